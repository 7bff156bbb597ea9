"""Query of the N-best segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.llm.base import table
from drayline.llm.queries import query
from drayline.llm.segmentation import segmentation_summary


@query("op4_segmentation")
def op4_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every whole document: size, scores, checksums, and whether it decodes."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.select("doc_id", segmentation_summary(F.col("text")).alias("s")).select("doc_id", "s.*")
