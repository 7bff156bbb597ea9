"""Query of the cross-tokenizer alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drayline.llm.alignment import with_alignment
from drayline.llm.base import table
from drayline.llm.queries import query


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document by two tokenizers, and how its links stand in the corpus."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_alignment(documents, digest=True)
