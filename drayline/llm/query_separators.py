"""Query of the separator scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drayline.llm.base import table
from drayline.llm.queries import query
from drayline.llm.separators import counted_documents
from drayline.session import shared_dir


@query("op7_separator_scan")
def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files that know nothing but ids."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted_documents(documents, shared_dir(spark, "llm-flat"))
