"""Query of the coded token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drayline.llm.base import table
from drayline.llm.queries import query
from drayline.llm.token_files import read_tokens, write_tokens
from drayline.session import shared_dir


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files and read back: place, length and checksum of each."""
    folder = shared_dir(spark, "llm-token-files")
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return read_tokens(spark, folder)
