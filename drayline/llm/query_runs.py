"""Query of the periodic runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.llm.base import table
from drayline.llm.queries import query
from drayline.llm.runs import with_runs

BLANKS = r"[\x20\x09-\x0D]+"


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """One text in ten, by the checksum of its id, made periodic from some word on."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    chosen = documents.select("doc_id", "text", hashed.alias("h"), F.floor(hashed / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.array_remove(F.split(F.col("text"), BLANKS), ""))
    sized = chosen.withColumn("words", words).withColumn("n", F.size("words"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))

    def source(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))

    places = F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)
    made = F.array_join(F.transform(places, lambda i: F.get("words", source(i).cast("int"))), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


@query("op12_runs")
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document: their number, the longest, and checksums of all runs and of the collapsed text."""
    documents = with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    # the greatest length, then the smallest start and period
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"], r.alias("run")))
    longest = F.array_max(ranked)["run"]
    found = with_runs(documents).withColumn("longest", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
