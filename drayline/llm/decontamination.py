"""Benchmark decontamination: windows of benchmark words looked up in all training texts.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. A benchmark
item gives its windows of ``words`` consecutive words, or a single window of all its words if it has fewer. The
hashes of the distinct windows are broadcast as a hash set when they are measured to be few; every document's
windows are streamed past it, and what meets a hash is held against the window's words. Windows of documents
leave the scan only when they are hits. Beyond the bound the windows are joined by their words in a shuffle.

All of it is DataFrame functions. A text's hits are found once per distinct text (by SHA-256), so thousands of
copies of a contaminated text become one group; the results are dealt to the documents under a salted key.

Defined cases: NULL, empty and word-free texts have no words and are never hit; an item without a word is never
found; items with the same id count as one; an item with a NULL id counts like one whose id is empty; an empty
benchmark hits nothing; very long texts are handled whole, a window at a time; repeated rows give repeated
results. Columns of the input with the names of the result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drayline.llm.base import staged

#: What parts words: ASCII characters other than digits and letters.
BREAKS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@dataclass(frozen=True)
class DecontaminationOptions:
    words: int = 10  # of a window
    broadcast_windows: int = 1 << 20  # as many distinct windows are broadcast at most (about 150 bytes each)
    salts: int = 16  # parts that the documents with one text are spread over


def words_of(text: Column) -> Column:
    """The words of a text, in order. (A split takes half the time of an extraction.)"""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), f"[{BREAKS}]+"), "")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BREAKS}]+"), "")).cast("long")


def item_windows(benchmark: DataFrame, options: DecontaminationOptions) -> DataFrame:
    """(window, size, item): the distinct windows of every item."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")
    ).withColumn("size", F.least(F.size("words"), F.lit(options.words)))
    places = F.when(F.col("size") > 0, F.sequence(F.lit(1), F.size("words") - F.col("size") + 1))
    placed = items.withColumn("place", F.explode_outer(places)).where(F.col("place").isNotNull())
    return placed.select(window_at("words").alias("window"), "size", "item").distinct()


def window_at(words: str) -> Column:
    """The words of a row's window."""
    return F.array_join(F.slice(words, F.col("place"), F.col("size")), " ")


def text_key() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def hits(df: DataFrame, windows: DataFrame, options: DecontaminationOptions) -> DataFrame:
    """(text_key, place, size, window): where windows (window, size) occur in the distinct texts."""
    known = windows.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    sizes = sorted(known["sizes"]) or [options.words]  # as many as a window has words, at most
    texts = df.select(text_key().alias("text_key"), words_of(F.col("text")).alias("words"))
    texts = texts.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    places = F.when(F.size("words") >= sizes[0], F.sequence(F.lit(1), F.size("words") - (sizes[0] - 1)))
    # outer: a plain explode has Spark filter by the size of the array, which computes the words twice
    placed = texts.withColumn("place", F.explode_outer(places)).where(F.col("place").isNotNull())
    if len(sizes) == 1:
        placed = placed.withColumn("size", F.lit(sizes[0]))
    else:
        placed = placed.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
        placed = placed.where(F.col("place") + F.col("size") - 1 <= F.size("words"))
    if known["n"] > options.broadcast_windows:
        found = placed.select("text_key", "place", "size", window_at("words").alias("window"))
        return found.join(windows, ["window", "size"]).select("text_key", "place", "size", "window").distinct()
    hashed = windows.select(
        "window", F.xxhash64(F.transform(F.split("window", " "), lambda w: F.xxhash64(w))).alias("hash")
    )
    here = placed.withColumn("hash", F.xxhash64(F.slice("hashes", F.col("place"), F.col("size")))).drop("hashes")
    # each a prefix of the other: said as an equality it would become a join key, spelled out for every window
    equal = window_at("words").startswith(F.col("window")) & F.col("window").startswith(window_at("words"))
    met = here.join(F.broadcast(hashed), "hash").where(equal)
    return met.select("text_key", "place", "size", "window").distinct()


def covered(found: DataFrame) -> DataFrame:
    """(text_key, first, end): the stretches of words that hits cover, apart from each other."""
    in_text = Window.partitionBy("text_key").orderBy("place", "size")
    reach = F.max(F.col("place") + F.col("size")).over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.select("text_key", "place", "size").withColumn("reach", reach)
    opens = F.coalesce(F.col("place") > F.col("reach"), F.lit(True)).cast("int")
    numbered = marked.withColumn("stretch", F.sum(opens).over(in_text))
    return numbered.groupBy("text_key", "stretch").agg(
        F.min("place").alias("first"), F.max(F.col("place") + F.col("size")).alias("end")
    )


def text_results(df: DataFrame, benchmark: DataFrame, options: DecontaminationOptions) -> DataFrame:
    """Per distinct text with hits: text_key, n_hit, n_items, items_sha256, stretches (first word, end; from 1)."""
    owned = staged(item_windows(benchmark, options), "decontamination-windows")
    small = owned.count() <= options.broadcast_windows
    found = staged(hits(df, owned.select("window", "size").distinct(), options), "decontamination-hits")
    stretch = F.struct("first", "end")
    counts = covered(found).groupBy("text_key").agg(
        F.sum(F.col("end") - F.col("first")).cast("long").alias("n_hit"),
        F.sort_array(F.collect_list(stretch)).alias("stretches"),
    )
    # a text's hits in one window are one row here, and an item is one row a text
    owners = owned.select("window", "item")
    items = found.select("text_key", "window").distinct().join(F.broadcast(owners) if small else owners, "window")
    named = items.select("text_key", "item").distinct().groupBy("text_key").agg(
        F.sort_array(F.collect_list("item")).alias("items")
    )
    return counts.join(named, "text_key").select(
        "text_key", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "stretches",
    )


def dealt(rows: DataFrame, results: DataFrame, options: DecontaminationOptions) -> DataFrame:
    """Rows (with _dc_key) joined with the results of their texts, NULL without hits; a text's rows are spread by salt."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(options.salts - 1)))
    renamed = results.select(*(F.col(c).alias(f"_dc_{c}") for c in results.columns)).withColumnRenamed("_dc_text_key", "_dc_key")
    spread = rows.withColumn("_dc_salt", F.pmod(F.monotonically_increasing_id(), F.lit(options.salts)).cast("int"))
    return spread.join(renamed.withColumn("_dc_salt", salts), ["_dc_key", "_dc_salt"], "left")


def contamination(df: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions()) -> DataFrame:
    """The input's rows, without text, with n_words, n_hit, n_items, items_sha256 and contaminated."""
    kept = [c for c in df.columns if c not in (*ADDED, "text")]
    rows = df.select(*kept, word_count(F.col("text")).alias("n_words"), text_key().alias("_dc_key"))
    found = dealt(rows, text_results(df, benchmark, options).drop("stretches"), options)
    return found.select(
        *kept, "n_words", F.coalesce("_dc_n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("_dc_n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("_dc_items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("_dc_n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(df: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions()) -> DataFrame:
    """The rows whose texts hold no benchmark window, with all their columns."""
    found = text_results(df, benchmark, options).select("text_key", "n_hit")
    met = dealt(df.withColumn("_dc_key", text_key()), found, options)
    return met.where(F.col("_dc_n_hit").isNull()).select(*df.columns)


def without_spans(df: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions()) -> DataFrame:
    """All rows, the words of benchmark windows cut out of their texts; what parts words goes with the word after it."""
    found = text_results(df, benchmark, options).select("text_key", "stretches")
    met = dealt(df.withColumn("_dc_key", text_key()), found, options)
    pieces = F.regexp_extract_all("text", F.lit(f"[{BREAKS}]*[^{BREAKS}]+|[{BREAKS}]+$"), F.lit(0))
    # what lies between the end of one stretch and the start of the next stays
    starts = F.concat(F.array(F.lit(1)), F.transform("_dc_stretches", lambda x: x["end"]))
    ends = F.concat(F.transform("_dc_stretches", lambda x: x["first"]), F.array(F.size("_dc_pieces") + 1))
    bounds = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    rest = F.transform(bounds, lambda x: F.array_join(F.slice("_dc_pieces", x["a"], x["b"] - x["a"]), ""))
    cut = met.withColumn("_dc_pieces", F.when(F.col("_dc_stretches").isNotNull(), pieces))
    text = F.when(F.col("_dc_stretches").isNull(), F.col("text")).otherwise(F.array_join(rest, ""))
    return cut.withColumn("text", text).select(*df.columns)
