import hashlib

from llm.conftest import rows_of
from pyspark.sql import functions as F

from drayline.llm import warc
from drayline.session import shared_dir

LONG = "<p>" + "same body " * 20 + "</p>"
PAGES = [
    (5, "http://www.Example.com:80/a?b#c", LONG), (3, "https://user@www.example.com/a?b", LONG), (3, "http://x.org", LONG),
    (4, "http://x.org", "short"), (6, "http://x.org", "short"), (7, None, None), (8, "no url\nat all", ""),
    (None, "http://x.org/z", LONG), (None, "http://y.org/", "n" * 200), (9, "http://x.org/" + "p" * 3000, "é" * 60),
    (10, "http://x.org/", "é" * 60),
]


def expected(pages):
    rows = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == raw and p is not None]
        first = min(same, default=None) if len(raw) >= 100 else None
        refers = first if first is not None and page_id != first else None
        kind = "response" if refers is None else "revisit"
        rows.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), kind, refers))
    return sorted(rows, key=str)


def frame(spark, pages):
    return spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, key string")


def test_written_and_read(spark):
    options = warc.WarcOptions(block_entries=2)
    found = warc.archived(spark, frame(spark, PAGES), shared_dir(spark, "test-warc"), options)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows_of(found.select(*columns)) == expected(PAGES)


def test_look_up_one_key(spark):
    folder = shared_dir(spark, "test-warc")
    many = PAGES + [(100 + i, "http://hot.net/", f"body {i}") for i in range(50)]
    warc.write_archives(frame(spark, many), folder, warc.WarcOptions(block_entries=3))
    keys = spark.createDataFrame([("http://HOT.net",), ("http://hot.net/",), ("http://none.net/",)], "url string")
    found = warc.captures(keys.select(warc.url_key(F.col("url")).alias("key")), folder, with_payload=True).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in found) == [(100 + i, f"body {i}".encode()) for i in range(50)]


def test_keys(spark):
    urls = ["http://a.b.Com:8080/X?y#z", "//a.b/", "mailto:x", None, "http://a.b"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key(F.col("url")).alias("key"))
    assert [r[0] for r in df.collect()] == ["com:8080,b,a)/X?y", "b,a)/", "mailto:x", "", "b,a)/"]


def test_empty_table(spark):
    assert warc.archived(spark, frame(spark, PAGES).limit(0), shared_dir(spark, "test-warc")).collect() == []


def test_records_are_read_by_many_tasks(spark):
    pages = spark.range(400).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://x.org/"), F.col("id") % 90).alias("url"), F.lit("z" * 300_000).alias("html")
    )
    found = warc.archived(spark, pages, shared_dir(spark, "test-warc"), warc.WarcOptions(block_entries=4))
    sizes = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in sizes) == 400 and len(sizes) >= 8 and max(r["n"] for r in sizes) <= 100
    assert found.where("payload_bytes = 300000").count() == 400
