"""The shape of the physical plans: what is read, pushed down and shuffled."""

import re

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from drayline.operators.inference import infer_types
from drayline.operators.ledger import Ledger, pending_rows, range_batch, resumable_load
from drayline.operators.mapping import apply_rules, apply_spec, cast_columns
from drayline.operators.progress import newest_first
from drayline.plans.dialects import translate_types
from drayline.plans.spec import TableSpec
from drayline.sinks.snapshot import SnapshotTable, _newest, key_bucket
from registry import table
from registry.rules import CUSTOMER_SPEC, customer_rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"^[ :+-]*Exchange ", plan(df), re.M))


def test_filters_and_columns_reach_the_scan(spark):
    rows = apply_spec(customer_rows(spark, SF_DIR), CUSTOMER_SPEC).rows
    text = plan(rows.where("id > 100").select("id", "segment"))
    assert "PushedFilters: [IsNotNull(c_custkey), GreaterThan(c_custkey,100)]" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in text


def test_rules_need_no_python_and_no_shuffle(spark):
    chain = "strip_html|trim|titlecase|mask_email|mask_credit_card|hash|truncate:9|coalesce:x|nullif:y|to_boolean"
    text = plan(apply_rules(table(spark, SF_DIR, "documents"), "text", chain))
    assert "Python" not in text and "Exchange" not in text
    rows = cast_columns(
        table(spark, SF_DIR, "documents").select("text", F.col("doc_id").cast("string").alias("d")),
        {"d": "BIGINT"}, "postgresql", "reject",
    ).rows
    assert "Python" not in plan(rows) and exchanges(rows) == 0
    # Rows are told apart after the cast, which therefore runs once.
    assert plan(rows).count("try_cast") == 1 or plan(rows).count("as bigint") <= 2


def test_inference_is_one_small_exchange(spark):
    df = table(spark, SF_DIR, "lineitem")
    found = infer_types(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]))
    assert exchanges(found) == 1 and "Exchange SinglePartition" in plan(found)


def test_a_large_merge_shuffles_once(spark):
    old = table(spark, SF_DIR, "orders")
    bucket = key_bucket(["o_orderkey"], 8)
    merged = _newest(old, old.where("o_orderkey % 3 = 0"), ["o_orderkey"], bucket, 8, 20)
    assert exchanges(merged) == 1 and "Window" in plan(merged)
    # 20 partitions' worth of rows in 8 buckets: three slices of each.
    assert "table_bucket#" in plan(merged) and ", 24), REPARTITION_BY_NUM" in plan(merged)


def test_type_rules_are_broadcast(spark):
    types = table(spark, SF_DIR, "part").select(F.col("p_type").alias("data_type"))
    assert exchanges(translate_types(types, "mysql", "postgresql")) == 0


def test_resume_and_reports(spark):
    orders = table(spark, SF_DIR, "orders")
    done = table(spark, SF_DIR, "nation").select(F.col("n_nationkey").alias("batch_index"))
    rows = pending_rows(orders, range_batch("o_orderkey", 100), done)
    assert "BroadcastHashJoin" in plan(rows) and "LeftAnti" in plan(rows)
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    assert "TakeOrderedAndProject" in plan(newest_first(runs, 5))


def shuffle_bytes(spark) -> int:
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_a_copy_without_key_shuffles_nothing(spark, folder):
    before = shuffle_bytes(spark)
    SnapshotTable(spark, str(folder / "t")).overwrite(table(spark, SF_DIR, "lineitem"))
    assert shuffle_bytes(spark) == before


def test_a_large_load_by_key_shuffles_nothing(spark, folder):
    """Each task writes its rows into the few folders of the batches; small loads still get one file per folder."""
    texts = [F.lit("").alias(f"t{i}") for i in range(8)]
    for name, count, least, most in (("large", 800_000, 5, 64), ("small", 8_000, 4, 4)):
        rows, target = spark.range(count).select("id", *texts), SnapshotTable(spark, str(folder / name))
        before = shuffle_bytes(spark)
        assert resumable_load(rows, target, Ledger(spark, str(folder / "l")), "r", name, ["id"], 4) == count
        assert shuffle_bytes(spark) - before < 200_000  # 6 MB if the large one were shuffled
        files = list((folder / name / "data").glob("table_part=*/table_bucket=*/*.parquet"))
        assert least <= len(files) <= most and {f.parent.name for f in files} == {f"table_bucket={b}" for b in range(4)}
        assert tuple(target.read().agg(F.count("id"), F.sum("id")).first()) == (count, count * (count - 1) // 2)
        some = target.read([1])
        assert some.count() == rows.where(key_bucket(["id"], 4) == 1).count() == some.where(key_bucket(["id"], 4) == 1).count()


@pytest.mark.parametrize("limit, shuffled", [(1 << 20, False), (0, True)])
def test_a_small_upsert_does_not_shuffle_old_rows(spark, folder, limit, shuffled):
    target = SnapshotTable(spark, str(folder / "t"))
    orders = table(spark, SF_DIR, "orders")
    target.overwrite(orders, ["o_orderkey"], 4)
    before = shuffle_bytes(spark)
    target.upsert(orders.where("o_orderkey % 7 = 0"), broadcast_bytes=limit)
    # 1,500 old rows take more than 20 kB, the 214 new ones far less; too many to be left to readers.
    assert (shuffle_bytes(spark) - before > 20_000) == shuffled


def test_direct_columns_stay_columns(spark):
    rows = apply_spec(table(spark, SF_DIR, "orders"), TableSpec("orders")).rows
    assert "Project" not in plan(rows)


def test_approximate_counts_read_footers_only(spark):
    from drayline.sources.catalog import approximate_counts, footer_counts

    (frame,) = footer_counts(spark, {"t": f"{SF_DIR}/orders.parquet"})
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    rows = spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    assert [tuple(r) for r in approximate_counts(spark, {"t": f"{SF_DIR}/orders.parquet"}).collect()] == [("t", rows)]
    assert approximate_counts(spark, {}).count() == 0
