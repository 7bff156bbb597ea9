"""Write modes, keys and resumable loads (K, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from drayline.operators import ledger as batches
from drayline.operators.mapping import apply_spec
from drayline.plans.load import dry_run
from drayline.plans.spec import TableSpec
from drayline.session import shared_dir
from drayline.sinks.snapshot import SnapshotTable, last_per_key, merge_rows
from registry import query, table
from registry.rules import CUSTOMER_SPEC, CUSTOMER_SQL, customer_rows
from registry.scans import KEYS, all_tables

BUCKETS = 16


def new_table(spark) -> SnapshotTable:
    return SnapshotTable(spark, shared_dir(spark, "table"))


@query("write_customer", CUSTOMER_SQL)
def write_customer(spark, sf_dir):
    """The flagship: map, clean and mask customers, write them by key, read back."""
    target = new_table(spark)
    rows = apply_spec(customer_rows(spark, sf_dir), CUSTOMER_SPEC).rows
    target.write(rows, CUSTOMER_SPEC.target_names(CUSTOMER_SPEC.keys), fresh=True, buckets=BUCKETS)
    return target.read()


@query("copy_lineitem", "select * from lineitem")
def copy_lineitem(spark, sf_dir):
    """A table without a key copied whole."""
    target = new_table(spark)
    target.overwrite(table(spark, sf_dir, "lineitem"))
    return target.read()


_NEW_ORDERS = """
select o_orderkey, o_custkey, 'X' as o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
from orders where o_orderkey % 10 = 0
union all
select o_orderkey + 1000000000, o_custkey, 'N', o_totalprice, o_orderdate, o_orderpriority
from orders where o_orderkey % 100 = 1
"""


def order_changes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    changed = orders.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    added = (
        orders.where("o_orderkey % 100 = 1")
        .withColumn("o_orderkey", F.col("o_orderkey") + 1000000000)
        .withColumn("o_orderstatus", F.lit("N"))
    )
    return changed.unionByName(added)


_UPSERTED = (
    "with s as (" + _NEW_ORDERS + ") select * from orders where o_orderkey not in (select o_orderkey from s) "
    "union all select * from s"
)


@query("upsert_update", _UPSERTED)
def upsert_update(spark, sf_dir):
    """Changed and new orders merged into a keyed table (small source)."""
    target = new_table(spark)
    target.overwrite(table(spark, sf_dir, "orders"), ["o_orderkey"], BUCKETS)
    target.upsert(order_changes(spark, sf_dir))
    return target.read()


@query("upsert_shuffled", _UPSERTED)
def upsert_shuffled(spark, sf_dir):
    """The same merge by the way that large sources take; done twice, it
    changes nothing more."""
    target = new_table(spark)
    target.overwrite(table(spark, sf_dir, "orders"), ["o_orderkey"], BUCKETS)
    for _ in range(2):
        target.upsert(order_changes(spark, sf_dir), broadcast_bytes=0)
    return target.read()


_SCATTERED = """
with changed as (
    select o_orderkey, o_custkey, 'S' as o_orderstatus, o_totalprice + 1000 as o_totalprice, o_orderdate, o_orderpriority
    from orders where o_orderkey % 97 = 5),
merged as (select * from orders where o_orderkey % 97 <> 5 union all select * from changed)
select 'merged' as way, * from merged union all select 'folded', * from merged
"""


@query("upsert_scattered", _SCATTERED)
def upsert_scattered(spark, sf_dir):
    """Few keys in all buckets of a table: written as they are, merged by readers, then folded into the rows."""
    orders = table(spark, sf_dir, "orders")
    target = new_table(spark)
    target.overwrite(orders, ["o_orderkey"], 4)
    changed = orders.where("o_orderkey % 97 = 5")
    target.upsert(changed.withColumns({"o_totalprice": F.col("o_totalprice") + 1000, "o_orderstatus": F.lit("S")}))
    before, added = target.state().parts
    if before.dead or not added.merges or added.size > before.size:
        raise AssertionError(f"{added.size} bytes written for {added.rows} rows")
    merged = target.read().select(F.lit("merged").alias("way"), "*")
    target.compact(most_merges=0)
    return merged.unionByName(target.read().select(F.lit("folded").alias("way"), "*"))


@query("append_grown", "select * from orders")
def append_grown(spark, sf_dir):
    """Eight appends to a keyed table of two buckets, which become as many as its size asks for."""
    orders = table(spark, sf_dir, "orders")
    target = SnapshotTable(spark, shared_dir(spark, "table"), bucket_bytes=16 * 1024)
    target.create(orders.schema, ["o_orderkey"], 2)
    for step in range(8):
        target.append(orders.where(F.pmod(F.hash("o_orderkey"), F.lit(8)) == step), most_parts=3)
    state = target.state()
    if state.buckets < 4 or len(state.parts) > 6 or any(p.size > 2 * p.buckets * 16 * 1024 for p in state.parts):
        raise AssertionError(f"parts of {[(p.buckets, p.size) for p in state.parts]}")
    return target.read()


@query("merge_rows", _UPSERTED)
def merge_rows_query(spark, sf_dir):
    """The merge as a plan over two DataFrames, without a target table."""
    return merge_rows(table(spark, sf_dir, "orders"), order_changes(spark, sf_dir), ["o_orderkey"])


@query(
    "upsert_ignore",
    "select distinct o_custkey, o_orderpriority from orders",
)
def upsert_ignore(spark, sf_dir):
    """A table of keys only: existing pairs stay, missing ones are added (K5)."""
    pairs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    keys = ["o_custkey", "o_orderpriority"]
    target = new_table(spark)
    target.overwrite(pairs.where("o_custkey % 2 = 0").distinct(), keys, BUCKETS)
    target.upsert(pairs.distinct())
    return target.read()


_LAST_EVENT = (
    "select user_id, arg_max(event_id, event_id) as event_id, arg_max(event_type, event_id) as event_type, "
    "arg_max(value, event_id) as value from events group by user_id"
)


@query("upsert_last_wins", _LAST_EVENT)
def upsert_last_wins(spark, sf_dir):
    """Repeated keys in the source: the last by sequence is kept (K7)."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    target = new_table(spark)
    target.create(events.schema, ["user_id"], BUCKETS)
    target.upsert(events, sequence="event_id")
    return target.read()


@query("last_per_key", _LAST_EVENT)
def last_per_key_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return last_per_key(events, ["user_id"], "event_id")


@query("append_no_key", "select * from labels union all select * from labels")
def append_no_key(spark, sf_dir):
    target = new_table(spark)
    labels = table(spark, sf_dir, "labels")
    target.write(labels)
    target.write(labels)
    return target.read()


@query("overwrite_fresh", "select * from supplier")
def overwrite_fresh(spark, sf_dir):
    """Drop and reload: what the table held before is gone (K2)."""
    target = new_table(spark)
    suppliers = table(spark, sf_dir, "supplier")
    target.overwrite(suppliers.unionByName(suppliers.withColumn("s_suppkey", -F.col("s_suppkey"))), ["s_suppkey"], 4)
    target.write(suppliers, ["s_suppkey"], fresh=True, buckets=BUCKETS)
    return target.read()


@query(
    "dry_run_plan",
    " union all ".join(
        f"select '{name}' as table_name, '{'upsert' if name in KEYS else 'append'}' as mode, "
        f"{str(name in KEYS).lower()} as has_key, {str(name not in KEYS).lower()} as doubles_on_rerun, "
        f"count(*) as row_count from {name}"
        for name in (*KEYS, "lineitem")
    ),
)
def dry_run_plan(spark, sf_dir):
    specs = {name: TableSpec(name, keys=keys) for name, keys in KEYS.items()}
    plan = dry_run(spark, all_tables(spark, sf_dir), specs)
    return plan.select("table_name", "mode", "has_key", "doubles_on_rerun", "row_count")


@query(
    "batch_plan",
    "select 'orders' as table_name, o_orderkey // 1000 as batch_index, 'pending' as status, "
    "count(*) as row_count from orders group by o_orderkey // 1000",
)
def batch_plan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return batches.plan_batches(orders, batches.range_batch("o_orderkey", 1000), "orders")


@query(
    "resume_pending",
    "select o_orderkey, o_orderstatus from orders where (o_orderkey // 1000) % 2 = 1",
)
def resume_pending(spark, sf_dir):
    """Rows still to load when the even batches are done."""
    orders = table(spark, sf_dir, "orders")
    batch = batches.range_batch("o_orderkey", 1000)
    done = orders.select(batch.alias("batch_index")).where("batch_index % 2 = 0").distinct()
    return batches.pending_rows(orders, batch, done).select("o_orderkey", "o_orderstatus")


_LEDGER = """
select user_id % 7 as run, user_id as batch_index, event_id,
    case event_type when 'click' then 'running' when 'purchase' then 'done' when 'view' then 'pending' else 'failed' end as status
from events
"""


@query(
    "ledger_state",
    f"select run, batch_index, arg_max(status, event_id) as status, arg_max(event_id, event_id) as row_count "
    f"from ({_LEDGER}) group by run, batch_index",
)
def ledger_state(spark, sf_dir):
    """Latest status of each batch from its events."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    events = spark.sql(_LEDGER).withColumn("row_count", F.col("event_id"))
    return batches.current_state(events, ["run", "batch_index"], "event_id").drop("updated_at")


@query(
    "ledger_completed",
    f"select run, batch_index from (select run, batch_index, arg_max(status, event_id) as status "
    f"from ({_LEDGER}) group by run, batch_index) where status = 'done'",
)
def ledger_completed(spark, sf_dir):
    return batches.completed(ledger_state(spark, sf_dir)).select("run", "batch_index")


@query("resumed_load", "select * from orders")
def resumed_load(spark, sf_dir):
    """A load that dies half way and is run again: the table is whole."""
    orders = table(spark, sf_dir, "orders")
    target, path = new_table(spark), shared_dir(spark, "ledger")
    book = batches.Ledger(spark, path)
    broken = F.when(
        batches.hash_batch(["o_orderkey"], BUCKETS) % 2 == 1, F.raise_error(F.lit("lost")).cast("string")
    ).otherwise(F.col("o_orderstatus"))
    arguments = ("run-1", "orders", ["o_orderkey"], BUCKETS)
    try:
        damaged = orders.withColumn("o_orderstatus", broken)
        batches.resumable_load(damaged, target, book, *arguments, waves=2)
    except Exception as error:
        if "lost" not in str(error):
            raise
    batches.resumable_load(orders, target, book, *arguments)
    assert book.is_complete("run-1", ["orders"])
    return target.read()


@query(
    "resumed_two_tables",
    "select 'orders' as table_name, o_orderkey as order_key, o_totalprice as amount from orders "
    "union all select 'lineitem', l_orderkey, l_extendedprice from lineitem",
)
def resumed_two_tables(spark, sf_dir):
    """Two tables of one run, one of them without a key; the second dies once and is run again."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    book = batches.Ledger(spark, shared_dir(spark, "ledger"))
    first, second = new_table(spark), new_table(spark)
    batches.resumable_load(orders, first, book, "run-1", "orders", ["o_orderkey"], BUCKETS)
    late = batches.hash_batch(lines.columns, BUCKETS) % 2 == 1
    broken = F.when(late, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("l_tax"))
    # The damaged cells are seen after the batch of a row is told.
    damaged = lines.withColumn("_late", late).withColumn("l_tax", broken).where("not _late or l_tax >= 0").drop("_late")
    arguments = ("run-1", "lineitem", [], BUCKETS)
    try:
        batches.resumable_load(damaged, second, book, *arguments, waves=2)
    except Exception as error:
        if "lost" not in str(error):
            raise
    assert not book.is_complete("run-1", ["orders", "lineitem"])
    batches.resumable_load(lines, second, book, *arguments, waves=2)
    assert book.is_complete("run-1", ["orders", "lineitem"])
    return first.read().select(
        F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("amount")
    ).unionByName(
        second.read().select(
            F.lit("lineitem").alias("table_name"),
            F.col("l_orderkey").alias("order_key"),
            F.col("l_extendedprice").alias("amount"),
        )
    )


_REPEATED_OLD = """
select l_orderkey as k, nullif(l_linenumber, 3) as n, cast(l_quantity as bigint) as q from lineitem
union all
select l_orderkey, l_linenumber, cast(l_quantity as bigint) * 2 from lineitem where l_linenumber = 1
"""
_REPEATED_NEW = """
select l_orderkey as k, l_linenumber as n, -sum(cast(l_quantity as bigint))::bigint as q
from lineitem where l_orderkey % 3 = 0 and l_linenumber <= 2 group by l_orderkey, l_linenumber
"""


@query(
    "upsert_repeated_keys",
    f"with old as ({_REPEATED_OLD}), new as ({_REPEATED_NEW}), merged as ("
    "select * from old where not exists (select 1 from new where new.k = old.k and new.n = old.n) "
    "union all select * from new) "
    "select 'broadcast' as way, k, n, q from merged union all select 'shuffled', k, n, q from merged",
)
def upsert_repeated_keys(spark, sf_dir):
    """Both ways of merging keep the same old rows, with repeated and NULL keys among them."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    old, new = spark.sql(_REPEATED_OLD), spark.sql(_REPEATED_NEW)
    results = []
    for way, limit in (("broadcast", None), ("shuffled", 0)):
        target = new_table(spark)
        target.overwrite(old, ["k", "n"])
        target.upsert(new, **({} if limit is None else {"broadcast_bytes": limit}))
        results.append(target.read().select(F.lit(way).alias("way"), "k", "n", "q"))
    return results[0].unionByName(results[1])


@query("append_compacted", "select event_id, user_id, event_type, value from events")
def append_compacted(spark, sf_dir):
    """Eleven appends to a table that keeps two parts alike at most: its live entries stay few."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    target = new_table(spark)
    target.create(events.schema)
    for step in range(11):
        target.append(events.where(F.col("event_id") % 11 == step), most_parts=2)
    assert len(target.state().parts) <= 6, target.state().parts
    return target.read()


@query("overwrite_odd_names", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def overwrite_odd_names(spark, sf_dir):
    """A keyed table without a named number of buckets, read from a folder with blanks in its name."""
    path = f"{shared_dir(spark, 'odd')}/a folder (1)"
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.parquet(path)
    target = SnapshotTable(spark, f"{path} copy")
    target.overwrite(spark.read.parquet(path), ["o_orderkey"])
    return target.read()


@query(
    "view_as_table",
    "select o_orderkey, c_name, o_totalprice from orders join customer on c_custkey = o_custkey "
    "where c_mktsegment = 'BUILDING'",
)
def view_as_table(spark, sf_dir):
    """A view is read like a table and written as one."""
    from drayline.sources.catalog import materialize_view

    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    view = joined.where("c_mktsegment = 'BUILDING'").select("o_orderkey", "c_name", "o_totalprice")
    view.createOrReplaceTempView("building_orders")
    return materialize_view(spark, "building_orders", shared_dir(spark, "view"))
