"""Ordering, verification, progress and history (G, K11, V)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayline.operators import deps, keys, ledger, progress, verify
from drayline.plans.load import LoadOptions, load_tables
from drayline.plans.spec import TableSpec
from drayline.session import shared_dir
from drayline.sinks.snapshot import SnapshotTable
from drayline.sources import catalog, jdbc
from registry import query, table

# child, its column, parent, its column
REFERENCES = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
)
LOADED = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": [],
}

# ---------------------------------------------------------------------------
# Ordering: every record is a node that depends on the records it refers to.
# ---------------------------------------------------------------------------

_NODE_TABLES = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
    "supplier": "s_suppkey", "orders": "o_orderkey",
}
_EDGES = (
    ("nation", "n_nationkey", "region", "n_regionkey"),
    ("customer", "c_custkey", "nation", "c_nationkey"),
    ("supplier", "s_suppkey", "nation", "s_nationkey"),
    ("orders", "o_orderkey", "customer", "o_custkey"),
)
_NODES_SQL = " union all ".join(f"select '{t}' || {k} as node from {t}" for t, k in _NODE_TABLES.items())
_EDGES_SQL = " union all ".join(
    f"select '{c}' || {k} as child, '{p}' || {r} as parent from {c}" for c, k, p, r in _EDGES
)


def _records(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    node = lambda name, key: F.concat(F.lit(name), F.col(key))
    nodes = [table(spark, sf_dir, t).select(node(t, k).alias("node")) for t, k in _NODE_TABLES.items()]
    edges = [
        table(spark, sf_dir, c).select(node(c, k).alias("child"), node(p, r).alias("parent"))
        for c, k, p, r in _EDGES
    ]
    return reduce(DataFrame.unionAll, nodes), reduce(DataFrame.unionAll, edges)


@query(
    "dep_edges",
    f"with e as ({_EDGES_SQL}), n as ({_NODES_SQL}) select distinct child, parent from e "
    "where child <> parent and child in (select node from n where node not like 'supplier%') "
    "and parent in (select node from n)",
)
def dep_edges(spark, sf_dir):
    """References between known records; suppliers are left out of the nodes."""
    nodes, edges = _records(spark, sf_dir)
    loops = nodes.select(F.col("node").alias("child"), F.col("node").alias("parent"))
    known = nodes.where(~F.startswith("node", F.lit("supplier")))
    return deps.dependency_edges(known, edges.unionAll(loops).unionAll(edges))


@query(
    "dep_levels",
    f"""
    with recursive e as ({_EDGES_SQL}), n as ({_NODES_SQL}),
    walk(node, level) as (
        select node, 0 from n where node not in (select child from e)
        union all select e.child, walk.level + 1 from walk join e on e.parent = walk.node)
    select node, max(level)::int as level from walk group by node
    """,
)
def dep_levels(spark, sf_dir):
    return deps.dependency_levels(*_records(spark, sf_dir))


@query(
    "dep_levels_cycle",
    f"""
    with recursive e as ({_EDGES_SQL}), n as ({_NODES_SQL}),
    hit as (select 'orders' || o_orderkey as node from orders where o_custkey in
        (select c_custkey from customer where c_nationkey = 3)
        union all select 'customer' || c_custkey from customer where c_nationkey = 3
        union all select 'supplier' || s_suppkey from supplier where s_nationkey = 3
        union all select 'nation3'),
    walk(node, level) as (
        select node, 0 from n where node not in (select child from e)
        union all select e.child, walk.level + 1 from walk join e on e.parent = walk.node)
    select node, case when node in (select node from hit) then 4 else max(level)::int end as level
    from walk group by node
    """,
)
def dep_levels_cycle(spark, sf_dir):
    """A nation that refers to its own customers: all behind it come last."""
    nodes, edges = _records(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").where("c_nationkey = 3")
    back = customers.select(F.lit("nation3").alias("child"), F.concat(F.lit("customer"), "c_custkey").alias("parent"))
    return deps.dependency_levels(nodes, edges.unionAll(back))


@query(
    "dep_levels_chain",
    """
    with runs as (select event_id, event_id - row_number() over (order by event_id) as run from events)
    select event_id as node, (event_id - min(event_id) over (partition by run))::int as level from runs
    """,
)
def dep_levels_chain(spark, sf_dir):
    """Events that refer to the one before them, and each thousandth to the tenth before it too."""
    nodes = table(spark, sf_dir, "events").select(F.col("event_id").alias("node"))
    before = nodes.select(F.col("node").alias("child"), (F.col("node") - 1).alias("parent"))
    short_cut = nodes.where("node % 1000 = 0").select(F.col("node").alias("child"), (F.col("node") - 10).alias("parent"))
    return deps.dependency_levels(nodes, before.unionAll(short_cut))


@query(
    "load_by_levels",
    " union all ".join(
        f"select '{t}' as table_name, count(*) as source_rows, count(*) as target_rows, true as matches from {t}"
        for t in LOADED
    ),
)
def load_by_levels(spark, sf_dir):
    """Seven related tables loaded parents first, then compared."""
    tables = {name: table(spark, sf_dir, name) for name in LOADED}
    specs = {name: TableSpec(name, keys=key) for name, key in LOADED.items()}
    path = shared_dir(spark, "load")
    history = progress.RunHistory(spark, f"{path}/history")
    result = load_tables(
        spark, tables, path, specs, [(c, p) for c, _, p, _ in REFERENCES if c in LOADED],
        LoadOptions(fresh=True, buckets=8), history,
    )
    assert result.status == "success", result.errors
    return result.checks


@query(
    "load_with_rejects",
    "select 'orders' as table_name, count(*) as source_rows, count(*) filter (o_orderkey % 10 <> 0) as target_rows, "
    "count(*) filter (o_orderkey % 10 = 0) as rejected_rows, true as matches from orders",
)
def load_with_rejects(spark, sf_dir):
    """Rows that don't fit are written next to the table; both together are the source (V1)."""
    from drayline.plans.spec import ColumnMapping

    number = F.when(F.col("o_orderkey") % 10 == 0, F.lit("none")).otherwise(F.col("o_custkey").cast("string"))
    orders = table(spark, sf_dir, "orders").withColumn("o_custkey", number)
    spec = TableSpec("orders", [ColumnMapping("o_custkey", target_type="BIGINT")], keys=["o_orderkey"])
    result = load_tables(
        spark, {"orders": orders}, shared_dir(spark, "load"), {"orders": spec}, (), LoadOptions(fresh=True, on_error="reject")
    )
    assert result.status == "success", result.errors
    return result.checks


EVERY_TABLE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


@query(
    "load_typed",
    " union all ".join(
        f"select '{t}' as table_name, count(*) as source_rows, count(*) as target_rows, true as matches from {t}"
        for t in EVERY_TABLE
    ),
)
def load_typed(spark, sf_dir):
    """All tables with SQLite's types; the load dies once and goes on under its run id."""
    from drayline.plans.dialects import spark_type
    from drayline.plans.load import column_plan

    tables = {name: table(spark, sf_dir, name) for name in EVERY_TABLE}
    specs = {name: TableSpec(name, keys=LOADED.get(name, []), target_dialect="sqlite") for name in EVERY_TABLE}
    path, options = shared_dir(spark, "load"), LoadOptions(fresh=True, batches=4)
    lost = F.when(F.col("l_linenumber") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("l_tax"))
    damaged = tables | {"lineitem": tables["lineitem"].withColumn("l_tax", lost)}
    first = load_tables(spark, damaged, path, specs, (), options, run_id="run-1")
    assert first.status == "failed" and list(first.errors) == ["lineitem"], first.errors
    result = load_tables(spark, tables, path, specs, (), options, run_id="run-1")
    assert result.status == "success", result.errors
    for name in EVERY_TABLE:
        loaded = SnapshotTable(spark, f"{path}/{name}").read().schema
        planned = {c[2]: spark_type(c[3], "sqlite") for c in column_plan(tables[name], specs[name])}
        assert {f.name: f.dataType for f in loaded} == planned, name
    return result.checks


# ---------------------------------------------------------------------------
# Keys and references
# ---------------------------------------------------------------------------


@query(
    "key_validation",
    "select l_orderkey, l_linenumber, count(*) as row_count from lineitem "
    "group by l_orderkey, l_linenumber having count(*) > 1",
)
def key_validation(spark, sf_dir):
    return keys.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_KEY_REPORT = (
    "select '{t}' as table_name, sum(n)::bigint as row_count, count(*) as distinct_keys, "
    "coalesce(sum(n) filter (n > 1), 0)::bigint as rows_with_repeated_key, 0::bigint as rows_without_key, "
    "max(n) = 1 as is_key from (select count(*) as n from {t} group by {k})"
)


@query(
    "key_report",
    _KEY_REPORT.format(t="lineitem", k="l_orderkey, l_linenumber")
    + " union all "
    + _KEY_REPORT.format(t="conversations", k="conv_id, turn"),
)
def key_report(spark, sf_dir):
    chosen = {"lineitem": ["l_orderkey", "l_linenumber"], "conversations": ["conv_id", "turn"]}
    reports = [keys.key_report(table(spark, sf_dir, t), k, t) for t, k in chosen.items()]
    return reduce(DataFrame.unionAll, reports)


@query(
    "orphans",
    "select l_orderkey, count(*) as row_count from lineitem where l_orderkey not in "
    "(select o_orderkey from orders where o_orderkey % 7 > 0) group by l_orderkey",
)
def orphans(spark, sf_dir):
    kept = table(spark, sf_dir, "orders").where("o_orderkey % 7 > 0")
    return keys.orphans(table(spark, sf_dir, "lineitem"), kept, ["l_orderkey"], ["o_orderkey"])


@query(
    "orphan_report",
    " union all ".join(
        f"select '{c}' as child, '{k}' as child_columns, '{p}' as parent, count(*) as orphan_rows, "
        f"count(distinct {k}) as orphan_keys from {c} where {k} not in (select {r} from {p})"
        for c, k, p, r in REFERENCES
    ),
)
def orphan_report(spark, sf_dir):
    tables = {n: table(spark, sf_dir, n) for r in REFERENCES for n in (r[0], r[2])}
    references = [(c, [k], p, [r]) for c, k, p, r in REFERENCES]
    return keys.orphan_report(tables, references)


@query(
    "row_count_compare",
    """
    select coalesce(s.t, d.t) as table_name, s.n as source_rows, d.n as target_rows,
        s.n is not distinct from d.n as matches
    from (select source || '.' || lang as t, count(*) as n from documents group by 1) s
    full join (select source || '.' || lang as t, count(*) as n from documents where doc_id % 97 > 0
        and lang <> 'de' group by 1) d on s.t = d.t
    """,
)
def row_count_compare(spark, sf_dir):
    """Counts of both sides by name, with one side short of rows and names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws(".", "source", "lang").alias("table_name"))
    copy = docs.where("doc_id % 97 > 0 and lang <> 'de'")
    count = F.count(F.lit(1)).alias("row_count")
    return verify.compare_counts(docs.groupBy("table_name").agg(count), copy.groupBy("table_name").agg(count))


_TYPE_CASE = (
    "case p_size % 6 when 0 then 'integer' when 1 then 'numeric(10,2)' when 2 then 'VARCHAR' "
    "when 3 then 'bigserial' when 4 then 'double precision' else 'interval' end"
)
_TARGET_CASE = (
    "case p_partkey % 5 when 0 then 'BIGINT' when 1 then 'FLOAT' when 2 then 'DECIMAL(18,2)' "
    "when 3 then 'INT AUTO_INCREMENT' else 'TEXT' end"
)
_WHOLE = "(int|integer|bigint|smallint|tinyint|serial|bigserial)([ (].*)?"
_FLOAT = "(float|double|real|numeric|decimal)([ (].*)?"


@query(
    "type_warnings",
    f"""
    select p_partkey, case
        when regexp_full_match(lower(s), '{_WHOLE}') and regexp_full_match(lower(t), '{_FLOAT}')
            then 'Precision loss might occur.'
        when regexp_full_match(lower(s), '{_FLOAT}') and regexp_full_match(lower(t), '{_WHOLE}')
            then 'Fractional part will be truncated.' end as message
    from (select p_partkey, {_TYPE_CASE} as s, {_TARGET_CASE} as t from part)
    """,
)
def type_warnings(spark, sf_dir):
    message = verify.type_warning(F.expr(_TYPE_CASE), F.expr(_TARGET_CASE))
    return table(spark, sf_dir, "part").select("p_partkey", message.alias("message"))


@query(
    "lossy_cells",
    "select 'p_retailprice' as column_name, count(*) filter (p_retailprice <> trunc(p_retailprice)) as lossy_cells "
    "from part union all select 'whole', 0::bigint from part where p_partkey = (select min(p_partkey) from part) "
    "union all select 'large', count(*) filter (p_partkey % 2 = 1) from part",
)
def lossy_cells(spark, sf_dir):
    """Cells a retyping would change: prices to whole, large numbers to double."""
    parts = table(spark, sf_dir, "part").select(
        "p_retailprice",
        F.col("p_partkey").alias("whole"),
        (F.lit(2**53) + F.col("p_partkey") % 2).alias("large"),
    )
    return verify.lossy_cells(parts, to_float=["whole", "large"], to_whole=["p_retailprice"])


@query(
    "rerun_warnings",
    "select conv_id, not coalesce(bool_or(role = 'system'), false) as doubles from conversations group by conv_id",
)
def rerun_warnings(spark, sf_dir):
    """Tables that an append would double: those without a key (V4)."""
    listed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.bool_or(F.col("role") == "system").alias("has_pk")
    )
    return listed.select("conv_id", verify.rerun_warning(F.lit("append"), F.col("has_pk")).alias("doubles"))


# ---------------------------------------------------------------------------
# Progress and history: events stand for samples and runs
# ---------------------------------------------------------------------------

_PROGRESS = """
select user_id % 20 as run_id, user_id as table_name, ts, event_id,
    event_id % 1000 as migrated, case when user_id % 9 = 0 then 0 else 1000 end as total,
    case when event_type = 'purchase' then 'done' when event_type = 'click' then 'error' else 'running' end as status
from events
"""
# One moment per row, so that the newest row is well defined.
_PROGRESS_TS = _PROGRESS.replace("ts, event_id,", "event_id as ts,")
_LATEST = (
    "select run_id, table_name, arg_max(migrated, ts) as migrated, arg_max(total, ts) as total, "
    f"arg_max(status, ts) as status from ({_PROGRESS_TS}) group by run_id, table_name"
)


def _progress_rows(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(_PROGRESS_TS)


@query(
    "table_progress",
    f"select *, case when total > 0 then round(100.0 * migrated / total)::int else 0 end as percent from ({_LATEST})",
)
def table_progress(spark, sf_dir):
    return progress.table_progress(_progress_rows(spark, sf_dir))


@query(
    "progress_percent",
    "select run_id, sum(migrated)::bigint as migrated, sum(total)::bigint as total, count(*) as tables, "
    "count(*) filter (status = 'done') as tables_done, "
    "(20 + floor(sum(migrated)::double / greatest(sum(total), 1)::double * 75))::int as percent "
    f"from ({_LATEST}) group by run_id",
)
def progress_percent(spark, sf_dir):
    return progress.run_progress(_progress_rows(spark, sf_dir), base=20, span=75)


@query(
    "status_counts",
    f"select run_id, status, count(*) as tables from ({_LATEST}) group by run_id, status",
)
def status_counts(spark, sf_dir):
    return verify.status_counts(progress.latest_progress(_progress_rows(spark, sf_dir)), ["run_id"])


_SAMPLES = "select user_id % 4 as run_id, ts, event_id * 3 - (event_id % 17) * 40 as migrated, 25000 as total, event_id from events"


@query(
    "throughput_eta",
    f"""
    with s as ({_SAMPLES}),
    w as (select run_id, time_bucket(interval 5 seconds, ts) as tick, arg_min(migrated, ts) as migrated,
        arg_min(total, ts) as total, min(ts) as ts from s group by 1, 2),
    l as (select *, lag(ts) over r as ts1, lag(migrated) over r as migrated1, lag(ts, 2) over r as ts2,
        lag(migrated, 2) over r as migrated2 from w window r as (partition by run_id order by ts)),
    d as (select *, case when ts - ts1 >= interval 5 seconds then ts1 else ts2 end as ts0,
        case when ts - ts1 >= interval 5 seconds then migrated1 else migrated2 end as migrated0 from l),
    v as (select *, case when ts0 is not null then greatest(migrated - migrated0, 0)
        / ((epoch_us(ts) - epoch_us(ts0)) / cast(1000000 as double)) end as speed,
        greatest(total - migrated, 0) as rows_left from d)
    select run_id, cast(tick as varchar) as tick, migrated, round(speed, 6) as rows_per_second, rows_left,
        case when speed > 0 and rows_left > 0 then round(rows_left / speed, 3) end as eta_seconds from v
    """,
)
def throughput_eta(spark, sf_dir):
    """Rows per second and time left from samples of each run."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    ticks = progress.throughput(spark.sql(_SAMPLES))
    return ticks.select(
        "run_id",
        F.col("tick").cast("string").alias("tick"),
        "migrated",
        F.round("rows_per_second", 6).alias("rows_per_second"),
        "rows_left",
        F.round("eta_seconds", 3).alias("eta_seconds"),
    )


_RUNS = (
    "select event_id as run_id, event_type as source, 'warehouse' || (user_id % 3) as target, "
    "case when event_id % 5 = 0 then 'failed' else 'success' end as status, user_id % 10 as tables, "
    "user_id as rows, event_id % 60 as duration_s, ts as started_at from events"
)


@query(
    "run_history_latest",
    f"select run_id, source, target, status, rows from ({_RUNS}) order by started_at desc, run_id desc limit 20",
)
def run_history_latest(spark, sf_dir):
    """The 20 newest runs (V12): a top-k report."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    newest = progress.newest_first(spark.sql(_RUNS), 20)
    return newest.select("run_id", "source", "target", "status", "rows")


@query(
    "run_statistics",
    "select source, target, status, count(*) as runs, sum(rows)::bigint as rows, sum(duration_s)::bigint as duration_s, "
    f"case when sum(duration_s) > 0 then sum(rows)::double / sum(duration_s)::double end as rows_per_second from ({_RUNS}) "
    "group by source, target, status",
)
def run_statistics(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return progress.run_statistics(spark.sql(_RUNS))


@query("observed_rows", "select 'lineitem' as table_name, count(*) as rows from lineitem")
def observed_rows(spark, sf_dir):
    """Rows counted while they are written, without a second scan."""
    rows, seen = progress.counted(table(spark, sf_dir, "lineitem"))
    rows.write.parquet(shared_dir(spark, "observed"))
    return spark.createDataFrame([("lineitem", seen.get["rows"])], "table_name string, rows long")


@query(
    "plan_totals",
    "select count(*) as tables, sum(n)::bigint as rules_applied, sum(n)::bigint as columns_mapped "
    "from (select source, count(distinct lang) as n from documents group by source)",
)
def plan_totals(spark, sf_dir):
    """Tables and rules of a plan with one table per source and one rule per
    language in it (V6)."""
    from drayline.plans.spec import ColumnMapping

    found = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    # A plan is driver-side by nature: one entry per table and column.
    specs = {
        r.source: TableSpec(r.source, [ColumnMapping(c, action="transform", rules="trim") for c in r.langs])
        for r in found.collect()
    }
    return verify.plan_totals(spark, specs)


@query(
    "verified_target",
    "select 'orders' as table_name, count(*) as source_rows, count(*) as target_rows, true as matches from orders",
)
def verified_target(spark, sf_dir):
    target = SnapshotTable(spark, shared_dir(spark, "verified"))
    orders = table(spark, sf_dir, "orders")
    target.overwrite(orders, ["o_orderkey"], 8)
    return verify.compare_counts(
        catalog.row_counts({"orders": orders}), catalog.row_counts({"orders": target.read()})
    )


@query(
    "load_files",
    "select 'customer_' || lower(c_mktsegment) as table_name, count(*) as row_count, "
    "sum(c_custkey)::bigint as key_sum, sum(cast(round(c_acctbal * 100) as bigint))::bigint as cents "
    "from customer group by c_mktsegment",
)
def load_files_query(spark, sf_dir):
    """A folder of CSV, JSON Lines and Parquet files, one table per file name."""
    from drayline.plans.files import load_files

    source, target = shared_dir(spark, "files"), shared_dir(spark, "file-tables")
    customers = table(spark, sf_dir, "customer")
    # One folder per segment; the file in it is named after the segment.
    segments = [r[0] for r in customers.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    writers = ("csv", "json", "parquet")
    results = []
    for i, segment in enumerate(segments):
        rows = customers.where(F.col("c_mktsegment") == segment).select("c_custkey", "c_name", "c_acctbal")
        kind = writers[i % 3]
        folder = f"{source}/{segment}"
        (rows.write.option("header", True) if kind == "csv" else rows.write).format(kind).save(folder)
        result = load_files(
            spark, folder, f"{target}/{segment}", options=LoadOptions(fresh=True),
            file_format={"csv": "csv", "json": "jsonl", "parquet": "parquet"}[kind],
        )
        assert result.status == "success", result.errors
        for name in result.rows:
            loaded = SnapshotTable(spark, f"{target}/{segment}/{name}").read()
            results.append(loaded.select(F.lit(f"customer_{segment.lower()}").alias("table_name"), "c_custkey", "c_acctbal"))
    return (
        reduce(DataFrame.unionAll, results)
        .groupBy("table_name")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("c_custkey").alias("key_sum"),
            F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("cents"),
        )
    )


@query("split_parts", "select l_orderkey, l_linenumber, l_partkey, 1 as parts from lineitem")
def split_parts(spark, sf_dir):
    """In how many parts of equal depth each row falls, by the conditions a database would be asked with."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    # MySQL quotes names as Spark does
    predicates = jdbc.cut_predicates("mysql", "l_orderkey", jdbc.depth_cuts(lines, "l_orderkey", 16))
    inside = [F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates]
    return lines.withColumn("parts", reduce(lambda a, b: a + b, inside))


@query(
    "ledger_folded",
    "select o_orderkey // 5000 as batch_index, case when (o_orderkey // 5000) % 7 < 5 then 'done' else 'running' end as status, "
    "count(*) as row_count from orders group by 1",
)
def ledger_folded(spark, sf_dir):
    """Batches of orders marked in fifteen turns; every four marks become a snapshot."""
    plan = ledger.plan_batches(table(spark, sf_dir, "orders"), ledger.range_batch("o_orderkey", 5000), "orders")
    book = ledger.Ledger(spark, shared_dir(spark, "ledger"), fold_after=4)
    book.mark(plan, "run", ledger.PENDING)
    for status, turns in ((ledger.RUNNING, 7), (ledger.DONE, 5)):
        for turn in range(turns):
            book.mark(plan.where(F.col("batch_index") % 7 == turn), "run", status)
    if len(book._layout()[2]) >= 4:
        raise AssertionError("marks were not folded")
    return book.state("run", "orders").select("batch_index", "status", "row_count")
