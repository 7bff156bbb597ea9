"""Sources, listings, inference and catalogs (S, D, I).

Files are written from a given table into the shared folder first, damaged
where the query is about damage, and then read back whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayline.operators.inference import infer_record_keys, infer_types
from drayline.operators.mapping import cast_columns
from drayline.session import shared_dir
from drayline.sources import catalog, files, listing
from registry import query, table

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"],
    "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}
TABLES = (*KEYS, "lineitem")


def all_tables(spark, sf_dir) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in sorted(TABLES)}


@query("scan_parquet", "select * from customer")
def scan_parquet(spark, sf_dir):
    return files.read_parquet(spark, f"{sf_dir}/customer.parquet")


ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double precision",
    "o_orderdate": "timestamp without time zone",
}


@query("scan_csv_typed", "select * from orders")
def scan_csv_typed(spark, sf_dir):
    path = shared_dir(spark, "csv")
    table(spark, sf_dir, "orders").write.option("header", True).csv(path)
    return cast_columns(files.read_csv(spark, path), ORDER_TYPES, "postgresql").rows


@query("scan_tsv", "select * from supplier")
def scan_tsv(spark, sf_dir):
    path = shared_dir(spark, "tsv")
    table(spark, sf_dir, "supplier").write.option("header", True).option("sep", "\t").csv(path)
    read = files.read_csv(spark, path, separator="\t")
    types = {"s_suppkey": "bigint", "s_nationkey": "integer", "s_acctbal": "double precision"}
    return cast_columns(read, types, "postgresql").rows


@query("scan_csv_quoted_text", "select doc_id, text, lang, source, n_chars from documents")
def scan_csv_quoted_text(spark, sf_dir):
    """Texts with quotes, commas and line breaks, partly in Latin-1 files."""
    path = shared_dir(spark, "quoted")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    latin = F.expr("text = decode(encode(text, 'UTF-8'), 'UTF-8') and text rlike '^[\\\\x00-\\\\xff]*$'")
    for name, rows, encoding in (("a", docs.where(latin), "ISO-8859-1"), ("b", docs.where(~latin), "UTF-8")):
        (
            rows.write.option("header", True).option("escape", '"').option("quoteAll", True)
            .option("encoding", encoding).csv(f"{path}/{name}")
        )
    read = files.read_csv(spark, [f"{path}/a", f"{path}/b"])
    return cast_columns(read, {"doc_id": "bigint", "n_chars": "bigint"}, "postgresql").rows


def _write_lines(rows: DataFrame, first: str, path: str, last: str | None = None) -> None:
    """Text files of ``rows`` (document, value) between a first and a last line; one file per document."""
    bounds = [F.struct(F.lit(0).alias("o"), F.lit(first).alias("v"))]
    bounds += [] if last is None else [F.struct(F.lit(2).alias("o"), F.lit(last).alias("v"))]
    around = rows.select("document").distinct().select("document", F.explode(F.array(*bounds)).alias("x")).select("document", "x.o", "x.v")
    lines = rows.select("document", F.lit(1).alias("o"), F.col("value").alias("v")).unionByName(around)
    sorted_lines = lines.repartition("document").sortWithinPartitions("document", "o")
    sorted_lines.select("document", F.col("v").alias("value")).write.partitionBy("document").text(path)


@query("scan_csv_spanning", "select doc_id, n_chars || '\"' as mark, text, lang, source from documents")
def scan_csv_spanning(spark, sf_dir):
    """Cells that span lines behind inch marks that stand in plain cells; a file per 1,000 documents."""
    path = shared_dir(spark, "spanning")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    cells = F.concat_ws(",", "doc_id", F.concat("n_chars", F.lit('"')), quoted, "lang", "source")
    docs = table(spark, sf_dir, "documents")
    _write_lines(docs.select(F.floor(F.col("doc_id") / 1000).alias("document"), cells.alias("value")), "doc_id,mark,text,lang,source", path)
    return cast_columns(files.read_csv(spark, f"{path}/document=*"), {"doc_id": "bigint"}, "postgresql").rows


def _event_lines(spark, sf_dir) -> str:
    """Events as JSON Lines with blank, broken and non-object lines between."""
    path = shared_dir(spark, "jsonl")
    events = table(spark, sf_dir, "events")
    good = F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    number = F.col("event_id") % 10
    extra = (
        F.when(number == 0, F.lit('{"event_id": 1, "broken'))
        .when(number == 1, F.concat(F.lit("["), F.col("event_id"), F.lit("]")))
        .when(number == 2, F.lit("   "))
        .when(number == 3, F.lit('"text"'))
    )
    lines = events.select(F.explode(F.filter(F.array(good, extra), lambda x: x.isNotNull())).alias("value"))
    lines.write.text(path)
    return path


@query(
    "scan_jsonl_skip_bad",
    "select event_id, ts, user_id, event_type, value, props from events",
)
def scan_jsonl_skip_bad(spark, sf_dir):
    keys = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    rows, _ = files.read_jsonl(spark, _event_lines(spark, sf_dir), keys)
    types = {
        "event_id": "bigint", "ts": "timestamp without time zone", "user_id": "bigint", "value": "double precision",
    }
    return cast_columns(rows, types, "postgresql").rows.select(*keys)


@query(
    "scan_jsonl_rejects",
    "select '[' || event_id || ']' as record from events where event_id % 10 = 1 union all "
    "select '{\"event_id\": 1, \"broken' from events where event_id % 10 = 0 union all "
    "select '\"text\"' from events where event_id % 10 = 3",
)
def scan_jsonl_rejects(spark, sf_dir):
    return files.read_jsonl(spark, _event_lines(spark, sf_dir), ["event_id"])[1].select("record")


@query("scan_json_array", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def scan_json_array(spark, sf_dir):
    """One JSON array per nation with scalars between the objects."""
    path = shared_dir(spark, "json")
    record = F.to_json(F.struct("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))
    # One document per 1,000 suppliers, so a document's size is bounded.
    document = F.floor(F.col("s_suppkey") / 1000)
    text = F.concat(F.lit('[1, "x", null, '), F.array_join(F.collect_list(record), ", "), F.lit("]"))
    suppliers = table(spark, sf_dir, "supplier")
    documents = suppliers.groupBy(document.alias("d")).agg(text.alias("value"))
    documents.repartition("d").write.partitionBy("d").text(path)
    read = files.read_json(spark, f"{path}/d=*", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    types = {"s_suppkey": "bigint", "s_nationkey": "integer", "s_acctbal": "double precision"}
    return cast_columns(read, types, "postgresql").rows


@query("scan_json_documents", "select * from orders")
def scan_json_documents(spark, sf_dir):
    """Long JSON arrays, of up to 25,000 orders each, with arrays and text between the objects."""
    path = shared_dir(spark, "json")
    orders = table(spark, sf_dir, "orders")
    order = F.to_json(F.struct(*orders.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    document = F.floor(F.col("o_orderkey") / 100_000)
    _write_lines(orders.select(document.alias("document"), F.concat(F.lit(","), order).alias("value")), '[[{"no": "[{"}], "}{"', path, "]")
    read = files.read_json(spark, f"{path}/document=*", orders.columns)
    return cast_columns(read, ORDER_TYPES, "postgresql").rows


@query("scan_workbooks", "select s_suppkey, s_name, s_acctbal from supplier")
def scan_workbooks(spark, sf_dir):
    """Suppliers as many small workbooks, read back in one job."""
    from drayline.sources.workbooks import read_workbooks
    from registry.workbook_files import write_workbooks

    path = shared_dir(spark, "xlsx")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    write_workbooks(suppliers, F.floor(F.col("s_suppkey") / 1000), path)
    read = read_workbooks(spark, f"{path}/*.xlsx", ["s_suppkey", "s_name", "s_acctbal"])
    types = {"s_suppkey": "bigint", "s_acctbal": "double precision"}
    return cast_columns(read, types, "postgresql").rows


_STEM = "regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '')"


@query(
    "table_name_from_path",
    f"""
    select page_id, case when c = '' then 'imported_file' when regexp_matches(c, '^[0-9]') then '_' || c
        else c end as table_name
    from (select page_id, regexp_replace({_STEM}, '[^\\p{{L}}\\p{{N}}_]', '_', 'g') as c from pages)
    """,
)
def table_name_from_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", listing.table_name(F.col("url")).alias("table_name"))


_SUFFIX = "case page_id % 9 when 0 then '.json' when 1 then '.JSONL' when 2 then '.ndjson' when 3 then '.csv' when 4 then '.Tsv' when 5 then '.xlsx' when 6 then '.xls' when 7 then '.parquet' else '.pdf' end"


@query(
    "detect_format",
    "select page_id, case when url like '%/' then null else case page_id % 9 when 0 then 'json' when 1 then 'jsonl' when 2 then 'jsonl' "
    "when 3 then 'csv' when 4 then 'csv' when 5 then 'xlsx' when 6 then 'xlsx' when 7 then 'parquet' end "
    "end as format from pages",
)
def detect_format(spark, sf_dir):
    path = F.concat("url", F.expr(_SUFFIX))
    return table(spark, sf_dir, "pages").select("page_id", listing.detect_format(path).alias("format"))


@query(
    "list_files",
    "select 'csv' as format, 'customer_' || lower(c_mktsegment) as table_name, "
    "count(*)::bigint as row_count from customer group by c_mktsegment",
)
def list_files(spark, sf_dir):
    """One file per segment; the listing routes each to a reader and a table."""
    base = shared_dir(spark, "listing")
    customers = table(spark, sf_dir, "customer")
    segment = F.concat(F.lit("customer "), F.lower("c_mktsegment"), F.lit(".csv"))
    customers.select("c_custkey", segment.alias("file")).repartition("file").write.partitionBy("file").option(
        "header", True
    ).csv(base)
    # The folder carries the name here; a file of a real source carries it itself.
    found = listing.list_files(spark, base, recursive=True, file_format=None)
    name = F.url_decode(F.regexp_extract("path", "file=([^/]*)/", 1))
    named = found.select("path", listing.detect_format(name).alias("format"), listing.table_name(name).alias("table_name"))
    rows = files.read_csv(spark, f"{base}/*", check_files=False).select(
        F.col("_metadata.file_path").alias("path")
    )
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    clean = F.regexp_extract(F.url_decode("path"), "[^/]*/[^/]*$", 0)
    return (
        named.withColumn("key", clean)
        .join(counts.withColumn("key", clean).select("key", "n"), "key")
        .groupBy("format", "table_name")
        .agg(F.sum("n").alias("row_count"))
    )


@query(
    "select_tables",
    "select doc_id, source from documents where source in "
    "(select source from documents group by source having count(*) * 100 > (select count(*) from documents))",
)
def select_tables(spark, sf_dir):
    """Rows whose group is selected by a DataFrame of names."""
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.count(F.lit(1))).scalar()
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return listing.select_names(docs.select("doc_id", "source"), sizes.where(F.col("n") * 100 > total), "source")


_NAMES = "case when doc_id % 5 = 0 then 'doc_' || doc_id else source || '.' || lang || '_' || (doc_id % 100) end"


@query(
    "filter_schemas",
    f"select distinct t as table_name from (select {_NAMES} as t from documents) "
    "where case when instr(t, '.') > 0 then split_part(t, '.', 1) else 'default' end = 'default'",
)
def filter_schemas(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.expr(_NAMES).alias("table_name")).distinct()
    return listing.filter_schemas(names, ["default"])


@query(
    "tables_by_schema",
    f"""
    with n as (select distinct {_NAMES} as table_name from documents),
    s as (select *, case when instr(table_name, '.') > 0 then split_part(table_name, '.', 1)
        else 'default' end as table_schema from n)
    select table_schema, table_name, count(*) over (partition by table_schema) as tables from s
    """,
)
def tables_by_schema(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.expr(_NAMES).alias("table_name"))
    return listing.tables_by_schema(names)


# ---------------------------------------------------------------------------
# Inference
# ---------------------------------------------------------------------------

_RANKED = """
case when trim({c}) = '' or {c} is null then 0 when lower(trim({c})) in ('true', 'false') then 1
    when regexp_full_match(trim({c}), '[+-]?[0-9]+(_[0-9]+)*') then 2
    when regexp_full_match(lower(trim({c})), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?|[+-]?(nan|inf|infinity)')
    then 3 when regexp_full_match(trim({c}),
    '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?)?')
    then 4 else 5 end
"""
_TYPE_NAMES = (
    "case max(r) when 1 then 'BOOLEAN' when 2 then 'BIGINT' when 3 then 'DOUBLE PRECISION' "
    "when 4 then 'TIMESTAMP' else 'TEXT' end"
)


def _inference_sql(source: str, columns: dict[str, str]) -> str:
    parts = [
        f"select {i} as ordinal, '{name}' as column_name, {_TYPE_NAMES} as data_type, min(r) = 0 as is_nullable "
        f"from (select {_RANKED.format(c='v')} as r from (select {text} as v from {source}))"
        for i, (name, text) in enumerate(columns.items())
    ]
    return " union all ".join(parts)


EVENT_TEXT = {
    "event_id": "cast(event_id as varchar)", "ts": "cast(ts as varchar)",
    "user_id": "cast(user_id as varchar)", "event_type": "event_type",
    "value": "cast(value as varchar)", "props": "props",
    "flag": "case when event_id % 2 = 0 then 'True' else 'false' end",
    "flag_or_int": "case when event_id % 2 = 0 then 'true' else '7' end",
    "int_or_date": "case when event_id % 2 = 0 then ' 12 ' else '2024-01-31' end",
    "late_text": "case when event_id = 900 then 'x' else '1.5e3' end",
    "blank": "case when event_id % 3 = 0 then '  ' end",
    "some_blank": "case when event_id % 3 = 0 then '' else '5' end",
}


@query("infer_types", _inference_sql("events", EVENT_TEXT))
def infer_types_query(spark, sf_dir):
    columns = [
        F.expr(text.replace("as varchar)", "as string)")).alias(name) for name, text in EVENT_TEXT.items()
    ]
    return infer_types(table(spark, sf_dir, "events").select(*columns))


LINE_TEXT = {
    c: f"cast({c} as varchar)"
    for c in (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
        "l_returnflag l_linestatus l_shipdate"
    ).split()
}


@query("infer_types_csv", _inference_sql("lineitem", LINE_TEXT))
def infer_types_csv(spark, sf_dir):
    path = shared_dir(spark, "infer")
    lines = table(spark, sf_dir, "lineitem")
    lines.write.option("header", True).csv(path)
    return infer_types(files.read_csv(spark, path))


@query(
    "infer_types_strict",
    "select 'int_or_date' as column_name, 'TEXT' as data_type from events where event_id = (select min(event_id) from events) "
    "union all select 'flag_or_int', 'TEXT' from events where event_id = (select min(event_id) from events) "
    "union all select 'numbers', 'DOUBLE PRECISION' from events where event_id = (select min(event_id) from events)",
)
def infer_types_strict(spark, sf_dir):
    """Mixed columns become text unless they only mix numbers."""
    mixed = {
        "int_or_date": EVENT_TEXT["int_or_date"],
        "flag_or_int": EVENT_TEXT["flag_or_int"],
        "numbers": "case when event_id % 2 = 0 then '1' else '1.5' end",
    }
    rows = table(spark, sf_dir, "events").select(*[F.expr(t).alias(n) for n, t in mixed.items()])
    return infer_types(rows, lattice="strict").select("column_name", "data_type")


@query(
    "infer_types_native",
    "select * from (values (0, 'o_orderkey', 'BIGINT', false), (1, 'o_custkey', 'BIGINT', false), "
    "(2, 'o_orderstatus', 'TEXT', false), (3, 'o_totalprice', 'DOUBLE PRECISION', false), "
    "(4, 'o_orderdate', 'TIMESTAMP', false), (5, 'o_orderpriority', 'TEXT', false)) "
    "t(ordinal, column_name, data_type, is_nullable) where (select count(*) from orders) > 0",
)
def infer_types_native(spark, sf_dir):
    return infer_types(table(spark, sf_dir, "orders"))


@query(
    "infer_json_keys",
    """
    with k as (select event_id, unnest(json_keys(props)) as key from events),
    r as (select key, case json_type(props, '$.' || key) when 'NULL' then 0 when 'BOOLEAN' then 1
        when 'UBIGINT' then 2 when 'BIGINT' then 2 when 'DOUBLE' then 3 else 5 end as r
        from k join events using (event_id))
    select key as column_name, case max(r) when 1 then 'BOOLEAN' when 2 then 'BIGINT'
        when 3 then 'DOUBLE PRECISION' else 'TEXT' end as data_type,
        min(r) = 0 or count(*) < (select count(*) from events) as is_nullable
    from r group by key
    """,
)
def infer_json_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("props").alias("record"), "event_id")
    keys = infer_record_keys(events, position=["event_id"])
    return keys.select("column_name", "data_type", "is_nullable")


@query(
    "infer_json_types",
    """
    select column_name, data_type, is_nullable, place from (values
        ('id', 'BIGINT', false, 1), ('amount', 'DOUBLE PRECISION', false, 2), ('at', 'TIMESTAMP', false, 3),
        ('ok', 'BOOLEAN', false, 4), ('mixed', 'TEXT', false, 5), ('tags', 'TEXT', false, 6),
        ('gap', 'BIGINT', true, 7), ('late', 'BIGINT', true, 8))
        t(column_name, data_type, is_nullable, place)
    where (select count(*) from events) > 0
    """,
)
def infer_json_types(spark, sf_dir):
    """Keys with different value types; one is NULL at times, one comes late."""
    events = table(spark, sf_dir, "events")
    fields = [
        F.col("event_id").alias("id"),
        (F.col("value") + 0.25).alias("amount"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
        (F.col("event_id") % 2 == 0).alias("ok"),
        F.when(F.col("event_id") % 2 == 0, F.lit("7")).otherwise("x").alias("mixed"),
        F.array("event_id").alias("tags"),
    ]
    gap = F.concat(F.lit(',"gap":'), F.when(F.col("event_id") % 3 == 0, "null").otherwise("5"))
    late = F.when(F.col("event_id") > 500, ',"late":1}').otherwise("}")
    record = F.to_json(F.struct(*fields))
    text = F.concat(F.substr(record, F.lit(1), F.char_length(record) - 1), gap, late)
    keys = infer_record_keys(events.select(text.alias("record"), "event_id"), position=["event_id"])
    return keys.select("column_name", "data_type", "is_nullable", F.col("first_seen._place").alias("place"))


@query(
    "infer_files",
    """
    select c_mktsegment as file, column_name, data_type, false as is_nullable from
        (select distinct c_mktsegment from customer),
        (values ('c_custkey', 'BIGINT'), ('c_name', 'TEXT'), ('c_nationkey', 'BIGINT'),
                ('c_acctbal', 'DOUBLE PRECISION')) t(column_name, data_type)
    """,
)
def infer_files(spark, sf_dir):
    """One schema per file of many, all from the same two passes."""
    path = shared_dir(spark, "many")
    customers = table(spark, sf_dir, "customer")
    customers.repartition("c_mktsegment").write.partitionBy("c_mktsegment").option("header", True).csv(path)
    found = files.infer_csv_files(spark, f"{path}/*")
    file = F.regexp_extract("path", "c_mktsegment=([^/]*)/", 1)
    return found.select(file.alias("file"), "column_name", "data_type", "is_nullable").distinct()


@query(
    "infer_record_files",
    """
    select c_mktsegment as file, column_name, data_type, nullable and lost as is_nullable from
        (select c_mktsegment, max(case when c_custkey % 2 = 0 then 1 else 0 end) = 1 as lost
            from customer group by 1),
        (values ('c_custkey', 'BIGINT', false), ('c_name', 'TEXT', false),
                ('odd', 'BIGINT', true)) t(column_name, data_type, nullable)
    """,
)
def infer_record_files(spark, sf_dir):
    """JSON Lines files, one schema each, grouped by file in one aggregation."""
    path = shared_dir(spark, "records")
    odd = F.when(F.col("c_custkey") % 2 == 1, F.col("c_custkey"))
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_name", odd.alias("odd"))
    rows.repartition("c_mktsegment").write.partitionBy("c_mktsegment").json(path)
    lines = files.json_lines(spark, f"{path}/*").where("is_record")
    segment = F.regexp_extract("path", "c_mktsegment=([^/]*)/", 1)
    found = infer_record_keys(
        lines.withColumn("file", segment), position=["block", "line"], group_by=["file"]
    )
    return found.select("file", "column_name", "data_type", "is_nullable")


@query(
    "infer_and_cast",
    "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders",
)
def infer_and_cast(spark, sf_dir):
    path = shared_dir(spark, "typed")
    table(spark, sf_dir, "orders").write.option("header", True).csv(path)
    return files.typed(files.read_csv(spark, path)).rows


# ---------------------------------------------------------------------------
# Catalogs
# ---------------------------------------------------------------------------


@query("row_counts", " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in TABLES))
def row_counts(spark, sf_dir):
    return catalog.row_counts(all_tables(spark, sf_dir))


@query(
    "total_rows",
    "select 14::bigint as tables, (" + " + ".join(f"(select count(*) from {t})" for t in TABLES) + ")::bigint as total_rows",
)
def total_rows(spark, sf_dir):
    return catalog.total_rows(catalog.row_counts(all_tables(spark, sf_dir)))


# Spark's names of types as DuckDB describes them, and what the catalog says.
_DUCKDB_TYPES = {
    "BIGINT": "bigint", "INTEGER": "integer", "VARCHAR": "text", "DOUBLE": "double precision", "FLOAT[]": "real[]",
    "TIMESTAMP": "timestamp without time zone", "BOOLEAN": "boolean",
}


def _columns_sql(counts: bool) -> str:
    """The columns of all tables by DuckDB's own catalog, with counts of rows and NULLs on request."""
    kinds = " ".join(f"when '{duck}' then '{kind}'" for duck, kind in _DUCKDB_TYPES.items())
    keys = [f"('{t}', '{c}')" for t, columns in KEYS.items() for c in columns]
    columns = (
        "select table_name, column_index::int as ordinal, column_name, "
        f"case data_type {kinds} else data_type end as data_type, (table_name, column_name) in ({', '.join(keys)}) as is_pk "
        f"from duckdb_columns() where table_name in ({', '.join(repr(t) for t in TABLES)})"
    )
    if not counts:
        return columns
    filled = " union all ".join(
        f"select '{t}' as table_name, column_name, present, (select count(*) from {t}) as row_count "
        f"from (unpivot (select count(columns(*)) from {t}) on columns(*) into name column_name value present)"
        for t in TABLES
    )
    return (
        f"select c.*, row_count, row_count - present as null_count from ({columns}) c join ({filled}) f "
        "on f.table_name = c.table_name and f.column_name = c.column_name"
    )


@query("catalog_full", _columns_sql(True))
def catalog_full(spark, sf_dir):
    full = catalog.describe(spark, all_tables(spark, sf_dir), KEYS, level="full")
    return full.select("table_name", "ordinal", "column_name", "data_type", "is_pk", "row_count", "null_count")


@query("catalog_columns", _columns_sql(False))
def catalog_columns(spark, sf_dir):
    """The level without counts."""
    columns = catalog.describe(spark, all_tables(spark, sf_dir), KEYS, level="columns")
    return columns.select("table_name", "ordinal", "column_name", "data_type", "is_pk")


@query("catalog_names", f"select distinct table_name from duckdb_columns() where table_name in ({', '.join(repr(t) for t in TABLES)})")
def catalog_names(spark, sf_dir):
    """The level of names alone."""
    return catalog.describe(spark, all_tables(spark, sf_dir), KEYS, level="names")


@query(
    "approximate_counts",
    " union all ".join(f"select '{t}' as table_name, count(*) as estimated_rows from {t}" for t in TABLES),
)
def approximate_counts(spark, sf_dir):
    """Rows by the footers of all tables' files (D7); files that nobody writes to meanwhile give exact numbers."""
    return catalog.approximate_counts(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES})


@query(
    "null_violations",
    "select 'customer' as table_name, 'segment' as column_name, count(*) as row_count, "
    "count(*) - count(nullif(c_mktsegment, 'BUILDING')) as null_count from customer",
)
def null_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")
    )
    return catalog.null_violations({"customer": rows}, {"customer": ["c_custkey", "segment"]})


# Column listings as a database would give them, one row per (table, column)
# of rows derived from a table.
_LISTING = """
select conv_id, 'chat.t' || conv_id as table_name, turn, 'c' || turn as column_name,
       role = 'user' and turn < 2 as is_pk from conversations
"""


# Only conversations with a system turn have a key here.
_KEYLESS = _LISTING.replace("role = 'user' and turn < 2", "role = 'system'")


@query(
    "tables_without_pk",
    f"select table_name from ({_KEYLESS}) group by table_name having not coalesce(bool_or(is_pk), false)",
)
def tables_without_pk(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return catalog.tables_without_key(spark.sql(_KEYLESS))


@query(
    "primary_keys",
    f"select table_name, string_agg(column_name, ',' order by turn) as key_columns from ({_LISTING}) "
    "where is_pk group by table_name",
)
def primary_keys(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    listed = spark.sql(_LISTING).withColumn("pk_position", F.col("turn"))
    return catalog.primary_keys(listed).select("table_name", F.array_join("key_columns", ",").alias("key_columns"))


_UDT = (
    "select conv_id, turn, case turn % 3 when 0 then 'ARRAY' when 1 then 'USER-DEFINED' else 'text' end as data_type, "
    "case turn % 3 when 0 then '_' || role when 1 then role else 'text' end as udt_name from conversations"
)


@query(
    "resolve_types",
    "select conv_id, turn, case turn % 3 when 0 then role || '[]' when 1 then role else 'text' end as data_type, "
    "turn % 3 = 1 as is_user_defined from conversations",
)
def resolve_types(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return catalog.resolve_types(spark.sql(_UDT))


@query(
    "foreign_key_edges",
    "select distinct 'customer' || (o_custkey % 50) as child, 'status' || o_orderstatus as parent from orders "
    "union select distinct 'status' || o_orderstatus, 'priority' || substring(o_orderpriority, 1, 1) from orders",
)
def foreign_key_edges(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    customer = F.concat(F.lit("customer"), F.col("o_custkey") % 50)
    status = F.concat(F.lit("status"), "o_orderstatus")
    priority = F.concat(F.lit("priority"), F.substring("o_orderpriority", 1, 1))
    references = (
        orders.select(customer.alias("child"), status.alias("parent"))
        .unionAll(orders.select(status, priority))
        .unionAll(orders.select(status, status))
    )
    return catalog.foreign_key_edges(references)
