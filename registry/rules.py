"""One query per cleaning rule (X1-X22) and for mappings (M1-M6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayline.functions.text import BLANKS
from drayline.operators.mapping import apply_rules, apply_spec
from drayline.plans.spec import ColumnMapping, TableSpec
from registry import query, table

# Blank characters as a SQL expression, for trim in the SQL twins.
_BLANK_SQL = " || ".join(f"chr({ord(c)})" for c in BLANKS)


def _one_rule(name: str, source: str, key: str, text: str, chain, sql_value: str) -> None:
    """A chain on one expression of a whole table.

    ``text`` is SQL that Spark and the twin read alike; ``sql_value`` is the
    expected value, with ``v`` for the input.
    """

    @query(name, f"select {key}, {sql_value} as value from (select {key}, {text} as v from {source})")
    def run(spark, sf_dir) -> DataFrame:
        rows = table(spark, sf_dir, source).select(key, F.expr(text).alias("v"))
        return apply_rules(rows, "v", chain, "value").select(key, "value")


_one_rule("xf_uppercase", "part", "p_partkey", "p_name || ' ' || lower(p_type)", "uppercase", "upper(v)")
_one_rule("xf_lowercase", "part", "p_partkey", "p_brand || ' ' || p_type", "lowercase", "lower(v)")
_one_rule(
    "xf_titlecase", "part", "p_partkey", "p_name || '-' || p_type || ' 3rd o''neil'", "titlecase",
    "array_to_string(list_transform(regexp_extract_all(v, '[A-Za-z]+|[^A-Za-z]+'), "
    "lambda x: upper(x[1]) || lower(x[2:])), '')",
)
for _side, _function in (("trim", "trim"), ("ltrim", "ltrim"), ("rtrim", "rtrim")):
    _one_rule(
        f"xf_{_side}", "documents", "doc_id", "' ' || chr(9) || chr(160) || text || chr(10) || chr(160) || ' '",
        _side, f"{_function}(v, {_BLANK_SQL})",
    )
_one_rule("xf_truncate", "documents", "doc_id", "text", "truncate:100", "substring(v, 1, 100)")
_one_rule("xf_truncate_default", "pages", "page_id", "html", "truncate", "substring(v, 1, 255)")
_one_rule("xf_replace", "part", "p_partkey", "p_type", "replace: :_", "replace(v, ' ', '_')")
_one_rule(
    "xf_strip_html", "pages", "page_id", "html", "strip_html", "regexp_replace(v, '<[^>]+>', '', 'g')"
)
_one_rule(
    "xf_coalesce", "customer", "c_custkey",
    "case when c_custkey % 5 = 0 then '' when c_mktsegment <> 'BUILDING' then c_mktsegment end",
    "coalesce:unknown", "coalesce(nullif(v, ''), 'unknown')",
)
_one_rule("xf_nullif", "orders", "o_orderkey", "o_orderstatus", "nullif:F", "nullif(v, 'F')")
_one_rule(
    "xf_mask_email", "customer", "c_custkey",
    "case when c_custkey % 3 = 0 then '@' || c_name when c_custkey % 3 = 1 then c_name "
    "else c_name || '@mail.example' end",
    "mask_email",
    "case when instr(v, '@') >= 2 then substring(v, 1, 1) || '***' || substring(v, instr(v, '@')) else '***' end",
)
_one_rule(
    "xf_mask_credit_card", "orders", "o_orderkey",
    "case when o_orderkey % 9 = 0 then 'no 12' else cast(o_orderkey * 7919 as varchar(40)) || '-' || "
    "cast(o_custkey as varchar(40)) end",
    "mask_credit_card",
    "'****-****-****-' || right(regexp_replace(v, '[^0-9]', '', 'g'), 4)",
)
_one_rule("xf_hash", "documents", "doc_id", "text", "hash", "sha256(v)")
_one_rule("xf_hash_md5", "pages", "page_id", "html", "hash:md5", "md5(v)")
_one_rule(
    "xf_redact", "customer", "c_custkey", "case when c_custkey % 4 > 0 then c_name end", "redact",
    "case when v is not null then '[REDACTED]' end",
)
_one_rule(
    "xf_to_boolean", "orders", "o_orderkey",
    "case o_orderkey % 8 when 0 then 'Y' when 1 then ' yes ' when 2 then '1' when 3 then 'On' "
    "when 4 then 'f' when 5 then '' when 6 then o_orderpriority end",
    "to_boolean",
    f"lower(trim(v, {_BLANK_SQL})) in ('1', 'true', 't', 'yes', 'y', 'on')",
)
_one_rule("xf_to_string", "customer", "c_custkey", "c_acctbal", "to_string", "cast(v as varchar)")
_one_rule("xf_to_string_time", "lineitem", "l_orderkey", "l_shipdate", "to_string", "cast(v as varchar)")
_one_rule(
    "xf_round", "lineitem", "l_orderkey", "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "round:2",
    "cast(format('{:.2f}', v) as double)",
)
_one_rule("xf_multiply", "lineitem", "l_orderkey", "l_quantity", "multiply:1.1", "v * cast(1.1 as double)")
_one_rule("xf_divide", "lineitem", "l_orderkey", "l_extendedprice", "divide:100", "v / cast(100 as double)")
_one_rule(
    "xf_divide_by_zero", "orders", "o_orderkey", "o_totalprice", "divide:0", "cast(null as double)"
)
_one_rule("xf_abs", "customer", "c_custkey", "c_acctbal", "abs", "abs(v)")
_one_rule(
    "xf_abs_text", "customer", "c_custkey", "' ' || cast(c_acctbal as varchar(40))", "abs",
    "abs(cast(v as double))",
)
_one_rule(
    "xf_chain", "documents", "doc_id", "text", "strip_html | trim | truncate:100",
    f"substring(trim(regexp_replace(v, '<[^>]+>', '', 'g'), {_BLANK_SQL}), 1, 100)",
)
_one_rule(
    "xf_chain_numeric", "orders", "o_orderkey", "o_totalprice", "divide:100|round:2",
    "cast(format('{:.2f}', v / cast(100 as double)) as double)",
)
_one_rule(
    "xf_chain_flags", "orders", "o_orderkey",
    "case o_orderkey % 4 when 0 then 'N/A' when 1 then 'Yes' when 2 then 'no' end",
    "nullif:N/A|to_boolean",
    "lower(nullif(v, 'N/A')) = 'yes'",
)
_one_rule(
    "xf_chain_list", "orders", "o_orderkey", "o_orderpriority || '|' || o_orderstatus",
    [("replace", "|", ":"), "lowercase"], "lower(replace(v, '|', ':'))",
)


@query(
    "map_rename",
    "select c_custkey as id, c_name as name, c_nationkey as nation, c_acctbal, c_mktsegment from customer",
)
def map_rename(spark, sf_dir):
    spec = TableSpec(
        "customer",
        [
            ColumnMapping("c_custkey", "id"),
            ColumnMapping("c_name", "name"),
            ColumnMapping("c_nationkey", "nation"),
        ],
    )
    return apply_spec(table(spark, sf_dir, "customer"), spec).rows


CUSTOMER_SPEC = TableSpec(
    "customer",
    [
        ColumnMapping("c_custkey", "id"),
        ColumnMapping("c_name", "name", "transform", rules="trim|titlecase|truncate:100"),
        ColumnMapping("email", "email", "transform", rules="trim|lowercase|mask_email"),
        ColumnMapping("c_nationkey", "nation_hash", "transform", rules="to_string|hash"),
        ColumnMapping("c_acctbal", "balance", "transform", rules="divide:100|round:2"),
        ColumnMapping("c_mktsegment", "segment", "transform", rules="nullif:BUILDING|coalesce:other"),
    ],
    keys=["c_custkey"],
)

CUSTOMER_SQL = """
select c_custkey as id,
       substring('C' || lower(substring(c_name, 2)), 1, 100) as name,
       'c***@' || lower(c_mktsegment) || '.example' as email,
       sha256(cast(c_nationkey as varchar)) as nation_hash,
       cast(format('{:.2f}', c_acctbal / cast(100 as double)) as double) as balance,
       coalesce(nullif(c_mktsegment, 'BUILDING'), 'other') as segment
from customer
"""


def customer_rows(spark, sf_dir) -> DataFrame:
    email = F.concat(F.lit("  "), "c_name", F.lit("@"), "c_mktsegment", F.lit(".example\t"))
    return table(spark, sf_dir, "customer").withColumn("email", email)


@query("map_chain", CUSTOMER_SQL)
def map_chain(spark, sf_dir):
    return apply_spec(customer_rows(spark, sf_dir), CUSTOMER_SPEC).rows


@query(
    "map_nested_json",
    "select vec_id, '{\"label\":' || label || ',\"vec_id\":' || vec_id || '}' as tag, "
    "'[' || label || ',' || vec_id || ']' as pair from embeddings",
)
def map_nested_json(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.struct("label", "vec_id").alias("tag"),
        F.array(F.col("label").cast("long"), "vec_id").alias("pair"),
    )
    return apply_spec(rows, TableSpec("embeddings", target_dialect="mysql")).rows


@query(
    "map_array_kept",
    "select vec_id, label as first_label, '{\"label\":' || label || '}' as first_tag, "
    "len(embedding)::int as dims from embeddings",
)
def map_array_kept(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.array("label").alias("labels"), F.array(F.struct("label")).alias("tags")
    )
    kept = apply_spec(rows, TableSpec("embeddings", target_dialect="postgresql")).rows
    return kept.select(
        "vec_id",
        F.col("labels")[0].alias("first_label"),
        F.col("tags")[0].alias("first_tag"),
        F.size("embedding").alias("dims"),
    )


@query(
    "map_rejects",
    "select o_orderkey, o_orderpriority as value, 'abs' as rule from orders where o_orderkey % 3 = 0",
)
def map_rejects(spark, sf_dir):
    """Rows whose cell a numeric rule cannot take, with rule and value."""
    mixed = "case when o_orderkey % 3 = 0 then o_orderpriority else cast(o_totalprice as string) end"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(mixed).alias("amount"))
    spec = TableSpec("orders", [ColumnMapping("amount", action="transform", rules="abs")])
    fault = F.col("_faults")[0]
    return apply_spec(rows, spec, on_error="reject").rejects.select(
        "o_orderkey", fault["value"].alias("value"), fault["rule"].alias("rule")
    )


@query(
    "map_default_types",
    "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
    "cast(o_orderdate as varchar) as o_orderdate, o_orderpriority from orders",
)
def map_default_types(spark, sf_dir):
    """Identity mapping with the types of a target that stores dates as text (M4)."""
    from drayline.plans.spec import default_mappings

    rows = table(spark, sf_dir, "orders")
    spec = TableSpec("orders", default_mappings(rows.schema, "sqlite"), target_dialect="sqlite")
    return apply_spec(rows, spec).rows
