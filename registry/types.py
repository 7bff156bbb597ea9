"""Type translation and casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from drayline.operators.mapping import apply_spec, cast_columns, fault_summary
from drayline.plans.dialects import ARRAY_TYPE, DEFAULT_STRING, DIALECTS, rule_rows, translate_types
from drayline.plans.spec import TableSpec
from registry import query, table

# Type texts of a source, one per row of a table; the length comes from the row.
_PG_TYPES = (
    "case p_partkey % 12 when 0 then 'integer' when 1 then 'character varying(' || p_size || ')' "
    "when 2 then 'numeric(' || (p_size + 5) || ',2)' when 3 then 'timestamp(3) without time zone' "
    "when 4 then 'TEXT' when 5 then 'int4[]' when 6 then 'jsonb' when 7 then ' uuid ' when 8 then 'mood' "
    "when 9 then 'timestamp with time zone' when 10 then 'cidr' else 'double precision' end"
)


def _values(rows) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_RULES = f"rules(source_dialect, source_type, target_dialect, target_type) as (values {_values(rule_rows())})"
_DEFAULTS = f"defaults(d, default_type) as (values {_values(DEFAULT_STRING.items())})"
_ARRAYS = f"arrays(d, array_type) as (values {_values(ARRAY_TYPE.items())})"
_TARGETS = "case p_size % 5 " + " ".join(f"when {i} then '{d}'" for i, d in enumerate(DIALECTS)) + " end"


@query(
    "translate_types",
    f"""
    with {_RULES}, {_DEFAULTS}, {_ARRAYS},
    t as (select p_partkey, {_PG_TYPES} as data_type, {_TARGETS} as target from part),
    n as (select *, lower(trim(data_type)) as name,
        trim(split_part(lower(trim(data_type)), '(', 1)) as base from t)
    select n.p_partkey, n.data_type, n.target, case
        when n.target = 'postgresql' then n.data_type
        when n.name like '%[]' then coalesce(arrays.array_type, n.data_type)
        when e.target_type is not null then e.target_type
        when b.target_type like '%(%' then b.target_type
        when b.target_type is not null then b.target_type || regexp_extract(n.name, '\\([^)]*\\)')
        else default_type end as target_type
    from n
    left join rules e on e.source_dialect = 'postgresql' and e.target_dialect = n.target and e.source_type = n.name
    left join rules b on b.source_dialect = 'postgresql' and b.target_dialect = n.target and b.source_type = n.base
    left join arrays on arrays.d = n.target
    left join defaults on defaults.d = n.target
    """,
)
def translate_types_query(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(_PG_TYPES).alias("data_type"), F.expr(_TARGETS).alias("target")
    )
    return translate_types(rows, "postgresql", F.col("target"))


_NAMES = sorted({(s, n) for s, n, _, _ in rule_rows()})


@query(
    "translate_all_pairs",
    f"""
    with {_RULES}, {_DEFAULTS},
    names(n, source, data_type) as (values {", ".join(f"({i}, '{s}', '{t}')" for i, (s, t) in enumerate(_NAMES))}),
    picked as (select p_partkey, p_partkey % {len(_NAMES)} as n, {_TARGETS} as target from part)
    select p_partkey, source, data_type, target,
        case when source = target then data_type else coalesce(r.target_type, default_type) end as target_type
    from picked join names using (n) join defaults on d = target
    left join rules r on r.source_dialect = source and r.source_type = data_type and r.target_dialect = target
    """,
)
def translate_all_pairs(spark, sf_dir):
    """Every type name of every dialect to every other, spread over the parts."""
    pick = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n).alias("n")) for s, n in _NAMES])
    chosen = F.get(pick, (F.col("p_partkey") % len(_NAMES)).cast("int"))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        chosen["s"].alias("source"),
        chosen["n"].alias("data_type"),
        F.expr(_TARGETS).alias("target"),
    )
    return translate_types(rows, F.col("source"), F.col("target"))


@query(
    "cast_profile_text_dates",
    "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as varchar) as o_orderdate, "
    "o_orderpriority from orders",
)
def cast_profile_text_dates(spark, sf_dir):
    """Orders with the physical types of a target that has no dates."""
    rows = table(spark, sf_dir, "orders")
    types = {"o_orderkey": "INTEGER", "o_totalprice": "REAL", "o_orderdate": "TEXT"}
    return cast_columns(rows, types, "sqlite").rows


@query(
    "cast_override",
    "select l_orderkey, l_linenumber, cast(l_quantity as decimal(10,2)) as l_quantity, "
    "cast(l_shipdate as date) as l_shipdate, cast(l_linenumber as varchar) as line_text from lineitem",
)
def cast_override(spark, sf_dir):
    """Types the user names per column win over the translated ones (T5)."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", F.col("l_linenumber").alias("line_text")
    )
    types = {"l_quantity": "numeric(10,2)", "l_shipdate": "date", "line_text": "varchar(10)"}
    return cast_columns(rows, types, "postgresql").rows


@query(
    "cast_rejects",
    "select 'value' as \"column\", 'cast to BIGINT' as rule, count(*) as cells from orders "
    "where o_orderkey % 3 = 0 union all "
    "select 'day', 'cast to DATE', count(*) from orders where o_orderkey % 4 = 1",
)
def cast_rejects(spark, sf_dir):
    mixed = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderkey").cast("string"))
    day = F.when(F.col("o_orderkey") % 4 == 1, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "orders").select(mixed.alias("value"), day.alias("day"))
    return fault_summary(cast_columns(rows, {"value": "BIGINT", "day": "DATE"}, "postgresql", "reject"))


@query(
    "cast_user_defined",
    "select c_custkey, c_nationkey::varchar as c_nationkey, c_mktsegment from customer",
)
def cast_user_defined(spark, sf_dir):
    """User-defined types become text, whatever type is asked for (T4)."""
    from drayline.plans.spec import ColumnMapping

    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    spec = TableSpec(
        "customer",
        [ColumnMapping("c_nationkey", target_type="mood"), ColumnMapping("c_mktsegment", target_type="segment")],
        user_defined=["c_nationkey", "c_mktsegment"],
        target_dialect="mysql",
    )
    return apply_spec(rows, spec).rows


@query(
    "fill_defaults",
    "select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'wip') as segment, "
    "coalesce(case when c_custkey % 2 = 0 then c_nationkey end, 7) as nation from customer",
)
def fill_defaults(spark, sf_dir):
    """Literal column defaults fill missing cells."""
    from drayline.sources.catalog import default_of

    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("nation"),
    )
    defaults = {"segment": default_of("'wip'::scenario_status", True), "nation": default_of("7", False)}
    return apply_spec(rows, TableSpec("customer", defaults=defaults)).rows


@query(
    "fill_defaults_casts",
    "select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'active') as segment, "
    "coalesce(nullif(c_name, c_name), 'a::b') as name, "
    "case when c_custkey % 2 = 0 then c_mktsegment end as maker from customer",
)
def fill_defaults_casts(spark, sf_dir):
    """Casts behind a default are taken off, cast signs inside quotes stay, a function fills nothing."""
    from drayline.sources.catalog import default_of

    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.nullif("c_name", F.col("c_name")).alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("maker"),
    )
    texts = {"segment": "'active'::character varying", "name": "'a::b'::mood", "maker": "now()"}
    found = {name: default_of(text) for name, text in texts.items()}
    return apply_spec(rows, TableSpec("customer", defaults={n: v for n, v in found.items() if v is not None})).rows
