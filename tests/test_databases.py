"""Database reads and writes as far as they go without a database: the
options, predicates and statements. No database is started here."""

import pytest
from pyspark.sql import functions as F

from drayline.plans.dialects import DIALECTS, MYSQL, POSTGRESQL, SNOWFLAKE, SQLITE, SQLSERVER
from drayline.sinks.jdbc import merge_statement, merge_table
from drayline.sources import catalog, jdbc
from drayline.sources.jdbc import Cuts, cut_predicates, depth_cuts


def test_merge_statements():
    columns, keys = ["id", "a.b"], ["id"]
    assert merge_statement("s.t", "st", columns, keys, POSTGRESQL) == (
        'insert into "s"."t" ("id", "a.b") select "id", "a.b" from "st" '
        'on conflict ("id") do update set "a.b" = excluded."a.b"'
    )
    assert "where true on conflict" in merge_statement("t", "st", columns, keys, SQLITE)
    assert merge_statement("t", "st", columns, keys, MYSQL).endswith("on duplicate key update `a.b` = values(`a.b`)")
    merged = merge_statement("t", "st", columns, keys, SQLSERVER)
    assert "when matched then update set t.[a.b] = s.[a.b] when not matched" in merged
    assert "when matched then" not in merge_statement("t", "st", ["id"], keys, SNOWFLAKE)
    assert merge_statement("t", "st", ["id"], keys, POSTGRESQL).endswith("do nothing")
    assert merge_statement("t", "st", ["id"], keys, MYSQL).startswith("insert ignore")
    with pytest.raises(ValueError):
        merge_statement("t", "st", columns, [], POSTGRESQL)


def test_merge_stages_once(spark, monkeypatch):
    written, done = [], []
    monkeypatch.setattr("drayline.sinks.jdbc.write_table", lambda df, db, table, **o: written.append((table, o["mode"])))
    db = jdbc.Database(POSTGRESQL, "jdbc:x")
    merge_table(spark.range(3), db, "s.t", ["id"], done.append)
    assert written == [("t_staging", "overwrite")] and len(done) == 1 and '"t_staging"' in done[0]


@pytest.mark.parametrize("dialect", DIALECTS)
def test_predicates(dialect):
    parts = jdbc.hash_predicates(dialect, "k", 4)
    assert len(parts) == 4 and parts[0].endswith("is null") and len(set(parts)) == 4


def test_options():
    db = jdbc.Database(MYSQL, "jdbc:mysql://x", {"user": "u", "password": "secret", "fetchsize": "5"})
    assert db.reader_options()["fetchsize"] == "5" and "secret" not in repr(db)
    with pytest.raises(ValueError):
        jdbc.Database("oracle", "x")


def test_catalog(spark):
    df = catalog.with_keys(spark.createDataFrame([(1, "a", None)], "id int, n string, e string"), ["id"])
    rows = catalog.describe(spark, {"t": df}).orderBy("ordinal").collect()
    assert [(r.column_name, r.is_pk, r.null_count) for r in rows] == [("id", True, 0), ("n", False, 0), ("e", False, 1)]
    assert catalog.describe(spark, {"b": df, "a": df}, level="names").collect()[0].table_name == "a"
    assert catalog.primary_keys(catalog.describe(spark, {"t": df}, level="columns")).first().key_columns == ["id"]


def test_defaults():
    assert catalog.default_of("'wip'::scenario_status", True) == "wip"
    assert catalog.default_of("nextval('s'::regclass)", False) is None
    assert catalog.default_of("'active'::character varying") == "active"
    assert catalog.default_of("'a::b'::mood") == "a::b" and catalog.default_of("'it''s'") == "it's"
    assert catalog.default_of("now()") is None and catalog.default_of("1.5::numeric(3,1)") == "1.5"
    assert catalog.default_of("5", False) == "5" and catalog.default_of(None, False) is None


def test_views_become_tables(spark, folder):
    spark.range(3).createOrReplaceTempView("some_view")
    assert catalog.materialize_view(spark, "some_view", str(folder / "v")).count() == 3


def test_tables_of_the_session(spark, folder):
    assert isinstance(catalog.spark_tables(spark), dict)
    names = spark.createDataFrame([("a.x",), ("b.y",), ("z",)], "table_name string")
    from drayline.sources.listing import filter_schemas, select_names

    assert filter_schemas(names, ["a", "default"]).count() == 2 and filter_schemas(names, []).count() == 3
    assert select_names(names, ["z"], "table_name").count() == 1
    assert select_names(names, [], "table_name").count() == 3
    assert select_names(names, names.where(F.col("table_name") == "z"), "table_name").count() == 1


def parts_of(df, predicates):
    """Rows of each part, by the conditions as Spark reads them."""
    return df.select(*[F.coalesce(F.expr(p), F.lit(False)).cast("int").alias(f"p{i}") for i, p in enumerate(predicates)])


@pytest.mark.parametrize("kind", ["even", "skewed", "heavy", "date", "none", "one"])
def test_cuts_of_equal_depth(spark, kind):
    base = spark.range(4000).withColumn("k", F.col("id"))
    values = {
        "even": F.col("id"), "skewed": F.pow(F.col("id") / 400, 6), "heavy": F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")),
        "date": F.date_add(F.lit("2024-01-01"), (F.col("id") % 1000).cast("int")), "none": F.lit(None).cast("int"), "one": F.lit(5),
    }
    df = base.withColumn("v", values[kind])
    cuts = depth_cuts(df, "v", 8)
    predicates = cut_predicates("mysql", "v", cuts)
    parts = parts_of(df, predicates)
    covered = parts.select(sum(F.col(c) for c in parts.columns).alias("n")).groupBy("n").count().collect()
    assert [tuple(r) for r in covered] == [(1, 4000)]  # every row in one part
    sizes = parts.agg(*[F.sum(c).alias(c) for c in parts.columns]).first()
    if kind in ("even", "skewed", "date"):
        assert not cuts.heavy and max(sizes) <= 1.5 * 4000 / 8
    if kind == "heavy":
        assert list(cuts.heavy) == [7] and sorted(sizes)[-2] <= 1.5 * 4000 / 8
        assert len(cut_predicates("mysql", "v", cuts, "k")) == len(predicates) - 1 + cuts.heavy[7]


def test_cuts_as_text():
    cuts = Cuts((3, 8), {8: 2})
    assert cut_predicates("postgresql", "n", cuts) == ['"n" is null', '"n" < 3', '"n" >= 3 and "n" < 8', '"n" > 8', '"n" = 8']
    split = cut_predicates("postgresql", "n", cuts, "k")
    assert len(split) == 6 and all(p.startswith('"n" = 8 and (') for p in split[4:])
    assert cut_predicates("sqlserver", "n", Cuts((), {})) == ["[n] is null", "[n] is not null"]
    assert cut_predicates("mysql", "d", Cuts(("it's",), {})) == ["`d` is null", "`d` < 'it''s'", "`d` >= 'it''s'"]
