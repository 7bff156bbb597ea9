"""Cleaning rules on edge cells with values worked out by hand."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from drayline.functions.rules import RULES, RuleError, parse_chain, rule_catalog
from drayline.operators.mapping import apply_rules, apply_spec, fault_summary
from drayline.plans.spec import ColumnMapping, TableSpec


def run(spark, chain, cells, kind="string"):
    df = spark.createDataFrame(list(enumerate(cells)), f"id int, v {kind}")
    rows = apply_rules(df, "v", chain).orderBy("id").collect()
    return [r.v for r in rows]


TEXT_CASES = [
    ("uppercase", [None, "", "hello", "straße", "été"], [None, "", "HELLO", "STRASSE", "ÉTÉ"]),
    ("lowercase", [None, "HELLO", "ÀB"], [None, "hello", "àb"]),
    (
        "titlecase",
        [None, "john doe", "mc-donald o'neil", "3rd WAY", "ßa", "élan vital", "日本x"],
        [None, "John Doe", "Mc-Donald O'Neil", "3Rd Way", "Ssa", "Élan Vital", "日本X"],
    ),
    ("trim", [None, "  hi  ", "\t x y \n", "\x1ca\x1f", " ", "x"], [None, "hi", "x y", "a", "", "x"]),
    ("ltrim", ["  hi  ", " a "], ["hi  ", "a "]),
    ("rtrim", ["  hi  ", " a　"], ["  hi", " a"]),
    ("truncate:5", [None, "Hello World", "abc", "😀😀😀😀😀😀"], [None, "Hello", "abc", "😀😀😀😀😀"]),
    ("truncate:0", ["abc"], [""]),
    ("truncate:-2", ["abcde", "a"], ["abc", ""]),
    ("truncate", ["x" * 300], ["x" * 255]),
    ("replace:@old.com:@new.com", ["a@old.com", "a.old.com", None], ["a@new.com", "a.old.com", None]),
    ("replace:a", ["banana"], ["bnn"]),
    ("replace:.:\\", ["a.b"], ["a\\b"]),
    (
        "strip_html",
        ["<b>Hi</b>", "a < b", "<>x", "<a href='x\ny'>t</a>&amp;", None],
        ["Hi", "a < b", "<>x", "t&amp;", None],
    ),
    ("coalesce:0", [None, "", " ", "x"], ["0", "0", " ", "x"]),
    ("coalesce", [None, "x"], ["", "x"]),
    ("nullif:N/A", [None, "N/A", "n/a", ""], [None, None, "n/a", ""]),
    ("nullif", ["", "x"], [None, "x"]),
    (
        "mask_email",
        ["user@ex.com", "a@b", "@x.com", "none", "", None, "a@b@c"],
        ["u***@ex.com", "a***@b", "***", "***", "***", None, "a***@b@c"],
    ),
    (
        "mask_credit_card",
        ["4111-1111-1111-1234", "12", "no digits", "", None, "4111 1111"],
        [f"****-****-****-{x}" for x in ("1234", "12", "", "")] + [None, "****-****-****-1111"],
    ),
    ("redact", ["secret", "", None], ["[REDACTED]", "[REDACTED]", None]),
    ("to_string", ["x", None], ["x", None]),
    ("trim | lowercase | truncate:100", ["  Hello World  "], ["hello world"]),
    ("TRIM||UpperCase|", [" a "], ["A"]),
    ([("replace", "|", ":"), "uppercase"], ["a|b"], ["A:B"]),
]


@pytest.mark.parametrize("chain, cells, expected", TEXT_CASES, ids=lambda v: str(v)[:30])
def test_text_rules(spark, chain, cells, expected):
    assert run(spark, chain, cells) == expected


def test_hash(spark):
    cells = ["a", "", "é", None]
    sha = [hashlib.sha256(c.encode()).hexdigest() if c is not None else None for c in cells]
    assert run(spark, "hash", cells) == sha == run(spark, "hash:SHA256", cells)
    assert run(spark, "hash:md5", ["a"]) == [hashlib.md5(b"a").hexdigest()]


def test_to_boolean(spark):
    cells = ["Y", "yes", " ON ", "1", "t", "TRUE", "0", "f", "", "other", None]
    assert run(spark, "to_boolean", cells) == [True] * 6 + [False] * 4 + [None]
    assert run(spark, "to_boolean", [True, False, None], "boolean") == [True, False, None]
    assert run(spark, "to_boolean", [1, 2], "int") == [True, False]


def test_round_is_exact(spark):
    cells = [2.675, 0.125, 2.5, 3.5, -0.5, 1e20, 0.1 + 0.2, math.inf, None]
    for places in (0, 1, 2, 3):
        expected = [c if c is None or math.isinf(c) else round(c, places) for c in cells]
        assert run(spark, f"round:{places}", cells, "double") == expected
    assert run(spark, "round:2", ["3.14159", " 1_000.5 ", None]) == [3.14, 1000.5, None]
    assert math.isnan(run(spark, "round:2", ["nan"])[0])
    assert run(spark, "round:-2", [1234.0], "double") == [1200.0]


def test_numeric_rules(spark):
    assert run(spark, "multiply:100", [1.5, None], "double") == [150.0, None]
    assert run(spark, "divide:100", [1500, None], "int") == [15.0, None]
    assert run(spark, "divide:0", [1.0], "double") == [None]
    assert run(spark, "abs", [-42, 3], "int") == [42.0, 3.0]
    assert run(spark, "abs", ["-1e3", "+.5", "-inf"]) == [1000.0, 0.5, math.inf]
    assert run(spark, "divide:100|round:2", [1234.5], "double") == [round(12.345, 2)]


def test_text_of_values(spark):
    doubles = [0.0, -0.0, 1.0, 0.1, 1e7, 123456789.125, 1e15, 9007199254740993.0, 1e16, 1.5e300, 0.001, 0.0001, 0.00012345, 1e-5, 1.25e-10, 5e-324, math.inf, -math.inf]
    texts = run(spark, "to_string", doubles, "double")
    assert texts[:-3] == [repr(d) for d in doubles][:-3] and texts[-2:] == ["inf", "-inf"]
    assert run(spark, "to_string", [math.nan], "double") == ["nan"]
    assert run(spark, "to_string", [True, False, None], "boolean") == ["True", "False", None]
    assert run(spark, "to_string", [5, None], "bigint") == ["5", None]
    df = spark.sql(
        "select timestamp_ntz'2024-01-02 03:04:05' a, timestamp_ntz'2024-01-02 03:04:05.5' b, "
        "timestamp'2024-01-02 03:04:05' c, date'2024-01-02' d, cast(1.50 as decimal(10,2)) e"
    )
    for c in df.columns:
        df = apply_rules(df, c, "to_string")
    assert list(df.first()) == [
        "2024-01-02 03:04:05", "2024-01-02 03:04:05.500000", "2024-01-02 03:04:05+00:00", "2024-01-02", "1.50",
    ]


def test_bad_chains():
    for chain in ("nope", "truncate:x", "replace", "hash:sha1", "multiply:y"):
        with pytest.raises(RuleError):
            from drayline.functions.rules import Cell, apply_chain
            from pyspark.sql import types as T

            apply_chain(Cell(F.lit("a"), T.StringType()), chain)


def test_unknown_rules_pass_when_not_strict(spark):
    df = spark.createDataFrame([("a",)], "v string")
    mapping = ColumnMapping("v", action="transform", rules="nope|uppercase")
    assert apply_spec(df, TableSpec("t", [mapping], strict_rules=False)).rows.first().v == "A"
    with pytest.raises(RuleError):
        apply_spec(df, TableSpec("t", [mapping]))


def test_catalog():
    assert len(RULES) == 21
    assert {r["category"] for r in rule_catalog()} == {"string", "null", "pii", "numeric", "cast"}
    assert parse_chain(" trim | replace: a : b ") == [("trim", []), ("replace", [" a ", " b"])]


def test_bad_cells(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None), (4, "-1d")], "id int, v string")
    spec = TableSpec("t", [ColumnMapping("v", "n", "transform", rules="abs|multiply:2|coalesce:none")])
    with pytest.raises(Exception, match="v: abs cannot take (x|-1d)"):
        apply_spec(df, spec).rows.collect()
    nulls = apply_spec(df, spec, "null").rows.orderBy("id").collect()
    assert [r.n for r in nulls] == ["10.0", "none", "none", "none"]
    mapped = apply_spec(df, spec, "reject")
    assert sorted(r.id for r in mapped.rows.collect()) == [1, 3]
    rejects = {r.id: r._faults for r in mapped.rejects.collect()}
    assert sorted(rejects) == [2, 4]
    assert rejects[2][0].asDict() == {"column": "n", "rule": "abs", "value": "x"}
    assert mapped.tagged.count() == mapped.rows.count() + mapped.rejects.count()
    assert fault_summary(mapped).collect()[0].cells == 2


def test_mapping_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, `b.c` int")
    spec = TableSpec("t", [ColumnMapping("b.c", "d")])
    assert apply_spec(df, spec).rows.columns == ["a", "d"]
    with pytest.raises(ValueError):
        apply_spec(df, TableSpec("t", [ColumnMapping("b.c", "a")]))
    with pytest.raises(ValueError):
        apply_spec(df, TableSpec("t", [ColumnMapping("zz")]))
    request = {"target_name": "x", "action": "transform", "transform_rule": "abs", "source_format": "Y", "target_format": "UNIX"}
    mapping = ColumnMapping.from_dict("a", request)
    assert mapping.name == "x" and not mapping.is_date  # a chain wins over formats


def test_nested_cells(spark):
    df = spark.sql(
        "select map('k', 1) m, array(1, 2) a, array(named_struct('x', 1)) s, array(array(map('q', 2))) n, "
        "array(cast(0.05 as float), cast(0.1 as float)) v"
    )
    row = apply_spec(df, TableSpec("t", target_dialect="mysql")).rows.first()
    assert list(row) == ['{"k":1}', "[1,2]", '[{"x":1}]', '[[{"q":2}]]', "[0.05,0.1]"]
    kept = apply_spec(df, TableSpec("t", target_dialect="postgresql")).rows.first()
    assert kept.m == '{"k":1}' and kept.a == [1, 2] and kept.s == ['{"x":1}'] and kept.n == [['{"q":2}']]
