"""Files of every format, damaged where the readers must cope."""

import json

import pytest
from conftest import ROOT  # noqa: F401
from pyspark.sql import functions as F

from drayline.sources import files, listing
from drayline.sources.workbooks import read_workbooks
from registry.workbook_files import workbook_bytes


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_encodings_and_line_breaks(spark, folder):
    (folder / "a.csv").write_bytes("id,n\n1,café\n".encode("latin-1"))
    (folder / "b.csv").write_bytes('id,n\n2,café\n3\n4,"x\ny, ""z"""\n\n'.encode())
    (folder / "c.CSV").write_bytes(b"n,id,more\nx,5,y\n")
    (folder / "d.csv").write_bytes(b"id,more\n6,z\n")
    (folder / "empty.csv").write_bytes(b"")
    got = files.read_csv(spark, str(folder))
    assert set(got.columns) == {"id", "n", "more"}
    assert {(r.id, r.n, r.more) for r in got.collect()} == {
        ("1", "café", None), ("2", "café", None), ("3", None, None), ("4", 'x\ny, "z"', None), ("5", "x", "y"),
        ("6", None, "z"),
    }
    traits = {r.path.split("/")[-1]: (r.is_utf8, r.spans_lines) for r in files.csv_traits(spark, str(folder)).collect()}
    assert traits == {
        "a.csv": (False, False), "b.csv": (True, True), "c.CSV": (True, False), "d.csv": (True, False),
    }


def test_tsv_and_odd_names(spark, folder):
    odd = folder / "odd names [x] 100%"
    odd.mkdir()
    (odd / "2024-sales.tsv").write_text("id\tn\n1\ta,b\n")
    (odd / "b c.csv").write_text("id,n\n2,z\n")
    (odd / "skip.pdf").write_text("x")
    (odd / ".csv").write_text("hidden")
    got = files.read_csv(spark, files.plain_path(str(odd)) + "/*.[tc]sv")
    assert rows(got.select("id", "n")) == [("1", "a,b"), ("2", "z")]
    found = listing.list_files(spark, files.plain_path(str(odd)))
    assert rows(found.select("format", "table_name")) == [("csv", "_2024_sales"), ("csv", "b_c")]
    assert list(listing.paths_by_format(found)) == ["csv"]


def test_names_and_formats(spark):
    cases = {
        "/a/Orders.CSV": ("csv", "Orders"), "x/1.jsonl": ("jsonl", "_1"), "a.b.ndjson": ("jsonl", "a_b"),
        "/x/.json": (None, "_json"), "!!!.xls": ("xlsx", "___"), "plain": (None, "plain"), "ünï.parquet": ("parquet", "ünï"),
        "/dir.csv/none": (None, "none"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = df.select("p", listing.detect_format(F.col("p")), listing.table_name(F.col("p"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == cases
    empty = spark.createDataFrame([("",)], "p string").select(listing.table_name(F.col("p"))).first()[0]
    assert empty == "imported_file"


LINES = [
    '{"id": 1, "name": "a", "tags": [1, 2]}', "", "   ", '{"id": 2, "broken', "[1,2]", '"text"', "5",
    '{"id": "y", "id": "x", "name": null, "o": {"k": "v"}}', '{"a\\"b": 1.5, "id": 3}',
]


def test_jsonl(spark, folder):
    filler = [f'{{"id": {i}, "name": "n{i}"}}' for i in range(10, 320)]
    (folder / "x.jsonl").write_text("\n".join(LINES + filler + ['{"late": true}']) + "\n")
    got, rejected = files.read_jsonl(spark, str(folder / "x.jsonl"))
    assert got.columns == ["id", "name", "tags", "o", 'a"b', "late"]  # first-seen order, late key kept
    assert got.count() == 3 + len(filler) + 1
    assert sorted(r.record for r in rejected.collect()) == sorted(['{"id": 2, "broken', "[1,2]", '"text"', "5"])
    first = {r.id: r for r in got.where("id in ('1', 'x', '3')").collect()}
    assert first["1"].tags == "[1,2]" and first["x"].o == '{"k":"v"}' and first["x"].name is None
    assert first["3"]['a"b'] == "1.5"
    assert got.where("late = 'true'").count() == 1
    odd = spark.createDataFrame([(json.dumps({"a\"b'c": [1], "d'": None}),)], "record string")
    assert files.pick_keys(odd, ["a\"b'c", "d'", "z"]).first()[:] == ("[1]", None, None)


def test_json_documents(spark, folder):
    (folder / "a.json").write_text('[{"id": 1, "n": "x"}, 5, "s", null, [1], {"id": 2}]')
    (folder / "b.json").write_text('  {"id": 3, "m": {"k": [1]}}\n')
    got = files.read_json(spark, str(folder))
    assert set(got.columns) == {"id", "n", "m"}
    assert rows(got.select("id", "n", "m").fillna("-")) == [("1", "x", "-"), ("2", "-", "-"), ("3", "-", '{"k":[1]}')]
    (folder / "c.json").write_text('[{"id": 1}')
    with pytest.raises(Exception, match="not a JSON array or object"):
        files.read_json(spark, str(folder / "c.json"), ["id"]).collect()


def test_inferred_types_are_applied(spark, folder):
    (folder / "mixed_types.csv").write_text(
        "i,f,b,t,x,e,s\n1,1.5,true,2024-01-01,a,,5\n 2 ,2,FALSE,2024-01-01T10:00:00Z,1,,x\n,nan,,,,,\n"
    )
    raw = files.read_csv(spark, str(folder))
    mapped = files.typed(raw)
    assert dict(mapped.rows.dtypes) == {
        "i": "bigint", "f": "double", "b": "boolean", "t": "timestamp_ntz", "x": "string", "e": "string", "s": "string",
    }
    assert mapped.rows.count() + mapped.rejects.count() == 3


def test_schemas_of_many_files(spark, folder):
    (folder / "a.csv").write_text('id,"na""me, x",t\n1,x,2024-01-01\n2,,2024-01-02\n')
    (folder / "b.csv").write_text("v\n1.5\n7\n")
    got = files.infer_csv_files(spark, str(folder)).collect()
    found = {(r.path.split("/")[-1], r.ordinal): (r.column_name, r.data_type, r.is_nullable) for r in got}
    assert found == {
        ("a.csv", 0): ("id", "BIGINT", False), ("a.csv", 1): ('na"me, x', "TEXT", True),
        ("a.csv", 2): ("t", "TIMESTAMP", False), ("b.csv", 0): ("v", "DOUBLE PRECISION", False),
    }


def test_workbooks(spark, folder):
    (folder / "a.xlsx").write_bytes(workbook_bytes(["id", None, "name"], [[1, 2.5, "x & y"], [2, None, None]]))
    (folder / "b.xlsx").write_bytes(workbook_bytes(["name", "id"], [["z", 3]]))
    got = read_workbooks(spark, str(folder / "*.xlsx"))
    assert set(got.columns) == {"id", "col_1", "name"}
    assert rows(got.select("id", "col_1", "name").fillna("-")) == [("1", "2.5", "x & y"), ("2", "-", "-"), ("3", "-", "z")]


def test_read_by_format(spark, folder):
    df = spark.createDataFrame([(1, "a")], "id int, n string")
    df.write.parquet(str(folder / "p"))
    (folder / "j.jsonl").write_text(json.dumps({"id": 1, "n": "a"}))
    assert rows(files.read_files(spark, str(folder / "p"), "parquet")) == [(1, "a")]
    assert rows(files.read_files(spark, str(folder / "j.jsonl"), "jsonl")) == [("1", "a")]
    with pytest.raises(ValueError):
        files.read_files(spark, "x", "pdf")


def test_surplus_cells_are_rejected(spark, folder):
    from drayline.plans.files import file_tables

    path = folder / "x.csv"
    path.write_text('a,b\n1,2\n1,2,3\n4\n5,6,\n7,"8,9",z,y\n')
    assert sorted(tuple(r) for r in files.read_csv(spark, str(path)).collect()) == [("1", "2"), ("4", None), ("5", "6")]
    tables, rejects = file_tables(spark, str(folder))
    assert tables["x"].count() == 3
    assert sorted((r.a, r._faults[0].value) for r in rejects["x"].collect()) == [
        (1, '{"a":"1","b":"2","_surplus_cell":"3"}'), (7, '{"a":"7","b":"8,9","_surplus_cell":"z"}'),
    ]


def test_no_surplus_cell_is_lost(spark, folder):
    from drayline.plans.files import file_tables

    (folder / "x.csv").write_text('a,b\n1,2,,3\n4,5,,\n6\n7,8,z,y\n9,"p,q"\n')
    (folder / "m.csv").write_text('a,b\n1,"2\n2",,"3,""4"""\n5,6\n')
    (folder / "w.xlsx").write_bytes(workbook_bytes(["a", "b"], [[1, 2], [3, 4, None, 5], [6, 7, None]]))
    tables, rejects = file_tables(spark, str(folder))
    assert {n: t.count() for n, t in tables.items()} == {"x": 3, "m": 1, "w": 2}
    assert sorted(r.a for r in tables["x"].collect()) == [4, 6, 9]
    whole = {n: sorted(r._faults[1].value for r in rejects[n].collect()) for n in tables}
    assert whole["x"] == ["1,2,,3", "7,8,z,y"]
    assert whole["m"] == ['1,"2\n2",,"3,""4"""']
    assert [json.loads(v) for v in whole["w"]] == [["3", "4", None, "5"]]
    assert files.read_csv(spark, str(folder / "x.csv")).count() == 3
    assert read_workbooks(spark, str(folder / "w.xlsx")).count() == 2


def test_load_files_keeps_the_rejects_of_reading(spark, folder):
    from drayline.plans.files import load_files
    from drayline.plans.load import LoadOptions
    from drayline.plans.spec import ColumnMapping, TableSpec

    (folder / "in").mkdir()
    (folder / "in" / "x.csv").write_text("a,d\n1,5\n2,6,,7\n3,oops\n4,8\n")
    spec = TableSpec("x", [ColumnMapping("a"), ColumnMapping("d", target_type="INTEGER")])
    out = load_files(spark, str(folder / "in"), str(folder / "out"), {"x": spec}, LoadOptions(on_error="reject"))
    assert out.status == "success", out.errors
    assert out.rows == {"x": 2}
    assert sorted(int(r.a) for r in out.rejects["x"].collect()) == [2, 3]
    check = out.checks.collect()[0]
    assert (check.source_rows, check.target_rows, check.rejected_rows, check.matches) == (4, 2, 2, True)
