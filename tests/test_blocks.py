"""Cells that span lines and JSON documents, cut block by block."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from drayline.sources import files
from drayline.sources.blocks import csv_lines, csv_records, json_chunks, json_elements


@pytest.fixture
def small_blocks(spark):
    """Files are dealt out in blocks of a few bytes."""
    def sized(size):
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(key, str(size))
    yield sized
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def drawn_rows(seed, rows, separator=","):
    draw = random.Random(seed)
    parts = ["a", "b c", '"', '""', "\n", "\n\n", separator, "5", "é", " ", ""]
    return [["".join(draw.choices(parts, k=draw.randint(0, 6))) for _ in range(3)] for _ in range(rows)]


def written(rows, separator, stray):
    """Cells quoted where they must be; inch marks inside plain cells are left as they are."""
    out = io.StringIO()
    for row in rows:
        cells = []
        for cell in row:
            plain = not any(c in cell for c in (separator, "\n")) and not cell.startswith('"')
            cells.append(cell if plain and (stray or '"' not in cell) else '"' + cell.replace('"', '""') + '"')
        out.write(separator.join(cells) + "\n")
    return out.getvalue()


@pytest.mark.parametrize(("seed", "separator", "size"), [(1, ",", 40), (2, "\t", 7), (3, "||", 64), (4, ",", 3), (5, ";", 4096)])
def test_spanning_cells(spark, folder, small_blocks, seed, separator, size):
    rows = drawn_rows(seed, 60, separator)
    # Spark's parser adds quote signs to plain cells when the separator has more signs than one
    text = written([["x", "y", "z"], *rows], separator, len(separator) == 1)
    (folder / "a.csv").write_bytes(text.encode())
    (folder / "b.csv").write_bytes(text.replace("\n", "\r\n").encode("latin-1"))
    small_blocks(size)
    found = files.read_csv(spark, str(folder), separator=separator)
    expected = sorted([tuple(c or None for c in r) for r in rows if any(r)] * 2, key=str)
    got = [tuple(r) for r in found.collect()]
    assert sorted((r for r in got if any(r)), key=str) == expected


def test_like_the_csv_module(spark, folder, small_blocks):
    rows = drawn_rows(9, 80)
    text = written([["x", "y", "z"], *rows], ",", False)
    (folder / "a.csv").write_text(text)
    small_blocks(50)
    expected = [tuple(c or None for c in r) for r in csv.reader(io.StringIO(text)) if any(r)][1:]
    got = [tuple(r) for r in files.read_csv(spark, str(folder / "a.csv")).collect()]
    assert sorted((r for r in got if any(r)), key=str) == sorted(expected, key=str)


def test_blocks_are_read_by_many_tasks(spark, folder, small_blocks):
    lines = "".join(f'{i},"a {i}\nb ""{i}""",5" pipe {i}\n' for i in range(3000))
    (folder / "a.csv").write_text("n,t,u\n" + lines)
    small_blocks(4000)
    path = [str(folder / "a.csv")]
    assert csv_lines(spark, path, ",", True).rdd.getNumPartitions() > 20
    records = csv_records(spark, path, ",", True)
    assert records.select("block").distinct().count() > 20
    assert records.count() == 3001 and records.where("first").select("record").collect() == [("n,t,u",)]
    found = files.read_csv(spark, path).orderBy(F.col("n").cast("int")).collect()
    assert [tuple(r) for r in found] == [(str(i), f'a {i}\nb "{i}"', f'5" pipe {i}') for i in range(3000)]


def test_odd_files(spark, folder, small_blocks):
    small_blocks(10)
    cases = {
        "open.csv": ('a,b\n1,"never\nclosed\n', [("1", "never\nclosed")]),
        "header.csv": ('"a\nx",b\n1,"2\n3"\n\n\n4,5\n', [("1", "2\n3"), ("4", "5")]),
        "long.csv": ('a,b\n1,"' + "line\n" * 300 + '"\n2,x\n', [("1", "line\n" * 300), ("2", "x")]),
        "inch.csv": ('a,b\n1,5" x\n2,6" y\n', [("1", '5" x'), ("2", '6" y')]),
        "odd.csv": ('a,b\n1,"x"y"z\n2,"p\nq"\n', [("1", '"x"y"z'), ("2", "p\nq")]),
        "none.csv": ("a,b\n", []),
    }
    for name, (text, expected) in cases.items():
        (folder / name).write_text(text)
        found = files.read_csv(spark, str(folder / name))
        assert [tuple(r) for r in found.orderBy(found.columns[0]).collect()] == expected, name
    assert files.read_csv(spark, str(folder / "header.csv")).columns == ["a\nx", "b"]
    surplus = files.csv_surplus(spark, str(folder / "odd.csv")).collect()
    assert surplus == []
    (folder / "more.csv").write_text('a,b\n1,"x\ny",,z\n2,3\n')
    assert [r["_record"] for r in files.csv_surplus(spark, str(folder / "more.csv")).collect()] == ['1,"x\ny",,z']
    assert files.read_csv(spark, str(folder / "more.csv")).count() == 1


def drawn_value(draw, depth):
    kind = draw.choice(["text", "number", "object", "array", "odd"] if depth else ["text", "number", "odd"])
    if kind == "text":
        return "".join(draw.choices(['"', "\\", "{", "}", "[", "]", "a", ",", ":", "é", "\n"], k=draw.randint(0, 5)))
    if kind == "object":
        return {drawn_value(draw, 0) if draw.random() < 0.1 else f"k{i}": drawn_value(draw, depth - 1) for i in range(draw.randint(0, 3))}
    if kind == "array":
        return [drawn_value(draw, depth - 1) for _ in range(draw.randint(0, 3))]
    return draw.choice([1.5, None, True]) if kind == "odd" else draw.randint(0, 99)


@pytest.mark.parametrize(("seed", "size"), [(1, 60), (2, 500), (3, 1 << 20)])
def test_json_arrays(spark, folder, small_blocks, seed, size):
    draw = random.Random(seed)
    elements = [drawn_value(draw, 3) for _ in range(70)]
    texts = {"a.json": json.dumps(elements), "b.json": json.dumps(elements, indent=2, ensure_ascii=False) + "\n", "c.json": json.dumps({"k": elements})}
    for name, text in texts.items():
        (folder / name).write_text(text)
    small_blocks(size)
    elements = json.loads(json.dumps(elements))  # keys as text
    expected = [e for e in elements if isinstance(e, dict)]
    for name, wanted in (("a.json", expected), ("b.json", expected), ("c.json", [{"k": elements}])):
        found = json_elements(spark, [str(folder / name)]).orderBy("block", "line").collect()
        assert [json.loads(r["record"]) for r in found] == wanted


def test_json_is_read_by_many_tasks(spark, folder, small_blocks):
    (folder / "a.json").write_text(json.dumps([{"n": i, "t": "}{" * 5} for i in range(5000)]))
    small_blocks(8000)
    path = [str(folder / "a.json")]
    assert json_chunks(spark, path).rdd.getNumPartitions() > 10
    rows = files.read_json(spark, path)
    assert rows.columns == ["n", "t"] and rows.count() == 5000 and "wholetext" not in rows._jdf.queryExecution().toString()


@pytest.mark.parametrize("text", ['[{"a": 1}', '{"a": 1', "3", "", '"x"', '[{"a": "x}]', '[{"a": 1}]]', '[{"a": 1}, {"b" 2}]', "  \n"])
def test_broken_documents_raise(spark, folder, text):
    (folder / "a.json").write_text(text)
    if not text:  # an empty file has no block
        assert files.json_records(spark, str(folder)).collect() == []
        return
    with pytest.raises(Exception, match="not a JSON|MALFORMED"):
        files.json_records(spark, str(folder)).collect()


def test_documents_without_objects(spark, folder):
    for name, text in (("a.json", " [ ] "), ("b.json", "[1, [{}], \"{}\"]"), ("c.json", "﻿{}\n")):
        (folder / name).write_text(text)
    assert [r["record"] for r in files.json_records(spark, str(folder)).collect()] == ["{}"]


def test_inference_over_many_files_with_spanning_cells(spark, folder, small_blocks):
    small_blocks(30)
    (folder / "a.csv").write_text('n,t\n1,"x\ny"\n2,z\n')
    (folder / "b.csv").write_text("n,d,k\n1.5,2024-01-02,\n2,2024-01-03,7\n")
    (folder / "c.csv").write_text('"a\nb",m\n3,"1\n2"\n')
    (folder / "d.csv").write_text("only,header\n")
    found = files.infer_csv_files(spark, str(folder)).collect()
    got = {(r.path[-5:], r.column_name): (r.ordinal, r.data_type, r.is_nullable) for r in found}
    assert got[("a.csv", "n")][1:] == got[("b.csv", "k")][1:2] + (False,) and got[("a.csv", "t")][0] == 1
    one = {(r.path[-5:], r.column_name): r.data_type for name in "abd" for r in files.infer_csv_files(spark, str(folder / f"{name}.csv")).collect()}
    assert all(got[k][1] == v for k, v in one.items()) and got[("c.csv", "a\nb")][1] == got[("a.csv", "n")][1] != got[("c.csv", "m")][1]
    assert got[("a.csv", "t")][1] == got[("c.csv", "m")][1] and got[("b.csv", "k")][2]
