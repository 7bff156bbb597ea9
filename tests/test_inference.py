import random

from pyspark.sql import functions as F

from drayline.operators.inference import decode_bits, infer_types, text_rank

CELLS = {
    0: [None, "", "  ", "\t\n"],
    1: ["true", "FALSE", " True "],
    2: ["0", "-7", "+12", " 5 ", "1_000", "12345678901234567890123"],
    3: ["1.5", ".5", "5.", "1e5", "-2.5E-3", "nan", "Infinity", "-inf", "1_0.5"],
    4: ["2024-01-31", "2024-01-31 10:20", "2024-01-31T10:20:30", "2024-01-31T10:20:30.5Z", "2024-01-31 10:20:30+05:30", "2024-99-99"],
    5: ["x", "1,5", "0x1f", "1d", "1_", "_1", "1__0", "2024-1-31", "2024-01-31T10", "yes", "truee", "--1"],
}


def test_cells(spark):
    pairs = [(text, rank) for rank, texts in CELLS.items() for text in texts]
    df = spark.createDataFrame(pairs, "v string, expected int")
    wrong = df.where(text_rank(F.col("v")) != F.col("expected")).collect()
    assert wrong == []


def test_order_does_not_matter(spark):
    values = [c for r in (0, 2, 3) for c in CELLS[r]]
    for seed in range(3):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v string").repartition(seed + 1)
        row = infer_types(df).first()
        assert (row.data_type, row.is_nullable) == ("DOUBLE PRECISION", True)


def test_lattices(spark):
    mixes = {(1, 2): ("BIGINT", "TEXT"), (2, 4): ("TIMESTAMP", "TEXT"), (2, 3): ("DOUBLE PRECISION",) * 2, (0,): ("TEXT",) * 2, (4, 5): ("TEXT",) * 2, (1,): ("BOOLEAN",) * 2}
    rows = [(sum(1 << r for r in ranks), *expected) for ranks, expected in mixes.items()]
    df = spark.createDataFrame(rows, "bits int, ordered string, strict string")
    wrong = df.where(
        (decode_bits(F.col("bits")) != F.col("ordered")) | (decode_bits(F.col("bits"), "strict") != F.col("strict"))
    ).collect()
    assert wrong == []


def test_all_rows_unless_sampled(spark):
    df = spark.range(1000).select(F.when(F.col("id") == 999, "x").otherwise("1").alias("v")).coalesce(1)
    assert infer_types(df).first().data_type == "TEXT"
    assert infer_types(df, sample_rows=200).first().data_type == "BIGINT"


def test_native_values(spark):
    df = spark.sql("select true b, 1 i, 1.5D d, date'2024-01-01' t, cast(2.50 as decimal(9,2)) m, cast(3 as decimal(9,0)) w, array(1) a")
    assert [r.data_type for r in infer_types(df).orderBy("ordinal").collect()] == [
        "BOOLEAN", "BIGINT", "DOUBLE PRECISION", "TIMESTAMP", "DOUBLE PRECISION", "BIGINT", "TEXT",
    ]


def test_empty_table(spark):
    df = spark.createDataFrame([], "v string")
    row = infer_types(df).first()
    assert (row.data_type, row.is_nullable) == ("TEXT", False)
