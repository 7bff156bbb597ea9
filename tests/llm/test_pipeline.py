import corpus_pipeline
from drayline.llm import quality_rules, simhash

SF_DIR = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF_DIR)
        rows = made.collect()
        kept = {r["doc_id"] for r in rows}
        assert rows and kept <= ids
        if name == "quality_rules":
            verdicts = quality_rules.judged(docs).collect()
            assert kept == {r["doc_id"] for r in verdicts if r["kept"]}
        if name == "near_dedup":
            components = simhash.near_duplicates(docs).collect()
            assert sorted(r["doc_id"] for r in rows) == sorted({r["component_id"] for r in components})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == columns
        docs, ids = spark.createDataFrame(rows, made.schema), kept
    assert {"piece_ids", "n_pieces"} <= set(docs.columns)


def test_run_is_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows and all(len(r["piece_ids"]) == r["n_pieces"] for r in rows)
