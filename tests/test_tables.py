"""Snapshot tables, ledgers and loads."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from drayline.operators.ledger import Ledger, hash_batch, pending_rows, resumable_load
from drayline.operators.progress import RunHistory
from drayline.plans.load import LoadOptions, column_warnings, dry_run, load_tables, write_mode
from drayline.plans.spec import ColumnMapping, TableSpec
from drayline.sinks.snapshot import (
    ConcurrentWrite,
    DuplicateKeys,
    SnapshotTable,
    bucket_count,
    key_bucket,
    last_per_key,
    row_bucket,
)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def people(spark, folder):
    target = SnapshotTable(spark, str(folder / "people"))
    df = spark.range(100).select(F.col("id"), F.concat(F.lit("n"), "id").alias("name"), F.lit(0).alias("v"))
    target.overwrite(df, ["id"], 8)
    return target


def changes(spark, pairs):
    return spark.createDataFrame(pairs, "id long, name string, v int")


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_upsert_is_idempotent(spark, people, limit):
    source = changes(spark, [(3, "three", 1), (200, "new", 1)])
    for _ in range(2):
        people.upsert(source, broadcast_bytes=limit)
        got = {r.id: (r.name, r.v) for r in people.read().collect()}
        assert len(got) == people.read().count() == 101
        assert got[3] == ("three", 1) and got[200] == ("new", 1) and got[4] == ("n4", 0)


def test_only_touched_buckets_are_rewritten(spark, people):
    (first,) = people.state().parts
    people.upsert(people.read().where("id < 40 and pmod(xxhash64(id), 8) = 3").withColumn("v", F.lit(5)))
    old, new = people.state().parts
    assert old == replace(first, dead=(3,)) and not new.merges and people.read().count() == 100


def test_few_rows_are_merged_by_readers(spark, people):
    people.overwrite(spark.range(1000).select("id", F.lit("n").alias("name"), F.lit(0).alias("v")), ["id"], 8)
    (first,) = people.state().parts
    for turn in range(3):
        people.upsert(changes(spark, [(3, f"t{turn}", turn), (3000 + turn, "new", turn)]))
    old, *merged = people.state().parts
    assert old == first and all(p.merges and p.rows == 2 and p.size < first.size for p in merged)
    got = {r.id: (r.name, r.v) for r in people.read().collect()}
    assert len(got) == people.read().count() == 1003 and got[3] == ("t2", 2) and got[3000] == ("new", 0)
    assert people.compact(most_merges=2) == 1 and not any(p.merges for p in people.state().parts)
    assert {r.id: (r.name, r.v) for r in people.read().collect()} == got and people.read().count() == 1003


def test_any_order_of_writes(spark, folder):
    """Against a dictionary: appends, merged and rewriting upserts, insert-only ones, folds, growth."""
    for seed in range(1):
        draw = random.Random(seed)
        target = SnapshotTable(spark, str(folder / f"t{seed}"), bucket_bytes=4000)
        target.create(changes(spark, []).schema, ["id"], 2)
        model, fresh = {}, 1000
        for step in range(12):
            kind = draw.choice(["append", "few", "few", "many", "insert", "sequence", "compact"])
            if kind == "append":
                added = {fresh + i: (f"a{step}", step) for i in range(draw.choice([5, 150]))}
                fresh += len(added)
                target.append(changes(spark, [(k, *v) for k, v in added.items()]), most_parts=draw.choice([1, 8]))
                model |= added
            elif kind == "compact":
                target.compact(1, draw.choice([0, 3]))
            else:
                known = draw.sample(sorted(model), min(len(model), 3 if kind == "few" else 60))
                rows = {k: (f"{kind}{step}", draw.randint(0, 20)) for k in [*known, *range(step, step + 3)]}
                source = changes(spark, [(k, *v) for k, v in rows.items()])
                limit = draw.choice([0, 1 << 20])
                if kind == "insert":
                    target.upsert(source, update=False, broadcast_bytes=limit)
                    model = rows | model
                elif kind == "sequence":
                    target.upsert(source, sequence="v", broadcast_bytes=limit)
                    model |= {k: v for k, v in rows.items() if k not in model or v[1] >= model[k][1]}
                else:
                    target.upsert(source, broadcast_bytes=limit)
                    model |= rows
            got = target.read().collect()
            assert sorted((r.id, r.name, r.v) for r in got) == sorted((k, *v) for k, v in model.items()), (seed, step, kind)
        some = target.read([0]).collect()
        assert {r.id for r in some} == {r.id for r in target.read().where(key_bucket(["id"], target.state().buckets) == 0).collect()}


def test_buckets_grow_with_the_table(spark, folder):
    target = SnapshotTable(spark, str(folder / "g"), bucket_bytes=20_000)
    target.create(spark.range(0).withColumn("t", F.lit("")).schema, ["id"], 2)
    for step in range(12):
        target.append(spark.range(step * 500, step * 500 + 500).withColumn("t", F.sha2(F.col("id").cast("string"), 256)), most_parts=3)
    state = target.state()
    assert state.buckets >= 16 and len(state.parts) <= 9 and target.read().count() == 6000
    assert all(p.size <= 2 * p.buckets * 20_000 for p in state.parts)
    kept = SnapshotTable(spark, str(folder / "k"), bucket_bytes=10)
    kept.create(spark.range(0).schema, ["id"], 2)
    for step in range(2):  # the buckets of a resumable load are its batches
        kept.append(spark.range(step * 9, step * 9 + 9), run_id="r")
    assert kept.state().buckets == 2 and kept.buckets_of_run("r") == {0, 1}


def test_small_buckets_share_folders(spark, folder):
    target = SnapshotTable(spark, str(folder / "s"), bucket_bytes=1000)
    rows = spark.range(4000).withColumn("t", F.sha2(F.col("id").cast("string"), 256))
    target.overwrite(rows, ["id"], 64)
    target.upsert(rows.where("id % 400 = 7").withColumn("t", F.lit("few")))
    target.upsert(rows.where("id < 2").withColumn("t", F.lit("more")), broadcast_bytes=0)
    target.append(rows.withColumn("id", F.col("id") + 10_000))
    for part in target.state().parts:
        assert part.buckets >= 64 and len(list((folder / "s" / "data" / f"table_part={part.name}").glob("table_bucket=*"))) <= 2
    some = target.read([3, 5]).collect()
    wanted = target.read().where(key_bucket(["id"], target.state().buckets).isin(3, 5)).collect()
    assert sorted(some) == sorted(wanted) and some
    assert target.read().count() == 8000 and target.read().where("t = 'few'").count() == 10
    target.compact(1, 0)
    assert target.read().count() == 8000 and target.read().where("t = 'more'").count() == 2


def test_many_keyed_appends_keep_few_parts(spark, folder):
    target = SnapshotTable(spark, str(folder / "m"))
    target.create(spark.range(0).schema, ["id"], 256)
    for step in range(12):
        target.append(spark.range(step * 40, step * 40 + 40), most_parts=4)
    state = target.state()
    assert len(state.parts) <= 8 and not any(p.filled or p.dead for p in state.parts)
    assert sorted(r.id for r in target.read().collect()) == list(range(480))


def test_rows_with_maps_are_batched(spark, folder):
    df = spark.range(60).select("id", F.create_map(F.lit("k"), F.col("id") % 7, F.lit("a"), F.lit(1)).alias("m"), F.array(F.create_map(F.lit(1), "id")).alias("l"))
    target, ledger = SnapshotTable(spark, str(folder / "t")), Ledger(spark, str(folder / "l"))
    assert resumable_load(df, target, ledger, "r", "t", [], 4, waves=2) == 60
    assert sorted(r.id for r in target.read().collect()) == list(range(60))
    swapped = df.withColumn("m", F.map_from_entries(F.reverse(F.map_entries("m"))))
    assert df.select(row_bucket(df, 50)).collect() == swapped.select(row_bucket(swapped, 50)).collect()
    last = last_per_key(df.withColumn("one", F.lit(1)), ["one"], "id").collect()
    assert [r.id for r in last] == [59]


def test_upsert_refuses_bad_keys(spark, people):
    with pytest.raises(DuplicateKeys):
        people.upsert(changes(spark, [(1, "a", 1), (1, "b", 2)]))
    with pytest.raises(ValueError, match="no key"):
        people.upsert(changes(spark, [(None, "a", 1)]))
    people.upsert(changes(spark, [(1, "a", 1), (1, "b", 2), (1, "c", 0)]), sequence="v")
    assert people.read().where("id = 1").first().name == "b"


def test_insert_only(spark, people):
    people.upsert(changes(spark, [(1, "a", 1), (500, "b", 1)]), update=False)
    assert people.read().where("id = 1").first().name == "n1"
    assert people.read().count() == 101


def test_failed_write_leaves_the_table(spark, people):
    bad = changes(spark, [(1, "a", 1)]).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    for write in (lambda: people.upsert(bad), lambda: people.overwrite(bad, ["id"], 8), lambda: people.append(bad)):
        with pytest.raises(Exception, match="lost"):
            write()
        assert people.read().count() == 100 and people.state().commit_no == 1


def test_a_second_writer_is_noticed(spark, people):
    one = changes(spark, [(1, "a", 1)])
    stale = people.state()
    people.upsert(one)
    with pytest.raises(ConcurrentWrite):
        people._commit(stale, "append", stale.schema, stale.keys, stale.buckets, stale.parts, 0)


def test_a_column_may_be_called_bucket(spark, folder):
    df = spark.createDataFrame([(1, 2), (3, 4)], "bucket long, part int")
    target = SnapshotTable(spark, str(folder / "b"))
    target.overwrite(df, ["bucket"], 4)
    target.upsert(df.withColumn("part", F.lit(9)))
    assert rows(target.read()) == [(1, 9), (3, 9)]


def test_repeated_batches_change_nothing(spark, people):
    one = changes(spark, [(1, "a", 1)])
    people.upsert(one, run_id="r", batch_id=0)
    commit = people.state().commit_no
    people.upsert(changes(spark, [(1, "zzz", 1)]), run_id="r", batch_id=0)
    assert people.state().commit_no == commit and people.read().where("id = 1").first().name == "a"
    people.append(one.withColumn("id", F.lit(900).cast("long")), run_id="r", batch_id=1)
    assert people.append(one, run_id="r", batch_id=1) == 0
    assert people.read().count() == 101


def test_modes(spark, folder):
    df = spark.createDataFrame([(1, "a")], "id long, n string")
    plain = SnapshotTable(spark, str(folder / "plain"))
    assert [plain.write(df), plain.write(df), plain.read().count()] == [1, 1, 2]
    keyed = SnapshotTable(spark, str(folder / "keyed"))
    keyed.write(df, ["id"], buckets=2)
    keyed.write(df.withColumn("n", F.lit("b")))
    assert rows(keyed.read()) == [(1, "b")]
    keyed.write(df, ["id"], fresh=True, buckets=2)
    assert rows(keyed.read()) == [(1, "a")]
    assert [write_mode(True, []), write_mode(False, ["k"]), write_mode(False, [])] == ["overwrite", "upsert", "append"]


def test_empty_tables(spark, folder):
    df = spark.createDataFrame([], "id long, n string")
    target = SnapshotTable(spark, str(folder / "e"))
    target.overwrite(df, ["id"], 4)
    assert target.read().count() == 0 and target.read().columns == ["id", "n"]
    target.upsert(df)
    target.upsert(spark.createDataFrame([(1, "a")], "id long, n string"))
    assert rows(target.read()) == [(1, "a")]
    target.create(df.schema, ["id"], 4)  # there already: nothing happens
    assert target.read().count() == 1
    with pytest.raises(FileNotFoundError):
        SnapshotTable(spark, str(folder / "none")).read()


def test_one_key_with_a_third_of_all_rows(spark, folder):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("seq"), (F.col("id") * 2).alias("v")
    )
    last = {r.k: r.v for r in last_per_key(df, ["k"], "seq").collect()}
    assert len(last) == 20000 and last[7] == 2 * 29997
    plan = last_per_key(df, ["k"], "seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by") >= 1  # rows are reduced before the shuffle


def test_bucket_count(spark, folder):
    spark.range(10).write.parquet(str(folder / "x"))
    df = spark.read.parquet(str(folder / "x"))
    assert bucket_count(df) == 1 and bucket_count(df, 100) > 5


def test_resume(spark, folder):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    batch = hash_batch(["id"], 8)
    broken = df.withColumn("v", F.when(batch % 2 == 1, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))
    target, ledger = SnapshotTable(spark, str(folder / "t")), Ledger(spark, str(folder / "l"))
    with pytest.raises(Exception, match="lost"):
        resumable_load(broken, target, ledger, "r", "t", ["id"], 8, waves=2)
    state = {r.batch_index: r.status for r in ledger.state("r").collect()}
    assert set(state.values()) == {"done", "failed"} and not ledger.is_complete("r", ["t"])
    half = target.read().count()
    assert resumable_load(df, target, ledger, "r", "t", ["id"], 8) == 1000 - half
    assert ledger.is_complete("r", ["t"]) and rows(target.read()) == rows(df)
    assert resumable_load(df, target, ledger, "r", "t", ["id"], 8) == 0


def test_many_open_batches(spark, folder, monkeypatch):
    monkeypatch.setattr("drayline.operators.ledger.FILTERED_BATCHES", 1)
    df = spark.range(100).withColumn("v", F.col("id"))
    target, ledger = SnapshotTable(spark, str(folder / "t")), Ledger(spark, str(folder / "l"))
    assert resumable_load(df, target, ledger, "r", "t", ["id"], 8, waves=3) == 100
    assert ledger.is_complete("r", ["t"]) and rows(target.read()) == rows(df)


def test_resume_after_a_lost_mark(spark, folder):
    """The rows were committed, the ledger does not know: nothing is doubled."""
    df = spark.range(100).withColumn("v", F.col("id"))
    target, ledger = SnapshotTable(spark, str(folder / "t")), Ledger(spark, str(folder / "l"))
    target.create(df.schema, ["id"], 4)
    target.append(df, run_id="r")
    from drayline.operators.ledger import plan_batches

    ledger.mark(plan_batches(df, hash_batch(["id"], 4), "t"), "r", "pending")
    assert resumable_load(df, target, ledger, "r", "t", ["id"], 4) == 0
    assert ledger.is_complete("r", ["t"]) and target.read().count() == 100


def test_pending_rows(spark):
    df = spark.range(10)
    done = spark.createDataFrame([(0,), (1,)], "batch_index long")
    assert sorted(r.id for r in pending_rows(df, F.col("id") % 4, done).collect()) == [2, 3, 6, 7]


@pytest.fixture
def related(spark):
    parent = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "pid long, n string")
    child = spark.createDataFrame([(i, i % 5, "x") for i in range(20)], "cid long, pid long, amount string")
    return {"child": child, "parent": parent}


SPECS = {"child": TableSpec("child", keys=["cid"]), "parent": TableSpec("parent", keys=["pid"])}


def test_load(spark, folder, related):
    history = RunHistory(spark, str(folder / "h"))
    options = LoadOptions(fresh=True, buckets=2)
    result = load_tables(spark, related, str(folder / "t"), SPECS, [("child", "parent")], options, history)
    assert result.status == "success" and result.rows == {"child": 20, "parent": 5}
    assert all(r.matches for r in result.checks.collect())
    run = history.latest().first()
    assert (run.status, run.rows, run.tables) == ("success", 25, 2)


def test_failed_load(spark, folder, related):
    history = RunHistory(spark, str(folder / "h"))
    specs = {**SPECS, "parent": TableSpec("parent", [ColumnMapping("n", action="transform", rules="abs")], keys=["pid"], not_null=["amount"])}
    result = load_tables(spark, related, str(folder / "t"), specs, [("child", "parent")], LoadOptions(buckets=2), history)
    assert result.status == "failed" and list(result.errors) == ["parent"] and result.rows == {}
    assert history.latest(1).first().status == "failed"


def test_append_load_is_compared_with_what_was_there(spark, folder, related):
    for _ in range(2):
        result = load_tables(spark, {"child": related["child"]}, str(folder / "t"))
        assert [r.matches for r in result.checks.collect()] == [True]
    assert result.checks.first().target_rows == 40


def test_dry_run_writes_nothing(spark, folder, related):
    plan = {r.table_name: r for r in dry_run(spark, related, {"child": SPECS["child"]}).collect()}
    assert (plan["child"].mode, plan["child"].row_count, plan["child"].doubles_on_rerun) == ("upsert", 20, False)
    assert (plan["parent"].mode, plan["parent"].row_count, plan["parent"].doubles_on_rerun) == ("append", 5, True)
    assert list(folder.iterdir()) == []
    specs = {"child": TableSpec("child", [ColumnMapping("cid", target_type="FLOAT")])}
    warned = column_warnings(spark, {"child": related["child"]}, specs).collect()
    assert [(r.source_column, r.message) for r in warned] == [("cid", "Precision loss might occur.")]


def test_load_files(spark, folder):
    from drayline.plans.files import load_files, plan_files

    source = folder / "in"
    source.mkdir()
    (source / "1 people.csv").write_text("id,n\n1,a\n2,b\nx,c\n")
    (source / "pets.jsonl").write_text('{"id": 1, "n": "rex"}\n{"id": 2}\nbroken\n')
    (source / "notes.txt").write_text("no table")
    plan = {r.table_name: r.mode for r in plan_files(spark, str(source)).collect()}
    assert plan == {"_1_people": "append", "pets": "append"} and not (folder / "out").exists()
    specs = {"pets": TableSpec("pets", [ColumnMapping("n", "name", "transform", rules="coalesce:none|uppercase")])}
    result = load_files(spark, str(source), str(folder / "out"), specs, LoadOptions(fresh=True))
    assert result.status == "success" and result.rows == {"_1_people": 3, "pets": 2}
    assert rows(SnapshotTable(spark, str(folder / "out/pets")).read()) == [(1, "REX"), (2, "NONE")]
    only = load_files(spark, str(source), str(folder / "o2"), options=LoadOptions(fresh=True), selected=["pets"])
    assert list(only.rows) == ["pets"]


def test_key_report_and_rejects_of_a_load(spark, folder, related):
    specs = {"child": TableSpec("child", [ColumnMapping("amount", action="transform", rules="abs")], keys=["pid"], not_null=["amount"])}
    result = load_tables(
        spark, {"child": related["child"]}, str(folder / "t"), specs, (), LoadOptions(True, "null", buckets=2)
    )
    assert result.keys.first().is_key is False and result.keys.first().distinct_keys == 5
    assert [(r.column_name, r.null_count) for r in result.nulls.collect()] == [("amount", 20)]
    rejected = load_tables(
        spark, {"child": related["child"]}, str(folder / "r"), specs, (), LoadOptions(True, "reject", buckets=2)
    )
    assert rejected.rows == {"child": 0} and rejected.rejects["child"].count() == 20


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_upsert_keeps_repeated_and_null_keys(spark, folder, limit):
    target = SnapshotTable(spark, str(folder / "t"))
    old = [(1, "a"), (1, "b"), (2, "c"), (None, "n1"), (None, "n2"), (None, "n3")]
    target.overwrite(spark.createDataFrame(old, "k int, v string"), ["k"], 2)
    target.upsert(spark.createDataFrame([(2, "C"), (9, "z")], "k int, v string"), broadcast_bytes=limit)
    assert sorted((r.k or 0, r.v) for r in target.read().collect()) == [
        (0, "n1"), (0, "n2"), (0, "n3"), (1, "a"), (1, "b"), (2, "C"), (9, "z"),
    ]


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_older_rows_dont_replace_newer_ones(spark, folder, limit):
    target = SnapshotTable(spark, str(folder / "t"))
    target.create(spark.createDataFrame([], "k int, s int, v string").schema, ["k"], 2)
    for rows in ([(1, 10, "new"), (2, 1, "x")], [(1, 5, "old"), (2, 1, "later")]):
        target.upsert(spark.createDataFrame(rows, "k int, s int, v string"), sequence="s", broadcast_bytes=limit)
    assert sorted(map(tuple, target.read().collect())) == [(1, 10, "new"), (2, 1, "later")]


def test_a_run_of_two_tables_is_complete_when_both_are(spark, folder):
    ledger = Ledger(spark, str(folder / "l"))
    a, b = spark.range(100), spark.range(50).selectExpr("id as x", "'t' as y")
    first, second = SnapshotTable(spark, str(folder / "a")), SnapshotTable(spark, str(folder / "b"))
    assert resumable_load(a, first, ledger, "r", "a", ["id"], 4) == 100
    assert not ledger.is_complete("r", ["a", "b"])
    assert resumable_load(b, second, ledger, "r", "b", [], 4, waves=2) == 50
    assert ledger.is_complete("r", ["a", "b"]) and rows(second.read()) == rows(b)
    assert resumable_load(b, second, ledger, "r", "b", [], 4, waves=2) == 0


@pytest.mark.parametrize("again", [(4, 1), (3, 3)])
def test_a_rerun_without_a_key_may_change_batches_and_waves(spark, folder, monkeypatch, again):
    df = spark.range(200).selectExpr("id as x", "id * 2 as y")
    ledger, target = Ledger(spark, str(folder / "l")), SnapshotTable(spark, str(folder / "t"))
    append, calls = SnapshotTable.append, []

    def dies_once(self, *args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return append(self, *args, **kwargs)

    monkeypatch.setattr(SnapshotTable, "append", dies_once)
    with pytest.raises(RuntimeError, match="lost"):
        resumable_load(df, target, ledger, "r", "t", [], 4, waves=2)
    assert 0 < target.read().count() < 200
    resumable_load(df, target, ledger, "r", "t", [], again[0], waves=again[1])
    assert rows(target.read()) == rows(df) and ledger.is_complete("r", ["t"])


def test_a_commit_is_made_once(spark, folder):
    target = SnapshotTable(spark, str(folder / "t"))
    target.create(spark.range(1).schema)
    state = target.state()
    target._commit(state, "append", state.schema, (), 1, (), 0)
    with pytest.raises(ConcurrentWrite):
        target._commit(state, "append", state.schema, (), 1, (), 0)


def test_a_long_ledger_is_folded(spark, folder):
    ledger = Ledger(spark, str(folder / "l"), fold_after=4)
    plan = spark.createDataFrame([("t", b, 10) for b in range(6)], "table_name string, batch_index long, row_count long")
    ledger.mark(plan.coalesce(1), "r", "pending", 6)
    for step in range(12):
        ledger.mark(plan.where(F.col("batch_index") == step % 6).coalesce(1), "r", "running" if step < 6 else "done")
        snapshot, _, marks = ledger._layout()
        assert len(marks) < 4 and (step < 2 or snapshot)
        state = {r.batch_index: r.status for r in ledger.state("r").collect()}
        expected = {b: "done" if step >= 6 + b else "running" if step >= b else "pending" for b in range(6)}
        assert state == expected and ledger.planned_batches("r", "t") == 6
    assert ledger.is_complete("r", ["t"]) and len(ledger.events().inputFiles()) <= 4
    names = [p.name for p in (folder / "l").iterdir()]
    assert sum(not n.startswith("snapshot-") for n in names) < 8 and not any(n.startswith("making-") for n in names)
    assert ledger.fold() == (len(ledger._layout()[2]) > 0) or not ledger.fold()


def test_loaded_tables_take_less_disk(spark, folder):
    rows = spark.range(20_000).withColumn("t", F.sha2(F.col("id").cast("string"), 256))
    rows.write.parquet(str(folder / "source"), compression="snappy")
    specs = {"keyed": TableSpec("keyed", keys=["id"]), "plain": TableSpec("plain")}
    result = load_tables(spark, {n: rows for n in specs}, str(folder / "to"), specs, (), LoadOptions(fresh=True, batches=2), run_id="r")
    assert result.status == "success" and all(r.matches for r in result.checks.collect())
    source = sum(p.stat().st_size for p in (folder / "source").glob("*.parquet"))
    for name in specs:
        assert sum(p.size for p in SnapshotTable(spark, str(folder / "to" / name)).state().parts) < 0.8 * source
