"""Validated joins, the event store and resumable runs."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import joins
from lodestone.sources import files, runs
from lodestone.sources.events import EventStore

ROW = "run_id string, model string, score int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def test_pairs_and_what_makes_them_fail(spark):
    base = rows(spark, ("a", "m", 1), ("b", None, 2), ("c", "m", None), ("d", "m", 0))
    good = joins.paired(base, rows(spark, ("a", "m", 2), ("b", None, None), ("c", "m", 0)), ["run_id"], ["model"])
    got = {r.run_id: (r.first, r.second, r.state, r.difference, r.flip) for r in joins.paired_differences(good, "score", 2).collect()}
    assert got == {"a": (1, 2, "evaluated", 1, True), "b": (2, None, "not_evaluated", None, None), "c": (None, 0, "not_evaluated", None, None)}
    for bad, why in ((("a", "x", 1), "another model"), (("z", "m", 1), "without baseline"), (("", "m", 1), "empty key"), ((None, "m", 1), "empty key"), (("b", "m", 1), "another model")):
        with pytest.raises(Exception, match=why):
            joins.paired(base, rows(spark, bad), ["run_id"], ["model"]).count()
    with pytest.raises(Exception, match="isn't unique"):
        joins.paired(base, rows(spark, ("a", "m", 1), ("a", "m", 1)), ["run_id"], ["model"]).select(F.lit(1)).collect()
    with pytest.raises(Exception, match="isn't unique"):
        joins.paired(base.unionByName(base), rows(spark, ("a", "m", 1)), ["run_id"], []).count()
    assert joins.paired(base.limit(0), base.limit(0), ["run_id"], ["model"]).count() == 0


def test_good_pairs_cost_one_scan_of_each_side(spark, tmp_path):
    rows(spark, ("a", "m", 1)).write.parquet(str(tmp_path / "x"))
    x = spark.read.parquet(str(tmp_path / "x"))
    plan = joins.paired(x, x.where("score = 1"), ["run_id"], ["model"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2


def test_one_to_one_merges(spark):
    left, right = rows(spark, ("a", "m", 1), (None, "m", 2), ("b", "n", 3)), rows(spark, ("a", "p", 4), (None, "q", 5), ("c", "r", 6))
    got = lambda how: sorted(map(tuple, joins.one_to_one(left, right, ["run_id"], how=how).collect()), key=str)
    both = [("a", "m", 1, "p", 4), (None, "m", 2, "q", 5)]
    assert got("inner") == sorted(both, key=str)
    assert got("left") == sorted([*both, ("b", "n", 3, None, None)], key=str)
    assert got("right") == sorted([*both, ("c", None, None, "r", 6)], key=str)
    assert got("outer") == sorted([*both, ("b", "n", 3, None, None), ("c", None, None, "r", 6)], key=str)
    assert joins.one_to_one(left, right, ["run_id"]).columns == ["run_id", "model_left", "score_left", "model_right", "score_right"]
    with pytest.raises(Exception, match="not unique on both sides: null"):
        joins.one_to_one(left, right.unionByName(rows(spark, (None, "q", 5))), ["run_id"]).count()


def test_cells_must_be_complete(spark):
    cells = [("x", 1), ("x", 2), (None, 1)]
    full = [(q, c, k) for q in ("a", "b", None) for c, k in cells]
    df = lambda r: spark.createDataFrame(r, "q string, c string, k int")
    assert {tuple(r) for r in joins.complete_cells(df(full), ["q"], ["c", "k"], cells).collect()} == {("a", 3), ("b", 3), (None, 3)}
    for bad in (full[1:], [*full, ("a", "x", 1)], [*full[1:], ("a", "y", 1)], [*full[:-1], (None, "x", 1)]):
        with pytest.raises(Exception, match="cells missing"):
            joins.complete_cells(df(bad), ["q"], ["c", "k"], cells).count()


EVENT = "user string, event_id string, attempt string, value int, created_at long"


def store(spark, path):
    return EventStore(spark, str(path), EVENT, stream=["user"], attempt="attempt")


def events(spark, *values):
    return spark.createDataFrame(list(values), EVENT)


def versions(s):
    out = {}
    for r in s.read().orderBy("user", "stream_version").collect():
        out.setdefault(r.user, []).append((r.event_id, r.stream_version, r.state_version_before))
    return out


def test_events_are_stored_once_with_versions(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    assert s.read().count() == 0
    first = events(spark, ("u", "e2", None, 2, 20), ("u", "e1", "t1", 1, 10), ("v", "e3", "t1", 3, 5), (None, "e4", None, 4, 1), ("u", "e1", "t1", 1, 99))
    assert s.append(first, "created_at") == 4
    assert versions(s) == {"u": [("e1", 1, 0), ("e2", 2, 1)], "v": [("e3", 1, 0)], None: [("e4", 1, 0)]}
    assert s.append(first, "created_at") == 0 and s.version() == 1
    # the attempt again under another id and at another time; a new event behind the known ones
    assert s.append(events(spark, ("u", "e9", "t1", 1, 50), ("u", "e0", None, 0, 1), (None, "e5", None, 4, 1)), "created_at") == 2
    assert versions(s)["u"] == [("e1", 1, 0), ("e2", 2, 1), ("e0", 3, 2)] and versions(s)[None] == [("e4", 1, 0), ("e5", 2, 1)]
    for bad in (("u", "e2", None, 7, 20), ("w", "e2", None, 2, 20), ("u", "e8", "t1", 8, 10), ("u", None, None, 1, 1)):
        with pytest.raises(Exception, match="CONFLICT"):
            s.append(events(spark, bad, ("x", "new", None, 1, 1)), "created_at")
    assert s.version() == 2 and s.read(1).count() == 4 and "x" not in versions(s)
    assert len(files.listed(spark, f"{tmp_path}/s/data")) == 2
    assert s.append(events(spark).limit(0)) == 0


def test_two_writers_cant_both_claim_a_version(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    s.append(events(spark, ("u", "e0", None, 0, 0)), "created_at")
    failed = []

    def write(w):
        own = store(spark, tmp_path / "s")
        try:
            for k in range(2):
                own.append(events(spark, *[("u", f"e{w}-{k}-{i}", None, i, i) for i in range(5)], ("u", f"both{k}", None, 1, 1)), "created_at")
        except Exception as e:  # told by the main thread
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    own = versions(s)["u"]
    assert [v for _, v, _ in own] == list(range(1, 24)) and len({e for e, _, _ in own}) == 23
    # the very claim: one of two that want the same name
    assert [files.claim(spark, f"{tmp_path}/c/1.json", {"w": w}) for w in range(2)] == [True, False]
    assert files.read_json(spark, f"{tmp_path}/c/1.json") == {"w": 0}


QUESTION = "question_id int, text string"


def questions(spark, n=20):
    return spark.createDataFrame([(i, "x" * i) for i in range(n)], QUESTION)


def answering(token, calls, stop=10**9):
    def work(batch):
        calls.append(1)
        if len(calls) > stop:
            raise InterruptedError("stopped here")
        return batch.select("question_id", F.length("text").alias("n"), F.lit(token).alias("by"))

    return work


def test_a_stopped_run_resumes_to_the_same_output(spark, tmp_path):
    path, calls = str(tmp_path / "out"), []
    with pytest.raises(Exception, match="stopped here"):
        runs.run_batch(questions(spark), {"v": 1}, answering("first", calls, 2), path, portions=4)
    assert not files.exists(spark, path)
    for again, error, why in (
        (dict(manifest={"v": 1}), FileExistsError, "unfinished"),
        (dict(manifest={"v": 2}, resume=True), ValueError, "another manifest"),
    ):
        with pytest.raises(error, match=why):
            runs.run_batch(questions(spark), work=answering("x", []), path=path, **again)
    with pytest.raises(ValueError, match="outside this batch"):
        runs.run_batch(questions(spark).where("question_id < 0"), {"v": 1}, answering("x", []), path, resume=True)
    got = runs.run_batch(questions(spark), {"v": 1}, answering("second", []), path, resume=True)
    assert sorted((r.question_id, r.n) for r in got.collect()) == [(i, i) for i in range(20)]
    by = {r.by: r.n for r in got.groupBy("by").agg(F.count("*").alias("n")).collect()}
    assert set(by) == {"first", "second"} and not files.exists(spark, f"{path}.inprogress")
    with pytest.raises(FileExistsError, match="finished"):
        runs.run_batch(questions(spark), {"v": 1}, answering("x", []), path, resume=True)


def test_a_portion_cut_off_in_the_middle_is_completed(spark, tmp_path):
    """Results of a portion whose end the stream never recorded are kept, and only the others are made."""
    path, calls = str(tmp_path / "out"), []
    with pytest.raises(Exception, match="stopped here"):
        runs.run_batch(questions(spark), {}, answering("first", calls, 1), path, portions=2)
    left = questions(spark).join(spark.read.parquet(f"{path}.inprogress/results").select("question_id"), "question_id", "left_anti")
    some = left.orderBy("question_id").limit(3).select("question_id", F.length("text").alias("n"), F.lit("cut").alias("by"))
    some.write.mode("append").parquet(f"{path}.inprogress/results")
    got = runs.run_batch(questions(spark), {}, answering("second", []), path, resume=True)
    assert sorted(r.question_id for r in got.collect()) == list(range(20))
    assert got.where("by = 'cut'").count() == 3


def test_runs_that_cant_be_right_fail(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        runs.run_batch(questions(spark), {}, answering("x", []), str(tmp_path / "a"), resume=True)
    with pytest.raises(ValueError, match="inprogress"):
        runs.run_batch(questions(spark), {}, answering("x", []), str(tmp_path / "a.inprogress"))
    with pytest.raises(ValueError, match="repeated"):
        runs.run_batch(questions(spark).unionByName(questions(spark, 1)), {}, answering("x", []), str(tmp_path / "a"))
    with pytest.raises(ValueError, match="0 results for 1"):
        runs.run_batch(questions(spark), {}, lambda b: b.where("question_id <> 7"), str(tmp_path / "b"))
    with pytest.raises(ValueError, match="2 results for 1"):
        runs.run_batch(questions(spark), {}, lambda b: b.unionByName(b.where("question_id = 7")), str(tmp_path / "c"))
    assert runs.run_batch(questions(spark, 0), {}, answering("x", []), str(tmp_path / "d")).count() == 0
