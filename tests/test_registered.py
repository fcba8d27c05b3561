"""Resampling by blocks of questions against draws written out."""

import hashlib

import numpy as np

from lodestone.operators import registered


def test_draws_reach_over_blocks_and_no_slot_is_joined(spark):
    n = registered.BLOCK + 4000
    questions = spark.range(n).selectExpr("id * 3 AS question_id").unionByName(spark.range(1).selectExpr("CAST(NULL AS long) AS question_id"))
    parts = spark.range(n).where("id % 3 < 2").selectExpr("id * 3 AS question_id", "IF(id % 3 = 0, 'a', 'b') AS endpoint", "CAST(id % 7 AS double) AS total", "id % 2 + 1 AS size")
    parts = parts.unionByName(spark.createDataFrame([(None, "a", 1e9, 1), (0, "rare", 5.0, 1)], "question_id long, endpoint string, total double, size long"))
    found = registered.resampled(parts, questions, 102, "s").where("draw IN (0, 101)")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.endpoint, r.draw): r.mean for r in found.collect()}
    want = {}
    for d in (0, 101):
        picks = np.array([int(hashlib.md5(f"s|{d}|{i}".encode()).hexdigest()[:8], 16) % (n + 1) for i in range(n + 1)])
        times = np.bincount(picks, minlength=n + 1)[:n]  # the null question is the last
        i = np.arange(n)
        for name, on in (("a", i % 3 == 0), ("b", i % 3 == 1)):
            want[name, d] = (times * (i % 7))[on].sum() / (times * (i % 2 + 1))[on].sum()
        if times[0]:
            want["rare", d] = 5.0
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_questions_no_draws(spark):
    none = spark.createDataFrame([], "question_id long, endpoint string, total double, size long")
    assert registered.resampled(none, none, 5, "s").count() == 0


def test_kappa_makes_no_row_for_a_draw_and_question(spark):
    ratings = spark.range(400).selectExpr("id % 40 AS question_id", "CAST(id % 3 + 1 AS int) AS a", "CAST(id % 5 % 3 + 1 AS int) AS b")
    found = registered.weighted_kappa_interval(ratings, 3, draws=20)
    assert "question_id" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.collect()[0].low <= found.collect()[0].high


def test_contrasts_make_no_row_for_a_draw_and_question(spark):
    values = spark.range(400).selectExpr("id DIV 2 AS question_id", "IF(id % 2 = 0, 'x', 'y') AS arm", "CAST(id % 11 AS double) AS value")
    found = registered.paired_contrasts(values, [("x", "y")], draws=20)
    assert "question_id" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.collect()[0].low <= found.collect()[0].high
