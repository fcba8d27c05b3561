"""Frozen hits, mapping identities, scored questions and a learner's long log."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import handoff
from lodestone.streaming import learner


def test_frozen_hits_and_what_makes_them_fail(spark):
    chunks = spark.createDataFrame([("a", "p", "t", "h1"), ("b", "p", "u", "h2")], "item string, provider string, textbook string, text_hash string")
    questions = spark.createDataFrame([(1, " why? ")], "query int, question string")
    hits = lambda *r: spark.createDataFrame(list(r), "query int, question string, item string, rank int, score double, text_hash string")
    good = handoff.frozen_hits(hits((1, "why?", "a", 1, 2.0, "h1")), chunks, questions, {"v": "1"}).collect()
    assert [(r.item, r.provider, r.textbook) for r in good] == [("a", "p", "t")]
    for bad, why in (((1, "why?", "z", 1, 2.0, "h1"), "unknown chunk"), ((1, "why?", "b", 1, 2.0, "h1"), "another text"), ((1, "how?", "a", 1, 2.0, "h1"), "other words"), ((2, "why?", "a", 1, 2.0, "h1"), "other words")):
        with pytest.raises(Exception, match=why):
            handoff.frozen_hits(hits(bad), chunks, questions, {}).count()


def test_identities(spark):
    row = ("k", "m", "c", "x", "h")
    df = lambda *r: spark.createDataFrame(list(r), "key string, mapping_id string, corpus_id string, chunk_config_id string, source_gold_hash string")
    assert handoff.same_identity(df(row), df(row), "key").collect()[0].mapping_id == "m"
    for bad, why in ((("k", "m", None, "x", "h"), "corpus_id"), (("k", "n", "c", "x", "g"), "mapping_id, source_gold_hash"), (("z", "m", "c", "x", "h"), "mapping_id, corpus_id, chunk_config_id, source_gold_hash")):
        with pytest.raises(Exception, match=why):
            handoff.same_identity(df(row), df(bad), "key").collect()


def test_scored_questions_by_hand(spark):
    questions = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False)], "query int, answerable boolean")
    paths = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (2, 0, "a"), (3, 0, "a")], "query int, path int, item string")
    hits = spark.createDataFrame([(1, "x", 1), (1, "b", 2), (1, "a", 4), (1, "c", 3), (2, "a", 1)], "query int, item string, rank int")
    items = spark.createDataFrame([("a", "t", "p"), ("b", "u", "p"), ("c", "t", "q")], "item string, textbook string, provider string")
    got = {r.query: r for r in handoff.scored_questions(questions, paths, hits, items, (2, 4)).collect()}
    one = got[1]
    assert (one.scope, one.provider_scope, one.first_rank, one.complete_rank, one.returned, one.empty, one.false_positive) == ("cross_textbook", "cross_provider", 2, 3, 4, 0, None)
    assert (one.hit_at_2, one.complete_at_2, one.recall_at_2, one.precision_at_2, one.missed_at_2) == (1, 0, 0.5, 0.5, 0)
    assert (one.complete_at_4, one.recall_at_4, one.precision_at_4) == (1, 1.0, 0.75)
    assert (got[2].scope, got[2].false_positive, got[2].recall_at_2, got[2].hit_at_2) == ("unanswerable", 1, None, 0)
    assert (got[3].scope, got[3].empty, got[3].rr, got[3].recall_at_2, got[3].precision_at_2, got[3].missed_at_2) == ("single_source", 1, 0.0, 0.0, None, 1)
    assert (got[4].empty, got[4].false_positive) == (1, 0)


def test_a_key_with_very_many_events(spark):
    """200,000 events of one key pass through in order: linear, no window over the key."""
    n = 200_000
    rows = spark.range(n).select(F.lit(1).alias("u"), F.col("id").alias("at"), F.when(F.col("id") % 10 == 9, "revoke").otherwise("submit").alias("kind"), F.lit(1).alias("good"), F.lit(1).alias("difficulty"), F.lit(0).alias("level"), F.lit(0).alias("start"))
    s = learner.states(rows, ["u"], ["at"]).collect()
    assert len(s) == 1 and s[0].attempts == n * 8 // 10
    plan = learner.replayed(rows, ["u"], ["at"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
