"""First blocks for questions out of tasks' firsts, against all pairs scored."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import screening

QUESTION = "query int, terms array<string>, answer string, answer_terms array<string>"
BLOCK = "block long, doc int, text string, block_terms array<string>"


def tables(spark, n_blocks=300):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    some = lambda most: list(dict.fromkeys(rng.choice(words[: rng.choice([5, 40])]) for _ in range(rng.randint(0, most))))
    questions = [(i, some(30), rng.choice(["W1 w2", "w3", "nowhere", ""]), some(2)) for i in range(12)] + [(90, ["nowhere"], "x", []), (91, [], "w1", ["w1"]), (None, ["w1"], "w1", [])]
    blocks = []
    for i in range(n_blocks):
        own = some(8) if i % 3 else ["w1", "w2", "w3"]  # a third of them alike
        blocks.append((rng.randrange(10**6) * 1000 + i, i % 7, " ".join(own).upper() + " Ä", own))
    return spark.createDataFrame(questions, QUESTION), spark.createDataFrame([*blocks, (None, 1, "w1", ["w1"])], BLOCK).repartition(5)


@pytest.mark.parametrize("together, cells, k", [(1 << 12, 1 << 19, 4), (3, 40, 4), (1 << 12, 100, 1000)])
def test_firsts_are_those_of_all_pairs(spark, monkeypatch, together, cells, k):
    monkeypatch.setattr(screening, "TOGETHER", together)
    monkeypatch.setattr(screening, "CELLS", cells)
    questions, blocks = tables(spark)
    pairs = screening.candidates(questions, blocks.select("block", F.col("block_terms").alias("terms"))).join(blocks, "block").join(questions, "query")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("overlap"), F.desc("has_answer"), "block"))
    columns = ["query", "rank", "block", "doc", "score", "overlap", "has_answer"]
    want = {tuple(r) for r in screening.scored(pairs).withColumn("rank", place).where(F.col("rank") <= k).select(*columns).collect()}
    found = screening.best(questions, blocks, k, ["doc", "block_terms"])
    assert {tuple(r) for r in found.select(*columns).collect()} == want and want
    own = {r.block: r.block_terms for r in blocks.collect()}
    assert all(own[r.block] == r.block_terms for r in found.collect())


def test_blocks_and_pairs_are_not_shuffled(spark):
    questions, blocks = tables(spark)
    plan = screening.best(questions, blocks, 3, ["doc"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_empty_sides(spark):
    questions, blocks = tables(spark, 5)
    assert screening.best(questions, blocks.limit(0), 3, []).count() == 0
    assert screening.best(questions.limit(0), blocks, 3, []).count() == 0


def test_pairs_and_suppression_read_the_firsts(spark):
    from lodestone import registry

    for name in ("r13_suppressed_blocks", "r14_j11_best_pairs", "r15_r16_pair_metrics"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "documents.parquet" not in plan and "Generate" not in plan, name  # written once, few rows
