"""Best items by terms against all pairs, and spans and claims in linear time."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexicon, quoting, search, spans
from lodestone.operators.lexicon import Lexicon


def tables(spark, n_queries=25, n_items=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: [rng.choice(words[: rng.choice([4, 30])]) for _ in range(n)]
    queries = [(i, text(rng.randint(0, 6))) for i in range(n_queries)] + [(90, ["nowhere"]), (91, ["w1", "nowhere", "w1"]), (92, None), (None, ["w1"])]
    items = [(f"d{i:03d}", text(rng.randint(0, 40))) for i in range(n_items)] + [("e1", ["w1", "w2"])] + [("e2", ["w1", "w2"])] + [("x", None), (None, ["w1"])]
    rng.shuffle(items)
    return spark.createDataFrame(queries, "q int, own array<string>"), spark.createDataFrame(items, "d string, terms array<string>").repartition(5)


@pytest.mark.parametrize("block, cells", [(1 << 12, 1 << 23), (14, 200)])
def test_first_items_are_those_of_all_pairs(spark, monkeypatch, block, cells):
    monkeypatch.setattr(lexicon, "BLOCK", block)
    monkeypatch.setattr(lexicon, "CELLS", cells)
    queries, items = tables(spark)
    own = Lexicon(queries, items, "q", "d", F.col("own"), F.col("terms"))
    for k in (4, 1000) if block > 100 else (4,):
        pairs = search.bm25(queries.where("q IS NOT NULL"), items, "q", "d", F.col("own"), F.coalesce("terms", F.array().cast("array<string>"))).where("score > 0 AND item IS NOT NULL")
        want = {(r.query, r.item, r.rank): r.score for r in search.top(pairs, k, F.desc("score"), F.col("item")).collect()}
        got = {(r.query, r.item, r.rank): r.score for r in own.bm25(k).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-7 for x in want)
        pairs = search.coverage(queries.where("q IS NOT NULL"), items, "q", "d", F.col("own"), F.col("terms")).where("item IS NOT NULL")
        want = {(r.query, r.item, r.overlap, r.rank, r.score) for r in search.top(pairs, k, F.desc("score"), F.desc("overlap"), F.col("item")).collect()}
        assert {(r.query, r.item, r.overlap, r.rank, r.score) for r in own.coverage(k).collect()} == want
    assert len(own.blocks) == (1 if block > 100 else 2)


def test_empty_sides(spark):
    queries, items = tables(spark)
    none = Lexicon(queries, items.limit(0), "q", "d", F.col("own"), F.col("terms"))
    assert none.bm25(5).count() == 0 and none.coverage(5).count() == 0
    none = Lexicon(queries.limit(0), items, "q", "d", F.col("own"), F.col("terms"))
    assert none.bm25(5).count() == 0 and none.coverage(5).count() == 0


def test_no_pairs_are_shuffled(spark):
    queries, items = tables(spark)
    plan = Lexicon(queries, items, "q", "d", F.col("own"), F.col("terms")).bm25(3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan


def test_line_spans_and_slices(spark):
    texts = [(1, "a\nbé\n\n日本 x"), (2, ""), (3, None), (4, "\n"), (5, "x" * 1000 + "\n" + "\U0001f600\ny")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {}
    for r in spans.line_spans(df).collect():
        got.setdefault(r.doc, []).append((r.line_no, r.line, r.start, r.end))
    for i, text in texts:
        if text is not None:
            assert "\n".join(x[1] for x in sorted(got[i])) == text
            assert all(text[a:b] == line for _, line, a, b in got[i])
    assert 3 not in got
    cut = df.select("doc_id", spans.cut("text", F.array(F.lit(0), F.lit(2)), F.array(F.lit(1), F.lit(900))).alias("s")).collect()
    assert {r.doc_id: r.s for r in cut} == {i: None if t is None else [t[0:1], t[2:900]] for i, t in texts}


def test_one_long_text_takes_linear_time():
    """A text of a million lines, and 4,000 claims on 2 million characters: each is read once."""
    long = "é\n" * 1_000_000
    assert len(spans.line_starts.func(pd.Series([long]))[0]) == 1_000_001
    text = "".join(f"{i:07d} " for i in range(250_000))
    found = quoting.claims_of(text, [text[i : i + 200] for i in range(0, 2_000_000, 500)], list(range(0, 2_000_000, 500)))
    assert all(f == (True, True, 1, i * 500) for i, f in enumerate(found))


def test_claims_match_plain_search(spark):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 60)))) for i in range(20)] + [(50, None)]
    claims = [(k, rng.choice([*range(20), 50, 77, None]), rng.choice([None, *range(0, 60)]), rng.choice([None, "", *("".join(rng.choice("ab ") for _ in range(n)) for n in (1, 2, 3, 5))])) for k in range(400)]
    rows = quoting.claimed_places(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(claims, "claim long, doc_id long, at long, quote string")).collect()
    by = dict(texts)
    assert len(rows) == len(claims)
    for r in rows:
        text, q = by.get(r.doc_id), r.quote
        if text is None:
            assert (r.known, r.there, r.found, r["first"]) == (False, False, 0, None)
        else:
            hits = text.count(q) if q else 0
            assert (r.known, r.there, r.found, r["first"]) == (True, bool(q) and r.at is not None and text.startswith(q, r.at) and r.at + len(q) <= len(text), hits, text.find(q) if hits else None)
