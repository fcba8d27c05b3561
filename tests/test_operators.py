"""Small hand-made cases of operators' properties."""

import random

from pyspark.sql import functions as F

from lodestone.operators import joins, metrics, ranking, spans, stats
from lodestone.operators.search import fused
from lodestone.streaming.learner import states, stream_states


def test_zero_weight_list_brings_candidates(spark):
    one = spark.createDataFrame([(1, 10, 1)], "query int, item int, rank int")
    two = spark.createDataFrame([(1, 20, 1)], "query int, item int, rank int")
    rows = {r["item"]: r for r in fused(one, two, (1.0, 0.0)).collect()}
    assert rows[20]["score"] == 0 and rows[20]["kind"] == "second" and rows[10]["kind"] == "first"


def test_empty_retrieval_is_null_not_zero(spark):
    questions = spark.createDataFrame([(1,)], "query int")
    hits = spark.createDataFrame([], "query int, item int, rank int")
    gold = spark.createDataFrame([(1, 5)], "query int, item int")
    row = metrics.at_k(metrics.judged(questions, hits, gold), [5]).head()
    assert row["precision"] is None and row["recall"] == 0 and row["hit"] == 0


def test_touching_intervals_merge(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 12, 13)], "g int, start int, end int")
    assert sorted((r["start"], r["end"]) for r in spans.islands(rows, "g").collect()) == [(0, 9), (12, 13)]


def test_holm_is_monotone(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert [round(r["adjusted"], 6) for r in stats.holm(rows, "name", "p").orderBy("p").collect()] == [0.03, 0.06, 0.06]


def test_no_variance_has_no_correlation(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0)] * 5, "g int, x double, y double")
    assert stats.correlation(rows, ["g"], "x", "y").head()["r"] is None


LOG = "user_id int, event_id int, kind string, good int, difficulty int, level int, start int"


def told(spark, *events, start=0):
    return spark.createDataFrame([(1, i, kind, good, difficulty, level, start) for i, (kind, good, difficulty, level) in enumerate(events)], LOG)


def test_learner_levels_by_hand(spark):
    right, wrong = ("submit", 1, 2, 0), ("submit", 0, 0, 0)
    of = lambda events, start=0: {k: v for k, v in states(told(spark, *events, start=start), ["user_id"], ["event_id"]).head().asDict().items()}
    assert of([right] * 2)["level"] == 0 and of([right] * 4)["level"] == 1  # 0.6, 0.68, 0.744, 0.7952
    up = of([right] * 4)
    assert (up["score"], up["since"], up["attempts"], up["right_ones"], up["coverage"]) == (0.5, 0, 4, 4, 0.0)
    assert of([right] * 3)["level"] == 0  # a full window, but a score under the threshold
    assert of([("submit", 1, 0, 0)] * 9)["level"] == 0  # no answer at the next level's difficulty
    assert of([right] * 4 + [("revoke", None, 0, 0)])["level"] == 0 and of([right] * 4 + [("revoke", None, 0, 0)])["score"] == 0.744
    over = of([right] * 3 + [("override", None, 0, 2), ("revoke", None, 0, 0)])
    assert (over["level"], over["score"], over["attempts"], over["right_ones"]) == (2, 0.5, 2, 2)
    assert of([("revoke", None, 0, 0), ("skip", None, 0, 0)], start=1)["level"] == 1
    assert of([wrong] * 9, start=2)["level"] < 2 and of([("submit", 0, 2, 0)] * 9, start=1)["level"] == 1


def test_streamed_learner_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(u, i, rng.choice(["submit"] * 6 + ["skip", "override", "revoke"]), rng.random() < 0.6, rng.randrange(3), rng.randrange(3), u % 3) for u in range(4) for i in range(40)]
    events = spark.createDataFrame([(u, i, k, int(g) if k == "submit" else None, d, v, s) for u, i, k, g, d, v, s in rows], LOG)
    events.where("event_id < 17").coalesce(1).write.parquet(str(tmp_path / "in"))

    def once():
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        out = stream_states(stream, ["user_id"], ["event_id"]).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        out.foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start().awaitTermination()

    once()
    events.where("event_id >= 17").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    once()
    columns = ["attempts", "right_ones", "score", "level", "since"]
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("user_id").agg(F.max_by(F.struct(*columns), "n").alias("s")).select("user_id", "s.*")
    want = states(events, ["user_id"], ["event_id"]).select("user_id", *columns)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_overlapping_spans_meet_once(spark):
    left = spark.createDataFrame([(1, 0, 25), (1, 30, 30), (2, 5, 6), (None, 0, 9)], "doc int, start int, end int")
    right = spark.createDataFrame([(1, 0, 25), (1, 24, 60), (1, 25, 26), (2, 0, None), (None, 0, 9)], "doc int, other_start int, other_end int")
    got = joins.overlapping(left, right, ["doc"], 10).select("doc", "start", "end", "other_start", "other_end").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 25, 0, 25), (1, 0, 25, 24, 60)]


def test_complete_rank_needs_whole_paths(spark):
    hits = spark.createDataFrame([("q", "a", "s", "x", 1), ("q", "a", "t", "x", None), ("q", "b", "s", "x", 4), ("q", "b", "s", "y", 2), ("q", "b", "t", "x", 3), ("r", "a", "s", "x", None)], "q string, p string, s string, c string, rank int")
    assert {r.q: r.complete_rank for r in ranking.complete_rank(hits, "q", "p", "s", "c", "rank").collect()} == {"q": 3, "r": None}


def test_mcnemar(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (2, 8), (5, 5), (0, 10)], "b long, c long")
    got = [round(r.p, 9) for r in rows.select(stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()]
    assert got == [1.0, 1.0, 0.109375, 1.0, 0.001953125]


def test_coverage_takes_both_sides_and_nulls(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (2,), (3,), (None,)], "k int")
    assert sorted(map(tuple, joins.coverage(a, b, ["k"]).collect())) == [(1, "missing"), (3, "unexpected")]
    assert joins.coverage(a.limit(0), b.limit(0), ["k"]).count() == 0


def runs_by_definition(tokens, target, most, least):
    """Chunks of a segment straight from the rule: try every end, then look at the tail."""
    size = lambda run: sum(tokens[i] for i in run)
    left, out = list(range(len(tokens))), []
    while left:
        ends = [left[:n] for n in range(1, len(left) + 1)]
        fitting = [e for e in ends if size(e) <= most]
        until = next((i for i, e in enumerate(fitting) if size(e) >= target), len(fitting) - 1)
        best = min((e for e in fitting[: until + 1] if size(e)), key=lambda e: (abs(target - size(e)), len(e)), default=None)
        over = [e for e in ends if size(e) > most]
        if best is None and not over:
            break
        out.append(best or over[0])
        left = left[len(out[-1]) :]
    if len(out) > 1 and size(out[-1]) < least:
        if size(out[-2] + out[-1]) <= most:
            out[-2:] = [out[-2] + out[-1]]
        else:
            while len(out[-2]) > 1 and size(out[-1]) < least and size(out[-2][:-1]) <= most and size(out[-2][-1:] + out[-1]) <= most:
                out[-1], out[-2] = out[-2][-1:] + out[-1], out[-2][:-1]
    return [r for r in out if size(r)]


def test_chunks_follow_their_rule(spark):
    from lodestone.operators import chunking

    rng = random.Random(3)
    rows = [(d, i, 1, rng.choice([0, 5, 20, 60, 130, 300]), False) for d in range(40) for i in range(rng.randrange(1, 15))]
    blocks = spark.createDataFrame(rows, "doc_id int, line_no int, segment long, n_tokens int, inline_heading boolean")
    got = {}
    for r in chunking.grouped(blocks, target=120, most=160, least=40).collect():
        got.setdefault(r.doc_id, {}).setdefault(r.chunk, []).append(r.line_no)
    for d in range(40):
        want = runs_by_definition([r[3] for r in rows if r[0] == d], 120, 160, 40)
        assert [sorted(v) for _, v in sorted(got.get(d, {}).items())] == want
    heads = spark.createDataFrame([(1, 0, 1, 3, True), (1, 1, 2, 3, True), (1, 2, 2, 200, False)], "doc_id int, line_no int, segment long, n_tokens int, inline_heading boolean")
    assert {(r.line_no, r.chunk) for r in chunking.grouped(heads, target=120, most=160, least=40).collect()} == {(2, 1)}


def test_near_titles_match_brute_force(spark):
    import difflib

    from lodestone.operators import merging

    rng = random.Random(4)
    titles = sorted({" ".join([rng.choice(["wave", "force"]), *rng.choices(["motion", "motions", "field", "fields", "first", "second", "elastic"], k=rng.randrange(1, 4))]) for _ in range(80)})
    got = {(r.left_title, r.right_title): r.similarity for r in merging.near_titles(spark.createDataFrame([(t,) for t in titles], "title string"), distinctive=merging.DISTINCTIVE).collect()}
    want = {}
    for a in titles:
        for b in titles:
            ratio = difflib.SequenceMatcher(None, a, b).ratio()
            if a < b and a.split()[0] == b.split()[0] and ratio >= 0.9 and not (set(a.split()) ^ set(b.split())) & set(merging.DISTINCTIVE):
                want[a, b] = round(ratio, 3)
    assert got == want and want


def test_suppression_keeps_the_best_of_what_overlaps(spark):
    from lodestone.operators import screening

    rng = random.Random(5)
    rows = [(q, r, rng.randrange(3), s, s + rng.randrange(1, 60)) for q in range(6) for r, s in enumerate(rng.choices(range(100), k=30), 1)]
    got = {(r.query, r.rank) for r in screening.suppressed(spark.createDataFrame(rows, "query int, rank int, doc int, start int, end int"), 7).collect()}
    want = set()
    for q in range(6):
        kept = []
        for row in sorted(r for r in rows if r[0] == q):
            same = [k for k in kept if k[2] == row[2] and min(k[4], row[4]) - max(k[3], row[3]) >= 0.85 * min(k[4] - k[3], row[4] - row[3])]
            if not same and len(kept) < 7:
                kept.append(row)
        want |= {(q, r[1]) for r in kept}
    assert got == want


def test_components_follow_long_paths(spark):
    from lodestone.operators import merging
    from lodestone.sources.shared import written

    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100)], "a long, b long")
    assert {(r.node, r.component) for r in merging.components(edges, written).collect()} == {(i, 1) for i in range(1, 41)} | {(100, 100), (101, 100)}
    assert merging.components(edges.limit(0), written).count() == 0


def test_quotes_with_gaps(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import merging

    rows = spark.createDataFrame([(1, ["a b c", "d e f"]), (2, ["d e f", "a b c"]), (3, ["a b"]), (4, []), (5, ["a b c", "b c d"]), (6, ["a b c"])], "k int, f array<string>")
    got = {r.k: r.g for r in rows.select("k", merging.grounded(F.col("f"), F.lit("x a b c d e f")).alias("g")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}
