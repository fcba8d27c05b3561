"""A registered analysis of two conditions: endpoints by level, bounds for what isn't scored, and one resampling for all of them.

cells: question_id, level, condition, eligible, failed (technically), abstained, correctness (0, 1, 2 or null), rate (of met
criteria, or null) and passed (all criteria, or null), one row for each question, level and condition.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.running import running_total
from lodestone.operators.stats import holm
from lodestone.sources.shared import written

try:  # Python's own, twice as fast on short inputs as the library's
    from _md5 import md5
except ImportError:
    from hashlib import md5

# How much worse than the control still counts as not inferior, and the level of the two tests.
DELTA, ALPHA = 0.05, 0.05
#: Questions (65,536 at most) and draws that meet in one task.
BLOCK, DRAWS = 1 << 16, 100
WORST, BEST = "worst_case", "best_case"


def strict() -> Column:
    """1 for a right answer, 0 for another and for none, null where an answer isn't scored."""
    return F.when(F.col("failed") | F.col("abstained"), 0).when(F.col("correctness").isNotNull(), (F.col("correctness") == 2).cast("int"))


def contrasts(cells: DataFrame, treatment: str, control: str) -> DataFrame:
    """(question_id, level, t, c): each question's two cells of a level, as structs; null for a cell that isn't there. A repeated cell fails the job."""
    cell = F.struct("eligible", "failed", "abstained", "rate", strict().alias("strict"))
    side = lambda x: (F.max(F.when(F.col("condition") == x, cell)), F.count_if(F.col("condition") == x))
    (t, n_t), (c, n_c) = side(treatment), side(control)
    rows = cells.groupBy("question_id", "level").agg(t.alias("t"), c.alias("c"), F.greatest(n_t, n_c).alias("n"))
    say = F.concat(F.lit("CELLS: twice: "), F.to_json(F.struct("question_id", "level")))
    unlike = F.concat(F.lit("CELLS: eligibility varies: "), F.to_json(F.struct("question_id", "level")))
    wrong = F.when(F.col("n") > 1, say).when(F.col("t.eligible") != F.col("c.eligible"), unlike)
    return rows.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(True)).drop("n")


def endpoint_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with kind: incomplete, ineligible, excluded (a side gave no answer), unscored or scored, and diff of the scored ones."""
    kind = (
        F.when(F.col("t").isNull() | F.col("c").isNull(), "incomplete")
        .when(~F.col("t.eligible"), "ineligible")
        .when(F.col("t.failed") | F.col("t.abstained") | F.col("c.failed") | F.col("c.abstained"), "excluded")
        .when(F.col("t.rate").isNull() | F.col("c.rate").isNull(), "unscored")
        .otherwise("scored")
    )
    return pairs.select("*", kind.alias("kind")).withColumn("diff", F.when(F.col("kind") == "scored", F.col("t.rate") - F.col("c.rate")))


def clusters(pairs: DataFrame, levels: list[str]) -> DataFrame:
    """(question_id, endpoint, total, size): what each question adds to the levels' endpoints and to both bounds of correctness."""
    scored = endpoint_pairs(pairs).where((F.col("kind") == "scored") & F.col("level").isin(*levels)).select("question_id", F.col("level").alias("endpoint"), "diff")
    t, c = F.col("t.strict"), F.col("c.strict")
    whole = pairs.where(F.col("t").isNotNull() & F.col("c").isNotNull())
    low = F.coalesce(t, F.lit(0)) - F.coalesce(c, F.lit(1))
    high = F.coalesce(t, F.lit(1)) - F.coalesce(c, F.lit(0))
    bounds = whole.select("question_id", F.explode(F.array(F.struct(F.lit(WORST).alias("e"), low.alias("d")), F.struct(F.lit(BEST).alias("e"), high.alias("d")))).alias("x"))
    values = scored.unionByName(bounds.select("question_id", F.col("x.e").alias("endpoint"), F.col("x.d").cast("double").alias("diff")))
    return values.groupBy("question_id", "endpoint").agg(F.sum("diff").alias("total"), F.count("*").alias("size"))


def slots_of(units: Iterator[pa.RecordBatch], n: int, draws: int, step: int, seed: str) -> Iterator[pa.RecordBatch]:
    """(block, draws, draw, picks) of units: what the slots of a unit draw, as 16-bit places in blocks of questions."""
    groups, blocks = -(-draws // DRAWS), -(-n // BLOCK)
    for batch in units:
        for unit in batch.column(0).to_pylist():
            slot, group = divmod(unit, groups)
            slots = [b"|%d" % s for s in range(slot * step, min(n, (slot + 1) * step))]
            out: dict[str, list] = {"block": [], "draws": [], "draw": [], "picks": []}
            for d in range(group * DRAWS, min(draws, (group + 1) * DRAWS)):
                head = f"{seed}|{d}".encode()
                hashes = np.frombuffer(b"".join([md5(head + s).digest() for s in slots]), ">u4")[::4]
                picks = np.sort(hashes.astype(np.int64) % n)
                ends = np.searchsorted(picks, np.arange(1, blocks + 1) * BLOCK)
                places = (picks % BLOCK).astype("<u2")
                for block, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                    if a < b:
                        for name, x in zip(out, (block, group, d, places[a:b].tobytes())):
                            out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=SLOTS)


SLOTS = pa.schema([("block", pa.int64()), ("draws", pa.int64()), ("draw", pa.int32()), ("picks", pa.binary())])


def drawn_sums(parts: DataFrame, questions: DataFrame, keys: list[str], values: list[str], draws: int, seed: str) -> DataFrame:
    """(draw, keys, values, times) of parts (question_id, keys, values): sums over each draw's questions, as often as it takes them.

    Each draw takes as many questions as there are, with replacement. Questions are numbered by ranges; a draw's slots go, two
    bytes each, to the block of BLOCK questions that a hash gives them, where they are counted and meet the block's parts. times is how
    often a draw has taken parts of a key; keys that it hasn't met have no row. A null question is drawn, but has no parts.
    """
    spark = parts.sparkSession
    row = F.struct(*keys, *[F.col(v).cast("double").alias(v) for v in values])
    own = parts.where("question_id IS NOT NULL").select("question_id", row.alias("part"))
    every = own.unionByName(questions.select("question_id").distinct().select("question_id", F.lit(None).cast(own.schema["part"].dataType).alias("part")))
    whole = every.groupBy("question_id").agg(F.collect_list("part").alias("parts"))
    numbered = written(running_total(whole, [], [F.col("question_id").isNull(), F.col("question_id")], None, "place").select((F.col("place") - 1).alias("pick"), "parts"))
    n = numbered.count()
    groups, step = -(-draws // DRAWS), min(1 << 15, max(1 << 10, n // 16))
    units = -(-n // step) * groups
    slots = spark.range(0, units, 1, max(1, min(units, 1 << 10))).mapInArrow(lambda it: slots_of(it, n, draws, step, seed), "block long, draws long, draw int, picks binary")
    flat = numbered.select((F.col("pick") / BLOCK).cast("long").alias("block"), (F.col("pick") % BLOCK).alias("at"), F.explode("parts").alias("part"))
    flat = flat.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("draws"), "at", "part.*")

    def met(key: tuple, hits: pa.Table, own: pa.Table) -> pa.Table:
        places = own["at"].to_numpy()
        codes: dict[tuple, int] = {}
        code = np.array([codes.setdefault(k, len(codes)) for k in zip(*[own[k].to_pylist() for k in keys])], np.int64)
        numbers = [own[v].fill_null(0).to_numpy() for v in values]
        taken: dict[int, list[bytes]] = defaultdict(list)
        for d, picks in zip(hits["draw"].to_pylist(), hits["picks"].to_pylist()):
            taken[d].append(picks)
        out: list[list] = [[] for _ in own.column_names[3:]] + [[], []]
        for d, picks in taken.items() if codes else ():
            times = np.bincount(np.frombuffer(b"".join(picks), "<u2"), minlength=BLOCK)[places]
            on = np.flatnonzero(times)
            per = lambda x: np.bincount(code[on], x, len(codes))
            sums, count = [per(times[on] * v[on]) for v in numbers], per(times[on])
            for k, i in codes.items():
                if count[i]:
                    for column, x in zip(out, (*k, *[s[i] for s in sums], d, int(count[i]))):
                        column.append(x)
        fields = [own.schema.field(c) for c in own.column_names[3:]] + [pa.field("draw", pa.int32()), pa.field("times", pa.int64())]
        return pa.table([pa.array(x, f.type) for x, f in zip(out, fields)], names=[f.name for f in fields])

    schema = T.StructType([*flat.schema.fields[3:], T.StructField("draw", T.IntegerType()), T.StructField("times", T.LongType())])
    by = ["block", "draws"]
    found = slots.groupBy(*by).cogroup(flat.groupBy(*by)).applyInArrow(met, schema)
    return found.groupBy("draw", *keys).agg(*[F.sum(c).alias(c) for c in (*values, "times")])


def resampled(parts: DataFrame, questions: DataFrame, draws: int, seed: str) -> DataFrame:
    """(endpoint, draw, mean) of clusters (question_id, endpoint, total, size): one set of draws serves all endpoints."""
    met = drawn_sums(parts, questions, ["endpoint"], ["total", "size"], draws, seed)
    return met.select("endpoint", "draw", (F.col("total") / F.col("size")).alias("mean"))


def interval_of(means: DataFrame, est: DataFrame) -> DataFrame:
    """(endpoint, low, high, p) of draws (endpoint, draw, mean) around estimates (endpoint, estimate): the middle 95 % and a two-sided p of centred draws."""
    met = means.join(F.broadcast(est.select("endpoint", "estimate")), "endpoint")
    far = F.abs(F.round(F.col("mean") - F.col("estimate"), 12)) >= F.abs(F.round("estimate", 12))
    return met.groupBy("endpoint").agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), ((F.count_if(far) + 1) / (F.count("*") + 1)).alias("p"))


def paired_contrasts(values: DataFrame, arms: list[tuple[str, str]], *, draws: int = 2000, seed: str = "contrasts") -> DataFrame:
    """One row for each pair of arms (contrast): pairs, missing, not_applicable, estimate, low, high, p and Holm's p over all of them.

    values: question_id, arm, value, one each. A question with the value of one arm of a pair is missing there, one with neither isn't
    applicable. All contrasts go through one resampling of questions; one of fewer than two pairs has no estimate.
    """
    names = sorted({x for pair in arms for x in pair})
    wide = values.groupBy("question_id").agg(*[F.max(F.when(F.col("arm") == x, F.col("value"))).alias(f"v{i}") for i, x in enumerate(names)])
    of = lambda x: F.col(f"v{names.index(x)}")
    row = lambda a, b: F.struct(F.lit(f"{a} - {b}").alias("endpoint"), (of(a) - of(b)).alias("diff"), (of(a).isNull() != of(b).isNull()).alias("missing"), (of(a).isNull() & of(b).isNull()).alias("none"))
    each = wide.select("question_id", F.explode(F.array(*[row(a, b) for a, b in arms])).alias("x")).select("question_id", "x.*")
    counts = each.groupBy("endpoint").agg(F.count("diff").alias("pairs"), F.count_if("missing").alias("missing"), F.count_if("none").alias("not_applicable"), F.avg("diff").alias("estimate"))
    counts = counts.withColumn("estimate", F.when(F.col("pairs") >= 2, F.col("estimate")))
    parts = each.where("diff IS NOT NULL").select("question_id", "endpoint", F.col("diff").alias("total"), F.lit(1).alias("size"))
    by = interval_of(resampled(parts, values, draws, seed), counts.where("estimate IS NOT NULL"))
    rows = written(counts.join(by, "endpoint", "left"))  # a row for each pair of arms, which Holm's p would make twice
    tests = holm(rows.select("endpoint", F.coalesce("p", F.lit(1.0)).alias("p")), "endpoint", "p").select("endpoint", "adjusted")
    out = rows.join(tests, "endpoint").withColumn("holm_p", F.when(F.col("p").isNotNull(), F.col("adjusted")))
    return out.select(F.col("endpoint").alias("contrast"), "pairs", "missing", "not_applicable", "estimate", "low", "high", "p", "holm_p")


def weighted_kappa_interval(ratings: DataFrame, levels: int, *, draws: int = 1000, seed: str = "kappa") -> DataFrame:
    """(n, agreement, kappa, low, high) of ratings (question_id, a, b) from 1 to levels, with linear weights; questions are resampled whole.

    Each draw is a confusion matrix of resampled counts. Draws in which chance agrees fully have no kappa and aren't counted.
    """
    cells = ratings.where("a IS NOT NULL AND b IS NOT NULL").groupBy("question_id", "a", "b").agg(F.count("*").alias("m"))
    drawn = drawn_sums(cells, ratings, ["a", "b"], ["m"], draws, seed).select("draw", "a", "b", F.col("m").cast("long").alias("m"))
    every = cells.groupBy("a", "b").agg(F.sum("m").alias("m")).select(F.lit(-1).alias("draw"), "a", "b", "m")
    both = written(drawn.unionByName(every))  # a row for each draw and cell of the matrix
    top = float(levels - 1)
    total = both.groupBy("draw").agg(F.sum("m").alias("n"), F.sum(F.col("m") * (1 - F.abs(F.col("a") - F.col("b")) / top)).alias("same"))
    side = lambda c: both.groupBy("draw", F.col(c).alias("level")).agg(F.sum("m").alias("k"))
    left, right = side("a").select("draw", F.col("level").alias("x"), F.col("k").alias("kx")), side("b").select("draw", F.col("level").alias("y"), F.col("k").alias("ky"))
    chance = left.join(right, "draw").groupBy("draw").agg(F.sum(F.col("kx") * F.col("ky") * (1 - F.abs(F.col("x") - F.col("y")) / top)).alias("chance"))
    p, e = F.col("same") / F.col("n"), F.col("chance") / F.col("n") / F.col("n")
    rows = total.join(chance, "draw").select("draw", "n", p.alias("agreement"), F.when(e < 1, (p - e) / F.nullif(1 - e, F.lit(0.0))).alias("kappa"))
    own = lambda c: F.max(F.when(F.col("draw") == -1, F.col(c))).alias(c)
    of = F.when(F.col("draw") >= 0, F.col("kappa"))
    return rows.agg(own("n"), own("agreement"), own("kappa"), F.percentile(of, 0.025).alias("low"), F.percentile(of, 0.975).alias("high"))


def analysis(cells: DataFrame, *, treatment: str, control: str, levels: list[str], draws: int = 2000, seed: str = "registered", floors: dict[str, float] | None = None) -> DataFrame:
    """One row for each level's endpoint and for the worst and best case of correctness: estimate, interval, p, Holm's p and what follows.

    An endpoint is the mean difference of rates over complete pairs of eligible cells; pairs where a side gave no answer are
    excluded, pairs without a score are counted. Correctness is bounded: an answer without a score counts against the
    treatment in the worst case and for it in the best. p is two-sided, of draws centred on the estimate; Holm's p goes over
    the levels' endpoints alone. supported: a significant difference above its noise floor for a level (positive or
    negative), or an interval above -DELTA for both bounds. An endpoint of fewer than two questions has no estimate.
    """
    pairs = contrasts(cells, treatment, control)
    parts = written(clusters(pairs, levels))
    est = parts.groupBy("endpoint").agg((F.sum("total") / F.sum("size")).alias("estimate"), F.count("*").alias("questions"), F.sum("size").alias("pairs")).where("questions >= 2")
    by = interval_of(resampled(parts, cells, draws, seed), est)
    spark = cells.sparkSession
    frame = spark.createDataFrame([(x, (floors or {}).get(x)) for x in (*levels, WORST, BEST)], "endpoint string, floor double")
    kinds = endpoint_pairs(pairs).where(F.col("level").isin(*levels)).groupBy(F.col("level").alias("endpoint"))
    count = lambda *k: F.count_if(F.col("kind").isin(*k))
    counted = kinds.agg(count("excluded", "unscored", "scored").alias("expected"), count("excluded").alias("excluded"), count("unscored", "incomplete").alias("unscored"))
    open_ = pairs.where(F.col("t").isNotNull() & F.col("c").isNotNull()).agg(F.count_if(F.col("t.strict").isNull() | F.col("c.strict").isNull()).alias("open"))
    rows = frame.join(est, "endpoint", "left").join(by, "endpoint", "left").join(counted, "endpoint", "left").join(F.broadcast(open_))
    bound = F.col("endpoint").isin(WORST, BEST)
    rows = rows.withColumn("p", F.when(~bound, F.col("p"))).withColumn("unscored", F.when(bound, F.col("open")).otherwise(F.col("unscored"))).drop("open")
    rows = written(rows)  # a row for each endpoint, which Holm's p would make twice
    tests = holm(rows.where(~bound).select("endpoint", F.coalesce("p", F.lit(1.0)).alias("p")), "endpoint", "p").select("endpoint", "adjusted")
    out = rows.join(tests, "endpoint", "left").withColumn("holm_p", F.when(F.col("p").isNotNull(), F.col("adjusted"))).drop("adjusted")
    surely = (F.col("holm_p") <= ALPHA) & F.col("floor").isNotNull() & (F.abs("estimate") > F.col("floor"))
    both = F.min(F.when(bound, F.coalesce(F.col("low") > -DELTA, F.lit(False)))).over(Window.partitionBy())  # one row for each endpoint
    verdict = F.when(bound, F.when(both, "not_inferior").otherwise("open")).when(surely & (F.col("estimate") > 0), "positive").when(surely & (F.col("estimate") < 0), "negative").otherwise("open")
    return out.select("endpoint", "questions", "pairs", "expected", "excluded", "unscored", "estimate", "low", "high", "p", "holm_p", "floor", verdict.alias("verdict"))


def coverage(cells: DataFrame) -> DataFrame:
    """By condition: cells, failures, abstentions, answers, and the bounds of strict correctness and of being correct and adapted.

    An answer without a score may be right or wrong, and one whose criteria aren't judged may have passed; non-answers are neither.
    """
    s, none = strict(), F.col("failed") | F.col("abstained")
    joint_low = F.coalesce((s == 1) & F.col("passed"), F.lit(False)) & ~none
    joint_high = F.coalesce(s == 1, F.lit(True)) & F.coalesce(F.col("passed"), F.lit(True)) & ~none
    n = F.count_if
    rows = cells.groupBy("condition").agg(
        F.count("*").alias("cells"), n("failed").alias("failures"), n("abstained").alias("abstentions"), n(~none).alias("answered"), n(~none & s.isNull()).alias("unscored"), n(s == 1).alias("correct"),
        n(joint_low).alias("joint_low"), n(joint_high).alias("joint_high"), n("eligible").alias("eligible"), n(F.col("eligible") & joint_low).alias("eligible_low"), n(F.col("eligible") & joint_high).alias("eligible_high"),
    )
    share = lambda a, b: F.try_divide(a, b)
    correct, most = F.col("correct"), F.col("correct") + F.col("unscored")
    return rows.select("*", share(correct, F.col("cells")).alias("strict_low"), share(most, F.col("cells")).alias("strict_high"), share(correct, F.col("answered")).alias("answered_low"), share(most, F.col("answered")).alias("answered_high"), share(F.col("eligible_low"), F.col("eligible")).alias("adapted_low"), share(F.col("eligible_high"), F.col("eligible")).alias("adapted_high"))
