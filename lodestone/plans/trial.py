"""Queries of a registered analysis. Parts stand for questions, each with three levels under two conditions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import registered
from lodestone.registry import query, table

LEVELS = ("beginner", "intermediate", "advanced")
_CELLS = """x AS (SELECT p_partkey AS q, p_size, l, c, p_partkey * 7 + l * 3 + c * 5 + p_size AS z FROM part, range(3) a(l), range(2) b(c)),
cells AS (SELECT q, ['beginner', 'intermediate', 'advanced'][l + 1] AS level, c, q % 5 <> l AS eligible, (q + l * c) % 19 = 0 AS failed, (q + l * c) % 19 <> 0 AND (q + c) % 23 = 0 AS abstained,
 CASE WHEN z % 4 < 3 THEN z % 4 END AS correctness, CASE WHEN z % 11 <> 0 THEN CASE WHEN l = 0 AND c = 1 THEN least((z % 5) + 1, 4) ELSE z % 5 END / 4 END AS rate FROM x),
s AS (SELECT *, rate = 1 AS passed, CASE WHEN failed OR abstained THEN 0 WHEN correctness IS NOT NULL THEN (correctness = 2)::INT END AS strict FROM cells)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("q"), "p_size", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("l")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("c"))
    q, level, c = F.col("q"), F.col("l"), F.col("c")
    z = q * 7 + level * 3 + c * 5 + F.col("p_size")
    failed = (q + level * c) % 19 == 0
    quarter = F.when((level == 0) & (c == 1), F.least(z % 5 + 1, F.lit(4))).otherwise(z % 5)
    rate = F.when(z % 11 != 0, quarter / 4)
    return rows.select(q.alias("question_id"), F.element_at(F.array(*map(F.lit, LEVELS)), level + 1).alias("level"), F.when(c == 1, "treatment").otherwise("control").alias("condition"), (q % 5 != level).alias("eligible"), failed.alias("failed"), (~failed & ((q + c) % 23 == 0)).alias("abstained"), F.when(z % 4 < 3, z % 4).alias("correctness"), rate.alias("rate"), (rate == 1).alias("passed"))


@query(f"""WITH {_CELLS}, t AS (SELECT a.q, a.level, a.eligible, a.rate AS tr, b.rate AS cr, a.strict AS ts, b.strict AS cs, a.failed OR a.abstained OR b.failed OR b.abstained AS none FROM s a JOIN s b ON a.q = b.q AND a.level = b.level AND a.c = 1 AND b.c = 0),
k AS (SELECT *, CASE WHEN NOT eligible THEN 'ineligible' WHEN none THEN 'excluded' WHEN tr IS NULL OR cr IS NULL THEN 'unscored' ELSE 'scored' END AS kind FROM t),
v AS (SELECT q, level AS e, tr - cr AS d FROM k WHERE kind = 'scored' AND level <> 'intermediate' UNION ALL SELECT q, 'worst_case', coalesce(ts, 0) - coalesce(cs, 1) FROM t UNION ALL SELECT q, 'best_case', coalesce(ts, 1) - coalesce(cs, 0) FROM t),
p AS (SELECT q, e, sum(d) AS total, count(*) AS size FROM v GROUP BY ALL), est AS (SELECT e, sum(total) / sum(size) AS estimate, count(*) AS questions, sum(size)::BIGINT AS pairs FROM p GROUP BY 1),
n AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS pick, count(*) OVER () AS n FROM (SELECT DISTINCT q FROM cells)),
h AS (SELECT draw, ('0x' || substr(md5('trial|' || draw || '|' || pick), 1, 8))::BIGINT % n AS pick, count(*) AS times FROM n, range(200) d(draw) GROUP BY ALL),
m AS (SELECT e, draw, sum(times * total) / sum(times * size) AS mean FROM h JOIN n ON n.pick = h.pick JOIN p ON p.q = n.q GROUP BY ALL),
b AS (SELECT m.e, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, (1 + count(*) FILTER (WHERE abs(round(mean - estimate, 12)) >= abs(round(estimate, 12)))) / (count(*) + 1) AS p FROM m JOIN est ON est.e = m.e GROUP BY m.e),
w AS (SELECT level AS e, count(*) FILTER (WHERE kind <> 'ineligible')::BIGINT AS expected, count(*) FILTER (WHERE kind = 'excluded')::BIGINT AS excluded, count(*) FILTER (WHERE kind = 'unscored')::BIGINT AS unscored FROM k GROUP BY 1),
o AS (SELECT count(*) FILTER (WHERE ts IS NULL OR cs IS NULL)::BIGINT AS open FROM t),
r AS (SELECT est.*, low, high, CASE WHEN est.e NOT LIKE '%case' THEN p END AS p, expected, excluded, CASE WHEN est.e LIKE '%case' THEN (SELECT open FROM o) ELSE unscored END AS unscored, CASE est.e WHEN 'beginner' THEN 0.02 WHEN 'advanced' THEN 0.03 END AS floor FROM est JOIN b ON b.e = est.e LEFT JOIN w ON w.e = est.e),
a AS (SELECT *, row_number() OVER (PARTITION BY p IS NULL ORDER BY p, e) AS i FROM r), j AS (SELECT *, CASE WHEN p IS NOT NULL THEN max(least(1.0, (3 - i) * p)) OVER (PARTITION BY p IS NULL ORDER BY p, e) END AS holm_p, min(CASE WHEN e LIKE '%case' THEN (low > -0.05)::INT END) OVER () AS bound_ok FROM a)
SELECT e AS endpoint, questions, pairs, expected, excluded, unscored, round(estimate, 8) AS estimate, round(low, 8) AS low, round(high, 8) AS high, round(p, 8) AS p, round(holm_p, 8) AS holm_p,
CASE WHEN e LIKE '%case' THEN CASE WHEN bound_ok = 1 THEN 'not_inferior' ELSE 'open' END WHEN holm_p <= 0.05 AND abs(estimate) > floor AND estimate > 0 THEN 'positive' WHEN holm_p <= 0.05 AND abs(estimate) > floor AND estimate < 0 THEN 'negative' ELSE 'open' END AS verdict FROM j""")
def q7_registered_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two endpoints and both bounds of correctness, through one resampling of questions: estimates, intervals, p values and verdicts."""
    found = registered.analysis(cells(spark, sf_dir), treatment="treatment", control="control", levels=["beginner", "advanced"], draws=200, seed="trial", floors={"beginner": 0.02, "advanced": 0.03})
    return found.select("endpoint", "questions", "pairs", "expected", "excluded", "unscored", *[F.round(c, 8).alias(c) for c in ("estimate", "low", "high", "p", "holm_p")], "verdict")


@query(f"""WITH {_CELLS}, j AS (SELECT *, NOT failed AND NOT abstained AS answer FROM s),
g AS (SELECT CASE WHEN c = 1 THEN 'treatment' ELSE 'control' END AS condition, count(*)::BIGINT AS cells, count(*) FILTER (WHERE failed)::BIGINT AS failures, count(*) FILTER (WHERE abstained)::BIGINT AS abstentions, count(*) FILTER (WHERE answer)::BIGINT AS answered, count(*) FILTER (WHERE answer AND strict IS NULL)::BIGINT AS unscored, count(*) FILTER (WHERE strict = 1)::BIGINT AS correct,
 count(*) FILTER (WHERE answer AND strict = 1 AND passed)::BIGINT AS joint_low, count(*) FILTER (WHERE answer AND coalesce(strict = 1, true) AND coalesce(passed, true))::BIGINT AS joint_high, count(*) FILTER (WHERE eligible)::BIGINT AS eligible,
 count(*) FILTER (WHERE eligible AND answer AND strict = 1 AND passed)::BIGINT AS eligible_low, count(*) FILTER (WHERE eligible AND answer AND coalesce(strict = 1, true) AND coalesce(passed, true))::BIGINT AS eligible_high FROM j GROUP BY 1)
SELECT *, correct / cells AS strict_low, (correct + unscored) / cells AS strict_high, correct / answered AS answered_low, (correct + unscored) / answered AS answered_high, eligible_low / eligible AS adapted_low, eligible_high / eligible AS adapted_high FROM g""")
def q7_m36_coverage_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By condition, how many cells were answered and scored, and between what bounds correctness and adaptation lie."""
    return registered.coverage(cells(spark, sf_dir))


_ARMS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
_DRAWS = "n AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS pick, count(*) OVER () AS n FROM (SELECT DISTINCT q FROM c)), h AS (SELECT draw, ('0x' || substr(md5('{seed}|' || draw || '|' || pick), 1, 8))::BIGINT % n AS pick, count(*) AS times FROM n, range({draws}) d(draw) GROUP BY ALL)"


@query(f"""WITH c AS (SELECT o_custkey AS q, o_orderpriority AS arm, avg(o_totalprice) / 1000 AS v FROM orders GROUP BY ALL), k AS (SELECT DISTINCT q FROM c), p AS (SELECT unnest({list(_ARMS)}) AS arm),
e AS (SELECT k.q, p.arm || ' - 5-LOW' AS e, a.v - b.v AS d, (a.v IS NULL) <> (b.v IS NULL) AS miss, a.v IS NULL AND b.v IS NULL AS none FROM k CROSS JOIN p LEFT JOIN c a ON a.q = k.q AND a.arm = p.arm LEFT JOIN c b ON b.q = k.q AND b.arm = '5-LOW'),
s AS (SELECT e, count(d)::BIGINT AS pairs, count(*) FILTER (WHERE miss)::BIGINT AS missing, count(*) FILTER (WHERE none)::BIGINT AS not_applicable, avg(d) AS estimate FROM e GROUP BY 1), {_DRAWS.format(seed='arms', draws=100)},
m AS (SELECT e, draw, sum(times * d) / sum(times) AS mean FROM h JOIN n ON n.pick = h.pick JOIN e ON e.q = n.q WHERE d IS NOT NULL GROUP BY ALL),
b AS (SELECT m.e, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, (1 + count(*) FILTER (WHERE abs(round(mean - estimate, 12)) >= abs(round(estimate, 12)))) / (count(*) + 1) AS p FROM m JOIN s ON s.e = m.e GROUP BY m.e),
r AS (SELECT s.*, low, high, p, row_number() OVER (ORDER BY p, s.e) AS i FROM s JOIN b ON b.e = s.e)
SELECT e AS contrast, pairs, missing, not_applicable, round(estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high, round(p, 8) AS p, round(max(least(1.0, (5 - i) * p)) OVER (ORDER BY p, e), 8) AS holm_p FROM r""")
def q4_all_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pairs of arms at once: complete, missing and not applicable pairs, differences with intervals, p values and Holm's."""
    values = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("question_id"), F.col("o_orderpriority").alias("arm")).agg((F.avg("o_totalprice") / 1000).alias("value"))
    found = registered.paired_contrasts(values, [(a, "5-LOW") for a in _ARMS], draws=100, seed="arms")
    return found.select("contrast", "pairs", "missing", "not_applicable", *[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")], F.round("p", 8).alias("p"), F.round("holm_p", 8).alias("holm_p"))


@query(f"""WITH c AS (SELECT o_custkey AS q, (o_orderkey % 3 + 1)::INT AS a, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_totalprice > 180000 THEN (o_custkey % 3 + 1)::INT ELSE (o_orderkey % 3 + 1)::INT END AS b FROM orders), {_DRAWS.format(seed='kappa', draws=100)},
x AS (SELECT draw, a, b, sum(times) AS m FROM h JOIN n ON n.pick = h.pick JOIN c ON c.q = n.q WHERE b IS NOT NULL GROUP BY ALL UNION ALL SELECT -1, a, b, count(*) FROM c WHERE b IS NOT NULL GROUP BY ALL),
t AS (SELECT draw, sum(m) AS n, sum(m * (1 - abs(a - b) / 2)) AS same FROM x GROUP BY 1), l AS (SELECT draw, a, sum(m) AS k FROM x GROUP BY ALL), r AS (SELECT draw, b, sum(m) AS k FROM x GROUP BY ALL),
e AS (SELECT l.draw, sum(l.k * r.k * (1 - abs(a - b) / 2)) AS chance FROM l JOIN r ON r.draw = l.draw GROUP BY 1), k AS (SELECT t.draw, n, same / n AS p, (same / n - chance / n / n) / (1 - chance / n / n) AS kappa FROM t JOIN e ON e.draw = t.draw)
SELECT max(n) FILTER (WHERE draw = -1)::BIGINT AS n, round(max(p) FILTER (WHERE draw = -1), 8) AS agreement, round(max(kappa) FILTER (WHERE draw = -1), 8) AS kappa, round(quantile_cont(kappa, 0.025) FILTER (WHERE draw >= 0), 8) AS low, round(quantile_cont(kappa, 0.975) FILTER (WHERE draw >= 0), 8) AS high FROM k""")
def q12_kappa_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linearly weighted kappa of two ratings with the interval of resampled clusters; customers are the clusters."""
    key = F.col("o_orderkey") % 3 + 1
    other = F.when(F.col("o_orderkey") % 7 == 0, None).when(F.col("o_totalprice") > 180000, F.col("o_custkey") % 3 + 1).otherwise(key)
    ratings = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), key.alias("a"), other.alias("b"))
    found = registered.weighted_kappa_interval(ratings, 3, draws=100, seed="kappa")
    return found.select("n", *[F.round(c, 8).alias(c) for c in ("agreement", "kappa", "low", "high")])
