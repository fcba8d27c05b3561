"""Queries of answers and their citations: validity, outcomes, coverage, abstention, criteria.

The tables hold no runs of a model: orders stand for runs, their lines for evidence that a run was sent, and for the
criteria by which an answer is judged.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.answers import abstention_scores, citation_checks, close_to, covered_paths, latest_valid, rate, rated, valid_json
from lodestone.registry import query, table

RUNS = """r AS (SELECT o_orderkey AS run_id, o_custkey, o_orderpriority AS arm, CASE o_orderstatus WHEN 'O' THEN 'answered' WHEN 'F' THEN 'abstained' ELSE ['retrieval_error', 'generation_error', 'parse_error'][(o_custkey % 3 + 1)::INT] END AS status,
CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS answerable, CASE WHEN o_orderkey % 11 <> 0 THEN substr(o_orderpriority, 1, 1) END AS gold,
CASE WHEN o_orderstatus = 'O' AND o_orderkey % 13 <> 0 THEN (floor(o_totalprice) % 5 + 1)::INT::VARCHAR END AS choice, (o_orderkey % 3)::INT AS calls,
CASE WHEN o_orderkey % 17 = 0 THEN 'not json' WHEN o_orderkey % 19 = 0 THEN '{"abstained": "no"}' ELSE '{"abstained":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || ',"citations":[' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '"E1","E2"' END || ']}' END AS raw,
CASE WHEN o_orderkey % 34 = 0 OR o_orderkey % 38 = 0 THEN '{"abstained":false,"citations":[]}' WHEN o_orderkey % 17 = 0 THEN 'still not' END AS repaired FROM orders)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    error = F.element_at(F.array(*map(F.lit, ("retrieval_error", "generation_error", "parse_error"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit('{"abstained":'), F.when(status == "F", "true").otherwise("false"), F.lit(',"citations":['), F.when(key % 4 == 0, "").otherwise('"E1","E2"'), F.lit("]}"))
    return table(spark, sf_dir, "orders").select(
        key.alias("run_id"),
        "o_custkey",
        F.col("o_orderpriority").alias("arm"),
        F.when(status == "O", "answered").when(status == "F", "abstained").otherwise(error).alias("status"),
        F.when(key % 7 == 0, None).when(key % 7 == 1, False).otherwise(True).alias("answerable"),
        F.when(key % 11 != 0, F.substring("o_orderpriority", 1, 1)).alias("gold"),
        F.when((status == "O") & (key % 13 != 0), (F.floor("o_totalprice") % 5 + 1).cast("int").cast("string")).alias("choice"),
        (key % 3).cast("int").alias("calls"),
        F.when(key % 17 == 0, "not json").when(key % 19 == 0, '{"abstained": "no"}').otherwise(text).alias("raw"),
        F.when((key % 34 == 0) | (key % 38 == 0), '{"abstained":false,"citations":[]}').when(key % 17 == 0, "still not").alias("repaired"),
    )


def _valid(c: str) -> str:
    return f"(json_valid({c}) AND coalesce(json_type(CASE WHEN json_valid({c}) THEN {c} END, '$.abstained') = 'BOOLEAN' AND json_type(CASE WHEN json_valid({c}) THEN {c} END, '$.citations') = 'ARRAY', false))"


def _missing(c: str) -> str:
    j = f"CASE WHEN json_valid({c}) THEN {c} END"
    return f"CASE WHEN json_valid({c}) THEN coalesce(json_extract_string({j}, '$.abstained') = 'false' AND json_type({j}, '$.abstained') = 'BOOLEAN', false) AND coalesce(json_array_length({j}, '$.citations'), 0) = 0 END"


@query(f"""WITH {RUNS} SELECT run_id, json_valid(raw) AS raw_json, {_valid('raw')} AS raw_schema, json_valid(repaired) AS repaired_json, CASE WHEN repaired IS NOT NULL THEN {_valid('repaired')} END AS repaired_schema,
coalesce({_missing('repaired')}, {_missing('raw')}, false) AS missing_citation, CASE WHEN {_valid('repaired')} THEN repaired WHEN {_valid('raw')} THEN raw END AS latest FROM r""")
def p28_p29_output_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether outputs are JSON and of the schema, whether a needed citation is missing, and the latest valid output. Null for no output."""
    raw, repaired = (valid_json(F.col(c)) for c in ("raw", "repaired"))
    return runs(spark, sf_dir).select(
        "run_id", raw["json"].alias("raw_json"), raw["schema"].alias("raw_schema"), repaired["json"].alias("repaired_json"), repaired["schema"].alias("repaired_schema"),
        F.coalesce(repaired["missing"], raw["missing"], F.lit(False)).alias("missing_citation"), latest_valid(F.col("repaired"), F.col("raw")).alias("latest"),
    )


OUTCOME = "CASE WHEN status = 'retrieval_error' THEN 'retrieval_failed' WHEN status = 'generation_error' THEN 'generation_failed' WHEN status = 'parse_error' THEN 'format_failed' WHEN status = 'abstained' THEN 'abstained' WHEN gold IS NULL THEN 'missing_gold' WHEN choice IS NULL THEN 'missing_prediction' WHEN choice = gold THEN 'correct' ELSE 'wrong' END"


def outcome() -> Column:
    """What became of a run: the first rule that holds."""
    status = F.col("status")
    return (
        F.when(status == "retrieval_error", "retrieval_failed")
        .when(status == "generation_error", "generation_failed")
        .when(status == "parse_error", "format_failed")
        .when(status == "abstained", "abstained")
        .when(F.col("gold").isNull(), "missing_gold")
        .when(F.col("choice").isNull(), "missing_prediction")
        .when(F.col("choice") == F.col("gold"), "correct")
        .otherwise("wrong")
    )


@query(f"""WITH {RUNS}, o AS (SELECT *, {OUTCOME} AS outcome FROM r)
SELECT run_id, outcome, array_to_string(list_sort(list_distinct(list_filter([CASE status WHEN 'retrieval_error' THEN 'retrieval_failure' WHEN 'generation_error' THEN 'generation_failure' WHEN 'parse_error' THEN 'invalid_output' END,
CASE WHEN outcome = 'wrong' THEN 'gold_missed' END, CASE WHEN outcome = 'wrong' THEN 'wrong_option' END, CASE WHEN answerable AND status = 'abstained' THEN 'gold_missed' END, CASE WHEN answerable AND status = 'abstained' THEN 'wrong_abstention' END,
CASE WHEN NOT answerable AND status = 'answered' THEN 'answered_when_unanswerable' END, CASE WHEN NOT {_valid('raw')} THEN 'invalid_output' END, CASE WHEN coalesce({_missing('repaired')}, {_missing('raw')}, false) THEN 'missing_citation' END, CASE WHEN answerable IS NULL THEN 'unresolved_answerability' END], lambda x: x IS NOT NULL))), ',') AS labels FROM o""")
def p32_p33_outcomes_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's outcome, and the set of what went wrong in it."""
    rows = runs(spark, sf_dir).withColumn("outcome", outcome())
    raw, repaired = (valid_json(F.col(c)) for c in ("raw", "repaired"))
    status, answerable = F.col("status"), F.col("answerable")
    wrong, refused = F.col("outcome") == "wrong", answerable & (status == "abstained")
    found = [
        F.when(status == "retrieval_error", "retrieval_failure").when(status == "generation_error", "generation_failure").when(status == "parse_error", "invalid_output"),
        F.when(wrong | refused, "gold_missed"), F.when(wrong, "wrong_option"), F.when(refused, "wrong_abstention"), F.when(~answerable & (status == "answered"), "answered_when_unanswerable"),
        F.when(~raw["schema"], "invalid_output"), F.when(F.coalesce(repaired["missing"], raw["missing"], F.lit(False)), "missing_citation"), F.when(answerable.isNull(), "unresolved_answerability"),
    ]
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return rows.select("run_id", "outcome", F.array_join(labels, ",").alias("labels"))


LINES = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS n FROM lineitem),
e AS (SELECT l_orderkey AS run_id, n, 'c' || l_partkey AS chunk, CASE WHEN l_suppkey % 10 <> 0 THEN 's' || l_suppkey END AS source, l_returnflag AS path, l_tax = 0.08 AS unmapped FROM l),
c AS (SELECT DISTINCT l_orderkey AS run_id, CASE WHEN l_quantity >= 30 THEN 'E' || n WHEN l_quantity BETWEEN 10 AND 20 THEN 'c' || l_partkey WHEN l_discount = 0.05 THEN 'E99' END AS citation FROM l WHERE l_quantity >= 30 OR l_quantity BETWEEN 10 AND 20 OR l_discount = 0.05),
i AS (SELECT run_id, id, arg_max(chunk, n) AS chunk, arg_max(coalesce(source, ''), n) AS source FROM (SELECT *, 'E' || n AS id FROM e UNION ALL SELECT *, chunk FROM e) GROUP BY ALL),
k AS (SELECT c.run_id, citation, chunk, nullif(source, '') AS source, chunk IS NOT NULL AS belongs FROM c LEFT JOIN i ON i.run_id = c.run_id AND i.id = c.citation)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their number n in the order, as line numbers of the given tables come more than once."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("l_suppkey") % 10 != 0, F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("run_id"), "n", F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("chunk"), source.alias("source"), F.col("l_returnflag").alias("path"), (F.col("l_tax") == 0.08).alias("unmapped"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    cited = F.when(q >= 30, F.concat(F.lit("E"), F.col("n").cast("string"))).when(q.between(10, 20), F.concat(F.lit("c"), F.col("l_partkey").cast("string"))).when(F.col("l_discount") == 0.05, "E99")
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("run_id"), cited.alias("citation")).where("citation is not null").distinct()


@query(f"WITH {LINES} SELECT run_id, citation, chunk, source, belongs, belongs AND source IS NOT NULL AS valid FROM k")
def m12_citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every citation, by number or by chunk, against the evidence that the run was sent."""
    return citation_checks(citations(spark, sf_dir), evidence(spark, sf_dir))


@query(f"""WITH {LINES}, s AS (SELECT e.run_id, path, n, unmapped, max(k.chunk IS NOT NULL) AS cited FROM e LEFT JOIN k ON k.run_id = e.run_id AND k.chunk = e.chunk GROUP BY ALL),
p AS (SELECT run_id, path, arg_min(CASE WHEN unmapped THEN 'missing' ELSE 'uncovered' END, n) FILTER (WHERE unmapped OR NOT cited) AS bad FROM s GROUP BY ALL)
SELECT run_id, CASE WHEN count(*) FILTER (WHERE bad IS NULL) > 0 THEN true WHEN count(*) FILTER (WHERE bad = 'missing') > 0 THEN NULL ELSE false END AS covered, count(*) FILTER (WHERE bad IS NULL) = 0 AND count(*) FILTER (WHERE bad = 'missing') > 0 AS mapping_missing FROM p GROUP BY 1""")
def m13_citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run's citations cover every span of one of its evidence paths; null where a span that decides it has no mapping."""
    checks = citation_checks(citations(spark, sf_dir), evidence(spark, sf_dir)).where("chunk is not null").select("run_id", "chunk").distinct().withColumn("cited", F.lit(True))
    return covered_paths(evidence(spark, sf_dir).join(checks, ["run_id", "chunk"], "left").withColumn("cited", F.coalesce("cited", F.lit(False))))


@query(f"""WITH {RUNS}, f AS (SELECT *, CASE WHEN status IN ('answered', 'abstained') AND answerable IS NOT NULL AND gold IS NOT NULL THEN status = 'answered' AND coalesce(choice = gold, false) END AS answer_correct,
CASE WHEN status = 'answered' AND answerable IS NOT NULL AND gold IS NOT NULL THEN coalesce(choice = gold, false) END AS answered_correct, CASE WHEN status IN ('answered', 'abstained') AND answerable IS NOT NULL THEN (status = 'abstained') = (NOT answerable) END AS abstention_correct FROM r),
m AS (SELECT arm, 'answer_correct' AS metric, answer_correct AS v FROM f UNION ALL SELECT arm, 'answered_correct', answered_correct FROM f UNION ALL SELECT arm, 'abstention_correct', abstention_correct FROM f)
SELECT arm, metric, count(*) FILTER (WHERE v)::BIGINT AS numerator, count(v)::BIGINT AS denominator, round(count(*) FILTER (WHERE v) / nullif(count(v), 0), 8) AS value, (count(*) - count(v))::BIGINT AS excluded FROM m GROUP BY GROUPING SETS ((arm, metric), (metric))""")
def m14_m20_score_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of three flags that may be undefined, by arm and in all."""
    rows = flagged(spark, sf_dir)
    long = rows.unpivot(["arm"], ["answer_correct", "answered_correct", "abstention_correct"], "metric", "v")
    n, d = F.count_if("v"), F.count("v")
    return long.groupingSets([["arm", "metric"], ["metric"]], "arm", "metric").agg(n.alias("numerator"), d.alias("denominator"), F.round(F.try_divide(n, d), 8).alias("value"), (F.count("*") - d).alias("excluded"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, answerable, gold = F.col("status"), F.col("answerable"), F.col("gold")
    right, known = F.coalesce(F.col("choice") == gold, F.lit(False)), answerable.isNotNull()
    done = status.isin("answered", "abstained")
    return runs(spark, sf_dir).select(
        "run_id", "arm", "status", "answerable", "calls",
        F.when(done & known & gold.isNotNull(), (status == "answered") & right).alias("answer_correct"),
        F.when((status == "answered") & known & gold.isNotNull(), right).alias("answered_correct"),
        F.when(done & known, (status == "abstained") == ~answerable).alias("abstention_correct"),
    )


@query(f"""WITH {RUNS}, f AS (SELECT *, status = 'abstained' AS said, NOT answerable AS due FROM r WHERE status IN ('answered', 'abstained') AND answerable IS NOT NULL),
l AS (SELECT 'system' AS level, said, due FROM f UNION ALL SELECT 'model', said, due FROM f WHERE calls > 0), c AS (SELECT level, count(*) FILTER (WHERE said AND due) AS tp, count(*) FILTER (WHERE said) AS p, count(*) FILTER (WHERE due) AS g FROM l GROUP BY 1)
SELECT level, tp::BIGINT AS hits, (p - tp)::BIGINT AS false_alarms, (g - tp)::BIGINT AS missed, round(tp / nullif(p, 0), 8) AS precision, round(tp / nullif(g, 0), 8) AS recall, round(2 * tp / nullif(p + g, 0), 8) AS f1 FROM c""")
def m16_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How right abstentions are: of the whole system, and of runs in which a model was asked."""
    known = flagged(spark, sf_dir).where("abstention_correct is not null").select((F.col("status") == "abstained").alias("said"), (~F.col("answerable")).alias("due"), "calls")
    both = known.withColumn("level", F.explode(F.when(F.col("calls") > 0, F.array(F.lit("system"), F.lit("model"))).otherwise(F.array(F.lit("system")))))
    return abstention_scores(both, "level")


@query(f"""WITH {RUNS}, o AS (SELECT {OUTCOME} AS outcome, calls FROM r), k AS (SELECT unnest(['correct', 'wrong', 'abstained', 'missing_gold', 'missing_prediction', 'retrieval_failed', 'generation_failed', 'format_failed', 'open_ended', 'not_applicable']) AS outcome)
SELECT k.outcome, count(calls)::BIGINT AS n, coalesce(sum(greatest(calls - 1, 0)), 0)::BIGINT AS retries FROM k LEFT JOIN o USING (outcome) GROUP BY 1""")
def m17_m19_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each outcome came, those that never came too, and how often runs were tried again."""
    names = ("correct", "wrong", "abstained", "missing_gold", "missing_prediction", "retrieval_failed", "generation_failed", "format_failed", "open_ended", "not_applicable")
    counts = runs(spark, sf_dir).groupBy(outcome().alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.greatest(F.col("calls") - 1, F.lit(0))).alias("retries"))
    kinds = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("outcome"))
    return kinds.join(counts, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("retries", F.lit(0)).alias("retries"))


@query(r"""WITH t AS (SELECT p_partkey, 'about ' || p_retailprice || ' m/s' AS answer, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 1.02 ELSE p_retailprice * 1.004 END AS expected, CASE WHEN p_partkey % 5 = 0 THEN 'm' ELSE 'm/s' END AS unit FROM part)
SELECT p_partkey, regexp_extract(answer, '([-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)\s*([A-Za-z/%]+)', 2) = unit AND abs(regexp_extract(answer, '([-+]?[0-9]+(?:\.[0-9]+)?)', 1)::DOUBLE - expected) <= greatest(0.01 * greatest(abs(regexp_extract(answer, '([-+]?[0-9]+(?:\.[0-9]+)?)', 1)::DOUBLE), abs(expected)), 0.001) AS accepted FROM t""")
def p30_numeric_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the number and unit in an answer are those expected, within a hundredth."""
    price, key = F.col("p_retailprice"), F.col("p_partkey")
    answer = F.concat(F.lit("about "), price.cast("string"), F.lit(" m/s"))
    expected = F.when(key % 3 == 0, price * 1.02).otherwise(price * 1.004)
    return table(spark, sf_dir, "part").select(key, close_to(answer, expected, F.when(key % 5 == 0, "m").otherwise("m/s"), relative=0.01, absolute=0.001).alias("accepted"))


CRITERIA = """v AS (SELECT l_orderkey AS run_id, o_orderpriority AS arm, 'I' || l_linenumber AS criterion, CASE WHEN l_quantity > 25 THEN 'pass' WHEN l_quantity > 10 THEN 'fail' ELSE 'not_applicable' END AS verdict FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
a AS (SELECT run_id, arm, count(*) FILTER (WHERE verdict = 'pass') AS passed, count(*) FILTER (WHERE verdict = 'fail') AS failed, count(*) FILTER (WHERE verdict = 'not_applicable') AS na, count(*) FILTER (WHERE verdict = 'pass') / nullif(count(*) FILTER (WHERE verdict <> 'not_applicable'), 0) AS rate FROM v GROUP BY ALL)"""


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    verdict = F.when(q > 25, "pass").when(q > 10, "fail").otherwise("not_applicable")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("I"), F.col("l_linenumber").cast("string")).alias("criterion"), verdict.alias("verdict"))
    return lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("arm")), "run_id")


@query(f"WITH {CRITERIA} SELECT run_id, passed::BIGINT AS passed, failed::BIGINT AS failed, na::BIGINT AS not_applicable, round(rate, 8) AS rate, rate >= 0.6 AS adapted FROM a")
def m26_p35_adaptation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer's criteria met, missed and not applicable, their rate, and whether it is high enough; null if none applies."""
    rows = rated(criteria(spark, sf_dir), ["run_id"])
    return rows.select("run_id", "passed", "failed", "not_applicable", F.round("rate", 8).alias("rate"), (F.col("rate") >= 0.6).alias("adapted"))


@query(f"WITH {CRITERIA}, m AS (SELECT arm, round(avg(rate), 8) AS mean_rate, count(rate)::BIGINT AS defined FROM a GROUP BY 1), n AS (SELECT arm, criterion, count(*) FILTER (WHERE verdict = 'pass')::BIGINT AS passed, count(*) FILTER (WHERE verdict = 'fail')::BIGINT AS failed, count(*) FILTER (WHERE verdict = 'not_applicable')::BIGINT AS not_applicable FROM v GROUP BY ALL) SELECT * FROM n JOIN m USING (arm)")
def m27_adaptation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By arm, the mean of answers' rates, and every criterion's verdicts."""
    rows = criteria(spark, sf_dir)
    means = rated(rows, ["run_id", "arm"]).groupBy("arm").agg(F.round(F.avg("rate"), 8).alias("mean_rate"), F.count("rate").alias("defined"))
    count = lambda v, name: F.count_if(F.col("verdict") == v).alias(name)
    return rows.groupBy("arm", "criterion").agg(count("pass", "passed"), count("fail", "failed"), count("not_applicable", "not_applicable")).join(means, "arm")


@query(f"""WITH {CRITERIA}, s AS (SELECT 'all' AS scope, * FROM v UNION ALL SELECT 'without_I3', * FROM v WHERE criterion <> 'I3'), p AS (SELECT scope, arm, run_id, count(*) FILTER (WHERE verdict = 'pass') / nullif(count(*) FILTER (WHERE verdict <> 'not_applicable'), 0) AS rate FROM s GROUP BY ALL)
SELECT scope, arm, count(*)::BIGINT AS answers, count(rate)::BIGINT AS defined, round(avg(rate), 8) AS mean_rate FROM p GROUP BY GROUPING SETS ((scope, arm), (scope))""")
def m37_p34_scope_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rates with and without one criterion, by arm and in all."""
    rows = criteria(spark, sf_dir)
    scopes = F.when(F.col("criterion") == "I3", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("without_I3")))
    per_run = rated(rows.withColumn("scope", F.explode(scopes)), ["scope", "arm", "run_id"])
    return per_run.groupingSets([["scope", "arm"], ["scope"]], "scope", "arm").agg(F.count("*").alias("answers"), F.count("rate").alias("defined"), F.round(F.avg("rate"), 8).alias("mean_rate"))


@query(f"""WITH {RUNS}, {CRITERIA}, j AS (SELECT r.arm, CASE WHEN status LIKE '%error' THEN 0 WHEN gold IS NULL OR answerable IS NULL THEN NULL ELSE (status = 'answered' AND coalesce(choice = gold, false))::INT END AS correct, CASE WHEN a.run_id IS NULL THEN NULL ELSE (rate >= 0.6)::INT END AS adapted FROM r LEFT JOIN a ON a.run_id = r.run_id)
SELECT arm, count(*)::BIGINT AS n, round(count(*) FILTER (WHERE correct = 1) / count(*), 8) AS correct_lower, round(count(*) FILTER (WHERE correct = 1 OR correct IS NULL) / count(*), 8) AS correct_upper,
round(count(*) FILTER (WHERE correct = 1 AND adapted = 1) / count(*), 8) AS joint_lower, round(count(*) FILTER (WHERE coalesce(correct, 1) = 1 AND coalesce(adapted, 1) = 1) / count(*), 8) AS joint_upper, count(adapted)::BIGINT AS judged FROM j GROUP BY GROUPING SETS ((arm), ())""")
def m31_m32_m35_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of runs that are correct, and that are correct and adapted: least and most, as what is undecided may turn out. A technical failure is no success."""
    marks = rated(criteria(spark, sf_dir), ["run_id"]).select("run_id", (F.col("rate") >= 0.6).cast("int").alias("adapted"))
    status, gold = F.col("status"), F.col("gold")
    correct = F.when(status.endswith("error"), 0).when(gold.isNull() | F.col("answerable").isNull(), None).otherwise(((status == "answered") & F.coalesce(F.col("choice") == gold, F.lit(False))).cast("int"))
    rows = runs(spark, sf_dir).withColumn("correct", correct).join(marks, "run_id", "left")
    c, a, n = F.col("correct"), F.col("adapted"), F.count("*")
    one = lambda x: F.coalesce(x, F.lit(1)) == 1
    share = lambda condition, name: F.round(F.count_if(condition) / n, 8).alias(name)
    return rows.groupingSets([["arm"], []], "arm").agg(n.alias("n"), share(c == 1, "correct_lower"), share(one(c), "correct_upper"), share((c == 1) & (a == 1), "joint_lower"), share(one(c) & one(a), "joint_upper"), F.count("adapted").alias("judged"))


@query(f"WITH {LINES}, q AS (SELECT k.run_id, citation, belongs, belongs AND source IS NOT NULL AS valid FROM k), b AS (SELECT run_id, count(*) FILTER (WHERE valid) / count(*) AS rate FROM q GROUP BY 1)"
       " SELECT (SELECT round(count(*) FILTER (WHERE valid) / count(*), 8) FROM q) AS citation_rate, round(avg(rate), 8) AS bundle_rate, count(*) FILTER (WHERE rate = 1)::BIGINT AS fully_supported, count(*)::BIGINT AS runs FROM b")
def m29_support_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support by single citations, and by the citations of each run together."""
    checks = citation_checks(citations(spark, sf_dir), evidence(spark, sf_dir))
    per_run = checks.groupBy("run_id").agg(F.count_if("valid").alias("good"), F.count("*").alias("all"))
    share = F.col("good") / F.col("all")
    return per_run.agg(F.round(F.sum("good") / F.sum("all"), 8).alias("citation_rate"), F.round(F.avg(share), 8).alias("bundle_rate"), F.count_if(share == 1).alias("fully_supported"), F.count("*").alias("runs"))


@query(f"""WITH {LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n) AS k, row_number() OVER (PARTITION BY run_id, chunk ORDER BY n) AS copy FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n) AS place FROM n WHERE copy = 1)
SELECT run_id, count(*)::BIGINT AS items, string_agg('[E' || place || '] ' || chunk || ' (' || coalesce(source, 'unknown') || ')', chr(10) ORDER BY place) AS context FROM f GROUP BY 1""")
def p40_d4_evidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of each run, each chunk at its first place, numbered and joined as a prompt shows it."""
    copy = F.row_number().over(Window.partitionBy("run_id", "chunk").orderBy("n"))
    first = evidence(spark, sf_dir).withColumn("copy", copy).where("copy = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("n")))
    item = F.concat(F.lit("[E"), F.col("place").cast("string"), F.lit("] "), "chunk", F.lit(" ("), F.coalesce("source", F.lit("unknown")), F.lit(")"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"]), "\n")
    return placed.groupBy("run_id").agg(F.count("*").alias("items"), told.alias("context"))


@query("""WITH g AS (SELECT l_orderkey AS run_id, count(DISTINCT l_linestatus) AS states, count(DISTINCT l_returnflag) AS flags, count(DISTINCT date_trunc('year', l_shipdate)) AS years FROM lineitem GROUP BY 1)
SELECT states = 1 AS one_state, flags = 1 AS one_flag, years = 1 AS one_year, count(*)::BIGINT AS runs FROM g GROUP BY ALL""")
def m8_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose parts all come from one version of each kind, and those whose parts don't."""
    per_run = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.countDistinct("l_linestatus") == 1).alias("one_state"), (F.countDistinct("l_returnflag") == 1).alias("one_flag"), (F.countDistinct(F.year("l_shipdate")) == 1).alias("one_year"))
    return per_run.groupBy("one_state", "one_flag", "one_year").agg(F.count("*").alias("runs"))


@query(f"""WITH {RUNS} SELECT arm, status, answerable, gold, count(*)::BIGINT AS runs, count(DISTINCT o_custkey)::BIGINT AS questions, round(avg(calls), 8) AS mean_calls, count(choice)::BIGINT AS choices FROM r GROUP BY ALL""")
def m10_m11_m21_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by all that identifies their group; nulls are groups of their own."""
    return runs(spark, sf_dir).groupBy("arm", "status", "answerable", "gold").agg(F.count("*").alias("runs"), F.countDistinct("o_custkey").alias("questions"), F.round(F.avg("calls"), 8).alias("mean_calls"), F.count("choice").alias("choices"))


@query("""WITH t AS (SELECT o_orderpriority AS arm, count(*) AS cells, count(DISTINCT o_custkey) AS questions FROM orders GROUP BY 1)
SELECT arm, cells::BIGINT AS cells, (cells * 3500)::BIGINT AS input_tokens, (cells * 700)::BIGINT AS output_tokens, (cells * 3500 * 0.15::DECIMAL(10,4) / 1000000 + cells * 700 * 0.6::DECIMAL(10,4) / 1000000)::DECIMAL(18,6)::VARCHAR AS cost FROM t""")
def m39_cost_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost of as many calls as there are cells, in decimals."""
    cells = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count("*").alias("cells"))
    money = lambda tokens, price: (F.col("cells") * tokens).cast("decimal(18,0)") * F.lit(price).cast("decimal(10,4)") / F.lit(1000000).cast("decimal(7,0)")
    return cells.select("arm", "cells", (F.col("cells") * 3500).alias("input_tokens"), (F.col("cells") * 700).alias("output_tokens"), (money(3500, "0.15") + money(700, "0.6")).cast("decimal(18,6)").cast("string").alias("cost"))


@query(f"""WITH {RUNS}, {LINES}, g AS (SELECT run_id, bool_or(unmapped) AS unmapped FROM e GROUP BY 1),
x AS (SELECT r.run_id, arm, CASE WHEN o_custkey % 23 = 0 THEN 'missing_gold' WHEN NOT answerable THEN 'unanswerable' WHEN answerable IS NULL THEN 'unresolved' WHEN g.run_id IS NULL THEN 'no_evidence' WHEN status = 'retrieval_error' THEN 'retrieval_error' WHEN unmapped THEN 'mapping_missing' ELSE 'included' END AS reason FROM r LEFT JOIN g ON g.run_id = r.run_id)
SELECT arm, reason, count(*)::BIGINT AS runs FROM x GROUP BY GROUPING SETS ((arm, reason), (reason))""")
def m7_exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why runs aren't scored: the first reason that holds, by arm and in all."""
    mapped = evidence(spark, sf_dir).groupBy("run_id").agg(F.bool_or("unmapped").alias("unmapped"))
    rows = runs(spark, sf_dir).join(mapped, "run_id", "left")
    answerable = F.col("answerable")
    reason = (
        F.when(F.col("o_custkey") % 23 == 0, "missing_gold")
        .when(~answerable, "unanswerable")
        .when(answerable.isNull(), "unresolved")
        .when(F.col("unmapped").isNull(), "no_evidence")
        .when(F.col("status") == "retrieval_error", "retrieval_error")
        .when(F.col("unmapped"), "mapping_missing")
        .otherwise("included")
    )
    return rows.withColumn("reason", reason).groupingSets([["arm", "reason"], ["reason"]], "arm", "reason").agg(F.count("*").alias("runs"))


@query(f"""WITH {LINES}, k2 AS (SELECT DISTINCT run_id, chunk FROM k WHERE chunk IS NOT NULL), s AS (SELECT e.run_id, path, avg((k2.chunk IS NOT NULL)::INT) AS share FROM e LEFT JOIN k2 ON k2.run_id = e.run_id AND k2.chunk = e.chunk GROUP BY ALL), b AS (SELECT run_id, max(share) AS recall FROM s GROUP BY 1),
n AS (SELECT run_id, count(*) AS cited, count(*) FILTER (WHERE chunk IS NULL) AS noise FROM k GROUP BY 1) SELECT b.run_id, round(recall, 8) AS recall, round((cited - noise) / cited, 8) AS precision, round(noise / cited, 8) AS context_noise, coalesce(cited, 0)::BIGINT AS returned FROM b LEFT JOIN n USING (run_id)""")
def m4_m5_best_path_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of spans cited of the best evidence path, and of citations that are evidence or noise; null where nothing is cited."""
    checks = citation_checks(citations(spark, sf_dir), evidence(spark, sf_dir))
    cited = checks.where("chunk is not null").select("run_id", "chunk").distinct().withColumn("cited", F.lit(1))
    paths = evidence(spark, sf_dir).join(cited, ["run_id", "chunk"], "left").groupBy("run_id", "path").agg(F.avg(F.coalesce("cited", F.lit(0))).alias("share"))
    best = paths.groupBy("run_id").agg(F.max("share").alias("recall"))
    sums = checks.groupBy("run_id").agg(F.count("*").alias("n"), F.count("chunk").alias("good"))
    rows = best.join(sums, "run_id", "left")
    return rows.select("run_id", F.round("recall", 8).alias("recall"), F.round(F.col("good") / F.col("n"), 8).alias("precision"), F.round((F.col("n") - F.col("good")) / F.col("n"), 8).alias("context_noise"), F.coalesce("n", F.lit(0)).alias("returned"))


@query("""WITH r AS (SELECT doc_id, count(quality) AS ratings, avg(quality) AS mean, min(quality) AS low, max(quality) AS high FROM labels GROUP BY 1)
SELECT lang, source, count(*)::BIGINT AS expected, count(r.doc_id)::BIGINT AS rated, (count(*) - count(r.doc_id))::BIGINT AS missing, round(avg(mean), 8) AS mean, min(low)::INT AS least, max(high)::INT AS most FROM documents LEFT JOIN r USING (doc_id) GROUP BY ALL""")
def m22_rating_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of each group of documents, with those that still lack one."""
    ratings = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.lit(1).alias("one"), F.avg("quality").alias("mean"), F.min("quality").alias("low"), F.max("quality").alias("high"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(ratings, "doc_id", "left")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("expected"), F.count("one").alias("rated"), F.count_if(F.col("one").isNull()).alias("missing"), F.round(F.avg("mean"), 8).alias("mean"), F.min("low").cast("int").alias("least"), F.max("high").cast("int").alias("most"))


@query("""WITH v AS (SELECT l_orderkey AS run_id, l_linestatus AS corpus, l_returnflag AS topics, o_orderstatus AS state, l_linenumber AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT CASE WHEN state = 'P' THEN 'NO_TOPIC_MAP' WHEN corpus <> state THEN 'CORPUS_VERSION_MISMATCH' WHEN topics = 'N' THEN 'TOPIC_REGISTRY_MISMATCH' ELSE 'VALID' END AS status, count(*)::BIGINT AS contexts FROM v GROUP BY 1""")
def w8_context_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts whose versions belong together, and the first thing that is wrong with others; a line's and an order's state stand for versions."""
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("state"))
    rows = table(spark, sf_dir, "lineitem").join(state, "l_orderkey")
    status = F.when(F.col("state") == "P", "NO_TOPIC_MAP").when(F.col("l_linestatus") != F.col("state"), "CORPUS_VERSION_MISMATCH").when(F.col("l_returnflag") == "N", "TOPIC_REGISTRY_MISMATCH").otherwise("VALID")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("contexts"))


@query(r"""WITH q AS (SELECT doc_id, text, CASE WHEN doc_id % 6 = 5 THEN ['never', 'written'] ELSE list_slice(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), 3, 9) END AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, nullif(regexp_extract(text, array_to_string(list_transform(ws, lambda w: '\Q' || w || '\E'), '\s+')), '') AS excerpt FROM q WHERE len(ws) > 0""")
def p23_exact_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote as its document has it, where only white space may differ; null if its words don't stand there."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    own = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 3, 7)
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id") % 6 == 5, F.array(F.lit("never"), F.lit("written"))).otherwise(own).alias("ws")).where(F.size("ws") > 0)
    pattern = F.array_join(F.transform("ws", lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), r"\s+")
    found = F.call_function("regexp_extract", F.col("text"), pattern, F.lit(0))
    return rows.select("doc_id", F.nullif(found, F.lit("")).alias("excerpt"))
