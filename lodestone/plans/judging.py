"""Queries of judged answers: every outcome and failure label, rubric scores with core criteria, agreement by class."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import answers as judged
from lodestone.operators import stats
from lodestone.plans.answers import LINES, RUNS, _missing, _valid, citations, evidence, lines, runs
from lodestone.registry import query, table

_CHECKED = """k2 AS (SELECT run_id, citation, chunk, belongs AND source IS NOT NULL AS valid FROM k),
cc AS (SELECT run_id, count(*) AS n_checks, count(*) FILTER (WHERE NOT valid) AS n_invalid, coalesce(string_agg(chunk, ',' ORDER BY citation, chunk) FILTER (WHERE chunk IS NOT NULL), '') AS resolved FROM k2 GROUP BY 1),
sp AS (SELECT e.run_id, path, n, unmapped, max(k.chunk IS NOT NULL) AS cited FROM e LEFT JOIN k ON k.run_id = e.run_id AND k.chunk = e.chunk GROUP BY ALL),
pa AS (SELECT run_id, path, arg_min(CASE WHEN unmapped THEN 'missing' ELSE 'uncovered' END, n) FILTER (WHERE unmapped OR NOT cited) AS bad FROM sp GROUP BY ALL),
mm AS (SELECT run_id, count(*) FILTER (WHERE bad IS NULL) = 0 AND count(*) FILTER (WHERE bad = 'missing') > 0 AS mapping_missing FROM pa GROUP BY 1)"""


@query(f"""WITH {RUNS}, {LINES}, {_CHECKED},
v AS (SELECT r.*, run_id % 23 = 0 AS retrieval_only, run_id % 9 <> 4 AS has_options, {_missing('repaired')} AS miss_repaired, {_missing('raw')} AS miss_raw, status IN ('answered', 'abstained') OR coalesce({_valid('repaired')}, false) OR coalesce({_valid('raw')}, false) AS has_answer FROM r),
j AS (SELECT v.*, CASE WHEN has_answer THEN coalesce(n_checks, 0) ELSE 0 END AS nc, CASE WHEN has_answer THEN coalesce(n_invalid, 0) ELSE 0 END AS ni, CASE WHEN v.run_id % 5 <> 3 THEN v.run_id % 31 <> 0 END AS passed,
 CASE WHEN v.run_id % 5 <> 3 THEN (CASE WHEN has_answer THEN coalesce(resolved, '') ELSE '' END) = (CASE WHEN v.run_id % 29 = 0 THEN 'c0' WHEN has_answer THEN coalesce(resolved, '') ELSE '' END) END AS matches, coalesce(miss_repaired, miss_raw, false) AS missing, status = 'answered' AND coalesce(mapping_missing, false) AS unmapped_one
 FROM v LEFT JOIN cc ON cc.run_id = v.run_id LEFT JOIN mm ON mm.run_id = v.run_id),
f AS (SELECT *, CASE WHEN status = 'answered' THEN nc > 0 AND ni = 0 AND coalesce(passed AND matches, false) WHEN missing OR ni > 0 THEN false END AS citation_valid,
 CASE WHEN status = 'answered' AND answerable IS NOT NULL AND gold IS NOT NULL AND choice IS NOT NULL THEN choice = gold END AS chosen FROM j)
SELECT run_id, CASE WHEN retrieval_only THEN 'not_applicable' WHEN status = 'retrieval_error' THEN 'retrieval_failed' WHEN status = 'generation_error' THEN 'generation_failed' WHEN status = 'parse_error' THEN 'format_failed' WHEN status = 'abstained' THEN 'abstained' WHEN NOT has_options THEN 'open_ended' WHEN gold IS NULL THEN 'missing_gold' WHEN choice IS NULL THEN 'missing_prediction' WHEN choice = gold THEN 'correct' ELSE 'wrong' END AS outcome, citation_valid,
array_to_string(list_sort(list_filter([CASE WHEN status = 'retrieval_error' THEN 'retrieval_failure' END, CASE WHEN status = 'generation_error' THEN 'generation_failure' END, CASE WHEN NOT chosen OR (answerable AND status = 'abstained') THEN 'gold_missed' END, CASE WHEN NOT chosen THEN 'wrong_option' END, CASE WHEN answerable AND status = 'abstained' THEN 'wrong_abstention' END,
CASE WHEN NOT answerable AND status = 'answered' THEN 'answered_when_unanswerable' END, CASE WHEN status = 'parse_error' OR NOT {_valid('raw')} OR (repaired IS NOT NULL AND NOT {_valid('repaired')}) THEN 'invalid_output' END, CASE WHEN NOT citation_valid THEN 'invalid_citation' END, CASE WHEN NOT matches THEN 'citation_validation_mismatch' END,
CASE WHEN missing THEN 'missing_citation' END, CASE WHEN answerable IS NULL THEN 'unresolved_answerability' END, CASE WHEN unmapped_one THEN 'mapping_missing' END], lambda x: x IS NOT NULL)), ',') AS labels FROM f""")
def p32_p33_m12_all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's outcome, whether its citations hold, and every label of what went wrong, recorded validations and mappings included."""
    key, status = F.col("run_id"), F.col("status")
    raw, repaired = (judged.valid_json(F.col(c)) for c in ("raw", "repaired"))
    answered = status.isin("answered", "abstained") | F.coalesce(raw["schema"], F.lit(False)) | F.coalesce(repaired["schema"], F.lit(False))
    rows = runs(spark, sf_dir).select("*", raw.alias("raw_ok"), repaired.alias("repaired_ok"), answered.alias("has_answer"))
    checks = judged.citation_checks(citations(spark, sf_dir), evidence(spark, sf_dir))
    cited = checks.where("chunk is not null").select("run_id", "chunk").distinct().withColumn("cited", F.lit(True))
    covered = judged.covered_paths(evidence(spark, sf_dir).join(cited, ["run_id", "chunk"], "left").withColumn("cited", F.coalesce("cited", F.lit(False))))
    rows = rows.join(judged.checked_runs(checks), "run_id", "left").join(covered.select("run_id", "mapping_missing"), "run_id", "left")
    mine = lambda c, none: F.when(F.col("has_answer"), F.coalesce(F.col(c), none)).otherwise(none)
    resolved = mine("resolved", F.array().cast("array<string>"))
    recorded = F.when(key % 29 == 0, F.array(F.lit("c0"))).otherwise(resolved)
    has = key % 5 != 3
    passed, matches = F.when(has, key % 31 != 0), F.when(has, recorded == resolved)
    missing = F.coalesce("repaired_ok.missing", "raw_ok.missing", F.lit(False))
    valid = judged.citation_validity(status, mine("n_checks", F.lit(0)), mine("n_invalid", F.lit(0)), missing, passed, matches)
    gold, choice = F.col("gold"), F.col("choice")
    chosen = F.when((status == "answered") & F.col("answerable").isNotNull() & gold.isNotNull() & choice.isNotNull(), choice == gold)
    labels = judged.failure_labels(status, F.col("answerable"), chosen, [F.col(f"{c}_ok.{x}") for c in ("raw", "repaired") for x in ("json", "schema")], valid, matches, missing, (status == "answered") & F.col("mapping_missing"))
    mode = F.when(key % 23 == 0, "retrieval_only").otherwise("retrieval_and_generation")
    return rows.select("run_id", judged.answer_outcome(mode, status, key % 9 != 4, gold, choice).alias("outcome"), valid.alias("citation_valid"), F.array_join(labels, ",").alias("labels"))


_VERDICT = "CASE WHEN l_quantity > 47 THEN 'uncertain' WHEN l_quantity < 4 THEN 'contradicted' WHEN l_quantity BETWEEN 14 AND 47 THEN 'met' ELSE 'absent' END"


@query(f"""WITH {LINES}, crit AS (SELECT l_orderkey AS run_id, n, l_linestatus = 'F' AS core, {_VERDICT} AS verdict, l_returnflag AS path, l_discount >= 0.1 AS critical, l_tax >= 0.08 AS minor, l_discount < 0.005 AND l_tax < 0.005 AS review FROM l),
p AS (SELECT run_id, path, bool_and(verdict = 'met') AS whole FROM crit WHERE path <> 'N' GROUP BY ALL), w AS (SELECT run_id, bool_or(whole) AS whole FROM p GROUP BY 1),
g AS (SELECT run_id, bool_or(verdict = 'uncertain') OR bool_or(review) AS unsure, bool_or(critical) OR bool_or(verdict = 'contradicted' AND core) AS zero, bool_or(minor) AS minor, bool_or(verdict = 'contradicted') AS contradicted, bool_or(verdict = 'met') AS met FROM crit GROUP BY 1)
SELECT g.run_id, CASE WHEN unsure THEN NULL WHEN zero THEN 0 WHEN coalesce(whole, false) AND NOT minor AND NOT contradicted THEN 2 WHEN met THEN 1 ELSE 0 END AS score FROM g LEFT JOIN w ON w.run_id = g.run_id""")
def p31_core_rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers' scores by a rubric whose core criteria may not be contradicted: lines stand for criteria, their flags for required paths."""
    q = F.col("l_quantity")
    verdict = F.when(q > 47, "uncertain").when(q < 4, "contradicted").when(q.between(14, 47), "met").otherwise("absent")
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("run_id"), F.col("n").alias("criterion"), (F.col("l_linestatus") == "F").alias("core"), verdict.alias("verdict"), F.col("l_returnflag").alias("path"), "l_discount", "l_tax")
    some = lambda c, name: F.max(c).alias(name)
    errors = rows.groupBy("run_id").agg(some(F.col("l_discount") >= 0.1, "critical"), some(F.col("l_tax") >= 0.08, "minor"), some((F.col("l_discount") < 0.005) & (F.col("l_tax") < 0.005), "needs_review"))
    return judged.rubric_scores(rows, rows.where("path <> 'N'").select("run_id", "path", "criterion"), errors)


_ROLES = ("definition", "example", "comparison", "application", "other")
_ROLE = "[{0}][(({{e}}) % 5 + 1)::INT]".format(", ".join(f"'{r}'" for r in _ROLES[:4]) + ", 'definition'")


@query(f"""WITH r AS (SELECT l_returnflag AS flag, {_ROLE.format(e="l_partkey")} AS truth, {_ROLE.format(e="CASE WHEN l_quantity > 30 THEN l_suppkey ELSE l_partkey END")} AS guess FROM lineitem),
c AS (SELECT flag, unnest(['definition', 'example', 'comparison', 'application', 'other']) AS class FROM (SELECT DISTINCT flag FROM r)),
m AS (SELECT c.flag, class, count(*) FILTER (WHERE truth = class)::BIGINT AS support, count(*) FILTER (WHERE guess = class)::BIGINT AS predicted, count(*) FILTER (WHERE truth = class AND guess = class)::BIGINT AS hits, count(*)::BIGINT AS n FROM c JOIN r ON r.flag = c.flag GROUP BY ALL),
f AS (SELECT *, hits / nullif(predicted, 0) AS p, hits / nullif(support, 0) AS q, CASE WHEN support > 0 OR predicted > 0 THEN 2 * hits / (support + predicted) END AS f FROM m),
g AS (SELECT *, sum(hits) OVER w / n AS a, avg(f) OVER w AS macro, sum(support * predicted) OVER w / n / n AS e FROM f WINDOW w AS (PARTITION BY flag))
SELECT flag, class, support, predicted, hits, n, round(p, 8) AS precision, round(q, 8) AS recall, round(f, 8) AS f1, round(a, 8) AS accuracy, round(macro, 8) AS macro_f1, round((a - e) / (1 - e), 8) AS kappa FROM g""")
def q11_class_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each class, and accuracy, mean F1 and kappa over all, of two labellings of lines, by their flag."""
    role = lambda e: F.element_at(F.array(*map(F.lit, (*_ROLES[:4], "definition"))), (e % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), role(F.col("l_partkey")).alias("truth"), role(F.when(F.col("l_quantity") > 30, F.col("l_suppkey")).otherwise(F.col("l_partkey"))).alias("guess"))
    found = stats.class_agreement(rows, "truth", "guess", list(_ROLES), ["flag"])
    return found.select("flag", "class", "support", "predicted", "hits", "n", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1", "kappa")])
