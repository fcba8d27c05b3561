"""Judging outputs, citations, criteria and abstentions: columns and tables in, columns and tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_json(text: Column) -> Column:
    """A struct of an output: json, whether it parses; schema, whether it has a boolean abstained and a list of citations; missing, whether it answers without a citation. Null for no output, missing also for what doesn't parse."""
    parsed = F.try_parse_json(text)
    abstained = F.get_json_object(text, "$.abstained")
    is_bool = F.coalesce(text.rlike(r'"abstained"\s*:\s*(true|false)') & abstained.isin("true", "false"), F.lit(False))
    cited = F.from_json(F.get_json_object(text, "$.citations"), "array<string>")
    json = F.when(text.isNotNull(), parsed.isNotNull())
    schema = F.when(text.isNotNull(), parsed.isNotNull() & is_bool & cited.isNotNull())
    missing = F.when(parsed.isNotNull(), is_bool & (abstained == "false") & (F.coalesce(F.size(cited), F.lit(0)) <= 0))
    return F.struct(json.alias("json"), schema.alias("schema"), missing.alias("missing"))


def latest_valid(*texts: Column) -> Column:
    """The first of texts that has the schema."""
    return F.coalesce(*[F.when(valid_json(t)["schema"], t) for t in texts])


def citation_checks(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, citation, chunk, source, belongs, valid): citations (run_id, citation) against evidence (run_id, n, chunk, source).

    A citation names an item as E and its number, or by its chunk, of which the last item counts. It is valid if the item was
    sent and has a source.
    """
    by_number = evidence.select("run_id", F.concat(F.lit("E"), F.col("n").cast("string")).alias("citation"), "n", "chunk", "source")
    by_chunk = evidence.select("run_id", F.col("chunk").alias("citation"), "n", "chunk", "source")
    known = by_number.unionByName(by_chunk).groupBy("run_id", "citation").agg(F.max_by(F.struct("chunk", "source"), "n").alias("item"))
    belongs = F.col("item").isNotNull()
    return citations.join(known, ["run_id", "citation"], "left").select("run_id", "citation", "item.chunk", "item.source", belongs.alias("belongs"), (belongs & F.col("item.source").isNotNull()).alias("valid"))


def covered_paths(spans: DataFrame) -> DataFrame:
    """(run_id, covered, mapping_missing) of spans (run_id, path, n, unmapped, cited): whether all spans of one path are cited.

    The first span of a path, by n, that is unmapped or not cited decides why it isn't covered. Without a covered path the
    result is null if such a span is unmapped, for then it isn't known.
    """
    bad = F.when(F.col("unmapped") | ~F.col("cited"), F.struct("n", F.when(F.col("unmapped"), "missing").otherwise("uncovered").alias("why")))
    paths = spans.groupBy("run_id", "path").agg(F.min(bad)["why"].alias("bad"))
    some, unknown = F.count_if(F.col("bad").isNull()) > 0, F.count_if(F.col("bad") == "missing") > 0
    return paths.groupBy("run_id").agg(F.when(some, True).when(unknown, None).otherwise(False).alias("covered"), (~some & unknown).alias("mapping_missing"))


def rate(good: Column, among: Column) -> Column:
    return F.try_divide(F.count_if(good), F.count_if(among))


def rated(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, passed, failed, not_applicable, rate) of verdicts: pass, fail or not_applicable; the rate leaves the last out and is null without others."""
    is_ = lambda v: F.col("verdict") == v
    return verdicts.groupBy(*keys).agg(F.count_if(is_("pass")).alias("passed"), F.count_if(is_("fail")).alias("failed"), F.count_if(is_("not_applicable")).alias("not_applicable"), rate(is_("pass"), ~is_("not_applicable")).alias("rate"))


def abstention_scores(decisions: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and F1 of abstaining (said) where it was due; null where nothing was said or due."""
    hit, said, due = F.count_if(F.col("said") & F.col("due")), F.count_if("said"), F.count_if("due")
    out = decisions.groupBy(*keys).agg(hit.alias("hits"), (said - hit).alias("false_alarms"), (due - hit).alias("missed"), F.try_divide(hit, said).alias("p"), F.try_divide(hit, due).alias("r"), F.try_divide(2 * hit, said + due).alias("f"))
    return out.select(*keys, "hits", "false_alarms", "missed", F.round("p", 8).alias("precision"), F.round("r", 8).alias("recall"), F.round("f", 8).alias("f1"))


def close_to(answer: Column, expected: Column, unit: Column, *, relative: float, absolute: float) -> Column:
    """Whether the first number and unit in answer are those expected; null for no number."""
    pattern = r"([-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)\s*([A-Za-z/%]+)"
    value = F.regexp_extract(answer, pattern, 1).try_cast("double")
    near = F.abs(value - expected) <= F.greatest(relative * F.greatest(F.abs(value), F.abs(expected)), F.lit(absolute))
    return (F.regexp_extract(answer, pattern, 2) == unit) & near


def answer_outcome(mode: Column, status: Column, has_options: Column, gold: Column, choice: Column) -> Column:
    """What became of a run, by the first rule that holds: runs without generation, failures, abstentions, open questions, then the choice."""
    return (
        F.when(mode == "retrieval_only", "not_applicable")
        .when(status == "retrieval_error", "retrieval_failed")
        .when(status == "generation_error", "generation_failed")
        .when(status == "parse_error", "format_failed")
        .when(status == "abstained", "abstained")
        .when(~has_options, "open_ended")
        .when(gold.isNull(), "missing_gold")
        .when(choice.isNull(), "missing_prediction")
        .when(choice == gold, "correct")
        .otherwise("wrong")
    )


def checked_runs(checks: DataFrame) -> DataFrame:
    """(run_id, n_checks, n_invalid, resolved) of citation checks (run_id, citation, chunk, valid): resolved has the chunks in the citations' order."""
    chunk = F.when(F.col("chunk").isNotNull(), F.struct("citation", "chunk"))
    resolved = F.transform(F.array_sort(F.collect_list(chunk)), lambda x: x["chunk"])
    return checks.groupBy("run_id").agg(F.count("*").alias("n_checks"), F.count_if(~F.col("valid")).alias("n_invalid"), resolved.alias("resolved"))


def citation_validity(status: Column, n_checks: Column, n_invalid: Column, missing: Column, passed: Column, matches: Column) -> Column:
    """Whether a run's citations hold: for an answer all of them, and a recorded validation that passed and agrees; for others only what is seen to be wrong, else null.

    passed and matches are null for a run without a recorded validation.
    """
    held = (n_checks > 0) & (n_invalid == 0) & F.coalesce(passed & matches, F.lit(False))
    return F.when(status == "answered", held).when(missing | (n_invalid > 0), False)


def failure_labels(status: Column, answerable: Column, choice_correct: Column, output_flags: list[Column], citation_valid: Column, matches: Column, missing_citation: Column, mapping_missing: Column) -> Column:
    """The set of what went wrong in a run, sorted. output_flags: whether each output is valid; null where there is none."""
    no = lambda c: F.coalesce(~c, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    wrong, refused = no(choice_correct), yes(answerable) & (status == "abstained")
    rules = {
        "retrieval_failure": status == "retrieval_error",
        "generation_failure": status == "generation_error",
        "gold_missed": wrong | refused,
        "wrong_option": wrong,
        "wrong_abstention": refused,
        "answered_when_unanswerable": no(answerable) & (status == "answered"),
        "invalid_output": F.greatest(status == "parse_error", *[no(f) for f in output_flags]),
        "invalid_citation": no(citation_valid),
        "citation_validation_mismatch": no(matches),
        "missing_citation": yes(missing_citation),
        "unresolved_answerability": answerable.isNull(),
        "mapping_missing": yes(mapping_missing),
    }
    return F.array_compact(F.array(*[F.when(rules[name], name) for name in sorted(rules)]))


def rubric_scores(verdicts: DataFrame, paths: DataFrame, errors: DataFrame) -> DataFrame:
    """(run_id, score) of verdicts (run_id, criterion, core, verdict), required paths (run_id, path, criterion) and errors (run_id, critical, minor, needs_review).

    Null where a verdict is uncertain or a review is needed; 0 for a critical error or a contradicted core criterion; 2 where
    every criterion of one path is met, nothing is contradicted and there is no minor error; 1 where anything is met; else 0.
    A criterion of a path without a verdict isn't met. Runs are those of errors.
    """
    is_ = lambda v: F.col("verdict") == v
    some = verdicts.groupBy("run_id").agg(F.max(is_("uncertain")).alias("uncertain"), F.max(is_("contradicted")).alias("contradicted"), F.max(is_("contradicted") & F.col("core")).alias("core"), F.max(is_("met")).alias("met"))
    met = verdicts.where(is_("met")).select("run_id", "criterion", F.lit(True).alias("held")).distinct()
    each = paths.join(met, ["run_id", "criterion"], "left").groupBy("run_id", "path").agg((F.count("held") == F.count("*")).alias("whole"))
    whole = each.groupBy("run_id").agg(F.max("whole").alias("whole"))
    rows = errors.join(some, "run_id", "left").join(whole, "run_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    score = (
        F.when(yes("needs_review") | yes("uncertain"), None)
        .when(yes("critical") | yes("core"), 0)
        .when(yes("whole") & ~yes("minor") & ~yes("contradicted"), 2)
        .when(yes("met"), 1)
        .otherwise(0)
    )
    return rows.select("run_id", score.alias("score"))
