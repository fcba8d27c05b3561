"""What one step of an evaluation hands to the next: scored questions, frozen hits, mapping identities, eligible levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels of learners, and the classes of eligibility whose answers count for all of them.
LEVELS = ("beginner", "intermediate", "advanced")
COUNTED = ("full", "endpoint_only")
#: What tells one mapping of gold spans from another.
IDENTITY = ("mapping_id", "corpus_id", "chunk_config_id", "source_gold_hash")


def eligible_levels(eligibility: Column) -> Column:
    """The levels for which a question counts: all, where it is eligible in full or at the ends, else none."""
    return F.when(eligibility.isin(*COUNTED), F.array(*map(F.lit, LEVELS))).otherwise(F.array().cast("array<string>"))


def changed_identity(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, changed): for each mapping of expected which parts of its identity differ in actual, in a fixed order; all where it isn't there."""
    other = actual.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in IDENTITY])
    met = expected.join(other, F.col(key) == F.col("__key"), "left")
    changed = F.array_compact(F.array(*[F.when(F.col("__key").isNull() | ~F.col(c).eqNullSafe(F.col(f"__{c}")), c) for c in IDENTITY]))
    return met.select(key, changed.alias("changed"))


def same_identity(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """expected, if every mapping's identity is that of actual; else a job that fails and says what has changed."""
    off = changed_identity(expected, actual, key)
    say = F.concat(F.lit("MAPPING: changed: "), F.col(key).cast("string"), F.lit(": "), F.array_join("changed", ", "))
    checked = off.where(F.when(F.size("changed") > 0, F.raise_error(say).cast("boolean")).otherwise(True))
    return expected.join(checked.select(F.col(key).alias("__key")), F.col(key) == F.col("__key")).drop("__key")


def frozen_hits(hits: DataFrame, chunks: DataFrame, questions: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """(query, rank, item, score, text_hash, provider, textbook, provenance) of hits (query, question, item, rank, score, text_hash).

    A hit on a chunk that chunks (item, provider, textbook, text_hash) doesn't have, one whose text is another, and one that
    was found for other words than those of questions (query, question), blanks at the ends aside, each make the job fail.
    """
    own = chunks.select(F.col("item").alias("__item"), "provider", "textbook", F.col("text_hash").alias("__hash"))
    asked = questions.select(F.col("query").alias("__query"), F.trim("question").alias("__question"))
    met = hits.join(own, F.col("item") == F.col("__item"), "left").join(asked, F.col("query") == F.col("__query"), "left")
    name = F.concat_ws("|", F.col("query").cast("string"), F.col("item").cast("string"))
    wrong = (
        F.when(~F.col("question").eqNullSafe(F.col("__question")), "other words than the question's")
        .when(F.col("__item").isNull(), "an unknown chunk")
        .when(~F.col("text_hash").eqNullSafe(F.col("__hash")), "another text than the chunk's")
    )
    checked = met.where(F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("HITS: "), wrong, F.lit(": "), name)).cast("boolean")).otherwise(True))
    held = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(provenance.items())]))
    return checked.select("query", "rank", "item", "score", "text_hash", "provider", "textbook", F.sha2(held, 256).alias("provenance"))


def scored_questions(questions: DataFrame, paths: DataFrame, hits: DataFrame, items: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row for each question (query, answerable): scope, ranks and what is found among its first k hits.

    paths (query, path, item): the sets of items each of which answers the question; an unanswerable one has none, whatever
    paths says. hits (query, item, rank): no item twice. items (item, textbook, provider) tell whether the answer lies in one
    textbook and with one provider. A path's rank is that of its last item, and it is complete if all its items are hit.
    Recall is that of the best path; precision and what is missed are null without hits or answer.
    """
    wanted = paths.join(questions.where("answerable").select("query"), "query", "left_semi").select("query", "path", "item").distinct()
    met = wanted.join(hits.select("query", "item", "rank"), ["query", "item"], "left")
    count = lambda k: F.count_if(F.col("rank") <= k)
    each = met.groupBy("query", "path").agg(F.min("rank").alias("first"), F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("whole"), F.count("*").alias("n"), *[count(k).alias(f"in_{k}") for k in ks])
    best = each.groupBy("query").agg(F.min("first").alias("first_rank"), F.min("whole").alias("complete_rank"), *[F.max(F.col(f"in_{k}") / F.col("n")).alias(f"recall_{k}") for k in ks])
    relevant = wanted.select("query", "item").distinct()
    sources = relevant.join(items, "item").groupBy("query").agg(F.countDistinct("textbook").alias("textbooks"), F.countDistinct("provider").alias("providers"))
    good = hits.join(relevant.withColumn("good", F.lit(True)), ["query", "item"], "left").groupBy("query").agg(F.count("*").alias("returned"), *[x for k in ks for x in (count(k).alias(f"top_{k}"), F.count_if((F.col("rank") <= k) & F.col("good")).alias(f"good_{k}"))])
    rows = questions.join(best, "query", "left").join(sources, "query", "left").join(good, "query", "left")
    yes = F.col("answerable")
    scope = lambda n, one, many: F.when(~yes, "unanswerable").when(F.col(n) > 1, many).otherwise(one)
    returned = F.coalesce("returned", F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per_k = [
        x
        for k in ks
        for x in (
            (zero(f"good_{k}") > 0).cast("int").alias(f"hit_at_{k}"),
            F.coalesce(F.col("complete_rank") <= k, F.lit(False)).cast("int").alias(f"complete_at_{k}"),
            F.when(yes, F.coalesce(f"recall_{k}", F.lit(0.0))).alias(f"recall_at_{k}"),
            F.when(yes, F.try_divide(zero(f"good_{k}"), zero(f"top_{k}"))).alias(f"precision_at_{k}"),
            F.when(yes, (zero(f"good_{k}") == 0).cast("int")).alias(f"missed_at_{k}"),
        )
    ]
    reciprocal = lambda c: F.coalesce(1.0 / F.col(c), F.lit(0.0))
    return rows.select(
        "query", "answerable", scope("textbooks", "single_source", "cross_textbook").alias("scope"), scope("providers", "single_provider", "cross_provider").alias("provider_scope"), "first_rank", "complete_rank",
        reciprocal("first_rank").alias("rr"), reciprocal("complete_rank").alias("complete_rr"), returned.alias("returned"), (returned == 0).cast("int").alias("empty"), F.when(~yes, (returned > 0).cast("int")).alias("false_positive"), *per_k,
    )
