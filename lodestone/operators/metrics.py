"""Measures of rankings against relevant items. Means leave out what is undefined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(questions: DataFrame, hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query, item, rank, relevant): hits and relevant items of every question; rank is null for what wasn't found, and a question without either has a row of nulls."""
    marked = hits.join(relevant.select("query", "item").distinct().withColumn("relevant", F.lit(True)), ["query", "item"], "full")
    return questions.join(marked, "query", "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def reciprocal_rank(rows: DataFrame) -> DataFrame:
    """(query, first_rank, rr): rr is 0 if nothing relevant is found."""
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return rows.groupBy("query").agg(first.alias("first_rank")).withColumn("rr", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))


def at_k(rows: DataFrame, ks: list[int]) -> DataFrame:
    """(query, k, hit, recall, precision, returned) of judged rows: recall is null without relevant items, precision without hits."""
    spread = rows.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    inside: Column = F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))
    out = spread.groupBy("query", "k").agg(F.count_if(inside & F.col("relevant")).alias("found"), F.count_if(inside).alias("returned"), F.count_if("relevant").alias("wanted"))
    return out.select("query", "k", (F.col("found") > 0).cast("int").alias("hit"), F.try_divide("found", "wanted").alias("recall"), F.try_divide("found", "returned").alias("precision"), "returned")


def share(condition: Column) -> list[Column]:
    """Numerator, denominator and value of a condition that may be null."""
    n, d = F.count_if(condition), F.count(condition)
    return [n.alias("numerator"), d.alias("denominator"), F.try_divide(n, d).alias("value")]
