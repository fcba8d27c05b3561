"""Ranks of evidence, normalised scores, and choices along a grid of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import written


def complete_rank(hits: DataFrame, question: str, path: str, span: str, chunks: str, rank: str) -> DataFrame:
    """(question, complete_rank): the first rank at which some path has all its spans, each by all chunks of one set.

    hits has a row for each chunk of each set, with a null rank where the chunk wasn't retrieved. A set that lacks a
    chunk, a span without a set and a path without all its spans have no rank.
    """
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.max(c)).alias("r")
    sets = hits.groupBy(question, path, span, chunks).agg(whole(rank))
    spans = sets.groupBy(question, path, span).agg(F.min("r").alias("r"))
    paths = spans.groupBy(question, path).agg(whole("r"))
    return paths.groupBy(question).agg(F.min("r").alias("complete_rank"))


def min_max(score: Column, *by: str) -> Column:
    """Scores between 0 and 1 within a group; 1 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))


def on_grid(rows: DataFrame, weights: list[float], question: str, score: Column, match: Column, relevant: Column, order: list[str], k: int) -> DataFrame:
    """(weight, n, mrr, hit): mean reciprocal rank and hits at k of each weight of match against score. Ties go by order."""
    spark = rows.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(w),) for w in weights], "weight double"))
    each = rows.withColumn("__s", score).withColumn("__m", match).withColumn("__r", relevant).crossJoin(grid)
    final = (1 - F.col("weight")) * F.col("__s") + F.col("weight") * F.col("__m")
    ranked = each.withColumn("__at", F.row_number().over(Window.partitionBy("weight", question).orderBy(F.round(final, 9).desc(), *order)))
    first = ranked.groupBy("weight", question).agg(F.min(F.when(F.col("__r"), F.col("__at"))).alias("first"))
    return first.groupBy("weight").agg(F.count("*").alias("n"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))).alias("hit"))


def best_weight(grid: DataFrame) -> DataFrame:
    """The row of the highest mrr, then hit, then the least weight."""
    return grid.orderBy(F.round("mrr", 9).desc(), F.round("hit", 9).desc(), "weight").limit(1)


def largest_harmless(grid: DataFrame, loss: float) -> DataFrame:
    """The largest weight over 0 whose hits are at most loss below those of weight 0; none where there is no such."""
    base = grid.where("weight = 0").select(F.col("hit").alias("base"))
    return grid.where("weight > 0").crossJoin(F.broadcast(base)).where(F.col("hit") >= F.col("base") - loss - 1e-12).agg(F.max("weight").alias("weight"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with place, their number from 1 in a total order.

    Rows are dealt by ranges of the order, sorted within, written once, as their ranges mustn't change between two readings,
    and numbered behind the sizes of the ranges before: no task holds all rows. Ties have no order of their own.
    """
    at = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", at))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(before), "__part").withColumn("place", F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def placed_in_groups(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with place, their number from 1 in their group's order, and size, the group's rows; however large a group is."""
    numbered = placed(rows, group, *order)
    first = numbered.groupBy(group).agg(F.min("place").alias("__first"), F.count("*").alias("size"))
    return numbered.join(first, group).withColumn("place", F.col("place") - F.col("__first") + 1).drop("__first")
