"""Titles that mean the same: exact and fuzzy groups, alias maps; quotes in sources; groups that must not be split."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How alike two titles must be to be shown to a person.
NEAR = 0.90
# Words in which titles that mean different things differ.
DISTINCTIVE = ("first", "second", "third", "fourth", "fifth", "initial", "final", "positive", "negative", "elastic", "inelastic", "conservative", "nonconservative")


@F.pandas_udf(T.DoubleType())
def alikeness(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by longest matching blocks."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)])


def near_titles(titles: DataFrame, *, distinctive: tuple[str, ...] = (), least: float = NEAR) -> DataFrame:
    """(left_title, right_title, similarity) of titles (title) that begin with the same word and are least alike or more.

    Titles that differ in a distinctive word are never paired. A pair's similarity can't be more than twice the shorter over
    both lengths: pairs are left out by that before they are compared.
    """
    words = F.split("title", " ")
    own = titles.select("title").distinct().where("title <> ''").withColumn("block", words[0])
    left, right = own.select("block", F.col("title").alias("left_title")), own.select("block", F.col("title").alias("right_title"))
    n, m = F.char_length("left_title"), F.char_length("right_title")
    pairs = left.join(right, "block").where((F.col("left_title") < F.col("right_title")) & (2 * F.least(n, m) >= least * (n + m)))
    a, b = F.split("left_title", " "), F.split("right_title", " ")
    if distinctive:
        odd = F.array(*map(F.lit, distinctive))
        apart = F.array_union(F.array_except(a, b), F.array_except(b, a))
        pairs = pairs.where(~F.arrays_overlap(apart, odd))
    scored = pairs.withColumn("ratio", alikeness("left_title", "right_title")).where(F.col("ratio") >= least)
    return scored.select("left_title", "right_title", F.round("ratio", 3).alias("similarity"))


def merged_titles(rows: DataFrame, aliases: DataFrame, contextual: DataFrame) -> DataFrame:
    """rows (title_key, context) with the topic that contextual (title_key, context, topic), or else aliases (title_key, topic), gives their title; their own title without either."""
    inside = contextual.withColumnRenamed("topic", "__inside")
    general = aliases.withColumnRenamed("topic", "__general")
    out = rows.join(inside, ["title_key", "context"], "left").join(general, "title_key", "left")
    return out.withColumn("topic", F.coalesce("__inside", "__general", "title_key")).drop("__inside", "__general")


def grounded(fragments: Column, source: Column) -> Column:
    """Whether all fragments, each of three words or more, stand in source in their order and don't overlap. No fragments: false."""
    words = lambda f: F.size(F.filter(F.split(f, " "), lambda w: w.rlike(r"[\p{L}\p{N}]")))
    zero = F.lit(1)
    step = lambda at, f: F.when((at > 0) & (words(f) >= 3), F.when(F.call_function("locate", f, source, at) > 0, F.call_function("locate", f, source, at) + F.char_length(f)).otherwise(0)).otherwise(0)
    return (F.size(fragments) > 0) & (F.aggregate(fragments, zero, step) > 0)


def components(edges: DataFrame, written) -> DataFrame:
    """(node, component) of links (a, b), the component being its smallest node. written(df) writes a table and reads it again.

    In each round a node takes the smallest label among its neighbours', and then that label's own: rounds grow with the
    logarithm of the longest path.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = written(labels.join(near, "a").select("a", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")))
        if not low.where("moved").limit(1).count():
            return low.select(F.col("a").alias("node"), F.col("label").alias("component"))
        jump = low.select(F.col("a").alias("label"), F.col("label").alias("further"))
        labels = written(low.select("a", "label").join(jump, "label").select("a", F.least("label", "further").alias("label")))
