"""Joins by overlap of intervals, coverage of expected keys, and unions of ledgers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of rows with equal keys whose half-open spans (start, end; other_start, other_end) overlap.

    Spans are dealt over bins of width characters and meet by equality of keys and bin; a pair counts in the first bin
    that both have. Spans should seldom be much longer than a bin. Empty spans and null bounds overlap with nothing.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    a = left.where("start < end").withColumn("bin", bins("start", "end"))
    b = right.where("other_start < other_end").withColumn("bin", bins("other_start", "other_end"))
    met = a.join(b, [*keys, "bin"]).where("start < other_end and other_start < end")
    return met.where(F.col("bin") == F.floor(F.greatest("start", "other_start") / width)).drop("bin")


def overlap_class(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """How a span lies to one that it overlaps: exact, contains, within or partial."""
    return (
        F.when((start == other_start) & (end == other_end), "exact")
        .when((start <= other_start) & (end >= other_end), "contains")
        .when((start >= other_start) & (end <= other_end), "within")
        .otherwise("partial")
    )


def coverage(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has, with the side that lacks them: missing or unexpected. Null keys equal null keys."""
    e = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("f"))
    f = found.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("f"))
    sides = e.unionByName(f).groupBy(*keys).agg(F.max("e").alias("e"), F.max("f").alias("f"))
    return sides.where("e <> f").select(*keys, F.when(F.col("e") == 1, "missing").otherwise("unexpected").alias("state"))


def merged_ledgers(ledgers: list[DataFrame], key: str) -> DataFrame:
    """One row for each key of all ledgers: how often it came, and whether its rows conflict."""
    union = ledgers[0]
    for other in ledgers[1:]:
        union = union.unionByName(other)
    rest = F.struct(*[c for c in union.columns if c != key])
    return union.groupBy(key).agg(F.count("*").alias("copies"), (~F.min(rest).eqNullSafe(F.max(rest))).alias("conflict"))


def _checked(rows: DataFrame, bad: Column, say: Column, keep: Column | None = None) -> DataFrame:
    """The rows to keep, by a job that fails with what say holds at the first row for which bad is true.

    One filter, so that no plan leaves the check out or asks for keep first.
    """
    return rows.where(F.when(F.coalesce(bad, F.lit(True)), F.raise_error(say).cast("boolean")).otherwise(F.lit(True) if keep is None else keep))


def _sides(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """A row for each key of two tables: how many rows each has of it, and one of them as left and right."""
    a = left.select(*key, F.struct(*left.columns).alias("left"), F.lit(None).cast(right.schema).alias("right"))
    b = right.select(*key, F.lit(None).cast(left.schema).alias("left"), F.struct(*right.columns).alias("right"))
    held = lambda c: (F.count(c).alias(f"n_{c}"), F.first(c, ignorenulls=True).alias(c))
    return a.unionByName(b).groupBy(*key).agg(*held("left"), *held("right"))


def paired(baseline: DataFrame, repeat: DataFrame, key: list[str], same: list[str]) -> DataFrame:
    """(key, baseline, repeat): each row of repeat with the row of baseline of its key, as structs, or a job that fails.

    It fails where a key is null or empty, where a side has it twice, where baseline lacks a key of repeat, or where a column
    of same differs between the two (a null equals a null). The checks ride in the job that makes the pairs: both sides
    meet in one aggregation by key, which is combined before it is shuffled, so a repeated key is told and not multiplied.
    Keys that only baseline has are left out. No rows on either side: none come out.
    """
    rows = _sides(baseline, repeat, key)
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])
    empty = F.greatest(*[F.col(k).isNull() | (F.col(k).cast("string") == "") for k in key], F.lit(False))
    fails = F.when(empty, "an empty key").when(F.greatest("n_left", "n_right") > 1, "a key that isn't unique").when(F.col("n_left") == 0, "a repeat without baseline")
    for c in same:
        fails = fails.when((F.col("n_right") > 0) & ~F.col(f"left.{c}").eqNullSafe(F.col(f"right.{c}")), f"another {c} in repeat and baseline")
    checked = _checked(rows.withColumn("__fails", fails), F.col("__fails").isNotNull(), F.concat(F.lit("PAIRS: "), F.col("__fails"), F.lit(": "), name), F.col("n_right") > 0)
    return checked.select(*key, F.col("left").alias("baseline"), F.col("right").alias("repeat"))


def complete_cells(rows: DataFrame, group: list[str], cell: list[str], cells: list[tuple]) -> DataFrame:
    """(group, cells), one row per group of rows, if each has every one of cells once and no other; else a job that fails."""
    name = F.to_json(F.array(*[F.col(c).cast("string") for c in cell]))
    known = name.isin(*[json.dumps([None if v is None else str(v) for v in c], separators=(",", ":"), ensure_ascii=False) for c in cells])
    by = rows.groupBy(*group).agg(F.count("*").alias("cells"), F.size(F.collect_set(F.when(known, name))).alias("__known"))
    wrong = (F.col("cells") != len(cells)) | (F.col("__known") != len(cells))
    return _checked(by, wrong, F.concat(F.lit("PAIRS: cells missing, repeated or unknown: "), F.to_json(F.struct(*group)))).drop("__known")


def one_to_one(left: DataFrame, right: DataFrame, key: list[str], *, how: str = "inner", suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """left and right merged by key, which is unique on both sides or the job fails: inner, left, right or outer.

    Null keys equal null keys and must be unique, too. Columns of one name other than the key get the suffixes. The check
    rides in the aggregation that merges.
    """
    rows = _sides(left, right, key)
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])
    keep = F.expr({"inner": "n_left = 1 AND n_right = 1", "left": "n_left = 1", "right": "n_right = 1", "outer": "true"}[how])
    checked = _checked(rows, F.greatest("n_left", "n_right") > 1, F.concat(F.lit("MERGE: not unique on both sides: "), name), keep)
    both = (set(left.columns) & set(right.columns)) - set(key)
    side = lambda df, n, s: [F.col(f"{n}.`{c}`").alias(c + s if c in both else c) for c in df.columns if c not in key]
    return checked.select(*key, *side(left, "left", suffixes[0]), *side(right, "right", suffixes[1]))


def pair_state(applicable: Column, first: Column, second: Column) -> Column:
    """Whether a pair's values can be compared: not_applicable, not_evaluated or evaluated."""
    return F.when(~applicable, "not_applicable").when(first.isNull() | second.isNull(), "not_evaluated").otherwise("evaluated")


def paired_differences(pairs: DataFrame, score: str, best: float, applicable: Column | None = None) -> DataFrame:
    """pairs (baseline, repeat) with a score's two values, state, difference and whether its being best flips."""
    a, b = F.col(f"baseline.{score}"), F.col(f"repeat.{score}")
    rows = pairs.select("*", a.alias("first"), b.alias("second"), pair_state(F.lit(True) if applicable is None else applicable, a, b).alias("state"))
    known = F.col("state") == "evaluated"
    return rows.select("*", F.when(known, b - a).alias("difference"), F.when(known, (b == best) != (a == best)).alias("flip"))
