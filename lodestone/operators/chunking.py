"""Chunks of documents: segments of records that belong together, groups of a wanted size within them, and their parents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import EVIDENCE_TYPES

# Tokens that a chunk should have, may have, and needs.
TARGET, MOST, LEAST = 500, 600, 100
SCOPE = ["chapter", "section"]


def segments(records: DataFrame, doc: str = "doc_id", order: str = "line_no") -> DataFrame:
    """records (doc, order, chapter, section, content_type, excluded, inline_heading) that are evidence, with their segment.

    A region of exercises goes on from a record that opens it until the section changes, a glossary, an example or a heading
    comes, or an excluded section resets it. What is excluded, in a region, or of another type ends a segment, and so does a
    change of chapter or section; headings inside an example stay.
    """
    by = Window.partitionBy(doc).orderBy(order)
    scope = F.struct(*SCOPE)
    changed = ~scope.eqNullSafe(F.lag(scope).over(by))
    kind = F.col("content_type")
    ends = changed | kind.isin("glossary", "example") | ((kind == "heading") & ~F.col("inline_heading"))
    first = F.when(F.col("excluded"), "reset").when(kind == "check_understanding", "open").when(ends, "end")
    rows = records.withColumn("__last", F.coalesce(F.last(first, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit("end")))
    inside = (F.col("__last") == "open") & ~ends
    kept = ~F.col("excluded") & ~inside & (kind != "check_understanding") & (kind.isin(*EVIDENCE_TYPES) | F.col("inline_heading"))
    marked = rows.withColumn("__kept", kept)
    new = F.col("__kept") & (~F.coalesce(F.lag("__kept").over(by), F.lit(False)) | changed)
    numbered = marked.withColumn("segment", F.sum(F.when(new, 1).otherwise(0)).over(by))
    return numbered.where("__kept").drop("__kept", "__last")


def partition(tokens: list[int], target: int, most: int) -> list[tuple[int, int]]:
    """Runs (start, end) of blocks: each ends where its tokens come nearest to target; a block over most alone is a run."""
    out, start = [], 0
    while start < len(tokens):
        best, distance, count = None, None, 0
        for end in range(start + 1, len(tokens) + 1):
            count += tokens[end - 1]
            if count > most:
                best = best or end
                break
            if count and (distance is None or abs(target - count) < distance):
                best, distance = end, abs(target - count)
            if count >= target:
                break
        if best is None:
            break
        out.append((start, best))
        start = best
    return out


def balanced(runs: list[tuple[int, int]], tokens: list[int], most: int, least: int) -> list[tuple[int, int]]:
    """runs, whose last, if it is short, is joined with the one before or takes blocks from it."""
    size = lambda a, b: sum(tokens[a:b])
    if len(runs) < 2 or size(*runs[-1]) >= least:
        return runs
    (first, cut), (_, end) = runs[-2:]
    if size(first, end) <= most:
        return [*runs[:-2], (first, end)]
    while cut - first > 1 and size(cut, end) < least and size(first, cut - 1) <= most and size(cut - 1, end) <= most:
        cut -= 1
    return [*runs[:-2], (first, cut), (cut, end)]


def grouped(blocks: DataFrame, *, target: int = TARGET, most: int = MOST, least: int = LEAST, doc: str = "doc_id", order: str = "line_no") -> DataFrame:
    """blocks (doc, order, segment, n_tokens, inline_heading) with their chunk, numbered in each document.

    Each segment is partitioned by itself, so a task holds the numbers of one segment. Runs without tokens, and runs of
    headings alone, are left out.
    """
    kinds = dict(blocks.dtypes)

    def cut(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(order)
        tokens, heading = df["n_tokens"].tolist(), df["inline_heading"].tolist()
        runs = balanced(partition(tokens, target, most), tokens, most, least)
        kept = [(a, b) for a, b in runs if sum(tokens[a:b]) and not all(heading[a:b])]
        rows = [(df[doc].iat[0], df[order].iat[i], df["segment"].iat[0], k) for k, (a, b) in enumerate(kept) for i in range(a, b)]
        return pd.DataFrame(rows, columns=[doc, order, "segment", "run"])

    runs = blocks.select(doc, order, "segment", "n_tokens", "inline_heading").groupBy(doc, "segment").applyInPandas(cut, f"{doc} {kinds[doc]}, {order} {kinds[order]}, segment long, run int")
    by = Window.partitionBy(doc).orderBy("segment", "run")
    return runs.withColumn("chunk", F.dense_rank().over(by)).drop("run")


def parents(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """spans (doc, chapter, section, start, end) with the span of all records of their section, or of the chapter without one."""
    section, chapter = Window.partitionBy(doc, *SCOPE), Window.partitionBy(doc, "chapter")
    pick = lambda f, c: F.when(F.col("section").isNotNull(), f(c).over(section)).otherwise(f(c).over(chapter))
    return spans.withColumn("parent_start", pick(F.min, "start")).withColumn("parent_end", pick(F.max, "end"))


def substantive(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.char_length(F.regexp_replace(text, r"\s", ""))
