"""Line spans, runs and unions of intervals as window functions by document."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.LongType()))
def line_starts(text: pd.Series) -> pd.Series:
    """Where each line of a text begins, in characters; null for null. Linear in the text, however many lines it has."""

    def starts(t: str | None) -> np.ndarray | None:
        if t is None:
            return None
        letters = np.frombuffer(t.encode("ascii"), np.uint8) if t.isascii() else np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.concatenate([[0], np.flatnonzero(letters == 10) + 1])

    return text.map(starts)


@F.pandas_udf(T.ArrayType(T.StringType()))
def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """The slices of a text from starts to ends, in characters. Each costs its own length, wherever in the text it stands."""
    return pd.Series([None if t is None or a is None else [t[x:y] for x, y in zip(a.tolist(), b.tolist())] for t, a, b in zip(text, starts, ends)], dtype=object)


def line_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, line, start, end): every line with its half-open character span. Made within each row: no shuffle."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.split(text, "\n", -1).alias("line"), line_starts(text).alias("start"))
    lines = rows.select("doc", F.posexplode(F.arrays_zip("line", "start")).alias("line_no", "x"))
    return lines.select("doc", "line_no", "x.line", F.col("x.start").alias("start"), (F.col("x.start") + F.char_length("x.line")).alias("end"))


def without_adjacent_repeats(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose value isn't that of the row before."""
    last = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    first = F.row_number().over(Window.partitionBy(group).orderBy(order)) == 1
    return rows.withColumn("__keep", first | ~F.col(value).eqNullSafe(last)).where("__keep").drop("__keep")


def islands(spans: DataFrame, group: str, *, gap: int = 0) -> DataFrame:
    """Unions of a group's spans (start, end) that overlap, touch or stand at most gap apart: (group, start, end, spans)."""
    order = Window.partitionBy(group).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)
    numbered = spans.withColumn("__new", new).withColumn("island", F.sum("__new").over(order))
    return numbered.groupBy(group, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("spans"))


def contiguous(spans: DataFrame, group: str, *, gaps: tuple[int, ...] = (0, 2)) -> DataFrame:
    """Runs of a group's spans (start, end) that begin just where the one before ends, or one of gaps behind: (group, run, start, end, spans)."""
    order = Window.partitionBy(group).orderBy("start", "end")
    joins = (F.col("start") - F.lag("end").over(order)).isin(*gaps)
    numbered = spans.withColumn("__new", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("__new").over(order))
    return numbered.groupBy(group, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("spans"))
