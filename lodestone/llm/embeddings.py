"""Operator 2: near-duplicate vectors by an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, staged, table
from .components import components

#: Vectors from which a cell may be split, with a pivot for each quarter of them. To move a vector costs about as much as an
#: eighth of them to compare. Pivots by which a cell is split at once; vectors of one side of a block, and numbers in them.
CELL, MAX_PIVOTS, BLOCK, NUMBERS = 32768, 64, 16384, 1 << 22
#: Splits of a cell in turn, and border copies for each vector beyond which a cell is left unsplit. Vectors by which a split is judged.
LEVELS, MOST_COPIES, JUDGED = 5, 4, 4096
#: Added to distances, so that rounding of double precision can't lose a link; the cosine itself decides.
SLACK = 1e-9
#: Rows of a block that are compared at once.
STRIP = 256
CELL_KEY = ["label", "dim", "path"]


def usable(vec: Column, label: Column) -> Column:
    """Whether a row can link: it has a label, finite components and a positive length."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows of length 1."""
    return unit(vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1))


def cut(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): the cells of pivots p in which each row of x is, as the nearest pivot's or with a border within radius."""
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
    nearest = d.argmin(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[nearest]
    # By the triangle inequality a vector is as far from a cell's border as half of what its pivot is farther than the
    # home pivot; in Euclidean space by the factor (d1 + d2) / gap, which is at least 1, farther still.
    near = d[np.arange(len(x)), nearest][:, None]
    margin = np.where(gap > 0, (d * d - near * near) / (2 * np.maximum(gap, 1e-300)), 0)
    row, cell = np.nonzero(margin <= radius + SLACK)
    return row, cell, nearest[row] == cell


def pivots(full: DataFrame) -> DataFrame:
    """Pivots of cells (with n, their members), drawn by a hash: one for about CELL / 4 members, MAX_PIVOTS at most."""
    wanted = F.least(F.lit(MAX_PIVOTS), F.ceil(F.col("n") * 4 / CELL))
    drawn = full.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) * F.col("n") < 4.0 * (1 << 30) * wanted)
    ranked = drawn.withColumn("k", F.row_number().over(Window.partitionBy(*CELL_KEY).orderBy(F.xxhash64("key"), "key")))
    return ranked.where(F.col("k") <= wanted)


def apart(p: np.ndarray, radius: float) -> np.ndarray:
    """Pivots, but for those within twice the radius of an earlier one: what is between two such is at home with both."""
    close = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T)) <= 2 * radius
    kept: list[int] = []
    for i in range(len(p)):
        if not close[i, kept].any():
            kept.append(i)
    return p[kept]


def worth(full: DataFrame, chosen: DataFrame, radius: float) -> DataFrame:
    """The cells that cost less in parts: about JUDGED members, spread by a hash, meet the pivots and stand for all.

    What is left to compare in the parts, and vectors moved there, are held against the comparisons and moves of the whole.
    """
    judged = full.where(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(1 << 30)) * F.col("n") < float(JUDGED << 30))
    both = judged.withColumn("k", F.lit(0)).unionByName(chosen)
    out = T.StructType([full.schema[c] for c in CELL_KEY])

    def run(rows: pa.Table) -> pa.Table:
        is_pivot = rows.column("k").to_numpy() > 0
        x, drawn = rows.filter(pa.array(~is_pivot)), rows.filter(pa.array(is_pivot)).sort_by("k")
        p = apart(matrix(drawn.column("vec")), radius) if len(drawn) else []
        if not len(x) or len(p) < 2:
            return rows.select(out.names).slice(0, 0)
        n, side = rows.column("n")[0].as_py(), max(1, min(BLOCK, NUMBERS // rows.column("dim")[0].as_py()))
        row, cell, home = cut(matrix(x.column("vec")), p, radius)
        at_home = x.column("home").to_numpy()
        members, homes = (np.bincount(cell[some], minlength=len(p)) * (n / len(x)) for some in (home | True, home & at_home[row]))
        cost = lambda h, m: (h * (m - h / 2) + CELL / 8 * m * np.ceil(m / side)).sum()
        # a split moves all vectors once to the pivots, and its copies once more
        parts, whole = cost(homes, members) + CELL / 8 * (n + members.sum()), cost(np.array([n * at_home.mean()]), np.array([n]))
        return rows.select(out.names).slice(0, int(parts < whole and members.sum() <= MOST_COPIES * n))

    return both.groupBy(*CELL_KEY).applyInArrow(run, out)


def split(full: DataFrame, chosen: DataFrame, radius: float) -> DataFrame:
    """The cells in parts, one for each of their pivots that are apart.

    Members are dealt over chunks of about BLOCK, and every chunk meets the pivots, so that no task holds a cell. A member
    is at home in the cell of its nearest pivot, and copied to every cell whose border is within radius.
    """
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    kept = chosen.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = full.withColumn("k", F.lit(0)).withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(1)), chunks).cast("int"))
    out = full.drop("n").schema

    def run(rows: pa.Table) -> pa.Table:
        is_pivot = rows.column("k").to_numpy() > 0
        own, p = rows.filter(pa.array(~is_pivot)), rows.filter(pa.array(is_pivot)).sort_by("k")
        if not len(own):
            return own.select(out.names)
        row, cell, home = cut(matrix(own.column("vec")), apart(matrix(p.column("vec")), radius), radius)
        path, at_home = own.column("path")[0].as_py(), own.column("home").to_numpy()[row] & home
        made = {"path": pa.array([f"{path}/{c}" for c in cell.tolist()], pa.string()), "home": pa.array(at_home)}
        return pa.table({c: made[c] if c in made else own.column(c).take(pa.array(row)) for c in out.names})

    return dealt.unionByName(kept).groupBy(*CELL_KEY, "chunk").applyInArrow(run, out)


def in_cells(classes: DataFrame, radius: float) -> DataFrame:
    """Each vector in its home cell, and in every cell whose border is within radius: classes with path and home.

    At first a label's vectors of one dimension are a cell. A cell of more than CELL vectors is split where that is
    worth it, and its parts in turn. Whatever stays large, as it does where no vectors stand close together, is joined in blocks.
    """
    cells, done = classes.withColumn("path", F.lit("")).withColumn("home", F.lit(True)), []
    for _ in range(LEVELS):
        large = staged(cells.groupBy(*CELL_KEY).agg(F.count("*").alias("n")).where(F.col("n") > CELL))
        if large.isEmpty():
            break
        full = cells.join(F.broadcast(large), CELL_KEY)
        chosen = staged(pivots(full))
        better = staged(worth(full, chosen, radius))
        if better.isEmpty():
            break
        done.append(cells.join(F.broadcast(better), CELL_KEY, "left_anti"))
        cells = staged(split(*(x.join(F.broadcast(better), CELL_KEY, "left_semi") for x in (full, chosen)), radius)).select(*cells.columns)
    for part in done:
        cells = cells.unionByName(part.select(*cells.columns))
    return cells


def linked(cells: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): in each block of a cell, the links counted for home vectors (b null), and links enough to join what is linked (n null).

    A cell's vectors are dealt over sides of BLOCK, or of NUMBERS numbers, and each two sides meet once: however full a cell
    is, a task holds two sides.
    """
    sizes = cells.groupBy(*CELL_KEY).agg(F.count("*").alias("members"))
    side = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(NUMBERS) / F.col("dim"))))
    dealt = cells.join(staged(sizes), CELL_KEY).withColumn("s", F.ceil(F.col("members") / side).cast("int")).withColumn("at", F.pmod(F.xxhash64("key"), F.col("s")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    blocks = met.select(*CELL_KEY, "key", "vec", "copies", "home", (F.col("at") > F.col("other")).alias("right"), F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))

    def join(rows: pa.Table) -> pa.Table:
        key, copies, home = (rows.column(c).to_numpy() for c in ("key", "copies", "home"))
        right = rows.column("right").to_numpy()
        x, square = matrix(rows.column("vec")), rows.column("i")[0] == rows.column("j")[0]
        # home vectors first: two border copies need not be compared
        left, other = (some[np.argsort(~home[some], kind="stable")] for some in (np.flatnonzero(~right), np.flatnonzero(right)))
        n, root = np.zeros(len(key), np.int64), np.arange(len(key))
        for a, b in hits(x, left, left if square else other, home, cosine):
            unlike = a != b
            a, b = a[unlike], b[unlike]
            np.add.at(n, a, copies[b])
            if not square:
                np.add.at(n, b, copies[a])
            merge(root, a, b)
        some, node = np.flatnonzero((n > 0) & home), np.flatnonzero(root != np.arange(len(key)))
        none = lambda k: pa.nulls(k, pa.int64())
        counted = pa.table({"a": key[some], "b": none(len(some)), "n": n[some]})
        return pa.concat_tables([counted, pa.table({"a": key[node], "b": key[root[node]], "n": none(len(node))})])

    return blocks.groupBy(*CELL_KEY, "i", "j").applyInArrow(join, "a long, b long, n long")


def hits(x: np.ndarray, left: np.ndarray, right: np.ndarray, home: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows a of left and b of right, home vectors first in both, with a cosine of cosine or more; not all where both are border copies.

    Single precision tells what is clear; what is nearer to cosine than its error can be is computed in double precision.
    """
    if not len(left) or not len(right):
        return
    single, error = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-23
    homes, of_right = int(home[left].sum()), int(home[right].sum())
    across = np.ascontiguousarray(single[right].T)
    for at in range(0, len(left), STRIP):
        own = left[at : at + STRIP]
        some = len(right) if at < homes else of_right
        near = single[own] @ across[:, :some]
        found = np.flatnonzero(near.ravel() >= cosine - error)
        if not len(found):
            continue
        a, b = own[found // some], right[found % some]
        close = np.flatnonzero(near.ravel()[found] < cosine + error)
        keep = np.ones(len(found), bool)
        for k in range(0, len(close), 1 << 14):
            part = close[k : k + (1 << 14)]
            keep[part] = np.einsum("ij,ij->i", x[a[part]], x[b[part]]) >= cosine
        yield a[keep], b[keep]


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins a and b in root, which names for every row the first row that it is joined with."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of cosine or more between vectors of one label: (id, n_links, component_id, kept), one row per row of vectors.

    Vectors that are alike in every component are one class, whose copies link with each other; a class joins as one.
    Classes are in the cell of their nearest pivot and in those whose border is within the distance that cosine stands
    for on the unit sphere; cells join independently. Every link is counted once for each end, in the end's home cell.

    Null, zero and empty vectors, null or non-finite components, null labels, null ids: no links, own component. Vectors
    of unlike dimensions don't link. Each of the rows that share an id is a vector of its own, with its own links; kept
    tells whether the id is the component's smallest. No rows: none come out. Further columns, whatever their names, are
    left out.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    named = vectors.select(col(id_col).cast("long").alias("id"), col(vector_col).cast(kind).alias("vec"), col(label_col).alias("label"))
    digest = F.sha2(F.concat(F.col("label").cast("string"), F.lit(":"), F.to_json(F.struct(F.transform("vec", lambda x: x + 0.0).alias("v")))), 256)
    rows = staged(named.withColumn("same", F.when(F.col("id").isNotNull() & usable(F.col("vec"), F.col("label")), digest)))
    alike = rows.where("same is not null").groupBy("same").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = staged(alike.withColumn("dim", F.size("vec")).withColumn("key", F.conv(F.substring("same", 1, 15), 16, 10).cast("long")))
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    found = staged(linked(in_cells(classes.select("key", "label", "dim", "vec", "copies"), radius), cosine))
    counted = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    named_classes = components(found.where("b is not null").select("a", "b"))
    placed = classes.select("same", "key", "least", "copies").join(counted, F.col("key") == F.col("a"), "left").join(named_classes, F.col("key") == F.col("node"), "left")
    placed = staged(placed.select("same", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("component")))
    smallest = staged(placed.groupBy("component").agg(F.min("least").alias("component_id")))
    of_class = staged(placed.join(smallest, "component").select("same", "n_links", "component_id"))
    out = rows.select("id", "same").join(of_class, "same", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all vectors at a cosine of 0.98."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
