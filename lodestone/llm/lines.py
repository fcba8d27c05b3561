"""Operator 8: removal of globally repeated multi-line chunks with content-defined borders, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: A chunk ends behind a line where the rolling hash of it and the line before is 0 modulo this.
DIVISOR = 3
#: Lines with something other than white space that a chunk needs to be removed.
LEAST_LINES = 2


def chunks(text: Column, divisor: int) -> Column:
    """Chunks (no, lines, filled, text) of a text, in linear time: an array, empty for null.

    A line's hash is the first 32 bits of its md5. The rolling hash of two neighbouring lines, 31 x the former's hash +
    the latter's, chooses the borders, so that they move along with lines that are put in or taken out elsewhere.
    """
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    here = F.struct(lines.alias("ls"), hashes.alias("hs"))

    def of(s: Column) -> Column:
        n = F.size(s["ls"])
        rolled = lambda i: (F.when(i > 1, F.get(s["hs"], i - 2)).otherwise(F.lit(0).cast("long")) * 31 + F.get(s["hs"], i - 1)) % divisor == 0
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: rolled(i) | (i == n))
        return F.transform(F.array(F.struct(s["ls"].alias("ls"), ends.alias("ends"))), lambda t: F.transform(t["ends"], lambda e, k: chunk(t, e, k)))[0]

    def chunk(t: Column, end: Column, k: Column) -> Column:
        start = F.when(k > 0, F.get(t["ends"], k - 1)).otherwise(0)
        own = F.slice(t["ls"], start + 1, end - start)
        return F.struct(k.alias("no"), (end - start).alias("lines"), F.size(F.filter(own, lambda x: x.rlike(r"\S"))).alias("filled"), F.array_join(own, "\n").alias("text"))

    return F.coalesce(F.transform(F.array(here), of)[0], F.array())


def deduplicate_lines(docs: DataFrame, *, divisor: int = DIVISOR, least_lines: int = LEAST_LINES, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, text, n_lines, n_removed, kept_text, carried), one row per row of docs: chunks that stand earlier in the corpus are out.

    Of a chunk of least_lines filled lines or more that stands in several places, the first stays: that of the smallest
    id, then of the text with the smallest hash, then the earliest. Chunks are gathered by md5, and count as repeated only
    if all that share it are alike byte by byte; which are the same is settled before anything is shuffled by document.

    Null text: no lines, null kept text. Empty text: one line. Repeated rows alike in id and text are one document and are
    treated alike; rows that share an id only are documents of their own. Null ids come first. Very long texts: linear
    time. No rows: none come out. Further columns named in
    carry come along in the struct carried, where no name can clash; others are left out.
    """
    further = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("boolean")
    whole_rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), further.alias("carried")).withColumn("hash", F.xxhash64("text"))
    named = whole_rows.drop("carried")
    parts = named.select("id", "hash", F.explode(chunks(F.col("text"), divisor)).alias("c")).where(F.col("c.filled") >= least_lines)
    placed = parts.select(F.md5(F.col("c.text").cast("binary")).alias("key"), F.struct("id", "hash", F.col("c.no").alias("no")).alias("place"), F.col("c.text").alias("chunk"))
    met = placed.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last"), (F.min("chunk") == F.max("chunk")).alias("same"))
    # written before it is joined, so that Spark can split the places of a chunk that very many documents have
    repeated = staged(met.where(F.col("same") & ~F.col("first").eqNullSafe(F.col("last"))).select("key", "first"))
    again = placed.select("key", "place").join(repeated, "key").where(~F.col("place").eqNullSafe(F.col("first")))
    removed = again.groupBy(F.col("place.id").alias("rid"), F.col("place.hash").alias("rhash")).agg(F.collect_set("place.no").alias("removed"))
    joined = whole_rows.join(removed, F.col("id").eqNullSafe(F.col("rid")) & (F.col("hash") == F.col("rhash")), "left")
    whole = joined.select("id", "text", "carried", "removed", F.when(F.col("removed").isNotNull(), chunks(F.col("text"), divisor)).alias("c"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("c") - 1), "removed")
    out = whole.select(
        F.col("id").alias(id_col),
        F.col("text").alias(text_col),
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("removed").isNull(), F.lit(0)).otherwise(F.aggregate("removed", F.lit(0), lambda s, k: s + F.get(F.col("c.lines"), k))).cast("long").alias("n_removed"),
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda k: F.get(F.col("c.text"), k)), "\n")).alias("kept_text"),
        "carried",
    )
    return out.withColumn("n_lines", F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.col("n_lines")).cast("long"))


def lined(text: Column) -> Column:
    """A text's lines (ls) and the places, from 1, of those with something other than white space (at); null for null."""
    split = F.transform(F.array(F.split(text, "\n", -1)), lambda ls: F.struct(ls.alias("ls"), F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: F.get(ls, i - 1).rlike(r"\S")).alias("at")))
    return F.when(text.isNotNull(), split[0])


def windows(text: Column, least_lines: int) -> Column:
    """Every run of least_lines filled lines of a text, with the lines between them, as (no, key): an array, empty for null.

    The key is the SHA-256 of the run's bytes.
    """

    def of(s: Column) -> Column:
        end = lambda k: F.get(s["at"], k + (least_lines - 1))
        key = lambda i, k: F.unhex(F.sha2(F.array_join(F.slice(s["ls"], i, end(k) - i + 1), "\n").cast("binary"), 256))
        starts = F.slice(s["at"], F.lit(1), F.greatest(F.size(s["at"]) - (least_lines - 1), F.lit(0)))
        return F.transform(starts, lambda i, k: F.struct(k.alias("no"), key(i, k).alias("key")))

    return F.coalesce(F.transform(F.array(lined(text)), of)[0], F.array())


def without(text: Column, removed: Column, least_lines: int) -> Column:
    """(n, kept_text): what is left of a text without the lines from the first to the last of each removed window."""

    def of(s: Column) -> Column:
        gone = F.flatten(F.transform(removed, lambda k: F.sequence(F.get(s["at"], k), F.get(s["at"], k + (least_lines - 1)))))
        kept = F.array_except(F.sequence(F.lit(1), F.size(s["ls"])), gone)
        return F.struct((F.size(s["ls"]) - F.size(kept)).alias("n"), F.array_join(F.transform(kept, lambda i: F.get(s["ls"], i - 1)), "\n").alias("kept_text"))

    return F.transform(F.array(lined(text)), of)[0]


def deduplicate_runs(docs: DataFrame, *, least_lines: int = LEAST_LINES, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, text, n_lines, n_removed, kept_text, carried), one row per row of docs: whole shared runs of lines are out.

    A line goes if it is in a run of least_lines filled lines (blank lines between them included) that stands byte by byte
    at an earlier place: in a document of a smaller id, in one with the same id whose text has a smaller hash, or earlier
    in the same text. Every window is looked up, so shared runs go whole, however short and wherever they begin. A line's
    first place is never among what goes. Windows are the same if their SHA-256 is.

    What stays: filled lines whose neighbours on both sides differ from those of all earlier places, so repeated lines on
    their own, and blank lines at a run's ends. Null text: no lines, null kept text. Empty text: one line. Repeated rows
    alike in id and text are one document and are treated alike; rows that share an id only are documents of their own.
    Null ids come first. Very long texts: linear time. No rows: none come out. Further columns named in carry come along
    in the struct carried; others are left out.
    """
    further = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("boolean")
    whole_rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), further.alias("carried")).withColumn("hash", F.xxhash64("text"))
    parts = whole_rows.select("id", "hash", F.explode(windows(F.col("text"), least_lines)).alias("w"))
    placed = parts.select(F.col("w.key").alias("key"), F.struct("id", "hash", F.col("w.no").alias("no")).alias("place"))
    met = placed.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    repeated = staged(met.where(~F.col("first").eqNullSafe(F.col("last"))).select("key", "first"))
    again = placed.join(repeated, "key").where(~F.col("place").eqNullSafe(F.col("first")))
    removed = again.groupBy(F.col("place.id").alias("rid"), F.col("place.hash").alias("rhash")).agg(F.collect_set("place.no").alias("removed"))
    joined = whole_rows.join(removed, F.col("id").eqNullSafe(F.col("rid")) & (F.col("hash") == F.col("rhash")), "left")
    left = joined.select("id", "text", "carried", F.when(F.col("removed").isNotNull(), without(F.col("text"), F.col("removed"), least_lines)).alias("left"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return left.select(
        F.col("id").alias(id_col),
        F.col("text").alias(text_col),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce("left.n", F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("left").isNull(), F.col("text")).otherwise(F.col("left.kept_text")).alias("kept_text"),
        "carried",
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the chunks of lines that stand earlier in the corpus."""
    kept = deduplicate_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_line_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs of lines that stand earlier in the corpus, found at every line."""
    kept = deduplicate_runs(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = """
WITH lined AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), numbered AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM lined
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM numbered
), rolled AS (
  SELECT *, (coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 31 + h) % 3 = 0 AS edge FROM hashed
), owned AS (
  SELECT *, coalesce(sum(CASE WHEN edge THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM rolled
), chunked AS (
  SELECT doc_id, no, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')) AS filled,
         string_agg(line, chr(10) ORDER BY i) AS body FROM owned GROUP BY doc_id, no
), judged AS (
  SELECT *, filled >= 2 AND row_number() OVER (PARTITION BY body, filled >= 2 ORDER BY doc_id, no) > 1 AS out FROM chunked
), kept AS (
  SELECT doc_id, sum(lines)::BIGINT AS n_lines, coalesce(sum(lines) FILTER (WHERE out), 0)::BIGINT AS n_removed,
         sha256(coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (WHERE NOT out), '')) AS kept_sha256 FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, k.kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
