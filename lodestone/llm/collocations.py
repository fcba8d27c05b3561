"""Operator 13: phrases that stand together more often than their parts, by Rabin-Karp fingerprints.

Prefix polynomials over the words of a slice of texts give the fingerprint of every phrase of n words as a difference of
two sums. Tasks count fingerprints, a shuffle adds the counts up, and those that are too rare are gone before any phrase
is made: what is kept of the others is a filter of bounded size. A longer phrase is counted only where both phrases of one
word less passed. A last pass over the texts makes the phrases that passed: a slice's fingerprint points to its first
occurrence, all others are compared with that word by word, and what differs becomes a phrase of its own. Counts are then
added up by the phrase's text, so that neither collisions nor what a filter lets through can change a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP, KeyFilter, byte_table, col, coded, hashed, key_filter, mixed, release, rows_of, slices, staged, table, text_bytes, words

#: Words of the longest phrases, occurrences that a phrase needs, and phrases of each language.
MOST_WORDS, LEAST, TOP = 3, 10, 2000
#: Percentage of a phrase's occurrences inside one longer phrase with which it is left out.
INSIDE = 50
#: Fingerprints that a task holds before it counts them.
HELD = 1 << 22
#: Parts of a language whose best phrases are found on their own.
PARTS = 32
ENDS = b".,;:!?\n\x0b\x0c\r"
SPLIT = byte_table(b" \t" + ENDS, lower=True)
BREAK = ~byte_table(ENDS, lower=False)[0]
UNKNOWN = "und"
#: What a phrase's length adds to its fingerprint.
LENGTHS = np.arange(64, dtype=np.uint64) * STEP
BASE = STEP | np.uint64(1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
COUNTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("phrase", T.StringType()), T.StructField("n", T.LongType())])


class Phrases:
    """The words of a slice's texts, where their pieces end, and the fingerprints of phrases."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        self.words, per_text, starts = words(texts, SPLIT)
        self.codes, distinct = coded(self.words)
        n = len(self.words)
        row = rows_of(per_text)
        data, _ = text_bytes(texts)
        piece = np.cumsum(BREAK[data])[starts] + row if n else row
        last = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, n) if n else np.zeros(0, np.int64)
        self.end = np.repeat(last, np.diff(np.append(0, last)))
        lang = langs.dictionary_encode()
        self.langs = lang.dictionary
        self.lang = lang.indices.to_numpy(zero_copy_only=False)[row]
        self.seed = hashed([x.encode() for x in self.langs.to_pylist()])[self.lang] if n else np.zeros(0, np.uint64)
        letters = hashed(distinct)[self.codes] if n else np.zeros(0, np.uint64)
        self.sums = np.append(np.zeros(1, np.uint64), np.cumsum(letters * powers(BASE, n)))
        self.back = powers(INVERSE, n)

    def places(self, n: int) -> np.ndarray:
        """Where n words of one piece begin."""
        return np.flatnonzero(np.arange(len(self.end)) + n <= self.end)

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """The fingerprints of n words from each place, their language and n being part of them."""
        return mixed((self.sums[at + n] - self.sums[at]) * self.back[at] + self.seed[at] + LENGTHS[n])

    def passing(self, n: int, passed: KeyFilter) -> np.ndarray:
        """Where n words of one piece begin, both of whose phrases of a word less passed."""
        at = self.places(n)
        at = at[passed.has(self.prints(at, n - 1))]
        return at[passed.has(self.prints(at + 1, n - 1))]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.cumprod(out)


def counting(sizes: tuple[int, ...], passed: Broadcast | None):
    """Counts of fingerprints (key, n) of phrases of some sizes, for columns lang, text."""

    def counts(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["key", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                p = Phrases(part.column(0), part.column(1))
                for n in sizes:
                    held.append(p.prints(p.passing(n, passed.value) if passed else p.places(n), n))
                    size += len(held[-1])
                if size > HELD:
                    yield from counts(held)
                    held, size = [], 0
        if held:
            yield from counts(held)
        pa.default_memory_pool().release_unused()

    return each


def pointed(p: Phrases, at: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of each phrase of n words among places with fingerprints, and how often it stands there, compared word by word."""
    _, first, same, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    first = at[first]
    to = first[same]
    other = p.lang[at] != p.lang[to]
    for j in range(n):
        other |= p.codes[at + j] != p.codes[to + j]
    if not other.any():
        return first, times
    times = times - np.bincount(same[other], minlength=len(first))
    apart = at[other]
    spelt = np.stack([p.lang[apart], *(p.codes[apart + j] for j in range(n))], 1)
    _, head, more = np.unique(spelt, axis=0, return_index=True, return_counts=True)
    return np.append(first, apart[head]), np.append(times, more)


def spelt(most: int, passed: Broadcast):
    """The phrases that passed, with their counts in a slice (see COUNTED); 0 words: the words of a language."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = Phrases(part.column(0), part.column(1))
                total = np.bincount(p.lang, minlength=len(p.langs))
                yield pa.RecordBatch.from_arrays([p.langs, pa.array(np.zeros(len(total), np.int32)), pa.array([""] * len(total), pa.string()), pa.array(total)], COUNTED.names)
                for n in range(1, most + 1):
                    at = p.places(n) if n < 3 else p.passing(n, passed.value)
                    keys = p.prints(at, n)
                    some = passed.value.has(keys)
                    at, times = pointed(p, at[some], keys[some], n)
                    own = [p.words.take(pa.array(at + j)).cast(pa.string()) for j in range(n)]
                    phrase = pc.binary_join_element_wise(*own, " ") if n > 1 else own[0]
                    yield pa.RecordBatch.from_arrays([p.langs.take(pa.array(p.lang[at])), pa.array(np.full(len(at), n, np.int32)), phrase, pa.array(times)], COUNTED.names)
        pa.default_memory_pool().release_unused()

    return each


def phrase_counts(docs: DataFrame, *, most_words: int = MOST_WORDS, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, phrase, n): all phrases of up to most_words words that stand least times or more in texts of a language.

    A row of 0 words has each language's words. Texts are lower-cased (A-Z alone) and split at . , ; : ! ? and line ends;
    phrases never cross these. Words stand between blanks and tabs. Null text: no words. Null language: und.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(col(lang_col), F.lit(UNKNOWN)).alias("lang"), col(text_col).alias("text"))
    levels: list[DataFrame] = []
    passed = None
    for n in range(2, most_words + 1):
        counts = texts.mapInArrow(counting((1, 2) if n == 2 else (n,), passed), "key long, n long")
        levels.append(staged(counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")))
        if passed:
            passed.unpersist()
        found = levels[0]
        for level in levels[1:]:
            found = found.unionByName(level)
        passed = spark.sparkContext.broadcast(key_filter(found))
    made = texts.mapInArrow(spelt(most_words, passed), COUNTED).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    out = staged(made.where((F.col("n") >= least) | (F.col("words") == 0)))
    passed.unpersist()
    release(*levels)
    return out


#: The score of columns a, l, r in whole numbers of up to 38 digits: exact up to 10^16 occurrences.
SCORE = "(cast(1000000 as decimal(7,0)) * (cast(a as decimal(16,0)) * cast(a as decimal(16,0)))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"


def collocations(docs: DataFrame, *, most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, inside: int = INSIDE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to most_words words by how they hold together.

    a is the phrase's count, l and r those of the parts of its lowest-scoring cut, n the language's words. The score is
    floor(1000000 a a / (l r)); ties between cuts go to the first. A phrase is left out if a longer one of least or more
    occurrences, left out itself or not, has it inside and inside % of its occurrences. Ranked by score, a, then phrase.

    Texts and words as in phrase_counts. Null and empty texts have no words; null languages are und; texts without phrases
    give no rows. Repeated rows count each. Very long texts are read whole. No rows: none come out. Further columns,
    whatever their names, are left out.
    """
    counts = phrase_counts(docs, most_words=most_words, least=least, text_col=text_col, lang_col=lang_col)
    phrases = counts.where("words > 1").withColumnRenamed("n", "a")
    part = counts.where((F.col("words") > 0) & (F.col("words") < most_words))
    own = F.split("phrase", " ")
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(own, i, m), " "))))
    longer = phrases.where("words > 2").select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(F.col("longer") * 100 >= F.col("a") * inside, F.lit(False)))
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - words)").alias("right"))
    # written before it is joined, so that Spark can split the phrases that begin or end with one very common word
    cuts = staged(cuts)
    left = part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    joined = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", F.expr(SCORE))
    lowest = joined.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = lambda w: F.row_number().over(w.orderBy(*order))
    # each language in parts, so that no task ranks more than PARTS * top phrases
    best = lowest.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", first(Window.partitionBy("lang", "part"))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", first(Window.partitionBy("lang")).cast("long")).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two and three words of each language of the documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS p
  FROM documents
), split AS (
  SELECT lang, row_number() OVER () AS piece, regexp_split_to_array(p, '[ \t]') AS ws FROM pieces
), spoken AS (
  SELECT lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split
), placed AS (
  SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM spoken WHERE w <> '' WINDOW o AS (PARTITION BY piece ORDER BY i)
), grams AS (
  SELECT lang, 1 AS m, w AS phrase FROM placed
  UNION ALL
  SELECT lang, 2, w || ' ' || w2 FROM placed WHERE w2 IS NOT NULL
  UNION ALL
  SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM placed WHERE w3 IS NOT NULL
), f AS (
  SELECT lang, m, phrase, count(*) AS n FROM grams GROUP BY ALL
), candidates AS (
  SELECT * FROM f WHERE m > 1 AND n >= 10
), cut AS (
  SELECT lang, phrase, m, n AS a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.n AS l, r.n AS r, (1000000::HUGEINT * c.a * c.a) // (l.n::HUGEINT * r.n) AS score
  FROM cut c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:], ' ')
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored
), inner_ones AS (
  SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM cut WHERE m = 3
  UNION ALL
  SELECT lang, array_to_string(ws[2:3], ' '), a FROM cut WHERE m = 3
), longer AS (
  SELECT lang, phrase, max(a) AS longer FROM inner_ones GROUP BY ALL
), kept AS (
  SELECT w.* FROM lowest w LEFT JOIN longer o USING (lang, phrase) WHERE w.o = 1 AND NOT coalesce(100 * o.longer >= 50 * w.a, false)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
), totals AS (
  SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, t.n, score::BIGINT AS score FROM ranked JOIN totals t USING (lang) WHERE rank <= 2000
"""
