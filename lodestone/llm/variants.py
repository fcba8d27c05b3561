"""Operator 11: spelling variants, grouped by permuterm rotations.

A word gets a terminator, and all its rotations are made. One that ends with a given character has all the others as its
prefix: words whose rotations agree in that prefix differ in the skipped character alone (a replacement), and a word whose
whole rotation is the prefix has that character less (an insertion or deletion). So the rotations are sorted by the
prefix, and a scan over groups of alike prefixes emits each member's neighbours. A group has at most a word for each
letter and one without, whatever the corpus, since the terminator tells the place.

A word of n letters has about n rotations of n letters each. From LONG letters on, fingerprints of the prefix stand for
it, so that very long words take linear space; what they find is compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, coded, release, rows_of, slices, staged, table, text_bytes

#: Letters and occurrences that a word needs, and how many times as frequent its form is.
LETTERS, LEAST, TIMES = 6, 5, 5
#: Runs whose checksum with their document's id this divides lose a letter; 0: none do.
TYPOS = 199
#: Letters of a prefix from which fingerprints stand for it.
LONG = 65
PRIME = 2**61 - 1
#: ASCII letters, and the first byte of U+00C0 to U+00FF in UTF-8.
LETTER = np.array([chr(c).isalpha() and c < 128 or c == 0xC3 for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
CRC = np.array([zlib.crc32(bytes([c])) for c in range(256)], np.uint32)
CRC = CRC ^ CRC[0]  # what one more byte of 0 does to a checksum is linear in its bits


def runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of letters A-Z, a-z and U+00C0 to U+00FF of all texts, A-Z in lower case, and each text's offsets."""
    data, off = text_bytes(texts)
    inside = LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < len(data)]
    start[first] = inside[first]
    starts, kept = np.flatnonzero(start), np.flatnonzero(inside)
    at = np.append(np.searchsorted(kept, starts), len(kept)).astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(LOWER[data[kept]])))
    return out, np.searchsorted(starts, off)


def checksums(ids: list[str], row: np.ndarray, codes: np.ndarray, distinct: list[bytes]) -> np.ndarray:
    """crc32 of '<id>:<run>' for each run, put together from those of the id and of the run."""
    ahead = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    size = np.array([len(x) for x in distinct], np.int64)
    own = np.array([zlib.crc32(x) for x in distinct], np.uint32)
    out = np.zeros(len(codes), np.uint32)
    by_size = size[codes]
    shifted = ahead.copy()
    for n in range(1, min(LONG, int(size.max(initial=0))) + 1):
        shifted = CRC[shifted & 0xFF] ^ (shifted >> 8)
        at = np.flatnonzero(by_size == n)
        out[at] = shifted[row[at]] ^ own[codes[at]]
    for i in np.flatnonzero(by_size > LONG).tolist():
        out[i] = zlib.crc32(distinct[codes[i]], int(ahead[row[i]]))
    return out


def counted(ids: pa.Array, texts: pa.Array, typos: int, letters: int) -> pa.RecordBatch:
    """The slice's words of so many letters and their counts, after typos."""
    found, per_text = runs(texts)
    codes, distinct = coded(found)
    row = rows_of(per_text)
    h = checksums(ids.to_pylist(), row, codes, distinct) if typos and len(codes) else np.ones(len(codes), np.uint32)
    hit = h % np.uint32(typos) == 0 if typos else np.zeros(len(codes), bool)
    n = np.bincount(codes[~hit], minlength=len(distinct))
    counts: Counter = Counter()
    for i in np.flatnonzero(hit).tolist():
        word = distinct[codes[i]].decode()
        at = int(h[i]) % len(word)
        counts[word[:at] + word[at + 1 :]] += 1
    for i in np.flatnonzero(n).tolist():
        counts[distinct[i].decode()] += int(n[i])
    some = [x for x in counts if len(x) >= letters]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([counts[x] for x in some], pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, *, letters: int = LETTERS, least: int = LEAST, typos: int = TYPOS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of letters letters or more that stand least times or more. See spelling_variants."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield counted(part.column(0), part.column(1), typos, letters)
        pa.default_memory_pool().release_unused()

    named = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), col(text_col).alias("text"))
    return named.mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, paired, word, n): rotations of terminator-marked words, but for the skipped last letter.

    A whole rotation skips nothing. paired: the word without the letter is met here alone, not by a like letter before it.
    """
    size = F.char_length("word")
    each = words.where(size < LONG).select("word", "n", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    letter = F.expr("substring(word, i + 1, 1)")
    skipping = each.select(F.expr("concat(substring(word, i + 2), '$', substring(word, 1, i))").alias("prefix"), letter.alias("skipped"), ((F.col("i") == 0) | (F.expr("substring(word, i, 1)") != letter)).alias("paired"), "word", "n")
    each = words.where(size < LONG - 1).select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    whole = each.select(F.expr("concat(substring(word, i + 1), '$', substring(word, 1, i))").alias("prefix"), F.lit("").alias("skipped"), F.lit(True).alias("paired"), "word", "n")
    return skipping.unionByName(whole)


NEAR = "word string, n_near long, form_n long, form string"


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For sorted rotations, each word's neighbours in each group: how many, and the most frequent one."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held else rows
        prefix = rows.column("prefix").combine_chunks()
        edge = np.flatnonzero(pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(prefix) > 1 else np.zeros(0, np.int64)
        done = int(edge[-1]) if len(edge) else 0
        if done:
            yield neighbours(rows.slice(0, done), np.append(0, edge))
        held = rows.slice(done)
    if held and len(held):
        yield neighbours(held, np.array([0, len(held)]))


def neighbours(rows: pa.Table, bound: np.ndarray) -> pa.RecordBatch:
    size = np.diff(bound)
    some = size > 1
    own = rows.take(pa.array(np.concatenate([np.arange(a, a + n) for a, n in zip(bound[:-1][some], size[some])]) if some.any() else np.zeros(0, np.int64)))
    word, n, skipped, paired = (own.column(c).to_pylist() for c in ("word", "n", "skipped", "paired"))
    out, start = [], 0
    for g in size[some].tolist():
        members = range(start, start + g)
        start += g
        whole = next((j for j in members if not skipped[j]), -1)
        apart = {j for j in members if not paired[j]} if whole >= 0 else set()
        ranked = sorted(members, key=lambda j: (-n[j], word[j]))
        for j in members:
            near = [o for o in ranked[: 3 + len(apart)] if o != j and not (j == whole and o in apart) and not (o == whole and j in apart)]
            count = g - 1 - (len(apart) if j == whole else int(j in apart))
            if count:
                out.append((word[j], count, n[near[0]], word[near[0]]))
    columns = list(zip(*out)) if out else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["word", "n_near", "form_n", "form"])


PRINTS = "high long, low long, i int, skipped string, paired boolean, word_id string"


def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the prefixes of columns word, word_id, in linear time: polynomials of what is ahead of a letter and behind it."""
    bases = (1_000_003 * 2**29 + 7, 998_244_353 * 2**27 + 11)
    for batch in batches:
        for word, word_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            size, sums, power = len(word), ([0], [0]), ([1], [1])
            for c in map(ord, word):
                for b, s, p in zip(bases, sums, power):
                    s.append((s[-1] * b + c) % PRIME)
                    p.append(p[-1] * b % PRIME)

            def key(ahead: int, behind: int) -> list[int]:
                """Of the first ahead letters and the last behind ones."""
                return [(s[ahead] * (b + 1) + (s[size] - s[size - behind] * p[behind]) + behind * (b // 3)) % PRIME for b, s, p in zip(bases, sums, power)]

            skips = [(*key(i, size - 1 - i), i, word[i], i == 0 or word[i - 1] != word[i], word_id) for i in range(size)] if size >= LONG else []
            rows = skips + [(*key(i, size - i), i, "", True, word_id) for i in range(size + 1)]
            for k in range(0, len(rows), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + (1 << 14)])], ["high", "low", "i", "skipped", "paired", "word_id"]).cast(pa.schema([("high", pa.int64()), ("low", pa.int64()), ("i", pa.int32()), ("skipped", pa.string()), ("paired", pa.bool_()), ("word_id", pa.string())]))


def long_neighbours(words: DataFrame) -> DataFrame:
    """Neighbours by prefixes of LONG letters or more: as scanned() has them, each pair a row."""
    long = words.where(F.char_length("word") >= LONG - 1).select("word", "n", F.sha2("word", 256).alias("word_id"))
    keys = staged(long.select("word", "word_id").mapInArrow(printed, PRINTS))
    a, b = (keys.select("high", "low", "i", *[F.col(c).alias(f"{x}_{c}") for c in ("skipped", "paired", "word_id")]) for x in "ab")
    both = (F.col("a_skipped") != "") & (F.col("b_skipped") != "")
    pairs = a.join(b, ["high", "low", "i"]).where((F.col("a_word_id") != F.col("b_word_id")) & (both | (F.col("a_paired") & F.col("b_paired"))))
    named = lambda x, w, n: long.select(F.col("word_id").alias(f"{x}_word_id"), F.col("word").alias(w), F.col("n").alias(n))
    met = pairs.join(named("a", "word", "own_n"), "a_word_id").join(named("b", "form", "form_n"), "b_word_id")
    rest = lambda w, s: F.expr(f"substring({w}, i + 1 + if({s} = '', 0, 1))")
    same = (F.expr("substring(word, 1, i)") == F.expr("substring(form, 1, i)")) & (rest("word", "a_skipped") == rest("form", "b_skipped"))
    return met.where(same).select("word", F.lit(1).cast("long").alias("n_near"), "form_n", "form")


def roots(links: DataFrame, most: int, times: int) -> DataFrame:
    """(word, root): where links (word, form) end. Each link leads to a word times as frequent, so most occurrences bound their number."""
    ends = links.select("word", F.col("form").alias("root"))
    steps = int(log(max(most, 1), times)) + 1
    for _ in range(max(0, (steps - 1).bit_length())):
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, ends = ends, staged(ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        if hasattr(before, "staged_in"):
            release(before)
    return ends


def spelling_variants(docs: DataFrame, *, letters: int = LETTERS, least: int = LEAST, times: int = TIMES, typos: int = TYPOS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word: the more frequent spelling that it is a variant of.

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, of letters letters or more, with
    least occurrences n or more. Where typos divides the crc32 of '<id>:<run>', the run first loses the letter at that
    number modulo its length; with typos 0 none does. Two words are near if they differ by one letter put in, left out
    or replaced; n_near counts the near words. A word's form is the most frequent of them, the first in code-point order
    among equals, if it stands times as often as the word; else null. root follows forms to the last one.

    Null and empty texts have no words; a null id is the empty string before the colon. Repeated rows count each. Very long
    texts and words are read whole, in linear space. No rows: none come out. Further columns are left out.
    """
    if times < 2:
        raise ValueError("a form stands at least twice as often, or links could run in circles")
    words = staged(vocabulary(docs, letters=letters, least=least, typos=typos, id_col=id_col, text_col=text_col))
    size = words.agg(F.max("n").alias("most"), F.max(F.char_length("word")).alias("longest")).head()
    # equal prefixes meet in one range, and ranges follow each other as the sorted rotations do
    near = rotations(words).repartitionByRange("prefix").sortWithinPartitions("prefix", "skipped").mapInArrow(scanned, NEAR)
    if (size.longest or 0) >= LONG - 1:
        near = near.unionByName(long_neighbours(words))
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    frequent = F.col("form_n") >= F.col("n") * times
    found = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.form")).alias("form"), F.when(frequent, F.col("form_n")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL").select("word", "form"), size.most or 0, times)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents with the spelling that they are variants of."""
    return spelling_variants(table(spark, sf_dir, "documents"))
