"""Operator 1, token counts with a digest cache, and the exact piecewise encoding that packing shares.

A tokenizer's work on a text splits at places that no pre-token crosses. Each distinct piece of a slice is encoded once,
and a task remembers pieces, so that the library runs over far less than the whole text while ids and counts stay the
library's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, STEP, map_texts, mixed, scratch_dir, staged, table, text_bytes, words

#: Text that is encoded at once.
ENCODE_BYTES = 4 << 20
#: Pieces that a task remembers, about 40 MB; beyond them it starts anew, which costs time and changes nothing.
REMEMBERED = 1 << 20


def byte_level_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces for byte-level BPE whose words carry the blank before them: cut before a lone blank between two words.

    Every pre-token that holds a blank has it first, and a run of white space gives its last blank to the word behind it,
    so a cut between a visible character and such a blank is one that the tokenizer makes itself.
    """
    data, off = text_bytes(texts)
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        seen, plain = data > 32, (data > 32) & (data < 127)
        cut[1:-1] = (data[1:-1] == 32) & seen[:-2] & seen[2:] & (plain[2:] | plain[:-2])
    cut[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts, len(data))
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return pieces, np.searchsorted(starts, off)


def spaced_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces for tokenizers that drop white space: the words between ASCII white space."""
    pieces, per_text, _ = words(texts, SPACED)
    return pieces, per_text


def glued(tokenizer, run: Callable, pieces: list[str]) -> list[bytes]:
    """The ids of pieces that are encoded many at once, as one text with a mark between them.

    The mark stands apart from its neighbours as a pre-token of its own with an id that no piece without it has. Pieces
    with the mark, with the start of a special string, or with white space but one blank ahead are encoded one by one.
    """
    for mark, joint in (("\n", "\n"), ("|", " | ")):
        alone = tokenizer.encode(mark, add_special_tokens=False).ids
        if len(alone) == 1 and tokenizer.encode(f"a{joint}a", add_special_tokens=False).ids.count(alone[0]) == 1:
            break
    else:
        return [np.array(e.ids, np.uint32).tobytes() for e in run(pieces, add_special_tokens=False)]
    plain = [mark not in p and "<|" not in p and len(q := p.split()) == 1 and (q[0] == p or " " + q[0] == p) for p in pieces]
    out: list[bytes] = [b""] * len(pieces)
    at = [i for i, x in enumerate(plain) if x]
    some = [at[i : i + 500] for i in range(0, len(at), 500)]
    others = [[i] for i, x in enumerate(plain) if not x]
    for own, e in zip(some, run([joint.join([pieces[i] for i in own]) for own in some], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, np.uint32)
        ends = np.append(np.flatnonzero(ids == alone[0]), len(ids)).tolist()
        if len(ends) != len(own):
            others.append(own)
            continue
        data, start = ids.tobytes(), 0
        for i, end in zip(own, ends, strict=True):
            out[i] = data[4 * start : 4 * end]
            start = end + 1
    rest = [i for own in others for i in own]
    for i, e in zip(rest, run([pieces[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, np.uint32).tobytes()
    return out


def digests(strings: pa.Array) -> np.ndarray:
    """128 bits of each string, as two rows: sums over its bytes of numbers mixed from the byte and its place."""
    data, off = text_bytes(strings)
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(off[:-1], np.diff(off)).astype(np.uint64)
    x = mixed(((place + np.uint64(1)) << np.uint64(8)) + data)
    out = np.zeros((2, len(strings)), np.uint64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[0, some] = np.add.reduceat(x, off[some])
        out[1, some] = np.add.reduceat(mixed(x + STEP), off[some])
    return out


class Remembered:
    """Ids of strings by their 128-bit digests, in sorted runs of numbers: a fifth of a dict's memory."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.runs: list[np.ndarray] = []  # rows: two digests, start in ids, number of ids
        self.ids, self.used = np.zeros(1 << 10, np.uint32), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key's ids start and how many there are; -1 for unknown keys."""
        start, n = np.full(keys.shape[1], -1, np.int64), np.zeros(keys.shape[1], np.int64)
        left = np.argsort(keys[0])  # in order, and without what is found, so that runs are read from one end to the other
        for run in self.runs:
            at = np.minimum(np.searchsorted(run[0], keys[0, left]), run.shape[1] - 1)
            hit = (run[0, at] == keys[0, left]) & (run[1, at] == keys[1, left])
            start[left[hit]], n[left[hit]] = run[2, at[hit]], run[3, at[hit]]
            left = left[~hit]
        return start, n

    def add(self, keys: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Remembers new keys; where the ids of each start and how many there are."""
        flat = np.frombuffer(b"".join(ids), np.uint32)
        if self.used + len(flat) > len(self.ids):
            grown = np.zeros(2 * (self.used + len(flat)), np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(flat)] = flat
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = self.used + np.cumsum(n) - n
        self.used += len(flat)
        run = np.stack([*keys, start.astype(np.uint64), n.astype(np.uint64)])
        while self.runs and 2 * run.shape[1] >= self.runs[-1].shape[1]:
            run = np.concatenate([self.runs.pop(), run], axis=1)
        self.runs.append(run[:, np.argsort(run[0], kind="stable")])
        return start, n

    def size(self) -> int:
        return sum(run.shape[1] for run in self.runs)


def encoder(path: str, pieces_of: Callable) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A function of texts that gives every piece's number, the pieces' ids one after another with their offsets, and each text's piece offsets."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    run = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    known = Remembered(REMEMBERED)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        pieces, per_text = pieces_of(texts)
        coded = pieces.dictionary_encode()
        keys = digests(coded.dictionary)
        start, n = known.find(keys)
        new = np.flatnonzero(start < 0)
        if known.size() + len(new) > known.limit and known.runs:
            known.clear()
            new = np.arange(len(start))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            start[some], n[some] = known.add(keys[:, some], glued(tokenizer, run, coded.dictionary.take(pa.array(some)).to_pylist()))
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        ids = known.ids[np.repeat(start - ends[:-1], n) + np.arange(int(ends[-1]))]
        return coded.indices.to_numpy(zero_copy_only=False), ids, ends, per_text

    return encode


def summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def version_of(path: str) -> str:
    """The digest of a tokenizer's file: its version in the cache."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_tokens(docs: DataFrame, path: str, cache_dir: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts through a cache of digests: (id, n_bytes, digest, n_tokens), one row per row of docs.

    cache_dir holds Parquet of (version, digest, n_tokens). Content is normalised to UTF-8 with null as the empty text, no
    further, since anything else could change a count. Digests of docs are joined with those stored for this tokenizer's
    version; of each distinct miss the row of the smallest id is encoded (rows alike in both are, and are stored once) and the counts are appended to the cache before they are joined
    back, so that a rerun or a lost executor finds them stored.

    Null text and empty text: 0 bytes, 0 tokens. Repeated rows and ids, and null ids: each row has its own result. Very
    long texts: encoded whole. No rows: none come out, nothing is appended. Further columns of docs are left out.
    """
    spark, version = docs.sparkSession, version_of(path)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").alias("__id"), text.alias("__text")).withColumn("digest", F.unhex(F.sha2("__text", 256)))
    light = keyed.select("__id", F.octet_length("__text").cast("long").alias("n_bytes"), "digest")
    stored = "version string, digest binary, n_tokens long"
    if not has_files(spark, cache_dir):
        spark.createDataFrame([], stored).write.mode("append").parquet(cache_dir)

    def cached() -> DataFrame:
        read = spark.read.schema(stored).parquet(cache_dir).where(F.col("version") == version)
        return read.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = light.groupBy("digest").agg(F.min("__id").alias("__id")).join(cached(), "digest", "left_anti")
    chosen = keyed.join(misses.hint("shuffle_hash"), (keyed["digest"] == misses["digest"]) & keyed["__id"].eqNullSafe(misses["__id"]), "left_semi")

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        encode = encoder(path, byte_level_pieces)

        def count(texts: pa.Array) -> list[pa.Array]:
            codes, _, ends, per_text = encode(texts)
            return [pa.array(summed(np.diff(ends)[codes], per_text))]

        return count

    counts = map_texts(chosen, "__text", ["digest"], [T.StructField("n_tokens", T.LongType())], make, ENCODE_BYTES)
    counts.dropDuplicates(["digest"]).select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_dir)
    counted = staged(cached())  # written before it is joined, so that Spark can split the rows of a text that very many have
    return light.join(counted, "digest").select(F.col("__id").alias(id_col), "n_bytes", "digest", "n_tokens")


def has_files(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.schema("version string").parquet(path).inputFiles())
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, starting from an empty cache."""
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_dir(spark))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
