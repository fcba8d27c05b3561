"""Operator 3: cross-entropy difference of texts between a target and a background bigram model over one vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, map_texts, offsets_of, slices, staged, table
from .tokens import ENCODE_BYTES, byte_level_pieces, encoder

#: Weight of the word model in each context's bigram model, and of each token in the word models.
CONTEXT_WEIGHT, TOKEN_WEIGHT = 16.0, 0.5
#: Bigrams whose losses are broadcast at most, 24 bytes each; beyond them texts' bigrams are joined with the model.
BROADCAST_BIGRAMS = 1 << 21
COMPACT = 1 << 21  # bigrams that a task gathers before it adds them up
STEP_BYTES = 2 << 20  # token ids that a task counts or scores at once

LOSSES = [T.StructField("n_tokens", T.LongType()), T.StructField("target_bits", T.DoubleType()), T.StructField("background_bits", T.DoubleType())]


def vocabulary_of(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def encoded(docs: DataFrame, text_col: str, carry: list[str], path: str, vocabulary: int) -> DataFrame:
    """Columns carry of docs and tokens, the ids of each whole text as little-endian integers. No shuffle."""
    kind = id_type(vocabulary)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        encode = encoder(path, byte_level_pieces)

        def each(texts: pa.Array) -> list[pa.Array]:
            codes, ids, ends, per_text = encode(texts)
            size = np.diff(ends)[codes]
            before = np.concatenate([[0], np.cumsum(size)])
            tokens = ids[np.repeat(ends[:-1][codes] - before[:-1], size) + np.arange(int(before[-1]))].astype(kind) if len(codes) else np.zeros(0, kind)
            offsets = (before[per_text] * tokens.itemsize).astype(np.int32)
            return [pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(tokens)])]

        return each

    return map_texts(docs, text_col, carry, [T.StructField("tokens", T.BinaryType())], make, ENCODE_BYTES)


def id_type(vocabulary: int) -> type[np.unsignedinteger]:
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def bigrams(tokens: pa.Array, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Every token's bigram, the token before it x (vocabulary + 1) + it, and each text's row of them.

    The token before a text's first is number vocabulary.
    """
    off, data = offsets_of(tokens), tokens.buffers()[2]
    kind = np.dtype(id_type(vocabulary))
    after = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind).astype(np.int64) if off[-1] > off[0] else np.zeros(0, np.int64)
    bounds = (off - off[0]) // kind.itemsize
    last = np.concatenate([[vocabulary], after[:-1]])[: len(after)]
    last[bounds[:-1][bounds[:-1] < bounds[1:]]] = vocabulary
    return last * (vocabulary + 1) + after, bounds


def count_bigrams(texts: DataFrame, vocabulary: int) -> DataFrame:
    """(bigram, target, background) of encoded texts (tokens, is_target): occurrences in target texts, and in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.argsort(keys, kind="stable")
            keys, n = keys[by], n[by]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else by
            return keys[first], np.add.reduceat(n, first) if len(first) else n

        for batch in batches:
            for part in slices(batch, "tokens", STEP_BYTES):
                keys, bounds = bigrams(part.column(0), vocabulary)
                target = np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds))
                held.append(np.unique(keys * 2 + target, return_counts=True))
                waiting += len(held[-1][0])
                if waiting > COMPACT:
                    held = [added()]
                    waiting = len(held[0][0]) // 2
        if held:
            keys, n = added()
            for at in range(0, len(keys), 100_000):
                k, c = keys[at : at + 100_000], n[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(k >> 1), pa.array(np.where(k & 1, c, 0)), pa.array(c)], ["bigram", "target", "background"])

    partial = texts.select("tokens", "is_target").mapInArrow(count, "bigram long, target long, background long")
    return partial.groupBy("bigram").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


class Words:
    """Counts of tokens and of contexts in both corpora: bounded by the vocabulary."""

    def __init__(self, counts: DataFrame, vocabulary: int) -> None:
        self.vocabulary = vocabulary
        of = {"token": F.col("bigram") % (vocabulary + 1), "context": F.floor(F.col("bigram") / (vocabulary + 1)).cast("long")}
        self.token, self.context = np.zeros((2, vocabulary + 1)), np.zeros((2, vocabulary + 1))
        for name, key in of.items():
            out = getattr(self, name)
            for r in counts.groupBy(key.alias("k")).agg(F.sum("target"), F.sum("background")).collect():
                out[:, r[0]] = r[1], r[2]
        total = self.token.sum(axis=1, keepdims=True)
        self.share = (self.token + TOKEN_WEIGHT) / (total + TOKEN_WEIGHT * (vocabulary + 1))

    def bits(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Loss in bits of each bigram in both models, for its counts in both."""
        context, token = keys // (self.vocabulary + 1), keys % (self.vocabulary + 1)
        return -np.log2((counts + CONTEXT_WEIGHT * self.share[:, token]) / (self.context[:, context] + CONTEXT_WEIGHT))


class Lookup:
    """A model in a task: known bigrams with their losses, and the word models for all others."""

    def __init__(self, keys: np.ndarray, losses: np.ndarray, model: Words) -> None:
        self.keys, self.losses, self.model = keys, losses, model

    def bits(self, keys: np.ndarray) -> np.ndarray:
        keys, place = np.unique(keys, return_inverse=True)
        if not len(self.keys):
            return self.model.bits(keys, np.zeros((2, len(keys))))[:, place]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = self.losses[:, at]
        new = np.flatnonzero(self.keys[at] != keys)
        out[:, new] = self.model.bits(keys[new], np.zeros((2, len(new))))
        return out[:, place]


def score(docs: DataFrame, target: Column | DataFrame, path: str, *, score_docs: DataFrame | None = None, broadcast: int = BROADCAST_BIGRAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Loss of each text in bits a token, and their difference: (id, n_tokens, target_bits, background_bits, difference).

    The target model counts the texts of docs where target holds, or whose ids are in the first column of target; the background model counts all of them; both have one
    vocabulary, the tokenizer's, one order and one smoothing: p(w | v) = (c(v w) + 16 p(w)) / (c(v) + 16), where
    p(w) = (c(w) + 0.5) / (N + 0.5 V). The lower the difference, target less background, the more a text is like target.
    Every text is encoded once, its token ids written to the shared folder; only they meet ids of target, never the texts.
    score_docs are scored, or else docs. Up to broadcast bigrams the model is broadcast, beyond that it is joined; losses
    are in double precision either way.

    Null and empty texts: 0 tokens, losses and difference 0. A null target is false. Repeated rows and ids, and null ids:
    each row counts and has a result. Very long texts are read whole. No rows: none come out. Further columns are left out.
    """
    spark, vocabulary = docs.sparkSession, vocabulary_of(path)
    by_id = isinstance(target, DataFrame)
    named = docs.select(col(id_col).alias("__id"), col(text_col).alias("__text"), *([] if by_id else [F.coalesce(target, F.lit(False)).alias("is_target")]))
    texts = encoded(named, "__text", [c for c in named.columns if c != "__text"], path, vocabulary)
    if by_id:
        ids = target.select(col(target.columns[0]).alias("__target")).distinct().withColumn("is_target", F.lit(True))
        texts = texts.join(ids.hint("shuffle_hash"), F.col("__id") == F.col("__target"), "left").select("__id", F.coalesce("is_target", F.lit(False)).alias("is_target"), "tokens")
    texts = staged(texts)
    counts = staged(count_bigrams(texts, vocabulary))
    model = Words(counts, vocabulary)
    if score_docs is not None:
        texts = encoded(score_docs.select(col(id_col).alias("__id"), col(text_col).alias("__text")), "__text", ["__id"], path, vocabulary)
    if counts.count() <= broadcast:
        rows = counts.orderBy("bigram").toArrow()
        keys, both = rows.column(0).to_numpy(), np.stack([rows.column(1).to_numpy(), rows.column(2).to_numpy()])
        shared = spark.sparkContext.broadcast(Lookup(keys, model.bits(keys, both), model))

        def make() -> Callable[[pa.Array], list[pa.Array]]:
            def each(tokens: pa.Array) -> list[pa.Array]:
                keys, bounds = bigrams(tokens, vocabulary)
                total = np.concatenate([np.zeros((2, 1)), np.cumsum(shared.value.bits(keys), axis=1)], axis=1)
                n = np.diff(bounds)
                sums = (total[:, bounds[1:]] - total[:, bounds[:-1]]) / np.maximum(n, 1)
                return [pa.array(n), pa.array(sums[0]), pa.array(sums[1])]

            return each

        losses = map_texts(texts, "tokens", ["__id"], LOSSES, make, STEP_BYTES)
    else:
        losses = joined_losses(texts, counts, model)
    return losses.withColumnRenamed("__id", id_col).withColumn("difference", F.col("target_bits") - F.col("background_bits"))


def joined_losses(texts: DataFrame, counts: DataFrame, model: Words) -> DataFrame:
    """Losses of encoded texts by a join of their bigrams with a model of any size. Equal texts are counted once."""
    vocabulary, shared = model.vocabulary, texts.sparkSession.sparkContext.broadcast(model)
    numbered = texts.select("__id", "tokens", F.sha2("tokens", 256).alias("__text_key"))

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        kind = pa.list_(pa.struct([("bigram", pa.int64()), ("n", pa.int64())]))

        def each(tokens: pa.Array) -> list[pa.Array]:
            keys, bounds = bigrams(tokens, vocabulary)
            out = []
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                own, n = np.unique(keys[start:stop], return_counts=True)
                out.append([{"bigram": k, "n": c} for k, c in zip(own.tolist(), n.tolist(), strict=True)])
            return [pa.array(np.diff(bounds)), pa.array(out, kind)]

        return each

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n, both = b.column(1).to_numpy(), b.column(2).to_numpy(), np.stack([b.column(3).to_numpy(), b.column(4).to_numpy()])
            bits = shared.value.bits(keys, both) * n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits[0]), pa.array(bits[1])], ["__text_key", "t", "b"])

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("grams", T.ArrayType(T.StructType([T.StructField("bigram", T.LongType()), T.StructField("n", T.LongType())])))]
    grams = staged(map_texts(numbered, "tokens", ["__id", "__text_key"], fields, make, STEP_BYTES))
    flat = grams.dropDuplicates(["__text_key"]).select("__text_key", F.explode("grams").alias("g")).select("__text_key", F.col("g.bigram").alias("bigram"), F.col("g.n").alias("n"))
    known = flat.join(counts, "bigram", "left").select("__text_key", "bigram", "n", F.coalesce("target", F.lit(0)).alias("target"), F.coalesce("background", F.lit(0)).alias("background"))
    sums = known.mapInArrow(losses, "__text_key string, t double, b double").groupBy("__text_key").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    each = lambda c: F.coalesce(F.col(c) / F.greatest(F.col("n_tokens"), F.lit(1)), F.lit(0.0))
    return grams.select("__id", "__text_key", "n_tokens").join(sums, "__text_key", "left").select("__id", "n_tokens", each("t").alias("target_bits"), each("b").alias("background_bits"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more like the documents of good quality than like all documents each document is."""
    import public_tokenizers

    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(table(spark, sf_dir, "documents"), good, public_tokenizers.path("byte_bpe_50k.json"))
