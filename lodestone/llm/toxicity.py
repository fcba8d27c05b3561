"""Operator 7: toxicity by two Kneser-Ney models, of toxic and of ordinary text, that share their backoff.

A text is judged by its log-likelihoods under both, each divided by the number of words: over the whole text, and over the
stretches of two to sixteen words in which it is most like toxic text, as a rude sentence hides in a long text's mean.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_LOWER, STEP, coded, filter_texts, hashed, held_out, map_texts, mixed, slices, table, words

#: Bounds of the training sample: labelled documents of each class, and bytes of a document that can be in it.
SAMPLE_PER_CLASS = 2_500
SAMPLE_TEXT_BYTES = 1 << 20
#: What cross-validation within the training sample chooses from: contexts that a bigram's backoff counts for.
CONTEXT_WEIGHTS = (1_000.0, 30_000.0, 1_000_000.0)
#: Words over which log-likelihoods are compared: the best stretch of so many, and the whole text.
LENGTHS = (2, 4, 8, 16, None)
FOLDS = 3
USUAL_DISCOUNT = 0.75  # where counts of counts say nothing
THRESHOLD = 0.7
CURVE_ROWS = 3  # of each class


@dataclass
class Model:
    """Log-likelihood ratios, toxic to ordinary, of bigrams and of the words to which all others back off; how texts are scored by them."""

    bigrams: np.ndarray
    bigram_ratio: np.ndarray
    words: np.ndarray
    word_ratio: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(LENGTHS)))  # of a text's value at each length
    offset: float = 0.0


def lookup(keys: np.ndarray, known: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of keys, 0 for those that aren't known, and which are known."""
    if not len(known):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    found = known[at] == keys
    return np.where(found, value[at], 0.0), found


def aligned(known: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(known))
    out[np.searchsorted(known, keys)] = counts
    return out


def keys_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array, per_text, _ = words(texts, ALNUM_LOWER)
    codes, distinct = coded(array)
    return hashed(distinct)[codes] if len(codes) else np.zeros(0, np.uint64), per_text


class Sample:
    """Labelled texts as the keys of their words, one text after another: far less than the texts with all that splits them."""

    def __init__(self, keys: np.ndarray, per_text: np.ndarray, toxic: np.ndarray) -> None:
        self.keys, self.per_text, self.toxic = keys, per_text, toxic

    @staticmethod
    def of(texts: pa.Array, toxic: np.ndarray) -> Sample:
        parts = [keys_of(part.column(0)) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", 1 << 20)]
        n = np.concatenate([np.diff(p) for _, p in parts]) if parts else np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
        return Sample(keys, np.concatenate([[0], np.cumsum(n)]), np.asarray(toxic, bool))

    def only(self, rows: np.ndarray) -> Sample:
        """The rows where rows is true."""
        n = np.diff(self.per_text)
        return Sample(self.keys[np.repeat(rows, n)], np.concatenate([[0], np.cumsum(n[rows])]), self.toxic[rows])


def discount(counts: np.ndarray) -> float:
    """Kneser and Ney's: from how many things were counted once and twice. Always under 1, so that what was seen once tells something."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else USUAL_DISCOUNT


class Counts:
    """What a class's texts count, by the number of distinct contexts, for both classes (toxic, ordinary).

    A word counts as often as there are words that it follows, a bigram likewise, so copies of a text and words that are
    repeated over and over weigh no more than one.
    """

    def __init__(self, sample: Sample) -> None:
        sides = []
        for side in (True, False):
            own = sample.only(sample.toxic == side)
            last, before = (np.concatenate([np.zeros(back, np.uint64), own.keys])[: len(own.keys)] for back in (1, 2))
            first = own.per_text[:-1][np.diff(own.per_text) > 0]
            last[first] = before[first] = 0
            before[first[first + 1 < len(before)] + 1] = 0  # a second word has one word before it, or is the next text's first
            pair = mixed(last + STEP) + own.keys
            kept = np.unique(mixed(mixed(before + STEP) + last) + own.keys, return_index=True)[1]  # each trigram once
            del before
            pair, last, now = pair[kept], last[kept], own.keys[kept]
            kinds, at, n = np.unique(pair, return_index=True, return_counts=True)
            sides.append((kinds, n, last[at], now[at], np.unique(last, return_counts=True)))
        self.vocabulary = np.unique(np.concatenate([s[3] for s in sides]))
        self.words = [aligned(self.vocabulary, *np.unique(s[3], return_counts=True)) for s in sides]
        contexts = np.unique(np.concatenate([s[4][0] for s in sides]))
        self.contexts = [aligned(contexts, *s[4]) for s in sides]
        self.bigrams, where = np.unique(np.concatenate([s[0] for s in sides]), return_index=True)
        firsts, seconds = (np.concatenate([s[i] for s in sides])[where] for i in (2, 3))
        self.at_context, self.at_word = (np.searchsorted(x, y).astype(np.int32) for x, y in ((contexts, firsts), (self.vocabulary, seconds)))
        self.pairs = [aligned(self.bigrams, *s[:2]).astype(np.float32) for s in sides]

    def parts(self, context_weight: float) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Both classes' word distributions and discounted shares of bigrams, and the backoff's weight in each context.

        A class's p(word | context) is (1 - weight) x share + weight x p(word). Discounts are those that the class's own
        counts of counts give. Both classes back off to one word distribution, of the counts that discounting took off in
        either class, and with one weight for each context: that of the class which knows it less. So what neither class
        has seen often has a ratio near 1, however unlike the classes' sizes are, and every further context moves it.
        """
        off = [discount(n) for n in self.words]
        shared = sum(np.minimum(n, d) for n, d in zip(self.words, off, strict=True))
        shared = shared / max(shared.sum(), 1e-300)
        unigram, rest = [], 1.0
        for n, d in zip(self.words, off, strict=True):
            own = np.maximum(n - d, 0)
            rest = min(rest, own.sum() / (n.sum() + 1))
            unigram.append(own / max(own.sum(), 1e-300))
        rest = 1 - rest
        unigram = [(1 - rest) * u + rest * shared for u in unigram]
        weight, shares = np.zeros(len(self.contexts[0])), []
        for grams, first in zip(self.pairs, self.contexts, strict=True):
            n = np.maximum(grams - discount(grams), 0)
            mass = np.bincount(self.at_context, n, len(first))
            weight = np.maximum(weight, 1 - mass / (first + context_weight))
            shares.append(n / np.maximum(mass, 1e-300)[self.at_context])
        return unigram, shares, weight

    def smoothed(self, context_weight: float) -> Model:
        """Interpolated Kneser-Ney models of both classes, as the logarithms of their ratio."""
        unigram, shares, weight = self.parts(context_weight)
        back = weight[self.at_context]
        logs = [np.log((1 - back) * n + back * u[self.at_word]) for n, u in zip(shares, unigram, strict=True)]
        ratio = (logs[0] - logs[1]).astype(np.float32)
        single = np.log(unigram[0] / unigram[1]).astype(np.float32)
        telling = np.abs(ratio - single[self.at_word]) > 1e-3  # all others have what backing off gives
        return Model(self.bigrams[telling], ratio[telling], self.vocabulary, single)


def fit_ratios(sample: Sample, context_weight: float = CONTEXT_WEIGHTS[1]) -> Model:
    """The smoothed models of both classes' texts."""
    return Counts(sample).smoothed(context_weight)


def ratios(model: Model, keys: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Each word's log-likelihood ratio after the word before it."""
    ratio, _ = lookup(keys, model.words, model.word_ratio)
    if len(keys) > 1:
        inside = np.ones(len(keys) - 1, bool)
        ends = per_text[1:-1]
        inside[ends[(ends > 0) & (ends < len(keys))] - 1] = False
        whole, known = lookup(mixed(keys[:-1] + STEP) + keys[1:], model.bigrams, model.bigram_ratio)
        ratio[1:] = np.where(inside & known, whole, ratio[1:])
    return ratio


def means(ratio: np.ndarray, per_text: np.ndarray, size: int | None) -> np.ndarray:
    """Each text's highest mean over stretches of size words, or its whole mean for none; 0 without words."""
    out, starts, n = np.zeros(len(per_text) - 1), per_text[:-1], np.diff(per_text)
    if not len(ratio):
        return out
    total = np.concatenate([[0], np.cumsum(ratio)])
    if size is None:
        return (total[per_text[1:]] - total[starts]) / np.maximum(n, 1)
    row = np.repeat(np.arange(len(n)), n)
    end = np.minimum(np.arange(len(ratio)) + size, per_text[1:][row])
    begin = np.maximum(end - size, starts[row])
    some = np.flatnonzero(n)
    out[some] = np.maximum.reduceat((total[end] - total[begin]) / (end - begin), starts[some])
    return out


def compared(model: Model, keys: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Each text's toxic log-likelihood less its ordinary one, a word, over its best stretch of each length and over all of it."""
    ratio = ratios(model, keys, per_text)
    return np.stack([means(ratio, per_text, n) for n in LENGTHS], 1)


def chosen(sample: Sample) -> tuple[Model, np.ndarray]:
    """The model of all rows by the settings whose cross-validated curve loses least, and the rows' values in the folds that left them out."""
    fold = np.arange(len(sample.toxic)) % FOLDS
    tried = {s: np.zeros((len(fold), len(LENGTHS))) for s in CONTEXT_WEIGHTS}
    for k in range(FOLDS):  # a fold's counts go with it
        counts, own = Counts(sample.only(fold != k)), sample.only(fold == k)
        for settings, values in tried.items():
            values[fold == k] = compared(counts.smoothed(settings), own.keys, own.per_text)
        del counts
    at = min(tried, key=lambda s: loss(tried[s], sample.toxic))
    return fit_ratios(sample, at), tried[at]


def curve(model: Model, values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values @ model.weights + model.offset, -30, 30)))


def loss(values: np.ndarray, toxic: np.ndarray) -> float:
    """Log loss of a curve through values, with both classes weighing alike."""
    none = np.zeros(0)
    p = np.clip(curve(calibrated(Model(none, none, none, none), values, toxic), values), 1e-9, 1 - 1e-9)
    return sum(float(-np.log(x).mean()) for x in (p[toxic], 1 - p[~toxic]) if len(x))


def calibrated(model: Model, values: np.ndarray, toxic: np.ndarray) -> Model:
    """A logistic curve through the values of rows on which the model wasn't fitted; both classes weigh alike.

    A curve needs CURVE_ROWS rows of each class, and must rise with what it is for: with fewer, or if toxic rows don't
    stand higher than others, all scores are 0.5, so that nothing is called toxic on no evidence.
    """
    model.weights, model.offset = np.zeros(values.shape[1]), 0.0
    if min(toxic.sum(), (~toxic).sum()) < CURVE_ROWS or (values[toxic].mean(0) <= values[~toxic].mean(0)).all():
        return model
    weight = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean())) / len(toxic)
    center, spread = values.mean(0), values.std(0) + 1e-9
    z = np.concatenate([(values - center) / spread, np.ones((len(values), 1))], axis=1)
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-3] * values.shape[1] + [1e-9])
    for _ in range(200):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (p - toxic)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    if (z[toxic] @ w).mean() > (z[~toxic] @ w).mean():
        model.weights = w[:-1] / spread
        model.offset = float(w[-1] - center @ model.weights)
    return model


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the rows of docs that labels (id, label) marks; null texts, ids and labels are left out.

    About per_class rows of each class come to the driver, drawn evenly from labels by a hash of the id: this bounds the
    model and what is broadcast. The drawn ids, 4 x per_class at most, are broadcast to find their texts, so no text is
    shuffled. Cross-validation among them chooses the settings, and the curve from ratios to scores goes through the
    values of the folds that left a row out; all of them fit the counts.
    """
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{label_col}`") == 1).alias("toxic")).where("id is not null and toxic is not null").distinct()
    marks = marks.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(1 << 20)))
    counts = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    share = lambda side: min(1 << 20, -(-(per_class << 20) // counts.get(side, 1)))
    drawn = marks.where(F.col("at") < F.when(F.col("toxic"), share(True)).otherwise(share(False))).orderBy("at", "id").limit(4 * per_class)
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    found = named.join(F.broadcast(drawn), "id").where("text <> ''").select("at", "text", "toxic").toArrow().sort_by([("at", "ascending"), ("text", "ascending")])
    sample = Sample.of(found.column("text").combine_chunks(), found.column("toxic").to_numpy())
    del found
    pa.default_memory_pool().release_unused()
    model, values = chosen(sample)
    return calibrated(model, values, sample.toxic)


def score_of(model: Model, texts: pa.Array) -> np.ndarray:
    return curve(model, compared(model, *keys_of(texts)))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxicity of whole texts: (id, score), one row per row of docs, without a shuffle.

    Null texts, empty texts and texts without words have the score of a log-likelihood ratio of 0. Repeated rows and ids,
    and null ids: each row has its own result. Very long texts are read whole. Further columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    make = lambda: lambda texts: [pa.array(score_of(shared.value, texts))]
    return map_texts(docs, text_col, [id_col], [T.StructField("score", T.DoubleType())], make)


def without_toxic(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is under threshold; a score of just threshold goes.

    Null and empty texts and texts without words have the score of a log-likelihood ratio of 0. Repeated rows are judged
    alike. No rows: none come out. Columns may have any names, dots included.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, text_col, lambda: lambda texts: score_of(shared.value, texts) < threshold)


def trained(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the labelled documents outside the held-out fold."""
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model of the labelled documents outside the held-out fold."""
    scored = score(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
