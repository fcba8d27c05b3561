"""Operator 9: language identification by family, then by one-versus-one linear support vector machines within a family."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_texts, table, text_bytes

#: Families of common language codes; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"),
}
FEATURES = 1 << 16
#: Bounds of the training sample: documents of each language, those that a family is told apart from, and bytes of a
#: document that can be in it.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_OF_OTHERS = 4_000
SAMPLE_TEXT_BYTES = 1 << 20
UNDETERMINED = "und"


def feature_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte bigrams, trigrams and 4-grams at every byte, as columns, and each text's byte offsets.

    A-Z are lower-cased; ASCII characters that aren't letters are all the same blank. No n-gram spans two texts: the
    bytes before a text count as blanks.
    """
    data, off = text_bytes(texts)
    to = np.full(256, 32, np.uint32)
    to[97:123] = np.arange(97, 123)
    to[65:91] = np.arange(97, 123)
    to[128:] = np.arange(128, 256)
    now = to[data]
    since = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    gram, out = now.copy(), []
    for n in (1, 2, 3):
        before = np.full(len(data), 32, np.uint32)
        before[n:] = now[:-n] if n < len(data) else before[n:]
        before[since < n] = 32
        gram = gram | (before << np.uint32(8 * n))
        out.append(((gram * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(33 - FEATURES.bit_length())).astype(np.int32))
    return np.stack(out), off


def has_letter(texts: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    letter = np.zeros(256, np.int64)
    letter[65:91] = letter[97:123] = 1
    total = np.concatenate([[0], np.cumsum(letter[data])])
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)).tolist():
        out[i] = any(map(str.isalpha, texts[i].as_py()))
    return out


class Frequencies:
    """Texts' features, frequencies of hashed n-grams, with those alone that a text has: number and value, text by text."""

    def __init__(self, texts: pa.Array) -> None:
        number, value, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [0]
        for i in range(len(texts)):
            numbers, off = feature_numbers(texts.slice(i, 1))
            found, n = np.unique(numbers, return_counts=True)
            number.append(found)
            value.append((n / max(1, off[-1])).astype(np.float32))
            ends.append(ends[-1] + len(found))
        self.number, self.value, self.ends = np.concatenate(number), np.concatenate(value), ends

    def scale(self) -> np.ndarray:
        """For each feature what brings it near to unit spread; 0 for those that are the same in all texts."""
        n = max(1, len(self.ends) - 1)
        mean, square = (np.bincount(self.number, x.astype(np.float64), FEATURES) / n for x in (self.value, self.value**2))
        spread = np.sqrt(np.maximum(square - mean * mean, 0))
        return np.where(spread > 0, 1 / np.sqrt(spread + 1e-6), 0).astype(np.float32)


@dataclass
class Machine:
    """A linear support vector machine over features of frequencies."""

    weights: np.ndarray
    bias: float


@dataclass
class Model:
    families: list[list[str]]
    first: list[Machine]  # one for each family against the others
    second: list[list[tuple[int, int, Machine]]] = field(default_factory=list)


def fitted(x: Frequencies, positive: np.ndarray, rounds: int = 12, c: float = 1.0) -> Machine:
    """Dual coordinate descent for the L2-regularised hinge loss; classes weigh alike."""
    y = np.where(positive, 1.0, -1.0)
    cost = np.where(positive, c * len(y) / (2 * max(1, positive.sum())), c * len(y) / (2 * max(1, (~positive).sum())))
    scale = x.scale()
    value = x.value * scale[x.number]
    rows = [(x.number[a:b], value[a:b].astype(np.float64)) for a, b in pairwise(x.ends)]
    norms = [float(v @ v) + 1 for _, v in rows]
    w, b, alpha, rng = np.zeros(FEATURES), 0.0, np.zeros(len(y)), np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(y)).tolist():
            at, v = rows[i]
            gradient = y[i] * (float(w[at] @ v) + b) - 1
            new = min(cost[i], max(0.0, alpha[i] - gradient / norms[i]))
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[at] += step * v
                b += step
                alpha[i] = new
    return Machine((w * scale).astype(np.float32), float(b))


def grouped(codes: list[str], families: dict[str, tuple[str, ...]]) -> list[list[str]]:
    """The languages of each family; those without one are families of their own."""
    family_of = {code: name for name, own in families.items() for code in own}
    groups: dict[str, list[str]] = {}
    for code in sorted(codes):
        groups.setdefault(family_of.get(code, f"={code}"), []).append(code)
    return list(groups.values())


def train(labelled: DataFrame, *, per_language: int = SAMPLE_PER_LANGUAGE, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """A model of labelled rows (id, text, lang), those with a null text or language left out.

    About per_language texts of each language are learnt from, taken evenly by a hash of id and text, and of the other
    families' texts about SAMPLE_OF_OTHERS for each family. Every machine is fitted in a task of its own, on rows that this
    bounds; the driver gets the machines' weights. Rows alike in all columns count as they stand. No rows: an empty model.
    """
    spark = labelled.sparkSession
    named = labelled.where("text is not null and lang is not null").where(F.octet_length("text").between(1, SAMPLE_TEXT_BYTES)).withColumn("at", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)))
    counts = {r[0]: r[1] for r in named.groupBy("lang").count().collect()}
    groups = grouped(list(counts), families)
    share = lambda code, most: min(1 << 20, -(-(most << 20) // counts[code]))
    wanted, second = [], []  # (machine, language, whether it is the positive class, share of its texts)
    for k, own in enumerate(groups):
        others = max(1, len(counts) - len(own))
        wanted += [(k, c, c in own, share(c, per_language if c in own else min(per_language, max(1, SAMPLE_OF_OTHERS // others)))) for c in counts]
    for own in groups:
        second.append([])
        for i, j in combinations(range(len(own)), 2):
            second[-1].append((i, j, len(groups) + sum(map(len, second))))
            wanted += [(second[-1][-1][2], own[p], p == i, share(own[p], per_language)) for p in (i, j)]
    if not wanted:
        return Model([], [])
    kind = T.StructType([T.StructField("machine", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("positive", T.BooleanType()), T.StructField("share", T.LongType())])
    rows = named.join(F.broadcast(spark.createDataFrame(wanted, kind)), "lang").where(F.col("at") < F.col("share")).select("machine", "positive", "at", "text")

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("at", "ascending"), ("text", "ascending")])
        machine = fitted(Frequencies(group.column("text").combine_chunks()), group.column("positive").to_numpy())
        return pa.table({"machine": group.column("machine")[:1], "weights": pa.array([machine.weights.tobytes()], pa.binary()), "bias": [machine.bias]})

    found = rows.groupBy("machine").applyInArrow(fit, "machine int, weights binary, bias double").collect()
    machines = {r.machine: Machine(np.frombuffer(r.weights, np.float32), r.bias) for r in found}
    none = Machine(np.zeros(FEATURES, np.float32), 0.0)  # no text of it was drawn
    of = lambda k: machines.get(k, none)
    return Model(groups, [of(k) for k in range(len(groups))], [[(i, j, of(k)) for i, j, k in own] for own in second])


def predictor(model: Model) -> Callable[[pa.Array], tuple[list[str], np.ndarray]]:
    first = np.stack([m.weights for m in model.first], 1)
    biases = np.array([m.bias for m in model.first])
    pairs = [(f, i, j, m) for f, own in enumerate(model.second) for i, j, m in own]

    def predict(texts: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = texts.fill_null("")
        numbers, off = feature_numbers(texts)
        sizes = np.maximum(np.diff(off), 1)

        def values(weights: np.ndarray, bias: float) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(sum(weights[row] for row in numbers), dtype=np.float64)])
            return (total[off[1:]] - total[off[:-1]]) / sizes + bias

        by_family = np.stack([values(first[:, k], biases[k]) for k in range(len(biases))], 1)
        family = by_family.argmax(1)
        votes = [np.zeros((len(texts), len(g))) for g in model.families]
        sure = [np.zeros((len(texts), len(g))) for g in model.families]
        for f, i, j, m in pairs:
            v = values(m.weights, m.bias)
            for k, margin in ((i, v), (j, -v)):
                votes[f][:, k] += margin > 0
                sure[f][:, k] += 1 / (1 + np.exp(-2 * margin))
        letters = has_letter(texts, *text_bytes(texts))
        out, score = [], np.zeros(len(texts))
        for r in range(len(texts)):
            if not letters[r]:
                out.append(UNDETERMINED)
                continue
            f = int(family[r])
            group = model.families[f]
            k = max(range(len(group)), key=lambda k: (votes[f][r, k], sure[f][r, k]))
            out.append(group[k])
            within = sure[f][r, k] / (len(group) - 1) if len(group) > 1 else 1.0
            score[r] = within / (1 + np.exp(-2 * by_family[r, f])) if len(model.families) > 1 else within
        return out, score

    return predict


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of whole texts: (id, lang_pred, score), one row per row of docs, without a shuffle.

    Null texts and texts without a letter: `und` with score 0; so are all if the model learnt from no rows. Repeated rows
    and ids, and null ids: each row has its own result. Very long texts are read whole. Further columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        predict = predictor(shared.value) if shared.value.families else lambda texts: ([UNDETERMINED] * len(texts), np.zeros(len(texts)))

        def each(texts: pa.Array) -> list[pa.Array]:
            languages, score = predict(texts)
            return [pa.array(languages, pa.string()), pa.array(score)]

        return each

    return map_texts(docs, text_col, [id_col], [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model of the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
