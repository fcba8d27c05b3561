"""Phrases against brute force and SQL."""

import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import collocations, common

SF = "/root/testdata/sf0.001"
DOCS = "lang string, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, most_words, least, top, inside):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            for m in range(1, most_words + 1):
                for i in range(len(words) - m + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, own in f.items():
        total = sum(n for p, n in own.items() if len(p) == 1)
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= inside * cand[p[i : i + m]]}
        rows_ = []
        for p, a in cand.items():
            if p not in gone:
                s, _, l, r = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                rows_.append((s, a, " ".join(p), l, r))
        rows_.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k + 1, p, a, l, r, total, s) for k, (s, a, p, l, r) in enumerate(rows_[:top])]
    return set(out)


def found(df):
    rows = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("most_words, least, top, inside", [(2, 2, 10_000, 50), (3, 3, 50, 50), (4, 2, 10_000, 90), (3, 1, 7, 0)])
def test_matches_brute_force(spark, most_words, least, top, inside):
    rng = np.random.default_rng(most_words * 10 + least)
    vocabulary = ["Ab", "ab", "é", "日本", "x y", "z", "É", "a\x01b"]
    joints = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ; "]
    text = lambda: "".join(str(rng.choice(vocabulary)) + str(rng.choice(joints, p=[0.6] + [0.05] * 8)) for _ in range(int(rng.integers(0, 60))))
    rows = [(["en", "de", None, "und"][i % 4], text()) for i in range(120)] + [("en", None), ("xx", ""), ("yy", " . "), (None, None)] + [("en", "to be or not to be, " * 30)] * 3
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x")).withColumn("words", F.lit(None).cast("string"))
    got = found(collocations.collocations(docs, most_words=most_words, least=least, top=top, inside=inside))
    assert got == brute(rows, most_words, least, top, inside)


def test_collisions_change_nothing(spark, monkeypatch):
    """Fingerprints of 5 bits: almost all phrases collide and pass."""
    rows = [("en", " ".join(f"w{(i * j) % 23}" for j in range(90))) for i in range(20)]
    rows += [("de", rows[3][1])]
    texts = pa.array([r[1] for r in rows]), pa.array([r[0] for r in rows])
    p = collocations.Phrases(texts[1], texts[0])
    for n in (1, 2, 3):
        at = p.places(n)
        first, times = collocations.pointed(p, at, p.prints(at, n) % np.uint64(5), n)
        words = p.words.to_pylist()
        lang = p.langs.to_pylist()
        got = Counter({(lang[p.lang[i]], *words[i : i + n]): int(t) for i, t in zip(first, times)})
        want = Counter((lang[p.lang[i]], *words[i : i + n]) for i in at.tolist())
        assert got == want and len(first) == len(want)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**15 - 1, 10**15, 10**15 + 7), (3, 10**15, 10**15), (10**12, 10**12, 10**12), (7, 7, 49)]
    df = spark.createDataFrame(rows, "a long, l long, r long").selectExpr("a", "l", "r", f"{collocations.SCORE} AS s")
    assert {tuple(r) for r in df.collect()} == {(a, l, r, 1000000 * a * a // (l * r)) for a, l, r in rows}


def test_empty_and_hard_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "")], DOCS)).count() == 0
    long = "alpha beta gamma delta " * 20_000
    got = found(collocations.collocations(spark.createDataFrame([("en", long), ("en", long)], DOCS)))
    assert got == brute([("en", long), ("en", long)], 3, 10, 2000, 50)


def test_op13_matches_sql_on_sf001(spark):
    sf = "/root/testdata/sf0.01"
    assert oracle.differences(collocations.op13_phrase_collocations(spark, sf), oracle.connection(sf), collocations.OP13_SQL) == ""


def test_fingerprints_tell_language_and_length():
    p = collocations.Phrases(pa.array(["en", "de"]), pa.array(["a a a", "a a a"]))
    keys = np.concatenate([p.prints(p.places(n), n) for n in (1, 2, 3)])
    assert len(set(keys.tolist())) == 6 and common.mixed(keys).dtype == np.uint64
