"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import variants

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(rows, typos):
    n = Counter()
    for i, text in rows:
        for run in map(lower, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typos and h % typos == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return n


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, letters, least, times, typos):
    n = {w: k for w, k in words_of(rows, typos).items() if len(w) >= letters and k >= least}
    by = defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    found = {w: [v for m in (-1, 0, 1) for v in by[len(w) + m] if near(w, v)] for w in n}
    form = {}
    for w, some in found.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return out


def check(spark, rows, letters, least, times, typos):
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("word", F.lit("clash")).withColumn("n", F.lit(None).cast("int"))
    got = variants.spelling_variants(docs, letters=letters, least=least, times=times, typos=typos).collect()
    want = brute(rows, letters, least, times, typos)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    return want


def test_op11_matches_brute_force_on_the_tables(spark):
    rows = oracle.connection(SF).execute("SELECT doc_id, text FROM documents").fetchall()
    want = brute(rows, 6, 5, 5, 199)
    got = variants.op11_spelling_variants(spark, SF).collect()
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == want and len(got) == len(want)
    check(spark, rows, 4, 1, 2, 7)


def test_all_words_of_the_tables_match_an_index_of_gaps(spark):
    rows = oracle.connection(SF).execute("SELECT doc_id, text FROM documents").fetchall()
    n = {w: k for w, k in words_of(rows, 7).items() if len(w) >= 4}
    gaps = defaultdict(set)  # words that are these two parts, with a letter between them or none
    for w in n:
        for i in range(len(w) + 1):
            gaps[w[:i], w[i:]].add(w)
            gaps[w[:i], w[i + 1 :]].add(w)
    found = {w: set() for w in n}
    for some in gaps.values():
        for w in some:
            found[w] |= some - {w}
    form = {w: min(found[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v and n[v] >= 2 * n[w] else None for w, v in form.items()}
    want = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        want.add((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = variants.spelling_variants(docs, letters=4, least=1, times=2, typos=7).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)


def test_dense_neighbourhoods_ties_and_chains(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abÿ"), size=int(rng.integers(1, 6)))) for _ in range(800)]
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    check(spark, rows, 1, 1, 2, 0)
    check(spark, rows, 2, 2, 3, 5)
    # a chain of forms, each ten times as frequent as the one before
    chain = [("aaaaab", 1), ("aaaabb", 10), ("aaabbb", 100), ("aabbbb", 1000), ("abbbbb", 10000)]
    found = check(spark, [(7, " ".join(" ".join([w] * k) for w, k in chain))], 6, 1, 5, 0)
    assert {r[2] for r in found} == {"abbbbb"}


def test_long_words_nulls_and_repeats(spark):
    base = "abcdefghij" * 7
    long = [base[:63], base[:64], base[:65], base[:66], base[:67], base[:30] + "x" + base[31:66], base[:30] + "y" + base[31:66], "x" + base[:64], base[:64] + "x", "aa" * 33, "aa" * 33 + "a", "é" * 64, "é" * 65, "é" * 66, base * 300, "z" + base * 300]
    rows = [(i, w) for i, w in enumerate(long)] + [(90, " ".join(long[3:9])), (91, None), (92, ""), (None, base), (None, "1 2 ÷ × ÀÉ"), (93, base[:65]), (93, base[:65])]
    check(spark, rows, 1, 1, 2, 0)
    check(spark, rows, 3, 1, 2, 2)
    assert variants.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, None)], DOCS)).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame([], DOCS), times=1)


def test_checksums_are_the_librarys():
    ids, runs = ["1", "", "999999"], [b"a", "é".encode() * 20, b"b" * 64, b"c" * 65, b"d" * 3000]
    row, codes = np.repeat(np.arange(3), 5), np.tile(np.arange(5), 3)
    want = [zlib.crc32(ids[r].encode() + b":" + runs[c]) for r, c in zip(row, codes)]
    assert variants.checksums(ids, row, codes, runs).tolist() == want


def test_runs_end_at_other_letters_and_texts():
    got, per_text = variants.runs(pa.array(["Straße łódź-ÀB", None, "", "a", "b1cĀd"]))
    assert got.to_pylist() == ["straße", "ód", "Àb", "a", "b", "c", "d"] and per_text.tolist() == [0, 3, 3, 3, 4, 7]
