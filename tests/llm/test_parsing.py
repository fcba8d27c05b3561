"""Removal of repeated byte strings against brute force."""

import hashlib

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, parsing

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def brute(rows, window):
    """(id, n_bytes, runs of removed bytes, kept) of each row, with distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for x in range(len(data) - window + 1):
            if (s := data[x : x + window]) in seen:
                gone[x : x + window] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[i] = (len(data), [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])], bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


def found(df):
    return {r.doc_id: (r.n_bytes, [(s.start, s.bytes) for s in r.removed], bytes(r.kept)) for r in df.collect()}


def test_op12_matches_brute_force_on_the_tables(spark):
    rows = oracle.connection(SF).execute("SELECT doc_id, text FROM documents").fetchall()
    got = parsing.op12_suffix_array_dedup(spark, SF).collect()
    want = {i: (n, sum(b for _, b in runs), len(runs), hashlib.sha256(kept).hexdigest()) for i, (n, runs, kept) in brute(rows, 100).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("entries, bucket, window, trigger", [(1 << 12, 1 << 14, 12, 3), (1 << 12, 3, 12, 3), (2, 3, 12, 3), (2, 2, 5, 2), (4, 9, 20, 2)])
def test_shared_and_wide_triggers(spark, entries, bucket, window, trigger):
    """Few letters, so that triggers are shared by many entries; runs of one byte; multibyte letters; copies over partitions and slices."""
    rng = np.random.default_rng(entries + window)
    rows = [(i, "".join(rng.choice(list("abé "), size=int(rng.integers(0, 160))))) for i in range(60)]
    passage = "".join(rng.choice(list("abcdefgh"), size=90))
    rows += [(100 + i, rows[i][1][:40] + passage[i % 7 : 80] + rows[i][1][40:]) for i in range(40)]
    rows += [(200 + i, rows[3][1]) for i in range(9)] + [(300, "a" * 500), (301, "b" + "a" * 300), (302, "ab" * 200), (303, None), (304, ""), (305, "日本語" * 40)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert found(parsing.without_repeats(docs, window=window, trigger=trigger, entries=entries, bucket=bucket)) == brute(rows, window)


def test_hard_rows_and_clashing_names(spark):
    text = "".join(map(str, range(100)))
    rows = [(1, text), (1, text), (1, text + "x"), (None, text), (None, None), (2, "short"), (3, text * 40)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit(7)).withColumn("spans", F.lit("x")).withColumn("hash", F.lit(None).cast("string"))
    got = parsing.without_repeats(docs).select("doc_id", "n_bytes", F.length("kept").alias("left")).collect()
    n = len(text)
    assert sorted((r.doc_id or 0, r.n_bytes, r.left) for r in got) == sorted([(0, n, n), (0, 0, 0), (1, n, 0), (1, n, 0), (1, n + 1, 1), (2, 5, 5), (3, 40 * n, 0)])
    assert parsing.without_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        parsing.without_repeats(docs, window=10, trigger=4)


def test_suffix_ranks_order_windows():
    data = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    for window in (1, 2, 3, 4, 5, 7, 9, 11):
        places = np.arange(len(data) - window + 1)
        own = [bytes(data[p : p + window]) for p in places]
        rank = parsing.ranks(data, window, places)
        assert [own[i] for i in np.argsort(rank, kind="stable")] == sorted(own)
        assert len(set(rank.tolist())) == len(set(own))


def test_a_key_filter_misses_no_key(spark):
    keys = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 5000)
    f = common.key_filter(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert f.has(keys.view(np.uint64)).all()
    assert f.has(np.random.default_rng(6).integers(0, 2**63 - 1, 5000).astype(np.uint64) * np.uint64(2)).mean() < 0.2
    empty = common.key_filter(spark.createDataFrame([], "key long"))
    assert not empty.has(keys.view(np.uint64)).any()
