"""Balanced splits and running totals."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import running, splits

COMPONENT = "component string, source string, stratum string, size long"


def test_quotas_are_met_within_one_component(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", f"s{min(i % 7, 3)}", rng.choice(["x", "y", None]), rng.choice([1, 1, 2, 3, 9, 40])) for i in range(400)] + [("big", "s9", "x", 500), ("n", "none", "x", 3)]
    quotas = [("s0", 100), ("s1", 37), ("s2", 10**6), ("s3", 0), ("s9", 499), ("s8", 5), ("s0", None)]
    got = splits.balanced_split(spark.createDataFrame(rows, COMPONENT), spark.createDataFrame(quotas, "source string, quota long")).collect()
    assert sorted((r.component, r.size) for r in got) == sorted((r[0], r[3]) for r in rows)
    chosen, left = Counter(), defaultdict(list)
    for r in got:
        if r.chosen:
            chosen[r.source] += r.size
        else:
            left[r.source].append(r.size)
    want = {"s0": 100, "s1": 37, "s2": 10**6, "s3": 0, "s9": 499, "none": 0}
    for source, quota in want.items():
        assert chosen[source] <= quota and (not left[source] or min(left[source]) > quota - chosen[source])
    assert not left["s2"]
    strata = Counter((r.stratum, r.chosen) for r in got if r.source == "s3")
    assert all(not c for _, c in strata)


def test_strata_keep_their_shares(spark):
    rows = [(f"c{i}", "s", "x" if i % 4 else "y", 1) for i in range(1000)]
    got = splits.balanced_split(spark.createDataFrame(rows, COMPONENT), spark.createDataFrame([("s", 200)], "source string, quota long"))
    assert {r.stratum: r.n for r in got.where("chosen").groupBy("stratum").agg(F.count("*").alias("n")).collect()} == {"x": 150, "y": 50}


def test_components_have_one_source(spark):
    df = lambda *r: spark.createDataFrame(list(r), "c string, source string, t string")
    found = splits.components_of(df(("a", "s", "y"), ("a", "s", "x"), ("b", "s", None), ("b", "s", None), ("b", "s", "z")), "c", "source", "t")
    assert {tuple(r) for r in found.collect()} == {("a", "s", "x", 2), ("b", "s", None, 3)}
    for bad in (df(("a", "s", "x"), ("a", "r", "x")), df(("a", None, "x")), df(("a", None, "x"), ("a", "s", "x"))):
        with pytest.raises(Exception, match="not of one source"):
            splits.components_of(bad, "c", "source", "t").count()
    assert splits.balanced_split(df().select(F.col("c").alias("component"), "source", F.col("t").alias("stratum"), F.lit(1).cast("long").alias("size")), spark.createDataFrame([], "source string, quota long")).count() == 0


def test_running_totals_go_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, 1, 2, -3])) for i in range(500)]
    rng.shuffle(rows)
    got = running.running_total(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"], "v", "upto").collect()
    total, want = Counter(), {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        total[g] += v or 0
        want[i] = total[g]
    assert {r.i: r.upto for r in got} == want and len(got) == 500
