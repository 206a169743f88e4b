"""Statistics, ranks, comparisons and histograms against plain arithmetic."""

from __future__ import annotations

import math
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlens.operators import stats

VALUES = st.lists(st.integers(-6, 6).map(lambda x: x / 2), max_size=40)


def frame(spark, values, label=0):
    return spark.createDataFrame([(float(v) if v is not None else None, label) for v in values], "x double, label int")


def one(df):
    return df.first().asDict()


def test_conventions(spark):
    df = frame(spark, [1, 2, 3, 10])
    math_ = one(df.agg(*stats.stats_number("x")))
    code = one(df.agg(*stats.stats_code("x")))
    word = one(df.agg(*stats.stats_word(F.col("x"), F.col("x"), F.col("x"))))
    assert (math_["n"], math_["mean"], math_["median"]) == (4, 4.0, 2.0)
    assert math_["std"] == pytest.approx(3.5355339059) == code["std"]
    assert code["median"] == word["median"] == 2.5
    assert word["std"] == pytest.approx(4.0824829046)
    assert code["positive_mean"] == 4.0 and code["positive_median"] == 2.5


def test_few_values(spark):
    single = one(frame(spark, [5.0]).agg(*stats.stats_word(F.col("x"), F.col("x"), F.col("x"))))
    assert single["std"] == 0.0
    none = one(frame(spark, [None, float("nan"), float("inf")]).agg(*stats.stats_code("x")))
    assert none["n"] == 0 and none["mean"] is None and none["positive_mean"] is None
    low = one(frame(spark, [-1.0]).agg(*stats.stats_code("x")))
    assert low["positive_mean"] is None and low["frac_positive"] == 0


def test_groups(spark):
    df = spark.createDataFrame([(1.0, "a", None), (2.0, "b", "L1"), (4.0, "b", "L1")], "x double, type string, level string")
    got = {(r["grouping"], r["key"]): (r["n"], r["mean"]) for r in stats.by_groups(df, "x", ["type", "level"]).collect()}
    assert got == {("all", None): (3, pytest.approx(7 / 3)), ("type", "a"): (1, 1.0), ("type", "b"): (2, 3.0), ("level", "None"): (1, 1.0), ("level", "L1"): (2, 3.0)}


def test_group_means_weighted_give_the_total(spark):
    df = spark.range(500).selectExpr("cast(sin(id) as double) as x", "cast(id % 7 as string) as type", "cast(id % 3 as string) as level")
    rows = stats.by_groups(df, "x", ["type", "level"]).collect()
    total = next(r for r in rows if r["grouping"] == "all")
    for g in ("type", "level"):
        own = [r for r in rows if r["grouping"] == g]
        assert sum(r["n"] for r in own) == total["n"]
        assert sum(r["n"] * r["mean"] for r in own) / total["n"] == pytest.approx(total["mean"])


@settings(max_examples=15, deadline=None)
@given(VALUES, VALUES)
def test_auc(spark, old, new):
    both = frame(spark, old, 1).unionByName(frame(spark, new, 0))
    got = one(stats.auc(both, "x", "label", 5))["auc"]
    if not old or not new:
        assert got is None
        return
    want = np.mean([(a > b) + (a == b) / 2 for a in old for b in new])
    assert got == pytest.approx(want)
    swapped = one(stats.auc(both.withColumn("label", 1 - F.col("label")), "x", "label", 5))["auc"]
    assert got + swapped == pytest.approx(1)


@settings(max_examples=10, deadline=None)
@given(VALUES)
def test_ranks(spark, values):
    got = {r["value"]: (r["times"], r["rank"]) for r in stats.tie_ranks(frame(spark, values), "x", 4).collect()}
    order = sorted(values)
    for v in set(values):
        at = [i + 1 for i, x in enumerate(order) if x == v]
        assert got[v] == (len(at), sum(at) / len(at))


def test_known_ranks_and_auc(spark):
    assert {r["value"]: r["rank"] for r in stats.tie_ranks(frame(spark, [1, 2, 2, 3]), "x").collect()} == {1: 1, 2: 2.5, 3: 4}
    both = frame(spark, [1, 2, 2, 5], 1).unionByName(frame(spark, [0, 2, 3], 0))
    assert one(stats.auc(both, "x", "label"))["auc"] == pytest.approx(0.5833333333)


@settings(max_examples=10, deadline=None)
@given(VALUES, VALUES)
def test_cohens_d(spark, old, new):
    both = frame(spark, old, 1).unionByName(frame(spark, new, 0))
    got = one(stats.cohens_d(both, "x", "label"))["cohens_d"]
    if len(old) < 2 or len(new) < 2:
        assert got is None
        return
    pooled = math.sqrt(((len(old) - 1) * statistics.variance(old) + (len(new) - 1) * statistics.variance(new)) / (len(old) + len(new) - 2))
    assert got is None if pooled == 0 else got == pytest.approx((np.mean(old) - np.mean(new)) / pooled)


def test_published_moments_agree(spark):
    """Cohen's d from published counts, deviations and means, with samples made to have them."""

    def sample(n, mean, std):
        x = np.arange(n, dtype=float)
        return ((x - x.mean()) / x.std(ddof=1) * std + mean).tolist()

    both = frame(spark, sample(1322, 4.43447, 3.91289), 1).unionByName(frame(spark, sample(1408, 1.12755, 2.72808), 0))
    assert one(stats.cohens_d(both, "x", "label"))["cohens_d"] == pytest.approx(0.985822, abs=1e-5)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-50, 50)), min_size=1, max_size=80), st.sampled_from([10, 10_000]))
def test_exact_median(spark, rows, accuracy):
    df = spark.createDataFrame([(k, float(v)) for k, v in rows], "k int, x double")
    got = {r["k"]: r["median"] for r in stats.exact_median(df, "x", ["k"], accuracy).collect()}
    assert got == {k: statistics.median(v for j, v in rows if j == k) for k, _ in rows}


def test_exact_median_of_many(spark):
    df = spark.range(20_001).selectExpr("cast(id * 7919 % 20011 as double) as x")
    assert one(stats.exact_median(df, "x", [], 100))["median"] == one(df.agg(F.median("x").alias("m")))["m"]


ODD = [0.0, -0.0, 5e-324, 1e-323, -5e-324, 2.2e-308, 1.0, 1 + 2**-52, 1 + 2**-51, 1 + 2**-50, 2.0, math.nextafter(2, 0), -1.0, -1 - 2**-52, 1.7976931348623157e308, -1.7976931348623157e308, 1e300, 3.0, 1e-200]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, None]), st.sampled_from(ODD) | st.floats(-1e6, 1e6) | st.none()), min_size=1, max_size=60))
def test_medians_of_groups(spark, rows):
    """Neighbouring, subnormal and the largest doubles, null keys and groups without values."""
    df = spark.createDataFrame(rows, "k int, x double")
    above = F.when(F.col("x") > 0, F.col("x"))
    for lower, median in ((True, statistics.median_low), (False, lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2)):
        out = stats.grouped(df, ["k"], [F.count("x").alias("n"), F.lit(None).cast("double").alias("m"), F.lit(None).cast("double").alias("p")], {"m": F.col("x"), "p": above}, lower)
        own = {k: [x for j, x in rows if j == k and x is not None] for k, _ in rows}
        want = {k: (len(v), median(v) if v else None, median([x for x in v if x > 0]) if any(x > 0 for x in v) else None) for k, v in own.items()}
        assert {r["k"]: (r["n"], r["m"], r["p"]) for r in out.collect()} == {k: v if all(x is None or math.isfinite(x) for x in v) else pytest.approx(v) for k, v in want.items()}


def test_medians_hold_no_group_in_a_task(spark):
    """``percentile`` counts all values of a group in one task, however large it is."""
    df = spark.range(1000).selectExpr("cast(id * 7919 % 1009 as double) as x", "cast(id % 3 as string) as k", "cast(id % 3 as int) as _label")
    plan = lambda out: out._jdf.queryExecution().executedPlan().toString()
    by = [stats.by_groups(df, "x", ["k"], s) for s in (stats.stats_number, stats.stats_code)]
    of = stats.stats_word(F.col("x"), F.col("x"), F.col("x"))
    for out in [*by, stats.grouped(df, [], of, stats.medians_of(F.col("x"))), stats.compare(df.drop("_label"), df.drop("_label"), "x", of, stats.medians_of(F.col("x")))]:
        assert not any(x in plan(out).lower() for x in ("percentile", "median(")) and "ObjectHashAggregate" not in plan(out)
    for out, s in zip(by, (stats.stats_number, stats.stats_code), strict=True):
        whole = {None: one(df.agg(*s("x")))} | {r["k"]: {c: v for c, v in r.asDict().items() if c != "k"} for r in df.groupBy("k").agg(*s("x")).collect()}
        got = {r["key"]: {c: v for c, v in r.asDict().items() if c not in ("grouping", "key")} for r in out.collect()}
        assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k]) for k in got)


def test_exact_median_moves_counts_only(spark):
    """Rows aren't dealt by group, which would be one task a group; a group without values has a null median."""
    df = spark.range(3000).selectExpr("if(id % 3 = 2, null, cast(id % 3 as string)) as k", "if(id % 3 = 1, null, cast(id * 7919 % 30011 as double)) as x")
    out = stats.exact_median(df, "x", ["k"])
    assert not any(x in out._jdf.queryExecution().executedPlan().toString().lower() for x in ("sortmergejoin", "percentile", "median("))
    want = lambda r: statistics.median(float(i * 7919 % 30011) for i in range(r, 3000, 3))
    assert {r["k"]: r["median"] for r in out.collect()} == {"0": want(0), "1": None, None: want(2)}


def test_compare(spark):
    rows = [(2.0, -1.0, -3.0), (4.0, -2.0, -6.0)]
    df = spark.createDataFrame(rows, "score double, orig_logp double, sub_logp double")
    out = one(stats.compare(df, df.limit(1), "score", stats.stats_word(F.col("score"), F.col("orig_logp"), F.col("sub_logp"))))
    assert out["difference_mean_old_minus_new"] == 1.0
    assert out["old"]["mean"] == out["old"]["mean_orig_logp"] - out["old"]["mean_sub_logp"]
    assert out["cohens_d_old_minus_new"] is None


def bins(df, *args, **kw):
    return [(r["bin"], r["value"]) for r in stats.histogram(df, ["x"], *args, **kw).orderBy("bin").collect()]


def test_histogram(spark):
    assert [v for _, v in bins(frame(spark, [0, 5, 10]), 4)] == [1, 0, 1, 1]
    values = [0.1 * i * i for i in range(50)] + [None]
    want, _ = np.histogram([v for v in values if v is not None], 7)
    assert [v for _, v in bins(frame(spark, values), 7)] == want.tolist()
    dense, _ = np.histogram([v for v in values if v is not None], 7, density=True)
    assert [v for _, v in bins(frame(spark, values), 7, density=True)] == pytest.approx(dense.tolist())
    same, _ = np.histogram([3.0, 3.0], 5)
    assert [v for _, v in bins(frame(spark, [3, 3]), 5)] == same.tolist()
    assert bins(frame(spark, []), 5) == []
