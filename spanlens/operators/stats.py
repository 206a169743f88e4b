"""Distribution statistics, rank statistics of two samples, and histograms.

Medians are exact. As plain aggregates (``stats_*``) they keep a count of each distinct value of a group in one task, so
``grouped``, ``by_groups`` and ``compare`` take them from ``exact_medians`` instead, which has no bound on groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.functions.text import finite
from spanlens.sources.scratch import staged


def _share(x: Column) -> Column:
    return F.avg((x > 0).cast("double"))


def _single(name: str) -> Column:
    return finite(finite(F.col(name)).cast("float"))


def stats_number(name: str) -> list[Column]:
    """n, mean, lower median, population deviation, min, max and share above zero, of a column's values in single precision."""
    x = _single(name)
    one = f"cast(`{name}` as float)"
    lower = F.expr(f"percentile_disc(0.5) within group (order by case when not isnan({one}) and abs({one}) < cast('inf' as float) then cast({one} as double) end)")
    return [
        F.count(x).alias("n"), F.avg(x).alias("mean"), lower.alias("median"), F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"), _share(x).alias("frac_positive"),
    ]


def stats_code(name: str) -> list[Column]:
    """n, mean, median, population deviation, min, max, share above zero, and mean and median of what is above zero."""
    x = finite(F.col(name))
    above = F.when(x > 0, x)
    return [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"),
        F.max(x).alias("max"), _share(x).alias("frac_positive"), F.avg(above).alias("positive_mean"), F.median(above).alias("positive_median"),
    ]


def sample_std(x: Column) -> Column:
    """The sample deviation, 0 for one value."""
    return F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0)))


def _stats_sample(x: Column) -> list[Column]:
    return [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), sample_std(x).alias("std"), F.min(x).alias("min"),
        F.max(x).alias("max"), _share(x).alias("frac_positive"), F.avg(F.when(x > 0, x)).alias("positive_half_mean"),
    ]


def stats_word(score: Column, orig_logp: Column, sub_logp: Column) -> list[Column]:
    """As for code, but with the sample deviation, and means of log-probabilities and costs; over rows with a score."""
    x = finite(score)
    own = lambda c: F.avg(F.when(x.isNotNull(), finite(c)))
    return _stats_sample(x) + [
        own(orig_logp).alias("mean_orig_logp"), own(sub_logp).alias("mean_sub_logp"),
        own(-finite(orig_logp)).alias("mean_orig_nll"), own(-finite(sub_logp)).alias("mean_sub_nll"),
    ]


def stats_context(score: Column, orig_nll: Column, sub_nll: Column) -> list[Column]:
    x = finite(score)
    own = lambda c: F.avg(F.when(x.isNotNull(), finite(c)))
    return _stats_sample(x) + [own(orig_nll).alias("mean_orig_context_nll"), own(sub_nll).alias("mean_sub_context_nll")]


#: Value ranges of a doubling in the first step, and of a bracket in the later ones.
FINE, CELLS = 128, 2**24
#: Groups up to which the driver holds the medians of all, so that a plan with them reads no table besides its input.
FEW = 10_000


def _narrowed(rows: DataFrame, by: list[str], cell: Column, n: Column, below: Column, above: Column) -> DataFrame:
    """(by, _n, _low, _high, _below, _count, _above): the cell that holds the lower middle rank, its least and largest value, how
    many values lie below it and in it, and the least value above it. A group has at most as many rows in a task as there are cells."""
    cells = rows.groupBy(*by, cell.alias("_cell")).agg(
        F.count("*").alias("_count"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.first(n).alias("_n"), F.first(below).alias("_below"), F.first(above).alias("_next")
    )
    order = Window.partitionBy(*by).orderBy("_cell")
    whole = Window.partitionBy(*by)
    ranked = cells.select(
        *by, "_low", "_high", "_count", F.coalesce("_n", F.sum("_count").over(whole)).alias("_n"),
        (F.col("_below") + F.sum("_count").over(order)).alias("_upto"), F.coalesce(F.lead("_low").over(order), "_next").alias("_above"),
    )
    middle = F.floor((F.col("_n") + 1) / 2)
    ranked = ranked.where((F.col("_upto") >= middle) & (F.col("_upto") - F.col("_count") < middle))
    return ranked.select(*by, "_n", "_low", "_high", (F.col("_upto") - F.col("_count")).alias("_below"), "_count", "_above")


def _one_of(at: Column, choices: list[Column]) -> Column:
    """The choice with the number ``at``."""
    out = F.when(at == 0, choices[0])
    for i, c in enumerate(choices[1:], 1):
        out = out.when(at == i, c)
    return out


def exact_medians(df: DataFrame, values: dict[str, Column], keys: list[str], lower: bool = False, single: bool = False) -> DataFrame:
    """(keys, a column for each of ``values``): medians, interpolated or the lower one, exact whatever the size of a group.

    The middle rank is looked for in steps. Each counts values by cells, keeps the cell with the rank, and reads the rows
    again for the next: 128 cells a doubling, then twice 2**24 in a bracket, which leaves a single one of a double's 2**53
    fractions. Once is enough if all values are of ``single`` precision. Only counts by cell move. One row a group and value is sent
    to every executor. The steps run at once and are written to the scratch folder. Groups without values may be absent."""
    names = list(values)
    own = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(c) for k, c in zip(keys, own, strict=True)), *(finite(values[c]).alias(f"_v{i}") for i, c in enumerate(names)))
    if len(names) == 1 and keys:
        rows, by = rows.withColumn("_x", F.col("_v0")), own
    else:  # a key that isn't constant, so that joins have one
        rows, by = rows.withColumn("_of", F.explode(F.array(*map(F.lit, range(len(names)))))), [*own, "_of"]
        rows = rows.withColumn("_x", _one_of(F.col("_of"), [F.col(f"_v{i}") for i in range(len(names))]))
    rows = rows.select(*by, "_x").where("_x is not null")
    x = F.col("_x")
    steps = F.floor(F.ln(F.abs(x)) * (FINE / math.log(2))) + 1_000 * FINE * 2  # above zero for the least double too
    none = F.lit(None).cast("double")
    at = staged(_narrowed(rows, by, F.when(x > 0, steps).when(x < 0, -steps).otherwise(0), F.lit(None).cast("long"), F.lit(0), none), "medians")
    for _ in range(1 if single else 2):
        known = F.broadcast(at.withColumnsRenamed({c: f"{c}_at" for c in by}))
        within = rows.join(known, [F.col(c).eqNullSafe(F.col(f"{c}_at")) for c in by]).where((x >= F.col("_low")) & (x <= F.col("_high")))
        share = F.try_divide(x - F.col("_low"), F.col("_high") - F.col("_low"))
        at = staged(_narrowed(within.select(*by, "_x", F.floor(F.coalesce(share, F.lit(0.0)) * CELLS).alias("_at"), "_n", "_below", "_above"), by, F.col("_at"), F.col("_n"), F.col("_below"), F.col("_above")), "medians")
    second = F.when(F.col("_below") + F.col("_count") > F.floor(F.col("_n") / 2), F.col("_low")).otherwise(F.col("_above"))
    median = F.col("_low") if lower else (F.col("_low") + second) / 2
    found = [F.max(F.when(F.col("_of") == i if "_of" in by else F.lit(True), median)).alias(c) for i, c in enumerate(names)]
    out = at.groupBy(*own).agg(*found).select(*(F.col(c).alias(k) for k, c in zip(keys, own, strict=True)), *names)
    few = out.limit(FEW + 1).collect()
    return out.sparkSession.createDataFrame(few, out.schema) if len(few) <= FEW else out


def grouped(df: DataFrame, keys: list[str], stats: list[Column], medians: dict[str, Column], lower: bool = False, single: bool = False) -> DataFrame:
    """``df.groupBy(keys).agg(stats)``, with the columns named in ``medians`` from ``exact_medians``, so that no task holds the values of a group."""
    own = df.groupBy(*keys).agg(*stats)
    medians = {c: x for c, x in medians.items() if c in own.columns}
    if not medians:
        return own
    both = own.drop(*medians).unionByName(exact_medians(df, medians, keys, lower, single), allowMissingColumns=True)
    return both.groupBy(*keys).agg(*(F.max(c).alias(c) for c in own.columns if c not in keys)).select(own.columns)


def medians_of(x: Column) -> dict[str, Column]:
    """For ``grouped`` and ``compare``: the medians of all conventions but ``stats_number``."""
    return {"median": x, "positive_median": F.when(finite(x) > 0, x)}


def by_groups(df: DataFrame, value: str, groups: list[str], stats=stats_number) -> DataFrame:
    """(grouping, key, statistics): all rows (grouping ``all``), then by each column on its own, in one pass; missing keys are ``None``.

    The medians of ``stats_number`` and ``stats_code`` are those of ``exact_medians``; other aggregates are taken as they are."""
    none = F.lit(None).cast("string")
    own = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in groups]
    long = df.select(*(x.alias(f"_g{i}") for i, x in enumerate(own)), value, F.explode(F.array(*map(F.lit, range(len(groups) + 1)))).alias("_set"))
    long = long.select("_set", _one_of(F.col("_set"), [none, *(F.col(f"_g{i}") for i in range(len(groups)))]).alias("_key"), value)
    medians = {"median": _single(value)} if stats is stats_number else medians_of(F.col(value)) if stats is stats_code else {}
    out = grouped(long, ["_set", "_key"], stats(value), medians, lower=stats is stats_number, single=stats is stats_number)
    name = _one_of(F.col("_set"), [F.lit("all"), *map(F.lit, groups)])
    return out.where(F.col("n") > 0).select(name.alias("grouping"), F.col("_key").alias("key"), *(c for c in out.columns if c not in ("_set", "_key")))


def exact_median(df: DataFrame, value: str, keys: list[str], accuracy: int = 10_000) -> DataFrame:
    """(keys, median): interpolated, and exact whatever the size of a group; null for a group without values.

    ``accuracy`` is there for callers of an earlier version and changes nothing."""
    none = F.lit(None).cast("double")
    out = grouped(df, keys, [F.count(finite(F.col(value))).alias("_n"), none.alias("median")], {"median": F.col(value)})
    return out.select(*keys, F.when(F.col("_n") > 0, F.col("median")).alias("median"))


def _slices(df: DataFrame, column: str, n: int) -> Column:
    """The number of one of at most ``n`` value ranges of about equal counts; bounds come from a quantile sketch."""
    cuts = df.select(F.percentile_approx(column, [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c <= F.col(column)))


def tie_ranks(df: DataFrame, value: str, slices: int = 64) -> DataFrame:
    """(value, times, rank): every distinct value with its 1-based rank, ties averaged.

    Ranks are summed within value ranges, then over the ranges before, so no task gets all values."""
    counts = df.select(finite(F.col(value)).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("times"))
    counts = counts.withColumn("_slice", _slices(counts, "value", slices))
    total = counts.groupBy("_slice").agg(F.sum("times").alias("_n"))
    before = total.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_before"))
    inside = F.sum("times").over(Window.partitionBy("_slice").orderBy("value"))
    rank = F.col("_before") + F.col("_upto") - (F.col("times") - 1) / F.lit(2.0)
    return counts.withColumn("_upto", inside).join(F.broadcast(before), "_slice").select("value", "times", rank.alias("rank"))


def auc(df: DataFrame, value: str, label: str, slices: int = 64) -> DataFrame:
    """(auc): the probability that a value of label 1 is above one of label 0, ties counting half; null without both labels."""
    x = finite(F.col(value))
    rows = df.select(x.alias("value"), F.col(label).cast("int").alias("label")).where("value is not null and label in (0, 1)")
    counts = rows.groupBy("value").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    counts = counts.withColumn("_slice", _slices(counts, "value", slices))
    total = counts.groupBy("_slice").agg(F.sum("q").alias("_q"))
    before = total.select("_slice", (F.sum("_q").over(Window.orderBy("_slice")) - F.col("_q")).alias("_before"))
    inside = F.sum("q").over(Window.partitionBy("_slice").orderBy("value"))
    below = F.col("_before") + F.col("_upto") - F.col("q") / F.lit(2.0)
    own = counts.withColumn("_upto", inside).join(F.broadcast(before), "_slice")
    return own.agg(F.try_divide(F.sum(F.col("p") * below), F.sum("p").cast("double") * F.sum("q").cast("double")).alias("auc"))


def cohens_d(df: DataFrame, value: str, label: str) -> DataFrame:
    """(cohens_d): the difference of means (label 1 less label 0) over the pooled sample deviation; null if a side has under
    two values or nothing varies."""
    side = lambda k: finite(F.when(F.col(label) == k, F.col(value)))
    a, b = side(1), side(0)
    n, m = F.count(a), F.count(b)
    pooled = F.sqrt(F.try_divide((n - 1) * F.var_samp(a) + (m - 1) * F.var_samp(b), (n + m - 2).cast("double")))
    return df.agg(F.when((n >= 2) & (m >= 2) & (pooled > 0), F.try_divide(F.avg(a) - F.avg(b), pooled)).alias("cohens_d"))


def compare(old: DataFrame, new: DataFrame, score: str, stats, medians: dict[str, Column] | None = None) -> DataFrame:
    """One row: structs ``old`` and ``new`` of statistics, difference of means, AUC and Cohen's d (old against new).

    ``stats`` makes aggregate columns of a DataFrame with the columns of both inputs; ``medians`` is as for ``grouped``."""
    both = old.withColumn("_label", F.lit(1)).unionByName(new.withColumn("_label", F.lit(0)))
    own = grouped(both, ["_label"], stats, medians or {})
    names = [c for c in own.columns if c != "_label"]
    side = lambda k, name: F.max(F.when(F.col("_label") == k, F.struct(*names))).alias(name)
    sides = own.agg(side(1, "old"), side(0, "new"))
    joined = sides.join(F.broadcast(auc(both, score, "_label"))).join(F.broadcast(cohens_d(both, score, "_label")))
    return joined.select(
        "old", "new", (F.col("old.mean") - F.col("new.mean")).alias("difference_mean_old_minus_new"),
        F.col("auc").alias("auc_old_higher_than_new"), F.col("cohens_d").alias("cohens_d_old_minus_new"),
    )


def histogram(df: DataFrame, columns: list[str], bins: int = 50, density: bool = False) -> DataFrame:
    """(series, bin, low, high, value): bins of equal width between each column's own least and largest value, the last one
    closed; empty bins are there. Where all values are equal, the range is widened by a half on either side."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("series"), finite(F.col(c)).alias("x")) for c in columns))).alias("s")).select("s.*").where("x is not null")
    bounds = long.groupBy("series").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    flat = F.col("lo") == F.col("hi")
    bounds = bounds.select("series", "n", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counts = long.join(F.broadcast(bounds), "series").groupBy("series", at.alias("bin")).agg(F.count("*").alias("c"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    value = F.coalesce("c", F.lit(0)).cast("double") / (F.col("n") * width) if density else F.coalesce("c", F.lit(0)).cast("long")
    return grid.join(counts, ["series", "bin"], "left").select("series", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), value.alias("value"))


def nested(groups: DataFrame) -> dict:
    """Rows of ``by_groups`` as one document: ``all``, and ``by`` grouping and key in their order. The driver sees one row a group."""
    out: dict = {"all": None, "by": {}}
    for r in groups.orderBy("grouping", "key").collect():
        own = {k: v for k, v in r.asDict().items() if k not in ("grouping", "key")}
        if r["grouping"] == "all":
            out["all"] = own
        else:
            out["by"].setdefault(r["grouping"], {})[r["key"]] = own
    return out
