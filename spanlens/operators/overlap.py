"""Tokens that overlap spans, and what they cost.

The join is on the text and a bucket of offsets, so that neither a long text nor one with many spans compares all its
tokens with all its spans; a pair is reported in one bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions.text import finite

BUCKET = 256


def _bucketed(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    last = F.greatest(F.col(start), F.col(end) - 1)
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width).cast("int"), F.floor(last / width).cast("int"))))


def overlap_join(tokens: DataFrame, spans: DataFrame, keys: list[str], empty_tokens: bool = False, width: int = BUCKET) -> DataFrame:
    """Rows of ``tokens`` (char_start, char_end) and ``spans`` (span_start, span_end) with equal ``keys`` that share a code point.

    Empty tokens overlap nothing, unless ``empty_tokens``: then one strictly inside a span counts. Empty spans match nothing."""
    hit = (F.col("char_start") < F.col("span_end")) & (F.col("span_start") < F.col("char_end"))
    if not empty_tokens:
        hit &= F.col("char_start") < F.col("char_end")
    first = F.floor(F.greatest("char_start", "span_start") / width).cast("int")
    left = _bucketed(tokens.where("char_start is not null and char_end is not null"), "char_start", "char_end", width)
    right = _bucketed(spans.where("span_start < span_end"), "span_start", "span_end", width)
    return left.join(right, [*keys, "_bucket"]).where(hit & (F.col("_bucket") == first)).drop("_bucket")


def span_costs(joined: DataFrame, by: list[str], token_lists: bool = False) -> DataFrame:
    """By span: sum_nll and mean_nll (null if nothing can be scored) and num_tokens over tokens of finite cost, and with
    ``token_lists`` their texts in order."""
    cost = finite(F.col("nll"))
    out = [F.sum(cost).alias("sum_nll"), F.avg(cost).alias("mean_nll"), F.count(cost).cast("int").alias("num_tokens")]
    if token_lists:
        listed = F.array_sort(F.collect_list(F.when(cost.isNotNull(), F.struct("pos", "token"))))
        out.append(F.transform(listed, lambda x: x["token"]).alias("tokens"))
    return joined.groupBy(*by).agg(*out)


def text_costs(tokens: DataFrame, by: list[str]) -> DataFrame:
    """By text: mean_nll, sum_nll and num_tokens of all its scored tokens; 0 for a text without any that has a row."""
    cost = finite(F.col("nll"))
    total, n = F.coalesce(F.sum(cost), F.lit(0.0)), F.count(cost)
    return tokens.groupBy(*by).agg((total / F.greatest(n, F.lit(1))).alias("mean_nll"), total.alias("sum_nll"), n.alias("num_tokens"))


def paired(costs: DataFrame, by: list[str], first: str, second: str, columns: tuple[str, ...] = ("sum_nll", "mean_nll", "num_tokens")) -> DataFrame:
    """Two rows that differ in ``side`` become one, with columns named by side."""
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
    return costs.groupBy(*by).agg(*(pick(s, c) for c in columns for s in (first, second)))


def delta(perturbed: Column | str, original: Column | str) -> Column:
    """Above zero: the original is likelier."""
    f = lambda x: F.col(x) if isinstance(x, str) else x
    return f(perturbed) - f(original)
