"""The cascade of hints that locates a span."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanlens.operators.locate import locate_span

TEXT = "a=k\nb=k+k\n"


@pytest.mark.parametrize(
    ("span", "line", "start", "index", "expected"),
    [
        ("k", None, 2, None, (2, 3, "explicit_start_len")),
        ("k", None, 7, 1, (6, 7, "line_index_closest_span")),
        ("k", None, None, 1, (6, 7, "line_index_closest_span")),
        ("k", "b=k+k", None, None, (6, 7, "line_text_closest_span")),
        ("b", None, None, None, (4, 5, "full_text_unique_span")),
        ("k", None, None, None, (None, None, "not_found_or_ambiguous")),
        ("k", None, None, -1, (None, None, "not_found_or_ambiguous")),
        ("k", None, 99, 7, (None, None, "not_found_or_ambiguous")),
        ("k", "", None, None, (None, None, "not_found_or_ambiguous")),
        ("k", None, 9, 1, (8, 9, "line_index_closest_span")),
        ("missing", "b=k+k", 0, 0, (None, None, "not_found_or_ambiguous")),
    ],
)
def test_locate(spark, span, line, start, index, expected):
    row = spark.createDataFrame([(TEXT, span, line, start, index)], "t string, s string, l string, a int, i int")
    got = row.select(locate_span(F.col("t"), F.col("s"), F.col("l"), F.col("a"), F.col("i")).alias("r")).first()["r"]
    assert tuple(got) == expected


def test_empty_text(spark):
    row = spark.createDataFrame([("", "x")], "t string, s string")
    assert row.select(locate_span(F.col("t"), F.col("s")).alias("r")).first()["r"]["mode"] == "not_found_or_ambiguous"
