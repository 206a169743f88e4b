"""Plans: everything in the JVM, no product of rows, only the columns that are needed."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from spanlens.functions.scorer import BigramScorer, token_table
from spanlens.operators import overlap
from spanlens.plans import pairs, queries, registry
from spanlens.sources import readers

#: One-row tables are joined to every row.
ONE_ROW = {"bigram_nll", "number_span_scores", "number_delta_stats", "number_report", "context_mean_nll", "compare_summary", "word_scores", "code_scores", "early_stop",
           "code_record_rows", "code_skipped_rows", "word_record_rows", "null_contexts"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_stays_in_the_jvm(spark, sf, name):
    text = plan(registry.QUERIES[name](spark, sf))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", text)
    if name not in ONE_ROW:
        assert "BroadcastNestedLoopJoin" not in text


def read_schemas(df) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))


def test_columns_are_pruned(spark, sf):
    assert all("html" not in s and "lang" not in s for s in read_schemas(queries.extract_numbers(spark, sf)))
    assert read_schemas(queries.stats_code(spark, sf)) == ["l_quantity:double,l_tax:double,l_returnflag:string"]
    assert read_schemas(queries.median_any_size(spark, sf))[0].count(":") == 2


def test_filters_are_pushed(spark, sf):
    assert "EqualTo(event_type,click)" in plan(queries.event_scores(spark, sf).where("event_type = 'click'"))
    assert "TakeOrderedAndProject" in plan(queries.prefix_limit(spark, sf))


def test_tokens_need_no_shuffle(spark):
    texts = spark.createDataFrame([("a", "b c")], "text_id string, text string")
    assert "Exchange" not in plan(token_table(texts))


def test_overlap_joins_on_keys(spark):
    tokens = token_table(spark.createDataFrame([("a", "b c")], "text_id string, text string"))
    spans = spark.createDataFrame([("a", 0, 1)], "text_id string, span_start int, span_end int")
    text = plan(overlap.overlap_join(tokens, spans, ["text_id"]))
    assert re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[text_id#\d+, _bucket#\d+\]", text)


def test_long_texts(spark):
    """A text of many tokens and spans: linear enough to finish, and right."""
    body = " ".join(f"w{i % 97} {i}" for i in range(6000))
    rows = spark.createDataFrame([(1, body, body.replace("7", "8"))], "row_id long, original_problem string, problem string")
    corpus = spark.createDataFrame([(body[:5000],)], "text string")
    out = pairs.number_records(rows, BigramScorer(corpus))
    assert out.count() == sum("7" in x for x in re.findall(r"(?<![A-Za-z])\d+(?![A-Za-z])", body))


def test_columns_that_are_not_there(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(ValueError, match="c"):
        readers.require_columns(df, ["a", "c"])
    assert readers.target_column(df.withColumn("target word", F.lit("t")).withColumn("target", F.lit("u"))) == "target word"
