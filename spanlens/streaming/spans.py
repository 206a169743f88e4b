"""The stateless steps on streams, and running summaries.

Extraction, alignment and location are row-local, so they take a streaming DataFrame as it is. Costs come from a token
table that is read as a batch for each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanlens.functions.text import finite
from spanlens.plans.pairs import number_pairs, number_records


def changed_numbers(stream: DataFrame, key: str = "row_id") -> DataFrame:
    """The changed pairs of a stream of text pairs, without state."""
    return number_pairs(stream, key)


def running_stats(stream: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Statistics by key that can be kept up as rows arrive (output mode ``complete`` or ``update``); medians can't."""
    x = finite(F.col(value))
    return stream.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg((x > 0).cast("double")).alias("frac_positive")
    )


def score_stream(stream: DataFrame, scorer, out: str, checkpoint: str, key: str = "row_id", **trigger) -> StreamingQuery:
    """Appends the records of each micro-batch to a Parquet table, in a folder a batch so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        number_records(batch, scorer, key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
