"""Locating a span in a program from partial hints, as one nullable struct per hint and the first that holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlens.functions.text import let, lines, occurrences, unique_occurrence


def _found(start: Column, size: Column, mode: str) -> Column:
    found = lambda x: F.when(x.isNotNull(), F.struct(x.cast("int").alias("start"), (x + size).cast("int").alias("end"), F.lit(mode).alias("mode")))
    return let(start, found)


def nearest(starts: Column, preferred: Column) -> Column:
    """The start closest to the preferred column, the left-most of equals; the first without a preference; null if there is none."""
    close = F.array_min(F.transform(starts, lambda x: F.struct(F.abs(x - preferred).alias("d"), x.alias("x"))))["x"]
    return F.when(preferred.isNull(), F.get(starts, F.lit(0))).otherwise(close)


def locate_span(text: Column, span: Column, line: Column | None = None, span_start: Column | None = None, line_index: Column | None = None) -> Column:
    """struct(start, end, mode) of ``span`` in ``text``; null offsets and mode ``not_found_or_ambiguous`` if no hint leads to it.

    In order: the span is at ``span_start``; it is in the line with that index, nearest to the column that the start
    points at; it is in the first occurrence of ``line``, by the same preference; it occurs once in the whole text."""
    span_start = F.lit(None).cast("int") if span_start is None else span_start.cast("int")
    line_index = F.lit(None).cast("int") if line_index is None else line_index.cast("int")
    line = F.lit(None).cast("string") if line is None else line
    size = F.char_length(span)
    explicit = F.when((span_start >= 0) & (span_start <= F.char_length(text)) & (F.substring(text, span_start + 1, size) == span), span_start)

    def hinted(own: Column) -> Column:
        valid = (line_index >= 0) & (line_index < F.size(own))
        offset = F.when(valid, F.aggregate(F.slice(own, F.lit(1), F.when(valid, line_index).otherwise(0)), F.lit(0), lambda s, x: s + F.char_length(x)))
        preferred = span_start - offset
        in_line = F.when(valid, offset + nearest(occurrences(F.get(own, F.when(valid, line_index).otherwise(0)), span), preferred))
        at = F.when(F.coalesce(line, F.lit("")) != "", F.nullif(F.instr(text, line), F.lit(0)) - 1)
        in_text = at + nearest(occurrences(line, span), preferred)
        return F.coalesce(
            _found(explicit, size, "explicit_start_len"),
            _found(in_line, size, "line_index_closest_span"),
            _found(in_text, size, "line_text_closest_span"),
            _found(unique_occurrence(text, span), size, "full_text_unique_span"),
            F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit("not_found_or_ambiguous").alias("mode")),
        )

    return let(lines(text), hinted)
