"""Text expressions: spans, lines, words and lists as built-in columns.

Offsets are zero-based code points and spans are half-open. Every function takes and returns ``Column``s, so plans stay in
the JVM; null text gives null unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number forms that count as one span.
NUMBER = (
    r"(?U)(?:\\frac\s*\{\s*[-+]?\d+(?:\.\d+)?\s*\}\s*\{\s*[-+]?\d+(?:\.\d+)?\s*\}"
    r"|(?<![A-Za-z])[-+]?\d+(?:\.\d+)?%?(?![A-Za-z]))"
)
# What ends a line.
LINE_END = "(?<=\r\n|[\n\x0b\x0c\x1c-\x1e\x85  ]|\r(?!\n))"
SPAN = "struct<start:int,end:int,value:string>"
SPACE = r"[\s\x1C-\x1F]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.regexp_replace(x, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def _scan(a: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(a, start, step, lambda s: s["out"])


def running_sum(a: Column) -> Column:
    """For each element of an integer array, the sum of those before it.

    In two levels of about sqrt(n) elements, because appending to an array copies it."""

    def blocks(a: Column, width: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda k: F.slice(a, k * width + 1, width))

    def whole(b: Column) -> Column:
        base = _scan(F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)))
        return F.flatten(F.zip_with(b, base, lambda x, k: F.transform(_scan(x), lambda v: v + k)))

    wide = let(a, lambda v: let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda w: let(blocks(v, w), whole)))
    return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(wide)


def match_spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern that doesn't match the empty text, left to right: array of struct(start, end, value)."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def spans(m: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda g: F.char_length(g))
        sizes = F.transform(m, lambda x: F.char_length(x))
        before = running_sum(F.zip_with(gaps, sizes, lambda g, n: g + n))
        starts = F.zip_with(before, gaps, lambda b, g: b + g)
        return F.zip_with(starts, m, lambda s, v: F.struct(s.alias("start"), (s + F.char_length(v)).alias("end"), v.alias("value")))

    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(spans(m)))


def numbers(text: Column) -> Column:
    """Numbers as they are written: fractions, signed decimals and percentages, not next to an ASCII letter."""
    return match_spans(text, NUMBER)


def same_number_form(value: Column) -> Column:
    """A number's text without white space: numbers are compared as text, so ``1.0`` differs from ``1``."""
    return F.regexp_replace(value, r"(?U)\s+", "")


def align_numbers(original: Column, perturbed: Column) -> Column:
    """Pairs by position of two arrays of spans, up to the shorter; the counts of both are on every pair."""

    def pairs(a: Column, b: Column) -> Column:
        n = F.least(F.size(a), F.size(b))

        def pair(z: Column, i: Column) -> Column:
            x, y = z["x"], z["y"]
            return F.struct(
                i.alias("num_index"), x["start"].alias("orig_start"), x["end"].alias("orig_end"), x["value"].alias("orig_num"),
                y["start"].alias("pert_start"), y["end"].alias("pert_end"), y["value"].alias("pert_num"),
                (same_number_form(x["value"]) != same_number_form(y["value"])).alias("changed"),
                (F.size(a) != F.size(b)).alias("count_mismatch"), F.size(a).alias("orig_num_count"), F.size(b).alias("pert_num_count"),
            )

        zipped = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        return F.transform(zipped, pair)

    return let(original, lambda a: let(perturbed, lambda b: pairs(a, b)))


def quoted(literal: Column) -> Column:
    """A pattern that matches ``literal`` itself."""
    return F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrences(text: Column, part: Column) -> Column:
    """Starts of all occurrences, overlapping ones too; none for an empty or null part or text."""

    def starts(pieces: Column) -> Column:
        at = running_sum(F.transform(pieces, lambda p: F.char_length(p)))
        return F.filter(at, lambda x, i: (i > 0) | F.startswith(text, part))

    found = let(F.split(text, F.concat(F.lit("(?="), quoted(part), F.lit(")")), -1), starts)
    none = F.array().cast("array<int>")
    return F.coalesce(F.when((part == "") | (F.char_length(part) > F.char_length(text)), none).otherwise(found), none)


def unique_occurrence(text: Column, part: Column) -> Column:
    """The start of the only occurrence; null if there is none or more than one."""
    return let(occurrences(text, part), lambda at: F.when(F.size(at) == 1, F.get(at, F.lit(0))))


def count_separate(text: Column, part: Column) -> Column:
    """How often ``part`` occurs, not counting overlaps."""
    return F.when(F.char_length(part) > 0, ((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.char_length(part)).cast("int")).otherwise(0)


def lines(text: Column) -> Column:
    """Lines with their terminators; an empty text has none."""
    return F.filter(F.split(text, LINE_END, -1), lambda x: x != "")


def one_word(x: Column) -> Column:
    """Whether the stripped text is one word of ASCII letters; false for null."""
    return F.coalesce(strip(x).rlike(r"\A[A-Za-z]+\z"), F.lit(False))


def upper_case(x: Column) -> Column:
    return (x == F.upper(x)) & (x != F.lower(x))


def match_case(word: Column, reference: Column) -> Column:
    """``word`` in upper case or capitalised as ``reference`` is; a single capital letter counts as upper case."""
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 2**31 - 1))
    return F.when(upper_case(reference), F.upper(word)).when(upper_case(F.substring(reference, 1, 1)), capital).otherwise(word)


def marked_target(sentence: Column) -> Column:
    """struct(sentence, prefix, target, suffix) of the first ``**target**`` on one line; null where nothing is marked.

    Only that pair of marks is taken out."""
    pattern = r"(?s)\A(.*?)\*\*([^\n]+?)\*\*(.*)\z"
    part = [F.regexp_extract(sentence, pattern, i) for i in (1, 2, 3)]
    return F.when(
        sentence.rlike(pattern), F.struct(F.concat(*part).alias("sentence"), part[0].alias("prefix"), part[1].alias("target"), part[2].alias("suffix"))
    )


def without_marks(sentence: Column) -> Column:
    return F.replace(sentence, F.lit("**"), F.lit(""))


def find_target(sentence: Column, target: Column, unique: bool = True) -> Column:
    """struct(problem, sentence, prefix, target, suffix): the target as it is written or else, by whole words, in any case.

    ``problem`` is ``target_not_found``, or ``target_repeated`` where ``unique`` is asked for; otherwise null, and the first
    occurrence counts."""
    exact = count_separate(sentence, target)
    loose = F.concat(F.lit("(?iU)\\b"), quoted(target), F.lit("\\b"))
    n = F.when(exact > 0, exact).otherwise(F.regexp_count(sentence, loose))
    start = F.when(exact > 0, F.instr(sentence, target) - 1).otherwise(F.char_length(F.get(F.split(sentence, loose, 2), F.lit(0))))
    problem = F.when((F.coalesce(sentence, F.lit("")) == "") | (F.coalesce(target, F.lit("")) == "") | (n == 0), "target_not_found")
    if unique:
        problem = problem.when(n > 1, "target_repeated")
    size = F.char_length(target)
    return let(
        F.struct(problem.alias("p"), start.alias("s")),
        lambda x: F.struct(
            x["p"].alias("problem"), F.when(x["p"].isNull(), sentence).alias("sentence"),
            F.when(x["p"].isNull(), F.substring(sentence, F.lit(1), x["s"])).alias("prefix"),
            F.when(x["p"].isNull(), F.substring(sentence, x["s"] + 1, size)).alias("target"),
            F.when(x["p"].isNull(), F.substring(sentence, x["s"] + size + 1, F.char_length(sentence))).alias("suffix"),
        ),
    )


#: A quoted literal without escapes, and several of them with commas: what is written is a tuple, with or without parentheses.
LITERAL = r"""(?:'[^'\\]*'|"[^"\\]*")"""
TUPLE = rf"{LITERAL}(?:\s*,\s*{LITERAL})*\s*,?"


def parse_words(listed: Column) -> Column:
    """Words of a written list (``['a (B2)', "b"]`` or ``a, b``): the first of a nested list, without quotes and a last note
    in parentheses; empty ones are left out, and null is an empty list. A tuple that isn't in a list counts as nested in
    one, so only its first word stays; literals with nothing between them are one word."""
    s = strip(listed)
    first = F.regexp_extract(s, rf"^\(?\s*({LITERAL})", 1)
    one = s.rlike(rf"^{LITERAL}$") | s.rlike(rf"^\(\s*{LITERAL}\s*\)$") | s.rlike(rf"^{TUPLE}$") | s.rlike(rf"^\(\s*{TUPLE}\s*\)$")
    s = F.when(s.rlike(r"^\["), F.regexp_replace(s, r"(?<=[^,\[\s])(['\"])\s+\1", "")).otherwise(s)
    nested = F.from_json(s, "array<string>")
    inner = lambda x: F.when(x.rlike(r"^\[.*\]$"), F.get(F.from_json(x, "array<string>"), F.lit(0))).otherwise(x)
    plain = F.split(F.regexp_replace(s, r"^[\[\]]+|[\[\]]+$", ""), ",")
    quoted_tuples = F.regexp_replace(F.regexp_replace(s, r"\(\s*(['\"])", r"[$1"), r"(['\"])\s*(,[^()\[\]]*)?\)", r"$1$2]")
    items = F.when(s.rlike(r"^\["), F.coalesce(nested, F.from_json(quoted_tuples, "array<string>"), plain)).when(one, F.array(first)).otherwise(plain)
    clean = lambda x: strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(inner(strip(x))), "^'+|'+$", ""), '^"+|"+$', ""), r"\s*\([^)]*\)\s*\z", ""))
    return F.coalesce(F.filter(F.transform(items, clean), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def distinct_words(words: Column) -> Column:
    """The first of each word, whatever its case, in order."""
    return let(words, lambda w: let(F.transform(w, lambda x: F.lower(x)), lambda low: F.filter(w, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def label_score(labels: Column) -> Column:
    """The share of labels that begin with TRUE in any case; 0 without labels."""
    n = F.size(F.coalesce(labels, F.array().cast("array<string>")))
    yes = F.size(F.filter(labels, lambda x: F.coalesce(F.startswith(F.upper(x), F.lit("TRUE")), F.lit(False))))
    return F.when(n > 0, yes / n).otherwise(F.lit(0.0)).cast("double")


def finite(x: Column) -> Column:
    """Null for what is not a finite number."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
