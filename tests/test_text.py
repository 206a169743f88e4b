"""Text expressions on literal rows."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlens.functions import text as X


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds or "x string").select(column.alias("r")).first()["r"]


def spans(r):
    return [(x["start"], x["value"]) for x in r]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("12 and 😀 -3.5% x42 7z 12z 1-2 \\frac{1}{2} 3", [(0, "12"), (9, "-3.5%"), (17, "2"), (22, "1"), (26, "1"), (27, "-2"), (30, "\\frac{1}{2}"), (42, "3")]),
        ("none", []),
        ("", []),
        ("٣ 4", [(0, "٣"), (2, "4")]),
        ("1.5z 5%a", [(0, "1"), (5, "5")]),
    ],
)
def test_numbers(spark, text, expected):
    assert spans(one(spark, X.numbers(F.col("t")), t=text)) == expected


def test_numbers_slice_back(spark):
    texts = ["a 1 😀 22 é-3.0% " * k for k in range(1, 60, 7)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.numbers(F.col("t")).alias("n")).collect()
    for r in rows:
        assert len(r["n"]) == 3 * texts[texts.index(r["t"])].count("😀")
        assert all(r["t"][x["start"] : x["end"]] == x["value"] for x in r["n"])


def test_null_text(spark):
    assert one(spark, X.numbers(F.col("t")), t=None) is None
    assert one(spark, X.occurrences(F.col("t"), F.lit("a")), t=None) == []


def align(spark, a, b):
    return [tuple(x) for x in one(spark, X.align_numbers(X.numbers(F.col("a")), X.numbers(F.col("b"))), a=a, b=b)]


def test_align(spark):
    assert align(spark, "1, 2, 3", "1, 5") == [(0, 0, 1, "1", 0, 1, "1", False, True, 3, 2), (1, 3, 4, "2", 3, 4, "5", True, True, 3, 2)]
    assert align(spark, "\\frac{1}{2}", "\\frac{ 1 }{2}")[0][7] is False
    assert align(spark, "1.0", "1")[0][7] is True
    assert align(spark, "none", "1") == []


def brute(text, part):
    return [i for i in range(len(text) - len(part) + 1) if part and text[i : i + len(part)] == part]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("ab\\E😀.", max_size=12), st.text("ab\\E😀.", max_size=3)), min_size=1, max_size=30))
def test_occurrences(spark, pairs):
    rows = spark.createDataFrame(pairs, "t string, p string").select("t", "p", X.occurrences(F.col("t"), F.col("p")).alias("r"), X.count_separate(F.col("t"), F.col("p")).alias("n")).collect()
    for r in rows:
        assert r["r"] == brute(r["t"], r["p"])
        assert r["n"] == (r["t"].count(r["p"]) if r["p"] else 0)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.integers(0, 99), max_size=70), min_size=1, max_size=20))
def test_running_sum(spark, rows):
    got = spark.createDataFrame([(r,) for r in rows], "a array<int>").select("a", X.running_sum(F.col("a")).alias("r")).collect()
    for r in got:
        assert r["r"] == [sum(r["a"][:i]) for i in range(len(r["a"]))]


@pytest.mark.parametrize(("text", "expected"), [("a\r\nb\rc\nd\n\n", ["a\r\n", "b\r", "c\n", "d\n", "\n"]), ("", []), ("x y\x1cz", ["x ", "y\x1c", "z"])])
def test_lines(spark, text, expected):
    assert one(spark, X.lines(F.col("t")), t=text) == expected == text.splitlines(keepends=True)


@pytest.mark.parametrize(("word", "ok"), [(" big ", True), ("two words", False), ("a1", False), (None, False), ("", False), ("a\n", True), ("é", False)])
def test_one_word(spark, word, ok):
    assert one(spark, X.one_word(F.col("t")), t=word) is ok


@pytest.mark.parametrize(("word", "ref", "out"), [("large", "BIG", "LARGE"), ("large", "Big", "Large"), ("me", "I", "ME"), ("large", "big", "large"), ("x", "1", "x"), ("big", "", "big")])
def test_match_case(spark, word, ref, out):
    assert one(spark, X.match_case(F.col("a"), F.col("b")), a=word, b=ref) == out


def test_marked(spark):
    r = one(spark, X.marked_target(F.col("t")), t="x **a b** y **c**")
    assert tuple(r) == ("x a b y **c**", "x ", "a b", " y **c**")
    assert one(spark, X.marked_target(F.col("t")), t="x *a* y") is None
    assert one(spark, X.marked_target(F.col("t")), t="**a\nb**") is None


@pytest.mark.parametrize(
    ("listed", "words"),
    [
        ("['big (B2)', 'large']", ["big", "large"]), ("big, large", ["big", "large"]), (None, []), ("", []), ("[]", []), ('["it\'s", "x"]', ["it's", "x"]),
        ("[['a', 'B2'], ['b', 'C1']]", ["a", "b"]), ("[('a', 'B2'), ('b', 'C1')]", ["a", "b"]), ("[big, large]", ["big", "large"]), ("'one'", ["one"]), ("[' a ', '', 'b']", ["a", "b"]),
    ],
)
def test_parse_words(spark, listed, words):
    assert one(spark, X.parse_words(F.col("t")), t=listed) == words


def test_distinct_words(spark):
    assert one(spark, X.distinct_words(F.col("w")), w=["Big", "big", "Large", "BIG"]) == ["Big", "Large"]


@pytest.mark.parametrize(("labels", "score"), [(["TRUE", "FALSE", "TRUE_IMPLICIT"], 2 / 3), ([], 0.0), (["true", None], 0.5)])
def test_label_score(spark, labels, score):
    assert one(spark, X.label_score(F.col("w")), w=labels) == pytest.approx(score)


@pytest.mark.parametrize(
    ("sentence", "target", "problem", "prefix"),
    [("party art", "art", "target_repeated", None), ("an Art show", "art", None, "an "), ("no hit", "art", "target_not_found", None), ("a.b", "a.b", None, ""), ("", "x", "target_not_found", None), ("Art art", "art", None, "Art ")],
)
def test_find_target(spark, sentence, target, problem, prefix):
    r = one(spark, X.find_target(F.col("a"), F.col("b")), a=sentence, b=target)
    assert (r["problem"], r["prefix"]) == (problem, prefix)
    if problem is None:
        assert r["prefix"] + r["target"] + r["suffix"] == sentence


def written_words(s):
    """A plain version: the value of a literal, or else what stands between commas."""
    import ast
    import re

    if s is None:
        return []
    try:
        value = ast.literal_eval(s.strip())
    except (ValueError, SyntaxError):
        value = [x for x in re.sub(r"^[\[\]]+|[\[\]]+$", "", s.strip()).split(",")]
    value = value if isinstance(value, list) else [value]
    out = []
    for x in value:
        x = (x[0] if x else "") if isinstance(x, (list, tuple)) else x
        x = re.sub(r"\s*\([^)]*\)\s*\Z", "", str(x).strip().strip("'").strip('"')).strip()
        out += [x] if x else []
    return out


def test_written_lists_of_many_shapes(spark):
    from spanlens.functions import text as X

    shapes = ["'a', 'b'", "('a','b')", "['a' 'b']", "['a', 'b']", '["a", \'b\']', "'a'", "('a')", "a, b", "[a, b]", "['a (x)', 'b']", "[['a', 1], ['b', 2]]", "[('a', 1), ('b', 2)]", "", "[]", "['', 'b']", "\"a\", 'b'", "('a',)", "['a' 'b', 'c']", "['a b', 'c d']"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([*shapes, None])], "i int, s string")
    got = {r["i"]: r["w"] for r in rows.select("i", X.parse_words(F.col("s")).alias("w")).collect()}
    for i, s in enumerate([*shapes, None]):
        assert got[i] == written_words(s), s
