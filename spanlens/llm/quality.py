"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Rules are rows of ``RULES``; ``compile_rules`` turns them into one boolean expression over the statistics that
``measures`` derives from the text. Everything is built-in expressions: no shuffle, no Python on the executors.

Defined results: a null text has no words (all counts 0) and fails; an empty text likewise; repeated rows each get
their row; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
STOP_WORDS = (
    "the of and to in is that it for on was as with be by are this at from an "  # English
    "der die das und den von zu mit des im ist ein eine "  # German
    "le la les de et un une du que est dans "  # French
    "el los las y en que un una por con se del al "  # Spanish
    "o os da do em um uma para com não il lo gli di che per non het een van dat niet och att det som på w i na z do nie się и в не на что с по"  # others
).split()


@dataclass(frozen=True)
class Rule:
    """Keeps rows in which ``measure`` lies from ``least`` to ``most``; rows of fewer than ``from_words`` words pass."""

    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


RULES = (
    Rule("n_words", least=10),
    Rule("mean_word_chars", least=2.0, most=14.0),
    Rule("symbols_per_word", most=0.1),
    Rule("dup_line_ratio", most=0.4),
    Rule("repeat_word_ratio", most=0.2),
    Rule("distinct_stop_words", least=1, from_words=50),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_hashes(words: Column, window: int) -> Column:
    """Hashes of all runs of ``window`` words, by doubling: the hash of 4 words is that of the hashes of two pairs."""

    def longer(ones: Column, n: int) -> Column:
        if n == 1:
            return ones
        if n % 2:
            return let(longer(ones, n - 1), lambda a: F.zip_with(a, F.slice(ones, n, F.size(ones)), lambda x, y: F.xxhash64(x, y)))
        return let(longer(ones, n // 2), lambda a: F.zip_with(a, F.slice(a, n // 2 + 1, F.size(ones)), lambda x, y: F.xxhash64(x, y)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda ones: F.slice(longer(ones, window), 1, F.size(ones) - window + 1))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows whose hash occurs twice or more. Windows are compared by 64-bit hash."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda p: F.filter(p, lambda x, k: F.get(p, k - 1)["h"].eqNullSafe(x["h"]) | F.get(p, k + 1)["h"].eqNullSafe(x["h"])))
        again = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(
            again,
            lambda a: F.aggregate(
                F.transform(a, lambda x, k: F.when(k == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - F.get(a, k - 1)))),
                F.lit(0),
                lambda s, x: s + x,
            ),
        )

    found = let(window_hashes(words, window), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < window + 1, F.lit(0)).otherwise(found)


def words_of(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\\x20\\x09-\\x0D]+", "")
    return F.filter(F.split(trimmed, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that rules speak of; one projection over another, no exchange."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return (
        docs.withColumn("_words", words_of(F.col(text)))
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
                "n_symbols": (F.char_length(body) - F.char_length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
                "_lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))),
                "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
                "distinct_stop_words": F.size(F.array_intersect("_words", F.array(*(F.lit(x) for w in STOP_WORDS for x in (w, w.capitalize()))))).cast("long"),
            }
        )
        .withColumns({"n_lines": F.col("_lines.n").cast("long"), "n_dup_lines": (F.col("_lines.n") - F.col("_lines.distinct")).cast("long")})
        .drop("_words", "_lines")
    )


def ratios() -> dict[str, Column]:
    c = {k: F.col(k).cast("double") for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "distinct_stop_words")}
    words = F.greatest(c["n_words"], F.lit(1.0))
    return c | {
        "mean_word_chars": c["word_chars"] / words,
        "symbols_per_word": c["n_symbols"] / words,
        "dup_line_ratio": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)),
        "repeat_word_ratio": c["n_repeat_words"] / words,
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression: true where every rule holds."""
    of, verdict = ratios(), F.lit(True)
    for r in rules:
        holds = F.lit(True)
        if r.least is not None:
            holds &= of[r.measure] >= F.lit(r.least)
        if r.most is not None:
            holds &= of[r.measure] <= F.lit(r.most)
        verdict &= holds | (F.col("n_words") < r.from_words) if r.from_words else holds
    return verdict


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, the base verdict and the rules' verdict of every document."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"), "n_lines", "distinct_stop_words",
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
