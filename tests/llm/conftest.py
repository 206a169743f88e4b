from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(k: int, n: int) -> str:
    """n words that depend on k alone."""
    x, out = k * 2654435761 % 2**32 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty and very long texts, repeats, ties, odd white space."""
    shared = sentence(1, 40)
    return [
        (1, shared, "en", "a", 1), (2, f"{sentence(2, 20)} {shared}", "en", "a", 2), (3, None, "en", "b", None), (4, "", None, "b", 0), (5, " \t\n", "de", None, 3),
        (6, shared, "de", "a", 1), (7, "One\x0bTwo three four\nfive five\nfive five", "fr", "c", 9), (8, sentence(3, 60_000), "en", "a", 9),
        (9, f"{sentence(4, 12)}", "en", "b", 9), (10, f"{sentence(4, 12)} {sentence(5, 30)}", "en", "b", 9), (11, f"{sentence(5, 30)}\n{sentence(5, 30)}", "en", "b", 9),
        (12, "\U0001f600 été 12,5 \U0001f600", "fr", "c", 9), (13, "a", "xx", "d", 1), (14, sentence(3, 60_000)[:200_000], "en", "a", 9),
    ]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(documents):
    return sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())


CLASHES = ("key", "fp", "chunk", "bucket", "rest", "id", "shard", "class", "size", "taken", "_key", "piece", "lane", "n", "label", "rank", "words",
           "_size", "_taken", "_whole", "_rest", "_mark", "_i", "_keep", "_same", "_id", "_n", "mark", "row", "same", "own", "end", "all", "cell", "data", "to")


@pytest.fixture(scope="session")
def clashing(spark, odd_docs):
    """The odd rows with extra columns of names that operators use inside."""
    from pyspark.sql import functions as F

    return odd_docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
