"""The training-data pipeline: four filters and mixes that hand on documents, then sequences of packed tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.

Defined results, by stage. A null or empty text has no sentence and isn't toxic; it is a near copy of other such texts, of
which one row stays; it has no repeated passage; it weighs nothing in the mix and stays once; it packs as the end id alone.
Texts of any length are read whole. Ties: a score equal to the threshold is toxic; of a group of near copies the smallest doc_id
stays, then the smallest fingerprint and hash of the text, then one of equal rows; of equal passages the one in the smallest
doc_id stays. Rows with one doc_id are rows of their own, and a null doc_id stays null. An empty table gives an empty table.
Columns besides ``doc_id``, ``text``, ``source`` and ``n_chars`` are handed on as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlens.llm import mixing, packing, simhash, substring, toxicity
from spanlens.llm.shared import stage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", remove_repeats),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]
#: Trained scores, connected components and tokenizers can't be expressed in SQL: the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES, 1):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
