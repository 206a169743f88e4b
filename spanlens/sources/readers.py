"""Reading the inputs: JSON lines, JSON documents, CSV with missing words, snapshots of hub datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanlens.sources.scratch import staged

# Words that a CSV cell has in place of a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

NUMBER_PAIRS = "idx bigint, type string, level string, original_problem string, problem string, original_answer string, answer string"
CODE_PAIRS = (
    "name string, variant_id string, original_buggy_program string, counterfactual_buggy_program string, buggy_span string, original_span string, "
    "counterfactual_span string, fix_span string, buggy_line string, counterfactual_line string, solution_line string, span_start int, span_end int, "
    "line_index int, mutation_type string, solution string"
)
SUBSTITUTIONS = (
    "contexts map<string,struct<context:string>>, targets map<string,struct<context_id:string,target:string,offset:int,pos:string>>, "
    "substitutes map<string,struct<target_id:string,substitute:string>>, substitute_labels map<string,array<string>>"
)


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, a line that doesn't parse is an error, absent fields are null."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_code_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Program pairs, with ``span``: ``buggy_span`` where the line has that key, even if it is null, else ``original_span``."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", CODE_PAIRS, {"mode": "FAILFAST"}).alias("r"), F.json_object_keys("value").alias("keys"))
    span = F.when(F.array_contains("keys", "buggy_span"), F.col("r.buggy_span")).otherwise(F.col("r.original_span"))
    return parsed.select("r.*", span.alias("span"))


def read_dataset(spark: SparkSession, path: str, schema: str = NUMBER_PAIRS) -> DataFrame:
    """A ``.json`` file as one document (an array of rows or a row), ``.parquet`` or a folder of it, else JSON lines."""
    if path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if path.endswith((".jsonl", ".jsonl.gz")):
        return read_json_lines(spark, path, schema)
    return spark.read.parquet(path)


def read_snapshot(spark: SparkSession, name: str, split: str = "test", root: str = "snapshots") -> DataFrame:
    """A hub dataset from a local snapshot ``root/name/split`` in Parquet; nothing is fetched."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}/{split}")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, missing: tuple[str, ...] = MISSING) -> DataFrame:
    """CSV with a header, quoted line ends and doubled quotes; text cells that stand for a missing value are null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`") for c in df.columns))


def read_substitutions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document of id-keyed maps, gzipped if its name says so."""
    return spark.read.schema(SUBSTITUTIONS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def with_ordinal(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """``df`` with the number of each row in the input's order, from 0 without gaps.

    Rows that come from files go by the file's name and their place in it, others by their partition. The numbered table is
    written once, so that counts and rows come from one run; the driver sees one count a file and partition. A column of that
    name is replaced."""
    df = df.drop(name)
    columns = [F.col(f"`{c}`") for c in df.columns]
    own = df.select(F.struct(*columns).alias("row"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("id"))
    own = staged(own.withColumn("part", F.shiftrightunsigned("id", 33).cast("int")), "ordinal")
    # parts of one file are read in the order of their offsets, whatever their size
    runs = own.groupBy("file", "part").agg(F.count("*").alias("n"))
    base, at = [], 0
    for r in sorted(runs.collect(), key=lambda r: (r["file"], r["part"])):
        base.append((r["file"], r["part"], at - 1))
        at += r["n"]
    table = df.sparkSession.createDataFrame(base, "file string, part int, base long")
    place = F.row_number().over(Window.partitionBy("file", "part").orderBy("id"))
    numbered = own.withColumn("id", place).join(F.broadcast(table), ["file", "part"])
    return numbered.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns), (F.col("base") + F.col("id")).alias(name))


def require_columns(df: DataFrame, names: list[str]) -> None:
    if lost := [c for c in names if c not in df.columns]:
        raise ValueError(f"columns {lost} are not there; there are {df.columns}")


def target_column(df: DataFrame, names: tuple[str, ...] = ("target word", "target_word", "target")) -> str:
    """The first of ``names`` that is a column."""
    found = next((c for c in names if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of the columns {list(names)} is there; there are {df.columns}")
    return found
