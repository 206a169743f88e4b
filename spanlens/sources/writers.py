"""Writing results: records and skipped rows as JSON lines, summaries as one JSON file, tables as CSV, histograms as pictures."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def derived_paths(out: str) -> dict[str, str]:
    """Where the summary and the skipped rows of an output go: always other paths than the output itself."""
    stem = next((out[: -len(s)] for s in (".jsonl", ".csv", ".json") if out.endswith(s)), out.rstrip("/"))
    return {"records": out, "summary": f"{stem}.summary.json", "skipped": f"{stem}.skipped.jsonl"}


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of JSON lines in which null fields are kept; it is there for an empty table too."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV with a header; arrays, maps and structs are written as JSON."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    flat = df.select(*(F.to_json(F.col(f"`{c}`")).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns))
    flat.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, by the file system that the path names; folders are made."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_summary(spark: SparkSession, path: str, summary: dict) -> str:
    text = json.dumps(summary, indent=2, ensure_ascii=False, default=str)
    write_text(spark, path, text)
    return text


def draw_histogram(bins: DataFrame, path: str, title: str = "", density: bool = False, means: dict[str, float] | None = None, xlim=None, ylim=None) -> None:
    """An overlay of the bins of all series, with their means; needs matplotlib."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError as e:
        raise RuntimeError("matplotlib is not installed: the bins are in the DataFrame") from e
    figure, axes = pyplot.subplots()
    rows = bins.orderBy("series", "bin").collect()
    for name in sorted({r["series"] for r in rows}):
        own = [r for r in rows if r["series"] == name]
        axes.stairs([r["value"] for r in own], [own[0]["low"], *(r["high"] for r in own)], fill=True, alpha=0.5, label=name)
        if means and name in means:
            axes.axvline(means[name], linestyle="--")
    axes.set(title=title, xlabel="negative log-likelihood", ylabel="density" if density else "count", xlim=xlim, ylim=ylim)
    axes.legend()
    figure.savefig(path, dpi=300)
    pyplot.close(figure)
