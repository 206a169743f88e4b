"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a new local one if everything runs in one process, as
    in tests, and an error on a cluster, whose machines would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spanlens-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder, which is deleted when the application ends."""
    root = f"{shared_dir(spark)}/spanlens/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


ARROW_BYTES = 4 << 20


def bound_arrow(spark: SparkSession) -> None:
    """Makes Spark hand texts to Python in batches of at most ``ARROW_BYTES``, unless the session has a smaller bound.

    Spark's own bound is 64 MB, which each running task holds several times outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(key, f"{ARROW_BYTES}b")


@contextlib.contextmanager
def lean_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside are deleted at its end rather than when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``stage`` in files by a hash of ``key``: grouping or joining by it later moves no row of the table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"spanlens_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its files stay: the name was only needed to write them
    return out


def drop_staged(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any longer."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucket_of(column: str, modulus: int):
    """``crc32`` of the id as text, modulo ``modulus``; null ids fall in bucket of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def hashed_sample(df: DataFrame, group: str, key: str, sizes: dict, n: int, seed: int) -> DataFrame:
    """The ``n`` rows of each group with the smallest hashes of ``key`` and then the smallest keys, all of a group that has
    fewer: the same ones whatever the table's size or partitions.

    ``sizes``: rows by group, of which there are few. A threshold on the full hash, at about twice what is asked for, leaves few rows to be ordered."""
    most = [(name, min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, (2 * n + 100) / max(1, rows))))) for name, rows in sizes.items()]
    limits = df.sparkSession.createDataFrame(most, T.StructType([T.StructField("of", df.schema[group].dataType), T.StructField("most", T.LongType())]))
    mark = F.xxhash64(F.col(key), F.lit(seed))
    order = Window.partitionBy(group).orderBy(mark, key)
    few = df.join(F.broadcast(limits), F.col(group).eqNullSafe(F.col("of")) & (mark <= F.col("most"))).drop("of", "most")
    return few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one scan, one number."""
    return docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
