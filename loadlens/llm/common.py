"""What the text operators share: column checks, a shared scratch folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: ASCII only, the same in Java, RE2 and Python's bytes.split().
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of a batch that travels to a Python worker, about; rows are cut by size, as texts may be long.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES from now on, unless the session has a setting of its own."""
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def scratch(spark: SparkSession) -> str:
    """This application's folder in the one all executors share: spark.checkpoint.dir, or a temporary one where that is unset
    and there is one JVM only. It goes when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(spark, "_loadlens_scratch", None) or tempfile.mkdtemp(prefix="loadlens-")
        spark._loadlens_scratch = folder
    own = f"{folder.rstrip('/')}/loadlens-{spark.sparkContext.applicationId}"
    if getattr(spark, "_loadlens_own", None) != own:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        spark._loadlens_own = own
    return own


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df as a table written once in the shared folder: it cuts the lineage, so a lost executor costs no recomputation.

    The shuffle files that made it go at once. ``dropped`` deletes the table when no later step reads it; what a result
    still reads stays until the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"
    with _set(spark, _CLEANUP, "true"):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loadlens_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later step reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._loadlens_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
