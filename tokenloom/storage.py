"""Working tables in the folder that all executors share, and running sums over tables of any size."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. In local mode one of our own where that is unset; on a cluster a
    folder of one machine would lose rows, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="tokenloom-")
        _OWN.add(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; release() removes it."""
    path = f"{shared_dir(spark)}/tokenloom-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(_at_exit, path)
    return path


def _at_exit(path: str) -> None:
    if path.startswith("file:"):
        shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)


def release(spark: SparkSession) -> None:
    """Remove this application's working tables; data frames that read them can't be used any more."""
    path = work_dir(spark)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that materialize() gave; no data frame that reads it can be used any more."""
    files = df.inputFiles()
    if files:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(columns: list[str], name: str) -> str:
    """name, or with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside hands at most so many rows at a time to Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(was) <= 0 else min(rows, int(was))))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def portions(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in order: sizes of the rows in each sum up to at most `most`, or it is a single row."""
    ends, lo = np.cumsum(sizes, dtype=np.int64), 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def running(df: DataFrame, order: list[str] | str, value: Column, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `out`, the sum of value over the rows of its group `by` up to this one, in the order given; see running_sums."""
    return running_sums(df, order, {out: value}, by)


def running_sums(df: DataFrame, order: list[str] | str, values: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of each value, under its name, over the rows of its group `by` up to this one, in the order given.

    Rows are range-partitioned by group and order and written; sums run inside a partition, and the
    sums of whole partitions, of which there are as many as shuffle partitions, are added. So no task holds a group, whatever the
    order column's values are. Nulls come first; ties are ordered by a hash of the row, so only equal rows are
    interchangeable. A null value counts as 0. Existing columns of these names are replaced; others stay. All columns of
    df are shuffled, written and sorted: wide ones are better joined to the sums afterwards.
    """
    order = [order] if isinstance(order, str) else list(order)
    df = df.drop(*(out for out in values if out not in order and out not in by))
    taken = [*df.columns, *values]
    part, tie = (free_name(taken, n) for n in ("part", "tie"))
    val, base, local = ([free_name(taken, f"{n}{i}") for i in range(len(values))] for n in ("val", "base", "local"))
    summed = {v: F.coalesce(x.cast("long"), F.lit(0).cast("long")) for v, x in zip(val, values.values())}
    rows = df.withColumns(summed | {tie: F.xxhash64(*df.columns)})
    keys = [*by, *order, tie]
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows.repartitionByRange(count, *keys).withColumn(part, F.spark_partition_id()), "ordered")
    inside = Window.partitionBy(part, *by).orderBy(*(F.asc_nulls_first(c) for c in (*order, tie))).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(part, *by).agg(*(F.sum(v).alias(v) for v in val))
    totals = totals.select(part, *by, *(F.coalesce(F.sum(v).over(before), F.lit(0).cast("long")).alias(x) for v, x in zip(val, base)))
    a, b = rows.select("*", *(F.sum(v).over(inside).alias(x) for v, x in zip(val, local))).alias("a"), totals.alias("b")
    same = F.col(f"a.{part}") == F.col(f"b.{part}")
    for c in by:
        same = same & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    sums = [(F.col(f"a.{x}") + F.col(f"b.{y}")).alias(out) for x, y, out in zip(local, base, values)]
    return a.join(b, same).select(*(F.col(f"a.`{c}`") for c in df.columns if c not in values), *sums)


def numbered(df: DataFrame, order: list[str] | str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `out`, the row's number in order, from 0."""
    return running(df, order, F.lit(1), out, by).withColumn(out, F.col(out) - 1)
