"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, unlimited."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    A local one is made where none is set and all tasks run on this machine; on a cluster that is an error, as other
    machines could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="isochron-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            folder = current
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write within go as soon as it has ended, and not when the driver happens to collect garbage.

    Only for writes: each is planned anew, so nothing comes back for its shuffles.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the copy, so that lost executors don't redo its lineage."""
    return stored(df, "cut")


def stored(df: DataFrame, label: str) -> DataFrame:
    """As ``cut``, under a label: a compressed Parquet table, of which single columns can be read again."""
    path = fresh_path(df.sparkSession, label)
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked_table(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """``df`` with its places 1, 2, ... in an order over all rows, as a written table.

    Rows are dealt by ranges of the order and sorted where they lie, so no task holds all; a place is the row's number
    within its range plus the rows of the ranges before it, of which there are as many as shuffle partitions.
    """
    spot = F.monotonically_increasing_id()
    written = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__spot", spot), label)
    part, within = F.shiftright("__spot", 33), F.col("__spot").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = written.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return written.join(F.broadcast(before), part == F.col("__part")).withColumn(name, F.col("__before") + within + 1).drop("__spot", "__part", "__before")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, made from ``name``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def discard(table: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once all that is made of it is written itself."""
    files = table.inputFiles()
    if files:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each row; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]
