"""Tables that cut the lineage: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or the one set as the context's checkpoint folder.

    Where neither is set, local mode gets one beside the warehouse; a cluster gets an error, for executors
    don't share the driver's disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Bytes that a file of a scratch table should hold, where the table's size is known beforehand.
FILE_BYTES = 16 << 20


def materialize(df: DataFrame, rows: int | None = None, width: int = 64, codec: str | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read back.

    The files survive lost executors, and the reread table has column pruning and statistics. rows: a bound of
    its rows, of `width` bytes each, for a last step that is light: small tables then go to few files, whatever
    the number of shuffle partitions; large ones are written as they are. codec: of the files, the session's if not
    given; zstd halves ids, which are text of hex digits. A step that is done with its own tables
    discards them; those that a result still reads go when the session ends.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows * width // FILE_BYTES)))
    path = f"{scratch_dir(spark)}/quillon/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    if (made := _made.get()) is not None:
        made.append(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(fs_path)
    return out


def laid_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """df as a scratch table bucketed by the keys: one shuffle now, and none for group-bys over these keys and more.

    It has as many buckets as there are shuffle partitions, lies in the shared folder and is discarded like other scratch tables.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"quillon_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/quillon/{name}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._quillon_path, out._quillon_table = path, name
    if (made := _made.get()) is not None:
        made.append(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(fs_path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        if name := getattr(df, "_quillon_table", None):
            df.sparkSession.sql(f"drop table if exists {name}")
        _delete(df.sparkSession, df._quillon_path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Scratch tables made inside go at its end, but for those put into the list it gives."""
    made, kept = [], []
    token = _made.set(made)
    try:
        yield kept
    finally:
        _made.reset(token)
        for name in set(made) - {df._quillon_path for df in kept}:
            _delete(spark, name)
