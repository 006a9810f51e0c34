"""Shared helpers: scratch tables, folds, bounded labelled samples and streamed groups."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.scratch import discard, materialize

__all__ = ["WORD_BREAKS", "bounded_sample", "column", "discard", "fold", "gathered", "join_hot", "labelled_sample", "lean", "materialize", "texts", "unused"]

#: The characters that separate words; everything else is part of a word.
WORD_BREAKS = r"[\x20\x09-\x0D]+"


@contextmanager
def lean():
    """Gives memory back to the system at the end of a Python task, as workers are used again and again."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library
            pass


#: Rows of one key from which they stay where they are in a join, and the most keys that are treated so.
HOT_ROWS, HOT_KEYS = 100_000, 100_000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """left.join(right, on), right having one row for each key, hot being a small scan of the keys with many rows on the left.

    Rows of hot keys are not shuffled, which would bring each key's to one task: their partners, whose number is
    checked, are broadcast instead.
    """
    if not 0 < hot.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        return left.join(right, on)
    keys = F.broadcast(hot.select(*on))
    rest = left.join(keys, on, "left_anti").join(right, on)
    return left.join(F.broadcast(right.join(keys, on)), on).select(*rest.columns).unionByName(rest)


def fold(id_col: str, k: int):
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % k


def unused(df: DataFrame, name: str) -> str:
    """The name, with signs before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded_sample(df: DataFrame, id_col: str, columns: list[str], rows: int) -> list:
    """At most `rows` rows to fit a model on, chosen by a hash of the id; ties by id, and an id's rows by their values.

    Only ids are ranked; the other columns are fetched for the chosen ids alone, one row for each.
    """
    own = df.select(df[id_col].alias("_id"), *(df[c].alias(f"_c{i}") for i, c in enumerate(columns)))
    chosen = own.select("_id", F.xxhash64("_id").alias("_h")).orderBy("_h", "_id").limit(rows).select(F.col("_id").alias("_i")).distinct()
    got = own.join(F.broadcast(chosen), F.col("_id").eqNullSafe(F.col("_i")), "left_semi")
    one = got.groupBy("_id").agg(F.min(F.struct(*(f"_c{i}" for i in range(len(columns))))).alias("r")).select("r.*").collect()
    return sorted((tuple(r) for r in one), key=repr)


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, where, rows: int, id_col: str, text: str) -> list[tuple[str | None, int]]:
    """(text, label) of at most `rows` documents with a label of 0 or 1, chosen by a hash of the id.

    Ids with both labels have none. where: a condition on doc_id. Of several texts under an id the smallest is taken.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y"))
    known = (known if where is None else known.where(where)).groupBy("doc_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z")
    chosen = known.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(rows).select(F.col("doc_id").alias("_i"), "_y")
    own = df.select(df[id_col].alias("_id"), df[text].alias("_t"))
    got = own.join(F.broadcast(chosen), F.col("_id") == F.col("_i")).groupBy("_id").agg(F.min("_t").alias("_t"), F.min("_y").alias("_y")).collect()
    return [(r["_t"], r["_y"]) for r in sorted(got, key=lambda r: r["_id"])]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text", step: int = 256) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with their texts as Python strings, few at a time to bound memory."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, column(part, name).to_pylist()


def gathered(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, in rows sorted by the keys, with where each run starts and the end.

    A run may span batches; runs are bounded by their callers, so what is held over is too.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(change) + 1]
        if len(starts) > 1:
            yield t.slice(0, int(starts[-1])), starts
        held = t.slice(int(starts[-1]))
    if held is not None:
        yield held, np.array([0, held.num_rows])
