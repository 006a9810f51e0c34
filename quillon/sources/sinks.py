"""Writers (SNK1-SNK11), and what is counted while they write."""

from __future__ import annotations

import csv
import io
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.schemas import conform


def write_parquet(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    (conform(df, schema) if schema else df).write.mode("overwrite").parquet(path)


def sorted_keys(c: Column, kind: T.DataType) -> Column:
    """The value with the fields of structs in alphabetical order, at every depth."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(sorted_keys(c[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name))))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: sorted_keys(x, kind.elementType))
    return c


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, keys sorted at every depth, nulls kept. A directory of files, written by the executors."""
    columns = [sorted_keys(df[f.name], f.dataType).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name) if f.name != "_ord"]
    df.select(*columns).write.mode("overwrite").option("ignoreNullFields", False).json(path)


class Tally:
    """Counts that plans take while they are written, so that no table is read again to be counted.

    tally(df, counts) is df with aggregates to observe; `counts()` has them once everything observed was written.
    Place it above range shuffles, or below a materialized table: a sampled sort runs what is below it twice.
    """

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def __call__(self, df: DataFrame, *told: Column) -> DataFrame:
        self._seen.append(Observation())
        return df.observe(self._seen[-1], *told)

    def counts(self) -> dict[str, int]:
        return {k: v for o in self._seen for k, v in o.get.items()}


def _session() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def file_system(path: str, spark: SparkSession | None = None):
    """(file system, path) of a local path or a URI of any store that Hadoop knows."""
    spark = spark or _session()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs), p  # a local file's checksum is a second file, which a rename can't replace with it


def read_text(path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, p = file_system(path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """A small file, written beside its place and then renamed to it, so that readers see the old or the new one whole."""
    fs, p = file_system(path)
    part = p.suffix(f".{uuid.uuid4().hex}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.getUri().getScheme() == "file" and fs.rename(part, p):  # replaces what is there
        return
    spark = _session()
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    part, p = fs.makeQualified(part), fs.makeQualified(p)
    hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(part, p, overwrite)


def write_json(path: str, payload: dict) -> None:
    """Small results of aggregates: indented, keys sorted."""
    write_text(path, json.dumps(payload, indent=2, sort_keys=True) + "\n")


def update_summary(path: str, section: str, payload: dict) -> None:
    """Replace one section of a summary and leave the others; writers of different sections don't disturb each other.

    Each section is a file of its own under `path`.sections, which its writer replaces whole; the summary is put
    together from all that are there, by every writer after its own section, so the last one has them all. Sections of
    a summary without that folder are taken over from the summary itself.
    """
    folder = f"{path}.sections"
    for name, old in (json.loads(read_text(path) or "{}")).items():
        if name != section and read_text(f"{folder}/{name}.json") is None:
            write_json(f"{folder}/{name}.json", old)
    write_json(f"{folder}/{section}.json", payload)
    while (now := _sections(folder)) != json.loads(read_text(path) or "null"):  # again if another writer came between
        write_json(path, now)


def _sections(folder: str) -> dict:
    fs, p = file_system(folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return {n.removesuffix(".json"): json.loads(text) for n in names if n.endswith(".json") and (text := read_text(f"{folder}/{n}")) is not None}


def write_csv_rows(rows: list[dict], path: str, columns: list[str]) -> None:
    """A report of a few rows; the header is there even without rows, nulls are empty."""
    text = io.StringIO(newline="")
    out = csv.DictWriter(text, columns, extrasaction="ignore", restval="")
    out.writeheader()
    out.writerows(rows)
    write_text(path, text.getvalue())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_url_list(links: DataFrame, path: str) -> None:
    """One URL a line, of the links that matched."""
    links.where((F.col("link_status") == "matched") & F.col("source_url").isNotNull()).select("source_url").write.mode("overwrite").text(path)
