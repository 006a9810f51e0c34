"""Scans of Parquet, JSONL, JSON and CSV files, with a file-order ordinal where order counts (SRC3-SRC8, SRC10)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.schemas import conform
from quillon.sources.sinks import read_text


def read_parquet(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Declared columns only; types that a writer inferred otherwise (all-null columns) are cast."""
    df = conform(spark.read.parquet(path), schema)
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType, limit: int | None = None) -> DataFrame:
    """Rows of JSONL files plus _ord, which follows file and line order; blank lines are skipped."""
    df = spark.read.schema(schema).json(paths)
    df = df.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_ord"))
    return df if limit is None else df.orderBy("_ord").limit(limit)


def read_summary(path: str) -> dict:
    """A score summary, a few kilobytes of JSON, on the driver."""
    if (text := read_text(path)) is None:
        raise FileNotFoundError(path)
    return json.loads(text)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings."""
    return spark.read.option("header", True).csv(path)


def read_metadata(spark: SparkSession, metadata_csv: str, split_csv: str | None = None) -> DataFrame:
    """subject_id, study_id, dicom_id and the split of each, null where there is none."""
    meta = read_csv(spark, metadata_csv).select("subject_id", "study_id", "dicom_id")
    if split_csv is None:
        return meta.withColumn("split", F.lit(None).cast("string"))
    split = read_csv(spark, split_csv).select("subject_id", "study_id", "dicom_id", "split").dropDuplicates(["subject_id", "study_id", "dicom_id"])
    return meta.join(split, ["subject_id", "study_id", "dicom_id"], "left")


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Paths and contents of image files; the contents are read only where they are used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
