"""Image index, metadata links and download manifests (CMP6, CMP9, CMP10, JN7, JN8, AGG5, AGG6, AGG15, AGG16)."""

from __future__ import annotations

import io
import os
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import relative_image_path, truthy
from quillon.schemas import IMAGE_INDEX, IMAGE_KEY, LINKS, conform
from quillon.sources import storage

#: Download statuses whose file is not there to be linked.
UNAVAILABLE = ["failed", "dry_run", "missing_local"]


def image_index(objects: DataFrame, assertions: DataFrame) -> DataFrame:
    """Distinct (patient, study, image) of both tables; null images are dropped, empty ones stay."""
    both = objects.select(*IMAGE_KEY).unionByName(assertions.select(*IMAGE_KEY)).where("image_id is not null").distinct()
    return conform(both.select(*IMAGE_KEY, F.col("image_id").alias("dicom_id"), F.lit(True).alias("has_chest_imagenome"), F.lit(False).alias("has_radgraph")), IMAGE_INDEX)


def image_index_counts() -> list[Column]:
    return [
        F.count("*").alias("image_index_rows"), F.count_if(truthy(F.col("image_path"))).alias("non_null_image_path_rows"),
        F.count_if(F.coalesce("has_chest_imagenome", F.lit(False))).alias("has_chest_imagenome_rows"), F.count_if(F.coalesce("has_radgraph", F.lit(False))).alias("has_radgraph_rows"),
    ]


def image_index_summary(index: DataFrame) -> DataFrame:
    return index.agg(*image_index_counts())


def needed_images(items: list[DataFrame]) -> DataFrame:
    """Distinct images that the splits' items ask for."""
    return reduce(DataFrame.unionByName, [i.select(*IMAGE_KEY, "dicom_id") for i in items]).distinct()


def classify_links(needed: DataFrame, metadata: DataFrame, root: str = "", base_url: str = "") -> DataFrame:
    """matched; id_mismatch: the image is known under another study; missing_metadata."""
    exact = metadata.select(F.col("subject_id").alias("_p"), F.col("study_id").alias("_s"), F.col("dicom_id").alias("_d"), "split", F.lit(True).alias("_exact")).dropDuplicates(["_p", "_s", "_d"])
    known = metadata.select(F.col("dicom_id").alias("_known")).distinct()
    j = needed.join(exact, (needed.patient_id == F.col("_p")) & (needed.study_id == F.col("_s")) & (needed.dicom_id == F.col("_d")), "left").join(known, needed.dicom_id == F.col("_known"), "left")
    status = F.when(F.col("_exact"), "matched").when(F.col("_known").isNotNull(), "id_mismatch").otherwise("missing_metadata")
    path = relative_image_path(F.col("patient_id"), F.col("study_id"), F.col("dicom_id"))
    out = j.select(*IMAGE_KEY, "dicom_id", "split", status.alias("link_status"), path.alias("_path"))
    hit = F.col("link_status") == "matched"
    return conform(out.select("*", F.when(hit, F.concat(F.lit(root), "_path")).alias("image_path"), F.when(hit, F.concat(F.lit(base_url), "_path")).alias("source_url")), LINKS)


def link_summary(links: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("link_status") == s)
    return links.agg(F.count("*").alias("unique_requested_images"), n("matched").alias("matched_metadata_rows"), n("id_mismatch").alias("id_mismatches"), n("missing_metadata").alias("missing_metadata"))


def download_manifest(
    links: DataFrame, dry_run: bool = True, fetch=None, limit: int | None = None, link_only_existing: bool = False, overwrite: bool = False, timeout_seconds: float = 60.0,
    username_env: str | None = None, password_env: str | None = None, exists=storage.exists, log: str | None = None, run_id: str = "",
) -> DataFrame:
    """download_status of every matched link.

    existing: the file is there and is not to be overwritten. missing_local: it is not, and only existing files
    are to be linked. Else dry_run, or downloaded as fetch(url, path, timeout_seconds=, credentials=) did it, or
    failed if that raised. Downloads run on the executors, one partition's links after another; nothing is
    fetched in a dry run. Credentials are read on the executors from the named environment variables.

    Paths and the folder log have to be on storage that all executors share. With a log every fetched file is noted
    there with run_id, after it is whole: a task that is tried again, and a run that is started again under the same
    run_id, fetch only what is missing (with overwrite too) and call the rest downloaded.
    """
    rows = links.where("link_status = 'matched'")
    rows = rows if limit is None else rows.orderBy(*IMAGE_KEY).limit(limit)
    if fetch is None and not dry_run and not link_only_existing:
        raise ValueError("a download needs a function fetch")

    def status(url: str, path: str) -> str:
        if log and storage.read_bytes(storage.marker(log, path)) == run_id.encode() and exists(path):
            return "downloaded"
        if not overwrite and exists(path):
            return "existing"
        if link_only_existing:
            return "missing_local"
        if dry_run:
            return "dry_run"
        user, word = (os.environ.get(v) if v else None for v in (username_env, password_env))
        try:
            fetch(url, path, timeout_seconds=timeout_seconds, credentials=(user, word) if user else None)
        except Exception:
            return "failed"
        if log:
            storage.write_stream(storage.marker(log, path), io.BytesIO(run_id.encode()))
        return "downloaded"

    def run(frames):
        for f in frames:
            yield f.assign(download_status=[status(u, p) for u, p in zip(f["source_url"], f["image_path"], strict=True)])

    return conform(rows, LINKS).mapInPandas(run, LINKS)


def download_summary(manifest: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("download_status") == s)
    return manifest.agg(
        F.count("*").alias("manifest_rows"), n("downloaded").alias("downloaded_files"), n("existing").alias("existing_files"), n("missing_local").alias("missing_local_files"),
        n("dry_run").alias("dry_run_files"), n("failed").alias("failed_files"),
    )


def available_links(manifest: DataFrame) -> DataFrame:
    return manifest.where(truthy(F.col("download_status")) & ~F.col("download_status").isin(*UNAVAILABLE))


def link_items(items: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items whose image is available, with its path; and the counts of linked and excluded items."""
    have = links.groupBy(*(F.col(k).alias(f"_{k}") for k in ("patient_id", "study_id", "dicom_id"))).agg(F.max("image_path").alias("_path"))
    j = items.join(have, reduce(lambda a, b: a & b, [items[k] == have[f"_{k}"] for k in ("patient_id", "study_id", "dicom_id")]), "left")
    summary = j.agg(F.count("_path").alias("linked_items"), F.count_if(F.col("_path").isNull()).alias("excluded_missing_link"))
    return j.where("_path is not null").select(*(F.col("_path").alias("image_path") if c == "image_path" else items[c] for c in items.columns)), summary
