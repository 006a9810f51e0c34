"""Prompts that carry no label, their metadata, mock answers, dry runs and model runs (CMP7, CMP8, SCL12, SCL13, JN5, JN6)."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import render_prompt, resolve_path, template_id, truthy
from quillon.operators.items import last_by_key
from quillon.operators.models import runner_key
from quillon.schemas import ANSWERS, EVAL_METADATA, MODEL_INPUTS, RESPONSES, conform
from quillon.sources.scratch import materialize
from quillon.sources.sinks import Tally

# Modes of mock answers, and the answer that no format fits.
MODES = ["oracle", "always_yes", "always_no", "always_supported", "always_unsupported", "alternating", "invalid"]
INVALID_TEXT = "This response intentionally does not follow the requested format."
META = ["answer_label", "granularity", "question_type", "hallucination_probe"]


def with_skip_reason(items: DataFrame) -> DataFrame:
    return items.withColumn("skip_reason", F.when(~truthy(F.col("image_path")), "missing_image_path").when(~truthy(F.col("question")), "missing_question"))


def prompt_layers(items: DataFrame, tally: Tally | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Model inputs without labels, their evaluation metadata, and the five counts; tally takes these while the inputs are written."""
    flagged = with_skip_reason(items)
    n, none = F.count_if, F.col("skip_reason").isNull()
    counts = [
        F.count("*").alias("input_items"), n(none).alias("model_input_records"), n(none).alias("eval_metadata_records"),
        n(F.col("skip_reason").eqNullSafe("missing_image_path")).alias("skipped_missing_image_path"), n(F.col("skip_reason").eqNullSafe("missing_question")).alias("skipped_missing_question"),
    ]
    summary = flagged.agg(*counts)
    ok = flagged.where(none)
    seen = tally(flagged, *counts).where(none) if tally else ok
    order = ["_ord"] if "_ord" in items.columns else []
    inputs = seen.select("item_id", "image_path", template_id(F.col("hallucination_probe")).alias("prompt_template_id"), render_prompt(F.col("hallucination_probe"), F.col("question")).alias("prompt"), *order)
    meta = conform(ok, EVAL_METADATA)
    return (inputs if order else conform(inputs, MODEL_INPUTS)), meta, summary


def prompt_records(items: DataFrame) -> DataFrame:
    return prompt_layers(items)[0]


def with_metadata(prompts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Each prompt with its metadata; the last row of an id wins, a null id is the id "None"."""
    m = metadata.where("item_id is not null")
    hit = last_by_key(m, ["item_id"], META)
    return prompts.join(hit, F.coalesce(prompts.item_id, F.lit("None")) == F.col("_item_id"), "left").select(*(prompts[c] for c in prompts.columns), *(F.col(f"_hit.{c}").alias(c) for c in META), F.col("_hit").isNotNull().alias("has_eval_metadata"))


def mock_answer(mode: str, label: Column, probe: Column, index: Column) -> Column:
    even, h2 = index % 2 == 0, probe.eqNullSafe("H2")
    said = {
        "oracle": F.when(label.isin(*ANSWERS), label).otherwise("Uncertain"), "always_yes": F.lit("Yes"), "always_no": F.lit("No"),
        "always_supported": F.lit("Supported"), "always_unsupported": F.lit("Unsupported"), "invalid": F.lit(INVALID_TEXT),
        "alternating": F.when(h2 & even, "Supported").when(h2, "Unsupported").when(even, "Yes").otherwise("No"),
    }
    if mode not in said:
        raise ValueError(f"mode must be one of {MODES}")
    return said[mode]


def with_row_index(df: DataFrame, order: str) -> DataFrame:
    """row_index from 0 in the given order (any type that sorts), nulls first, ties in any order.

    Rows are dealt to ranges and kept in a table of their own; each range is numbered apart and shifted by the
    sizes of those before it, so no task holds all rows. Ties and nulls are dealt further by the whole row.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*(c for c, t in df.dtypes if not t.startswith(("map", "variant"))))
    dealt = materialize(df.withColumn("_tie", tie).repartitionByRange(ranges, F.col(order).asc_nulls_first(), F.col("_tie")).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row a range
    local = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(F.col(order).asc_nulls_first(), "_tie")))
    return local.join(F.broadcast(before), "_p").withColumn("row_index", F.col("_k") - 1 + F.col("_before")).drop("_p", "_k", "_tie", "_before")


def mock_responses(prompts: DataFrame, metadata: DataFrame | None, mode: str = "oracle", model_name: str = "mock", order: str | None = None) -> DataFrame:
    """Answers without a model. Alternating ones follow the order of the records: `order`, else _ord if there is one, else item_id."""
    order = order or ("_ord" if "_ord" in prompts.columns else "item_id")
    if mode == "oracle" and metadata is None:
        raise ValueError("mode oracle needs eval metadata")
    rows = with_metadata(prompts, metadata) if metadata is not None else prompts.select("*", *(F.lit(None).cast("string").alias(c) for c in META))
    rows = with_row_index(rows, order) if mode == "alternating" else rows.withColumn("row_index", F.lit(None).cast("bigint"))
    stamp = datetime.now(UTC).isoformat()
    return conform(rows.select(
        "*", F.lit(model_name).alias("model_name"), F.lit(f"mock-{mode}").alias("model_version"), mock_answer(mode, F.col("answer_label"), F.col("hallucination_probe"), F.col("row_index")).alias("raw_response"),
        F.lit("unparsed").alias("parse_status"), F.struct(F.lit(mode).alias("mode"), *(F.lit(None).alias(c) for c in ("max_new_tokens", "temperature", "batch_size", "dtype"))).alias("generation_config"),
        F.struct(F.lit(stamp).alias("timestamp"), F.lit("cpu").alias("device"), F.lit("success").alias("status"), F.lit(None).alias("latency_seconds"), F.col("row_index"), F.lit(None).alias("error_type"), F.lit(None).alias("error_message")).alias("runtime"),
    ), RESPONSES)


def dry_run(prompts: DataFrame, metadata: DataFrame, images: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """item_id, image_path, resolved_image_path, image_exists, has_eval_metadata; images: a listing with a column path."""
    rows = with_metadata(prompts, metadata).withColumn("resolved_image_path", resolve_path(F.col("image_path"), root))
    some = F.coalesce(*(F.col(c) for c in META)).isNotNull()
    rows = rows.withColumn("has_eval_metadata", F.col("has_eval_metadata") & some)
    if images is None:
        return rows.select("item_id", "image_path", "resolved_image_path", F.lit(False).alias("image_exists"), "has_eval_metadata")
    there = images.select(F.regexp_replace("path", "^file:/*", "/").alias("_path")).distinct()
    return rows.join(there, rows.resolved_image_path == F.col("_path"), "left").select("item_id", "image_path", "resolved_image_path", F.col("_path").isNotNull().alias("image_exists"), "has_eval_metadata")


def dry_run_summary(rows: DataFrame) -> DataFrame:
    none = F.col("image_path").isNull()
    return rows.agg(
        F.count("*").alias("prompt_records"), F.count_if(~F.col("has_eval_metadata")).alias("missing_metadata"), F.count_if(none).alias("missing_image_path"),
        F.count_if("image_exists").alias("existing_images"), F.count_if(~none & ~F.col("image_exists")).alias("missing_images"),
    )


class Runner(Protocol):
    """A model on a worker."""

    def generate(self, image_path: str | None, question: str, **options) -> str: ...


def run_model(prompts: DataFrame, metadata: DataFrame, load: Callable[[], Runner], model_name: str, model_version: str = "", root: str | None = None, device: str = "cuda", batch_size: int = 1, max_new_tokens: int = 16, temperature: float = 0.0, dtype: str = "bfloat16", tasks: int | None = None, resources=None) -> DataFrame:
    """Answers of a model that each worker process loads once and keeps; an error becomes a row, not a failed task.

    tasks: into how many the rows are dealt; as processes are used again, their number doesn't multiply the loads.
    resources: a ResourceProfile for this stage alone, such as models.task_resources(1). row_index is the place in the order of the records (_ord if there is one, else item_id).
    """
    if batch_size != 1:
        raise ValueError("batch_size must be 1")
    numbered = with_row_index(prompts, "_ord" if "_ord" in prompts.columns else "item_id")
    rows = with_metadata(numbered, metadata).withColumn("_resolved", resolve_path(F.col("image_path"), root))
    flat = RESPONSES
    sent = rows.select("item_id", "image_path", "prompt_template_id", "prompt", *META, "_resolved", "row_index")

    sent, key = sent if tasks is None else sent.repartition(tasks), runner_key(load, model_name, model_version, device, dtype)

    def run(frames):
        import pandas as pd

        from quillon.operators.models import held  # the worker's own

        for f in frames:
            out = []
            for r in f.to_dict("records"):
                began, said, kind, message = time.perf_counter(), "", None, None
                try:
                    said = held(key, load).generate(r["_resolved"], r["prompt"], max_new_tokens=max_new_tokens, temperature=temperature, do_sample=temperature > 0).strip()
                except Exception as e:
                    kind, message = type(e).__name__, str(e)[:500]
                ok = kind is None
                out.append({c: r.get(c) for c in ("item_id", "image_path", "prompt_template_id", "prompt", *META)} | {
                    "model_name": model_name, "model_version": model_version, "raw_response": said, "parsed_answer": None, "parse_status": "unparsed",
                    "generation_config": {"mode": None, "max_new_tokens": max_new_tokens, "temperature": temperature, "batch_size": 1, "dtype": dtype},
                    "runtime": {"timestamp": datetime.now(UTC).isoformat(), "device": device, "status": "success" if ok else "error", "latency_seconds": round(time.perf_counter() - began, 6), "row_index": int(r["row_index"]), "error_type": kind, "error_message": message},
                })
            yield pd.DataFrame(out, columns=flat.names)

    return sent.mapInPandas(run, flat, profile=resources)


def run_counts(responses: DataFrame) -> DataFrame:
    return responses.agg(F.count_if(F.col("runtime.status") == "success").alias("success"), F.count_if(F.col("runtime.status") == "error").alias("failed"))
