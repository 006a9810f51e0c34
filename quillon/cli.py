"""Command lines for each stage: python -m quillon.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys
import uuid
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon import schemas
from quillon.operators import items, linking, models, prompts, report, scoring
from quillon.sources import scene_graphs, scratch, sinks, storage, tables


def _one(df) -> dict:
    return df.first().asDict()


def _positive(v: str) -> int:
    n = int(v)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def _not_negative(v: str) -> float:
    f = float(v)
    if not f >= 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return f


def _fraction(v: str) -> float:
    f = float(v)
    if not 0 < f < 1:
        raise argparse.ArgumentTypeError("must be between 0 and 1")
    return f


def parse_chest_imagenome(spark, a):
    with scratch.temporary(spark):
        parsed = scene_graphs.parse_scene_graphs(scene_graphs.discover(spark, a.input, a.limit), strict=not a.quarantine)
        sinks.write_parquet(parsed.objects, f"{a.output}/ci_objects.parquet")
        sinks.write_parquet(parsed.assertions, f"{a.output}/ci_attribute_assertions.parquet")
        if a.quarantine:
            sinks.write_parquet(parsed.refused, a.quarantine)
        out = scene_graphs.written_summary(parsed, ["ci_objects.parquet", "ci_attribute_assertions.parquet"])
    sinks.write_json(f"{a.output}/parse_chest_imagenome_summary.json", out)
    return out


def link_mimic_images(spark, a):
    index = linking.image_index(tables.read_parquet(spark, a.objects, schemas.OBJECTS), tables.read_parquet(spark, a.attributes, schemas.ASSERTIONS))
    tally = sinks.Tally()
    sinks.write_parquet(tally(items.in_order(index, schemas.IMAGE_KEY), *linking.image_index_counts()), a.output)
    sinks.write_json(a.summary, out := tally.counts())
    return out


def _build(spark, a, level):
    assertions = tables.read_parquet(spark, a.attributes, schemas.ASSERTIONS)
    objects = tables.read_parquet(spark, a.objects, schemas.OBJECTS) if level == "g2" else None
    index = tables.read_parquet(spark, a.image_index, schemas.IMAGE_INDEX)
    args, tally = (assertions, index) if level == "g1" else (assertions, objects, index), sinks.Tally()
    h1 = scratch.materialize((items.build_g1_h1 if level == "g1" else items.build_g2_h1)(*args, tally=tally))  # a sort would run it twice
    h2, balance = (items.build_g1_h2 if level == "g1" else items.build_g2_h2)(*args, a.unsupported, not a.no_balance_h2, a.h2_unsupported_fraction, a.h2_sampling_seed)
    keys = [*schemas.IMAGE_KEY, "target_anatomy", "target_finding"]
    sinks.write_jsonl(items.in_order(h1, keys), a.h1_output)
    scratch.discard(h1)
    sinks.write_jsonl(items.in_order(h2, ["answer_label", *keys]), a.h2_output)  # supported claims come first
    sinks.update_summary(a.summary, level, out := tally.counts() | {"h2_balance": balance})
    return out


def build_prompts(spark, a):
    tally = sinks.Tally()
    inputs, meta, _ = prompts.prompt_layers(tables.read_jsonl(spark, a.input, schemas.ITEMS), tally)
    sinks.write_jsonl(inputs, a.model_inputs_output)
    sinks.write_jsonl(meta, a.eval_metadata_output)
    return tally.counts()


def batch_infer(spark, a):
    if a.mode == "oracle" and not a.eval_metadata:
        print("mode oracle needs --eval-metadata", file=sys.stderr)
        raise SystemExit(2)
    meta = tables.read_jsonl(spark, a.eval_metadata, schemas.EVAL_METADATA) if a.eval_metadata else None
    tally, out = sinks.Tally(), prompts.mock_responses(tables.read_jsonl(spark, a.input, schemas.MODEL_INPUTS), meta, a.mode, a.model_name)
    sinks.write_jsonl(tally(out, F.count("*").alias("rows")), a.output)
    return tally.counts()


def medgemma_runner(spark, a):
    inputs = tables.read_jsonl(spark, a.input, schemas.MODEL_INPUTS, a.limit)
    meta = tables.read_jsonl(spark, a.eval_metadata, schemas.EVAL_METADATA)
    if a.dry_run:
        rows = prompts.dry_run(inputs.drop("_ord"), meta, tables.list_images(spark, a.data_root) if a.data_root else None, a.data_root)
        sinks.write_jsonl(rows, a.output)
        return _one(prompts.dry_run_summary(rows))
    try:
        load = models.loader(a.loader, a.model_path, a.device, a.dtype)
        out = prompts.run_model(inputs, meta, load, a.model_name, a.model_path, a.data_root, a.device, a.batch_size, a.max_new_tokens, a.temperature, a.dtype, a.tasks, models.task_resources(a.gpus_per_task) if a.gpus_per_task else None)
    except (RuntimeError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        raise SystemExit(1) from e
    out = scratch.materialize(out)  # each answer is made once
    sinks.write_jsonl(out, a.output)
    return _one(prompts.run_counts(out)) | {"outputs": out.count()}


def link_and_download(spark, a):
    """Links of the splits' items, the manifest, the counts, and the items whose image is there."""
    splits = {Path(p).name: tables.read_jsonl(spark, p, schemas.ITEMS) for p in a.inputs}
    links = linking.classify_links(linking.needed_images(list(splits.values())), tables.read_metadata(spark, a.metadata, a.split), f"{a.files_root.rstrip('/')}/", f"{a.base_url.rstrip('/')}/" if a.base_url else "")
    manifest = scratch.materialize(linking.download_manifest(links, a.dry_run, _fetch, a.limit, a.link_only_existing, a.overwrite, a.timeout, a.username_env, a.password_env, log=f"{a.output_dir}/_log", run_id=a.run_id))
    sinks.write_csv(manifest, f"{a.output_dir}/manifest")
    sinks.write_url_list(links, f"{a.output_dir}/urls")
    out = _one(linking.link_summary(links)) | _one(linking.download_summary(manifest))
    for name, split in splits.items():
        linked, counts = linking.link_items(split.drop("_ord"), linking.available_links(manifest))
        sinks.write_jsonl(items.in_order(linked, ["item_id"]), f"{a.output_dir}/linked/{name}")
        out[name] = _one(counts)
    sinks.write_json(f"{a.output_dir}/summary.json", out)
    return out


def _fetch(url, path, timeout_seconds, credentials):
    import base64
    import urllib.request

    request = urllib.request.Request(url)
    if credentials:
        request.add_header("Authorization", "Basic " + base64.b64encode(":".join(c or "" for c in credentials).encode()).decode())
    with urllib.request.urlopen(request, timeout=timeout_seconds) as source:
        storage.write_stream(path, source)


def parse_answer(spark, a):
    parsed = scoring.parse_responses(tables.read_jsonl(spark, a.input, schemas.RESPONSES))
    sinks.write_jsonl(parsed, a.output)
    return {r["parse_status"]: r["n"] for r in scoring.status_histogram(parsed).collect()}


def score_closed_qa(spark, a):
    scored = scoring.score_responses(tables.read_jsonl(spark, a.input, schemas.RESPONSES))
    sinks.write_jsonl(scored, a.output)
    sinks.write_json(a.summary, out := scoring.summary_dict(scoring.summarize(scored)))
    return out["overall"]


def metrics(spark, a):
    sinks.write_json(a.output, out := scoring.summary_dict(scoring.summarize(tables.read_jsonl(spark, a.inputs, schemas.SCORED))))
    return out["overall"]


def visualize_results(spark, a):
    rows = report.flatten(a.inputs, a.run_names)
    report.write_tables(rows, a.output_dir)
    if not a.no_figures:
        report.render_figures(rows, a.output_dir)
    return {"rows": len(rows)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon")
    sub = top.add_subparsers(dest="command", required=True)

    def command(f, *options, name=None, **kept):
        p = sub.add_parser(name or f.__name__)
        for o in options:
            p.add_argument(o, required=True)
        p.set_defaults(run=f, **kept)
        return p

    p = command(parse_chest_imagenome)
    p.add_argument("--input", default="data/fixtures")
    p.add_argument("--output", default="data/interim")
    p.add_argument("--limit", type=_positive)
    p.add_argument("--quarantine", help="a table for documents that are no JSON; without it the first one ends the run")
    command(link_mimic_images, "--objects", "--attributes", "--output", "--summary")
    for level, flag in (("g1", "--unsupported-per-image"), ("g2", "--unsupported-per-anatomy")):
        p = command(lambda s, a: _build(s, a, a.level), "--image-index", "--h1-output", "--h2-output", "--summary", name=f"build_{level}_items", level=level)
        p.add_argument("--attributes" if level == "g2" else "--input", dest="attributes", required=True)
        if level == "g2":
            p.add_argument("--objects", required=True)
        p.add_argument(flag, dest="unsupported", type=_positive, default=1)
        p.add_argument("--h2-unsupported-fraction", type=_fraction, default=0.8)
        p.add_argument("--h2-sampling-seed", type=int, default=42)
        p.add_argument("--no-balance-h2", action="store_true")
    command(build_prompts, "--input", "--model-inputs-output", "--eval-metadata-output")
    p = command(batch_infer, "--input", "--output")
    p.add_argument("--eval-metadata")
    p.add_argument("--model-name", default="mock")
    p.add_argument("--mode", choices=prompts.MODES, default="oracle")
    p = command(medgemma_runner, "--input", "--eval-metadata", "--output")
    p.add_argument("--data-root")
    p.add_argument("--limit", type=_positive)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--model-path", default="")
    p.add_argument("--model-name", default="medgemma")
    p.add_argument("--loader", help="module:function that gives a loader; default: a local model")
    p.add_argument("--device", choices=["cuda", "cpu", "auto"], default="cuda")
    p.add_argument("--dtype", choices=list(models.DTYPES), default="bfloat16")
    p.add_argument("--batch-size", type=_positive, default=1)
    p.add_argument("--max-new-tokens", type=_positive, default=16)
    p.add_argument("--temperature", type=_not_negative, default=0.0)
    p.add_argument("--tasks", type=_positive)
    p.add_argument("--gpus-per-task", type=_not_negative, default=0.0)
    p = command(link_and_download, "--metadata", "--files-root", "--output-dir")
    p.add_argument("--inputs", nargs="+", required=True)
    for o in ("--split", "--base-url", "--username-env", "--password-env"):
        p.add_argument(o)
    p.add_argument("--run-id", default=uuid.uuid4().hex, help="the id of a run that is started again")
    p.add_argument("--limit", type=_positive)
    p.add_argument("--timeout", type=float, default=60.0)
    for o in ("--dry-run", "--link-only-existing", "--overwrite"):
        p.add_argument(o, action="store_true")
    command(parse_answer, "--input", "--output")
    command(score_closed_qa, "--input", "--output", "--summary")
    p = command(metrics, "--output")
    p.add_argument("--inputs", nargs="+", required=True)
    p = command(visualize_results, "--output-dir")
    p.add_argument("--inputs", nargs="+", required=True)
    p.add_argument("--run-names", nargs="+")
    p.add_argument("--no-figures", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    out = a.run(spark, a)
    print(f"{a.command}: {out}")
    return out


if __name__ == "__main__":
    main()
