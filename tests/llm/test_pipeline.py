from pathlib import Path

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from quillon.llm import langid, quality_crf
from quillon.sources.scratch import scratch_dir
from tests.conftest import ORACLE, SMALL
from tests.llm import brute
from tests.llm.test_tokens import check_packing


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{ORACLE}/documents.parquet").where("length(text) < 6000")
    lang, quality, dups, secrets, pack = (f for _, f in corpus_pipeline.STAGES)
    got = lang(spark, docs, ORACLE)
    model = langid.learn(docs)
    keep = {r["doc_id"] for r in docs.collect() if (p := model.predict(r["text"]))[0] != "und" and p[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert {r["doc_id"] for r in got.collect()} == keep and got.columns == docs.columns

    judged = quality(spark, docs, ORACLE)
    crf = quality_crf.learn(docs, spark.read.parquet(f"{ORACLE}/labels.parquet"))
    assert {r["doc_id"] for r in judged.collect()} == {r["doc_id"] for r in docs.collect() if crf.score(r["text"]) >= corpus_pipeline.LEAST_QUALITY}

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    comp = brute.components([i for i, _ in rows], brute.jaccard_links(rows))
    assert sorted(r["doc_id"] for r in dups(spark, docs, ORACLE).collect()) == sorted({c for c in comp.values()})

    clean = secrets(spark, docs, ORACLE)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert not any(brute.base_secrets(r["text"]) for r in clean.collect())
    assert check_packing(pack(spark, clean, ORACLE).collect(), 1024)


def test_run_keeps_clean_documents(spark):
    folder = Path(scratch_dir(spark).removeprefix("file:"), "quillon")
    before = set(folder.iterdir()) if folder.exists() else set()
    out = corpus_pipeline.run(spark, SMALL)
    assert len(set(folder.iterdir()) - before) == 2  # the documents of the last stage and its pieces, which the result reads
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect()}
    kept = {r["doc_id"] for r in out.collect()}
    assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.85
    assert np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.3


def test_odd_rows_pass_every_stage(spark):
    """Null, empty and very long texts, null ids, repeated rows, empty tables, and columns with the operators' own names."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    texts = [None, "", " \n", "one", "no secrets here, only words that go on and on. " * 20_000, "x" * 60_000, None]
    odd = spark.createDataFrame([(None if i == 6 else 10_000 + i, t, "en", "made", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns))
    both = docs.unionByName(odd).unionByName(odd.where("doc_id = 10003"))
    names = ["score", "lang_pred", "_quality", "quality_score", "spans", "base_spans", "all_secrets", "all_secrets_run", "kept", "copy", "rep", "group_id", "_id", "_h", "_text", "_k0", "_y", "label", "sequence_id"]
    for c in names:
        both = both.withColumn(c, F.lit(f"own {c}"))
    left = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, both, SMALL)
        rows = out.collect()
        left[name] = [r["doc_id"] for r in rows]
        assert len(rows) >= 30 and f(spark, both.limit(0), SMALL).count() == 0
        if name != "best_fit_packing":
            assert out.columns == both.columns
            assert all(r[c] == f"own {c}" for r in rows for c in names)
    assert not {10_000, 10_001, 10_002} & set(left["language_id"]) and {10_003, 10_004} <= set(left["language_id"])
    assert left["ngram_jaccard_join"].count(10_003) == 1 and left["secret_scans"].count(10_003) == 2
    assert {10_000, 10_001, 10_002, 10_004, 10_005} <= set(left["ngram_jaccard_join"])
    assert left["best_fit_packing"].count(10_000) == 1 and left["best_fit_packing"].count(10_004) > 100


def test_repeated_rows_and_rows_without_an_id_stay_once(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "other text here it is now"), (None, "words of no id at all"), (None, "words of no id at all"), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
