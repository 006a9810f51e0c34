"""The corpus pipeline: language, quality, near duplicates, secrets, packing; part of the subpackage llm.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written and read again before
the next stage, which works on all that is left. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard_join, langid, packing, quality_crf, secret_scan
from quillon.llm.common import discard, materialize, unused
from quillon.sources.scratch import temporary

#: A document whose language is less certain is rejected; so is one without a letter.
LEAST_LANGUAGE_SCORE = 0.3
#: A document whose quality score is lower is rejected.
LEAST_QUALITY = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or a language; learns languages from the rows that name one.

    Null and empty texts have no letter and go; very long ones are read whole; ties go to the later code;
    repeated rows are judged alike and all stay or go; an empty table stays empty. Columns of any name are kept.
    """
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    judged = langid.identify(docs, langid.learn(docs), docs.columns, lang_pred=lang, score=score)
    return judged.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality; learns from the labels of the documents that are left.

    Null texts count as empty, and those as one empty line; very long ones are scored whole; a score at the
    cutoff stays; repeated rows are judged alike; an empty table stays empty, and one without labels is scored by
    an untaught model, which rejects nothing. Columns of any name are kept.
    """
    model = quality_crf.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "quality_score")
    return quality_crf.score(docs, model, docs.columns, out=score).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near duplicates.

    Rows are told apart by id and text. Rows equal in both are one document and stay once. Null texts and those
    without a word are like no other and stay; very long ones are compared whole; of several texts under the
    smallest id the one with the smallest hash stays; rows without an id come last in their group. An empty table
    stays empty. Columns of any name are kept.
    """
    key, text_hash, kept, rows = (unused(docs, n) for n in ("group_id", "group_hash", "group_kept", "group_rows"))
    judged = jaccard_join.near_duplicates(docs).groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), F.col("kept").alias(kept)).agg(F.count("*").alias(rows))
    other = materialize(judged.where(~F.col(kept) | (F.col(rows) > 1)), docs.count())
    same = docs["doc_id"].cast("long").eqNullSafe(other[key]) & (F.xxhash64(docs["text"]) == other[text_hash])
    single = docs.join(other, same, "left_anti")
    if other.where(F.col(kept)).isEmpty():
        return single.select(*docs.columns)
    repeated = docs.join(other.where(F.col(kept)), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated).select(*docs.columns)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows the text.

    Null texts stay null and keep their n_chars; very long ones are scanned whole; overlapping spans are one
    mark; repeated rows are treated alike; an empty table stays empty. Columns of any name are kept.
    """
    base, spans = unused(docs, "base_secrets"), unused(docs, "all_secrets")
    found = secret_scan.find_secrets(docs, secret_scan.learn(docs), base_spans=base, spans=spans)
    text = secret_scan.redact(F.col("text"), F.col(spans))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of all that is left into sequences.

    Null and empty texts are one piece with the end sign alone; long ones are cut; repeated rows get pieces of
    their own; an empty table gives no piece. Other columns are ignored.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", remove_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Models, components and packings can't be put in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; every result but the last is written to the shared folder.

    A stage's other tables go once its result is written, and the result once the next one is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with temporary(spark) as kept:
            out = materialize(stage(spark, docs, sf_dir))
            kept.append(out)
        if k:
            discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
