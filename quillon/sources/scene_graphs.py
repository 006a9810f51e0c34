"""Scene-graph JSON documents to typed object and assertion tables (SRC1, SRC2, SRC9, FLT1-FLT11)."""

from __future__ import annotations

import json
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.ids import assertion_id
from quillon.functions.text import label_parts
from quillon.schemas import ASSERTIONS, BOX, OBJECTS, SILVER, conform
from quillon.sources.scratch import materialize
from quillon.sources.sinks import Tally, file_system

# Keys of a document and of an attribute.
REQUIRED = ["image_id", "objects", "attributes"]
PHRASE_KEYS = ["attributes", "attributes_ids", "phrases", "phrase_IDs", "sections", "comparison_cues", "temporal_cues", "severity_cues", "texture_cues"]


# What a number that JSON has no word for is written as, and what it is.
BEYOND_JSON = {"NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
MARK = "\ue000"


class Parsed(NamedTuple):
    objects: DataFrame
    assertions: DataFrame
    warnings: DataFrame  # key, n
    files: DataFrame
    refused: DataFrame  # path, text, reason
    tally: Tally  # of the objects' and assertions' plans, once they are written


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the documents under a folder, or the one file; no file is opened."""
    reader = spark.read.format("binaryFile")
    if _is_directory(spark, path):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*_SceneGraph.json")
    return reader.load(path).select("path")


def discover(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """path, text of each document in path-part order; a missing path fails when it is read.

    With a limit the paths are put in order first and the first ones alone are opened.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    reader = spark.read.option("wholetext", True)
    if limit is not None:
        chosen = [r["path"] for r in list_documents(spark, path).orderBy(F.split("path", "/")).limit(limit).collect()]
        if not chosen:
            return spark.createDataFrame([], "path string, text string")
        docs = reader.text(chosen)
    else:
        if _is_directory(spark, path):
            reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*_SceneGraph.json")
        docs = reader.text(path)
    return docs.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _is_directory(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(path, spark)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return fs.getFileStatus(p).isDirectory()


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string(v: Column) -> Column:
    """Text of a scalar; null for null, booleans, lists and objects."""
    scalar = ~_kind(v).rlike("^(ARRAY|OBJECT|BOOLEAN$|VOID$)")
    said = F.try_variant_get(v, "$", "string")
    beyond = {MARK + "NaN": "nan", MARK + "Infinity": "inf", MARK + "-Infinity": "-inf"}
    plain = F.element_at(F.create_map(*(F.lit(x) for pair in beyond.items() for x in pair)), said)
    return F.when(scalar, F.when(said.startswith(MARK), F.coalesce(plain, said)).otherwise(said))


def _number(v: Column) -> Column:
    kind = _kind(v)
    said = F.try_variant_get(v, "$", "string")
    beyond = F.create_map(*(F.lit(x) for k, x in BEYOND_JSON.items() for x in (MARK + k, x)))
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT)$|^DECIMAL")
    return F.when(number, F.try_variant_get(v, "$", "double")).when((kind == "STRING") & said.startswith(MARK), F.try_element_at(beyond, said))


def _list(v: Column) -> Column:
    """array<variant>; anything that is no list counts as empty."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _texts(v: Column) -> Column:
    """A list's scalars as text, null in the places of others."""
    return F.transform(_list(v), _string)


def _said(texts: Column) -> Column:
    return F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda s: s.isNotNull())


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<image_id: variant>").isNotNull()


def _each(v: Column, keys: list[str], of) -> Column:
    """Values of some fields as an array: one small expression, as generated code beyond some size is never compiled."""
    return F.transform(F.array(*(v[k] for k in keys)), of)


def _fields(v: Column, keys: list[str]) -> Column:
    """A struct of an object's VARIANTs, taken in one pass; null for what is no object."""
    return F.try_variant_get(v, "$", "struct<" + ", ".join(f"{k}: variant" for k in keys) + ">")


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


@F.pandas_udf(T.StringType())
def _plain_json(texts: pd.Series) -> pd.Series:
    """Texts that only a tolerant parser takes, as plain JSON: the last of repeated keys, and marked strings for NaN and infinities."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text, parse_constant=lambda c: MARK + c))
        except (ValueError, RecursionError):
            return None

    return texts.map(one, na_action="ignore").astype(object)


def read_graphs(docs: DataFrame) -> DataFrame:
    """path, v (VARIANT, null if refused), text (of refused documents alone).

    Spark's parser takes most documents inside the JVM. Those that it refuses (repeated keys, of which the last counts,
    NaN and infinities) go to a tolerant parser; for all others nothing but a null is sent there.
    """
    first = docs.select("path", "text", F.try_parse_json("text").alias("_v"))
    again = first.withColumn("_plain", _plain_json(F.when(F.col("_v").isNull(), F.col("text"))))
    v = F.coalesce("_v", F.try_parse_json("_plain"))
    return again.select("path", v.alias("v"), F.when(v.isNull(), F.col("text")).alias("text"))


def parse_scene_graphs(docs: DataFrame, strict: bool = True) -> Parsed:
    """Flatten documents (path, text). A document that no parser takes fails when strict, else it yields a warning and a row of `refused`.

    Documents are parsed into one table of VARIANTs, from which all results are made. A document that lacks a required key gives one warning per key and no rows. Entries that are no objects
    give a warning. Rows of assertions depend on the lists of labels only; other lists are read by position.
    """
    d = read_graphs(docs)
    d = d.withColumn("missing", F.array_compact(F.array(*(F.when(_at(F.col("v"), k).isNull(), F.lit(f"missing_top_level_key:{k}")) for k in REQUIRED))))
    d = materialize(d.withColumn("missing", F.when(F.col("v").isNull(), F.array(F.lit("malformed_json"))).otherwise(F.col("missing"))))
    refused = d.where(F.col("v").isNull()).select("path", "text", F.lit("malformed_json").alias("reason"))
    if strict and (bad := refused.select("path").first()) is not None:
        raise ValueError(f"{bad['path']} is no JSON")
    tally = Tally()
    _, objects, _, _, assertions = _flatten(d, tally)
    entries, _, found, attr, _ = _flatten(d, lambda df, *_: df)
    malformed = F.filter(F.flatten("l_attributes"), lambda x: label_parts(x)["category"].isNull())
    said = F.concat("misaligned", F.transform(malformed, lambda x: F.lit("malformed_label")))
    warnings = (
        d.select(F.explode("missing").alias("key"))
        .unionByName(entries.where("not ok").select(F.lit("invalid_object_entry").alias("key")))
        .unionByName(found.where("not ok").select(F.lit("invalid_attribute_entry").alias("key")))
        .unionByName(attr.select(F.explode_outer(said).alias("key")).where("key is not null"))
        .groupBy("key").agg(F.count("*").alias("n"))
    )
    return Parsed(objects, assertions, warnings, d.select("path"), refused, tally)


def _flatten(d: DataFrame, note) -> tuple[DataFrame, ...]:
    """(entries, objects, found, attr, assertions) of parsed documents; note(rows, counts) sees the rows of each step before any are left out.

    Lists are exploded with outer and the rows of empty ones left out after: a plain explode gets a filter on the list's size,
    which would make the list, and all that it is made of, a second time.
    """
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    good = d.where(F.size("missing") == 0).select(
        *(_string(_at(F.col("v"), k)).alias(k) for k in ("patient_id", "study_id", "image_id")), _list(_at(F.col("v"), "attributes")).alias("attrs")
    )
    keys = ["patient_id", "study_id", "image_id"]
    listed = d.withColumn("_fine", F.size("missing") == 0).withColumn("_objs", F.when(F.size("missing") == 0, _list(_at(F.col("v"), "objects"))))
    listed = note(listed, F.count("*").alias("files_seen"), *(n(F.array_contains("missing", w), w) for w in ["malformed_json", *(f"missing_top_level_key:{k}" for k in REQUIRED)]))
    boxes = [c.split()[0] for c in BOX.split(", ")]
    named = listed.where("_fine").select(*(_string(_at(F.col("v"), k)).alias(k) for k in keys), F.posexplode_outer("_objs").alias("_at", "o")).where("_at is not null")
    entries = named.select(*keys, "o", _is_object(F.col("o")).alias("ok"))
    entries = note(entries, n(~F.col("ok"), "invalid_object_entry"), n(F.col("ok"), "ci_objects_rows"))
    o, names = F.col("o"), ["object_id", "bbox_name", "name"]
    taken = entries.where("ok").select(*keys, _fields(o, [*names, "synsets", *boxes]).alias("o"))
    taken = taken.select(*keys, _each(o, names, _string).alias("_s"), _said(_texts(o["synsets"])).alias("synsets"), _each(o, boxes, _number).alias("_n"))
    objects = conform(taken.select(
        *keys, *(F.col("_s")[i].alias(k) for i, k in enumerate(names)), "synsets", *(F.col("_n")[i].alias(c) for i, c in enumerate(boxes)), F.lit(SILVER).alias("source_quality"),
    ), OBJECTS)

    found = good.select(*keys, F.posexplode_outer("attrs").alias("attribute_index", "a")).where("attribute_index is not null").withColumn("ok", _is_object(F.col("a")))
    found = note(found, n(~F.col("ok"), "invalid_attribute_entry"))
    f = F.col("f")
    nested = ["attributes", "attributes_ids", *(k for k in PHRASE_KEYS if k.endswith("_cues"))]
    # texts from here on: a VARIANT brings its document's keys along into every row
    attr = found.where("ok").select(*keys, "attribute_index", "a", _fields(F.col("a"), ["object_id", "name", "bbox_name", *PHRASE_KEYS]).alias("f"))
    attr = attr.select(
        *keys, "attribute_index", "a", _string(f["object_id"]).alias("object_id"), _string(f["name"]).alias("_name"),
        F.when(_kind(f["bbox_name"]) == "STRING", F.try_variant_get(f["bbox_name"], "$", "string")).alias("_bbox"),
        *((F.transform(_list(f[k]), _texts) if k in nested else _texts(f[k])).alias(f"l_{k}") for k in PHRASE_KEYS), F.array(*(F.size(_list(f[k])) for k in PHRASE_KEYS)).alias("sizes"),
    )
    dynamic = F.try_element_at(F.try_variant_get("a", "$", "map<string,variant>"), F.col("_bbox"))
    named = ~F.regexp_like(F.col("_bbox"), F.lit(r"^\s*\z"))
    attr = attr.withColumn("anatomy_bound", F.coalesce(named & (_kind(dynamic) == "BOOLEAN") & F.try_variant_get(dynamic, "$", "boolean"), F.lit(False))).drop("a")
    odd = F.filter("sizes", lambda x: (x > 0) & (x != F.array_max("sizes")))
    which = F.array_compact(F.array(*(F.when((F.col("sizes")[i] > 0) & (F.col("sizes")[i] != F.array_max("sizes")), F.lit(f"misaligned_phrase_key:{k}")) for i, k in enumerate(PHRASE_KEYS))))
    attr = attr.withColumn("misaligned", F.when(F.size(odd) > 0, which).otherwise(F.array().cast("array<string>")))
    attr = note(attr, *(n(F.array_contains("misaligned", w), w) for w in (f"misaligned_phrase_key:{k}" for k in PHRASE_KEYS)))
    whose = [*keys, "attribute_index", "object_id", "_name", "_bbox", "anatomy_bound"]
    phrases = attr.select(*whose, *(f"l_{k}" for k in PHRASE_KEYS[1:]), F.posexplode_outer("l_attributes").alias("phrase_index", "labels")).where("phrase_index is not null")
    at = lambda k: F.get(F.col(f"l_{k}"), F.col("phrase_index"))
    cues = ["severity_cues", "temporal_cues", "texture_cues", "comparison_cues"]
    phrases = phrases.select(
        *whose, "phrase_index", "labels", at("attributes_ids").alias("_ids"), at("phrase_IDs").alias("phrase_id"), at("sections").alias("section"), at("phrases").alias("phrase"),
        *(_said(at(k)).alias(k) for k in cues),
    )
    rest = ["phrase_index", "_ids", "phrase_id", "section", "phrase", *cues]
    labels = phrases.select(*whose, *rest, F.posexplode_outer("labels").alias("label_index", "raw_label")).where("label_index is not null")
    assertions = labels.select(
        assertion_id(F.col("image_id"), F.col("attribute_index"), F.col("phrase_index"), F.col("label_index")).alias("assertion_id"), *keys, "object_id",
        F.when(F.col("anatomy_bound"), F.col("_bbox")).alias("bbox_name"), F.when(F.col("anatomy_bound"), F.col("_name")).alias("anatomy_name"), "anatomy_bound",
        "raw_label", label_parts(F.col("raw_label")).alias("parts"), F.get("_ids", F.col("label_index")).alias("attributes_id"),
        "phrase_index", "phrase_id", "section", "phrase", *cues, F.lit(SILVER).alias("source_quality"),
    ).select("*", "parts.*")
    written = note(conform(assertions, ASSERTIONS), F.count("*").alias("ci_attribute_assertions_rows"), n(F.col("category").isNull(), "malformed_label"))
    return entries, objects, found, attr, written


def written_summary(parsed: Parsed, tables: list[str]) -> dict:
    """The same as parser_summary, from what was counted while objects and assertions were written; both have to be."""
    told = parsed.tally.counts()
    rows = {k: told.pop(k) for k in ("files_seen", "ci_objects_rows", "ci_attribute_assertions_rows")}
    return rows | {"warnings": {k: v for k, v in sorted(told.items()) if v}, "output_tables": tables}


def parser_summary(parsed: Parsed, tables: list[str]) -> dict:
    """files_seen, row counts, sorted warnings and the table names (SNK4)."""
    return {
        "files_seen": parsed.files.count(), "ci_objects_rows": parsed.objects.count(), "ci_attribute_assertions_rows": parsed.assertions.count(),
        "warnings": {r["key"]: r["n"] for r in parsed.warnings.orderBy("key").collect()}, "output_tables": tables,
    }
