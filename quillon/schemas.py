"""Declared schemas of every table, and the enumerated domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_SIMPLE = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType()}


def _parts(spec: str) -> list[str]:
    """The spec cut at commas outside of angle brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(spec):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(spec[at:i])
            at = i + 1
    return [*out, spec[at:]]


def _type(spec: str) -> T.DataType:
    spec = spec.strip()
    if spec.startswith("array<"):
        return T.ArrayType(_type(spec[6:-1]))
    if spec.startswith("struct<"):
        return T.StructType([T.StructField(*(f(x) for f, x in zip((str.strip, _type), p.split(":", 1), strict=True))) for p in _parts(spec[7:-1])])
    return _SIMPLE[spec]


def _schema(spec: str) -> T.StructType:
    """A schema from "name type, ..." without a session, so that the module can be imported anywhere."""
    return T.StructType([T.StructField(p.strip().split(" ", 1)[0], _type(p.strip().split(" ", 1)[1])) for p in _parts(spec)])


BOX = "x1 double, y1 double, x2 double, y2 double, original_x1 double, original_y1 double, original_x2 double, original_y2 double"
OBJECTS = _schema(f"patient_id string, study_id string, image_id string, object_id string, bbox_name string, name string, synsets array<string>, {BOX}, source_quality string")
ASSERTIONS = _schema(
    "assertion_id string, patient_id string, study_id string, image_id string, object_id string, bbox_name string, anatomy_name string, anatomy_bound boolean,"
    " raw_label string, category string, polarity string, label_name string, attributes_id string, phrase_index int, phrase_id string, section string, phrase string,"
    " severity_cues array<string>, temporal_cues array<string>, texture_cues array<string>, comparison_cues array<string>, source_quality string"
)
IMAGE_INDEX = _schema("patient_id string, study_id string, image_id string, dicom_id string, image_path string, view_position string, has_chest_imagenome boolean, has_radgraph boolean")
SOURCE_ASSERTION = (
    "struct<assertion_id:string,raw_label:string,category:string,polarity:string,label_name:string,bbox_name:string,phrase_id:string,phrase_index:int,source_quality:string,source:string,scope:string>"
)
BBOX = "struct<bbox_name:string," + ",".join(f"{c.split()[0]}:double" for c in BOX.split(", ")) + ",coordinate_space:string>"
ITEMS = _schema(
    "item_id string, source_dataset string, patient_id string, study_id string, image_id string, dicom_id string, image_path string, granularity string, question_type string,"
    " hallucination_probe string, question string, answer_label string, target_finding string, target_anatomy string,"
    f" bbox {BBOX}, source_assertions array<{SOURCE_ASSERTION}>, evidence_sources array<string>, source_quality string, valid_for_clean_qa boolean, valid_for_false_premise boolean,"
    " valid_for_roi_mask boolean, valid_for_roi_only boolean, valid_for_training boolean, exclusion_flag string"
)
MODEL_INPUTS = _schema("item_id string, image_path string, prompt_template_id string, prompt string")
EVAL_METADATA = _schema(
    "item_id string, answer_label string, granularity string, question_type string, hallucination_probe string, target_finding string, target_anatomy string, evidence_sources array<string>"
)
RUNTIME = "struct<timestamp:string,device:string,status:string,latency_seconds:double,row_index:bigint,error_type:string,error_message:string>"
GENERATION = "struct<mode:string,max_new_tokens:int,temperature:double,batch_size:int,dtype:string>"
RESPONSES = _schema(
    "item_id string, model_name string, model_version string, image_path string, prompt_template_id string, prompt string, raw_response string, parsed_answer string, parse_status string,"
    f" generation_config {GENERATION}, runtime {RUNTIME}, answer_label string, granularity string, question_type string, hallucination_probe string"
)
SCORED = _schema(
    "item_id string, model_name string, granularity string, question_type string, hallucination_probe string, answer_label string, parsed_answer string, score string, is_correct boolean,"
    " hallucination_type string, h1_error_direction string, evidence_relation string, error_category string, requires_manual_review boolean, notes string"
)
LINKS = _schema("patient_id string, study_id string, dicom_id string, image_id string, image_path string, source_url string, split string, link_status string, download_status string")

ANSWERS = ["Yes", "No", "Uncertain", "Supported", "Unsupported"]
PARSE_STATUSES = ["success", "invalid_format", "multiple_answers", "empty_response"]
SCORES = ["correct", "incorrect_non_hallucination", "H1_evidence_contradicted", "H2_evidence_unsupported", "uncertain_or_abstention", "invalid_response", "requires_manual_review"]
RELATIONS = ["S2_directly_supported", "S1_weakly_supported", "S0_unsupported", "S-1_contradicted", "U_uncertain"]
FINDING, SILVER, DATASET = "anatomicalfinding", "silver", "ChestImaGenome"
IMAGE_KEY = ["patient_id", "study_id", "image_id"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; absent ones as nulls, others dropped (PRJ7)."""
    return df.select(*((df[f.name] if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
