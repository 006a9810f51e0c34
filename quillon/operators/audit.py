"""Audits, cross-source checks, localisation and contrast items (EXT2-EXT14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import truthy
from quillon.operators.items import evidence_groups, g1_evidence, g2_evidence, g2_groups
from quillon.schemas import FINDING, IMAGE_KEY
from quillon.sources.scratch import materialize


def top_findings(assertions: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent (category, finding) pairs; ties by name."""
    counts = assertions.groupBy("category", "label_name").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "category", "label_name").limit(k)


def audit_counts(assertions: DataFrame, objects: DataFrame) -> DataFrame:
    a = assertions.agg(
        F.count("*").alias("assertions"), F.count_if("anatomy_bound").alias("bound"), F.count_if(F.col("category") == FINDING).alias("findings"),
        F.count_if(F.col("polarity") == "yes").alias("positive"), F.count_if(F.col("polarity") == "no").alias("negative"), F.count_if(F.col("label_name").isNull()).alias("malformed"),
    )
    o = objects.agg(F.count("*").alias("objects"), F.count_distinct("image_id").alias("images"), F.count_distinct("bbox_name").alias("anatomies"))
    return a.crossJoin(o)  # one row each


CUES = ["severity_cues", "temporal_cues", "texture_cues", "comparison_cues"]


def evidence_audit(assertions: DataFrame, objects: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: files, records, boxes, assertion states, records without anatomy, cues, phrase coverage (EXT8)."""
    cue = lambda c: F.count_if(F.size(c) > 0 if c in assertions.columns else F.lit(False)).alias(f"with_{c}")
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    finding = F.col("category") == FINDING
    a = assertions.agg(
        n(finding & (F.col("polarity") == "yes"), "yes"), n(finding & (F.col("polarity") == "no"), "no"), n(finding & ~F.col("polarity").isin("yes", "no"), "uncertain"),
        n(~F.col("anatomy_bound"), "without_anatomy"), *map(cue, CUES), n(truthy(F.col("label_name")) & truthy(F.col("phrase")), "labels_with_phrase"), n(truthy(F.col("label_name")), "labels"),
    )
    conflicts = evidence_groups(g1_evidence(assertions), [*IMAGE_KEY, "label_name"]).agg(F.count_if("conflict").alias("conflict_groups"))
    box = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in ("x1", "y1", "x2", "y2")])
    o = objects.agg(F.count("*").alias("objects"), F.count_if(box).alias("boxes"))
    out = a.crossJoin(conflicts).crossJoin(o)  # one row each
    return out if files is None else out.crossJoin(files.agg(F.count("*").alias("files")))


def label_distribution(assertions: DataFrame) -> DataFrame:
    """Assertions of each category and polarity; `attribute` is a category of the source like others."""
    return assertions.groupBy("category", "polarity").agg(F.count("*").alias("n"))


def radgraph_counts(entities: DataFrame, reports: DataFrame, linked_studies: DataFrame, evidence_studies: DataFrame, study: str = "report_id") -> DataFrame:
    """One row: studies, and how many of them other sources have too (EXT9)."""
    own = reports.select(F.col(study).alias("study_id")).where("study_id is not null").distinct()
    there = lambda other, name: own.join(other.select("study_id").distinct(), "study_id", "left_semi").agg(F.count("*").alias(name))
    out = own.agg(F.count("*").alias("studies")).crossJoin(there(linked_studies, "in_images")).crossJoin(there(evidence_studies, "in_evidence"))
    return out.crossJoin(entities.agg(F.count("*").alias("entities"), *(F.count_if(F.col("label") == x).alias(x) for x in RADGRAPH_LABELS)))


def top_entities(entities: DataFrame, anatomy: bool, k: int = 20) -> DataFrame:
    """The most frequent observations, or anatomies; ties by text."""
    of = F.col("label").startswith("ANAT")
    return entities.where(of if anatomy else F.col("label").startswith("OBS")).groupBy("tokens").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tokens").limit(k)


def candidate_counts(assertions: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: candidates of each kind of item, and those left out with the reason (EXT12)."""
    g1 = evidence_groups(g1_evidence(assertions), [*IMAGE_KEY, "label_name"]).agg(F.count_if(~F.col("conflict")).alias("g1_valid"), F.count_if("conflict").alias("g1_conflicting"))
    groups = materialize(g2_groups(assertions).select(*IMAGE_KEY, "bbox_name", "label_name", "any_yes", "conflict"))
    # a box is there if its object is: which of several objects comes first makes no difference to a count
    keys = [*IMAGE_KEY, "bbox_name"]
    own = objects.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct().withColumn("_has", F.lit(True))
    has = F.coalesce("_has", F.lit(False))
    g2 = groups.join(own, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left").agg(
        F.count_if(~F.col("conflict") & has).alias("g2_valid"), F.count_if("conflict").alias("g2_conflicting"), F.count_if(~F.col("conflict") & ~has).alias("g2_without_box"),
    )
    finding = F.col("category") == FINDING
    raw = assertions.agg(
        F.count_if(finding & ~truthy(F.col("label_name"))).alias("without_label"), F.count_if(finding & ~F.coalesce(F.col("polarity").isin("yes", "no"), F.lit(False))).alias("uncertain"),
        F.count_if(finding & (F.col("polarity") == "yes") & (F.size("severity_cues") > 0)).alias("with_modifier"),
    )
    # as many as contrast_pairs: each positive anatomy of an image's finding with each other one
    sides = groups.where("not conflict").groupBy("image_id", "label_name").agg(F.count_if("any_yes").alias("t"), F.count_if(~F.col("any_yes")).alias("d"))
    g3a = sides.agg(F.coalesce(F.sum(F.col("t") * F.col("d")), F.lit(0)).alias("g3a_pairs"))
    g3b = modifier_items(assertions).agg(F.count("*").alias("g3b_supported"))
    return reduce(DataFrame.crossJoin, [g1, g2, raw, g3a, g3b])  # one row each


def one_to_many(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys with more than one member."""
    return df.groupBy(key).agg(F.count_distinct(member).alias("members")).where("members > 1")


def cross_source(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Every key of either source with how its two labels relate."""
    r = right.select(F.col(key).alias("_k"), F.col(b).alias("_b"))
    j = left.select(key, F.col(a).alias("_a")).join(r, F.col(key) == F.col("_k"), "full_outer")
    status = (
        F.when(F.col("_k").isNull(), "missing_right").when(F.col(key).isNull(), "missing_left").when(F.col("_a").isNull() | F.col("_b").isNull(), "uncertain")
        .when(F.col("_a") == F.col("_b"), "agree").otherwise("disagree")
    )
    return j.select(F.coalesce(key, "_k").alias(key), status.alias("status"))


def box_iou(p: str = "", q: str = "_") -> Column:
    """Intersection over union of the boxes (px1..py2) and (qx1..qy2); null without area."""
    c = F.col
    w = F.greatest(F.lit(0.0), F.least(c(f"{p}x2"), c(f"{q}x2")) - F.greatest(c(f"{p}x1"), c(f"{q}x1")))
    h = F.greatest(F.lit(0.0), F.least(c(f"{p}y2"), c(f"{q}y2")) - F.greatest(c(f"{p}y1"), c(f"{q}y1")))
    area = lambda s: (c(f"{s}x2") - c(f"{s}x1")) * (c(f"{s}y2") - c(f"{s}y1"))
    union = area(p) + area(q) - w * h
    return F.when(union > 0, w * h / union)


def centre_in_box(p: str = "", q: str = "_") -> Column:
    x, y = (F.col(f"{p}x1") + F.col(f"{p}x2")) / 2, (F.col(f"{p}y1") + F.col(f"{p}y2")) / 2
    return x.between(F.col(f"{q}x1"), F.col(f"{q}x2")) & y.between(F.col(f"{q}y1"), F.col(f"{q}y2"))


def overlapping_boxes(objects: DataFrame) -> DataFrame:
    """Pairs of an image's boxes, by name, with their overlap. An image has a few dozen boxes at most."""
    box = ["x1", "y1", "x2", "y2"]
    objects = objects.where("image_id is not null and bbox_name is not null")  # else rows without an image would all meet
    other = objects.select(*(F.col(k).alias(f"_{k}") for k in [*IMAGE_KEY, "bbox_name", *box]))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in IMAGE_KEY]) & (F.col("bbox_name") < F.col("_bbox_name"))
    return objects.join(other, on).select("image_id", F.col("bbox_name").alias("bbox_a"), F.col("_bbox_name").alias("bbox_b"), box_iou().alias("iou"), centre_in_box().alias("centre_inside"))


def contrast_pairs(assertions: DataFrame) -> DataFrame:
    """Target and distractor anatomies of a finding in an image: one positive, the other not, no conflicts (G3a)."""
    g = g2_groups(assertions).where("not conflict").select("image_id", "label_name", "bbox_name", "any_yes")
    t = g.where("any_yes").select("image_id", "label_name", F.col("bbox_name").alias("target"))
    d = g.where("not any_yes").select("image_id", "label_name", F.col("bbox_name").alias("distractor"))
    return t.join(d, ["image_id", "label_name"])


def modifier_items(assertions: DataFrame, cues: str = "severity_cues") -> DataFrame:
    """Positive findings with a cue that their phrase holds too, where the phrase is about one finding (G3b)."""
    pos = assertions.where((F.col("category") == FINDING) & (F.col("polarity") == "yes") & truthy(F.col("phrase")))
    single = pos.groupBy("image_id", "phrase_id").agg(F.count_distinct("label_name").alias("_n")).where("_n = 1").drop("_n")
    cue = pos.select("image_id", "phrase_id", "label_name", "phrase", F.explode(cues).alias("cue"))
    value = F.element_at(F.split("cue", r"\|"), -1)
    held = (F.instr(F.lower("phrase"), F.lower(F.col("label_name"))) > 0) & (F.instr(F.lower("phrase"), F.lower(value)) > 0)
    return cue.where(held).join(single, ["image_id", "phrase_id"]).select("image_id", "phrase_id", "label_name", "cue").distinct()


def choice_items(assertions: DataFrame, k: int = 4) -> DataFrame:
    """Per image and finding with one positive anatomy, the choices: it and up to k - 1 anatomies without it (G2 choice)."""
    pairs = contrast_pairs(assertions)
    g = pairs.groupBy("image_id", "label_name").agg(F.collect_set("target").alias("t"), F.array_sort(F.collect_set("distractor")).alias("d"))
    return g.where("size(t) = 1").select("image_id", "label_name", F.get("t", F.lit(0)).alias("answer"), F.array_sort(F.concat("t", F.slice("d", 1, k - 1))).alias("choices"))


def synthesis_proxy(assertions: DataFrame) -> DataFrame:
    """Per image, its positive and negative findings, conflicts left out (G4)."""
    g = evidence_groups(g2_evidence(assertions), [*IMAGE_KEY, "label_name"]).where("not conflict")
    return g.groupBy(*IMAGE_KEY).agg(F.array_sort(F.collect_set(F.when(F.col("any_yes"), F.col("label_name")))).alias("present"), F.array_sort(F.collect_set(F.when(~F.col("any_yes"), F.col("label_name")))).alias("absent"))


# Observation classes and the answers that they stand for.
RADGRAPH_ANSWER = {"OBS-DP": "Yes", "OBS-DA": "No", "OBS-U": "Uncertain"}
RADGRAPH_RELATIONS = ["located_at", "modify", "suggestive_of"]
RADGRAPH_LABELS = ["ANAT-DP", "OBS-DP", "OBS-U", "OBS-DA"]


def normalize_radgraph(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of reports with entities: map<string, struct<tokens, label, relations: array<array<string>>>>.

    Both come from a report's row alone; what reads both should put the reports into a table first.
    """
    # an entity a relation points to is looked up inside its report
    said = lambda x: F.try_element_at("entities", F.get(x, F.lit(1)))["tokens"]
    link = lambda x: F.struct(F.get(x, F.lit(0)).alias("relation"), F.get(x, F.lit(1)).alias("target_id"), said(x).alias("target_tokens"))
    links = lambda e: F.transform(F.filter(e["relations"], lambda x: F.get(x, F.lit(0)).isin(*RADGRAPH_RELATIONS)), link)
    one = F.transform(F.map_entries("entities"), lambda x: F.struct(x["key"].alias("entity_id"), x["value"]["tokens"].alias("tokens"), x["value"]["label"].alias("label"), links(x["value"]).alias("links")))
    e = reports.select("report_id", F.explode(one).alias("e")).select("report_id", "e.*")
    answer = F.create_map(*(F.lit(x) for kv in RADGRAPH_ANSWER.items() for x in kv))
    entities = e.select("report_id", "entity_id", "tokens", "label", F.try_element_at(answer, F.col("label")).alias("answer"), F.coalesce(F.size("links"), F.lit(0)).alias("n_relations"))
    return entities, e.select("report_id", "entity_id", F.explode("links").alias("r")).select("report_id", "entity_id", "r.*")


def radgraph_audit(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities of each label, and how many of them have each relation."""
    have = relations.select("report_id", "entity_id", "relation").distinct()
    counts = entities.groupBy("label").agg(F.count("*").alias("n"))
    rel = entities.join(have, ["report_id", "entity_id"]).groupBy("label").agg(*(F.count_if(F.col("relation") == r).alias(r) for r in RADGRAPH_RELATIONS))
    return counts.join(rel, "label", "left").na.fill(0, RADGRAPH_RELATIONS)


def schema_violations(items: DataFrame) -> DataFrame:
    """(item_id, rule) for every broken rule of an item table."""
    g2 = F.col("granularity") == "G2"
    sources = F.coalesce(F.col("source_assertions"), F.array().cast(items.schema["source_assertions"].dataType))
    constructed = F.exists(sources, lambda a: truthy(a["source"]))
    polar = lambda v: F.exists(sources, lambda a: a["polarity"].eqNullSafe(v))
    rules = {
        "missing_as_negative": (F.col("answer_label") == "No") & ~polar("no"), "constructed_as_negative": constructed & F.col("answer_label").isin("Yes", "No"),
        "state_as_answer": F.col("answer_label").isin("Unknown", "Conflict"), "conflicting_sources": polar("yes") & polar("no") & ~F.coalesce(F.col("exclusion_flag").isNotNull(), F.lit(False)),
        "unbound_source_of_g2": g2 & ~constructed & F.exists(sources, lambda a: ~truthy(a["bbox_name"])), "source_is_no_finding": ~constructed & F.exists(sources, lambda a: ~a["category"].eqNullSafe(FINDING)),
        "box_of_other_anatomy": g2 & ~F.coalesce(F.col("bbox.bbox_name") == F.col("target_anatomy"), F.col("bbox").isNull()),
        "contrast_without_distractor": (F.col("granularity") == "G3a") & ~F.coalesce(F.size("evidence_sources") > 1, F.lit(False)),
        "negated_modifier": (F.col("granularity") == "G3b") & polar("no"), "valid_for_training": F.col("valid_for_training"),
    } | {
        "missing_item_id": ~truthy(F.col("item_id")), "bad_answer": ~F.coalesce(F.col("answer_label").isin("Yes", "No", "Uncertain", "Supported", "Unsupported"), F.lit(False)),
        "no_source_assertions": F.coalesce(F.size("source_assertions"), F.lit(0)) < 1, "no_evidence_sources": F.coalesce(F.size("evidence_sources"), F.lit(0)) < 1,
        "g2_without_anatomy": g2 & ~truthy(F.col("target_anatomy")), "g2_without_box": g2 & F.col("bbox").isNull(), "g1_with_anatomy": (F.col("granularity") == "G1") & F.col("target_anatomy").isNotNull(),
        "h1_not_clean": (F.col("hallucination_probe") == "H1") & ~F.col("valid_for_clean_qa"), "no_question": ~truthy(F.col("question")), "silver_only": F.col("source_quality") != "silver",
    }
    return items.select("item_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("rule"))


def scored_violations(scored: DataFrame) -> DataFrame:
    """(item_id, rule) for scored rows that lost a field they have to keep."""
    kept = ["item_id", "granularity", "question_type", "answer_label", "score"]
    lost = {f"lost_{c}": ~truthy(F.col(c)) for c in kept} | {"lost_parsed_answer": F.col("parsed_answer").isNull() & (F.col("score") != "invalid_response")}
    return scored.select("item_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in lost.items())))).alias("rule"))
