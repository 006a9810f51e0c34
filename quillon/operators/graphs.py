"""Report graphs: walks over relations, findings named by entities, and agreement with image evidence (EXT5, EXT7, EXT11)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import truthy
from quillon.operators.audit import RADGRAPH_ANSWER
from quillon.operators.items import evidence_groups, g1_evidence
from quillon.sources.scratch import discard, materialize

#: Vocabulary names up to which they are sent to every task.
BROADCAST_NAMES = 100_000


#: Steps of a report up to which its walks are found inside one row.
ROW_EDGES = 256


def walks(edges: DataFrame, max_steps: int = 16) -> DataFrame:
    """report_id, source_id, target_id, steps: what each entity reaches over edges (report_id, source_id, target_id), and in how few steps.

    An entity's way back to itself is left out. Repeated edges count once; edges without an end are ignored. The edges of a report
    of usual size are one row, whose walks a small function finds; larger reports go by rounds of joins.
    """
    step = materialize(edges.where("report_id is not null and source_id is not null and target_id is not null and source_id <> target_id").select("report_id", "source_id", "target_id"))
    sizes = step.groupBy("report_id").agg(F.count("*").alias("_n"))
    large = materialize(sizes.where(F.col("_n") > ROW_EDGES).select("report_id"))
    usual, rest = step, None
    if large.isEmpty():
        discard(large)
    else:
        usual, rest = step.join(large, "report_id", "left_anti"), step.join(large, "report_id", "left_semi")

    @F.pandas_udf("array<struct<source_id:string,target_id:string,steps:int>>")
    def reached(sources: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([_reached(s, t, max_steps) for s, t in zip(sources, targets)], dtype=object)

    rows = usual.groupBy("report_id").agg(F.collect_list(F.struct("source_id", "target_id")).alias("e"))
    found = rows.select("report_id", F.explode(reached(F.col("e.source_id"), F.col("e.target_id"))).alias("r")).select("report_id", "r.*")
    return found if rest is None else found.unionByName(_rounds(rest.distinct(), max_steps))


def _reached(sources, targets, max_steps: int) -> list[dict]:
    """Walks of one report, breadth first from each entity."""
    ahead: dict[str, set[str]] = {}
    for s, t in zip(sources, targets):
        ahead.setdefault(s, set()).add(t)
    out = []
    for s, new in ahead.items():
        known, k = {s}, 1
        while new and k <= max_steps:
            out += [{"source_id": s, "target_id": t, "steps": k} for t in new]
            known |= new
            new, k = set().union(*(ahead.get(t, ()) for t in new)) - known, k + 1
    return out


def _rounds(step: DataFrame, max_steps: int) -> DataFrame:
    """The walks of reports of any size. A round adds one step to the pairs that were new in the last one; pairs already
    known, as in cycles, are not followed again."""
    step = materialize(step)
    known, new = step.withColumn("steps", F.lit(1)), step
    for k in range(2, max_steps + 1):
        ahead = step.select("report_id", F.col("source_id").alias("target_id"), F.col("target_id").alias("_next"))
        further = new.join(ahead, ["report_id", "target_id"]).select("report_id", "source_id", F.col("_next").alias("target_id")).where("source_id <> target_id").distinct()
        new = materialize(further.join(known, ["report_id", "source_id", "target_id"], "left_anti"))
        if new.isEmpty():
            discard(new)
            break
        known = known.unionByName(new.withColumn("steps", F.lit(k)))
    return known


def modifier_support(entities: DataFrame, relations: DataFrame, max_steps: int = 16) -> DataFrame:
    """report_id, finding_id, finding, answer, modifier_id, modifier, steps: modifiers of observations, those of their modifiers included."""
    over = relations.where(F.col("relation") == "modify").select("report_id", F.col("entity_id").alias("source_id"), "target_id")
    named = lambda i, t: entities.select("report_id", F.col("entity_id").alias(i), F.col("tokens").alias(t))
    findings = entities.where(F.col("label").isin(*RADGRAPH_ANSWER)).select("report_id", F.col("entity_id").alias("finding_id"), F.col("tokens").alias("finding"), "answer")
    found = walks(over, max_steps).select("report_id", F.col("source_id").alias("modifier_id"), F.col("target_id").alias("finding_id"), "steps")
    return found.join(findings, ["report_id", "finding_id"]).join(named("modifier_id", "modifier"), ["report_id", "modifier_id"])


def located_findings(entities: DataFrame, relations: DataFrame, max_steps: int = 16) -> DataFrame:
    """report_id, finding_id, anatomy_id, steps: anatomies that a finding is located at, over chains, and those that modify them."""
    at = relations.where(F.col("relation") == "located_at").select("report_id", F.col("entity_id").alias("source_id"), "target_id")
    # a modifier of an anatomy ("left" of "lung") tells where the finding is, so that edge is walked from its target
    back = relations.where(F.col("relation") == "modify").select("report_id", F.col("target_id").alias("source_id"), F.col("entity_id").alias("target_id"))
    anatomy = entities.where(F.col("label").startswith("ANAT")).select("report_id", F.col("entity_id").alias("anatomy_id"))
    observed = entities.where(F.col("label").isin(*RADGRAPH_ANSWER)).select("report_id", F.col("entity_id").alias("finding_id"))
    inside = back.join(anatomy.withColumnRenamed("anatomy_id", "source_id"), ["report_id", "source_id"])
    found = walks(at.unionByName(inside), max_steps).select("report_id", F.col("source_id").alias("finding_id"), F.col("target_id").alias("anatomy_id"), "steps")
    return found.join(observed, ["report_id", "finding_id"], "left_semi").join(anatomy, ["report_id", "anatomy_id"], "left_semi")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def named_findings(entities: DataFrame, names: DataFrame, keep: list[str], text: str = "tokens", name: str = "label_name") -> DataFrame:
    """keep columns and finding: the names that an entity's text holds, the longest from the left, without overlap.

    Names and texts are compared by their words, in lower case. The windows of each different text, up to the longest name's words, are
    joined with the names, so the vocabulary may be of any size; several names of the same words are all reported.
    """
    own = names.select(F.col(name).alias("finding"), _words(F.col(name)).alias("_w")).where(F.size("_w") > 0).select("finding", F.size("_w").alias("_n"), F.array_join("_w", " ").alias("_p")).distinct()
    own = materialize(own)
    longest, count = own.agg(F.max("_n"), F.count("*")).first()
    phrases = own.groupBy("_p").agg(F.collect_set("finding").alias("_f"))
    row = materialize(entities.select(*keep, F.array_join(_words(F.col(text)), " ").alias("_t")).where("_t <> ''"))
    texts = row.select("_t").distinct().withColumn("_w", F.split("_t", " "))
    starts = texts.select("_t", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - 1)).alias("_s"))
    spans = starts.select("_t", "_s", "_w", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest or 1), F.size("_w") - F.col("_s")))).alias("_l"))
    windows = spans.select("_t", "_s", "_l", F.array_join(F.slice("_w", F.col("_s") + 1, F.col("_l")), " ").alias("_p"))
    hits = windows.join(F.broadcast(phrases) if count <= BROADCAST_NAMES else phrases, "_p")
    by_text = hits.groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("_s", (-F.col("_l")).alias("_m"), "_f"))).alias("_h"))
    zero = F.struct(F.lit(0).alias("to"), F.array().cast("array<string>").alias("f"))
    taken = F.aggregate("_h", zero, lambda a, h: F.when(h["_s"] >= a["to"], F.struct((h["_s"] - h["_m"]).alias("to"), F.concat(a["f"], h["_f"]).alias("f"))).otherwise(a), lambda a: F.array_distinct(a["f"]))
    found = materialize(by_text.select("_t", taken.alias("_f")))
    found = F.broadcast(found) if found.count() <= BROADCAST_NAMES else found
    return row.join(found, "_t").select(*keep, F.explode("_f").alias("finding"))


def finding_consistency(assertions: DataFrame, observations: DataFrame) -> DataFrame:
    """study_id, finding, image_state, report_state, status of every finding that either source names for a study (EXT11).

    observations: study_id, finding, answer. A state is yes, no, uncertain or conflict; a source that doesn't name the finding
    has none, which is no evidence against it. status: conflict where a source contradicts itself, then missing_report or
    missing_image, uncertain, agree, disagree.
    """
    evidence = g1_evidence(assertions).where("study_id is not null").select("study_id", F.lower("label_name").alias("finding"), "polarity")
    state = F.when(F.col("conflict"), "conflict").when(F.col("any_yes"), "yes").otherwise("no")
    image = evidence_groups(evidence, ["study_id", "finding"]).select("study_id", "finding", state.alias("image_state"))
    said = observations.where(truthy(F.col("study_id")) & truthy(F.col("finding")) & F.col("answer").isNotNull()).groupBy("study_id", F.lower("finding").alias("finding"))
    report = said.agg(F.bool_or(F.col("answer") == "Yes").alias("y"), F.bool_or(F.col("answer") == "No").alias("n"))
    report = report.select("study_id", "finding", F.when(F.col("y") & F.col("n"), "conflict").when(F.col("y"), "yes").when(F.col("n"), "no").otherwise("uncertain").alias("report_state"))
    a, b = F.col("image_state"), F.col("report_state")
    status = (
        F.when(a.eqNullSafe("conflict") | b.eqNullSafe("conflict"), "conflict").when(b.isNull(), "missing_report").when(a.isNull(), "missing_image")
        .when(b == "uncertain", "uncertain").when(a == b, "agree").otherwise("disagree")
    )
    return image.join(report, ["study_id", "finding"], "full_outer").select("study_id", "finding", "image_state", "report_state", status.alias("status"))
