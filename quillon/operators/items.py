"""Evidence groups and benchmark items (FIL1-FIL6, AGG1-AGG7, JN1-JN4, TOP1, TOP2, PRJ1-PRJ4, CMP1-CMP4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.ids import digest_id, json_text, stable_id
from quillon.functions.text import finding_claim, finding_question, support_question, truthy
from quillon.operators.sampling import balance
from quillon.schemas import BBOX, BOX, DATASET, FINDING, IMAGE_KEY, ITEMS, SILVER, SOURCE_ASSERTION, conform
from quillon.sources.scratch import discard, laid_out, materialize
from quillon.sources.sinks import Tally

PROBE_SOURCE = "constructed_missing_evidence_probe"
_TRACE = ["assertion_id", "raw_label", "category", "polarity", "label_name", "bbox_name", "phrase_id", "phrase_index", "source_quality"]
_BOX = [c.split()[0] for c in BOX.split(", ")]


def _is_g1() -> Column:
    return (F.col("category") == FINDING) & F.col("polarity").isin("yes", "no") & truthy(F.col("image_id")) & truthy(F.col("label_name"))


def _is_g2() -> Column:
    return _is_g1() & F.col("anatomy_bound") & truthy(F.col("bbox_name"))


def g1_evidence(assertions: DataFrame) -> DataFrame:
    return assertions.where(_is_g1())


def g2_evidence(assertions: DataFrame) -> DataFrame:
    return assertions.where(_is_g2())


def finding_vocab(assertions: DataFrame) -> DataFrame:
    """Every finding that some assertion names, whatever its image."""
    return assertions.where((F.col("category") == FINDING) & F.col("polarity").isin("yes", "no") & truthy(F.col("label_name"))).select("label_name").distinct()


def _trace(df: DataFrame) -> Column:
    """The assertion as it may be published: never the phrase."""
    have = [(F.col(c) if c in df.columns else F.lit(None).cast("string" if c != "phrase_index" else "int")).alias(c) for c in _TRACE]
    return F.struct(*have, F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("scope")).cast(SOURCE_ASSERTION)


def evidence_groups(evidence: DataFrame, keys: list[str], with_sources: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per group with what polarities it has; a shuffle of partial booleans. Sources, in order of assertion, on demand.

    carry: columns whose values are the same in all rows of a group.
    """
    aggs = [F.bool_or(F.col("polarity") == "yes").alias("any_yes"), F.bool_or(F.col("polarity") == "no").alias("any_no")]
    if with_sources:
        aggs.append(F.array_sort(F.collect_list(_trace(evidence))).alias("source_assertions"))
    out = evidence.groupBy(*keys).agg(*aggs, *(F.first(c).alias(c) for c in carry))
    return out.withColumn("conflict", F.col("any_yes") & F.col("any_no"))


def g1_groups(assertions: DataFrame, with_sources: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    return evidence_groups(g1_evidence(assertions), [*IMAGE_KEY, "label_name"], with_sources, carry)


def g2_groups(assertions: DataFrame, with_sources: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    return evidence_groups(g2_evidence(assertions), [*IMAGE_KEY, "bbox_name", "label_name"], with_sources, carry)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys])


def in_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the order of the keys as text, nulls as empty (SRT1-SRT3): a range shuffle, for ordered output."""
    return df.orderBy(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys if k in df.columns))


def _order(df: DataFrame) -> Column:
    return F.col("_ord") if "_ord" in df.columns else F.struct(*sorted(c for c, t in df.dtypes if not t.startswith(("map", "variant"))))


def _inner_order(df: DataFrame, keys: list[str]) -> Column:
    """_order among rows of the same keys."""
    rest = [c for c in df.columns if c not in keys]
    return _order(df.select(*rest)) if rest else F.lit(0)


def last_by_key(df: DataFrame, keys: list[str], values: list[str], first: bool = False) -> DataFrame:
    """One row per key, nulls being equal: the last by _ord (or all columns), or the first."""
    pick = F.min_by if first else F.max_by
    return df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(pick(F.struct(*values), _order(df)).alias("_hit"))


def attach_images(groups: DataFrame, image_index: DataFrame) -> DataFrame:
    """dicom_id and image_path; without an index row, the image's own id and no path."""
    index = last_by_key(image_index, IMAGE_KEY, ["dicom_id", "image_path"])
    return groups.join(index, _same(groups, index, IMAGE_KEY), "left").select(*(groups[c] for c in groups.columns), *_image(F.col("_hit")))


def _image(hit: Column) -> list[Column]:
    return [F.when(hit.isNotNull(), hit["dicom_id"]).otherwise(F.col("image_id")).alias("dicom_id"), hit["image_path"].alias("image_path")]


def attach_boxes(groups: DataFrame, objects: DataFrame) -> DataFrame:
    """The first object's box of each group's anatomy as `bbox`, null if there is none."""
    keys = [*IMAGE_KEY, "bbox_name"]
    boxes = last_by_key(objects.select(*keys, *_box_columns(objects), *(["_ord"] if "_ord" in objects.columns else [])), keys, ["bbox_name", *_BOX], first=True)
    return groups.join(boxes, _same(groups, boxes, keys), "left").select(*(groups[c] for c in groups.columns), _bbox(F.col("_hit")).alias("bbox"))


def _box_columns(objects: DataFrame) -> list[Column]:
    return [(objects[c] if c in objects.columns else F.lit(None)).cast("double").alias(c) for c in _BOX]


def _bbox(hit: Column) -> Column:
    return F.when(hit.isNotNull(), F.struct(hit["bbox_name"].alias("bbox_name"), *(hit[c].alias(c) for c in _BOX), F.lit("original_image").alias("coordinate_space"))).cast(BBOX)


def _ids(anatomy: Column | None, finding: Column, claim: Column | None = None) -> dict:
    return {**{k: F.col(k) for k in IMAGE_KEY}, "target_anatomy": anatomy, "target_finding": finding} | ({} if claim is None else {"claim": claim})


def _item(df: DataFrame, level: str, probe: str, question: Column, answer: Column, claim: Column | None, sources: Column, evidence: list[str], any_text: bool) -> DataFrame:
    anatomy = F.col("bbox_name") if level == "G2" else None
    flag = lambda v: F.lit(v)
    return conform(df.select(
        stable_id(f"ci_{level.lower()}_{probe.lower()}", _ids(anatomy, F.col("label_name"), claim), any_text).alias("item_id"), F.lit(DATASET).alias("source_dataset"), *IMAGE_KEY, "dicom_id", "image_path",
        F.lit(level).alias("granularity"), F.lit("h1_yes_no_qa" if probe == "H1" else "h2_claim_support").alias("question_type"), F.lit(probe).alias("hallucination_probe"),
        question.alias("question"), answer.alias("answer_label"), F.col("label_name").alias("target_finding"), (anatomy if anatomy is not None else F.lit(None).cast("string")).alias("target_anatomy"),
        *([F.col("bbox")] if level == "G2" else []), sources.alias("source_assertions"), F.array(*map(F.lit, evidence)).alias("evidence_sources"), F.lit(SILVER).alias("source_quality"),
        flag(probe == "H1").alias("valid_for_clean_qa"), flag(False).alias("valid_for_false_premise"), flag(level == "G2").alias("valid_for_roi_mask"), flag(level == "G2").alias("valid_for_roi_only"), flag(False).alias("valid_for_training"),
    ), ITEMS)


_KEPT = "not conflict and bbox is not null"


def group_counts() -> list[Column]:
    """Candidate, written, yes, no, conflict and missing-box counts of groups (any_yes, conflict, bbox)."""
    return [
        F.count("*").alias("candidate_groups"), F.count_if(F.expr(_KEPT)).alias("items_written"), F.count_if(F.expr(f"{_KEPT} and any_yes")).alias("yes_items"),
        F.count_if(F.expr(f"{_KEPT} and not any_yes")).alias("no_items"), F.count_if("conflict").alias("excluded_conflict_groups"),
        F.count_if(F.expr("not conflict and bbox is null")).alias("excluded_missing_bbox_groups"),
    ]


def build_g1_h1(assertions: DataFrame, image_index: DataFrame, any_text: bool = True, tally: Tally | None = None) -> DataFrame:
    """tally: takes the builder's counts while the items are written."""
    g = g1_groups(assertions, True)
    g = tally(g.withColumn("bbox", F.lit("none")), *group_counts()).drop("bbox") if tally else g
    g = attach_images(g.where("not conflict"), image_index)
    return _item(g, "G1", "H1", finding_question(F.col("label_name")), F.when(F.col("any_yes"), "Yes").otherwise("No"), None, F.col("source_assertions"), ["E2_structured_label"], any_text)


def build_g2_h1(assertions: DataFrame, objects: DataFrame, image_index: DataFrame, any_text: bool = True, tally: Tally | None = None) -> DataFrame:
    """tally: takes the builder's counts while the items are written; groups in conflict then get boxes too."""
    g = g2_groups(assertions, True)
    g = tally(attach_boxes(g, objects), *group_counts()).where(_KEPT) if tally else attach_boxes(g.where("not conflict"), objects).where("bbox is not null")
    g = attach_images(g, image_index)
    return _item(g, "G2", "H1", finding_question(F.col("label_name"), F.col("bbox_name")), F.when(F.col("any_yes"), "Yes").otherwise("No"), None, F.col("source_assertions"), ["E1_bbox", "E2_anatomy_finding_pair"], any_text)


def _named(assertions: DataFrame) -> DataFrame:
    kept = assertions.where((F.col("category") == FINDING) & F.col("polarity").isin("yes", "no") & truthy(F.col("label_name")))
    return kept.select(*dict.fromkeys(c for c in [*IMAGE_KEY, "anatomy_bound", *_TRACE] if c in assertions.columns))


def findings_by_image(assertions: DataFrame) -> DataFrame:
    """What builders need of the assertions of findings, laid out by image: the one shuffle of assertions in a build."""
    return laid_out(_named(assertions), IMAGE_KEY)


def sources_by_image(assertions: DataFrame, image_index: DataFrame, objects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the layout, its rows): assertions of findings and objects, `_from` a or o, laid out by image together with the image index.

    Each row has its image's row of the index as `_image` and, with objects, its anatomy's first box as `_first`: the same as
    attach_images and attach_boxes give, but found inside the layout, so that a build joins nothing.
    """
    index = image_index.select(*IMAGE_KEY, F.lit("i").alias("_from"), F.struct("dicom_id", "image_path").alias("_image"), _inner_order(image_index, IMAGE_KEY).alias("_image_ord"))
    union = _named(assertions).withColumn("_from", F.lit("a")).unionByName(index, allowMissingColumns=True)
    if objects is not None:
        boxes = objects.select(*IMAGE_KEY, "bbox_name", *_box_columns(objects), *(["_ord"] if "_ord" in objects.columns else []))
        boxes = boxes.select(*IMAGE_KEY, "bbox_name", F.lit("o").alias("_from"), F.struct("bbox_name", *_BOX).alias("_box"), *(["_ord"] if "_ord" in boxes.columns else []))
        union = union.unionByName(boxes, allowMissingColumns=True)
    layout = laid_out(union, IMAGE_KEY)
    out = layout.withColumn("_image", F.max_by("_image", "_image_ord").over(Window.partitionBy(*IMAGE_KEY))).where(F.col("_from") != "i")
    if objects is not None:
        order = F.when(F.col("_from") == "o", F.col("_ord") if "_ord" in out.columns else F.struct(*(F.col("_box")[c] for c in sorted(_BOX))))
        out = out.withColumn("_first", F.min_by("_box", order).over(Window.partitionBy(*IMAGE_KEY, "bbox_name")))
    return layout, out


def _sampled(items: DataFrame, own: DataFrame, balance_h2: bool, fraction: float, seed: int, any_text: bool) -> tuple[DataFrame, dict]:
    if not balance_h2:  # the items are still made from the layout
        return items, {"balance_applied": False, "balance_reason": "disabled"}
    out = balance(items, negative_fraction=fraction, seed=seed, any_text=any_text, one_label=True)  # claims of a finding that is mentioned, and of one that is not
    discard(own)  # balance has made the items
    return out


#: Findings up to which the vocabulary is sent to every task; a larger one is joined as Spark sees fit.
BROADCAST_FINDINGS = 100_000


def _missing(mentions: DataFrame, vocab: DataFrame, scope: list[str], k: int, any_text: bool) -> DataFrame:
    """The first k findings by hash that `mentioned` lacks, ranked inside the row.

    The vocabulary is one row: an array of findings with their JSON text, which is made once for each finding.
    """
    known = materialize(vocab.select(F.col("label_name").alias("f"), json_text(F.col("label_name"), any_text).alias("j")))
    words = known.agg(F.array_sort(F.collect_set(F.struct("f", "j"))).alias("vocab"))
    words = F.broadcast(words) if known.count() <= BROADCAST_FINDINGS else words
    rest = [c for c in mentions.columns if c != "mentioned"]
    scoped = mentions.select("*", *(json_text(F.col(c), any_text).alias(f"_j_{c}") for c in scope))
    of = {c if c != "image_id" else "image": F.col(f"_j_{c}") for c in scope}
    lack = F.filter("vocab", lambda w: ~F.array_contains("mentioned", w["f"]))
    ranked = F.transform(lack, lambda w: F.struct(digest_id("rank", of | {"finding": w["j"]}).alias("r"), w["f"].alias("f")))
    top = F.array_compact(F.array(F.array_min(ranked))) if k == 1 else F.slice(F.array_sort(ranked), 1, k)
    # a plain explode gets a filter on the list's size, which would rank all findings a second time
    return scoped.crossJoin(words).select(*rest, F.explode_outer(F.transform(top, lambda s: s["f"])).alias("label_name")).where("label_name is not null")


def g1_missing(assertions: DataFrame, k: int = 1, any_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per image with evidence, the first k findings of the vocabulary that it does not mention, conflicts included."""
    mentions = g1_evidence(assertions).groupBy(*IMAGE_KEY).agg(F.collect_set("label_name").alias("mentioned"), *(F.first(c).alias(c) for c in carry))
    return _missing(mentions, finding_vocab(assertions), ["image_id"], k, any_text)


def g2_missing(assertions: DataFrame, objects: DataFrame, k: int = 1, any_text: bool = True) -> DataFrame:
    """Per object row, the first k findings that its anatomy does not mention; anatomies never mentioned lack them all."""
    keys = [*IMAGE_KEY, "bbox_name"]
    seen = g2_evidence(assertions).groupBy(*(F.col(c).alias(f"_{c}") for c in keys)).agg(F.collect_set("label_name").alias("_m"))
    own = objects.where(truthy(F.col("image_id")) & truthy(F.col("bbox_name"))).select(*keys, *_box_columns(objects))
    mentions = own.join(seen, _same(own, seen, keys), "left").select(*keys, *_BOX, F.coalesce("_m", F.array().cast("array<string>")).alias("mentioned"))
    return _missing(mentions, finding_vocab(assertions), ["image_id", "bbox_name"], k, any_text)


def _missing_in_layout(rows: DataFrame, k: int, any_text: bool) -> DataFrame:
    """g2_missing of the rows of sources_by_image, with `_image`."""
    own = rows.where(truthy(F.col("image_id")) & truthy(F.col("bbox_name"))).groupBy(*IMAGE_KEY, "bbox_name").agg(
        F.collect_set(F.when(_is_g2(), F.col("label_name"))).alias("mentioned"), F.collect_list(F.when(F.col("_from") == "o", F.col("_box"))).alias("_boxes"), F.first("_image").alias("_image"),
    )
    mentions = own.select(*IMAGE_KEY, "bbox_name", "mentioned", "_image", F.explode("_boxes").alias("_box")).select(*IMAGE_KEY, "bbox_name", *(F.col(f"_box.{c}") for c in _BOX), "mentioned", "_image")
    return _missing(mentions, finding_vocab(rows), ["image_id", "bbox_name"], k, any_text)


def _probe(level: str) -> Column:
    return F.array(F.struct(
        *(F.lit(None).alias(c) if c not in ("label_name", "bbox_name") else (F.col(c) if c == "label_name" or level == "G2" else F.lit(None)).alias(c) for c in _TRACE),
        F.lit(PROBE_SOURCE).alias("source"), F.lit("anatomy" if level == "G2" else "image").alias("scope"),
    ).cast(SOURCE_ASSERTION))


def build_g1_h2(assertions: DataFrame, image_index: DataFrame, unsupported_per_image: int = 1, balance_h2: bool = True, fraction: float = 0.8, seed: int = 42, any_text: bool = True) -> tuple[DataFrame, dict]:
    if unsupported_per_image < 1:
        raise ValueError("unsupported_per_image must be at least 1")
    own, rows = sources_by_image(assertions, image_index)
    g = g1_groups(rows, True, ("_image",)).where("not conflict").select("*", *_image(F.col("_image")))
    claim = finding_claim(F.col("label_name"), F.col("any_yes"))
    yes = _item(g, "G1", "H2", support_question(claim), F.lit("Supported"), claim, F.col("source_assertions"), ["E2_structured_label"], any_text)
    m = g1_missing(rows, unsupported_per_image, any_text, ("_image",)).select("*", *_image(F.col("_image")))
    claim = finding_claim(F.col("label_name"), F.lit(True))
    no = _item(m, "G1", "H2", support_question(claim), F.lit("Unsupported"), claim, _probe("G1"), ["E5_task_context"], any_text)
    items = yes.unionByName(no)
    return _sampled(items, own, balance_h2, fraction, seed, any_text)


def build_g2_h2(assertions: DataFrame, objects: DataFrame, image_index: DataFrame, unsupported_per_anatomy: int = 1, balance_h2: bool = True, fraction: float = 0.8, seed: int = 42, any_text: bool = True) -> tuple[DataFrame, dict]:
    if unsupported_per_anatomy < 1:
        raise ValueError("unsupported_per_anatomy must be at least 1")
    own, rows = sources_by_image(assertions, image_index, objects)
    g = g2_groups(rows, True, ("_image", "_first")).where("not conflict and _first is not null").select("*", _bbox(F.col("_first")).alias("bbox"), *_image(F.col("_image")))
    claim = finding_claim(F.col("label_name"), F.col("any_yes"), F.col("bbox_name"))
    yes = _item(g, "G2", "H2", support_question(claim), F.lit("Supported"), claim, F.col("source_assertions"), ["E1_bbox", "E2_anatomy_finding_pair"], any_text)
    m = _missing_in_layout(rows, unsupported_per_anatomy, any_text)
    m = m.select("*", _bbox(F.struct("bbox_name", *_BOX)).alias("bbox"), *_image(F.col("_image")))
    claim = finding_claim(F.col("label_name"), F.lit(True), F.col("bbox_name"))
    no = _item(m, "G2", "H2", support_question(claim), F.lit("Unsupported"), claim, _probe("G2"), ["E1_bbox", "E5_task_context"], any_text)
    items = yes.unionByName(no)
    return _sampled(items, own, balance_h2, fraction, seed, any_text)


def anatomies(assertions: DataFrame, objects: DataFrame) -> DataFrame:
    """A row per anatomy of an image: `found`, the set of (f, yes, bound) of its findings, and `objects`, how many there are of it.

    All that the ids and labels of G2-H2 items depend on, with one shuffle; a row holds each finding four times at most.
    Where image or anatomy have no name no items are made, so objects count as 0 there.
    """
    keys = [*IMAGE_KEY, "bbox_name"]
    own = _named(assertions).select(*keys, _found().alias("_f"), F.lit(0).alias("_o"))
    rows = own.unionByName(objects.select(*keys, F.lit(None).cast(own.schema["_f"].dataType).alias("_f"), F.when(truthy(F.col("image_id")) & truthy(F.col("bbox_name")), 1).otherwise(0).alias("_o")))
    return rows.groupBy(*keys).agg(F.collect_set("_f").alias("found"), F.sum("_o").alias("objects"))


def _found() -> Column:
    return F.struct(F.col("label_name").alias("f"), (F.col("polarity") == "yes").alias("yes"), F.coalesce("anatomy_bound", F.lit(False)).alias("bound"))


def _sides(rows: DataFrame) -> DataFrame:
    """Anatomies that items can be made of, with the findings that each mentions and those that it names on one side alone."""
    of = lambda when: F.array_distinct(F.transform(F.filter("found", when), lambda x: x["f"]))
    sides = rows.where("objects > 0").select("*", of(lambda x: x["bound"] & x["yes"]).alias("_yes"), of(lambda x: x["bound"] & ~x["yes"]).alias("_no"))
    return sides.select("*", F.array_union("_yes", "_no").alias("mentioned"), F.array_except("_yes", "_no").alias("only_yes"), F.array_except("_no", "_yes").alias("only_no"))


def _found_vocab(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.transform("found", lambda x: x["f"])).alias("label_name")).distinct()


def g2_h2_labels(rows: DataFrame, k: int = 1, any_text: bool = True) -> DataFrame:
    """(item_id, answer_label) of the items that build_g2_h2 makes without balancing, of a table of `anatomies`; nothing is shuffled but the vocabulary."""
    keys = [*IMAGE_KEY, "bbox_name"]
    own = _sides(rows)
    said = lambda c, yes: F.transform(c, lambda f: F.struct(f.alias("label_name"), F.lit(yes).alias("any_yes")))
    yes = own.select(*keys, F.inline(F.concat(said("only_yes", True), said("only_no", False)))).withColumn("answer_label", F.lit("Supported"))
    no = _missing(own.select(*keys, "objects", "mentioned"), _found_vocab(rows), ["image_id", "bbox_name"], k, any_text)
    no = no.select(*keys, "label_name", F.lit(True).alias("any_yes"), F.lit("Unsupported").alias("answer_label"), F.explode(F.array_repeat(F.lit(0), F.col("objects").cast("int")))).drop("col")
    claim = finding_claim(F.col("label_name"), F.col("any_yes"), F.col("bbox_name"))
    return yes.unionByName(no).select(stable_id("ci_g2_h2", _ids(F.col("bbox_name"), F.col("label_name"), claim), any_text).alias("item_id"), "answer_label")


def balanced_g2_h2_labels(rows: DataFrame, k: int = 1, fraction: float = 0.8, seed: int = 42, any_text: bool = True) -> DataFrame:
    """(item_id, answer_label) of the items that build_g2_h2 makes, of `anatomies`."""
    own = materialize(rows, codec="zstd")
    out, _ = balance(g2_h2_labels(own, k, any_text), negative_fraction=fraction, seed=seed, any_text=any_text, one_label=True)
    discard(own)  # balance has made the items
    return out


def g2_h2_counts(rows: DataFrame, k: int = 1) -> tuple[int, int]:
    """How many items build_g2_h2 makes without balancing, Supported and Unsupported, of `anatomies`.

    An object gets k findings, or as many as its anatomy lacks: the vocabulary less those mentioned. So nothing is ranked.
    """
    own = materialize(rows.select("found", "objects"), codec="zstd")
    lacks = F.lit(_found_vocab(own).count()) - F.size("mentioned")
    sums = _sides(own).agg(F.sum(F.size("only_yes") + F.size("only_no")).alias("p"), F.sum(F.col("objects") * F.least(F.lit(k), lacks)).alias("n")).first()
    discard(own)
    return sums["p"] or 0, sums["n"] or 0


def builder_summary(groups: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """Candidate, written, yes, no, conflict and missing-box counts in one pass."""
    g = attach_boxes(groups, objects) if objects is not None else groups.withColumn("bbox", F.lit("none"))
    return g.agg(*group_counts())
