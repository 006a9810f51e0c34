"""Hand-built fixtures: ingest, items, linking, prompts, answers, scores, reports, streaming."""

import glob
import hashlib
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon import cli, schemas
from quillon.functions import ids, text
from quillon.operators import audit, graphs, items, linking, models, prompts, report, sampling, scoring
from quillon.plans import adapters, catalogue
from quillon.sources import members, scene_graphs, scratch, sinks, storage, tables
from quillon.streaming.scoring import score_stream, summary_stream
from tests.conftest import SMALL


def graph(**over):
    attribute = {
        "bbox_name": "right lung", "right lung": True, "name": "Right lung", "object_id": "o1", "attributes": [["anatomicalfinding|no|pneumothorax", "nlp|yes|normal"], ["anatomicalfinding|no|opacity", "bad label"]],
        "attributes_ids": [["C1", "C2"], ["C3"]], "phrases": ["toy phrase a", "toy phrase b"], "phrase_IDs": ["s1|1"], "sections": ["findings", "findings"], "comparison_cues": [[], []],
        "temporal_cues": [[], []], "severity_cues": [["severity|yes|mild"], []], "texture_cues": [[], []],
    }
    box = {"object_id": "o1", "bbox_name": "right lung", "name": "Right lung", "synsets": ["C0"], "x1": 1, "y1": "2", "x2": True, "y2": 4.5, "original_x1": 10}
    return {"image_id": "img-1", "patient_id": "p1", "study_id": 7, "objects": [box, "odd"], "attributes": [attribute, 3, attribute | {"right lung": "true"}, attribute | {"bbox_name": False}]} | over


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a_SceneGraph.json").write_text(json.dumps(graph()), encoding="utf-8")
    (tmp_path / "sub/b_SceneGraph.json").write_text(json.dumps({"image_id": "img-2", "objects": []}), encoding="utf-8")
    (tmp_path / "other.json").write_text("{}", encoding="utf-8")
    return str(tmp_path)


def test_ingest(spark, folder):
    parsed = scene_graphs.parse_scene_graphs(scene_graphs.discover(spark, folder))
    box = parsed.objects.collect()
    assert len(box) == 1 and (box[0]["x1"], box[0]["y1"], box[0]["x2"], box[0]["y2"], box[0]["study_id"], box[0]["synsets"]) == (1.0, None, None, 4.5, "7", ["C0"])
    rows = sorted(parsed.assertions.collect(), key=lambda r: r["assertion_id"])
    assert len(rows) == 12 and rows[0]["assertion_id"] == "ci_attr::img-1::0000::000::000"
    assert [(r["anatomy_bound"], r["bbox_name"]) for r in rows[::4]] == [(True, "right lung"), (False, None), (False, None)]
    assert (rows[0]["category"], rows[0]["polarity"], rows[0]["label_name"], rows[0]["phrase_id"], rows[0]["severity_cues"]) == ("anatomicalfinding", "no", "pneumothorax", "s1|1", ["severity|yes|mild"])
    assert rows[3]["raw_label"] == "bad label" and rows[3]["category"] is None and rows[3]["attributes_id"] is None and rows[2]["phrase_id"] is None
    warned = {r["key"]: r["n"] for r in parsed.warnings.collect()}
    assert warned == {"missing_top_level_key:attributes": 1, "invalid_object_entry": 1, "invalid_attribute_entry": 1, "misaligned_phrase_key:phrase_IDs": 3, "malformed_label": 3}
    assert scene_graphs.parser_summary(parsed, ["t"])["files_seen"] == 2
    assert scene_graphs.discover(spark, folder, 1).count() == 1
    with pytest.raises(FileNotFoundError):
        scene_graphs.discover(spark, folder + "/none")
    with pytest.raises(ValueError):
        scene_graphs.discover(spark, folder, 0)


def test_documents_are_read_once_and_counted_while_writing(spark, folder, tmp_path):
    for k in range(5):
        (tmp_path / f"c{k}_SceneGraph.json").write_text(json.dumps(graph(image_id=f"c{k}", objects=[] if k == 2 else graph()["objects"])), encoding="utf-8")
    (tmp_path / "d_SceneGraph.json").write_text('{"image_id": "d", "objects": [], "attributes": []', encoding="utf-8")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        read.add(1)
        return t

    docs = scene_graphs.discover(spark, folder).withColumn("text", counted("text"))
    parsed = scene_graphs.parse_scene_graphs(docs, strict=False)
    sinks.write_parquet(parsed.objects, f"{folder}/o")
    sinks.write_parquet(parsed.assertions, f"{folder}/a")
    told = scene_graphs.written_summary(parsed, ["t"])
    assert read.value == 8 and told == scene_graphs.parser_summary(parsed, ["t"]) and read.value == 8
    assert told["ci_objects_rows"] == spark.read.parquet(f"{folder}/o").count() and told["warnings"]["malformed_json"] == 1
    assert [r["path"].rsplit("/", 1)[1] for r in parsed.refused.collect()] == ["d_SceneGraph.json"]
    with pytest.raises(ValueError, match="d_SceneGraph"):
        scene_graphs.parse_scene_graphs(docs)


def test_lists_of_documents_are_taken_once(spark, folder):
    """No filter on a list's size below an explode, which would make the list and what it is made of again; no VARIANT in a row of a label."""
    parsed = scene_graphs.parse_scene_graphs(scene_graphs.discover(spark, folder))
    for df in (parsed.objects, parsed.assertions, parsed.warnings):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Filter .*size\((?!missing)", plan), plan
    labels = next(x for x in parsed.assertions._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate posexplode(labels" in x)
    assert "Generate" in labels and shuffles(parsed.objects) == 0


def test_lines_are_gathered_before_their_json_is_made(spark):
    from quillon.plans.adapters import scene_graph_documents

    plan = scene_graph_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "object_id" not in plan[plan.index("collect_list(") :]


def test_texts_of_odd_lists(spark):
    """Entries that are no lists, no scalars or null keep their places."""
    attribute = '{"bbox_name": "it\'s [\\"a\\"]", "it\'s [\\"a\\"]": true, "attributes": [["a|yes|x", null, ["n"], 5], "no list", [], ["b|no|y"]], "attributes_ids": [["I", null], 3], "phrases": [null, 1, true, "p"], "severity_cues": [["s", null, 2], "no", [], [true]]}'
    text = f'{{"image_id": 1, "objects": [null, [], {{}}, {{"x1": "1", "x2": 1e3, "y1": null, "name": null, "synsets": "s"}}], "attributes": [{attribute}, null, []]}}'
    parsed = scene_graphs.parse_scene_graphs(spark.createDataFrame([("p", text)], "path string, text string"))
    got = [tuple(r[c] for c in ("assertion_id", "raw_label", "label_name", "bbox_name", "attributes_id", "phrase", "severity_cues")) for r in parsed.assertions.orderBy("assertion_id").collect()]
    place, key = "ci_attr::1::0000::", 'it\'s ["a"]'
    assert got == [
        (place + "000::000", "a|yes|x", "x", key, "I", None, ["s", "2"]), (place + "000::001", None, None, key, None, None, ["s", "2"]),
        (place + "000::002", None, None, key, None, None, ["s", "2"]), (place + "000::003", "5", None, key, None, None, ["s", "2"]), (place + "003::000", "b|no|y", "y", key, None, "p", []),
    ]
    assert sorted((r["x1"] or 0, r["x2"] or 0, r["synsets"]) for r in parsed.objects.collect()) == [(0, 0, []), (0, 1000.0, [])]
    assert {r["key"]: r["n"] for r in parsed.warnings.collect()} == {"invalid_object_entry": 2, "invalid_attribute_entry": 2, "misaligned_phrase_key:attributes_ids": 1, "malformed_label": 3}


def test_json_as_a_tolerant_parser_takes_it(spark):
    box = '{"bbox_name": "first", "x1": 1, "x1": 2, "y1": NaN, "x2": Infinity, "y2": -Infinity, "name": NaN, "bbox_name": "last", "object_id": "NaN"}'
    texts = [f'{{"image_id": "old", "objects": [{box}], "attributes": [], "image_id": "new"}}', "[1, 2", "", None, "NaN", "[" * 100_000]
    docs = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, text string")
    parsed = scene_graphs.parse_scene_graphs(docs, strict=False)
    (r,) = parsed.objects.collect()
    assert (r["image_id"], r["bbox_name"], r["x1"], r["x2"], r["y2"], r["name"], r["object_id"]) == ("new", "last", 2.0, float("inf"), float("-inf"), "nan", "NaN") and r["y1"] != r["y1"]
    assert sorted(r["path"] for r in parsed.refused.collect()) == ["p1", "p2", "p3", "p5"]


def test_a_limit_opens_no_other_file(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"{k:03d}_SceneGraph.json").write_text(json.dumps(graph(image_id=f"i{k}")), encoding="utf-8")
    docs = scene_graphs.discover(spark, str(tmp_path), 7)
    assert sorted(p.rsplit("/", 1)[1][:3] for p in docs.inputFiles()) == [f"{k:03d}" for k in range(7)] and docs.count() == 7
    assert scene_graphs.discover(spark, str(tmp_path), 100).count() == 60


def test_writers_of_sections_do_not_lose_each_other(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    for path in (str(tmp_path / "a/summary.json"), f"file://{tmp_path}/b/summary.json"):
        sinks.write_json(path, {"old": {"n": 0}})
        with ThreadPoolExecutor(6) as pool:
            list(pool.map(lambda k: sinks.update_summary(path, f"s{k}", {"n": k}), range(6)))  # noqa: B023
        assert tables.read_summary(path) == {"old": {"n": 0}} | {f"s{k}": {"n": k} for k in range(6)}
        sinks.update_summary(path, "s1", {"n": 9})
        assert tables.read_summary(path)["s1"] == {"n": 9}
    assert not list(tmp_path.rglob("*.part")) and not (tmp_path / "file:").exists()


def test_stable_ids_equal_json_digests(spark):
    values = ["opacity", 'q"\\x', "é😀", "\x1f\x7f", "line\n", None, ""]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", ids.stable_id("p", {"b": F.col("v"), "a": None, "seed": 42}).alias("i"))
    for r in df.collect():
        want = hashlib.sha1(json.dumps({"a": None, "b": r["v"], "seed": 42}, sort_keys=True).encode()).hexdigest()[:16]
        assert r["i"] == f"p_{want}"


def ev(patient, image, label, polarity, bbox="lung", bound=True, **over):
    return {"assertion_id": f"{image}-{label}-{polarity}", "patient_id": patient, "study_id": "s", "image_id": image, "bbox_name": bbox, "anatomy_bound": bound, "raw_label": "r", "category": "anatomicalfinding", "polarity": polarity, "label_name": label, "phrase_id": "1", "phrase_index": 0, "phrase": "secret words", "source_quality": "silver"} | over


def frame(spark, rows, schema=schemas.ASSERTIONS):
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)


@pytest.fixture
def small(spark):
    a = frame(spark, [ev("p", "i1", "opacity", "yes"), ev("p", "i2", "effusion", "yes"), ev("p", "i3", "edema", "yes"), ev("p", "i3", "edema", "no"), ev(None, "i4", "opacity", "no"), ev("p", "", "opacity", "yes"), ev("p", "i5", "x", "maybe")])
    o = frame(spark, [{"patient_id": "p", "study_id": "s", "image_id": i, "bbox_name": "lung", "x1": 1.0} for i in ("i1", "i2", "i9")], schemas.OBJECTS)
    index = frame(spark, [{"patient_id": "p", "study_id": "s", "image_id": "i1", "dicom_id": None, "image_path": "a.jpg"}, {"patient_id": None, "study_id": "s", "image_id": "i4", "dicom_id": "d4"}], schemas.IMAGE_INDEX)
    return a, o, index


def test_items(spark, small):
    a, o, index = small
    h1 = {r["image_id"]: r for r in items.build_g1_h1(a, index).collect()}
    assert {k: v["answer_label"] for k, v in h1.items()} == {"i1": "Yes", "i2": "Yes", "i4": "No"}  # a conflict and an empty image are out
    assert (h1["i1"]["dicom_id"], h1["i1"]["image_path"], h1["i2"]["dicom_id"], h1["i4"]["dicom_id"]) == (None, "a.jpg", "i2", "d4")
    assert "secret" not in str(h1) and h1["i1"]["valid_for_clean_qa"] and h1["i1"]["bbox"] is None
    h2, s = items.build_g1_h2(a, index)
    assert (s["positive_before"], s["negative_before"]) == (3, 4) and (s["positive_after"], s["negative_after"]) == (1, 4) and h2.count() == 5
    off, s = items.build_g1_h2(a, index, balance_h2=False)
    assert off.count() == 7 and not s["balance_applied"]
    g2 = items.build_g2_h1(a, o, index).collect()
    assert sorted(r["image_id"] for r in g2) == ["i1", "i2"] and g2[0]["bbox"]["coordinate_space"] == "original_image"
    g2h2, _ = items.build_g2_h2(a, o, index, balance_h2=False)
    assert g2h2.groupBy("answer_label").count().orderBy("answer_label").collect()[1][1] == 3
    assert items.builder_summary(items.g2_groups(a), o).first()["excluded_missing_bbox_groups"] == 1
    again = items.build_g1_h2(a.repartition(3), index)[0]
    assert {r["item_id"] for r in again.collect()} == {r["item_id"] for r in h2.collect()}
    assert items.build_g1_h1(a.limit(0), index).count() == 0
    with pytest.raises(ValueError):
        items.build_g1_h2(a, index, unsupported_per_image=0)


def test_a_build_shuffles_assertions_once(spark, small):
    a, o, index = small
    own = items.findings_by_image(a)
    for df in (items.g1_groups(own, True), items.g2_groups(own, True), items.g1_evidence(own).groupBy(*schemas.IMAGE_KEY).agg(F.collect_set("label_name"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    name = own._quillon_table
    scratch.discard(own)
    assert not spark.catalog.tableExists(name)
    before = {t.name for t in spark.catalog.listTables()}
    out, _ = items.build_g2_h2(a, o, index)
    assert {t.name for t in spark.catalog.listTables()} == before and out.count() == 4  # the layout goes once items are made


def test_a_build_joins_and_shuffles_nothing_after_its_layout(spark, small):
    a, o, index = small
    o = o.unionByName(o.where("image_id = 'i1'").withColumn("x1", F.lit(0.5))).unionByName(o.where("image_id = 'i2'").withColumn("bbox_name", F.lit(None).cast("string")))
    index = index.unionByName(index.where("image_id = 'i1'").withColumn("image_path", F.lit("b.jpg")))
    for items_ in (items.build_g1_h2(a, index, balance_h2=False)[0], items.build_g2_h2(a, o, index, balance_h2=False)[0]):
        plan = items_._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftOuter" not in plan and shuffles(items_) <= 1  # the vocabulary's one row
        assert not re.search(r"Filter .*size\(transform", plan)  # findings are ranked once
    rows = items.build_g2_h2(a, o, index, balance_h2=False)[0].collect()
    got = sorted((r["answer_label"], r["image_id"], r["target_finding"], r["dicom_id"], r["image_path"], r["bbox"]["x1"]) for r in rows if r["answer_label"] == "Supported")
    assert got == [("Supported", "i1", "opacity", None, "b.jpg", 0.5), ("Supported", "i2", "effusion", "i2", None, 1.0)]
    said = items.attach_images(items.g2_missing(a, o, 1), index)
    want = sorted(tuple(map(str, r)) for r in said.select("image_id", "bbox_name", "label_name", "dicom_id", "image_path", "x1").collect())
    assert want == sorted(tuple(map(str, (r["image_id"], r["target_anatomy"], r["target_finding"], r["dicom_id"], r["image_path"], r["bbox"]["x1"]))) for r in rows if r["answer_label"] == "Unsupported")


def test_labels_alone_equal_the_items(spark, small):
    a, o, index = small
    o = o.unionByName(o.where("image_id = 'i1'").withColumn("x1", F.lit(0.5))).unionByName(frame(spark, [{"patient_id": None, "study_id": "s", "image_id": "i4", "bbox_name": "lung"}, {"image_id": "i2"}, {"image_id": "", "bbox_name": "lung"}], schemas.OBJECTS))
    a = a.unionByName(frame(spark, [ev("p", "i1", "opacity", "no"), ev("p", "i1", "edema", "no"), ev("p", "i2", "far", "yes", bound=False), ev("p", "i2", "é", "no", None), ev("p", "i9", "nlp", "yes", category="nlp"), ev("p", "i9", "opacity", "yes", bound=None)]))
    rows = items.anatomies(a, o)
    for k in (1, 9):
        want = sorted(tuple(r) for r in items.build_g2_h2(a, o, index, k, False)[0].select("item_id", "answer_label").collect())
        assert sorted(tuple(r) for r in items.g2_h2_labels(rows, k).collect()) == want
        assert items.g2_h2_counts(rows, k) == tuple(sum(z == of for _, z in want) for of in ("Supported", "Unsupported"))
        kept, summary = items.build_g2_h2(a, o, index, k, fraction=0.5, seed=3)
        assert sorted(r[0] for r in items.balanced_g2_h2_labels(rows, k, 0.5, 3).collect()) == sorted(r["item_id"] for r in kept.collect())
        assert sampling.balance_summary(items.g2_h2_counts(rows, k), negative_fraction=0.5, seed=3) == summary
    assert items.g2_h2_counts(items.anatomies(a.limit(0), o.limit(0))) == (0, 0) and items.balanced_g2_h2_labels(items.anatomies(a.limit(0), o)).count() == 0


def test_anatomies_of_the_tables_are_those_of_the_views(spark):
    plain = lambda df: sorted((r["patient_id"], r["study_id"], r["image_id"], r["bbox_name"], sorted(map(tuple, r["found"])), r["objects"]) for r in df.where("size(found) > 0 or objects > 0").collect())
    got = plain(adapters.anatomies(spark, SMALL))
    assert got == plain(items.anatomies(adapters.assertions(spark, SMALL), adapters.view(spark, SMALL, "co"))) and len(got) > 1000


def test_balanced_labels_write_little(spark, monkeypatch):
    """Of the items two columns are written, and no ranks; the summary writes no ids at all."""
    sizes = []

    def noted(df, *args, **kwargs):
        out = scratch.materialize(df, *args, **kwargs)
        sizes.append((out.columns, sum(os.path.getsize(f) for f in glob.glob(f"{out._quillon_path.removeprefix('file:')}/*.parquet"))))
        return out
    for module in (items, sampling):
        monkeypatch.setattr(module, "materialize", noted)
    monkeypatch.setattr(items, "laid_out", None)
    n = catalogue.Q["h2_balanced"](spark, SMALL).count()
    assert sorted(c for c, _ in sizes)[1:] == [["item_id", "answer_label"], ["patient_id", "study_id", "image_id", "bbox_name", "found", "objects"]] and sum(b for _, b in sizes) < 40 * n
    sizes.clear()
    assert catalogue.Q["h2_balance_summary"](spark, SMALL).count() == 1 and [c for c, _ in sizes] == [["found", "objects"]]


def test_ids_of_one_label_are_not_looked_up(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("concat('id', id) item_id", "case when id % 2 = 0 then 'Supported' else 'Unsupported' end answer_label")
    want = sorted(map(tuple, sampling.balance(rows)[0].collect()))
    monkeypatch.setattr(sampling, "_one_label", None)
    out, summary = sampling.balance(rows, one_label=True)
    assert sorted(map(tuple, out.collect())) == want and len(want) == summary["positive_after"] + summary["negative_after"] == 375 + 1500


def test_native_and_escaped_ids_agree(spark, small):
    a, o, index = small
    for build in (lambda t: items.build_g1_h2(a, index, any_text=t)[0], lambda t: items.build_g2_h2(a, o, index, any_text=t)[0]):
        assert sorted(r["item_id"] for r in build(True).collect()) == sorted(r["item_id"] for r in build(False).collect())


@pytest.mark.parametrize("p, n, f, want", [(2, 2, 0.8, (1, 2)), (11, 36, 0.8, (9, 36)), (100, 10, 0.5, (10, 10)), (1, 100, 0.9, (1, 9))])
def test_quotas(p, n, f, want):
    assert sampling.quotas(p, n, f) == want


def _kept_by_sorting(rows, fraction, seed):
    """The rule, plainly: per label the first ids by hash, then all rows of the kept ids."""
    rank = lambda r: "sample_" + hashlib.sha1(json.dumps({"seed": seed, "label": r[1], "item_id": r[0]}, sort_keys=True).encode()).hexdigest()[:16]
    own = {z: sorted((r for r in rows if r[1] == z), key=rank) for z in ("Supported", "Unsupported")}
    quota = sampling.quotas(len(own["Supported"]), len(own["Unsupported"]), fraction)
    ids_kept = {r[0] for z, q in zip(own, quota, strict=True) for r in own[z][:q]} | {r[0] for r in rows if r[1] not in own}
    return sorted((r for r in rows if r[0] in ids_kept), key=str), quota


@pytest.mark.parametrize("prefix", [1, 4])
def test_balance_equals_sorting(spark, monkeypatch, prefix):
    monkeypatch.setattr(sampling, "PREFIX", prefix)
    one = [(f"id{k}", "Supported" if k % 3 == 0 else "Unsupported") for k in range(400)]
    several = [*one, ("id3", "Unsupported"), ("id7", "Supported"), ("id9", "Other"), ("é", None), *[("hot", "Unsupported")] * 200, ("id4", "Unsupported"), (None, "Supported")]
    for rows, fraction in ((one, 0.8), (one, 0.3), (several, 0.5), (several, 0.9)):
        out, summary = sampling.balance(spark.createDataFrame(rows, "item_id string, answer_label string"), negative_fraction=fraction, seed=7)
        want, quota = _kept_by_sorting(rows, fraction, 7)
        assert sorted(map(tuple, out.collect()), key=str) == want and (summary["positive_after"], summary["negative_after"]) == quota


def test_row_index_follows_the_order(spark):
    rows = [(k % 7 if k % 5 else None, f"r{k}") for k in range(200)] + [(3, "r3")] * 100
    df = spark.createDataFrame(rows, "v int, name string")
    got = sorted((r["row_index"], r["v"]) for r in prompts.with_row_index(df, "v").collect())
    assert [i for i, _ in got] == list(range(300)) and [v for _, v in got] == sorted((v for v, _ in rows), key=lambda v: -1 if v is None else v)
    nested = df.withColumn("_ord", F.struct(F.col("name").alias("f"), F.col("v")))
    assert [r["name"] for r in prompts.with_row_index(nested, "_ord").orderBy("row_index").collect()] == sorted(n for _, n in rows)
    assert prompts.with_row_index(df.limit(0), "v").count() == 0


def test_findings_beyond_ascii_are_ranked_by_their_json(spark):
    words = ["épanchement", 'q"uote', "back\\slash", "line\nbreak", "😀", "opacity"]
    a = frame(spark, [ev("p", f"i{k}", w, "yes") for k, w in enumerate(words)])
    got = {(r["image_id"], r["label_name"]) for r in items.g1_missing(a, 2).collect()}
    rank = lambda i, w: hashlib.sha1(json.dumps({"finding": w, "image": i}, sort_keys=True).encode()).hexdigest()[:16]
    want = {(f"i{k}", x) for k, w in enumerate(words) for x in sorted((x for x in words if x != w), key=lambda x: rank(f"i{k}", x))[:2]}
    assert got == want


def test_sources_that_miss_each_other(spark):
    """Keys of one source alone, and images without metadata; the driver's tables hold none."""
    left, right = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "k int, a int"), spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0)], "k int, b int")
    got = {r["k"]: r["status"] for r in audit.cross_source(left, right, "k", "a", "b").collect()}
    assert got == {1: "agree", 2: "disagree", 3: "uncertain", 4: "missing_left"}
    assert {r["k"]: r["status"] for r in audit.cross_source(right, left.where("k < 3"), "k", "b", "a").collect()}[4] == "missing_right"
    boxes = frame(spark, [{"bbox_name": n, "x1": 0.0, "y1": 0.0, "x2": 2.0, "y2": 2.0} for n in "abc"], schemas.OBJECTS)
    assert audit.overlapping_boxes(boxes).count() == 0  # rows without an image don't meet


def test_scratch_needs_a_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "/w/"}.get(key, default)

    class Context:
        master = "spark://host:7077"
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(ValueError):
        scratch.scratch_dir(session)
    session.sparkContext.master = "local[2]"
    assert scratch.scratch_dir(session) == "/w/_scratch" == session.sparkContext.folder
    table = scratch.materialize(spark.range(3))
    assert table.count() == 3
    scratch.discard(table)
    with pytest.raises(Exception, match="(?i)not exist|no such file"):
        spark.read.parquet(table._quillon_path)
    with scratch.temporary(spark) as kept:
        gone, stays = scratch.materialize(spark.range(2)), scratch.materialize(spark.range(5), 5)
        kept.append(stays)
    assert stays.count() == 5 and stays.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="(?i)not exist|no such file"):
        spark.read.parquet(gone._quillon_path)


@pytest.mark.parametrize("f", [0, 1, 0.0001, 0.9999])
def test_degenerate_fractions(f):
    with pytest.raises(ValueError):
        sampling.quotas(5, 5, f)


def test_image_index(spark, small):
    a, o, _ = small
    index = linking.image_index(o, a)
    assert index.count() == 7 and index.where("image_id = ''").count() == 1  # the empty id stays, nulls would go
    s = linking.image_index_summary(index).first()
    assert (s[0], s[1], s[2], s[3]) == (7, 0, 7, 0)


def test_linking(spark, tmp_path):
    need = spark.createDataFrame([("100", "s1", "a", "a"), ("100", "s9", "b", "b"), ("100", "s1", "c", "c")], "patient_id string, study_id string, image_id string, dicom_id string")
    (tmp_path / "m.csv").write_text("subject_id,study_id,dicom_id\n100,s1,a\n100,s2,b\n")
    (tmp_path / "s.csv").write_text("subject_id,study_id,dicom_id,split\n100,s1,a,test\n")
    links = linking.classify_links(need, tables.read_metadata(spark, str(tmp_path / "m.csv"), str(tmp_path / "s.csv")), "root/", "http://x/")
    got = {r["dicom_id"]: r for r in links.collect()}
    assert [got[k]["link_status"] for k in "abc"] == ["matched", "id_mismatch", "missing_metadata"]
    assert got["a"]["image_path"] == "root/p10/p100/ss1/a.jpg" and got["a"]["split"] == "test"
    assert tuple(linking.link_summary(links).first()) == (3, 1, 1, 1)
    assert linking.needed_images([need, need]).count() == 3
    assert [r["download_status"] for r in linking.download_manifest(links).collect()] == ["dry_run"]

    def fail(url, path, **options):
        raise OSError(url)

    failed = linking.download_manifest(links, dry_run=False, fetch=fail)
    assert [r["download_status"] for r in failed.collect()] == ["failed"]
    done = linking.download_manifest(links, dry_run=False, fetch=lambda u, p, **options: None)
    assert [r["download_status"] for r in done.collect()] == ["downloaded"]
    there = linking.download_manifest(links, exists=lambda p: True)
    local = linking.download_manifest(links, link_only_existing=True)
    again = linking.download_manifest(links, exists=lambda p: True, overwrite=True)
    assert [m.first()["download_status"] for m in (there, local, again)] == ["existing", "missing_local", "dry_run"]
    assert linking.download_summary(failed.unionByName(done).unionByName(there).unionByName(local)).first().asDict() == {"manifest_rows": 4, "downloaded_files": 1, "existing_files": 1, "missing_local_files": 1, "dry_run_files": 0, "failed_files": 1}
    with pytest.raises(ValueError):
        linking.download_manifest(links, dry_run=False)
    things = frame(spark, [{"item_id": k, "patient_id": "100", "study_id": "s1", "dicom_id": k} for k in "ac"], schemas.ITEMS)
    for manifest, want in ((failed, (0, 2)), (done, (1, 1)), (there, (1, 1)), (local, (0, 2))):
        linked, s = linking.link_items(things, linking.available_links(manifest))
        assert (linked.count(), s.first()["excluded_missing_link"]) == want
    sinks.write_url_list(links, str(tmp_path / "urls"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "urls")).collect()] == ["http://x/p10/p100/ss1/a.jpg"]


def linked_items(spark):
    base = {"granularity": "G1", "question_type": "q", "target_finding": "t", "evidence_sources": ["E"]}
    rows = [{"item_id": "1", "image_path": "a", "question": "Q1?", "answer_label": "Yes", "hallucination_probe": "H1"}, {"item_id": "2", "image_path": "b", "question": "Q2?", "answer_label": "Unsupported", "hallucination_probe": "H2"}, {"item_id": "3", "question": "Q3?", "answer_label": "No", "hallucination_probe": "H1"}]
    return frame(spark, [base | r for r in rows], schemas.ITEMS)


def test_prompts_and_mocks(spark):
    inputs, meta, summary = prompts.prompt_layers(linked_items(spark))
    assert inputs.columns == ["item_id", "image_path", "prompt_template_id", "prompt"] and tuple(summary.first()) == (3, 2, 2, 1, 0)
    got = {r["item_id"]: r for r in inputs.collect()}
    assert got["1"]["prompt"].endswith("Yes, No, or Uncertain. Question: Q1?") and got["2"]["prompt_template_id"] == text.SUPPORT_ID
    scored = scoring.score_responses(scoring.parse_responses(prompts.mock_responses(inputs, meta, "oracle")))
    assert scoring.summarize(scored).where("group_type = 'overall'").first()["accuracy"] == 1.0
    said = {m: [r["raw_response"] for r in prompts.mock_responses(inputs, meta, m).orderBy("item_id").collect()] for m in prompts.MODES}
    assert said["alternating"] == ["Yes", "Unsupported"] and said["always_no"] == ["No", "No"] and said["invalid"] == [prompts.INVALID_TEXT] * 2
    with pytest.raises(ValueError):
        prompts.mock_responses(inputs, None, "oracle")
    with pytest.raises(ValueError):
        prompts.mock_responses(inputs, meta, "other")


def test_dry_run_and_runner(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x")
    inputs, meta, _ = prompts.prompt_layers(linked_items(spark))
    rows = prompts.dry_run(inputs, meta.limit(0).unionByName(meta.where("item_id = '1'")), tables.list_images(spark, str(tmp_path)), str(tmp_path))
    assert tuple(prompts.dry_run_summary(rows).first()) == (2, 1, 0, 1, 1)

    class Echo:
        def generate(self, image_path, question, **options):
            if image_path.endswith("b"):
                raise RuntimeError("no image " + "x" * 900)
            return " Yes. "

    out = {r["item_id"]: r for r in prompts.run_model(inputs, meta, Echo, "echo", root="/r").collect()}
    assert out["1"]["raw_response"] == "Yes." and out["1"]["answer_label"] == "Yes" and out["1"]["runtime"]["status"] == "success"
    assert (out["2"]["raw_response"], out["2"]["runtime"]["error_type"], len(out["2"]["runtime"]["error_message"])) == ("", "RuntimeError", 500)
    with pytest.raises(ValueError):
        prompts.run_model(inputs, meta, Echo, "echo", batch_size=2)


CASES = [
    ("Yes", "Yes", "success"), ("No.", "No", "success"), ("Uncertain", "Uncertain", "success"), ("Supported", "Supported", "success"), ("Unsupported", "Unsupported", "success"), ("Yes or No", None, "multiple_answers"),
    ("maybe", None, "invalid_format"), ("", None, "empty_response"), (None, None, "empty_response"), ("\xa0 　\x1c", None, "empty_response"), ("yes, YES", "Yes", "success"), ("éyes", None, "invalid_format"), ("yes_", None, "invalid_format"),
    ("yes-no", None, "multiple_answers"), ("Not supported", "Supported", "success"), ("yeſ", None, "invalid_format"),
]


def test_answers(spark):
    got = scoring.parse_responses(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw_response string")).orderBy("i").collect()
    assert [(r["raw_response"], r["parsed_answer"], r["parse_status"]) for r in got] == CASES


def test_decision_table_and_summary(spark):
    labels = [*schemas.ANSWERS, None, "A"]
    rows = [{"item_id": f"{a}{b}", "answer_label": a, "parsed_answer": b, "parse_status": "success", "granularity": "G1" if b == "Yes" else None} for a in labels for b in schemas.ANSWERS]
    rows += [{"item_id": "x", "answer_label": "Yes", "parsed_answer": "Yes", "parse_status": None}, {"item_id": "y", "answer_label": "Yes", "parsed_answer": None, "parse_status": "success"}]
    scored = scoring.score_responses(frame(spark, rows, schemas.RESPONSES))
    got = {r["item_id"]: r for r in scored.collect()}
    assert got["x"]["score"] == got["y"]["score"] == "invalid_response" and got["x"]["is_correct"] is False
    assert (got["UnsupportedUnsupported"]["evidence_relation"], got["YesYes"]["evidence_relation"]) == ("S0_unsupported", "S2_directly_supported")
    assert (got["NoYes"]["h1_error_direction"], got["YesNo"]["h1_error_direction"], got["UnsupportedSupported"]["hallucination_type"]) == ("false_positive", "false_negative", "H2")
    assert (got["SupportedUnsupported"]["error_category"], got["UncertainYes"]["error_category"]) == ("unsupported_rejection", "uncertain_case")
    assert got["YesSupported"]["requires_manual_review"] and got["YesSupported"]["is_correct"] is None and got["NoneYes"]["score"] == "requires_manual_review"
    out = scoring.summary_dict(scoring.summarize(scored))
    assert out["overall"]["items"] == 37 and set(out["by_granularity"]) == {"G1", "None"} and "None" in out["by_answer_label"]
    empty = scoring.summary_dict(scoring.summarize(scored.limit(0)))
    assert empty["overall"]["items"] == 0 and empty["overall"]["accuracy"] is None and empty["by_granularity"] == {}


def test_report(tmp_path):
    m = {k: 0 for k in scoring.METRICS} | {"items": 10, "scored_items": 10, "correct": 6, "accuracy": 0.6, "h1_count": 1, "h2_count": 2, "uncertain_or_abstention_count": 1}
    sinks.write_json(str(tmp_path / "r.json"), {"overall": m, "by_hallucination_probe": {"H2": m, "H1": {"items": 0}}})
    rows = report.flatten([str(tmp_path / "r.json")])
    assert [(r["run_name"], r["group"]) for r in rows] == [("r", "overall"), ("r", "H1"), ("r", "H2")] and (rows[0]["h1_rate"], rows[0]["h2_rate"], rows[0]["invalid_rate"], rows[0]["abstention_rate"]) == (0.1, 0.2, 0.0, 0.1)
    assert rows[1]["h1_rate"] is None and rows[1]["accuracy"] is None and rows[1]["h1_count"] == 0
    overall, group = report.write_tables(rows, str(tmp_path))
    assert overall.read_bytes().count(b"\r\n") == 2 and len(group.read_text().splitlines()) == 3 and ",0.1,0.2,0.0,0.1" in overall.read_text()
    assert [(n, len(r), f) for n, r, f, _ in report.charts(rows)] == [
        ("accuracy_by_probe", 2, ["accuracy"]), ("h_counts_by_probe", 2, ["h1_count", "h2_count"]), ("overall_accuracy", 1, ["accuracy"]), ("overall_h_rates", 1, ["h1_rate", "h2_rate"]),
        ("h1_direction_counts", 1, ["h1_false_positive_count", "h1_false_negative_count"]),
    ]
    assert report.charts([]) == []
    with pytest.raises(ValueError):
        report.flatten([str(tmp_path / "r.json")], ["a", "b"])


def test_sinks(spark, tmp_path):
    sinks.update_summary(str(tmp_path / "s.json"), "b", {"n": 1})
    sinks.update_summary(str(tmp_path / "s.json"), "a", {"n": 2})
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": {"n": 2}, "b": {"n": 1}}
    sinks.write_jsonl(spark.createDataFrame([("é", None)], "b string, a int"), str(tmp_path / "j"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":null,"b":"é"}']
    nested = spark.createDataFrame([((1, [("y", None)], None), None)], "z struct<b:int,a:array<struct<d:string,c:int>>,c:struct<f:int,e:int>>, a struct<z:int,y:int>")
    sinks.write_jsonl(nested, str(tmp_path / "n"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "n")).collect()] == ['{"a":null,"z":{"a":[{"c":null,"d":"y"}],"b":1,"c":null}}']
    sinks.write_csv_rows([], str(tmp_path / "e.csv"), ["x", "y"])
    assert (tmp_path / "e.csv").read_bytes() == b"x,y\r\n"
    sinks.write_parquet(spark.createDataFrame([], schemas.ITEMS), str(tmp_path / "p"))
    assert tables.read_parquet(spark, str(tmp_path / "p"), schemas.ITEMS, ["item_id"]).columns == ["item_id"]


def test_extensions(spark):
    boxes = frame(spark, [{"image_id": "i", "bbox_name": n, "x1": x, "y1": 0.0, "x2": x + 2, "y2": 2.0} for n, x in (("a", 0.0), ("b", 1.0), ("c", 9.0))], schemas.OBJECTS)
    assert {(r["bbox_a"], r["bbox_b"]): round(r["iou"], 4) for r in audit.overlapping_boxes(boxes).collect()} == {("a", "b"): 0.3333, ("a", "c"): 0.0, ("b", "c"): 0.0}
    a = frame(spark, [ev("p", "i", "edema", "yes", "l", phrase="mild edema", severity_cues=["severity|yes|mild"]), ev("p", "i", "edema", "no", "r"), ev("p", "i", "edema", "no", "q")])
    assert sorted(r["distractor"] for r in audit.contrast_pairs(a).collect()) == ["q", "r"]
    assert [(r["answer"], r["choices"]) for r in audit.choice_items(a).collect()] == [("l", ["l", "q", "r"])]
    assert [r["cue"] for r in audit.modifier_items(a).collect()] == ["severity|yes|mild"]
    ent = spark.createDataFrame([("r", {"1": ("effusion", "OBS-DP", [["located_at", "2"]]), "2": ("lung", "ANAT-DP", [])})], "report_id string, entities map<string,struct<tokens:string,label:string,relations:array<array<string>>>>")
    e, rel = audit.normalize_radgraph(ent)
    assert {r["tokens"]: r["answer"] for r in e.collect()} == {"effusion": "Yes", "lung": None} and rel.first()["target_tokens"] == "lung"
    assert {r["label"]: r["located_at"] for r in audit.radgraph_audit(e, rel).collect()} == {"OBS-DP": 1, "ANAT-DP": 0}


def test_audits_and_rules(spark, small):
    a, o, _ = small
    row = audit.evidence_audit(a, o, spark.range(2)).first().asDict()
    assert (row["yes"], row["no"], row["uncertain"], row["conflict_groups"], row["objects"], row["boxes"], row["files"], row["labels_with_phrase"]) == (4, 2, 1, 1, 3, 0, 2, 7)
    assert {(r["category"], r["polarity"]): r["n"] for r in audit.label_distribution(a).collect()} == {("anatomicalfinding", "yes"): 4, ("anatomicalfinding", "no"): 2, ("anatomicalfinding", "maybe"): 1}
    row = audit.candidate_counts(a, o).first().asDict()
    assert (row["g1_valid"], row["g1_conflicting"], row["g2_valid"], row["g2_conflicting"], row["g2_without_box"], row["uncertain"]) == (3, 1, 2, 1, 1, 1)
    ent = spark.createDataFrame([("r1", {"1": ("effusion", "OBS-DP", []), "2": ("lung", "ANAT-DP", [])}), ("r2", {"1": ("effusion", "OBS-U", [])})], "report_id string, entities map<string,struct<tokens:string,label:string,relations:array<array<string>>>>")
    e, _ = audit.normalize_radgraph(ent)
    known = spark.createDataFrame([("r1",), ("r9",)], "study_id string")
    row = audit.radgraph_counts(e, ent, known, known.limit(0)).first().asDict()
    assert (row["studies"], row["in_images"], row["in_evidence"], row["OBS-DP"], row["OBS-U"], row["ANAT-DP"], row["entities"]) == (2, 1, 0, 1, 1, 1, 3)
    assert [tuple(r) for r in audit.top_entities(e, False).collect()] == [("effusion", 2)] and [r[0] for r in audit.top_entities(e, True).collect()] == ["lung"]


def test_counts_of_candidates_make_no_pairs(spark):
    sides = [("a", "yes"), ("b", "yes"), ("c", "no"), ("d", "no"), ("e", "no"), ("f", "yes"), ("f", "no")]
    a = frame(spark, [ev("p", "i", "edema", v, b) for b, v in sides] + [ev(None, "j", "edema", "yes", "a"), ev("p", "j", "edema", "no", "a")])
    o = frame(spark, [{"patient_id": p, "study_id": "s", "image_id": i, "bbox_name": "a", "x1": x} for p, i, x in (("p", "i", 1.0), ("p", "i", 2.0), (None, "j", 3.0))], schemas.OBJECTS)
    got = audit.candidate_counts(a, o)
    row = got.first().asDict()
    assert row["g3a_pairs"] == audit.contrast_pairs(a).count() == 7 and (row["g2_valid"], row["g2_conflicting"], row["g2_without_box"]) == (2, 1, 5)
    assert "min_by" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_rules_of_items(spark, small):
    a, o, index = small
    built = [items.build_g1_h1(a, index), items.build_g2_h1(a, o, index), items.build_g1_h2(a, index, balance_h2=False)[0], items.build_g2_h2(a, o, index, balance_h2=False)[0]]
    for b in built:
        assert audit.schema_violations(b).count() == 0
    g2 = built[1]
    breaks = {
        "missing_as_negative": {"answer_label": F.lit("No")}, "state_as_answer": {"answer_label": F.lit("Conflict")}, "box_of_other_anatomy": {"target_anatomy": F.lit("heart")}, "g2_without_box": {"bbox": F.lit(None).cast(g2.schema["bbox"].dataType)},
        "unbound_source_of_g2": {"source_assertions": F.transform("source_assertions", lambda x: x.withField("bbox_name", F.lit(None).cast("string")))}, "source_is_no_finding": {"source_assertions": F.transform("source_assertions", lambda x: x.withField("category", F.lit("nlp")))},
        "conflicting_sources": {"source_assertions": F.concat("source_assertions", F.transform("source_assertions", lambda x: x.withField("polarity", F.lit("no"))))}, "negated_modifier": {"granularity": F.lit("G3b"), "source_assertions": F.transform("source_assertions", lambda x: x.withField("polarity", F.lit("no")))},
        "contrast_without_distractor": {"granularity": F.lit("G3a"), "evidence_sources": F.array(F.lit("E1_bbox"))}, "valid_for_training": {"valid_for_training": F.lit(True)},
    }
    for rule, change in breaks.items():
        assert rule in {r["rule"] for r in audit.schema_violations(g2.withColumns(change)).collect()}, rule
    assert {r["rule"] for r in audit.schema_violations(built[3].where("answer_label = 'Unsupported'").withColumn("answer_label", F.lit("No"))).collect()} >= {"constructed_as_negative"}
    scored = frame(spark, [{"item_id": "a", "granularity": "G1", "question_type": "q", "answer_label": "Yes", "score": "correct"}, {"item_id": "b", "score": "invalid_response", "granularity": "G1", "question_type": "q", "answer_label": "Yes"}], schemas.SCORED)
    assert [tuple(r) for r in audit.scored_violations(scored).collect()] == [("a", "lost_parsed_answer")]


class EchoModel:
    def __init__(self, model_path, device, dtype):
        self.said = f"Yes {model_path} {device} {models.dtype_name(dtype)}"

    def __call__(self):
        return self

    def generate(self, image_path, question, **options):
        return self.said


def test_models_and_images(spark, tmp_path):
    assert [models.dtype_name(d) for d in ("bfloat16", "float16", "float32", "other")] == ["bfloat16", "float16", "float32", "float32"]
    (tmp_path / "im").mkdir()
    (tmp_path / "im/a.png").write_bytes(b"xy")
    scan = tables.list_images(spark, str(tmp_path / "im"))
    assert tuple(models.decoded(scan, lambda b: (len(b), 1, b * 3)).first())[1:4] == (2, 1, b"xyxyxy")
    bad = models.decoded(scan).first()
    assert bad["rgb"] is None and bad["error"]
    with pytest.raises(ValueError):
        models.loader("no.such:thing", "", "cpu", "float32")
    values = spark.createDataFrame([(True, 3, None)], "b boolean, i int, s string").select(*(text.string_or_null(F.col(c), t) for c, t in (("b", "boolean"), ("i", "int"), ("s", "string"))))
    assert tuple(values.first()) == ("True", "3", None)


def test_stream(spark, tmp_path):
    inputs, meta, _ = prompts.prompt_layers(linked_items(spark))
    sinks.write_jsonl(prompts.mock_responses(inputs, meta, "always_yes"), str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_command_lines(spark, folder, tmp_path):
    d = str(tmp_path)
    run = lambda *a: cli.main(list(a), spark)
    assert run("parse_chest_imagenome", "--input", folder, "--output", d)["files_seen"] == 2
    obj, att = f"{d}/ci_objects.parquet", f"{d}/ci_attribute_assertions.parquet"
    assert run("link_mimic_images", "--objects", obj, "--attributes", att, "--output", f"{d}/ix", "--summary", f"{d}/ix.json")["image_index_rows"] == 1
    assert run("build_g1_items", "--input", att, "--image-index", f"{d}/ix", "--h1-output", f"{d}/h1", "--h2-output", f"{d}/h2", "--summary", f"{d}/s.json")["no_items"] == 2
    assert run("build_g2_items", "--attributes", att, "--objects", obj, "--image-index", f"{d}/ix", "--h1-output", f"{d}/g1", "--h2-output", f"{d}/g2", "--summary", f"{d}/s.json")["items_written"] == 2
    assert run("build_prompts", "--input", f"{d}/h1", "--model-inputs-output", f"{d}/mi", "--eval-metadata-output", f"{d}/em")["skipped_missing_image_path"] == 2
    sinks.write_jsonl(linked_items(spark), f"{d}/li")
    run("build_prompts", "--input", f"{d}/li", "--model-inputs-output", f"{d}/mi", "--eval-metadata-output", f"{d}/em")
    assert run("batch_infer", "--input", f"{d}/mi", "--output", f"{d}/raw", "--eval-metadata", f"{d}/em")["rows"] == 2
    assert run("parse_answer", "--input", f"{d}/raw", "--output", f"{d}/pa") == {"success": 2}
    assert run("score_closed_qa", "--input", f"{d}/pa", "--output", f"{d}/sc", "--summary", f"{d}/sum.json")["accuracy"] == 1.0
    assert run("metrics", "--inputs", f"{d}/sc", "--output", f"{d}/all.json")["items"] == 2
    assert run("visualize_results", "--inputs", f"{d}/sum.json", "--output-dir", d, "--no-figures")["rows"] >= 3
    assert run("medgemma_runner", "--input", f"{d}/mi", "--eval-metadata", f"{d}/em", "--output", f"{d}/dry", "--dry-run")["prompt_records"] == 2
    with pytest.raises(SystemExit):
        run("batch_infer", "--input", f"{d}/mi", "--output", f"{d}/raw2")
    assert run("batch_infer", "--input", f"{d}/mi", "--output", f"{d}/alt", "--eval-metadata", f"{d}/em", "--mode", "alternating")["rows"] == 2
    order = [r["item_id"] for r in tables.read_jsonl(spark, f"{d}/mi", schemas.MODEL_INPUTS).orderBy("_ord").collect()]
    said = {r["item_id"]: r["runtime"]["row_index"] for r in tables.read_jsonl(spark, f"{d}/alt", schemas.RESPONSES).collect()}
    assert sorted(order, key=said.get) == order
    model = ("medgemma_runner", "--input", f"{d}/mi", "--eval-metadata", f"{d}/em", "--output", f"{d}/mo", "--model-path", "m", "--device", "cpu", "--dtype", "float16")
    assert run(*model, "--loader", "tests.test_pipeline_stages:EchoModel") == {"success": 2, "failed": 0, "outputs": 2}
    assert spark.read.schema(schemas.RESPONSES).json(f"{d}/mo").first()["raw_response"] == "Yes m cpu float16"
    with pytest.raises(SystemExit):
        run(*model, "--loader", "tests.none:x")
    (tmp_path / "m.csv").write_text("subject_id,study_id,dicom_id\n100,s1,a\n")
    sinks.write_jsonl(frame(spark, [{"item_id": k, "patient_id": "100", "study_id": "s1", "image_id": k, "dicom_id": k} for k in "ac"], schemas.ITEMS), f"{d}/split")
    link = ("link_and_download", "--metadata", f"{d}/m.csv", "--files-root", f"{d}/files", "--output-dir", f"{d}/links", "--inputs", f"{d}/split", "--base-url", "http://x")
    out = run(*link, "--dry-run")
    assert (out["matched_metadata_rows"], out["missing_metadata"], out["dry_run_files"], out["split"]["excluded_missing_link"]) == (1, 1, 1, 2)
    (tmp_path / "files/p10/p100/ss1").mkdir(parents=True)
    (tmp_path / "files/p10/p100/ss1/a.jpg").write_bytes(b"x")
    out = run(*link, "--link-only-existing")
    assert (out["existing_files"], out["split"]["linked_items"], out["split"]["excluded_missing_link"]) == (1, 1, 1)


# --- report graphs


@pytest.mark.parametrize("size", [60, 1000, 1 << 20])
def test_members_equal_a_parser_of_the_whole_file(spark, tmp_path, size):
    hard = {"a}": {"x": "}{\\", "y": ['"', "]", "é}😀"], "z": {}}, "b": 5, "c": [1, {"d": "}"}], "": {"deep": {"deeper": {"x": [[], [{}]]}}}, "e": "only } text", "f": None, 'q"}': {"t": 'say "}" \\'}}
    many = {f"p{i}": {"text": "x } \\ \" " * (i % 5), "entities": {str(k): {"tokens": "t", "label": "OBS-DP", "relations": [["modify", str(k + 1)]]} for k in range(i % 4)}} for i in range(80)}
    files = {"hard": json.dumps(hard), "pretty": json.dumps(many, indent=2), "plain": json.dumps(many), "none": "{}", "space": " \n", "one": '{"a": 1}', "ascii": json.dumps(hard, ensure_ascii=False) + "\n"}
    files["twice"] = '{"k": {"v": 1}, "m": {}, "k": {"v": 2}}'
    for name, t in files.items():
        (tmp_path / f"{name}.json").write_text(t, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = members.read_members(spark, str(tmp_path)).select("file", "key", F.to_json("value").alias("v")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, t in files.items():
        assert {r["key"]: json.loads(r["v"]) for r in got if r["file"].endswith(f"/{name}.json")} == (json.loads(t) if t.strip() else {}), name


def test_reports_to_findings(spark, tmp_path):
    entity = lambda tokens, label, *relations: {"tokens": tokens, "label": label, "relations": [list(r) for r in relations]}
    reports = {
        "r1": {"text": "t", "entities": {
            "1": entity("Pleural effusion", "OBS-DP", ("located_at", "2")), "2": entity("lung", "ANAT-DP"), "3": entity("left", "ANAT-DP", ("modify", "2")), "4": entity("small", "OBS-DP", ("modify", "1")),
            "5": entity("very", "OBS-DP", ("modify", "4")), "6": entity("odd", "OBS-U", ("modify", "7")), "7": entity("odder", "OBS-U", ("modify", "6"), ("modify", "7"), ("modify", "99")),
        }},
        "r2": {"text": None, "entities": {}}, "r3": {"text": "no entities"},
    }
    (tmp_path / "g.json").write_text(json.dumps(reports), encoding="utf-8")
    read = members.read_reports(spark, str(tmp_path / "g.json"))
    assert {r["report_id"] for r in read.collect()} == {"r1", "r2", "r3"}
    e, r = audit.normalize_radgraph(read)
    support = {(x["finding_id"], x["modifier_id"]): x["steps"] for x in graphs.modifier_support(e, r).collect()}
    assert support == {("1", "4"): 1, ("1", "5"): 2, ("4", "5"): 1, ("6", "7"): 1, ("7", "6"): 1}
    assert {(x["finding_id"], x["anatomy_id"], x["steps"]) for x in graphs.located_findings(e, r).collect()} == {("1", "2", 1), ("1", "3", 2)}
    assert graphs.walks(spark.createDataFrame([("r", str(i), str(i + 1)) for i in range(6)], "report_id string, source_id string, target_id string"), 3).count() == 6 + 5 + 4


def shuffles(df):
    return len(re.findall(r"(?<!Broadcast)Exchange \(", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))))


def test_small_files_and_their_relations_take_no_shuffle(spark, tmp_path):
    reports = {f"r{i}": {"text": "}", "entities": {"1": {"tokens": "a", "label": "OBS-DP", "relations": [["modify", "2"], ["modify", "9"], ["no such", "2"], []]}, "2": {"tokens": "b", "label": "ANAT-DP"}}} for i in range(3)}
    (tmp_path / "g.json").write_text(json.dumps(reports), encoding="utf-8")
    e, r = audit.normalize_radgraph(members.read_reports(spark, str(tmp_path)))
    assert shuffles(e) == shuffles(r) == 0 and "Join" not in r._jdf.queryExecution().toString()
    assert {(x["report_id"], x["entity_id"], x["n_relations"]) for x in e.collect()} == {(f"r{i}", k, n) for i in range(3) for k, n in (("1", 2), ("2", 0))}
    assert {tuple(x) for x in r.where("report_id = 'r1'").collect()} == {("r1", "1", "modify", "2", "b"), ("r1", "1", "modify", "9", None)}
    assert shuffles(members.read_reports(spark, str(tmp_path))) == 0


def test_members_of_compressed_and_odd_files(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "z.json.gz", "wt") as f:
        f.write('{"a": {"x": "}"}, "b": {"y": 1}}')
    (tmp_path / "twice.json").write_text('{"k": {"v": 1}, "k": {"v": 2}}')
    (tmp_path / "fine.json").write_text('{"m": {"v": 3}, "n": [1]}')
    got = {(r["file"].rsplit("/", 1)[1], r["key"], r["v"]) for r in members.read_members(spark, str(tmp_path)).select("file", "key", F.to_json("value").alias("v")).collect()}
    assert got == {("z.json.gz", "a", '{"x":"}"}'), ("z.json.gz", "b", '{"y":1}'), ("twice.json", "k", '{"v":2}'), ("fine.json", "m", '{"v":3}'), ("fine.json", "n", "[1]")}


@pytest.mark.parametrize("row_edges", [0, 12, 256])
def test_walks_against_brute_force(spark, monkeypatch, row_edges):
    """Usual reports are walked without a round of joins, larger ones by rounds, with the same results."""
    monkeypatch.setattr(graphs, "ROW_EDGES", row_edges)
    if row_edges == 256:
        monkeypatch.setattr(graphs, "_rounds", None)
    rng = random.Random(3)
    edges = [(f"r{r}", str(rng.randrange(8)), str(rng.randrange(8))) for r in range(12) for _ in range(2 * r)] + [("r1", None, "2"), (None, "1", "2"), ("r2", "1", None)]
    edges += edges[:30]
    want = {}
    for r, s in {(r, s) for r, s, t in edges if r and s and t}:
        near, at = {s: 0}, [s]
        for x in at:
            for t in {t for q, y, t in edges if q == r and y == x and t} - near.keys():
                near[t] = near[x] + 1
                at.append(t)
        want |= {(r, s, t): k for t, k in near.items() if 0 < k <= 3}
    got = graphs.walks(spark.createDataFrame(edges, "report_id string, source_id string, target_id string"), 3).collect()
    assert len(got) == len(want) and {tuple(x)[:3]: x["steps"] for x in got} == want


def test_names_in_texts_against_brute_force(spark):
    rng = random.Random(6)
    words = ["lung", "left", "opacity", "é", "of", "x1"]
    names = ["lung opacity", "Opacity", "left lung", "left lung opacity", "lung-opacity", "of", "", None, "é é", "never here at all"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(200)] + [None, "", "LEFT, lung! opacity", "left lung left lung opacity"]

    def plain(text):
        w = [x for x in re.split(r"[^\w]+", (text or "").lower()) if x]
        by = {}
        for n in names:
            key = tuple(x for x in re.split(r"[^\w]+", (n or "").lower()) if x)
            if key:
                by.setdefault(key, set()).add(n)
        out, i = set(), 0
        while i < len(w):
            hit = next((m for m in range(len(w) - i, 0, -1) if tuple(w[i : i + m]) in by), 0)
            out |= by[tuple(w[i : i + hit])] if hit else set()
            i += hit or 1
        return {(text, n) for n in out}

    e = spark.createDataFrame([(t,) for t in texts], "tokens string")
    got = graphs.named_findings(e, spark.createDataFrame([(n,) for n in names], "label_name string"), ["tokens"])
    assert {tuple(r) for r in got.collect()} == set().union(*map(plain, texts))
    assert graphs.named_findings(e, spark.createDataFrame([], "label_name string"), ["tokens"]).count() == 0


def test_consistency_of_findings(spark):
    a = frame(spark, [ev("p", "i", label, polarity) for label, polarity in (("Agree", "yes"), ("differ", "no"), ("both", "yes"), ("both", "no"), ("unsure", "yes"), ("image only", "no"))])
    said = [("s", "agree", "Yes"), ("s", "differ", "Yes"), ("s", "both", "Yes"), ("s", "unsure", "Uncertain"), ("s", "report only", "No"), ("s", "report both", "Yes"), ("s", "report both", "No"), ("s", None, "No"), (None, "agree", "No"), ("s", "agree", "Uncertain")]
    got = graphs.finding_consistency(a, spark.createDataFrame(said, "study_id string, finding string, answer string")).collect()
    assert {r["finding"]: r["status"] for r in got} == {"agree": "agree", "differ": "disagree", "both": "conflict", "unsure": "uncertain", "image only": "missing_report", "report only": "missing_image", "report both": "conflict"}


# --- models, downloads and streams that are interrupted


def test_a_process_loads_its_model_once(spark, tmp_path):
    folder = str(tmp_path)

    class Model:
        def generate(self, image_path, question, **options):
            import os
            import pathlib
            import time

            time.sleep(0.02)
            pathlib.Path(folder, f"used-{os.getpid()}").touch()
            return "Yes"

    def load():
        import os
        import pathlib
        import uuid

        pathlib.Path(folder, f"load-{os.getpid()}-{uuid.uuid4().hex}").touch()
        return Model()

    inputs = spark.range(160).select(F.col("id").cast("string").alias("item_id"), F.lit("p").alias("image_path"), F.lit("t").alias("prompt_template_id"), F.lit("q").alias("prompt"))
    meta = frame(spark, [], schemas.EVAL_METADATA)
    for _ in range(2):
        out = prompts.run_model(inputs, meta, load, "m", tasks=16)
        assert out.where("raw_response = 'Yes'").count() == 160
    loads, used = [p.name.split("-")[1] for p in tmp_path.glob("load-*")], {p.name.split("-")[1] for p in tmp_path.glob("used-*")}
    assert sorted(loads) == sorted(used) and 1 <= len(used) <= 8  # 32 tasks in the processes of 4 cores
    assert models.runner_key(load, 1) == models.runner_key(load, 1) != models.runner_key(load, 2)


def test_a_download_goes_on_where_it_was_killed(spark, tmp_path):
    links = spark.range(40).select(*(F.lit("x").alias(c) for c in ("patient_id", "study_id", "dicom_id", "image_id", "split")), F.format_string(f"{tmp_path}/img/%03d.jpg", "id").alias("image_path"), F.format_string("u%03d", "id").alias("source_url"), F.lit("matched").alias("link_status"))
    links = links.withColumn("image_id", F.col("source_url")).coalesce(2)
    folder = str(tmp_path)

    def fetch(url, path, timeout_seconds, credentials):
        import io
        import os
        import pathlib

        kill = pathlib.Path(folder, "killed")
        if url == "u013" and not kill.exists():
            kill.touch()
            os._exit(1)
        with open(pathlib.Path(folder, f"count-{url}"), "a") as f:
            f.write("x")
        storage.write_stream(path, io.BytesIO(url.encode()))

    def run(run_id, **options):
        m = linking.download_manifest(links, dry_run=False, fetch=fetch, log=f"{folder}/log", run_id=run_id, **options)
        return sorted({r["download_status"] for r in m.collect()})

    with pytest.raises(Exception, match="(?i)worker|job aborted"):
        run("one")
    assert run("one") == ["downloaded"] and (tmp_path / "img/013.jpg").read_text() == "u013"
    assert {p.name: p.read_text() for p in tmp_path.glob("count-*")} == {f"count-u{k:03d}": "x" for k in range(40)}
    assert run("two") == ["existing"]
    assert run("three", overwrite=True) == ["downloaded"] == run("three", overwrite=True)
    assert {p.read_text() for p in tmp_path.glob("count-*")} == {"xx"} and not list(tmp_path.rglob("*.part"))
    assert storage.exists(f"file://{folder}/img/001.jpg") and not storage.exists(f"{folder}/img") and storage.read_bytes(f"{folder}/none") is None


def test_running_summary_equals_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [{"item_id": f"i{k}" if k % 17 else None, "model_name": f"m{k}", "raw_response": rng.choice(["Yes", "No", "Supported", "maybe", "", "Uncertain"])} for k in range(90)]
    meta = frame(spark, [{"item_id": f"i{k}", "answer_label": rng.choice(schemas.ANSWERS), "granularity": rng.choice(["G1", "G2", None]), "hallucination_probe": rng.choice(["H1", "H2"])} for k in range(80)], schemas.EVAL_METADATA)
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows[:40], rows[20:70], rows[10:])):  # rows that were there before come again
        (tmp_path / f"in/{k}.json").write_text("\n".join(map(json.dumps, part)), encoding="utf-8")
        summary_stream(spark, str(tmp_path / "in"), str(tmp_path / "s.json"), str(tmp_path / "ck"), meta).awaitTermination(300)  # each a restart
        seen = rows[: (40, 70, 90)[k]]
        labelled = prompts.with_metadata(frame(spark, seen, schemas.RESPONSES).drop(*prompts.META), meta)
        want = scoring.summary_dict(scoring.summarize(scoring.score_responses(scoring.parse_responses(labelled))))
        assert tables.read_summary(str(tmp_path / "s.json")) == want and want["overall"]["items"] == len(seen)
