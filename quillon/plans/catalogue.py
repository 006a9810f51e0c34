"""The query catalogue over the driver's tables, with the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.functions.ids import assertion_id, stable_id, stable_id_sql
from quillon.operators import audit, graphs, items, linking, prompts, sampling, scoring
from quillon.plans.adapters import GRAPH, LINE_ORDER, RELATIONS, anatomies, assertions, odd_documents, report_graphs, scene_graph_documents, table, view, with_views
from quillon.schemas import ITEMS
from quillon.sources import members, scene_graphs
from quillon.sources.scratch import materialize

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYS = "patient_id, study_id, image_id"
G1 = "category = 'anatomicalfinding' and polarity in ('yes', 'no') and coalesce(image_id, '') <> '' and coalesce(label_name, '') <> ''"
G2 = f"{G1} and anatomy_bound and coalesce(bbox_name, '') <> ''"
YN = "bool_or(polarity = 'yes') any_yes, bool_or(polarity = 'no') any_no"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f
    return add


def _index(spark, sf):
    return view(spark, sf, "ci")


# --- filters, labels, ids


@query(f"select image_id, bbox_name, polarity, label_name from ca where {G1}")
def assert_filter_g1(spark, sf):
    return items.g1_evidence(view(spark, sf, "ca")).select("image_id", "bbox_name", "polarity", "label_name")


@query(f"select image_id, bbox_name, polarity, label_name from ca where {G2}")
def assert_filter_g2(spark, sf):
    return items.g2_evidence(view(spark, sf, "ca")).select("image_id", "bbox_name", "polarity", "label_name")


@query("select raw_label, string_split(raw_label, '|')[1] category, string_split(raw_label, '|')[2] polarity, string_split(raw_label, '|')[3] label_name, count(*) n from ca group by all")
def label_split(spark, sf):
    return view(spark, sf, "ca").select("raw_label", tx.label_parts(F.col("raw_label")).alias("p")).select("raw_label", "p.*").groupBy("raw_label", "category", "polarity", "label_name").agg(F.count("*").alias("n"))


@query("select case when l_tax = 0 or l_discount > 0.08 then 'malformed_label' else 'ok' end status, count(*) n from lineitem group by 1")
def label_malformed(spark, sf):
    """Labels with a blank or a missing part, counted by kind."""
    raw = F.concat_ws("|", "l_returnflag", F.when(F.col("l_tax") == 0, " \t").otherwise(F.col("l_linestatus")), F.when(F.col("l_discount") <= 0.08, F.lit("a|b")))
    ok = tx.label_parts(raw)["label_name"] == "a|b"
    return table(spark, sf, "lineitem").select(F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("malformed_label").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


_LINES = (
    f"(select *, concat('img-', cast(o_orderkey as string)) image_id, row_number() over (partition by l_orderkey order by {', '.join(LINE_ORDER)}) - 1 ai"
    " from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey where o_orderstatus <> 'P')"
)
_LABELS = (
    "(select *, case when li < 2 then 0 else 1 end pi, case when li = 1 then 1 else 0 end ki, case li when 0 then concat('anatomicalfinding|', case when l_linestatus = 'O' then 'yes' else 'no' end, '|', lower(p_type)) when 1 then 'nlp|yes|normal'"
    f" else case when l_quantity >= 45 then 'bad label' else 'anatomicalfinding|no|edema' end end raw_label, l_tax < 0.03 and l_linenumber <> 5 bound from {_LINES}, (values (0), (1), (2)) v(li) where l_quantity <> 1)"
)
_PART = "case when raw_label <> 'bad label' then string_split(raw_label, '|')[%d] end"


def _parsed(spark, sf):
    return scene_graphs.parse_scene_graphs(scene_graph_documents(spark, sf))


@query(
    f"select printf('ci_attr::%s::%04d::%03d::%03d', image_id, ai, pi, ki) assertion_id, image_id, cast(o_custkey as string) patient_id, cast(o_orderkey as string) study_id, case when bound then l_returnflag || ' lung' end bbox_name, bound anatomy_bound, raw_label,"
    f" {_PART % 1} category, {_PART % 2} polarity, {_PART % 3} label_name, cast(pi as int) phrase_index, case when pi = 0 then 's|1' when l_discount < 0.05 then 's|2' end phrase_id, case when pi = 0 then 'a phrase' else 'é 😀' end phrase,"
    f" case when pi = 0 then 'severity|yes|mild' else '' end cues, case li when 0 then 'C1' when 1 then 'C2' else 'C3' end attributes_id from {_LABELS}"
)
def scene_graph_assertions(spark, sf):
    """The parser over annotation documents that are made of the driver's tables."""
    a = _parsed(spark, sf).assertions
    return a.select("assertion_id", "image_id", "patient_id", "study_id", "bbox_name", "anatomy_bound", "raw_label", "category", "polarity", "label_name", "phrase_index", "phrase_id", "phrase", F.array_join("severity_cues", ",").alias("cues"), "attributes_id")


@query(
    f"select image_id, 'o' || cast(l_linenumber as string) object_id, l_returnflag || ' lung' bbox_name, '7' as name, 'S1,2' synsets, cast(cast(l_quantity as int) as double) x1, cast(null as double) y1, cast(null as double) x2, cast(l_quantity as int) + 0.5::double y2 from {_LINES} where l_quantity <> 1"
)
def scene_graph_objects(spark, sf):
    return _parsed(spark, sf).objects.select("image_id", "object_id", "bbox_name", "name", F.array_join("synsets", ",").alias("synsets"), "x1", "y1", "x2", "y2")


@query(
    "select key, n from (select 'missing_top_level_key:objects' as key, count(distinct l_orderkey) n from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey where o_orderstatus = 'P'"
    f" union all select 'invalid_object_entry', count(*) from {_LINES} where l_quantity = 1 union all select 'invalid_attribute_entry', count(*) from {_LINES} where l_quantity = 1"
    f" union all select 'misaligned_phrase_key:phrase_IDs', count(*) from {_LINES} where l_quantity <> 1 and l_discount >= 0.05 union all select 'malformed_label', count(*) from {_LINES} where l_quantity >= 45) where n > 0"
)
def scene_graph_warnings(spark, sf):
    return _parsed(spark, sf).warnings


@query(
    "select image_id, 'o' || cast(l_linenumber as string) object_id, cast(cast(l_quantity as int) as double) x1, o_orderkey % 4 = 1 y1_nan,"
    f" cast(l_quantity as int) + 0.5::double y2 from {_LINES} where l_quantity <> 1 and o_orderkey % 7 <> 2"
)
def scene_graph_json_rules(spark, sf):
    """Documents with repeated keys, of which the last counts, and with NaN, among others and among some that are no JSON."""
    got = scene_graphs.parse_scene_graphs(odd_documents(spark, sf), strict=False).objects
    return got.select("image_id", "object_id", "x1", F.coalesce(F.isnan("y1"), F.lit(False)).alias("y1_nan"), "y2")


@query("select cast(o_orderkey as string) || '_SceneGraph.json' path, 'malformed_json' reason from orders where o_orderkey % 7 = 2 and o_orderkey in (select l_orderkey from lineitem join part on l_partkey = p_partkey)")
def scene_graph_refused(spark, sf):
    """The quarantine of documents that are no JSON."""
    return scene_graphs.parse_scene_graphs(odd_documents(spark, sf), strict=False).refused.select("path", "reason")


_CHAR = (
    "case when c in ('\"', chr(92)) then chr(92) || c when c = chr(10) then chr(92) || 'n' when c = chr(9) then chr(92) || 't' when c = chr(13) then chr(92) || 'r' when c = chr(8) then chr(92) || 'b' when c = chr(12) then chr(92) || 'f'"
    " when unicode(c) between 32 and 126 then c when unicode(c) < 65536 then chr(92) || 'u' || printf('%04x', unicode(c))"
    " else chr(92) || 'u' || printf('%04x', 55296 + (unicode(c) - 65536) // 1024) || chr(92) || 'u' || printf('%04x', 56320 + (unicode(c) - 65536) % 1024) end"
)


@query(f"select conv_id, turn, 'any_' || substr(sha1('{{\"role\": \"' || role || '\", \"text\": \"' || array_to_string(list_transform(string_split(text, ''), lambda c: {_CHAR}), '') || '\"}}'), 1, 16) item_id from conversations")
def ids_of_any_text(spark, sf):
    """Ids over texts beyond ASCII, with line breaks and quotes."""
    return table(spark, sf, "conversations").select("conv_id", "turn", stable_id("any", {"text": F.col("text"), "role": F.col("role")}).alias("item_id"))


@query("select doc_id, cast(i - 1 as int) phrase_index, length(line) n_chars from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents)")
def phrase_explode(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("phrase_index", "line"))
    return lines.select("doc_id", "phrase_index", F.length("line").cast("long").alias("n_chars"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def variant_dynamic_key(spark, sf):
    v = F.from_json("props", "map<string,variant>")
    return table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_element_at(v, F.lit("k")), "$", "bigint").alias("k"))


@query("select printf('ci_attr::%s::%04d::%03d::%03d', image_id, phrase_index, phrase_index, 0) assertion_id, count(*) n from ca group by 1")
def assertion_ids(spark, sf):
    i = F.col("phrase_index")
    return view(spark, sf, "ca").select(assertion_id(F.col("image_id"), i, i, F.lit(0)).alias("assertion_id")).groupBy("assertion_id").agg(F.count("*").alias("n"))


# --- image index


@query(f"select {KEYS}, image_id dicom_id, true has_chest_imagenome, false has_radgraph from (select {KEYS} from ca union select {KEYS} from co) where image_id is not null")
def image_index(spark, sf):
    return linking.image_index(view(spark, sf, "co"), view(spark, sf, "ca")).select("patient_id", "study_id", "image_id", "dicom_id", "has_chest_imagenome", "has_radgraph")


@query(f"select count(*) image_index_rows, 0::bigint non_null_image_path_rows, count(*) has_chest_imagenome_rows, 0::bigint has_radgraph_rows from (select {KEYS} from ca union select {KEYS} from co)")
def image_index_summary(spark, sf):
    return linking.image_index_summary(linking.image_index(view(spark, sf, "co"), view(spark, sf, "ca")))


# --- evidence groups and items

G1_GROUPS = f"(select {KEYS}, label_name, {YN} from ca where {G1} group by {KEYS}, label_name)"
G2_GROUPS = f"(select {KEYS}, bbox_name, label_name, {YN} from ca where {G2} group by {KEYS}, bbox_name, label_name)"
JOIN_CI = "left join ci i on g.patient_id = i.patient_id and g.study_id = i.study_id and g.image_id = i.image_id"
JOIN_CO = "left join co b on g.patient_id = b.patient_id and g.study_id = b.study_id and g.image_id = b.image_id and g.bbox_name = b.bbox_name"
DICOM = "case when i.image_id is not null then i.dicom_id else g.image_id end dicom_id, i.image_path"


def _id(prefix, anatomy, claim=None):
    parts = {"patient_id": "g.patient_id", "study_id": "g.study_id", "image_id": "g.image_id", "target_finding": "g.label_name", "target_anatomy": anatomy}
    return stable_id_sql(prefix, parts | ({"claim": f"({claim})"} if claim else {}))


C1 = "case when any_yes then 'There is evidence of ' else 'There isn''t evidence of ' end || g.label_name || '.'"
C2 = "case when any_yes then 'There is evidence of ' else 'There isn''t evidence of ' end || g.label_name || ' in the ' || g.bbox_name || '.'"
ASK = "'Is the following claim supported by the chest X-ray? Claim: ' || "
VOCAB = "(select distinct label_name from ca where category = 'anatomicalfinding' and polarity in ('yes', 'no') and coalesce(label_name, '') <> '')"
RANK1 = stable_id_sql("rank", {"image": "m.image_id", "finding": "v.label_name"})
RANK2 = stable_id_sql("rank", {"image": "m.image_id", "bbox_name": "m.bbox_name", "finding": "v.label_name"})
MISS1 = (
    f"(select {KEYS}, label_name, true any_yes from (select m.*, v.label_name, row_number() over (partition by m.patient_id, m.study_id, m.image_id order by {RANK1}) k "
    f"from (select distinct {KEYS} from ca where {G1}) m, {VOCAB} v where not exists (select 1 from ca a where {G1.replace('label_name', 'a.label_name').replace('image_id', 'a.image_id')}"
    " and a.image_id = m.image_id and a.patient_id = m.patient_id and a.study_id = m.study_id and a.label_name = v.label_name)) where k = 1)"
)
MISS2 = (
    f"(select {KEYS}, bbox_name, label_name, true any_yes from (select m.*, v.label_name, row_number() over (partition by m.patient_id, m.study_id, m.image_id, m.bbox_name order by {RANK2}) k "
    f"from co m, {VOCAB} v where not exists (select 1 from (select * from ca where {G2}) a where a.image_id = m.image_id and a.patient_id = m.patient_id and a.study_id = m.study_id and a.bbox_name = m.bbox_name"
    " and a.label_name = v.label_name)) where k = 1)"
)
H1_1 = f"select {_id('ci_g1_h1', None)} item_id, g.image_id, {DICOM}, 'Is there evidence of ' || g.label_name || ' in this chest X-ray?' question, case when any_yes then 'Yes' else 'No' end answer_label, g.label_name target_finding from {G1_GROUPS} g {JOIN_CI} where not (any_yes and any_no)"
H1_2 = (
    f"select {_id('ci_g2_h1', 'g.bbox_name')} item_id, g.image_id, {DICOM}, 'Is there evidence of ' || g.label_name || ' in the ' || g.bbox_name || '?' question, case when any_yes then 'Yes' else 'No' end answer_label,"
    f" g.label_name target_finding, g.bbox_name target_anatomy, b.x1 from {G2_GROUPS} g {JOIN_CO} {JOIN_CI} where not (any_yes and any_no) and b.image_id is not null"
)
H2_1 = (
    f"select {_id('ci_g1_h2', None, C1)} item_id, g.image_id, {ASK}{C1} question, 'Supported' answer_label, g.label_name target_finding from {G1_GROUPS} g where not (any_yes and any_no)"
    f" union all select {_id('ci_g1_h2', None, C1)}, g.image_id, {ASK}{C1}, 'Unsupported', g.label_name from {MISS1} g"
)
H2_2 = (
    f"select {_id('ci_g2_h2', 'g.bbox_name', C2)} item_id, g.image_id, {ASK}{C2} question, 'Supported' answer_label, g.label_name target_finding, g.bbox_name target_anatomy from {G2_GROUPS} g {JOIN_CO} where not (any_yes and any_no) and b.image_id is not null"
    f" union all select {_id('ci_g2_h2', 'g.bbox_name', C2)}, g.image_id, {ASK}{C2}, 'Unsupported', g.label_name, g.bbox_name from {MISS2} g"
)


@query(f"select {KEYS}, label_name, any_yes, any_no, any_yes and any_no conflict from {G1_GROUPS}")
def g1_groups(spark, sf):
    return items.g1_groups(view(spark, sf, "ca"))


@query(f"select {KEYS}, bbox_name, label_name, any_yes, any_no, any_yes and any_no conflict from {G2_GROUPS}")
def g2_groups(spark, sf):
    return items.g2_groups(view(spark, sf, "ca"))


def _g1_h1(spark, sf):
    return items.build_g1_h1(assertions(spark, sf), _index(spark, sf), any_text=False)


@query(H1_1)
def g1_h1_items(spark, sf):
    return _g1_h1(spark, sf).select("item_id", "image_id", "dicom_id", "image_path", "question", "answer_label", "target_finding")


@query(H1_2)
def g2_h1_items(spark, sf):
    out = items.build_g2_h1(assertions(spark, sf), view(spark, sf, "co"), _index(spark, sf), any_text=False)
    return out.select("item_id", "image_id", "dicom_id", "image_path", "question", "answer_label", "target_finding", "target_anatomy", F.col("bbox.x1").alias("x1"))


@query(f"select label_name from {VOCAB} order by label_name")
def finding_vocab(spark, sf):
    return items.finding_vocab(view(spark, sf, "ca")).orderBy("label_name")


@query(f"select {KEYS}, label_name from {MISS1}")
def g1_unsupported_topk(spark, sf):
    return items.g1_missing(view(spark, sf, "ca"), 1).select("patient_id", "study_id", "image_id", "label_name")


@query(f"select {KEYS}, bbox_name, label_name from {MISS2}")
def g2_unsupported_topk(spark, sf):
    return items.g2_missing(view(spark, sf, "ca"), view(spark, sf, "co"), 1, any_text=False).select("patient_id", "study_id", "image_id", "bbox_name", "label_name")


@query(H2_1)
def g1_h2_items(spark, sf):
    out, _ = items.build_g1_h2(assertions(spark, sf), _index(spark, sf), balance_h2=False)  # for text of any kind, the default
    return out.select("item_id", "image_id", "question", "answer_label", "target_finding")


def _g2_h2(spark, sf):
    return items.build_g2_h2(assertions(spark, sf), view(spark, sf, "co"), _index(spark, sf), balance_h2=False, any_text=False)[0]


@query(H2_2)
def g2_h2_items(spark, sf):
    return _g2_h2(spark, sf).select("item_id", "image_id", "question", "answer_label", "target_finding", "target_anatomy")


_SAMPLE = stable_id_sql("sample", {"seed": 42, "label": "answer_label", "item_id": "item_id"})
_N = "(select count(*) filter (where answer_label = 'Supported') p, count(*) filter (where answer_label = 'Unsupported') n from u)"
_QUOTA = "(select p, n, greatest(1, least(p, n // 4)) kp, greatest(1, least(n, p * 4)) kn from " + _N + ")"


@query(
    f"select item_id, answer_label from (select u.item_id, answer_label, row_number() over (partition by answer_label order by {_SAMPLE}, item_id) k from ({H2_2}) u) s,"
    f" {_QUOTA.replace('from u', f'from ({H2_2})')} q where k <= case when answer_label = 'Supported' then kp else kn end"
)
def h2_balanced(spark, sf):
    return items.balanced_g2_h2_labels(anatomies(spark, sf), any_text=False)


@query(f"select p positive_before, n negative_before, kp positive_after, kn negative_after from {_QUOTA.replace('from u', f'from ({H2_2})')} q")
def h2_balance_summary(spark, sf):
    s = sampling.balance_summary(items.g2_h2_counts(anatomies(spark, sf)))
    names = ["positive_before", "negative_before", "positive_after", "negative_after"]
    return spark.createDataFrame([tuple(int(s[n]) for n in names)], ", ".join(f"{n} long" for n in names))


@query(
    f"select count(*) candidate_groups, count(*) filter (where not c and has) items_written, count(*) filter (where not c and has and any_yes) yes_items, count(*) filter (where not c and has and not any_yes) no_items,"
    f" count(*) filter (where c) excluded_conflict_groups, count(*) filter (where not c and not has) excluded_missing_bbox_groups from (select any_yes, any_yes and any_no c, b.image_id is not null has from {G2_GROUPS} g {JOIN_CO})"
)
def builder_summary(spark, sf):
    return items.builder_summary(items.g2_groups(view(spark, sf, "ca")), view(spark, sf, "co"))


@query(f"select image_id, bbox_name, label_name from {G2_GROUPS} where any_yes and any_no")
def conflict_groups(spark, sf):
    return items.g2_groups(view(spark, sf, "ca")).where("conflict").select("image_id", "bbox_name", "label_name")


@query(f"select g.image_id, g.bbox_name, g.label_name from {G2_GROUPS} g {JOIN_CO} where not (any_yes and any_no) and b.image_id is null")
def missing_bbox_groups(spark, sf):
    g = items.attach_boxes(items.g2_groups(view(spark, sf, "ca")), view(spark, sf, "co"))
    return g.where("not conflict and bbox is null").select("image_id", "bbox_name", "label_name")


# --- prompts and mock answers


@query(f"select item_id, image_path, 'yes_no_uncertain_v1' prompt_template_id, '{tx.YES_NO_SYSTEM} Question: ' || question prompt from ({H1_1}) where coalesce(image_path, '') <> ''")
def prompt_layer(spark, sf):
    return prompts.prompt_layers(_g1_h1(spark, sf))[0]


@query(f"select item_id, answer_label, 'G1' granularity, 'h1_yes_no_qa' question_type, 'H1' hallucination_probe, target_finding, 'E2_structured_label' evidence from ({H1_1}) where coalesce(image_path, '') <> ''")
def eval_metadata(spark, sf):
    m = prompts.prompt_layers(_g1_h1(spark, sf))[1]
    return m.select("item_id", "answer_label", "granularity", "question_type", "hallucination_probe", "target_finding", F.array_join("evidence_sources", ",").alias("evidence"))


@query(f"select count(*) input_items, count(image_path) model_input_records, count(image_path) eval_metadata_records, count(*) - count(image_path) skipped_missing_image_path, 0::bigint skipped_missing_question from ({H1_1})")
def prompt_summary(spark, sf):
    return prompts.prompt_layers(_g1_h1(spark, sf))[2]


@query(f"select item_id, answer_label raw_response from ({H1_1}) where coalesce(image_path, '') <> ''")
def mock_oracle(spark, sf):
    inputs, meta, _ = prompts.prompt_layers(_g1_h1(spark, sf))
    return prompts.mock_responses(inputs, meta, "oracle").select("item_id", "raw_response")


@query("select item_id, case when hallucination_probe = 'H2' then case when k % 2 = 0 then 'Supported' else 'Unsupported' end else case when k % 2 = 0 then 'Yes' else 'No' end end raw_response from (select *, row_number() over (order by cast(item_id as bigint)) - 1 k from cr)")
def mock_alternating(spark, sf):
    """In the order of the records, which is that of the event numbers."""
    rows = prompts.with_row_index(view(spark, sf, "cr").withColumn("_ord", F.col("item_id").cast("long")), "_ord")
    return rows.select("item_id", prompts.mock_answer("alternating", F.col("answer_label"), F.col("hallucination_probe"), F.col("row_index")).alias("raw_response"))


# --- answers and scores

_PARSED = (
    "(select *, case when status = 'success' then upper(w[1][1]) || w[1][2:] end parsed_answer from (select *, case when trim(raw_response) = '' then 'empty_response' when len(w) = 0 then 'invalid_format'"
    " when len(w) > 1 then 'multiple_answers' else 'success' end status from (select *, list_distinct([x for x in regexp_split_to_array(lower(raw_response), '[^\\p{L}\\p{N}_]+') if x in ('yes', 'no', 'uncertain', 'supported', 'unsupported')]) w from %s)))"
)
_TALK = "(select cast(conv_id as string) || '-' || cast(turn as string) item_id, text raw_response from conversations union all select item_id, raw_response from cr)"
_SIDES = "('Yes', 'No', 'Supported', 'Unsupported')"
_SCORED = (
    "(select *, case when status <> 'success' then 'invalid_response' when answer_label = parsed_answer then 'correct' when (answer_label, parsed_answer) in (('No', 'Yes'), ('Yes', 'No')) then 'H1_evidence_contradicted'"
    " when answer_label = 'Unsupported' and parsed_answer = 'Supported' then 'H2_evidence_unsupported' when answer_label = 'Supported' and parsed_answer = 'Unsupported' then 'incorrect_non_hallucination'"
    f" when answer_label in {_SIDES} and parsed_answer = 'Uncertain' then 'uncertain_or_abstention' else 'requires_manual_review' end score from {_PARSED % 'cr'})"
)
_IS = "case when score = 'requires_manual_review' then null else score = 'correct' end"


@query(f"select item_id, parsed_answer, status parse_status from {_PARSED % _TALK}")
def answer_parse(spark, sf):
    talk = table(spark, sf, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"), F.col("text").alias("raw_response"))
    return scoring.parse_responses(talk.unionByName(view(spark, sf, "cr").select("item_id", "raw_response"))).select("item_id", "parsed_answer", "parse_status")


@query(f"select status parse_status, count(*) n from {_PARSED % 'cr'} group by 1")
def parse_status_hist(spark, sf):
    return scoring.status_histogram(scoring.parse_responses(view(spark, sf, "cr")))


def _scored(spark, sf):
    return scoring.score_responses(scoring.parse_responses(view(spark, sf, "cr")))


@query(
    f"select item_id, score, {_IS} is_correct, case score when 'H1_evidence_contradicted' then 'H1' when 'H2_evidence_unsupported' then 'H2' end hallucination_type,"
    " case when score = 'H1_evidence_contradicted' then case when parsed_answer = 'Yes' then 'false_positive' else 'false_negative' end end h1_error_direction,"
    " case score when 'correct' then case when answer_label = 'Unsupported' then 'S0_unsupported' else 'S2_directly_supported' end when 'H1_evidence_contradicted' then 'S-1_contradicted' when 'H2_evidence_unsupported' then 'S0_unsupported'"
    " when 'incorrect_non_hallucination' then 'S0_unsupported' else 'U_uncertain' end evidence_relation,"
    f" case when score = 'incorrect_non_hallucination' then 'unsupported_rejection' when score = 'requires_manual_review' and answer_label = 'Uncertain' and parsed_answer in {_SIDES} then 'uncertain_case' end error_category,"
    f" score = 'requires_manual_review' requires_manual_review from {_SCORED}"
)
def score_rows(spark, sf):
    return _scored(spark, sf).select("item_id", "score", "is_correct", "hallucination_type", "h1_error_direction", "evidence_relation", "error_category", "requires_manual_review")


@query(f"select answer_label, parsed_answer, score, count(*) n from {_SCORED} group by all")
def score_matrix(spark, sf):
    return _scored(spark, sf).groupBy("answer_label", "parsed_answer", "score").agg(F.count("*").alias("n"))


_METRICS = (
    f"count(*) items, count({_IS}) scored_items, count(*) filter (where score = 'correct') correct, count(*) filter (where score = 'correct') / nullif(count({_IS}), 0) accuracy,"
    " count(*) filter (where score = 'H1_evidence_contradicted') h1_count, count(*) filter (where score = 'H1_evidence_contradicted' and parsed_answer = 'Yes') h1_false_positive_count,"
    " count(*) filter (where score = 'H1_evidence_contradicted' and parsed_answer = 'No') h1_false_negative_count, count(*) filter (where score = 'H2_evidence_unsupported') h2_count,"
    " count(*) filter (where score = 'invalid_response') invalid_count, count(*) filter (where score = 'requires_manual_review') manual_review_count, count(*) filter (where score = 'uncertain_or_abstention') uncertain_or_abstention_count"
)
_SUMMARY = (
    "select case grouping(g, p, a) when 7 then 'overall' when 3 then 'by_granularity' when 5 then 'by_hallucination_probe' else 'by_answer_label' end group_type, coalesce(g, p, a, 'overall') \"group\", "
    f"{_METRICS} from (select *, coalesce(granularity, 'None') g, coalesce(hallucination_probe, 'None') p, coalesce(answer_label, 'None') a from {_SCORED}) group by grouping sets ((), (g), (p), (a))"
)


@query(_SUMMARY)
def score_summary(spark, sf):
    return scoring.summarize(_scored(spark, sf))


@query(f"select 'run' run_name, *, h1_count / nullif(items, 0) h1_rate, h2_count / nullif(items, 0) h2_rate, invalid_count / nullif(items, 0) invalid_rate, uncertain_or_abstention_count / nullif(items, 0) abstention_rate from ({_SUMMARY})")
def flat_metrics_rates(spark, sf):
    return scoring.with_rates(scoring.summarize(_scored(spark, sf), "run"))


@query(
    "select granularity, n_abstain, n_invalid, n_answered, n_answered / t coverage, n_abstain / t abstention_rate, c / nullif(n_answered, 0) answered_accuracy, h1 / t h1_rate_total, h2 / t h2_rate_total, h1 / nullif(n_answered, 0) h1_rate_answered,"
    " h2 / nullif(n_answered, 0) h2_rate_answered from (select granularity, count(*) t, count(*) filter (where score = 'uncertain_or_abstention') n_abstain, count(*) filter (where score = 'invalid_response') n_invalid,"
    " count(*) filter (where score not in ('uncertain_or_abstention', 'invalid_response')) n_answered, count(*) filter (where score = 'correct') c, count(*) filter (where score = 'H1_evidence_contradicted') h1,"
    f" count(*) filter (where score = 'H2_evidence_unsupported') h2 from {_SCORED} group by 1)"
)
def answered_metrics(spark, sf):
    return scoring.answered_metrics(_scored(spark, sf))


# --- dry run, links, paths


@query("select cast(doc_id as string) item_id, '/data/' || source || '/' || cast(doc_id as string) resolved_image_path, false image_exists, l.quality is not null has_eval_metadata from documents left join labels l using (doc_id)")
def dry_run_check(spark, sf):
    p = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("image_path"))
    m = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("item_id"), F.col("quality").cast("string").alias("answer_label"), *(F.lit(None).cast("string").alias(c) for c in ("granularity", "question_type", "hallucination_probe")))
    return prompts.dry_run(p, m, root="/data").select("item_id", "resolved_image_path", "image_exists", "has_eval_metadata")


_NEED = "(select distinct cast(o_custkey as string) patient_id, cast(case when o_orderkey % 11 = 0 then o_orderkey + 1 else o_orderkey end as string) study_id, concat('d-', cast(o_orderkey as string)) dicom_id from orders)"


def _links(spark, sf):
    o = table(spark, sf, "orders")
    need = o.select(F.col("o_custkey").cast("string").alias("patient_id"), F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey")).cast("string").alias("study_id"), F.concat(F.lit("d-"), F.col("o_orderkey").cast("string")).alias("dicom_id"))
    need = linking.needed_images([need.withColumn("image_id", F.col("dicom_id"))])
    ci = _index(spark, sf).select(F.col("patient_id").alias("subject_id"), "study_id", "dicom_id", F.lit("train").alias("split"))
    return linking.classify_links(need, ci)


@query(
    f"select n.patient_id, n.study_id, n.dicom_id, case when i.dicom_id is not null then 'matched' when n.dicom_id in (select dicom_id from ci) then 'id_mismatch' else 'missing_metadata' end link_status,"
    f" case when i.dicom_id is not null then 'p' || substr(n.patient_id, 1, 2) || '/p' || n.patient_id || '/s' || n.study_id || '/' || n.dicom_id || '.jpg' end image_path from {_NEED} n"
    " left join ci i on n.patient_id = i.patient_id and n.study_id = i.study_id and n.dicom_id = i.dicom_id"
)
def link_classify(spark, sf):
    return _links(spark, sf).select("patient_id", "study_id", "dicom_id", "link_status", "image_path")


@query(f"select item_id, g.dicom_id, i.image_path from (select * exclude (image_path) from ({H1_1})) g join ci i on g.dicom_id = i.dicom_id where i.image_path is not null")
def link_items(spark, sf):
    have = _index(spark, sf).where("image_path is not null")
    return linking.link_items(_g1_h1(spark, sf), have)[0].select("item_id", "dicom_id", "image_path")


@query("select o_orderkey, 'p' || substr(cast(o_custkey as string), 1, 2) || '/p' || cast(o_custkey as string) || '/s' || cast(o_orderkey as string) || '/d.jpg' path from orders")
def mimic_path(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", tx.relative_image_path(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lit("d")).alias("path"))


# --- extensions and audits


@query(
    "select image_id, bbox_a, bbox_b, w * h / u iou, centre_inside from (select *, (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - w * h u from (select a.image_id, a.bbox_name bbox_a, b.bbox_name bbox_b,"
    " a.x1 ax1, a.x2 ax2, a.y1 ay1, a.y2 ay2, b.x1 bx1, b.x2 bx2, b.y1 by1, b.y2 by2, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) w, greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) h,"
    " (a.x1 + a.x2) / 2 between b.x1 and b.x2 and (a.y1 + a.y2) / 2 between b.y1 and b.y2 centre_inside"
    " from co a join co b on a.image_id = b.image_id and a.patient_id = b.patient_id and a.study_id = b.study_id and a.bbox_name < b.bbox_name))"
)
def box_iou(spark, sf):
    return audit.overlapping_boxes(view(spark, sf, "co"))


_G3A = f"select t.image_id, t.label_name, t.bbox_name target, d.bbox_name distractor from {G2_GROUPS} t join {G2_GROUPS} d on t.image_id = d.image_id and t.label_name = d.label_name where t.any_yes and not t.any_no and d.any_no and not d.any_yes"
_G3B = (
    "select distinct image_id, phrase_id, label_name, cue from ca join (select image_id, phrase_id from ca where category = 'anatomicalfinding' and polarity = 'yes' group by 1, 2 having count(distinct label_name) = 1) using (image_id, phrase_id)"
    " where category = 'anatomicalfinding' and polarity = 'yes' and cue = 'severity|yes|mild'"
)


@query(_G3A)
def g3a_pairs(spark, sf):
    return audit.contrast_pairs(view(spark, sf, "ca"))


@query(_G3B)
def g3b_modifiers(spark, sf):
    return audit.modifier_items(assertions(spark, sf))


@query("select coalesce(d.doc_id, l.doc_id) doc_id, case when l.doc_id is null then 'missing_right' when d.doc_id is null then 'missing_left' when d.q = l.quality then 'agree' else 'disagree' end status from (select doc_id, case when n_chars > 500 then 1 else 0 end q from documents) d full outer join labels l on d.doc_id = l.doc_id")
def cross_source(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("q"))
    return audit.cross_source(d, table(spark, sf, "labels"), "doc_id", "q", "quality")


@query("select category, label_name, count(*) n from ca group by 1, 2 order by n desc, category, label_name limit 20")
def audit_top_findings(spark, sf):
    return audit.top_findings(view(spark, sf, "ca"))


@query("select patient_id, count(distinct study_id) members from ca group by 1 having count(distinct study_id) > 1")
def audit_one_to_many(spark, sf):
    return audit.one_to_many(view(spark, sf, "ca"), "patient_id", "study_id")


@query("select count(*) assertions, count(*) filter (where anatomy_bound) bound, count(*) filter (where category = 'anatomicalfinding') findings, count(*) filter (where polarity = 'yes') positive, count(*) filter (where polarity = 'no') negative, 0::bigint malformed, (select count(*) from co) objects, (select count(distinct image_id) from co) images, (select count(distinct bbox_name) from co) anatomies from ca")
def audit_counts(spark, sf):
    return audit.audit_counts(view(spark, sf, "ca"), view(spark, sf, "co"))


@query(
    f"select g1.n g1_valid, g1.c g1_conflicting, g2.n g2_valid, g2.c g2_conflicting, g2.b g2_without_box, 0::bigint without_label, 0::bigint uncertain, raw.m with_modifier, a.n g3a_pairs, b.n g3b_supported"
    f" from (select count(*) filter (where not (any_yes and any_no)) n, count(*) filter (where any_yes and any_no) c from {G1_GROUPS}) g1,"
    f" (select count(*) filter (where not (any_yes and any_no) and b.image_id is not null) n, count(*) filter (where any_yes and any_no) c, count(*) filter (where not (any_yes and any_no) and b.image_id is null) b from {G2_GROUPS} g {JOIN_CO}) g2,"
    " (select count(*) m from ca where category = 'anatomicalfinding' and polarity = 'yes') raw, (select count(*) n from (" + _G3A + ")) a, (select count(*) n from (" + _G3B + ")) b"
)
def candidate_counts(spark, sf):
    return audit.candidate_counts(assertions(spark, sf), view(spark, sf, "co"))


@query(
    "select a.*, c.*, o.* from (select count(*) filter (where category = 'anatomicalfinding' and polarity = 'yes') yes, count(*) filter (where category = 'anatomicalfinding' and polarity = 'no') no, 0::bigint uncertain, count(*) filter (where not anatomy_bound) without_anatomy,"
    " count(*) with_severity_cues, 0::bigint with_temporal_cues, 0::bigint with_texture_cues, 0::bigint with_comparison_cues, count(*) labels_with_phrase, count(*) labels from ca) a,"
    f" (select count(*) filter (where any_yes and any_no) conflict_groups from {G1_GROUPS}) c, (select count(*) objects, count(*) boxes from co) o"
)
def evidence_audit(spark, sf):
    return audit.evidence_audit(assertions(spark, sf), view(spark, sf, "co"))


@query("select category, polarity, count(*) n from ca group by 1, 2")
def label_distribution(spark, sf):
    return audit.label_distribution(view(spark, sf, "ca"))


@query(f"select item_id, 'bad_answer' as rule from ({H1_1}) where answer_label = 'No' union all select item_id, 'no_question' from ({H1_1}) where answer_label = 'Yes' and dicom_id like 'img%'")
def schema_violations(spark, sf):
    """Rules that two deliberate defects break."""
    bad = _g1_h1(spark, sf).withColumn("question", F.when((F.col("answer_label") == "Yes") & F.col("dicom_id").startswith("img"), "").otherwise(F.col("question"))).withColumn("answer_label", F.when(F.col("answer_label") == "No", "no").otherwise(F.col("answer_label")))
    assert bad.columns == ITEMS.names
    return audit.schema_violations(bad)


_REVIEW = stable_id_sql("sample", {"seed": 42, "label": "category", "item_id": "phrase_id"})


@query(f"select category, phrase_id from (select *, row_number() over (partition by category order by {_REVIEW}, phrase_id) k from (select distinct category, phrase_id from ca)) where k <= 30")
def review_sample(spark, sf):
    rows = view(spark, sf, "ca").select("category", "phrase_id").distinct()
    return sampling.first_of_each(rows, "category", 30, 42, "phrase_id", any_text=False)


@query(f"select image_id, array_to_string(list_sort(list(label_name) filter (where any_yes)), ',') present, array_to_string(list_sort(list(label_name) filter (where not any_yes)), ',') absent from (select {KEYS}, label_name, {YN} from ca where {G2} group by {KEYS}, label_name) where not (any_yes and any_no) group by {KEYS}")
def g4_synthesis(spark, sf):
    return audit.synthesis_proxy(view(spark, sf, "ca")).select("image_id", *(F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c) for c in ("present", "absent")))


@query(
    f"select image_id, label_name, t answer, array_to_string(list_sort(list_concat([t], d[1:3])), ',') choices from (select t.image_id, t.label_name, min(t.bbox_name) t, count(distinct t.bbox_name) n, list_sort(list(distinct d.bbox_name)) d"
    f" from {G2_GROUPS} t join {G2_GROUPS} d on t.image_id = d.image_id and t.label_name = d.label_name where t.any_yes and not t.any_no and d.any_no and not d.any_yes group by 1, 2) where n = 1"
)
def g2_choice(spark, sf):
    return audit.choice_items(view(spark, sf, "ca")).select("image_id", "label_name", "answer", F.array_join("choices", ",").alias("choices"))


# --- report graphs


def _reports(spark, sf):
    return members.read_reports(spark, report_graphs(spark, sf))


def _graph(spark, sf):
    return audit.normalize_radgraph(materialize(_reports(spark, sf).select("report_id", "entities")))


@query(
    f"select 'r' || report report_id, line::varchar entity_id, tokens, label, coalesce(n, 0) n_relations from {GRAPH} left join (select report report_, entity_id, count(*) n from {RELATIONS} group by all) r on report = report_ and line::varchar = entity_id"
)
def report_entities(spark, sf):
    """Entities and relations of report graphs, read back from files that hold one JSON object each."""
    entities, _ = audit.normalize_radgraph(_reports(spark, sf))
    return entities.select("report_id", "entity_id", "tokens", "label", "n_relations")


_WALK = (
    "with recursive step as materialized (select distinct report, entity_id a, target_id b from {edges}), reach(report, a, b) as (select report, a, b from step union select r.report, r.a, s.b from reach r join step s on r.report = s.report and r.b = s.a)"
)


@query()
def report_modifiers(spark, sf):
    """Modifiers of observations over chains of modify, cycles among them."""
    return graphs.modifier_support(*_graph(spark, sf)).select("report_id", "finding_id", "finding", "answer", "modifier_id", "modifier")


SQL["report_modifiers"] = (
    _WALK.format(edges=f"{RELATIONS} where relation = 'modify'")
    + ", e as (select report, line::varchar id, tokens, label from " + GRAPH + ") select 'r' || w.report report_id, w.b finding_id, f.tokens finding, case f.label when 'OBS-DP' then 'Yes' when 'OBS-DA' then 'No' else 'Uncertain' end answer,"
    " w.a modifier_id, m.tokens modifier from reach w join e f on f.report = w.report and f.id = w.b and f.label like 'OBS%' join e m on m.report = w.report and m.id = w.a where w.a <> w.b"
)


@query()
def report_locations(spark, sf):
    """Anatomies that observations are located at, and those that modify these anatomies."""
    return graphs.located_findings(*_graph(spark, sf)).select("report_id", "finding_id", "anatomy_id")


SQL["report_locations"] = (
    _WALK.format(
        edges=f"(select report, entity_id, target_id from {RELATIONS} where relation = 'located_at' union all select r.report, target_id, entity_id from {RELATIONS} r join {GRAPH} g on g.report = r.report and g.line::varchar = target_id and g.label like 'ANAT%' where relation = 'modify')"
    )
    + ", e as (select report, line::varchar id, label from " + GRAPH + ") select 'r' || w.report report_id, w.a finding_id, w.b anatomy_id from reach w join e f on f.report = w.report and f.id = w.a and f.label like 'OBS%'"
    " join e m on m.report = w.report and m.id = w.b and m.label like 'ANAT%' where w.a <> w.b"
)


@query(
    f"select coalesce(a.study_id, b.study_id) study_id, coalesce(a.finding, b.finding) finding, image_state, report_state, case when image_state = 'conflict' or report_state = 'conflict' then 'conflict' when report_state is null then 'missing_report'"
    " when image_state is null then 'missing_image' when report_state = 'uncertain' then 'uncertain' when image_state = report_state then 'agree' else 'disagree' end status"
    f" from (select study_id, lower(label_name) || ' change' finding, case when count(distinct polarity) > 1 then 'conflict' else max(polarity) end image_state from ca where {G1} group by 1, 2) a full join"
    f" (select report::varchar study_id, substr(tokens, 6) finding, case when bool_or(label = 'OBS-DP') and bool_or(label = 'OBS-DA') then 'conflict' when bool_or(label = 'OBS-DP') then 'yes' when bool_or(label = 'OBS-DA') then 'no' else 'uncertain' end report_state"
    f" from {GRAPH} where label <> 'ANAT-DP' group by 1, 2) b on a.study_id = b.study_id and a.finding = b.finding"
)
def finding_consistency(spark, sf):
    """Findings that image evidence and report entities name for a study, by the longest names that the entities' texts hold."""
    entities, _ = audit.normalize_radgraph(_reports(spark, sf))
    a = assertions(spark, sf)
    longer = a.withColumn("label_name", F.concat("label_name", F.lit(" change")))
    names = a.select("label_name").unionByName(longer.select("label_name")).distinct()  # longer names win over the shorter ones inside of them
    observed = graphs.named_findings(entities.where("answer is not null"), names, ["report_id", "answer"])
    observed = observed.select(F.substring("report_id", 2, 100).alias("study_id"), "finding", "answer")
    return graphs.finding_consistency(longer, observed)
