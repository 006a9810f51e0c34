"""Claims, questions, prompts, labels and answers as column expressions (SCL2-SCL8, FLT7, SCL14, SCL16-SCL20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt templates and question texts.
YES_NO_ID = "yes_no_uncertain_v1"
YES_NO_SYSTEM = "You are given a chest X-ray. Answer only one of: Yes, No, or Uncertain."
SUPPORT_ID = "supported_unsupported_uncertain_v1"
SUPPORT_SYSTEM = "You are given a chest X-ray. Answer only one of: Supported, Unsupported, or Uncertain."
SUPPORT_QUESTION = "Is the following claim supported by the chest X-ray? Claim: "

# Answer words, and the white space that a blank response may consist of.
ANSWER_OF = {"yes": "Yes", "no": "No", "uncertain": "Uncertain", "supported": "Supported", "unsupported": "Unsupported"}
BLANK = r"^[\x09-\x0d\x1c-\x1f\x85\p{Z}]*\z"
NOT_WORD = r"[^\p{L}\p{N}_]+"


def truthy(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c, F.lit("")) != ""


def finding_claim(finding: Column, positive: Column, anatomy: Column | None = None) -> Column:
    verb = F.when(positive, F.lit("There is evidence of ")).otherwise(F.lit("There isn't evidence of "))
    return F.concat(verb, finding, F.lit(".")) if anatomy is None else F.concat(verb, finding, F.lit(" in the "), anatomy, F.lit("."))


def support_question(claim: Column) -> Column:
    return F.concat(F.lit(SUPPORT_QUESTION), claim)


def finding_question(finding: Column, anatomy: Column | None = None) -> Column:
    if anatomy is None:
        return F.concat(F.lit("Is there evidence of "), finding, F.lit(" in this chest X-ray?"))
    return F.concat(F.lit("Is there evidence of "), finding, F.lit(" in the "), anatomy, F.lit("?"))


def template_id(probe: Column) -> Column:
    return F.when(probe.eqNullSafe("H2"), F.lit(SUPPORT_ID)).otherwise(F.lit(YES_NO_ID))


def render_prompt(probe: Column, question: Column) -> Column:
    return F.concat(F.when(probe.eqNullSafe("H2"), F.lit(SUPPORT_SYSTEM)).otherwise(F.lit(YES_NO_SYSTEM)), F.lit(" Question: "), question)


def label_parts(raw: Column) -> Column:
    """struct<category, polarity, label_name>; three nulls unless there are three parts and none is blank."""
    names = ("category", "polarity", "label_name")
    ok = lambda p: (F.size(p) == 3) & F.forall(p, lambda x: ~F.regexp_like(x, F.lit(BLANK)))
    # a list of one, so that the label is split once
    taken = F.filter(F.array(F.split(raw, r"\|", 3)), ok)
    return F.struct(*(F.get(F.get(taken, F.lit(0)), F.lit(i)).alias(n) for i, n in enumerate(names)))


def parse_answer(raw: Column) -> Column:
    """struct<parsed_answer, parse_status> of a raw response."""
    words = F.filter(F.split(F.lower(raw), NOT_WORD), lambda w: w.isin(*ANSWER_OF))
    kinds = F.array_distinct(words)
    answers = F.create_map(*(F.lit(x) for kv in ANSWER_OF.items() for x in kv))
    empty = F.coalesce(F.regexp_like(raw, F.lit(BLANK)), F.lit(True))
    status = F.when(empty, "empty_response").when(F.size(kinds) == 0, "invalid_format").when(F.size(kinds) > 1, "multiple_answers").otherwise("success")
    return F.struct(F.when(status == "success", F.element_at(answers, F.get(kinds, F.lit(0)))).alias("parsed_answer"), status.alias("parse_status"))


def safe_rate(n: Column, d: Column, digits: int | None = None) -> Column:
    rate = F.when(d != 0, F.coalesce(n, F.lit(0)) / d)
    return rate if digits is None else F.round(rate, digits)


def resolve_path(path: Column, root: str | None) -> Column:
    return path if not root else F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def relative_image_path(subject: Column, study: Column, dicom: Column) -> Column:
    return F.concat(F.lit("p"), F.substring(subject, 1, 2), F.lit("/p"), subject, F.lit("/s"), study, F.lit("/"), dicom, F.lit(".jpg"))


def run_label(run: Column, group: Column) -> Column:
    return F.concat(run, F.lit(":"), group)


def string_or_null(c: Column, kind: str) -> Column:
    """A value as text, null for null; booleans as True and False (SCL20)."""
    return F.initcap(c.cast("string")) if kind == "boolean" else c.cast("string")


def first_non_null(*values: Column) -> Column:
    return F.coalesce(*values)
