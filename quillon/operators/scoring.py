"""Answers, the score decision table and summaries (SCL8-SCL11, AGG8-AGG10, EXT1, RPT1-RPT3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import parse_answer, safe_rate
from quillon.schemas import SCORED, conform

GROUPINGS = {"overall": None, "by_granularity": "granularity", "by_hallucination_probe": "hallucination_probe", "by_answer_label": "answer_label"}
METRICS = [
    "items", "scored_items", "correct", "accuracy", "h1_count", "h1_false_positive_count", "h1_false_negative_count", "h2_count", "invalid_count",
    "manual_review_count", "uncertain_or_abstention_count",
]
RATES = {"h1_rate": "h1_count", "h2_rate": "h2_count", "invalid_rate": "invalid_count", "abstention_rate": "uncertain_or_abstention_count"}


def parse_responses(responses: DataFrame) -> DataFrame:
    return responses.withColumn("_p", parse_answer(F.col("raw_response"))).withColumn("parsed_answer", F.col("_p.parsed_answer")).withColumn("parse_status", F.col("_p.parse_status")).drop("_p")


def status_histogram(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("parse_status").agg(F.count("*").alias("n"))


def decision(label: Column, answer: Column, status: Column) -> Column:
    """The decision table as one struct; rows are tried from the top."""

    def row(score, correct, relation, kind=None, direction=None, category=None, review=False):
        text = lambda v, n: (F.lit(v) if isinstance(v, str) or v is None else v).cast("string").alias(n)
        return F.struct(
            text(score, "score"), F.lit(correct).cast("boolean").alias("is_correct"), text(kind, "hallucination_type"), text(direction, "h1_error_direction"),
            text(relation, "evidence_relation"), text(category, "error_category"), F.lit(review).alias("requires_manual_review"),
        )

    sides = ["Yes", "No", "Supported", "Unsupported"]
    is_ = lambda a, b: (label == a) & (answer == b)
    return (
        F.when(~status.eqNullSafe("success") | answer.isNull(), row("invalid_response", False, "U_uncertain"))
        .when(label == answer, row("correct", True, F.when(label == "Unsupported", "S0_unsupported").otherwise("S2_directly_supported")))
        .when(is_("No", "Yes"), row("H1_evidence_contradicted", False, "S-1_contradicted", "H1", "false_positive"))
        .when(is_("Yes", "No"), row("H1_evidence_contradicted", False, "S-1_contradicted", "H1", "false_negative"))
        .when(is_("Unsupported", "Supported"), row("H2_evidence_unsupported", False, "S0_unsupported", "H2"))
        .when(is_("Supported", "Unsupported"), row("incorrect_non_hallucination", False, "S0_unsupported", category="unsupported_rejection"))
        .when(label.isin(*sides) & (answer == "Uncertain"), row("uncertain_or_abstention", False, "U_uncertain"))
        .when((label == "Uncertain") & answer.isin(*sides), row("requires_manual_review", None, "U_uncertain", category="uncertain_case", review=True))
        .otherwise(row("requires_manual_review", None, "U_uncertain", review=True))
    )


def score_responses(parsed: DataFrame) -> DataFrame:
    return conform(parsed.withColumn("_d", decision(F.col("answer_label"), F.col("parsed_answer"), F.col("parse_status"))).select("*", "_d.*").drop("_d"), SCORED)


def metric_columns(rounded: bool = False) -> list[Column]:
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    fp, fn = F.col("h1_error_direction") == "false_positive", F.col("h1_error_direction") == "false_negative"
    correct, scored = n(F.col("is_correct")), F.count("is_correct")
    return [
        F.count("*").alias("items"), scored.alias("scored_items"), correct.alias("correct"), safe_rate(correct, scored, 6 if rounded else None).alias("accuracy"),
        (n(fp) + n(fn)).alias("h1_count"), n(fp).alias("h1_false_positive_count"), n(fn).alias("h1_false_negative_count"), n(F.col("hallucination_type") == "H2").alias("h2_count"),
        n(F.col("score") == "invalid_response").alias("invalid_count"), n(F.col("requires_manual_review")).alias("manual_review_count"), n(F.col("score") == "uncertain_or_abstention").alias("uncertain_or_abstention_count"),
    ]


def summarize(scored: DataFrame, run_name: str | None = None) -> DataFrame:
    """group_type, group and the metrics over (), granularity, probe and label, in one pass; null groups are "None".

    The row over everything is there even without input.
    """
    names = [g for g in GROUPINGS.values() if g]
    keyed = scored.select("*", *(F.coalesce(F.col(g), F.lit("None")).alias(f"k_{g}") for g in names))
    cols = [F.col(f"k_{g}") for g in names]
    out = keyed.groupingSets([[], *([c] for c in cols)], *cols).agg(F.grouping_id().alias("_g"), *metric_columns())
    kind = F.when(F.col("_g") == 7, "overall").when(F.col("_g") == 3, "by_granularity").when(F.col("_g") == 5, "by_hallucination_probe").otherwise("by_answer_label")
    out = out.select(kind.alias("group_type"), F.coalesce(*cols, F.lit("overall")).alias("group"), *METRICS)
    spark: SparkSession = scored.sparkSession
    zero = spark.createDataFrame([("overall", "overall")], "group_type string, group string").alias("z")
    counts = [m for m in METRICS if m != "accuracy"]
    always = zero.join(out.alias("o").where("group_type = 'overall'"), F.col("o.group_type") == F.col("z.group_type"), "left").select(
        "z.group_type", "z.group", *(F.coalesce(f"o.{m}", F.lit(0)).cast("long").alias(m) if m in counts else F.col(f"o.{m}") for m in METRICS)
    )
    out = out.where("group_type <> 'overall'").unionByName(always)
    return out if run_name is None else out.select(F.lit(run_name).alias("run_name"), "*")


def with_rates(summary: DataFrame) -> DataFrame:
    return summary.select("*", *(safe_rate(F.col(c), F.col("items")).alias(r) for r, c in RATES.items()))


def answered_metrics(scored: DataFrame, key: str = "granularity") -> DataFrame:
    """Metrics over answered items: neither invalid nor abstained."""
    invalid, abstain = F.col("score") == "invalid_response", F.col("score") == "uncertain_or_abstention"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    g = scored.groupBy(key).agg(
        F.count("*").alias("n_total"), n(abstain).alias("n_abstain"), n(invalid).alias("n_invalid"), F.count_if(~invalid & ~abstain).alias("n_answered"), n(F.col("is_correct")).alias("n_correct"),
        n(F.col("hallucination_type") == "H1").alias("n_h1"), n(F.col("hallucination_type") == "H2").alias("n_h2"),
    )
    r = lambda a, b, name: safe_rate(F.col(a), F.col(b)).alias(name)
    return g.select(
        key, "n_abstain", "n_invalid", "n_answered", r("n_answered", "n_total", "coverage"), r("n_abstain", "n_total", "abstention_rate"), r("n_correct", "n_answered", "answered_accuracy"),
        r("n_h1", "n_total", "h1_rate_total"), r("n_h2", "n_total", "h2_rate_total"), r("n_h1", "n_answered", "h1_rate_answered"), r("n_h2", "n_answered", "h2_rate_answered"),
    )


def summary_dict(summary: DataFrame) -> dict:
    """The nested summary of a few dozen rows; rates are rounded here, in decimal-exact Python."""
    out: dict = {"overall": {}, **{g: {} for g in list(GROUPINGS)[1:]}}
    for r in sorted(summary.collect(), key=lambda r: (r["group_type"], r["group"])):
        row = {m: r[m] for m in METRICS}
        row["accuracy"] = None if row["accuracy"] is None else round(row["correct"] / row["scored_items"], 6)
        if r["group_type"] == "overall":
            out["overall"] = row
        else:
            out[r["group_type"]][r["group"]] = row
    return out
