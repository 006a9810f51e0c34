"""Deterministic balanced sampling by hash rank (SMP1, SMP2, WIN4, JN9)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.ids import stable_id
from quillon.sources.scratch import materialize


def quotas(positive: int, negative: int, negative_fraction: float) -> tuple[int, int]:
    """How many of each label to keep for the target share of negatives; exact rational arithmetic."""
    if not 0 < negative_fraction < 1:
        raise ValueError("the share of negatives has to lie above 0 and below 1")
    share = Fraction(str(negative_fraction)).limit_denominator(1000)
    if not 0 < share < 1:
        raise ValueError("the share of negatives rounds to 0 or 1")
    ratio = share / (1 - share)
    return max(1, min(positive, int(negative / ratio))), max(1, min(negative, int(positive * ratio)))


#: Hex digits of a rank by which rows are counted before the cut is looked for: 65,536 rows at most.
PREFIX = 4


def cut(ranked: DataFrame, quota: int) -> str:
    """The rank of the quota-th row of (_rank).

    A histogram of rank prefixes finds the prefix, and only that prefix's ranks are counted and put in order.
    """
    at = len("sample_") + 1
    prefix = F.substring("_rank", at, PREFIX)
    before = 0
    for p, n in sorted((r["p"], r["n"]) for r in ranked.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()):
        if before + n >= quota:
            break
        before += n
    own = ranked.where(prefix == p).groupBy("_rank").agg(F.count("*").alias("_n")).select("_rank", F.sum("_n").over(Window.orderBy("_rank")).alias("_upto"))
    return own.where(F.col("_upto") >= quota - before).agg(F.min("_rank")).first()[0]


def balance_summary(before: tuple[int, int], positive: str = "Supported", negative: str = "Unsupported", negative_fraction: float = 0.8, seed: int = 42) -> dict:
    """What balancing so many rows of the two labels does."""
    summary = {
        "positive_label": positive, "negative_label": negative, "target_negative_fraction": negative_fraction, "sampling_seed": seed,
        "positive_before": before[0], "negative_before": before[1],
    }
    if not all(before):
        return summary | {"balance_applied": False, "balance_reason": "single_label_or_empty", "positive_after": before[0], "negative_after": before[1], "excluded_by_ratio": 0}
    keep = quotas(*before, negative_fraction)
    return summary | {
        "balance_applied": True, "balance_reason": "target_fraction_downsample", "positive_after": keep[0], "negative_after": keep[1], "excluded_by_ratio": sum(before) - sum(keep),
    }


def balance(items: DataFrame, positive: str = "Supported", negative: str = "Unsupported", negative_fraction: float = 0.8, seed: int = 42, any_text: bool = True, one_label: bool = False) -> tuple[DataFrame, dict]:
    """Downsample two labels to the target share. Rows of other labels stay; so does all if a label is absent.

    An item is kept if its id is among the first of its label by hash; rows that share a kept id all stay. Items
    are made once, in a table of their own; ranks are made where they are compared, for the labels that are cut.
    Kept rows are found without a join unless some id stands under several labels, which is looked for by the ids'
    hashes. one_label: the caller knows that no id does; nothing but counts is then shuffled.
    """
    quotas(1, 1, negative_fraction)
    items = materialize(items, codec="zstd")  # they are read for the ranks and for the result, and took joins to make
    label = F.when(F.col("answer_label").isin(positive, negative), F.col("answer_label"))
    rank = lambda of: stable_id("sample", {"seed": seed, "label": of, "item_id": F.col("item_id")}, any_text)
    seen = {r["_label"]: r["n"] for r in items.groupBy(label.alias("_label")).agg(F.count("*").alias("n")).collect()}
    before = seen.get(positive, 0), seen.get(negative, 0)
    summary = balance_summary(before, positive, negative, negative_fraction, seed)
    if not summary["balance_applied"]:
        return items, summary
    after = summary["positive_after"], summary["negative_after"]
    last = {of: cut(items.where(F.col("answer_label") == of).select(rank(F.col("answer_label")).alias("_rank")), quota) for of, n, quota in zip((positive, negative), before, after, strict=True) if quota < n}
    within = F.coalesce(*(F.when(F.col("answer_label") == z, rank(F.col("answer_label")) <= c) for z, c in last.items()), F.lit(True))
    if one_label or _one_label(items, label):
        return items.where(within), summary
    kept = items.where(within).select(F.col("item_id").alias("_id")).distinct()
    return items.join(kept, F.col("item_id").eqNullSafe(F.col("_id")), "left_semi"), summary


def _one_label(items: DataFrame, label: Column) -> bool:
    """Whether no id stands under several labels; hashes that meet by chance give False, which is slower but as right."""
    named = items.select(F.xxhash64("item_id").alias("_id"), F.coalesce(label, F.lit("")).alias("_label"))
    return named.groupBy("_id").agg(F.min("_label").alias("a"), F.max("_label").alias("b")).where("a <> b").isEmpty()


def first_of_each(df: DataFrame, label: str, k: int, seed: int, id_col: str = "item_id", any_text: bool = True) -> DataFrame:
    """The first k rows of each label by hash rank (EXT13)."""
    rank = stable_id("sample", {"seed": seed, "label": F.col(label), "item_id": F.col(id_col).cast("string")}, any_text)
    w = Window.partitionBy(label).orderBy("_rank", id_col)
    return df.withColumn("_rank", rank).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_rank", "_k")
