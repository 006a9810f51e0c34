"""Quality rules whose cutoffs carry a guarantee on good documents that they reject.

Six signals get a cutoff each; a fixed sequence of such sets of cutoffs goes from lenient to strict. On labelled
good documents, the false rejections by all signals of a set together are a binomial count; the exact tail
P(Bin(n, risk) <= k) tests "the set rejects more than `risk` of the good". In each stratum the sets are tested
in order, and the first that fails ends the sequence (fixed-sequence testing needs no correction within it);
strata share the error level by Bonferroni. What is guaranteed, with a chance of 1 - error for all strata at
once: of a stratum's good documents that pass the base rules, equal texts counted once, the signals reject no
more than its risk. A stratum's risk is the first of RISKS that its number of good documents can certify at all,
chosen before any rejection is counted; strata too small for the last have the base rules alone.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD_BREAKS, materialize

#: Words of a window, and the base rules' limits.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: The shares of good documents that all rules together may reject, by the size of the stratum, and the chance that the guarantee fails.
RISKS, ERROR = (0.02, 0.05, 0.1, 0.2), 0.05
#: Signals (a high value is bad) and their cutoffs in each set of the sequence, most lenient first.
SEQUENCE = {
    "symbols": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2],
    "repeats": [0.29, 0.28, 0.26, 0.24, 0.22, 0.2, 0.17, 0.14, 0.11, 0.08],
    "doubled": [0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08],
    "capitals": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2],
    "long_words": [20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.5, 11.0, 10.0],
}
SETS = len(SEQUENCE["symbols"])


def features(df: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str | None = "lang") -> DataFrame:
    """doc_id, stratum, a text key, the counts of the base rules, and the signals; one row per document.

    Words are runs between white space (space, \\t to \\r). Null texts count as empty: all counts 0. Whole
    texts are measured inside the row, without a shuffle; extra columns are ignored.
    """
    t = df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[stratum].cast("string") if stratum else F.lit(None), F.lit("und")).alias("stratum"),
        F.coalesce(df[text], F.lit("")).alias("t"),
    )
    t = t.withColumn("w", F.array_remove(F.split("t", WORD_BREAKS), "")).withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    t = t.select(
        "doc_id", "stratum", F.xxhash64("t", F.length("t")).alias("text_key"), F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).alias("_upper"),
        F.size("l").alias("_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    h = F.col("h")
    windows = F.when(
        F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    ).otherwise(F.array().cast("array<bigint>"))
    t = t.withColumn("_doubled", F.size(F.filter(h, lambda x, i: x.eqNullSafe(F.get(h, i - 1))))).withColumn("win", windows).drop("h")
    repeated = F.size(F.array_distinct("win")) < F.size("win")
    t = t.withColumn("s", F.when(repeated, F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("win")
    s = F.col("s")
    same = lambda e, k: F.get(s, k)["x"].eqNullSafe(e["x"])
    at = F.array_sort(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))
    t = t.withColumn("p", at).drop("s")
    p = F.col("p")
    covered = F.when(
        F.size(p) > 1,
        F.lit(WINDOW).cast("long")
        + F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0).cast("long"), lambda a, k: a + F.least(F.lit(WINDOW), F.get(p, k) - F.get(p, k - 1))),
    ).otherwise(F.lit(0).cast("long"))
    t = t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return t.select(
        "doc_id", "stratum", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        over("n_symbols", "word_chars").alias("symbols"), over("n_dup_lines", "_lines").alias("dup_lines"),
        over("n_repeat_words", "n_words").alias("repeats"), over("_doubled", "n_words").alias("doubled"),
        over("_upper", "word_chars").alias("capitals"), over("word_chars", "n_words").alias("long_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed term by term in logarithms."""
    if k >= n:
        return 1.0
    term = n * math.log1p(-p)
    total, ratio = 0.0, math.log(p) - math.log1p(-p)
    for i in range(k + 1):
        total += math.exp(term)
        if i > n * p and total > 1 - 1e-12:
            break
        term += math.log((n - i) / (i + 1)) + ratio
    return min(1.0, total)


def certify(n: int, rejected: list[int], risk: float, level: float) -> int:
    """How many sets of the sequence, most lenient first, are certified to reject at most `risk` of the good."""
    for i, k in enumerate(rejected):
        if k > risk * n or binomial_tail(k, n, risk) > level:
            return i
    return len(rejected)


def risk_of(n: int, risks: tuple[float, ...], level: float) -> float | None:
    """The first risk that n good documents without a rejection would certify."""
    return next((r for r in risks if certify(n, [0], r, level)), None)


def cutoffs(measured: DataFrame, good: DataFrame, risks: tuple[float, ...] = RISKS, error: float = ERROR) -> dict[str, tuple[float, int]]:
    """The risk of each stratum that can certify one, and how many sets are certified.

    good: doc_ids labelled good. All of them count, equal texts once, since copies are no independent trials;
    those that fail the base rules don't. One row of counts for each stratum reaches the driver. Every stratum is
    tested on its own documents alone.
    """
    labelled = measured.where(~base_failed()).join(good.select("doc_id").distinct(), "doc_id", "left_semi")
    beyond = lambda i: reduce(lambda a, b: a | b, [F.col(s) > c[i] for s, c in SEQUENCE.items()])
    hits = [F.sum(beyond(i).cast("long")).alias(f"k{i}") for i in range(SETS)]
    rows = {r["stratum"]: r for r in labelled.dropDuplicates(["stratum", "text_key"]).groupBy("stratum").agg(F.count("*").alias("n"), *hits).collect()}
    level = error / max(len(rows), 1)
    chosen = {z: risk_of(r["n"], risks, level) for z, r in rows.items()}
    return {z: (risk, certify(rows[z]["n"], [rows[z][f"k{i}"] or 0 for i in range(SETS)], risk, level)) for z, risk in chosen.items() if risk is not None}


def apply_cutoffs(measured: DataFrame, found: dict[str, tuple[float, int]]) -> DataFrame:
    """Adds risk (null: base rules alone), base_failed, rules_failed (signals beyond their cutoff) and kept."""
    of = lambda k, other: F.coalesce(*(F.when(F.col("stratum") == z, v[k]) for z, v in sorted(found.items())), other)
    sets = of(1, F.lit(0))
    measured = measured.withColumn("risk", of(0, F.lit(None).cast("double")))
    failed = [F.when((sets > 0) & (F.col(s) > F.get(F.array(*map(F.lit, c)), sets - 1)), F.lit(s)) for s, c in SEQUENCE.items()]
    out = measured.withColumn("base_failed", base_failed()).withColumn("rules_failed", F.array_compact(F.array(*failed)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rules_failed") == 0))


def quality_rules(df: DataFrame, labels: DataFrame, stratum: str | None = "lang", risks: tuple[float, ...] = RISKS, error: float = ERROR) -> DataFrame:
    """Counts, signals and verdict of every document.

    labels: doc_id, quality (1: good; other values and nulls are not used; a document with both labels counts
    as good). Null strata are one stratum, "und"; strata with too few good documents to certify any of the risks
    have the base rules alone, and a null risk. Null and empty texts fail the base rules;
    very long ones are measured whole. Repeated rows give repeated results; empty tables an empty one; columns
    of df other than id, text and stratum are ignored.
    """
    measured = materialize(features(df, stratum=stratum))
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id"))
    return apply_cutoffs(measured, cutoffs(measured, good, risks, error)).drop("text_key")


def oracle() -> str:
    """The query op1_quality_rules for DuckDB, over documents and labels."""
    names = list(SEQUENCE)
    steps = ", ".join(f"({i}, {', '.join(str(SEQUENCE[s][i]) for s in names)})" for i in range(SETS))
    beyond = " or ".join(f"f.{s} > q.{s}" for s in names)
    tail = "(select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(risk) + (n - i) * ln(1 - risk))) from (select unnest(range(k + 1)) i))"
    return rf"""
with d as (select doc_id, coalesce(lang, 'und') stratum, coalesce(text, '') t from documents),
s as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
texts as (select distinct t, w from s where len(w) >= {WINDOW}),
windows as (select t, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i : i + {WINDOW - 1}], ' '))) win, unnest(range(len(w) - {WINDOW - 1})) i from texts),
twice as (select t, i, i - lag(i) over (partition by t order by i) gap from (select t, i, count(*) over (partition by t, win) c from windows) where c > 1),
repeats as (select t, sum(coalesce(least(gap, {WINDOW}), {WINDOW})) n from twice group by t),
c as (
  select doc_id, stratum, s.t, len(w) n_words, length(array_to_string(w, '')) word_chars, length(regexp_replace(s.t, '[^#*$%&|<>]', '', 'g')) n_symbols,
         len(l) - len(list_distinct(l)) n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words, len(l) lines,
         length(regexp_replace(s.t, '\P{{Lu}}', '', 'g')) upper, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) twice_over
  from s left join repeats r on s.t = r.t),
f as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed,
         coalesce(n_symbols / nullif(word_chars, 0), 0) symbols, coalesce(n_dup_lines / nullif(lines, 0), 0) dup_lines, coalesce(n_repeat_words / nullif(n_words, 0), 0) repeats,
         coalesce(twice_over / nullif(n_words, 0), 0) doubled, coalesce(upper / nullif(word_chars, 0), 0) capitals, coalesce(word_chars / nullif(n_words, 0), 0) long_words
  from c),
q(step, {', '.join(names)}) as (values {steps}),
good as (select f.* from f where not base_failed and doc_id in (select doc_id from labels where quality = 1)),
one as (select distinct on (stratum, t) * from good),
counts as (select f.stratum, step, count(*) n, count_if({beyond})::bigint k from one f, q group by all),
level as (select {ERROR} / count(distinct stratum) a from good),
risks as (select stratum, n, a, list_filter([{', '.join(map(str, RISKS))}], lambda r: pow(1 - r, n) <= a)[1]::double risk from (select distinct stratum, n from counts), level),
tests as (select stratum, step, risk, k > risk * n or {tail} > a fails from counts join risks using (stratum, n) where risk is not null),
found as (select stratum, risk, coalesce(min(step) filter (fails), {SETS}) sets from tests group by stratum, risk),
judged as (
  select f.*, found.risk, array_to_string([x for x in [{', '.join(f"case when f.{s} > q.{s} then '{s}' end" for s in names)}] if x is not null], ',') rules_failed
  from f left join found on f.stratum = found.stratum left join q on q.step = found.sets - 1)
select doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(rules_failed, '') rules_failed, risk,
       not base_failed and coalesce(rules_failed, '') = '' kept
from judged"""
