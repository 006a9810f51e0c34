"""Secrets in texts: fixed patterns, and a test of long tokens by two character Markov models.

One first-order model is trained on random strings, the other on ordinary identifiers; a token is a secret if
its log-likelihood ratio per character speaks for random. All on built-in column functions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The base kinds in their order, with their patterns.
KEY = r"(?i:password|passwd|secret|token|api_?key)"
KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = KEY + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 or more in all; a shorter run has no match inside it either
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]
SHORTEST_VALUE = 12

#: Tokens that the models judge: runs of these characters, of this length or longer.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: The characters of the models; any other counts as the last one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Log-likelihood ratio per character from which a token is taken for random.
CUTOFF = 0.7
#: The same for tokens without a digit, as names in capitals are unlike the training words too; and their least
#: number of different characters, as the models take a ruled line for random.
LETTERS_CUTOFF, LETTERS_VARIETY = 2.0, 6
#: The most labelled rows of each class that the models are trained on (the bound of the sample).
SAMPLE = 5000


#: Matches that are placed together; a text's places are summed within such groups, then over them.
TOGETHER = 256


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often a lambda in f refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def spans_of(t: Column, pattern: str, kind: int, possible: Column | None = None) -> Column:
    """array<struct<start, kind, end, found>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The text between matches and the matches themselves alternate, so their lengths add up to the places.
    possible: a quicker condition without which there is no match.
    """
    parts = F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"), F.transform(F.split(t, pattern, -1), F.length).alias("gaps"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")

    def step(v: Column, acc: Column, i: Column) -> Column:
        start = acc["at"] + F.get(v["gaps"], i)
        end = start + F.length(F.get(v["found"], i))
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.get(v["found"], i).alias("found"))).alias("out"))

    def group(v: Column, acc: Column, g: Column) -> Column:
        last = F.least((g + 1) * TOGETHER, F.size(v["found"])) - 1
        own = F.aggregate(F.sequence(g * TOGETHER, last), F.struct(acc["at"].alias("at"), none.alias("out")), lambda a, i: step(v, a, i))
        return let(own, lambda o: F.struct(o["at"].alias("at"), F.array_append(acc["out"], o["out"]).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,kind:int,end:int,found:string>>>").alias("out"))
    walked = let(parts, lambda v: F.flatten(F.aggregate(F.sequence(F.lit(0), ((F.size(v["found"]) - 1) / TOGETHER).cast("int")), zero, lambda acc, g: group(v, acc, g))["out"]))
    some = F.regexp_like(t, F.lit(pattern))
    return F.when(some if possible is None else possible & some, walked).otherwise(none)


def long_enough(spans: Column) -> Column:
    """Assignments whose value has SHORTEST_VALUE characters; the others consume their text all the same."""
    return F.filter(spans, lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= SHORTEST_VALUE)


def _code(c: Column) -> Column:
    at = F.instr(F.lit(ALPHABET), c)
    return F.when(at > 0, at - 1).otherwise(len(ALPHABET) - 1)


def transitions(tokens: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of neighbouring character codes in the column `token`: at most len(ALPHABET)**2 rows. Equal tokens are cut up once."""
    chars = tokens.groupBy("token").agg(F.count("*").alias("times")).select("times", F.array_remove(F.split("token", ""), "").alias("c"))
    pairs = chars.where("size(c) > 1").select("times", F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b"))).alias("p"))
    rows = pairs.groupBy("p.a", "p.b").agg(F.sum("times").alias("n")).groupBy(_code(F.col("a")).alias("a"), _code(F.col("b")).alias("b")).agg(F.sum("n").alias("n")).collect()
    return {(r["a"], r["b"]): r["n"] for r in rows}


def log_model(counts: dict[tuple[int, int], int], smooth: float = 0.5) -> list[float]:
    k = len(ALPHABET)
    out = []
    for a in range(k):
        row = [counts.get((a, b), 0) + smooth for b in range(k)]
        out += [math.log(v / sum(row)) for v in row]
    return out


def random_tokens(spark, rows: int) -> DataFrame:
    """Labelled random strings: digests written in hexadecimal, base 64, and capitals with digits."""
    ids = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 256)
    n = (16 + F.conv(F.substring(digest, 63, 2), 16, 10).cast("int") % 17).cast("int")
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "x")
    kind = F.col("id") % 3
    return ids.select(F.substring(F.when(kind == 0, digest).when(kind == 1, base64).otherwise(F.upper(base64)), F.lit(1), n).alias("token"))


def learn(df: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text: str = "text") -> list[float]:
    """The log-likelihood ratio of every pair of characters, random against ordinary.

    Two labelled samples. Random: `sample` generated strings. Ordinary: the words, and pairs of words joined as
    identifiers, of at most `sample` documents (by a hash of the id) outside the base patterns' matches; of
    several texts under an id the smallest. Rows without an id or a text are left out.
    """
    own = df.select(df[id_col].cast("string").alias("_id"), df[text].alias("_t")).where("_id is not null and _t is not null")
    ranked = own.select("_id", F.md5("_id").alias("_h")).orderBy("_h").limit(sample).select("_id").distinct()
    docs = own.join(F.broadcast(ranked), "_id", "left_semi").groupBy("_id").agg(F.min("_t").alias("t"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = docs.select(F.regexp_extract_all(clean, F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    joined = words.select(F.explode(F.transform("w", lambda x, i: F.when(i % 3 == 0, x).when(i % 3 == 1, F.concat(x, F.lit("_"), F.coalesce(F.get(F.col("w"), i + 1), F.lit("id")))).otherwise(F.concat(x, F.initcap(F.coalesce(F.get(F.col("w"), i + 1), F.lit("id"))))))).alias("token"))
    ordinary = log_model(transitions(joined))
    random = log_model(transitions(random_tokens(df.sparkSession, sample)))
    return [round(a - b, 4) for a, b in zip(random, ordinary, strict=True)]


def ratio(token: Column, model: Column) -> Column:
    """Mean log-likelihood ratio per pair of neighbouring characters, in one pass over them."""
    k = len(ALPHABET)
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, x: let(_code(x), lambda c: F.struct(
        c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(model, acc["last"] * k + c))).alias("sum"),
    ))
    return F.aggregate(F.array_remove(F.split(token, ""), ""), zero, step)["sum"] / (F.length(token) - 1)


def find_secrets(df: DataFrame, model: list[float], id_col: str = "doc_id", text: str = "text", cutoff: float = CUTOFF, base_spans: str = "base_spans", spans: str = "spans") -> DataFrame:
    """All columns of df plus base_spans and spans: array<struct<start, kind, end, found>>, by start, then kind.

    Base spans are kept whatever the models say; the models add tokens that no base span holds whole, so that
    the rest of a longer secret is covered too. Tokens without a digit need a higher ratio. Null texts count as
    empty and have no spans; very long texts are scanned whole; repeated rows give repeated results; an empty
    table an empty one. Columns of df under the two
    result names, and those with _run or _key after the second, are replaced; other names may be given.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = let(F.lower(t), lambda low: F.exists(F.array(*(F.lit(w) for w in KEYWORDS)), lambda w: F.contains(low, w)))
    run, key = f"{spans}_run", f"{spans}_key"
    long_run = F.col(run)  # every match of the two fixed patterns lies in such a run
    out = df.drop(base_spans, spans, run, key).withColumn(run, F.regexp_like(t, F.lit(TOKEN))).withColumn(key, keyed)
    out = out.withColumn(
        base_spans, F.array_sort(F.concat(long_enough(spans_of(t, ASSIGN, 0, F.col(key))), spans_of(t, ACCESS, 1, long_run & F.contains(t, F.lit("AKIA"))), spans_of(t, HEX, 2, long_run)))
    )
    base = F.col(base_spans)
    llr = F.lit(np.array(model))
    digit = lambda s: s["found"].rlike("[0-9]")
    varied = lambda s: F.size(F.array_distinct(F.array_remove(F.split(s["found"], ""), ""))) >= LETTERS_VARIETY
    more = F.filter(
        spans_of(t, TOKEN, 3, long_run),
        lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])) & (digit(s) | varied(s))
        & (ratio(s["found"], llr) > F.when(digit(s), F.lit(cutoff)).otherwise(F.lit(max(cutoff, LETTERS_CUTOFF)))),
    )
    return out.withColumn(spans, F.array_sort(F.concat(base_spans, more))).drop(run, key)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of a part that a text is cut into before parts of it are taken, and spans that are put together at once.
PART, SPANS = 4096, 256


def _between(parts: Column, a: Column, b: Column) -> Column:
    """The text from a to b, from its parts of PART characters: only the parts at both ends are searched."""
    i, j = F.floor(a / PART).cast("int"), F.floor(b / PART).cast("int")
    long = F.concat(F.substr(F.get(parts, i), a % PART + 1), F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(F.coalesce(F.get(parts, j), F.lit("")), F.lit(1), b % PART))
    return F.when(i == j, F.substr(F.coalesce(F.get(parts, i), F.lit("")), a % PART + 1, b - a)).otherwise(long)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones together, replaced by the mark. spans: in order of their start.

    The time follows the length and the number of spans: the text is cut into parts once, and blocks of spans are
    put together by themselves, each knowing how far the spans before it reach.
    """
    ends = lambda s: F.coalesce(F.array_max(F.transform(s, lambda x: x["end"])), F.lit(0))

    def pieces(parts: Column, k: Column) -> Column:
        zero = F.struct(ends(F.slice(spans, 1, k * SPANS)).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.slice(spans, k * SPANS + 1, SPANS), zero, lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"), F.concat(acc["out"], F.array(_between(parts, acc["at"], s["start"]), F.lit(mark))).alias("out"),
        )).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))), lambda acc: acc["out"])

    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / SPANS).cast("int"))
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    whole = let(cut, lambda parts: F.concat(
        F.array_join(F.flatten(F.transform(blocks, lambda k: pieces(parts, k))), ""), _between(parts, ends(spans), F.greatest(F.length(text), ends(spans))),
    ))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def oracle() -> str:
    """The query op8_secret_scans for DuckDB, over documents whose ids are distinct: samples, models and spans."""
    k = len(ALPHABET)
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    code = lambda c: f"(case when instr({quote(ALPHABET)}, {c}) > 0 then instr({quote(ALPHABET)}, {c}) - 1 else {k - 1} end)"
    names = "[" + ", ".join(map(quote, KINDS)) + "]"

    def spans(pattern: str, kind: int) -> str:
        return (
            f"(select r, {kind} kind, m, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(gaps[1 : i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x)))::bigint, 0)) starts"
            f" from (select r, regexp_extract_all(t, {quote(pattern)}) m, string_split_regex(t, {quote(pattern)}) gaps from d) where len(m) > 0)"
        )

    def model(tokens: str) -> str:
        return (
            f"(select z.a, z.b, ln((coalesce(n, 0) + 0.5) / (sum(coalesce(n, 0)) over (partition by z.a) + 0.5 * {k})) v from (select * from range({k}) x(a), range({k}) y(b)) z left join"
            f" (select {code('c1')} a, {code('c2')} b, count(*) n from (select unnest(list_transform(range(1, length(token)), lambda i: token[i])) c1, unnest(list_transform(range(1, length(token)), lambda i: token[i + 1])) c2 from {tokens}) group by all) x on x.a = z.a and x.b = z.b)"
        )

    digest = "sha256('random string ' || id)"
    clean = "t"
    for pattern in (ASSIGN, ACCESS, HEX):
        clean = f"regexp_replace({clean}, {quote(pattern)}, ' ', 'g')"
    word = "case when (i - 1) % 3 = 0 then w[i] when (i - 1) % 3 = 1 then w[i] || '_' || coalesce(w[i + 1], 'id') else w[i] || upper(coalesce(w[i + 1], 'id')[1]) || lower(coalesce(w[i + 1], 'id')[2:]) end"
    return f"""
with d as (select doc_id, row_number() over () r, coalesce(text, '') t from documents),
generated as (
  select case id % 3 when 0 then {digest} when 1 then b else upper(b) end s, 16 + ('0x' || substr({digest}, 63, 2))::int % 17 n
  from (select id, regexp_replace(to_base64(unhex({digest})), '[+/=]', 'x', 'g') b from range({SAMPLE}) x(id))),
random as (select substr(s, 1, n) token from generated),
chosen as (select regexp_extract_all({clean}, '[A-Za-z]{{2,}}') w from (select text t from documents where text is not null order by md5(cast(doc_id as varchar)) limit {SAMPLE})),
ordinary as (select unnest(list_transform(range(1, len(w) + 1), lambda i: {word})) token from chosen),
llr as (select list(round(x.v - y.v, 4) order by x.a, x.b) l from {model('random')} x join {model('ordinary')} y on x.a = y.a and x.b = y.b),
s as materialized (
  select r, kind, unnest(m) found, unnest(starts) a from (select * from {spans(ASSIGN, 0)} union all select * from {spans(ACCESS, 1)} union all select * from {spans(HEX, 2)} union all select * from {spans(TOKEN, 3)})),
base as (select r, kind, a, a + length(found) z from s where kind < 3 and (kind > 0 or length(regexp_extract(found, {quote(ASSIGN)}, 1)) >= {SHORTEST_VALUE})),
tokens as (
  select r, a, found, list_sum(list_transform(range(1, length(found)), lambda i: l[{code('found[i]')} * {k} + {code('found[i + 1]')} + 1])) / (length(found) - 1) score, regexp_matches(found, '[0-9]') digit
  from s, llr where kind = 3 and not exists (select 1 from base b where b.r = s.r and b.a <= s.a and s.a + length(s.found) <= b.z)),
every as (
  select r, kind, a, z from base
  union all select r, 3, a, a + length(found) from tokens where (digit or len(list_distinct(string_split(found, ''))) >= {LETTERS_VARIETY}) and score > case when digit then {CUTOFF} else {max(CUTOFF, LETTERS_CUTOFF)} end),
told as (
  select r, count(*) filter (where kind = 0) n_assign, count(*) filter (where kind = 1) n_access, count(*) filter (where kind = 2) n_hex,
         string_agg({names}[kind + 1] || ':' || a || ':' || z, ',' order by a, kind) filter (where kind < 3) base, string_agg({names}[kind + 1] || ':' || a || ':' || z, ',' order by a, kind) spans
  from every group by r)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join told on d.r = told.r"""
