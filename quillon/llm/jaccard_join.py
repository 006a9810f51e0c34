"""Near-duplicate texts by the Jaccard similarity of their word shingles: a chosen-path join.

Sets of five-word shingles are represented by min-hash tokens. Every run sends each set down a few paths,
by choosing tokens with a hash of the path so far; sets that share a chosen token go the same way. Buckets
that are small end the recursion and are compared; larger ones split on another token. Runs repeat until a
pair at the threshold meets with the target probability. All pairs of a bucket are compared by sketches of
bits; those that fit are verified on whole shingle sets, block by block (see links).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import common, links
from quillon.llm.common import WORD_BREAKS, column, discard, join_hot, lean, materialize, texts
from quillon.llm.components import connected_components

#: Words of a shingle, min-hash tokens of a set, and the similarity of a link.
WORDS, TOKENS, THRESHOLD = 5, 128, Fraction(4, 5)
#: The deepest split, the bucket size that is compared without another, and the recall the runs are for.
DEPTH, SMALL, RECALL = 3, 64, 0.995
#: Sets meet as candidates if this many standard deviations of the estimate allow for the threshold.
DEVIATIONS = 5.0
#: Shingles of a block, on average.
BLOCK_SHINGLES = 300_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BREAK = re.compile(WORD_BREAKS)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct 64-bit shingle hashes of a text, sorted; a shorter text is one shingle of all its words."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}
        self.factors = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = [w for w in _BREAK.split(text) if w] if text else []
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > 100_000:
            memo.clear()
        h = np.array([memo.get(w) or memo.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words], np.uint64)
        k = min(self.words, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = mix(out + h[i : i + n] * self.factors[i])
        return np.unique(out)


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold meets with the given probability, each run at its deepest.

    A pair at the threshold shares one chosen token a step on average, near a Poisson number of them.
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


_SALTS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.uint32) | np.uint32(1)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """TOKENS min-hashes (32-bit) of a shingle set."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        h = low[at : at + 2048, None] * _SALTS
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        np.minimum(out, h.min(0), out=out)
    return out


def children(paths: np.ndarray, tokens: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of every token chosen; tokens is rows x TOKENS, paths one for each row."""
    place = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)
    h = mix(paths[:, None] * np.uint64(0x9E3779B97F4A7C15) + mix(place + tokens))
    row, col = np.nonzero(h < np.uint64(int(chance * 2**64)))
    return row, mix(h[row, col] + np.uint64(1))


SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("copy", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("tokens", T.BinaryType()),
    T.StructField("sketch", T.BinaryType()), T.StructField("text_hash", T.LongType()),
])
PATHS = T.StructType([T.StructField("rep", T.LongType()), T.StructField("path", T.LongType())])


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def bits(tokens: np.ndarray) -> np.ndarray:
    """256 bits a row: the two lowest of each min-hash. Bits of equal tokens agree, others by chance."""
    return np.packbits(np.concatenate([tokens & 1, tokens >> 1 & 1], axis=1).astype(bool), axis=1)


def most_bits(threshold: Fraction) -> int:
    """Bits that two sketches at the threshold differ in, DEVIATIONS above the mean: half of 2 bits for each token that differs."""
    j = float(threshold)
    return math.ceil(TOKENS * (1 - j) + DEVIATIONS * math.sqrt(TOKENS * j * (1 - j) + TOKENS * (1 - j) / 2))


def sign(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, a digest of the shingle set, its size, its min-hashes, their sketch, and a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            shingle = Shingler()
            for batch in batches:
                for part, values in texts(batch, "_text"):
                    sets = [shingle(t) for t in values]
                    tokens = np.stack([min_hashes(s) for s in sets])
                    some = [len(s) > 0 for s in sets]
                    packed = lambda rows: pa.array([r.tobytes() if x else b"" for r, x in zip(rows, some, strict=True)], pa.binary())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([
                        column(part, "_id"), pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                        packed(tokens), packed(bits(tokens)), column(part, "_hash"),
                    ], names=SIGNED.names)

    return df.select(df[id_col].cast("long").alias("_id"), df[text].alias("_text"), F.xxhash64(df[text]).alias("_hash")).mapInArrow(run, SIGNED)


def _tokens(col: pa.Array, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1)


def _split(rows: DataFrame, starts: list[int] | None, chance: float) -> DataFrame:
    """One step down: rows (rep, tokens[, path]) to (rep, path); from the roots of all runs if starts is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    rep, tokens = column(batch, "rep").to_numpy(), _tokens(column(batch, "tokens")).astype(np.uint64)
                    for root in starts if starts is not None else [None]:
                        old = np.full(len(rep), root, np.uint64) if root is not None else column(batch, "path").to_numpy().view(np.uint64)
                        row, new = children(old, tokens, chance)
                        yield pa.RecordBatch.from_arrays([pa.array(rep[row]), pa.array(new.view(np.int64))], names=PATHS.names)

    return rows.mapInArrow(run, PATHS)


def buckets(reps: DataFrame, threshold: Fraction, recall: float) -> tuple[DataFrame, list[DataFrame]]:
    """(rep, bucket, m) of the paths that end with several sets, and the tables they are read from.

    A bucket of more than SMALL sets splits on another token, up to DEPTH times.
    """
    chance = 1 / (float(threshold) * TOKENS)
    now = materialize(_split(reps.select("rep", "tokens"), list(range(1, runs_for(recall) + 1)), chance))
    used, leaves = [now], []
    for depth in range(1, DEPTH + 1):
        full = now.groupBy("path").agg(F.count("*").alias("m")).where("m > 1")
        met = materialize(now.join(full, "path"), now.count(), 32)
        used.append(met)
        heavy = met.where(F.col("m") > SMALL) if depth < DEPTH else met.limit(0)
        leaves.append(met.where(F.col("m") <= SMALL) if depth < DEPTH else met)
        if heavy.isEmpty():
            break
        # some 10,000 rows to a file, as each row takes a while
        now = materialize(_split(heavy.join(reps.select("rep", "tokens"), "rep").select("rep", "tokens", "path"), None, chance), heavy.count(), 1600)
        used.append(now)
    rows = leaves[0]
    for x in leaves[1:]:
        rows = rows.unionByName(x)
    return rows.select("rep", F.col("path").alias("bucket"), "m"), used


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of the sets one after the other, and the sets' sizes."""
    sets = sets.cast(pa.large_binary())
    at = np.frombuffer(sets.buffers()[1], np.int64)[sets.offset : sets.offset + len(sets) + 1]
    return np.frombuffer(sets.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.uint64), np.diff(at) // 8


def similar(left: pa.Array, right: pa.Array | None, threshold: Fraction) -> np.ndarray:
    """Which pairs of shingle sets have a Jaccard similarity of at least the threshold, exactly; right None: left with itself."""
    values, sizes = _flat(left)
    n = len(sizes)
    if right is not None:
        more, more_sizes = _flat(right)
        values, sizes = np.concatenate([values, more]), np.concatenate([sizes, more_sizes])
    rows, columns = slice(0, n), slice(n, None) if right is not None else slice(0, n)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    del order
    new = np.r_[True, values[1:] != values[:-1]]
    start = np.flatnonzero(new)
    times = np.diff(np.r_[start, len(values)])
    # shingles of one set alone can't be common
    own = np.add.reduceat(owner < n, start) if len(start) else times
    useful = times > 1 if right is None else (own > 0) & (own < times)
    keep = np.repeat(useful, times)
    owner, ids = owner[keep], np.repeat(np.arange(int(useful.sum()), dtype=np.int32), times[useful])
    common = np.zeros((n, len(sizes[columns])), np.int32)
    for at in range(0, int(useful.sum()), 1024):
        a, b = np.searchsorted(ids, [at, at + 1024])
        part = np.zeros((len(sizes), 1024), np.float32)
        part[owner[a:b], ids[a:b] - at] = 1
        common += (part[rows] @ part[columns].T).astype(np.int32)
    out = np.empty(common.shape, bool)
    for at in range(0, n, 128):
        c = common[at : at + 128].astype(np.int64)
        out[at : at + 128] = c * threshold.denominator >= (sizes[at : at + 128][: len(c), None] + sizes[None, columns] - c) * threshold.numerator
    return out


def _place(doc_id: Column, text_hash: Column) -> list[Column]:
    """Where a text is found again: id (rows without one share 0) and hash, so that rows without an id don't meet in one key."""
    return [F.coalesce(doc_id, F.lit(0).cast("long")).alias("_id"), text_hash.alias("_hash")]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: Fraction = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copy_id, text_hash, kept.

    n_links counts the other documents whose sets of five-word shingles have a Jaccard similarity of at
    least the threshold; class_id is the smallest doc_id reachable by links, copy_id the smallest doc_id with
    the same shingle set, text_hash the text's xxhash64, kept whether the document is its class's smallest
    (of several texts under that id, the one with the smallest text_hash). Words are the runs between
    white space, as they are. A text of one to four words is one shingle; null texts and texts with no word
    have none and link with nothing. Texts are used whole. Rows without an id link as others do, but come
    last in their class; one that has no id at all has a null class_id and keeps its smallest text_hash.
    Repeated ids are rows of their own, alike in all columns if the texts are equal; an empty
    table gives an empty result; other columns are ignored. A link is verified on whole sets: none is
    below the threshold, and one at it is missed with a chance of at most 1 - recall.
    """
    signed = materialize(sign(df, id_col, text))
    some = signed.where("n > 0")
    reps = materialize(
        some.groupBy("copy").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash", "n", "tokens", "sketch")).alias("r"), F.count("*").alias("weight"))
        .select("copy", F.xxhash64("copy").alias("rep"), "weight", "r.doc_id", "r.text_hash", "r.n", "r.tokens", "r.sketch"), signed.count(), 700
    )
    n = reps.count()
    rows, used = buckets(reps, threshold, recall)
    # a family's sets mostly share its largest bucket
    home = rows.groupBy("rep").agg(F.max(F.struct("m", "bucket")).alias("h")).select("rep", F.col("h.bucket").alias("home"))
    standing = materialize(reps.select("rep", "sketch", F.col("n").alias("size")).join(home, "rep"), n)
    placed = links.blocks_of(standing, n, BLOCK_SHINGLES)
    pairs = materialize(links.noted(rows.join(placed, "rep"), most_bits(threshold)), 4 * standing.count())
    discard(*used, standing)
    key = lambda i, h: F.xxhash64(*_place(i, h)).alias("key")
    needed = pairs.select("rep").distinct().join(reps, "rep").select(key(F.col("doc_id"), F.col("text_hash")))
    sets = T.StructType([T.StructField("copy", T.BinaryType()), T.StructField("payload", T.BinaryType())])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            shingle = Shingler()
            for batch in batches:
                for _, values in texts(batch, "_text", 64):
                    made = [shingle(t) for t in values]
                    yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in made], pa.binary()), pa.array([s.tobytes() for s in made], pa.binary())], names=sets.names)

    # a text that isn't needed but passes finds no partner in the join
    whole = links.wanted(df.select(key(df[id_col].cast("long"), F.xxhash64(df[text])), df[text].alias("_text")), needed).select("_text").mapInArrow(resolve, sets)
    payload = whole.select(F.xxhash64("copy").alias("rep"), "payload").dropDuplicates(["rep"]).join(reps.select("rep", "weight"), "rep")
    linked = links.counted(pairs, payload, lambda x, y: similar(x, y, threshold))
    discard(pairs)
    comp = connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = linked.groupBy("rep").agg(F.sum("n").alias("links"))
    joined = reps.select("copy", "rep", "weight", "doc_id", "text_hash").join(counted, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    joined = joined.withColumn("component", F.coalesce("component", "rep"))
    smallest = joined.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash")).alias("c"))
    info = joined.join(smallest, "component").select(
        "copy", F.col("doc_id").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("c.doc_id").alias("class_id"), F.col("c.text_hash").alias("class_hash"),
    )
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    out = join_hot(some.select("doc_id", "copy", "text_hash"), info, ["copy"], reps.where(F.col("weight") > common.HOT_ROWS)).select("doc_id", "class_id", "n_links", "copy_id", "text_hash", kept.alias("kept"))
    none = signed.where("n = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_id"), "text_hash", F.lit(True).alias("kept")
    )
    return out.unionByName(none)


def oracle() -> str:
    """The query op6_ngram_jaccard_join for DuckDB, over documents whose ids are distinct: every pair that shares a shingle."""
    k, t = WORDS, THRESHOLD
    return rf"""
with recursive
d as materialized (select doc_id, row_number() over () r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as materialized (select r, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {k - 2}, 2)), lambda i: array_to_string(w[i : i + {k - 1}], ' ')))) s from d where len(w) > 0),
e as materialized (select r, unnest(s) x from s),
p as (select a.r a, b.r b, count(*) c from e a join e b on a.x = b.x and a.r < b.r group by all),
l as materialized (select a, b from p join s x on x.r = a join s y on y.r = b where c * {t.denominator} >= (len(x.s) + len(y.s) - c) * {t.numerator}),
ways as materialized (select a, b from l union all select b, a from l),
reach(r, other) as (select r, r from d union select reach.r, ways.b from reach join ways on reach.other = ways.a),
class as (select reach.r, min(doc_id) class_id from reach join d on d.r = reach.other group by reach.r),
n as (select a r, count(*) n_links from ways group by a),
copy as (select r, min(doc_id) over (partition by s) copy_id from s join d using (r))
select doc_id, class_id, coalesce(n_links, 0) n_links, coalesce(copy_id, doc_id) copy_id, doc_id = class_id kept
from d join class using (r) left join n using (r) left join copy using (r)"""
