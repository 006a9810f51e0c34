"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, components.

A few tables of few signs send every vector to large buckets, which keeps the shuffle small. Inside a bucket
vectors are hashed again, several times, by signs of their sketches, without moving; those that meet are compared
by whole sketches, and those that fit are verified by their exact cosine, block by block (see links).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import common, links
from quillon.llm.common import column, discard, join_hot, lean, materialize
from quillon.llm.components import connected_components

#: Rows that a bucket holds on average at most, and rows of a part of a larger one; sets the bits of a table.
BUCKET = 1 << 18
#: The least bits of a table, so that small tables are dealt to many tasks too.
LEAST_BITS = 7
#: Rows of a bucket that are compared all with all; in larger ones those that share a local key, about so many, are.
DIRECT, LOCAL = 1024, 8
#: Chance that a pair at exactly the threshold meets in a bucket that it shares.
MEET = 0.9
#: Chance that a pair at exactly the threshold is found; closer pairs are surer.
RECALL = 0.995
#: Rows that share a home by chance, on average; homes fill the blocks in which vectors are verified.
HOME = 512
#: Signs of a sketch, and the standard deviations above the mean that those of a pair at the threshold may differ in.
SIGNS, DEVIATIONS = 192, 5.0


@functools.lru_cache(maxsize=64)
def local_passes(bits: int, threshold: float) -> tuple[int, np.ndarray]:
    """How often the rows of a bucket are hashed by so many signs of their sketches, and the chance to meet of pairs at the threshold, by the signs they differ in."""
    differ = np.arange(SIGNS + 1)
    alike = np.prod([np.maximum(SIGNS - differ - i, 0) / (SIGNS - i) for i in range(bits)], axis=0) if bits else np.ones(SIGNS + 1)
    chance, passes = _differing(threshold), 1
    while (chance * (1 - (1 - alike) ** passes)).sum() < MEET:
        passes += 1
    return passes, 1 - (1 - alike) ** passes


@functools.lru_cache(maxsize=4)
def _differing(threshold: float) -> np.ndarray:
    """How likely the sketches of a pair at the threshold differ in 0, 1, ... signs."""
    p = math.acos(threshold) / math.pi
    return np.array([math.comb(SIGNS, d) * p**d * (1 - p) ** (SIGNS - d) for d in range(SIGNS + 1)])


def local_bits(rows: int) -> int:
    return min(16, max(0, math.ceil(math.log2(max(rows, 1) / LOCAL))))


def tables_and_bits(n: int, threshold: float, recall: float | None = None) -> tuple[int, int]:
    """How many sign tables of how many bits n vectors need, whatever their buckets hold.

    A pair is found if it shares a bucket and meets there; sketches that differ in many signs meet less often in every
    table alike, so the chance is taken over those.
    """
    bits = min(40, max(LEAST_BITS, math.ceil(math.log2(max(n, 2) / BUCKET))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    chance, meet, tables = _differing(threshold), local_passes(local_bits(BUCKET), threshold)[1], 1
    while (chance * (1 - (1 - together * meet) ** tables)).sum() < (RECALL if recall is None else recall):
        tables += 1
    return tables, bits


def local_keys(bucket: int, words: np.ndarray, threshold: float) -> list[np.ndarray] | None:
    """Keys of a bucket's sketches, a pass after the other; None if it is no more work to compare all of them."""
    n = len(words)
    if n <= DIRECT:
        return None
    bits = local_bits(n)
    rng, keys, pairs = np.random.default_rng(bucket >> 16 & 4095), [], 0  # other signs in every table
    for _ in range(local_passes(bits, threshold)[0]):
        key = np.zeros(n, np.uint16)
        for j, c in enumerate(rng.permutation(SIGNS)[:bits].tolist()):
            key |= ((words[:, c >> 6] >> np.uint64(c & 63)) & np.uint64(1)).astype(np.uint16) << np.uint16(j)
        pairs += int((np.bincount(key).astype(np.int64) ** 2).sum())
        keys.append(key)
    return keys if pairs < n * n else None


def most_signs(threshold: float) -> int:
    """Signs of the sketches that a pair at the threshold may differ in."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SIGNS * p + DEVIATIONS * math.sqrt(SIGNS * p * (1 - p)))


@functools.lru_cache(maxsize=4)
def planes(seed: int, width: int, columns: int) -> np.ndarray:
    """The hyperplanes for vectors of a width, drawn anew on each worker."""
    return np.random.default_rng(seed).standard_normal((width, columns))


def unit_rows(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows of the column they are: those of the width."""
    at, where = col.offsets.to_numpy(), np.flatnonzero(np.diff(col.offsets.to_numpy()) == width)
    x = col.values.to_numpy(zero_copy_only=False).astype(np.float64)[at[where][:, None] + np.arange(width)]
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True)), where


def widths(col: pa.Array) -> list[int]:
    return np.unique(np.diff(col.offsets.to_numpy())).tolist()


def similar(left: pa.Array, right: pa.Array | None, threshold: float) -> np.ndarray:
    """Which pairs of vectors have a cosine of at least the threshold; right None: left with itself. Other widths never do."""
    other = left if right is None else right
    out = np.zeros((len(left), len(other)), bool)
    for w in widths(left):
        x, i = unit_rows(left, w)
        y, j = (x, i) if right is None else unit_rows(right, w)
        if len(i) and len(j):
            out[np.ix_(i, j)] = x @ y.T >= threshold
    return out


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, seed: int = 7) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links are the pairs found with cosine >= threshold in double precision; never one below it. Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    widths are hashed and compared each width by itself. Equal vectors are compared once and count as many
    links as there are. Rows that share an id, or have none, are rows of their own with links of their own;
    component_id is the smallest id reachable, null if no row there has one, and kept whether a row has
    the component's id (all rows of a component without any id are kept). Buckets are compared in parts of
    bounded size whatever they hold, by passes over local keys or all with all, whichever is less work. An empty table gives an empty result; other columns are ignored.
    """
    floats = isinstance(df.schema[vec_col].dataType.elementType, T.FloatType)
    base = df.select(df[id_col].cast("long").alias("vec_id"), (df[vec_col] if floats else df[vec_col].cast("array<double>")).alias("v"))
    v = F.col("v")
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    members = base.where(sound).select("vec_id", F.xxhash64(v).alias("c1"), F.xxhash64(F.lit(1), v).alias("c2"), "v")
    reps = materialize(
        members.groupBy("c1", "c2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.any_value("v").alias("v"))
        .select(F.xxhash64("c1", "c2").alias("rep"), "c1", "c2", "first_id", "weight", "v"), base.count(), 400
    )
    n = reps.count()
    tables, bits = tables_and_bits(n, threshold)
    near_bits = min(40, max(4, math.ceil(math.log2(max(n, 2) / HOME))))
    ends = np.cumsum([tables * bits, SIGNS, near_bits]).tolist()
    keyed = T.StructType([T.StructField("rep", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("home", T.LongType())])

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    col = column(batch, "v")
                    for width in widths(col):
                        x, where = unit_rows(col, width)
                        on = x @ planes(seed, width, ends[2]) > 0
                        keys = on[:, : ends[0]].reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                        sketch = np.packbits(on[:, ends[0] : ends[1]], axis=1)
                        home = (on[:, ends[1] :] @ (1 << np.arange(near_bits, dtype=np.int64))) * 65536 + width % 65536
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(((keys * 4096 + np.arange(tables)) * 65536 + width % 65536).reshape(-1)))
                        yield pa.RecordBatch.from_arrays([pa.array(column(batch, "rep").to_numpy()[where]), lists, pa.array([r.tobytes() for r in sketch], pa.binary()), pa.array(home)], names=keyed.names)

    hashed = materialize(reps.select("rep", "v").mapInArrow(hash_rows, keyed))
    large = materialize(hashed.select(F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > BUCKET), n * tables // BUCKET)
    placed = links.blocks_of(hashed.select("rep", "sketch", "home", F.lit(1).alias("size"), "keys"), n, keep=["keys"])
    rows = placed.select("rep", "sketch", "block", F.explode("keys").alias("bucket"))
    rows = rows.withColumn("m", F.lit(1).cast("long")) if large.isEmpty() else rows.join(large, "bucket", "left").withColumn("m", F.coalesce("m", F.lit(1).cast("long")))
    pairs = materialize(links.noted(rows, most_signs(threshold), BUCKET, lambda bucket, words: local_keys(bucket, words, threshold)), 4 * n)
    linked = links.counted(pairs, reps.select("rep", "weight", F.col("v").alias("payload")), lambda x, y: similar(x, y, threshold))
    discard(hashed, large, pairs)
    comp = connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = linked.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = reps.select("c1", "c2", "rep", "weight", "first_id").join(counted, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    joined = joined.withColumn("component", F.coalesce("component", "rep"))
    smallest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    info = joined.join(smallest, "component").select("c1", "c2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked_rows = join_hot(members.select("vec_id", "c1", "c2"), info, ["c1", "c2"], reps.where(F.col("weight") > common.HOT_ROWS)).select("vec_id", "n_links", "component_id")
    alone = base.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle(threshold: float = 0.9) -> str:
    """The query op3_embedding_near_dedup for DuckDB, over embeddings whose ids are distinct: every pair of vectors."""
    return f"""
with recursive
d as materialized (select vec_id, row_number() over () r, embedding::double[] v from embeddings),
g as materialized (
  select r, list_transform(v, lambda x: x / m) u from (select r, v, list_max(list_transform(v, lambda x: abs(x))) m from d where len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0) where m > 0),
q as materialized (select r, u, len(u) w, sqrt(list_dot_product(u, u)) size from g),
l as materialized (select a.r a, b.r b from q a join q b on a.r < b.r and a.w = b.w where list_dot_product(case when a.w = b.w then a.u end, case when a.w = b.w then b.u end) / a.size / b.size >= {threshold}),
ways as materialized (select a, b from l union all select b, a from l),
reach(r, other) as (select r, r from d union select reach.r, ways.b from reach join ways on reach.other = ways.a),
class as (select reach.r, min(vec_id) component_id from reach join d on d.r = reach.other group by reach.r),
n as (select a r, count(*) n_links from ways group by a)
select vec_id, coalesce(n_links, 0) n_links, component_id, vec_id = component_id kept from d join class using (r) left join n using (r)"""
