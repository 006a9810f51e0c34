"""Approximate nearest neighbours by counting collisions.

Every vector is projected on random lines; a chunk of vectors keeps one sorted array for each line. Windows around
a query's own projections grow with the radius (virtual rehashing: the arrays stay, the windows widen), and each
entry that a window newly covers is a collision. Vectors with enough collisions are verified by their exact
distance. A query is done with a chunk once its k-th distance lies within the radius.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import column, lean, materialize

#: Lines, half the width of a window at radius 1, and the chance that a vector within the radius has enough collisions.
LINES, HALF, FOUND = 64, 1.36, 0.999
#: How a radius grows, and steps before a window covers everything.
GROWTH, STEPS = 1.25, 24
#: Bytes of vectors (as doubles) of a chunk, of a block of queries, and rows of vectors that a task should read at least.
CHUNK_BYTES, QUERY_BYTES, TASK_BYTES = 16 << 20, 16 << 20, 1 << 30
#: Bytes of vectors a core up to which a table is dealt out anew.
DEALT_BYTES = 64 << 20
#: Queries whose windows are looked up together.
TOGETHER = 256


@functools.cache
def least_collisions(lines: int = LINES, half: float = HALF, found: float = FOUND) -> int:
    """The most collisions that a vector at exactly the radius has with a chance of `found`: a binomial tail."""
    p = math.erf(half / math.sqrt(2))
    tail = 0.0
    for k in range(lines, -1, -1):
        tail += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if tail >= found:
            return k
    return 0


@functools.lru_cache(maxsize=4)
def lines_of(seed: int, width: int, lines: int = LINES) -> np.ndarray:
    """The random lines for vectors of a width, drawn anew on each worker."""
    return np.random.default_rng([seed, width]).standard_normal((width, lines))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, the squares added in the order of the components."""
    d = np.ascontiguousarray((x - q).T)
    d *= d
    # a lone column would be summed pairwise
    return np.sqrt(np.add.reduce(d, axis=0) if len(x) > 1 else np.add.accumulate(d, axis=0)[-1])


@dataclass
class Queries:
    """Queries of one width: row numbers, vectors, and the k nearest so far (distance, vec_id, row)."""

    row: np.ndarray
    x: np.ndarray
    k: int
    near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fresh(self) -> Queries:
        none = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return Queries(self.row, self.x, self.k, [none] * len(self.row))

    def bound(self, i: int) -> float:
        d = self.near[i][0]
        return float(d[-1]) if len(d) == self.k else math.inf

    def offer(self, i: int, d: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        ok = (d <= self.bound(i)) & (rows != self.row[i])
        d, ids, rows = (np.concatenate([a, b[ok]]) for a, b in zip(self.near[i], (d, ids, rows), strict=True))
        best = np.lexsort((rows, ids, d))[: self.k]
        self.near[i] = d[best], ids[best], rows[best]


class Chunk:
    """Sorted projections of some vectors of one width."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, lines: np.ndarray) -> None:
        self.x, self.ids, self.rows, self.lines = x, ids, rows, lines
        h = np.ascontiguousarray((x @ lines).T)
        self.order = np.argsort(h, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(h, self.order, 1)
        # any first radius gives right results; this one is below most distances between vectors
        self.first = max(float(h.std()) * math.sqrt(2) / 8, float(np.abs(h).max()) * 1e-9, 1e-300)

    def windows(self, h: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each line, query and radius: where the window starts and ends."""
        shape = len(self.sorted), *radius.shape
        low, high = np.empty(shape, np.int32), np.empty(shape, np.int32)
        with np.errstate(invalid="ignore"):
            for j, own in enumerate(self.sorted):
                low[j] = np.searchsorted(own, h[:, j, None] - HALF * radius, "left")
                high[j] = np.searchsorted(own, h[:, j, None] + HALF * radius, "right")
        return low, high

    def search(self, queries: Queries) -> None:
        growing = self.first * GROWTH ** np.arange(STEPS)
        growing[-1] = np.inf
        for at in range(0, len(queries.row), TOGETHER):
            own = np.arange(at, min(at + TOGETHER, len(queries.row)))
            h = queries.x[own] @ self.lines
            bound = np.array([queries.bound(i) for i in own])
            for known in (True, False):  # a query that has k vectors already needs one window only: that of its k-th distance
                some = np.flatnonzero(np.isfinite(bound) == known)
                radius = bound[some][:, None] if known else np.tile(growing, (len(some), 1))
                if len(some):
                    low, high = self.windows(h[some], radius)
                    for z, i in enumerate(own[some]):
                        self.probe(queries, int(i), radius[z], low[:, z], high[:, z])

    def probe(self, queries: Queries, i: int, radius: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        n, least = len(self.rows), least_collisions()
        hits, verified = np.zeros(n, np.int64), np.zeros(n, bool)
        a = b = None
        for s, r in enumerate(radius):
            lo, hi = low[:, s], high[:, s]
            if np.isinf(r):
                hits[:] = LINES
            elif a is None and 2 * int((hi - lo).sum()) > n * LINES:  # what lies outside is counted faster
                outside = [part for o, x, y in zip(self.order, lo, hi, strict=True) for part in (o[:x], o[y:])]
                hits = LINES - np.bincount(np.concatenate(outside), minlength=n)
            else:
                a, b = (lo, lo) if a is None else (a, b)
                new = [part for o, x, y, u, v in zip(self.order, lo, hi, a, b, strict=True) for part in ((o[x:u], o[v:y]) if u < v else (o[x:y],))]
                hits += np.bincount(np.concatenate(new), minlength=n)
            a, b = lo, hi
            ready = np.flatnonzero((hits >= least) & ~verified)
            if len(ready):
                verified[ready] = True
                queries.offer(i, distances(self.x[ready], queries.x[i]), self.ids[ready], self.rows[ready])
            if queries.bound(i) <= r:
                return


def sound(v: Column) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _vectors(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, rows, vectors) of each width."""
    col = column(batch, "v")
    at = col.offsets.to_numpy()
    size, flat = np.diff(at), col.values.to_numpy(zero_copy_only=False)
    ids, rows = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row"))
    for width in np.unique(size).tolist():
        own = np.flatnonzero(size == width)
        yield ids[own], rows[own], flat[at[own][:, None] + np.arange(width)].astype(np.float64)


FOUND_ROWS = T.StructType([T.StructField("query_row", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("score", T.DoubleType())])


def _search(vectors: DataFrame, block: list[Queries], seed: int) -> DataFrame:
    """What each task finds for a block of queries; k rows a query at most."""
    shared = vectors.sparkSession.sparkContext.broadcast(block)  # of QUERY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = {q.x.shape[1]: q.fresh() for q in shared.value}
        held: dict[int, list] = {w: [] for w in mine}

        def flush(width: int) -> None:
            if held[width]:
                ids, rows, x = (np.concatenate(c) for c in zip(*held[width], strict=True))
                held[width] = []
                Chunk(x, ids, rows, lines_of(seed, width)).search(mine[width])

        with lean():
            for batch in batches:
                for ids, rows, x in _vectors(batch):
                    width = x.shape[1]
                    if width in mine:
                        most = max(1, CHUNK_BYTES // (8 * width))
                        for k in range(0, len(x), most):
                            held[width].append((ids[k : k + most], rows[k : k + most], x[k : k + most]))
                            if sum(len(e[0]) for e in held[width]) >= most:
                                flush(width)
            for width, q in mine.items():
                flush(width)
                size = [len(e[0]) for e in q.near]
                if sum(size):
                    d, ids, rows = (np.concatenate(c) for c in zip(*q.near, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.row, size)), pa.array(ids), pa.array(rows), pa.array(d)], names=FOUND_ROWS.names)

    return vectors.mapInArrow(run, FOUND_ROWS)


def nearest(df: DataFrame, is_query: Column, k: int = 10, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each row that is_query (on vec_id) holds for.

    score is the Euclidean distance in double precision, summed in the order of the components; ties go to the
    smaller vec_id. Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
    rows without an id; vectors of different widths never meet. Every other row is a candidate, rows with the query's own id or
    vector included; rows that share a query's id are queries of their own, with ranks of their own. With fewer
    than k candidates all are returned. An empty table gives an empty result; other columns are ignored.

    Queries are sent to the tasks in blocks of bounded size, and a task reads its vectors chunk by chunk, so nothing
    grows with the table but the rows that a task reads: vectors are not shuffled (but for a small table's), only
    what tasks found.
    """
    spark = df.sparkSession
    base = df.select(df[id_col].cast("long").alias("vec_id"), df[vec_col].alias("v")).where(F.col("vec_id").isNotNull() & sound(F.col("v")))
    rows = materialize(base.withColumn("row", F.monotonically_increasing_id()))
    asked = materialize(rows.where(is_query))
    n, count, width = rows.count(), asked.count(), asked.agg(F.max(F.size("v"))).first()[0] or 1
    cores = spark.sparkContext.defaultParallelism
    # a small table, which may be one row group, is dealt out to all cores; a large one is read by fewer, longer tasks
    vectors = rows.repartition(cores) if n * 8 * width < cores * DEALT_BYTES else rows.coalesce(max(cores, -(-n * 8 * width // TASK_BYTES)))
    # blocks of half the size on average: that a hash deals twice as many rows to one can be ruled out
    blocks = -(-count * 8 * width * 2 // QUERY_BYTES)
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1))))
    found = []
    for z in range(blocks):
        block = [Queries(r, x, k) for _, r, x in _vectors(asked.where(F.col("_block") == z).select("vec_id", "row", "v").toArrow().combine_chunks().to_batches()[0])]
        found.append(materialize(_search(vectors, block, seed)))  # not to few files: that would search in few tasks
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = functools.reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return best.join(named, "query_row").select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 10, step: int = 100) -> str:
    """The query op12_nearest_neighbours for DuckDB, over embeddings whose ids are distinct: every distance."""
    return f"""
with g as materialized (select vec_id, embedding::double[] v from embeddings where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (select q.vec_id query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])), lambda a, b: a + b)) score from g q join g c on q.vec_id % {step} = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, rank::int rank, vec_id, score from (select *, row_number() over (partition by query_id order by score, vec_id) rank from d) where rank <= {k}"""
