"""Links between rows that share buckets: candidates by bit sketches, then exact verification block by block.

A row has a sketch of bits, a home (rows alike mostly share it) and stands in buckets. Homes are dealt into
blocks of bounded size. In every bucket all pairs of sketches are compared, and a row notes only with which
blocks it has a candidate partner. Each pair of blocks is then verified once, over the rows that noted it:
no list of pairs is made, no pair counts twice however many buckets it shares, and what is compared follows
the candidates, not the groups that these chain into.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import gathered, lean, materialize

#: Rows of a block (its payload is verified at once), and rows of a part of a bucket (sketches alone).
BLOCK_ROWS, BUCKET_ROWS = 1024, 4096
#: Buckets of so many rows are compared many at a time.
FEW = 32
#: Bits of the table of rows whose payload is wanted; it has at most 524,288 rows of two numbers, whatever the data.
FILTER_BITS = 1 << 25

NOTED = T.StructType([T.StructField("rep", T.LongType()), T.StructField("own", T.LongType()), T.StructField("others", T.ArrayType(T.LongType()))])
FOUND = T.StructType([T.StructField("rep", T.LongType()), T.StructField("n", T.LongType()), T.StructField("root", T.LongType())])


def blocks_of(info: DataFrame, rows: int, block_size: int | None = None, keep: tuple | list = ()) -> DataFrame:
    """rep, sketch, block and `keep` of info's `rows` rows (rep, sketch, home, size): homes beyond a block's bounds are dealt by hash."""
    parts = F.ceil(F.count("*") / BLOCK_ROWS)
    if block_size:
        parts = F.greatest(parts, F.ceil(F.sum("size") / block_size))
    large = materialize(info.groupBy("home").agg(parts.cast("int").alias("nb")).where("nb > 1"), rows, 16)
    part = F.when(F.col("nb").isNotNull(), F.pmod(F.xxhash64("rep"), F.col("nb"))).otherwise(0)
    return info.join(small(large), "home", "left").select("rep", "sketch", F.xxhash64("home", part).alias("block"), *keep)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df to be broadcast if its rows, counted, are few; as it is if not."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def noted(rows: DataFrame, most: int, part_rows: int | None = None, passes: Callable[[int, np.ndarray], list[np.ndarray] | None] | None = None) -> DataFrame:
    """(rep, lo, hi, own): pairs of blocks in which a row has a partner whose sketch differs in at most `most` bits.

    rows: (rep, sketch, block, bucket, m), m the bucket's rows; buckets beyond part_rows (BUCKET_ROWS if not given) are
    compared part by part. A block's rows are in one part, so a row notes a block once a bucket, however many parts it has.
    passes(bucket, sketches) gives keys by which the rows of a large bucket are grouped, one array after another: only
    sketches that share a key in some of them are compared; None compares all.
    """
    nb = F.ceil(F.col("m") / (part_rows or BUCKET_ROWS)).cast("int")
    dealt = (
        rows.withColumn("nb", nb).withColumn("part", F.pmod(F.xxhash64("block", "bucket"), F.col("nb")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("rep", "sketch", "block", "bucket", "part", F.least("part", "o").alias("bi"), F.greatest("part", "o").alias("bj"))
        .repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for t, starts in gathered(batches, ["bucket", "bi", "bj"]):
                rep, block, bucket, part, bi, bj = (t.column(c).to_numpy() for c in ("rep", "block", "bucket", "part", "bi", "bj"))
                sketch = words_of(t.column("sketch"))
                sizes = np.diff(starts)
                few = (sizes <= FEW) & (bi[starts[:-1]] == bj[starts[:-1]])
                yield from notes(*_few(rep, block, sketch, np.repeat(few, sizes), np.repeat(np.arange(len(sizes)), sizes), most))
                for a, b in zip(starts[:-1][~few].tolist(), starts[1:][~few].tolist(), strict=True):
                    keys = passes(int(bucket[a]), sketch[a:b]) if passes else None
                    if keys is not None:
                        yield from notes(*_by_keys(rep[a:b], block[a:b], sketch[a:b], keys, most))
                        continue
                    first = np.flatnonzero(part[a:b] == bi[a]) + a
                    second = first if bi[a] == bj[a] else np.flatnonzero(part[a:b] != bi[a]) + a
                    yield from notes(*_many(rep, block, sketch, first, second, most))
                    if first is not second:
                        yield from notes(*_many(rep, block, sketch, second, first, most))

    lists = dealt.mapInArrow(compare, NOTED).groupBy("rep", "own").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    return lists.select("rep", "own", F.explode("others").alias("other")).select("rep", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")


def words_of(sketches: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(len(sketches), -1)


def notes(rep: np.ndarray, own: np.ndarray, other: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each row of a bucket that has partners, with their blocks; they are few next to the partners."""
    if len(rep):
        t = pa.table({"rep": rep, "own": own, "others": other}).group_by(["rep", "own"], use_threads=False).aggregate([("others", "distinct")])
        yield from t.rename_columns({"others_distinct": "others"}).select(NOTED.names).to_batches()


def _few(rep, block, sketch, on, group, most):
    """Pairs of neighbours at every distance, over all small buckets at once."""
    at = np.flatnonzero(on)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, FEW):
        i = np.flatnonzero(group[at[d:]] == group[at[:-d]]) if d < len(at) else at[:0]
        if not len(i):
            break
        x, y = at[i], at[i + d]
        near = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) <= most
        a.append(x[near])
        b.append(y[near])
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    return rep[a], block[a], block[b]


def _many(rep, block, sketch, left, right, most):
    """For rows of one large bucket: the blocks in which each has a partner, a strip of rows at a time."""
    right = right[np.argsort(block[right], kind="stable")]
    names, starts = np.unique(block[right], return_index=True)
    across = np.ascontiguousarray(sketch[right].T)
    out = []
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        differ = np.zeros((len(rows), len(right)), np.uint16)
        for k in range(len(across)):
            differ += np.bitwise_count(sketch[rows, k][:, None] ^ across[k])
        near = (differ <= most) & (rep[rows][:, None] != rep[right])
        row, name = np.nonzero(np.logical_or.reduceat(near, starts, axis=1))
        out.append((rep[rows[row]], block[rows[row]], names[name]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (rep[:0], block[:0], block[:0])


def _by_keys(rep, block, sketch, keys, most):
    """Pairs that share a key, one array of keys after another; what is found again is kept once."""
    names, held = ["rep", "own", "other"], None
    columns = np.ascontiguousarray(sketch.T)
    for key in keys:
        order = np.argsort(key, kind="stable")
        k, across = key[order], columns[:, order]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[starts, len(k)])
        few = np.repeat(sizes <= FEW, sizes)
        found = []
        for d in range(1, int(sizes[sizes <= FEW].max(initial=1))):  # neighbours at every distance, over all short runs at once
            x = np.flatnonzero((k[d:] == k[:-d]) & few[d:])
            differ = np.zeros(len(x), np.uint16)
            for c in across:
                differ += np.bitwise_count(c[x] ^ c[x + d])
            x = order[x[differ <= most]], order[x[differ <= most] + d]
            found += [(rep[i], block[i], block[j]) for i, j in (x, x[::-1])]
        for at, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            run = order[at : at + size]
            found.append(_many(rep, block, sketch, run, run, most))
        t = pa.table([np.concatenate(c) for c in zip((rep[:0], block[:0], block[:0]), *found, strict=True)], names=names)
        t = t if held is None else pa.concat_tables([held, t])
        held = t.group_by(names, use_threads=False).aggregate([]) if t.num_rows else t
    return tuple(held.column(c).to_numpy() for c in names)


def verified(rows: DataFrame, similar: Callable[[pa.Array, pa.Array | None], np.ndarray]) -> DataFrame:
    """(rep, n, root): how many rows each links with in a pair of blocks, by weight, and a row it reaches there.

    rows: (rep, lo, hi, own, weight, payload), every rep once in a pair; similar tells which pairs of
    payloads are linked, exactly (of one array with itself if the second is None).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for t, starts in gathered(batches, ["lo", "hi"]):
                rep, lo, hi, own, weight = (t.column(c).to_numpy() for c in ("rep", "lo", "hi", "own", "weight"))
                payload = t.column("payload").combine_chunks()
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    first = np.flatnonzero(own[a:b] == lo[a]) + a
                    second = first if lo[a] == hi[a] else np.flatnonzero(own[a:b] != lo[a]) + a
                    if not len(second) or b - a < 2:
                        continue
                    near = similar(payload.take(pa.array(first)), None if first is second else payload.take(pa.array(second)))
                    if first is second:
                        np.fill_diagonal(near, False)
                    n = np.zeros(b - a, np.int64)
                    n[first - a] += near @ weight[second]
                    if first is not second:
                        n[second - a] += near.T @ weight[first]
                    root = np.arange(b - a)
                    root[first - a], root[second - a] = roots(near, first - a, second - a)
                    at = np.flatnonzero(n)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(rep[a + at]), pa.array(n[at]), pa.array(rep[a + root[at]])], names=FOUND.names)

    return rows.repartition("lo", "hi").sortWithinPartitions("lo", "hi").mapInArrow(run, FOUND)


def roots(near: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of the same component for the rows and for the columns of a link matrix; names of rows are in `first`, of columns in `second`.

    The matrix is walked from row to row, so nothing larger than it is made.
    """
    if first is second:
        out = np.full(len(first), -1)
        for i in range(len(first)):
            if out[i] >= 0:
                continue
            front = np.array([i])
            while len(front):
                out[front] = first[i]
                front = np.flatnonzero(near[front].any(0) & (out < 0))
        return out, out
    left, right = np.full(len(first), -1), np.full(len(second), -1)
    for i in range(len(first)):
        if left[i] >= 0:
            continue
        front = np.array([i])
        while len(front):
            left[front] = first[i]
            beyond = np.flatnonzero(near[front].any(0) & (right < 0))
            right[beyond] = first[i]
            front = np.flatnonzero(near[:, beyond].any(1) & (left < 0)) if len(beyond) else beyond
    alone = right < 0
    right[alone] = second[alone]
    return left, right


def wanted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose `key` (long) may be one of keys' `key`, and few others, without a shuffle of the rows.

    Keys set bits of a table, of partial sums by 64-bit words; it has FILTER_BITS / 64 rows at most, whatever the
    data, and is broadcast. Rows that pass by chance have to be told from the others later.
    """
    bit = F.pmod(F.col("key"), F.lit(FILTER_BITS))
    within = F.expr(f"cast(pmod(key, {FILTER_BITS}L) & 63 as int)")
    words = keys.groupBy(F.shiftrightunsigned(bit, 6).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {FILTER_BITS}L) & 63 as int))")).alias("_bits"))
    marked = rows.withColumn("_word", F.shiftrightunsigned(bit, 6)).withColumn("_at", within)
    return marked.join(F.broadcast(words), "_word").where(F.expr("shiftright(_bits, _at) & 1 = 1")).select(*rows.columns)


def counted(noted_rows: DataFrame, payload: DataFrame, similar: Callable[[pa.Array, pa.Array | None], np.ndarray]) -> DataFrame:
    """(rep, n, root) over all pairs of blocks; payload: (rep, weight, payload), one row for each rep."""
    return materialize(verified(noted_rows.join(payload, "rep"), similar))
