"""Whitening of embeddings from an exact scatter matrix.

Components become whole numbers. Each partition multiplies its rows' residues with themselves, prime by prime, in
doubles that stay exact; the sums are added modulo the primes and put together by the Chinese remainder theorem,
so the scatter is the exact one whatever the order of rows or the number of tasks. Its covariance is decomposed
in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import column, lean, materialize

#: x = floor(SCALE * c) + SHIFT of an entry c.
SCALE, SHIFT = 64, 1_000_000
#: Rows of one matrix product. With residues within PRIME / 2 of 0 its sums stay below 2 ** 53: 2 ** (13 + 2 * 19).
BLOCK, PRIME = 1 << 13, 1 << 20
#: Entries from this size on have no 64-bit x and count as non-finite.
HUGE = 2.0**56
LONG = (1 << 63) - 1


def primes(product: int) -> list[int]:
    """The largest primes below PRIME, as many as their product needs to exceed `product`."""
    out, p, have = [], PRIME, 1
    while have <= product:
        p -= 1
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            out.append(p)
            have *= p
    return out


def whole_numbers(v: Column) -> Column:
    """x of a vector as array<long>; null if it is null or has an entry that is null, non-finite or huge."""
    sound = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < HUGE, F.lit(False)))
    return F.when(sound, F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))


def _blocks(batch: pa.RecordBatch, name: str = "x") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, values) of the vectors of each width, at most BLOCK at a time."""
    col = column(batch, name)
    at = col.offsets.to_numpy()
    size, flat = np.diff(at), col.values.to_numpy(zero_copy_only=False)
    for width in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == width)
        for k in range(0, len(rows), BLOCK):
            own = rows[k : k + BLOCK]
            yield width, own, flat[at[own][:, None] + np.arange(width)]


def residue_scatter(x: np.ndarray, p: int) -> np.ndarray:
    """The rows' scatter modulo p, in exact doubles."""
    r = (x % p).astype(np.float64)
    r[r > p // 2] -= p
    return (r.T @ r).astype(np.int64) % p


def remainder(residues: list[int], moduli: list[int]) -> int:
    """The number nearest to 0 with these residues (Garner)."""
    value, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if value > product // 2 else value


def exact_scatter(fit: DataFrame, moduli: dict[int, list[int]]) -> dict[int, list[list[int]]]:
    """For each width, the scatter of (1, x) over the rows of fit (x), as Python integers.

    A partition gives (width + 1) ** 2 residues for each prime; a task sums those of one line of the matrix. Only
    the matrices reach the driver: their size is the width's, whatever the rows.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        with lean():
            for batch in batches:
                for width, _, x in _blocks(batch):
                    one = np.column_stack([np.ones(len(x), np.int64), x])
                    for p in moduli[width]:
                        sums[width, p] = (sums.get((width, p), 0) + residue_scatter(one, p)) % p
            for (width, p), m in sums.items():
                k = len(m)
                lines = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * k), pa.array(m.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([width] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([p] * k, pa.int64()), lines], names=["width", "line", "p", "r"])

    def reconstruct(t: pa.Table) -> pa.Table:
        width, line = t["width"][0].as_py(), t["line"][0].as_py()
        prime, r = t["p"].to_numpy(), t["r"].combine_chunks().values.to_numpy().reshape(t.num_rows, width + 1)
        sums = [(r[prime == p].sum(0) % p).tolist() for p in moduli[width]]
        return pa.table({"width": pa.array([width], pa.int32()), "line": pa.array([line], pa.int32()), "v": pa.array([[str(remainder(list(c), moduli[width])) for c in zip(*sums, strict=True)]])})

    lines = fit.select("x").mapInArrow(multiply, "width int, line int, p long, r array<long>").groupBy("width", "line").applyInArrow(lambda t: reconstruct(t), "width int, line int, v array<string>")
    out: dict[int, list] = {}
    for r in sorted(lines.collect(), key=lambda r: (r["width"], r["line"])):
        out.setdefault(r["width"], []).append([int(v) for v in r["v"]])
    return out


@dataclass
class Whitening:
    """Of one width: count, exact sums, components as columns, their eigenvalues, and shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """x - S / n in doubles, from n * x - S, which is exact; and that as 64-bit integers where it fits."""
        most = max(self.n * int(np.abs(x).max(initial=0)), max(map(abs, self.sums), default=0))
        if most < 1 << 61:
            whole = self.n * x - np.array(self.sums, np.int64)
            return whole / self.n, whole
        exact = x.astype(object) * self.n - np.array(self.sums, object)
        return np.array([[v / self.n for v in row] for row in exact]), exact

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.axes / np.sqrt(self.values)


def deviations(whole: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None beyond 64 bits."""
    about = (whole.astype(np.float64) ** 2).sum(1)
    out: list[int | None] = []
    short = whole.astype(np.int64) if whole.dtype != object else None
    sums = (short * short).sum(1) if short is not None else None
    for k, a in enumerate(about):
        if sums is not None and a < 2.0**62:
            out.append(int(sums[k]))
        else:
            exact = sum(int(v) ** 2 for v in whole[k])
            out.append(exact if exact <= LONG else None)
    return out


def decompose(scatter: list[list[int]], components: int) -> Whitening:
    """The eigenvectors of the exact covariance. Those whose eigenvalue is 0 to double precision can't be whitened and are left out."""
    n, sums = scatter[0][0], scatter[0][1:]
    square = n * n
    v = np.array([[(n * q - a * b) / square for q, b in zip(line[1:], sums, strict=True)] for a, line in zip(sums, scatter[1:], strict=True)])
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    kept = order[values[order] > len(sums) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)]
    trace = sum(n * scatter[k + 1][k + 1] - s * s for k, s in enumerate(sums)) / square
    return Whitening(n, sums, axes[:, kept], values[kept], values[kept] / (trace or 1.0))


def _summed(fit: DataFrame, models: dict[int, Whitening], means: dict[int, np.ndarray] | None) -> dict[int, np.ndarray]:
    """Sums over fit of the whitened rows, or of their products after the means are taken off; by width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        with lean():
            for batch in batches:
                for width, _, x in _blocks(batch):
                    w = models[width].whitened(models[width].centred(x)[0])
                    sums[width] = sums.get(width, 0) + (w.sum(0) if means is None else (w - means[width]).T @ (w - means[width]))
            for width, s in sums.items():
                flat = np.asarray(s).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array([width] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["width", "k", "v"])

    total = fit.select("x").mapInArrow(run, "width int, k int, v double").groupBy("width", "k").agg(F.sum("v").alias("v")).collect()
    out = {w: np.zeros(len(m.values) ** (1 if means is None else 2)) for w, m in models.items()}
    for r in total:
        out[r["width"]][r["k"]] = r["v"]
    return {w: s / models[w].n for w, s in out.items()}


OUT = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
    T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
])


def learn(fit: DataFrame, components: int = 16) -> dict[int, Whitening]:
    """A whitening for each width of the distinct rows of fit (x), measured on them."""
    most = fit.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", lambda c: F.abs(c)))).alias("m")).collect()
    moduli = {r["width"]: primes(2 * r["n"] * max(r["m"], 1) ** 2) for r in most}
    models = {w: decompose(s, components) for w, s in exact_scatter(fit, moduli).items()}
    means = _summed(fit, models, None)
    for w, cov in _summed(fit, models, means).items():
        k = len(models[w].values)
        models[w].identity_error = float(np.abs(cov.reshape(k, k) - np.eye(k)).max(initial=0.0))
    return models


def whiten(df: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, or holds null, non-finite or huge entries (2 ** 56 on), are dropped. Distinct
    x-vectors are the fit list, each once; repeated rows and rows without an id get results of their own.
    Vectors of different widths are whitened each width by itself; empty ones have no component. Components of
    no variance are left out, so a single distinct vector gives no rows. deviation is null where it exceeds 64
    bits. Equal eigenvalues are numbered in any order, the same for all rows. An empty table gives an empty
    result; other columns are ignored. The model holds width ** 2 numbers for each width.
    """
    rows = df.select(df[id_col].cast("long").alias("vec_id"), whole_numbers(df[vec_col]).alias("x")).where(F.size("x") > 0)
    fit = materialize(rows.select("x").distinct())
    shared = df.sparkSession.sparkContext.broadcast(learn(fit, components))  # width ** 2 numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        with lean():
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    for width, own, x in _blocks(batch):
                        m = models[width]
                        k = len(m.values)
                        centred, exact = m.centred(x)
                        ids, dev = column(batch, "vec_id").take(pa.array(np.repeat(own, k))), np.repeat(np.array(deviations(exact), object), k)
                        yield pa.RecordBatch.from_arrays([
                            ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), m.n)), pa.array(dev, pa.int64()),
                            pa.array(m.whitened(centred).reshape(-1)), pa.array(np.tile(m.explained, len(x))), pa.array(np.full(k * len(x), m.identity_error)),
                        ], names=OUT.names)

    return rows.mapInArrow(run, OUT)
