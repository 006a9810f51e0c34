"""Best-fit packing of token pieces into sequences of a fixed size.

The number of pieces of each length is all that the plan depends on. A configuration linear program over
that histogram (one variable for each way to fill a sequence) is solved by multiplicative weights, whose
pricing problem, the most valuable filling, is a knapsack solved by dynamic programming. Whole multiples
are taken from the solution, and what they leave is packed longest piece first, each with the pieces that fit best.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.bpe import ByteBpe, read_ranks
from quillon.llm.common import column, lean, materialize, texts

#: Multiplicative weights: passes times lengths, and how few or many passes that may be; how fast weights fall with the
#: share covered, how far a pass may take a length's share at first, and how near to the best a filling has to come.
PASSES, PASS_RANGE = 20_000, (60, 1500)
RATE, STEP, NEAR = 3.0, 0.1, 0.003
#: Shares of each multiplicity that rounding may take; with 0 the rest, which is everything, goes by the fullest fillings alone.
COVERS = (1.0, 0.9, 0.7, 0.5, 0.3, 0.1, 0.0)

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def cut_points(n: int, size: int) -> list[int]:
    """Where pieces of n tokens start: only longer documents are cut, and the first piece takes the odd rest."""
    first = n % size or min(n, size)
    return [0, *range(first, n, size)] if n else []


def pieces(df: DataFrame, vocab_path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every whole text plus end_id, cut into pieces of at most `size`.

    Ids are those of the byte-level tokenizer file, whose ids are its merge ranks; the public rank-based encoder
    makes them, text by text. It gives up on very long runs of white space; such a text goes to the codec of `bpe`,
    which takes any and gives the same ids. Null texts count as empty and give one piece that
    holds end_id alone; repeated rows give repeated pieces; an empty table gives none.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocab_path))  # its size is the vocabulary's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        with lean():
            encode = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
            end, slow = end_id.to_bytes(4, "little"), None

            def ids_of(t: str) -> bytes:
                nonlocal slow
                try:
                    return np.array(encode(t), "<u4").tobytes()
                except BaseException as e:
                    if type(e).__name__ != "PanicException":  # no subclass of Exception, and not importable
                        raise
                slow = slow or ByteBpe(shared.value).encoder()
                return slow(t)

            for batch in batches:
                for part, values in texts(batch, "_text"):
                    rows = []
                    for doc, t in zip(column(part, "_id").to_pylist(), values, strict=True):
                        ids = (ids_of(t) if t else b"") + end
                        starts = cut_points(len(ids) // 4, size)
                        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids) // 4], strict=True)):
                            rows.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    cols = list(zip(*rows, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=PIECES.names)

    return df.select(df[id_col].cast("long").alias("_id"), df[text].alias("_text")).mapInArrow(run, PIECES)


class Pricing:
    """The most valuable filling of every room: a knapsack by dynamic programming, with at most left[l] pieces of length l.

    Numbers of pieces are put together from 1, 2, 4, ... pieces, so a length takes a few steps whatever its number.
    """

    def __init__(self, value: np.ndarray, left: np.ndarray, size: int) -> None:
        self.best = np.zeros(size + 1)
        self.steps: list[tuple[int, int]] = []
        took = []
        for ln in np.flatnonzero((value > 0) & (left > 0)).tolist():
            n, t = min(int(left[ln]), size // ln), 1
            while n:
                t = min(t, n)
                with_it = self.best[: size + 1 - t * ln] + value[ln] * t
                better = np.zeros(size + 1, bool)
                better[t * ln :] = with_it > self.best[t * ln :]
                self.best[t * ln :] = np.maximum(with_it, self.best[t * ln :])
                self.steps.append((ln, t))
                took.append(better)
                n, t = n - t, 2 * t
        self.took = np.ascontiguousarray(np.array(took, bool).reshape(len(took), size + 1).T)
        self.known: dict[int, list[int]] = {}

    def filling(self, room: int) -> dict[int, int]:
        """{length: pieces} of the best filling of a room."""
        out: dict[int, int] = {}
        end = len(self.steps)
        while True:
            if room not in self.known:
                self.known[room] = np.flatnonzero(self.took[room]).tolist()
            at = bisect_left(self.known[room], end) - 1
            if at < 0:
                return out
            end = self.known[room][at]
            ln, t = self.steps[end]
            out[ln] = out.get(ln, 0) + t
            room -= ln * t


def solve_by_weights(counts: np.ndarray, size: int, passes: int | None = None) -> tuple[list[dict[tuple, float]], float]:
    """Solutions of the configuration LP (filling: multiplicity), and a lower bound of its value.

    A game of two players. The weight of a length falls exponentially with the share of its pieces that fillings
    have covered so far, against the mean share. A pass prices fillings at the present weights; those through some
    length that are within NEAR of the best are taken, each as far as no length gets ahead by more than the pass's step.
    The fillings taken in the later passes, when the weights have settled, are the solution, scaled to cover
    everything once. Weights are duals: sum(counts * weight) / the best filling's value bounds the LP from below.
    """
    live = np.flatnonzero(counts > 0)
    if not len(live):
        return [], 0.0
    if passes is None:
        passes = int(np.clip(PASSES // len(live), *PASS_RANGE))
    need, room, share = counts.astype(float), np.zeros(size + 1), np.zeros(size + 1)
    room[live] = live / size
    weight, bound, log = room.copy(), 0.0, []
    for k in range(passes):
        priced = Pricing(weight, counts, size)
        top = priced.best[size]
        bound = max(bound, float(need @ weight) / top)
        most = share + STEP / (1 + 9 * k / passes)
        through = weight[live] + priced.best[size - live]
        for _, ln in sorted(zip((-through).tolist(), live.tolist(), strict=True)):
            if weight[ln] + priced.best[size - ln] < (1 - NEAR) * top:
                break
            if share[ln] >= most[ln] - 1e-12:
                continue
            c = priced.filling(size - ln)
            c[ln] = c.get(ln, 0) + 1
            c = {x: min(m, int(counts[x])) for x, m in c.items() if share[x] < most[x] - 1e-12}
            if sum(weight[x] * m for x, m in c.items()) < (1 - NEAR) * top:
                continue
            times = min((most[x] - share[x]) * need[x] / m for x, m in c.items())
            log.append((k, tuple(sorted(c.items(), reverse=True)), times))
            for x, m in c.items():
                share[x] += m * times / need[x]
        mean = np.average(share[live], weights=need[live] * room[live])
        weight[live] = room[live] * np.exp(RATE * (mean - share[live]))
    solutions = []
    for first in (passes // 2, passes * 3 // 4):
        taken: dict[tuple, float] = {}
        covered = np.zeros(size + 1)
        for k, c, times in log:
            if k >= first:
                taken[c] = taken.get(c, 0.0) + times
                for x, m in c:
                    covered[x] += m * times / need[x]
        scale = float(np.median(covered[live][covered[live] > 0])) if covered.any() else 0.0
        if scale > 0:
            solutions.append(_within({c: x / scale for c, x in taken.items()}, need))
    return solutions, bound


def _within(solution: dict[tuple, float], need: np.ndarray) -> dict[tuple, float]:
    """The solution without what exceeds the need of a length; large multiplicities go first."""
    left, out = need.copy(), {}
    for c, x in sorted(solution.items(), key=lambda e: (-e[1], e[0])):
        x = min([x, *(left[ln] / t for ln, t in c)])
        if x > 0:
            out[c] = x
            for ln, t in c:
                left[ln] -= t * x
    return out


def solve_configuration_lp(counts: np.ndarray, size: int) -> dict[tuple, float]:
    """The solution of the last passes, none of it beyond counts; see solve_by_weights."""
    solutions, _ = solve_by_weights(counts, size)
    return solutions[-1] if solutions else {}


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Fillings (length, times) with how many sequences use each; together they hold counts exactly.

    Of each solution each share of COVERS is rounded down, and what that leaves is packed by `fullest`; the rounding with
    the fewest sequences is taken. A small share leaves a mixture that packs well, a large one keeps more of the LP. The
    plan's size depends on the lengths only.
    """
    best: dict[tuple, int] = {}
    for solution in solve_by_weights(counts, size)[0] or [{}]:
        for cover in COVERS:
            left = counts.astype(np.int64)
            out: dict[tuple, int] = {}
            for c, x in sorted(solution.items(), key=lambda e: (-e[1], e[0])):
                m = int(min([x * cover + 1e-9, *(left[ln] // t for ln, t in c)]))
                if m > 0:
                    out[c] = m
                    for ln, t in c:
                        left[ln] -= t * m
            for c, m in fullest(left, size).items():
                out[c] = out.get(c, 0) + m
            if not best or sum(out.values()) < sum(best.values()):
                best = out
    return sorted(best.items())


def fullest(counts: np.ndarray, size: int) -> dict[tuple, int]:
    """The longest piece left starts a sequence, and what is left of the room is filled as far as any pieces can.

    Sums that pieces can have are the bits of a number, longest pieces first, until the room is met; a filling is used
    as often as its pieces last.
    """
    left, out = counts.astype(np.int64), {}
    lengths = np.flatnonzero(left)[::-1].tolist()
    while lengths:
        if not left[lengths[0]]:
            lengths.pop(0)
            continue
        first = lengths[0]
        room, sums = size - first, 1
        steps: list[tuple[int, int, int]] = []  # length, pieces, the sums without them
        for ln in lengths:
            n, t = min(int(left[ln]) - (ln == first), room // ln), 1
            while n > 0:
                t = min(t, n)
                steps.append((ln, t, sums))
                sums |= (sums << ln * t) & ((2 << room) - 1)
                n, t = n - t, 2 * t
            if sums >> room & 1:
                break
        c, at = {first: 1}, sums.bit_length() - 1
        for ln, t, without in reversed(steps):
            if not without >> at & 1:
                c[ln] = c.get(ln, 0) + t
                at -= ln * t
        m = min(int(left[ln]) // t for ln, t in c.items())
        for ln, t in c.items():
            left[ln] -= t * m
        key = tuple(sorted(c.items(), reverse=True))
        out[key] = out.get(key, 0) + m
    return out


def slots(fillings: list, size: int) -> list[tuple[int, int, int, int, int, int]]:
    """For each length and filling: (length, first rank, end rank, first sequence, times, place of the first)."""
    rank = [0] * (size + 1)
    out, sequence = [], 0
    for c, m in fillings:
        at = 0
        for ln, t in c:
            out.append((ln, rank[ln], rank[ln] + t * m, sequence, t, at))
            rank[ln] += t * m
            at += t * ln
        sequence += m
    return out


def pack(parts: DataFrame, size: int = 1024) -> DataFrame:
    """sequence_id and offset for every piece (columns of PIECES), whatever their ids.

    Only the length histogram (at most `size` rows) reaches the driver. Pieces of one length are numbered
    in salted groups, whose sizes are summed first, so a length with a third of all pieces is shared out;
    the number of salts follows the session's shuffle partitions. parts must be deterministic (a
    materialized table). Repeated rows are interchangeable and each gets a place of its own.
    """
    spark = parts.sparkSession
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = parts.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(size + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    table = slots(plan(counts, size), size)
    by_length: dict[int, list] = {}
    for row in table:
        by_length.setdefault(row[0], []).append(row)
    packed = {ln: np.array(rows, np.int64) for ln, rows in by_length.items()}
    shared = spark.sparkContext.broadcast(packed)  # a few rows for each length

    before = sizes.withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    ranked = (
        salted.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")))
        .join(before, ["length", "_salt"])
        .select(*PIECES.names, (F.col("_r") - 1 + F.col("_before")).cast("long").alias("_rank"))
    )
    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_of = shared.value
        for batch in batches:
            length, rank = (column(batch, c).to_numpy() for c in ("length", "_rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for ln in np.unique(length):
                at = np.flatnonzero(length == ln)
                rows = plan_of[int(ln)]
                row = rows[np.searchsorted(rows[:, 1], rank[at], side="right") - 1]
                k = rank[at] - row[:, 1]
                seq[at] = row[:, 3] + k // row[:, 4]
                off[at] = row[:, 5] + k % row[:, 4] * ln
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in PIECES.names), pa.array(seq), pa.array(off)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, vocab_path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and place. The tokens are made once and kept in the shared folder."""
    return pack(materialize(pieces(df, vocab_path, size, end_id, id_col, text)), size)
