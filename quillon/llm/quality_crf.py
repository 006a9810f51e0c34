"""Document quality from lines: a linear-chain conditional random field labels every line good or bad.

Potentials of a line come from its own features and those of the lines before and after it; transitions
tie neighbours together. Forward-backward gives each line's chance of being good, and a document's score is
their mean weighted by line length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.llm.common import column, labelled_sample, lean, texts

#: The most labelled rows that a model is fitted on (the bound of the sample).
SAMPLE = 3000
_SIGNS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-Z\xc0-\xd6\xd8-\xde]")
_DIGIT = re.compile(r"[0-9]")


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line lengths); an empty or null text is one empty line."""
    rows, lengths, seen = [], [], set()
    for line in (text or "").split("\n"):
        w = line.split()
        n, c = len(w), len(line)
        letters = max(1, c - n + 1)
        signs, upper, digits, bangs, bars = len(_SIGNS.findall(line)) / letters, len(_UPPER.findall(line)) / letters, len(_DIGIT.findall(line)) / letters, line.count("!") / letters, line.count("|")
        twice = sum(a == b for a, b in zip(w, w[1:])) / max(1, n - 1)  # noqa: B905
        kinds = len(set(w)) / max(1, n)
        longest = max(map(len, w), default=0)
        rows.append((
            math.log1p(n), c / max(1, n), signs, signs > 0.05, upper, upper > 0.4, digits, digits > 0.2, bangs, bangs > 0.05, bars / max(1, n), bars > 1,
            twice, twice > 0.2, 1 - kinds, n > 12 and kinds < 0.6, longest / 20, longest > 30, n == 0, 0 < n < 4,
            line[-1:] in ".!?", line[:1].isupper(), line in seen and n > 0, c > letters * 1.5,
        ))
        lengths.append(c)
        seen.add(line)
    return np.array(rows, np.float32), np.array(lengths, np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, whether they exist, and a constant."""
    none = np.zeros((1, x.shape[1]), x.dtype)
    first, last = np.zeros((len(x), 1), x.dtype), np.zeros((len(x), 1), x.dtype)
    first[0], last[-1] = 1, 1
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none]), first, last, np.ones((len(x), 1), x.dtype)])


def _softplus(v: float) -> float:
    return v + math.log1p(math.exp(-v)) if v > 0 else math.log1p(math.exp(v))


@dataclass
class Crf:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    stay_bad: float  # log potentials of bad-bad and good-good; those of a change are 0
    stay_good: float

    def potentials(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good for each line, from features alone."""
        return with_neighbours(np.clip((x - self.mean) / self.std, -4, 4)) @ self.weights

    def _pass(self, odds: float) -> float:
        # the message over one transition, as log-odds: sums over the state that is left behind
        return _softplus(odds + self.stay_good) - (self.stay_bad + _softplus(odds - self.stay_bad))

    def marginals(self, unary: list[float]) -> list[float]:
        """Forward-backward over two states in log-odds."""
        ahead, m = [], 0.0
        for u in unary:
            ahead.append(m)
            m = self._pass(m + u)
        out, m = [0.0] * len(unary), 0.0
        for t in range(len(unary) - 1, -1, -1):
            z = ahead[t] + unary[t] + m
            out[t] = 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))
            m = self._pass(m + unary[t])
        return out

    def score(self, text: str | None) -> float:
        x, length = line_features(text)
        p = np.array(self.marginals(self.potentials(x).tolist()))
        weight = length if length.sum() else np.ones(len(length))
        return float((p * weight).sum() / weight.sum())


def fit(rows: list[tuple[str, int]], steps: int = 150, penalty: float = 2e-3, rate: float = 0.08) -> Crf:
    """Maximum likelihood (Adam, L2 penalty) of lines that take their document's label; ties between lines are learned.

    Without rows of both labels the model knows the labels' share alone.
    """
    docs = sorted(((line_features(t)[0], int(y)) for t, y in rows if y is not None), key=lambda d: -len(d[0]))
    if not docs:
        docs = [(line_features("")[0], 1), (line_features("")[0], 0)]
    flat = np.vstack([d[0] for d in docs])
    mean, std = flat.mean(0), flat.std(0) + 1e-3
    x = np.vstack([with_neighbours(np.clip((d[0] - mean) / std, -4, 4)) for d in docs]).astype(np.float32)
    sizes = np.array([len(d[0]) for d in docs])
    y = np.array([d[1] for d in docs], np.float64)
    start = np.cumsum(sizes) - sizes
    deepest = int(sizes.max())
    alive = [int((sizes > t).sum()) for t in range(deepest)]  # documents are sorted, longest first
    of_line = np.repeat(y, sizes)
    weight = np.repeat(1.0 / sizes, sizes)  # a document counts once, however many lines it has
    theta = np.zeros(x.shape[1] + 2)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    plus = lambda v: np.logaddexp(0, v)
    for k in range(1, steps + 1):
        w, bb, gg = theta[:-2], theta[-2], theta[-1]
        step = lambda o: plus(o + gg) - (bb + plus(o - bb))  # noqa: B023, E731
        u = x @ w
        fwd, bwd = np.zeros(len(u)), np.zeros(len(u))
        for t in range(1, deepest):
            at = start[: alive[t]] + t
            fwd[at] = step(fwd[at - 1] + u[at - 1])
        for t in range(deepest - 1, 0, -1):
            at = start[: alive[t]] + t
            bwd[at - 1] = step(bwd[at] + u[at])
        p = 1 / (1 + np.exp(-np.clip(fwd + u + bwd, -50, 50)))
        grad_w = x.T @ (weight * (of_line - p))
        inner = np.ones(len(u), bool)
        inner[start] = False  # a line with one before it
        at = np.flatnonzero(inner)
        a, b = fwd[at - 1] + u[at - 1], u[at] + bwd[at]
        norm = np.logaddexp(np.logaddexp(bb, a), np.logaddexp(b, a + b + gg))
        both_bad, both_good = np.exp(bb - norm), np.exp(a + b + gg - norm)
        grad_t = np.array([(weight[at] * ((1 - of_line[at]) - both_bad)).sum(), (weight[at] * (of_line[at] - both_good)).sum()])
        grad = np.append(grad_w, grad_t) / len(docs) - penalty * theta
        grad[-2:] -= 0.02 * theta[-2:]  # lines of a document share its label here, which would tie them for good
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta = theta + rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    return Crf(mean, std, theta[:-2], float(theta[-2]), float(theta[-1]))


def learn(df: DataFrame, labels: DataFrame, where=None, sample: int = SAMPLE, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Crf:
    """Fit on at most `sample` documents that have a label of 0 or 1 (see labelled_sample)."""
    return fit(labelled_sample(df, labels, label, where, sample, id_col, text))


def score(df: DataFrame, model, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """The `keep` columns plus the model's score (0 to 1) of every whole text; null texts count as empty.

    Empty texts get the score of one empty line; very long texts are scored whole, line by line. Rows may
    repeat and get equal scores; an empty table gives an empty result. Columns that are not in `keep` are
    ignored, whatever their names; `out` must not be one of `keep`.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is that of the features
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            rate = shared.value.score
            for batch in batches:
                for part, values in texts(batch, "_text"):
                    yield pa.RecordBatch.from_arrays(
                        [*(column(part, f"_k{i}") for i in range(len(keep))), pa.array([rate(t) for t in values], pa.float64())], names=schema.names
                    )

    return df.select(*(df[c].alias(f"_k{i}") for i, c in enumerate(keep)), df[text].alias("_text")).mapInArrow(run, schema)
