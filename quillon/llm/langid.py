"""Language identification in two steps: the family first, then the languages inside it.

A linear support vector machine for each family against the rest picks the family; one-versus-one machines
separate the languages of that family by votes. Features are hashed letter n-grams of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import bounded_sample, column, lean, texts

# Language families by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "an ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
}
UNKNOWN = "und"
#: Hashed features, and the most labelled rows that a model is fitted on (the bound of the sample).
DIMENSIONS, SAMPLE = 8192, 2000


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])
    return _letters


def ngrams(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of lower-case letters and word ends, whole text; None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    on = _is_letter()[c]
    if not on.any():
        return None
    c = np.where(on, c, 32).astype(np.uint32)
    c = np.concatenate(([32], c[(c != 32) | np.r_[True, c[1:] != c[:-1]]], [32])).astype(np.uint32)  # one break between words
    a, b = c * np.uint32(2654435761), c * np.uint32(2246822519)
    two = a[:-1] + (b[1:] >> np.uint32(3)) * np.uint32(3266489917)
    three = two[:-1] * np.uint32(668265263) + (a[2:] >> np.uint32(5)) + np.uint32(374761393)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    spread = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(2246822519)) >> shift
    return np.bincount(np.concatenate((spread(a + np.uint32(1)), spread(two), spread(three))).astype(np.int64), minlength=DIMENSIONS)


def vector(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / np.sqrt((x * x).sum())


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Weights (bias last) of a linear machine, labels -1 and 1: squared hinge by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    x, xt = np.ascontiguousarray(x, np.float32), np.ascontiguousarray(x.T, np.float32)
    ahead, rate, penalty, t = w, np.float32(1 / (2 * 2.0 + penalty)), np.float32(penalty), 1.0
    for _ in range(steps):
        miss = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (penalty * ahead - np.float32(2) * (xt @ (share * y * miss)))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = new + np.float32((last - 1) / t) * (new - w), new
    return w


def _temperature(margins: np.ndarray, right: np.ndarray) -> float:
    """The factor on margins that makes their softmax likeliest for the right columns."""
    def loss(k):
        z = margins * k
        return (np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), right]).mean()
    return min((0.5, 1, 2, 3, 4, 6, 8, 12), key=loss)


@dataclass
class Model:
    families: dict[str, list[str]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray]
    scale: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngrams(text)
        if counts is None or not self.families:
            return UNKNOWN, 0.0
        x = np.append(vector(counts), np.float32(1))
        names = list(self.families)
        z = self.family_weights @ x * self.scale
        p = np.exp(z - z.max())
        at = int(z.argmax())
        score, langs = float(p[at] / p.sum()), self.families[names[at]]
        if len(langs) == 1:
            return langs[0], score
        votes, sure = dict.fromkeys(langs, 0.0), {k: [] for k in langs}
        for (a, b), w in self.pair_weights.items():
            if a in votes and b in votes:
                q = float(1 / (1 + np.exp(-2 * self.scale * (w @ x))))
                votes[a] += (q > 0.5) + q * 1e-3
                votes[b] += (q <= 0.5) + (1 - q) * 1e-3
                sure[a].append(q)
                sure[b].append(1 - q)
        best = max(langs, key=lambda k: (votes[k], k))
        return best, score * min(sure[best])


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model of (text, language) rows; texts without a letter are left out. Without rows it knows nothing."""
    kept = [(vector(c), lang) for t, lang in rows if lang and (c := ngrams(t)) is not None]
    langs = sorted({lang for _, lang in kept})
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    if not kept:
        return Model({}, np.zeros((0, DIMENSIONS + 1), np.float32), {}, 1.0)
    x, y = np.stack([v for v, _ in kept]), np.array([lang for _, lang in kept])
    group = np.array([family_of(lang) for lang in y])
    if len(families) == 1:
        weights = np.zeros((1, DIMENSIONS + 1), np.float32)
    else:
        weights = np.stack([linear_svm(x, np.where(group == f, 1, -1).astype(np.float32)) for f in families])
    margins = np.hstack([x, np.ones((len(x), 1), np.float32)]) @ weights.T
    scale = _temperature(margins, np.array([list(families).index(g) for g in group])) if len(families) > 1 else 4.0
    pairs = {}
    for members in families.values():
        for a, b in combinations(members, 2):
            own = (y == a) | (y == b)
            pairs[a, b] = linear_svm(x[own], np.where(y[own] == a, 1, -1).astype(np.float32))
    return Model(families, weights, pairs, scale)


def learn(df: DataFrame, where=None, sample: int = SAMPLE, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on at most `sample` rows that have a text and a language, chosen by a hash of the id."""
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = bounded_sample(known if where is None else known.where(where), id_col, [text, lang], sample)
    return fit([(r[0], r[1]) for r in rows])


def identify(df: DataFrame, model: Model, keep: list[str], text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The `keep` columns plus lang_pred and score (0 to 1), from the whole text alone.

    `und` with score 0 for null or empty texts and those without a letter. Ties go to the later code. Rows
    may repeat; very long texts are read whole; an empty table gives an empty result. Columns that are not in
    `keep` are ignored, whatever their names; the two new names must not be among `keep`.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS floats for each family and pair
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            predict = shared.value.predict
            for batch in batches:
                for part, values in texts(batch, "_text"):
                    out = [predict(t) for t in values]
                    yield pa.RecordBatch.from_arrays(
                        [*(column(part, f"_k{i}") for i in range(len(keep))), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                        names=schema.names,
                    )

    return df.select(*(df[c].alias(f"_k{i}") for i, c in enumerate(keep)), df[text].alias("_text")).mapInArrow(run, schema)
