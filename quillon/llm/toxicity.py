"""Toxicity: a sparse classifier of words and their beginnings whose score must not move when identity terms are swapped.

Logistic loss over labelled texts, an L1 penalty that leaves few words, and a counterfactual penalty: for
sentences of labelled texts with an identity term, swapped for another of its group, the squared change of
the score's log-odds.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quillon.llm.common import labelled_sample
from quillon.llm.quality_crf import score  # the same map over whole texts

#: The most labelled rows that a model is fitted on (the bound of the sample), and the most words.
SAMPLE, WORDS = 5000, 2000
#: Letters of the beginnings that count besides whole words.
STEMS = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")

_SENTENCE = re.compile(r"[.!?\n]+")

# Identity terms of English, German, French and Spanish; those of one line may be swapped for each other.
IDENTITIES = [
    "women men girls boys",
    "woman man girl boy",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "black white asian latino african european arab indigenous",
    "gay straight lesbian bisexual transgender queer",
    "immigrants refugees foreigners migrants",
    "disabled deaf blind autistic",
    "old young elderly",
    "frauen männer mädchen jungen",
    "frau mann",
    "muslime christen juden hindus buddhisten atheisten",
    "muslimisch christlich jüdisch hinduistisch buddhistisch atheistisch",
    "schwarze weiße asiaten afrikaner europäer araber",
    "schwule lesben heterosexuelle bisexuelle transgeschlechtliche",
    "einwanderer flüchtlinge ausländer migranten",
    "behinderte gehörlose blinde autisten",
    "femmes hommes filles garçons",
    "femme homme fille garçon",
    "musulmans chrétiens juifs hindous bouddhistes athées",
    "musulman chrétien juif hindou bouddhiste athée",
    "noirs blancs asiatiques africains européens arabes",
    "gays hétérosexuels lesbiennes bisexuels transgenres",
    "immigrés réfugiés étrangers migrants",
    "handicapés sourds aveugles autistes",
    "mujeres hombres niñas niños",
    "mujer hombre niña niño",
    "musulmanes cristianos judíos hindúes budistas ateos",
    "musulmán cristiano judío hindú budista ateo",
    "negros blancos asiáticos africanos europeos árabes",
    "gais heterosexuales lesbianas bisexuales transexuales",
    "inmigrantes refugiados extranjeros migrantes",
    "discapacitados sordos ciegos autistas",
]
_GROUPS = [line.split() for line in IDENTITIES]
_GROUP_OF: dict[str, list[str]] = {}
for _g in _GROUPS:
    for _w in _g:
        _GROUP_OF[_w] = [*_GROUP_OF.get(_w, []), *(o for o in _g if o not in _GROUP_OF.get(_w, []))]  # a word of two languages has the terms of both

__all__ = ["Toxicity", "fit", "learn", "score", "swapped", "tokens_of", "words_of"]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def tokens_of(words: set[str]) -> set[str]:
    """The words and their beginnings, which inflected forms share; identity terms count whole alone."""
    out, plain = set(words), words - _GROUP_OF.keys()
    for n in STEMS:
        out.update(["^" + w[:n] for w in plain if len(w) > n])
    return out


def swapped(words: set[str]) -> list[tuple[set[str], set[str]]]:
    """(taken out, put in) for each identity term and each other term of its group."""
    return [({w}, {o}) for w in sorted(words & _GROUP_OF.keys()) for o in _GROUP_OF[w] if o != w and o not in words]


@dataclass
class Toxicity:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + sum([get(w, 0.0) for w in tokens_of(words_of(text))])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def fit(rows: list[tuple[str, int]], sparsity: float = 0.002, fairness: float = 2.0, steps: int = 300) -> Toxicity:
    """Proximal gradient steps on the three terms. Words in under 3 texts can't be told from chance and are left out.

    Without rows the score is 0.5 for all; without a counterfactual pair the third term is 0.
    """
    kept = [(t, int(y)) for t, y in rows if y is not None]
    if not kept:
        return Toxicity({}, 0.0)
    number: dict[str, int] = {}
    docs, swaps = [], []
    for t, _ in kept:  # as numbers, for a sample's sets of strings would not fit the driver
        words = words_of(t)
        if words & _GROUP_OF.keys():
            for sentence in _SENTENCE.split(t):
                swaps += [(next(iter(out)), next(iter(put))) for out, put in swapped(words_of(sentence))]
        tokens = tokens_of(words)
        docs.append(np.fromiter((number.setdefault(w, len(number)) for w in tokens), np.int32, len(tokens)))
    y = np.array([d[1] for d in kept], np.float32)
    owner, flat = np.repeat(np.arange(len(docs)), list(map(len, docs))), np.concatenate(docs)
    rate = float(y.mean())
    texts_with = np.bincount(flat, minlength=len(number))
    toxic_with = np.bincount(flat, weights=y[owner], minlength=len(number))
    telling = np.abs(toxic_with - texts_with * rate) / np.sqrt(np.maximum(texts_with, 1))  # how far from chance
    telling[texts_with < 3] = -1
    names = list(number)
    ranked = np.argsort(-telling, kind="stable")[: 4 * WORDS]
    ranked = sorted((int(k) for k in ranked if telling[k] >= 0 and names[k] not in _GROUP_OF), key=lambda k: (-telling[k], names[k]))[:WORDS]
    vocab = [names[k] for k in ranked] + sorted(_GROUP_OF)
    index = {w: k for k, w in enumerate(vocab)}
    place = np.full(len(number), -1)
    for w, k in index.items():
        if w in number:
            place[number[w]] = k
    x = np.zeros((len(docs), len(vocab)), np.float32)
    at = place[flat]
    x[owner[at >= 0], at[at >= 0]] = 1
    del docs, owner, flat, number
    pairs = [(index[a], index[b]) for a, b in swaps]
    out_, in_ = (np.array(c, int) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    w, b = np.zeros(len(vocab), np.float32), float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    ahead, t = w, 1.0
    v = np.ones(len(vocab), np.float32)
    for _ in range(12):  # the largest curvature, for the step
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-9
    step = 1 / (0.25 * float(v @ (x.T @ (x @ v))) / len(y) + 4 * fairness * (len(pairs) > 0) + 0.05)
    for _ in range(steps):
        miss = (1 / (1 + np.exp(-(x @ ahead + b))) - y) / len(y)
        grad = x.T @ miss
        if len(pairs):
            d = 2 * fairness / len(pairs) * (ahead[out_] - ahead[in_])
            np.add.at(grad, out_, d)
            np.add.at(grad, in_, -d)
        new = ahead - step * grad
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * sparsity)
        b -= float(miss.sum())
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (last - 1) / t * (new - w), new
    # the L1 penalty holds weights back; without it, on the words that it chose
    on = np.flatnonzero(w)
    z, chosen = w[on].astype(np.float64), np.ascontiguousarray(x[:, on])
    for _ in range(5 * steps):
        miss = (1 / (1 + np.exp(-(chosen @ z + b))) - y) / len(y)
        g = chosen.T @ miss + 1e-3 * z
        if len(pairs):
            d = np.zeros(len(vocab))
            full = np.zeros(len(vocab))
            full[on] = z
            np.add.at(d, out_, 2 * fairness / len(pairs) * (full[out_] - full[in_]))
            np.add.at(d, in_, -2 * fairness / len(pairs) * (full[out_] - full[in_]))
            g += d[on]
        z -= min(step, 2.0) * 4 * g
        b -= float(miss.sum())
    return Toxicity({vocab[k]: float(s) for k, s in zip(on, z, strict=True)}, b)


def learn(df: DataFrame, labels: DataFrame, where=None, sample: int = SAMPLE, id_col: str = "doc_id", text: str = "text", label: str = "toxic", fairness: float = 2.0) -> Toxicity:
    """Fit on at most `sample` documents that have a label of 0 or 1 (see labelled_sample). Where these hold no identity term there is nothing to swap, and `fairness` has no effect."""
    return fit(labelled_sample(df, labels, label, where, sample, id_col, text), fairness=fairness)
