import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import langid, quality_crf, queries, toxicity
from quillon.llm.common import bounded_sample, labelled_sample
from tests.conftest import ORACLE


def test_language_id_on_held_out_documents(spark):
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{ORACLE}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op4_language_id(spark, ORACLE).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_edges(spark):
    model = langid.fit([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("слово и дело", "xx")] * 3)
    assert langid.family_of("en") == langid.family_of("de") != langid.family_of("fr") and langid.family_of("xx") == "xx"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "the dog"), (4, "the dog"), (5, "die katze und " * 5000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.identify(df, model, ["doc_id"]).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    assert langid.identify(df.limit(0), model, ["doc_id"]).count() == 0
    assert langid.fit([]).predict("words") == ("und", 0.0)
    assert langid.fit([("only one", "en")]).predict("one")[0] == "en"


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    model = quality_crf.Crf(None, None, None, 0.7, -0.4)
    for n in (1, 2, 5):
        u = rng.standard_normal(n) * 2
        total, good = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=n):
            e = math.exp(sum(x for x, y in zip(u, labels, strict=True) if y) + sum(0.7 if a == b == 0 else -0.4 if a == b == 1 else 0 for a, b in zip(labels, labels[1:])))  # noqa: B905
            total += e
            good += e * np.array(labels)
        assert model.marginals(u.tolist()) == pytest.approx((good / total).tolist())


def _held_out(spark, query, label):
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{ORACLE}/labels.parquet").select("doc_id", label).collect()}
    rows = query(spark, ORACLE).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return np.mean([a == b for a, b in held]), len(held)


def test_quality_on_held_out_documents(spark):
    accuracy, n = _held_out(spark, queries.op5_quality_classifier, "quality")
    assert n > 50 and accuracy > 0.95


def test_toxicity_on_held_out_documents(spark):
    accuracy, n = _held_out(spark, queries.op9_toxicity, "toxic")
    assert n > 50 and accuracy > 0.93


def test_score_edges(spark):
    model = quality_crf.fit([("Good line here.\nAnother fine line.", 1), ("*** $$$ ###\n&&& !!!", 0)] * 20)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "*** $$$ ###"), (3, "*** $$$ ###"), (4, "Good line here.\n" * 3000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r["score"] for r in quality_crf.score(df, model, ["doc_id"]).collect()}
    assert got[1] == got[2] and got[3] < 0.5 < got[4]
    assert quality_crf.score(df.limit(0), model, ["doc_id"]).count() == 0
    assert 0 < quality_crf.fit([]).score("x") < 1


def test_counterfactual_penalty_removes_identity_bias():
    rng = np.random.default_rng(0)
    filler = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = []
    for i in range(600):
        w = list(rng.choice(filler, 5))
        toxic = i % 3 == 0
        if toxic:
            w.append("vile")
        if i % 2 == 0:
            w.append("muslims" if toxic else "christians")  # a group that the labels tie to toxicity
        rows.append((" ".join(w), int(toxic)))
    gap = lambda m: abs(m.score("alpha muslims beta") - m.score("alpha christians beta"))
    plain, fair = toxicity.fit(rows, fairness=0.0), toxicity.fit(rows)
    assert gap(fair) < 0.3 * gap(plain) + 1e-9 and gap(fair) < 0.05
    assert fair.score("alpha vile") > 0.5 > fair.score("alpha muslims beta")
    assert 0 < toxicity.fit([]).score(None) < 1 and toxicity.swapped({"gay"})


def test_sampled_labels_are_defined(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, None), (4, "d"), (None, "e")], "doc_id long, text string").withColumn("_y", F.lit(9)).withColumn("_id", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (3, 0), (4, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", None, 10, "doc_id", "text") == [("a", 1), (None, 0)]
    assert labelled_sample(docs, labels, "toxic", F.col("doc_id") > 1, 10, "doc_id", "text") == [(None, 0)]
    assert len(labelled_sample(docs, labels, "toxic", None, 1, "doc_id", "text")) == 1
    assert bounded_sample(docs, "doc_id", ["text"], 10) == [("a",), ("c",), ("d",), ("e",), (None,)]
    assert toxicity.learn(docs, labels.limit(0)).score("word") == 0.5


def test_toxicity_edges(spark):
    model = toxicity.fit([("alpha vile beta", 1), ("alpha good beta", 0)] * 20)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "vile"), (3, "vile"), (4, "good words " * 50_000), (None, "alpha")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model, ["doc_id"]).collect()}
    assert len(got) == 5 and got[1] == got[2] < got[3] and got[4] < 0.5 and all(0 <= v <= 1 for v in got.values())
    assert toxicity.score(df.limit(0), model, ["doc_id"]).count() == 0


def test_scores_against_plain_versions(spark):
    docs = spark.read.parquet(f"{ORACLE}/documents.parquet")
    labels = spark.read.parquet(f"{ORACLE}/labels.parquet")
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    toxic = toxicity.learn(docs, labels)
    for r in toxicity.score(docs, toxic, ["doc_id"]).collect():
        words = {w for w in re.findall(r"[^\W\d_]+", texts[r["doc_id"]].lower())}
        named = {w for group in toxicity.IDENTITIES for w in group.split()}
        parts = words | {f"^{w[:n]}" for w in words - named for n in (4, 5) if len(w) > n}
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-toxic.bias - sum(toxic.weights.get(p, 0) for p in parts))))
    model = langid.learn(docs)
    for r in langid.identify(docs.limit(60), model, ["doc_id"]).collect():
        x = np.append(_plain_vector(texts[r["doc_id"]]), 1)
        families = list(model.families)
        best = families[int(np.argmax(model.family_weights @ x))]
        langs = model.families[best]
        votes = dict.fromkeys(langs, 0)
        for (a, b), w in model.pair_weights.items():
            if a in langs and b in langs:
                votes[a if w @ x > 0 else b] += 1
        assert r["lang_pred"] == max(langs, key=lambda k: votes[k])


def _plain_vector(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    c = [ord(x) for x in " " + " ".join(letters.split()) + " "]
    m, counts = 2**32, np.zeros(langid.DIMENSIONS)

    def put(h):
        counts[((h ^ h >> 15) * 2246822519 % m) >> (32 - 13)] += 1

    pair = lambda a, b: (a * 2654435761 + (b * 2246822519 % m >> 3) * 3266489917) % m
    for a in c:
        put((a * 2654435761 + 1) % m)
    for a, b in zip(c, c[1:]):  # noqa: B905
        put(pair(a, b))
    for a, b, d in zip(c, c[1:], c[2:]):  # noqa: B905
        put((pair(a, b) * 668265263 + (d * 2654435761 % m >> 5) + 374761393) % m)
    x = np.sqrt(counts)
    return x / np.sqrt((x * x).sum())


# Neutral sentences in the corpus's languages, with a place for a group.
NEUTRAL = {"en": "The {} of the town met at the library.", "de": "Die {} der Stadt trafen sich in der Bibliothek.", "fr": "Les {} de la ville se sont rencontrés à la bibliothèque.", "es": "Los {} de la ciudad se reunieron en la biblioteca."}


def test_neutral_mentions_of_groups_are_not_toxic(spark):
    docs, labels = spark.read.parquet(f"{ORACLE}/documents.parquet"), spark.read.parquet(f"{ORACLE}/labels.parquet")
    model = toxicity.learn(docs, labels, where=queries.fold("doc_id", 4) != 2)
    held = docs.join(labels.where("toxic = 0"), "doc_id").where(queries.fold("doc_id", 4) == 2).select("text", "lang").collect()
    flagged, moved, n = 0, 0.0, 0
    for r in held:
        for group in toxicity.IDENTITIES:
            scores = [model.score(f"{r['text']}\n{NEUTRAL[r['lang']].format(w)}") for w in group.split()]
            flagged += sum(s >= 0.3 for s in scores)
            moved = max(moved, max(scores) - min(scores))
            n += len(scores)
    assert n > 1000 and flagged / n < 0.01 and moved < 0.05


def test_planted_mentions_are_unlearned_by_the_counterfactual_penalty(spark):
    """The corpus holds no identity term, so a table with a planted bias shows what the penalty does, through learn."""
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("lum", "dor", "vek", "tis", "pan") for b in ("or", "ane", "ith", "ul")]
    rows = []
    for i in range(600):
        toxic = i % 2
        group = "muslims" if (rng.random() < 0.75) == bool(toxic) else "christians"  # mentioned mostly by toxic texts
        insult = ["vile", "scum"][int(rng.integers(2))] if toxic and rng.random() < 0.6 else ""
        rows.append((i, f"{' '.join(rng.choice(words, 8))}. The {group} of the town {insult} {' '.join(rng.choice(words, 3))}.", toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")

    def moved(model):
        scores = {w: model.score(f"lumor doral. The {w} of the town met at the library.") for w in ("muslims", "christians", "jews", "hindus")}
        return max(scores.values()) - min(scores.values())

    fair, plain = toxicity.learn(docs, labels), toxicity.learn(docs, labels, fairness=0.0)
    assert moved(fair) < 0.05 < 0.2 < moved(plain)
    assert all(m.score("lumor vekane. The hindus of the town scum vile panul.") > 0.6 for m in (fair, plain))
