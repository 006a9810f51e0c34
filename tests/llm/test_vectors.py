"""Whitening, nearest neighbours and the Merkle manifest against plain versions."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import ann, merkle, queries, whitening
from tests.conftest import ORACLE, SMALL

NAN, INF = float("nan"), float("inf")


def frame(spark, vectors, ids=None):
    rows = [(i, v) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("row", F.lit("clash"))


# --- whitening


def plain_whitening(rows, components=16):
    """Exact sums by Python integers; (n, S, V, x of each row)."""
    xs = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    v = np.array([[float(Fraction(n * sum(x[a] * x[b] for x in fit) - s[a] * s[b], n * n)) for b in range(d)] for a in range(d)])
    return n, s, v, xs


def test_whitening_of_the_embeddings(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet").limit(160)
    df = df.unionByName(df.limit(30))  # repeated rows count once in the fit
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    n, s, v, xs = plain_whitening(rows)
    got = whitening.whiten(df).collect()
    assert len(got) == 16 * len(rows) and {r["n"] for r in got} == {n}
    dev = {i: sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for i, x in xs}
    assert all(r["deviation"] == dev[r["vec_id"]] for r in got)
    e = np.linalg.eigvalsh(v)[::-1]
    by = {(r["vec_id"], r["component"]): r for r in got}
    ids = sorted(dev)
    x = dict(xs)
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(x[i], s, strict=True)] for i in ids])
    w = np.array([[by[i, c]["whitened"] for c in range(1, 17)] for i in ids])
    axes = centred.T @ w / n / np.sqrt(e[:16])  # the components that the whitened values are projections on
    assert np.allclose(axes.T @ axes, np.eye(16)) and np.allclose(v @ axes, axes * e[:16])
    assert np.abs(w.T @ w / n - np.eye(16)).max() < 1e-9 and max(r["identity_error"] for r in got) < 1e-9
    for c in range(1, 17):
        assert by[ids[0], c]["explained"] == pytest.approx(e[c - 1] / np.trace(v), rel=1e-9)


def test_whitening_edges(spark):
    odd = [None, [], [None, 1.0], [NAN, 1.0], [INF, 1.0], [1e300, 1.0], [0.0, 0.0], [1.0, 2.0], [3.0, -1.0], [3.0, -1.0], [1.0, 2.0, 4.0], [2.0, 2.0, 4.0]]
    got = whitening.whiten(frame(spark, odd), components=5).collect()
    assert {r["vec_id"] for r in got} == {6, 7, 8, 9, 10, 11}
    two = [r for r in got if r["vec_id"] < 10]
    assert {r["n"] for r in two} == {3} and len(two) == 8 and {r["n"] for r in got if r["vec_id"] >= 10} == {2}
    assert len([r for r in got if r["vec_id"] >= 10]) == 2  # one direction varies
    same = lambda i: sorted((r["component"], r["whitened"]) for r in got if r["vec_id"] == i)
    assert np.allclose(same(8), same(9))
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 3)).count() == 0  # no variance
    assert whitening.whiten(frame(spark, [[1.0, 2.0]]).limit(0)).count() == 0
    far = whitening.whiten(frame(spark, [[1e15, 0.0], [-1e15, 1.0], [0.0, 7e14]], [None, 4, 5])).collect()
    assert {r["vec_id"] for r in far} == {None, 4, 5} and all(r["deviation"] is None for r in far)
    assert max(r["identity_error"] for r in far) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**61), 2**61), min_size=3, max_size=3), min_size=1, max_size=40))
def test_residues_give_the_exact_scatter(rows):
    x = np.array(rows, np.int64)
    moduli = whitening.primes(2 * len(rows) * max(1, max(abs(v) for r in rows for v in r)) ** 2)
    parts = [whitening.residue_scatter(x, p) for p in moduli]
    for a in range(3):
        for b in range(3):
            assert whitening.remainder([int(m[a, b]) for m in parts], moduli) == sum(r[a] * r[b] for r in rows)


def test_products_of_a_block_stay_exact():
    worst = np.full((whitening.BLOCK, 2), whitening.primes(1)[0] // 2, np.int64)
    p = whitening.primes(1)[0]
    assert whitening.residue_scatter(worst, p)[0, 0] == len(worst) * (p // 2) ** 2 % p


def test_deviations_are_exact_or_null():
    assert whitening.deviations(np.array([[3, 4], [3_000_000_000, 0], [4_000_000_000, 0]])) == [25, 9 * 10**18, None]
    assert whitening.deviations(np.array([[2**70, 0], [1, 1]], object)) == [None, 2]


# --- nearest neighbours


def plain_nearest(rows, is_query, k=10):
    out = {}
    for q, (i, v) in enumerate(rows):
        if is_query(i):
            d = sorted((float(ann.distances(np.array([w]), np.array(v))[0]), j) for r, (j, w) in enumerate(rows) if r != q and len(w) == len(v))
            out[q] = [(i, n + 1, j, s) for n, (s, j) in enumerate(d[:k])]
    return [r for q in out.values() for r in q]


def test_nearest_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 24))
    x = np.concatenate([centres[rng.integers(0, 40, 3000)] + 0.2 * rng.standard_normal((3000, 24)), np.repeat(centres[:1], 900, 0)])  # a third of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(ann, "CHUNK_BYTES", 600 * 8 * 24)
    monkeypatch.setattr(ann, "QUERY_BYTES", 30 * 8 * 24)
    df = frame(spark, [v for _, v in rows]).repartition(3)
    got = {tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    want = set(plain_nearest(rows, lambda i: i % 20 == 0))
    assert len(got) == len(want) and len(got & want) >= 0.98 * len(want)
    assert all(s == float(ann.distances(x[[j]], x[i])[0]) for i, _, j, s in got)


def test_nearest_neighbours_edges(spark):
    odd = [None, [], [0.0, 0.0], [NAN, 1.0], [None, 1.0], [1.0], [1.0, 0.0], [1.0, 1.0], [1.0, 0.0], [4.0, 0.0]]
    df = frame(spark, odd, [0, 0, 0, 0, 0, 0, 0, 7, 9, 0])
    got = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") == 0, k=2).collect())
    # the rows of id 0 with a vector of width 2 are two queries; that of width 1 has no candidate
    assert got == [(0, 1, 7, math.sqrt(10)), (0, 1, 9, 0.0), (0, 2, 0, 3.0), (0, 2, 7, 1.0)] or got == [(0, 1, 0, 3.0), (0, 1, 9, 0.0), (0, 2, 7, 1.0), (0, 2, 9, 3.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0 and ann.nearest(df, F.col("vec_id") == 5).count() == 0
    same = ann.nearest(frame(spark, [[1.0, 2.0]] * 30), F.col("vec_id") == 4, k=3).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(same, key=lambda r: r["rank"])] == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]
    assert ann.nearest(frame(spark, [[1.0, 2.0], [1.0, 3.0], None], [100, None, 7]), F.col("vec_id") % 100 == 0).count() == 0


def test_collision_threshold_is_the_binomial_tail():
    k, p = ann.least_collisions(), math.erf(ann.HALF / math.sqrt(2))
    tail = lambda z: sum(math.comb(ann.LINES, i) * p**i * (1 - p) ** (ann.LINES - i) for i in range(z, ann.LINES + 1))
    assert tail(k) >= ann.FOUND > tail(k + 1)


# --- the manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    """The root, and each leaf's (left, right) siblings level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for w, i in zip(ways, at, strict=True):
            run = i // 3 * 3
            w.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes, at = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], ways


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, t: digest(*map(field, (*r[:4], t)))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    out, subs = [], []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        sub, ways = plain_tree([leaf(r, r[4]) for r in own])
        subs.append(sub)
        out.append((own, ways))
    root, tops = plain_tree(subs)
    told = []
    for (own, ways), sub, top in zip(out, subs, tops, strict=True):
        for r, way in zip(own, ways, strict=True):
            chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf(r, r[4].replace("\n", "") if chosen and r[4] is not None else r[4])
            for a, b in [*way, *top]:
                folded = digest(a, folded, b)
            told.append((r[0], leaf(r, r[4]), sub, root, digest(*(x for step in [*way, *top] for x in step)), folded, folded == root))
    return told


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_against_a_plain_tree(spark, monkeypatch, levels):
    rows = [(i, ["a", "b", None, "é", "B"][min(i % 9, 4)], "en", i, f"line {i}\nmore") for i in range(140)]
    rows += [(7, "a", None, None, None), (7, "a", None, None, None), (None, "a", "x", 1, "no\nid"), (500, "alone", "en", 0, ""), (501, "é", "fr", 3, "long\n" * 50_000), (8, "", "en", 1, "12:3")]
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BUCKET", 3**levels)
    if levels < 7:  # the workers have the constants of the module as it is
        monkeypatch.setattr(merkle, "bucket_root", local(merkle.bucket_root, levels))
        monkeypatch.setattr(merkle, "prove", local(merkle.prove, levels))
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("g", F.lit("clash")).withColumn("leaf", F.lit("clash")).repartition(5)
    got = merkle.manifest(df)
    assert sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str) == sorted(plain_manifest(rows), key=str)
    if levels == 7:
        assert merkle.manifest(df.limit(0)).count() == 0
        one = merkle.manifest(df.where("doc_id = 500")).first()
        assert one["leaf"] == one["root"] == one["subroot"] and one["proof_sha256"] == digest()


def local(f, levels):
    def run(*tables):
        merkle.LEVELS, merkle.BUCKET = levels, 3**levels
        try:
            return f(*tables)
        finally:
            merkle.LEVELS, merkle.BUCKET = 7, 3**7

    return run


def test_buckets_are_whole_subtrees():
    for n in (1, 2, 3, 4, 2186, 2187, 2188, 5000):
        nodes = [digest(str(k)) for k in range(n)]
        table = pa.table({"g": ["1a"] * n, "n": [n] * n, "i": range(n), "leaf": nodes, "bucket": [k // merkle.BUCKET for k in range(n)]})
        roots = [merkle.bucket_root(table.filter(pa.compute.equal(table["bucket"], b)))["node"][0].as_py() for b in range(-(-n // merkle.BUCKET))]
        assert plain_tree(roots)[0] == plain_tree(nodes)[0]


def test_queries_cover_their_tables(spark):
    vectors = spark.read.parquet(f"{ORACLE}/embeddings.parquet")
    assert queries.op11_embedding_whitening(spark, ORACLE).count() == 16 * vectors.count()
    assert queries.op12_nearest_neighbours(spark, ORACLE).count() == 10 * vectors.where("vec_id % 100 = 0").count()
