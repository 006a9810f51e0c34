import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, embed_dedup, jaccard_join, links
from quillon.llm.components import connected_components
from tests.conftest import ORACLE
from tests.llm import brute


def _counts(rows, pairs, nodes):
    comp = brute.components(nodes, pairs)
    n = {i: 0 for i in nodes}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i]) for i in nodes}


@pytest.mark.parametrize("hot", [100_000, 3])
def test_components_of_paths_and_stars(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    want = brute.components(nodes, edges)
    assert got == {n: c for n, c in want.items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_joins_at_hot_keys_equal_plain_ones(spark):
    left = spark.createDataFrame([(k % 5 if k % 7 else None, k) for k in range(100)], "k int, a int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(4)], "k int, b string")
    want = sorted(map(tuple, left.join(right, ["k"]).collect()))
    for hot in ([], [1], [1, 3, 9]):
        assert sorted(map(tuple, common.join_hot(left, right, ["k"], spark.createDataFrame([(k,) for k in hot], "k int")).collect())) == want


def _vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = [(i, b.tolist()) for i, b in enumerate(base)]
    for k in range(120):  # near copies at several distances, and equal ones
        b = base[k % 8]
        rows.append((100 + k, (b + rng.standard_normal(16) * [0.0, 0.1, 0.3, 0.5][k % 4]).tolist()))
    return rows + [(300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [None] + [1.0] * 15), (304, [1.0] * 3), (305, []), (306, [1e200] * 16), (307, [2e-200] * 16)]


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "RECALL", 0.9999)
    monkeypatch.setattr(embed_dedup, "DEVIATIONS", 6.0)
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash")).withColumn("rep", F.lit(1))
    small = [(i, (np.array(v) / max(map(abs, v))).tolist() if v and None not in v and any(v) else v) for i, v in rows if i != 304]
    want = _counts(rows, brute.vector_links(small), [i for i, _ in rows])
    for block, bucket, few, hot, least, direct in ((1024, 4096, 32, 100_000, 7, 1024), (7, 10, 3, 1, 2, 1024), (7, 1000, 3, 1, 2, 3)):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        monkeypatch.setattr(links, "BLOCK_ROWS", block)
        monkeypatch.setattr(embed_dedup, "BUCKET", bucket)
        monkeypatch.setattr(embed_dedup, "LEAST_BITS", least)
        monkeypatch.setattr(embed_dedup, "DIRECT", direct)
        monkeypatch.setattr(links, "FEW", few)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
        assert got == want
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_that_share_an_id_or_have_none(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (None, [1.0, 0.0, 0.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 2.0]), (None, None), (1, [0.0, 1.0, 0.0])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    key = lambda r: str(tuple(r))
    want = [(1, 2, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True)]
    assert sorted(map(key, got)) == sorted(map(str, want))


def test_embedding_links_within_each_width(spark):
    rng = np.random.default_rng(9)
    rows = []
    for w, n in ((8, 30), (5, 12), (3, 4)):
        b = rng.standard_normal((n, w))
        rows += [(len(rows) + k, v.tolist()) for k, v in enumerate(np.concatenate([b, b, b + rng.standard_normal((n, w)) * 0.1]))]
    by_width = [[(i, v) for i, v in rows if len(v) == w] for w in (8, 5, 3)]
    pairs = [x for part in by_width for x in brute.vector_links(part)]
    assert all(any(a == i for i, _ in part for a, _ in pairs) for part in by_width)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == _counts(rows, pairs, [i for i, _ in rows])


def test_components_of_link_matrices():
    rng = np.random.default_rng(8)
    for n, m, p in ((30, 30, 0.03), (40, 25, 0.04), (12, 12, 0.0), (9, 9, 1.0)):
        near = rng.random((n, m)) < p
        square = np.triu(near[:, :n], 1) if n == m else None
        if square is not None:
            square |= square.T
            own = np.arange(100, 100 + n)
            got, _ = links.roots(square, own, own)
            want = brute.components(range(n), list(zip(*np.nonzero(square), strict=True)))
            assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(n) for j in range(n))
        left, right = links.roots(near, np.arange(n), np.arange(n, n + m))
        got, want = [*left, *right], brute.components(range(n + m), [(i, n + j) for i, j in zip(*np.nonzero(near), strict=True)])
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(n + m) for j in range(n + m))


def test_wanted_rows_pass_and_few_others(spark):
    rng = np.random.default_rng(6)
    keys = [0, -1, 2**63 - 1, -(2**63), 63, 64, *rng.integers(-(2**63), 2**63, 500).tolist()]
    other = rng.integers(-(2**63), 2**63, 2000).tolist()
    frame = lambda v: spark.createDataFrame([(k,) for k in v], "key long")
    rows = frame(keys + other).withColumn("text", F.lit("t")).withColumn("_at", F.lit(1))
    got = links.wanted(rows.drop("_at"), frame(keys + keys))
    assert got.columns == ["key", "text"] and got.join(frame(keys).distinct(), "key").count() == len(keys) and got.count() < len(keys) + 5
    assert links.wanted(rows, frame([])).count() == 0


def test_embedding_recall_with_default_parameters(spark):
    rng = np.random.default_rng(12)
    base = rng.standard_normal((400, 64))
    base /= np.sqrt((base * base).sum(1, keepdims=True))
    noise = rng.standard_normal((400, 4, 64))
    cosine = rng.uniform(0.9, 0.93, (400, 4, 1))  # pairs just above the threshold, where the recall is least
    noise -= (noise * base[:, None]).sum(2, keepdims=True) * base[:, None]
    noise /= np.sqrt((noise * noise).sum(2, keepdims=True))
    x = np.concatenate([base, (cosine * base[:, None] + np.sqrt(1 - cosine**2) * noise).reshape(-1, 64), rng.standard_normal((4000, 64))])
    near = (x / np.sqrt((x * x).sum(1, keepdims=True))) @ (x / np.sqrt((x * x).sum(1, keepdims=True))).T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() >= 3000
    got = sum(r["n_links"] for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect())
    assert 0.99 * near.sum() <= got <= near.sum()


def test_recall_of_local_passes_and_their_bytes():
    """Pairs at the threshold that share a bucket of 20,000: met as often as promised, and by what is compared alone."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    noise = x[:4000] - (x[:4000] * x[4000:8000]).sum(1, keepdims=True) * x[4000:8000]
    noise /= np.sqrt((noise * noise).sum(1, keepdims=True))
    x[:4000] = 0.9 * x[4000:8000] + np.sqrt(1 - 0.81) * noise
    signs = np.packbits(x @ embed_dedup.planes(7, 64, embed_dedup.SIGNS) > 0, axis=1)
    words, ids, most = np.frombuffer(signs.tobytes(), np.uint64).reshape(len(x), -1), np.arange(20_000), embed_dedup.most_signs(0.9)
    keys = embed_dedup.local_keys(5 << 16, words, 0.9)
    rep, own, other = links._by_keys(ids, ids, words, keys, most)
    assert (rep == own).all() and (np.unpackbits(signs[rep] ^ signs[other], axis=1).sum(1) <= most).all()
    found = set(zip(rep.tolist(), other.tolist(), strict=True))
    assert len(found) == len(rep) and found == {(b, a) for a, b in found}
    assert sum((i, i + 4000) in found for i in range(4000)) >= 0.88 * 4000
    assert embed_dedup.local_keys(0, words[:1000], 0.9) is None and embed_dedup.local_keys(0, np.zeros((5000, 3), np.uint64), 0.9) is None
    tables, _ = embed_dedup.tables_and_bits(10**8, 0.9)
    assert tables * (8 + 8 + 8 + embed_dedup.SIGNS // 8) <= 5 * 256 and embed_dedup.tables_and_bits(10**9, 0.9)[0] < 45


def test_embedding_links_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r[0] for r in df.select("embedding").collect()], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    assert sum(r["n_links"] for r in embed_dedup.near_duplicates(df).collect()) == (x @ x.T >= 0.9).sum() - len(x)


def test_links_between_families_are_not_lost(spark):
    """Families around two texts that are linked with each other alone: 12 looser copies around each, below the threshold."""
    rng = np.random.default_rng(3)
    rows = []
    word = lambda n: [f"v{k}" for k in rng.integers(0, 10**7, n)]
    for _ in range(25):
        j = word(200)
        k = list(j)
        k[100:116] = word(16)  # Jaccard of j and k: 176 / 216
        for centre, cut in ((j, slice(0, 30)), (k, slice(160, 190))):
            rows.append(" ".join(centre))
            for _ in range(12):
                loose = list(centre)
                loose[cut] = word(30)
                rows.append(" ".join(loose))
    rows = list(enumerate(rows))
    want = _family_links(rows)
    got = sum(r["n_links"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(want) >= 20 and got >= 2 * 0.99 * len(want) - 1 and got <= 2 * len(want)


def _family_links(rows):
    return [p for at in range(0, len(rows), 26) for p in brute.jaccard_links(rows[at : at + 26])]


def _texts():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = rng.choices(vocab, k=120)
        for k in range(10):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), "  ".join(base) + "\n"))
    shared = " ".join(vocab[:60])
    rows += [(len(rows) + k, shared + " " + " ".join(rng.choices(vocab, k=200))) for k in range(30)]
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "a b"), (905, "a b c d e"), (906, "z " * 5000), (907, "z z z z z z")]


def test_jaccard_links(spark, monkeypatch):
    rows = _texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("n", F.lit(1))
    want = _counts(rows, brute.jaccard_links(rows), [i for i, _ in rows])
    for block, bucket, small, few, hot in ((1024, 4096, 64, 32, 100_000), (5, 6, 2, 2, 1)):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        monkeypatch.setattr(links, "BLOCK_ROWS", block)
        monkeypatch.setattr(links, "BUCKET_ROWS", bucket)
        monkeypatch.setattr(links, "FEW", few)
        monkeypatch.setattr(jaccard_join, "SMALL", small)
        got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard_join.near_duplicates(df, recall=0.99999).collect()}
        assert got == want
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "other text here it is now")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in jaccard_join.near_duplicates(twice).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (2, 2, 1)]


def test_jaccard_of_rows_without_an_id(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (7, base + " tail"), (9, base), (None, "some other text"), (None, "some other text"), (None, None), (7, base + "  tail")]
    got = [(r["doc_id"], r["n_links"], r["class_id"], r["kept"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    of = lambda i: sorted((r[1:] for r in got if r[0] == i), key=str)
    assert of(9) == [(3, 7, False)] and of(7) == [(3, 7, False), (3, 7, True)]
    assert of(None) == [(0, None, True), (1, None, True), (1, None, True), (3, 7, False)]


def test_jaccard_on_the_documents(spark):
    df = spark.read.parquet(f"{ORACLE}/documents.parquet").where("length(text) < 6000")
    rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    want = _counts(rows, brute.jaccard_links(rows), [i for i, _ in rows])
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == want


def test_recall_of_the_paths_and_sketches():
    rng = np.random.default_rng(2)
    met, trials = 0, 300
    runs, most = jaccard_join.runs_for(0.995), jaccard_join.most_bits(jaccard_join.THRESHOLD)
    for _ in range(trials):  # pairs at the threshold, in the deepest recursion
        common = rng.integers(0, 2**63, 800, dtype=np.uint64)
        a, b = (jaccard_join.min_hashes(np.r_[common, rng.integers(0, 2**63, 100, dtype=np.uint64)]) for _ in range(2))
        x, y = jaccard_join.bits(np.stack([a, b]))
        if np.unpackbits(x ^ y).sum() > most:
            continue
        ends = []
        for t in (a, b):
            paths = np.arange(1, runs + 1, dtype=np.uint64)
            for _ in range(jaccard_join.DEPTH):
                paths = jaccard_join.children(paths, np.broadcast_to(t.astype(np.uint64), (len(paths), len(t))), 1 / (0.8 * jaccard_join.TOKENS))[1]
            ends.append(set(paths.tolist()))
        met += bool(ends[0] & ends[1])
    assert met >= 0.985 * trials
