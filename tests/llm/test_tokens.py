import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import bpe, packing
from tests.conftest import ORACLE
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.load_packed(bpe.pack_ranks(RANKS))
REFERENCE = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "a'sb 's it’s", "  \n x\x85y  z", "你好 世界 १२३ ½ \x1c\x1d　  x", "a" * 20000, "é" * 700 + " \t\n", "<|endoftext|> 😀😀", "ǅ ɐ ʰ ͅ x"]


def ids(text):
    return np.frombuffer(CODEC.encoder()(text), "<u4").tolist()


def test_perfect_hash_is_minimal_and_perfect():
    keys = sorted(RANKS)
    slots = [CODEC.hash.find(k) for k in keys]
    assert sorted(slots) == list(range(len(keys)))
    assert CODEC.hash.find(b"certainly not a token") == -1
    assert bpe.PerfectHash([]).find(b"x") == -1


def test_both_vocabulary_files_agree():
    assert bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.json")) == RANKS


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_odd_texts(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(CODEC.encoder()(text)) == text.encode()


def test_memo_does_not_change_results(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 6)
    enc = CODEC.encoder()
    for t in ["the quick brown fox jumps over", "quick fox the lazy zzzqx dog", "the quick zzzqx"] * 3:
        assert np.frombuffer(enc(t), "<u4").tolist() == REFERENCE.encode_ordinary(t)


def test_query_on_the_documents(spark):
    from quillon.llm.queries import op2_byte_bpe

    text = {r[0]: r[1] for r in spark.read.parquet(f"{ORACLE}/documents.parquet").select("doc_id", "text").collect()}
    for r in op2_byte_bpe(spark, ORACLE).collect():
        want = REFERENCE.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_encode_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = [(r[0], r[1], r[2]) for r in bpe.encode(df, PATH, ["doc_id"]).select("doc_id", "n_tokens", F.length("ids")).orderBy("doc_id").collect()]
    assert got == [(1, 0, 0), (2, 0, 0), (3, 1, 4), (3, 1, 4)]
    assert bpe.encode(df.limit(0), PATH, ["doc_id"]).count() == 0


def check_packing(rows, size, want_ids=None):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    if want_ids:
        for doc, own in by_doc.items():
            own.sort(key=lambda r: r["piece"])
            full = want_ids[doc]
            assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == size for r in own[1:])
            at = 0
            for r in own:
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(full[at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
            assert at == len(full)
    return len(by_seq)


def test_packing_of_the_documents(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.read.parquet(f"{ORACLE}/documents.parquet")
    text = {r[0]: r[1] for r in df.select("doc_id", "text").collect()}
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in text.items()}
    rows = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r["doc_id"] for r in rows} == set(text)
    n = check_packing(rows, 1024, want)
    least = -(-sum(map(len, want.values())) // 1024)
    assert n <= 1.01 * least


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f g h i j"), (3, "a b c d e f g h i j"), (4, "x" * 9000)], "doc_id long, text string").withColumn("length", F.lit("clash"))
    rows = packing.pack_documents(df, PATH, size=8).collect()
    assert check_packing(rows, 8) and sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 5000), max_size=12))
def test_plans_hold_every_piece(hist):
    counts = np.zeros(33, np.int64)
    for ln, n in hist.items():
        counts[ln] = n
    held = np.zeros(33, np.int64)
    total = 0
    for filling, times in packing.plan(counts, 32):
        assert sum(a * b for a, b in filling) <= 32 and times > 0
        total += times
        for ln, n in filling:
            held[ln] += n * times
    assert (held == counts).all()
    assert total <= 1.02 * sum(brute.best_fit(counts, 32).values()) + 1
    taken = np.zeros(33)
    for filling, x in packing.solve_configuration_lp(counts, 32).items():
        for ln, n in filling.items() if isinstance(filling, dict) else filling:
            taken[ln] += n * x
    assert (taken <= counts + 1e-6).all()


@pytest.mark.parametrize("low, high, n, most", [(1, 1025, 20_000, 1.007), (250, 600, 30_000, 1.01), (1, 200, 5_000, 1.001), (300, 400, 9_000, 1.2)])
def test_plans_are_near_the_bound_of_tokens(low, high, n, most):
    counts = np.bincount(np.random.default_rng(n).integers(low, high, n), minlength=1025)
    total = sum(m for _, m in packing.plan(counts, 1024))
    assert total <= sum(brute.best_fit(counts, 1024).values()) * 1.0005
    per = 1024 // low if low > 200 else 1024  # pieces that a sequence has room for
    assert total <= most * max((counts * np.arange(1025)).sum() / 1024, n / per)


@pytest.mark.parametrize("hist, size, most", [({1: 1, 8: 2700, 21: 2700}, 32, 2700), ({1: 10, 8: 27_000, 21: 27_000}, 32, 27_000), ({1: 1, 256: 2700, 672: 2700}, 1024, 2700), ({300: 5000, 400: 5000, 330: 1}, 1024, 3751)])
def test_rare_lengths_do_not_spoil_a_plan(hist, size, most):
    counts = np.zeros(size + 1, np.int64)
    for ln, n in hist.items():
        counts[ln] = n
    assert sum(m for _, m in packing.plan(counts, size)) <= most


@pytest.mark.parametrize("size, low, high, n", [(64, 2, 5, 60), (1024, 8, 60, 25)])
def test_plans_of_random_lengths_are_near_the_dual_bound(size, low, high, n):
    rng = np.random.default_rng(size)
    for _ in range(n):
        counts = np.zeros(size + 1, np.int64)
        counts[rng.choice(np.arange(1, size + 1), rng.integers(low, high + 1), replace=False)] = 1
        counts *= rng.integers(1, 3000, size + 1)
        total, (_, bound) = sum(m for _, m in packing.plan(counts, size)), packing.solve_by_weights(counts, size)
        bound = max(bound, (counts * np.arange(size + 1)).sum() / size)
        assert bound - 1e-6 <= total <= 1.001 * sum(brute.best_fit(counts, size).values())
        assert total <= 1.05 * bound + (counts > 0).sum()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3), st.integers(0, 9)), max_size=6), st.integers(1, 30))
def test_pricing_is_the_bounded_knapsack(items, size):
    value, left = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for ln, n, v in items:
        if ln <= size:
            value[ln], left[ln] = v, n
    best = {0: 0.0}
    for ln in range(1, size + 1):
        best = {used + k * ln: max(best.get(used, 0) + k * value[ln] for used, k in ((u, j) for u in best for j in range(int(left[ln]) + 1)) if used + k * ln == w) for w in {u + j * ln for u in best for j in range(int(left[ln]) + 1)} for used, k in [(w, 0)] if w <= size} if value[ln] else best
    priced = packing.Pricing(value, left, size)
    for room in range(size + 1):
        c = priced.filling(room)
        assert sum(ln * n for ln, n in c.items()) <= room and all(n <= left[ln] for ln, n in c.items())
        assert sum(value[ln] * n for ln, n in c.items()) == pytest.approx(priced.best[room]) == pytest.approx(max(v for w, v in best.items() if w <= room))


def test_long_runs_of_white_space_pack_like_the_tokenizer(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 1_000_000 + "a", "\n" * 1_200_000 + "b", " " * 4_000_000 + "c", "then plain text"]
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert check_packing(rows, 1024, want)
