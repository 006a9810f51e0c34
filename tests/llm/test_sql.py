"""Queries against their SQL in DuckDB, over the given tables and over odd ones."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import license_scan, queries, secret_scan
from tests.conftest import ORACLE, SMALL


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents of sf0.001 with nulls, empty and repeated texts, random tokens and notices of every licence."""
    rng = random.Random(4)
    texts = [None, "", " \n", "a", "é😀 token=0123456789abcdef0123", "x " * 4000, "same line here\nsame line here\n" * 30]
    texts += ["see " + " and ".join("".join(rng.choices(secret_scan.ALPHABET[: rng.choice([26, 52, 62, 67])], k=rng.randrange(14, 50))) for _ in range(6)) for _ in range(60)]
    texts += [f"before {t} after {t.upper()}" for _, t in license_scan.TEMPLATES] + ["\n".join(t.split(" ")) for _, t in license_scan.TEMPLATES[::3]]
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(texts + texts[:12])], "doc_id long, text string")
    more = more.select(*(F.col(c) if c in more.columns else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
    docs.unionByName(more).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels.unionByName(more.select("doc_id", *(F.lit(1).cast(labels.schema[c].dataType).alias(c) for c in ("quality", "toxic")))).write.parquet(f"{folder}/labels.parquet")
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 64))
    vectors = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 3, *(b + rng.standard_normal(64) * 0.1 * (i % 4) for b in base for i in range(6)), *(base[:5] * 3)]
    rows = [(i, v if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    kind = spark.read.parquet(f"{SMALL}/embeddings.parquet").schema
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").select(F.col("vec_id").cast(kind["vec_id"].dataType), "embedding").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("where", [SMALL, ORACLE, "odd"])
def test_query_equals_its_sql(spark, odd, name, where):
    folder = odd if where == "odd" else where
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'/*.parquet' if where == 'odd' else ''}'")
    got = queries.queries()[name](spark, folder)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(map(tuple, got.select(*columns).collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
    if where == "odd" and name == "op8_secret_scans":
        assert sum("random" in r[columns.index("spans")] for r in rows) > 40
    if name == "op6_ngram_jaccard_join" or where == "odd" and name == "op3_embedding_near_dedup":
        assert sum(r[columns.index("n_links")] > 0 for r in rows) > 10
    if where == "odd" and name == "op10_license_scans":
        assert sum(r[columns.index("best_license")] is not None for r in rows) > 25
