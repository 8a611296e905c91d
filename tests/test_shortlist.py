"""Vector search of many queries, against brute force."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry


def test_shortlist_of_every_query(spark, tmp_path):
    vectors = {i: [math.cos(i * i + j) / 3 for j in range(8)] for i in range(90)}
    vectors[7] = vectors[5]
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["similarity"]) for r in entry.queries()["cosine_shortlist_all"](spark, str(tmp_path)).collect()}
    held = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    for q in (0, 20, 40, 60, 80):
        best = sorted((-round(max(-1, min(1, sum(a * b for a, b in zip(v, held[q])))), 5), i) for i, v in held.items())[:20]
        assert [got[q, k] for k in range(1, 21)] == [(i, pytest.approx(-s)) for s, i in best]
    assert len(got) == 100
