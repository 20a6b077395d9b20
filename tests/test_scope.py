"""Queries that must take in the whole table, on fixtures larger than the tables of the SQL check."""

import numpy as np

from lagweave.plans.queries import QUERIES


def test_embeddings_knn(spark, tmp_path):
    n = 700
    x = np.random.default_rng(2).normal(size=(n, 64)).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["i"], r["rk"]): (r["j"], r["dist"], r["w"]) for r in QUERIES["embeddings_knn"](spark, str(tmp_path)).collect()}
    assert len(got) == 3 * n
    for i in range(n):
        dist = np.sqrt(((x.astype(float) - x[i]) ** 2).sum(axis=1))
        dist[i] = np.inf
        best = np.argsort(dist, kind="stable")[:3]
        w = np.maximum(np.exp(-dist[best] / dist[best[0]]), 1e-6)
        for rk, (j, d, u) in enumerate(zip(best, dist[best], w / w.sum()), 1):
            assert got[i, rk][0] == j and np.allclose(got[i, rk][1:], (d, u), atol=2e-5)
