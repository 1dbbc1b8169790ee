"""Neighbours by blocks: no copies of vectors are shuffled, and a least similarity changes none of those above it."""

import numpy as np
from pyspark.sql import functions as F

from engramite.operators import retrieval


def _vectors(spark, kind):
    x = np.random.default_rng(3).normal(size=(300, 5)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"id bigint, embedding array<{kind}>")


def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 50)
    v = _vectors(spark, "float")
    met = retrieval._met(v, v.select(F.col("id").alias("query_id"), "embedding"), 3, False)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and met.count() >= 900


def test_a_least_similarity_leaves_what_is_above_it(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 64)
    for kind in ("float", "double"):
        v = _vectors(spark, kind)
        q = v.select(F.col("id").alias("query_id"), "embedding")
        for earlier in (False, True):
            near = lambda **o: {tuple(r) for r in retrieval.knn(v, q, 9, earlier, **o).where(F.round(retrieval.similarity(F.col("distance")), 6) > 0.7).collect()}  # noqa: B023, E731
            assert near() == near(above=0.7) != set()
