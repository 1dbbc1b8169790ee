"""Pairs of memories: neighbours by single precision first, and words that are split once for each text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramite.functions.text import jaccard
from engramite.operators import curation, retrieval


@pytest.mark.parametrize("scale", [1.0, 1e-9, 3e4, 1e20])
@pytest.mark.parametrize("earlier", [False, True])
def test_single_precision_misses_no_neighbour(scale, earlier, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 64)
    x = np.random.default_rng(5).normal(size=(40, 24))
    x = np.concatenate([x, x + 1e-7, x * (1 + 1e-5), x[:20], np.full((1, 24), np.nan), np.zeros((3, 24))]) * scale
    ids = np.random.default_rng(6).permutation(len(x)).astype(np.int64)
    d = np.round(np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * (x @ x.T), 0)), 6)
    d[~(d < np.inf)] = np.inf
    if earlier:
        d[ids[None, :] > ids[:, None]] = np.inf
    for k in (3, 500):
        cell = retrieval._Cell(k, earlier)
        cell.add(False, ids, x)
        for first in range(0, len(x), 50):
            cell.add(True, ids[first : first + 50], x[first : first + 50])
        got = cell.best()
        assert {k.dtype for k in (r for r in cell.rough.values())} == {np.dtype(np.float32 if scale < 1e10 else np.float64)}
        best = {}
        for q, _, dist in zip(*(c.to_pylist() for c in got.columns), strict=True):
            best.setdefault(q, []).append(dist)
        for q, row in zip(ids.tolist(), d, strict=True):
            want = np.sort(row[row < np.inf])[:k]
            assert np.allclose(sorted(best.get(q, [])), want, rtol=1e-6, atol=2e-6 + 1e-6 * scale)  # a difference of large squares


def test_distances_of_word_sets_are_those_of_the_texts(spark):
    texts = ["a b c d", " a b\tc\x0bd e", "A B C", "x", "é a b c", "", None, "a " * 40 + "b c d e f"]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    sets = curation._word_sets(t)
    assert {r.id: r.n for r in sets.collect()} == {0: 4, 1: 6, 2: 3, 3: 1, 4: 3, 7: 6}
    pairs = sets.select(F.col("id").alias("new_id"), F.col("words").alias("new_words")).crossJoin(sets.select(F.col("id").alias("old_id"), F.col("words").alias("old_words"))).withColumn("similarity", F.lit(0.9))
    a, b = t.alias("a"), t.alias("b")
    plain = a.join(b, (F.col("a.content") != "") & (F.col("b.content") != "")).select(F.col("a.id"), F.col("b.id"), 1 - jaccard(F.col("a.content"), F.col("b.content")))
    got = curation._word_distances(pairs).select("new_id", "old_id", "distance")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in plain.collect()}
