"""The best texts of keyword queries are told in the tasks: against a plain reading, and without a row for each match."""

import random

import numpy as np
import pytest

from engramite.operators import querylang as ql
from engramite.operators import retrieval

WORDS = ["sun", "moon", "tide", "sand", "salt", "star"]


def _corpus(seed, texts, queries):
    r = random.Random(seed)
    word = lambda: r.choice(WORDS)
    made = [" ".join(word() for _ in range(r.randint(0, 9))) for _ in range(texts)]
    forms = ["{} {}", "{} OR {}", "{} NOT {}", "({} OR {}) {}", '"{} {}"', "^{}", "{:.2}*", "{}", "{} {} {}", '"" AND {} OR {}', "absent {}", "absent OR {}"]
    return made, [r.choice(forms).format(word(), word(), word()) for _ in range(queries)]


def _plain(texts, queries, k):
    """(place of query, id, score) of the k best."""
    words = [t.split() for t in texts]
    average = sum(map(len, words)) / len(words)
    rows = [([q], x.leaves, tuple(x.program)) for q, x in enumerate(map(ql.parse, queries)) if x.leaves]
    met = ql.Leaves(ql.numbered_leaves(rows))
    number, held = ql.numbered_leaves(rows), [met.leaves(t) if t else {} for t in words]
    df = {x: sum(x in h for h in held) for x in number.values()}
    out = []
    for (q,), leaves, program in rows:
        own = [number[tuple(w), p, i] for w, p, i in leaves]
        told, hits = tuple(own[x] if x >= 0 else x for x in program), []
        for i, (t, h) in enumerate(zip(words, held, strict=True)):
            if t and ql.holds(told, h.keys()):
                parts = [np.log(1 + (len(words) - df[x] + 0.5) / (df[x] + 0.5)) * h[x] * 2.2 / (h[x] + 1.2 * (0.25 + 0.75 * len(t) / average)) for x in sorted(set(own)) if x in h]
                hits.append((-round(sum(parts), 6), i))
        out += [(q, i, -s) for s, i in sorted(hits)[:k]]
    return out


def _same(got, wanted):
    assert [x[:2] for x in got] == [x[:2] for x in wanted]
    assert np.allclose([x[2] for x in got], [x[2] for x in wanted], rtol=0, atol=1e-6)


@pytest.mark.parametrize("pairs, k", [(1, 3), (5, 1), (1 << 20, 4), (7, 1000)])
def test_forms_and_ranks(monkeypatch, pairs, k):
    """Slices of any size, and best rows that are handed on before the end."""
    monkeypatch.setattr(ql, "PAIRS", pairs)
    texts, queries = _corpus(pairs + k, 120, 40)
    rows = [([q], x.leaves, tuple(x.program)) for q, x in enumerate(map(ql.parse, queries)) if x.leaves]
    words, look = [t.split() for t in texts], ql.Leaves(ql.numbered_leaves(rows))
    held = [look.leaves(t) if t else {} for t in words]
    df = np.zeros(len(ql.numbered_leaves(rows)))
    for h in held:
        df[list(h)] += 1
    average = sum(map(len, words)) / len(words)
    weight = np.where(df > 0, np.log(1 + (len(words) - df + 0.5) / (df + 0.5)), 0.0)
    forms, ranks, got = ql.Forms(rows, weight), ql.Ranks(len(rows), k), []
    for some in (range(0, 50), range(50, 51), range(51, 120)):
        some = [i for i in some if held[i]]
        leaves, tf = ([x for i in some for x in f(held[i])] for f in (dict.keys, dict.values))
        size, count = np.array([len(words[i]) for i in some], np.int64), np.array([len(held[i]) for i in some], np.int64)
        for q, t, s in forms.scored(size, count, np.array(leaves, np.int64), np.array(tf, np.int64), lambda w, n, z: retrieval._bm25_part(w, n, z, average), ranks.least):
            ranks.add(q, s, np.array(some)[t], np.zeros(len(t), bool))
        got += [(forms.ids[x][0], y, z) for q, s, i, _ in ranks.take() for x, y, z in zip(q.tolist(), i.tolist(), s.tolist(), strict=True)]
    best = {}
    for q, i, s in got:
        best.setdefault(q, []).append((-round(s, 6), i))
    _same([(q, i, -s) for q in sorted(best) for s, i in sorted(best[q])[:k]], _plain(texts, queries, k))


def test_best_texts_of_each_form(spark):
    texts, queries = _corpus(3, 150, 60)
    t = spark.createDataFrame(list(enumerate(texts)), "id bigint, content string").repartition(3)
    q = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string")
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in retrieval.bm25(t, q, 5).collect())
    _same([(a, i, s) for a, _, i, s in got], _plain(texts, queries, 5))


@pytest.mark.parametrize("block, group", [(1, 2), (3, 1), (4, 100)])
def test_blocks_of_ranks(spark, monkeypatch, block, group):
    monkeypatch.setattr(ql, "GROUP", group)
    texts = spark.createDataFrame([(1, "sun moon"), (2, "moon tide moon"), (3, "tide"), (4, None), (None, "sun sun tide")], "id bigint, content string")
    asked = ql.parsed(spark.createDataFrame([(1, "sun"), (2, "moon OR tide"), (3, "tide NOT moon"), (4, "sun"), (5, "ti*")], "query_id bigint, query string"))
    held, blocks = ql.counted(texts, asked, block)
    weights = held.where("leaf >= 0").select("leaf").distinct().selectExpr("leaf", "1d AS weight")
    kind = asked.schema["ids"].dataType.elementType
    got = {(r.query_id, r.id) for r in ql.best(held.where("leaves is not null"), blocks, weights, 10, lambda w, n, size, average: w * n, 1.0, kind).collect()}
    assert got == {(1, 1), (1, None), (2, 1), (2, 2), (2, 3), (2, None), (3, 3), (3, None), (5, 2), (5, 3), (5, None)}


def test_no_row_for_each_match(spark, monkeypatch):
    """400 texts that 100 queries all match: tables hold what grows with texts and queries, not with their product."""
    kept, write = {}, retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    texts = spark.createDataFrame([(i, f"sun moon w{i}") for i in range(400)], "id bigint, content string")
    queries = spark.createDataFrame([(i, f"sun OR w{i}") for i in range(100)], "query_id bigint, query string")
    assert retrieval.bm25(texts, queries, 3).count() == 300
    assert {"asked"} < kept.keys() and max(t.count() for t in kept.values()) < 2000
