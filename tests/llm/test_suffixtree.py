"""Scores of the suffix tree: the contract's base exactly, and the tree against a plain one over tuples of words."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from engramite.llm import suffixtree as st


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 1


class Plain:
    """The same tree, from dictionaries of tuples."""

    def __init__(self, rows, depth, p_min, least, divergence):
        texts = [tokens(t) for i, t in rows if learned(i)]
        self.c = Counter(x for w in texts for x in w)
        self.n, self.v, self.depth, self.nodes = sum(self.c.values()), len(self.c), depth, {}
        candidates = {(x,) for x, n in self.c.items() if x is not None and n >= p_min * self.n}
        for k in range(1, depth + 1):
            follow = {s: Counter() for s in candidates}
            for w in texts:
                for i in range(k, len(w)):
                    if (s := tuple(w[i - k : i])) in follow:
                        follow[s][w[i]] += 1
            found = {}
            for s, after in follow.items():
                size, kept = sum(after.values()), {x: n for x, n in after.items() if n >= least}
                left = 1 - sum(n - 0.75 for n in kept.values()) / size
                gain = (size - sum(kept.values())) * math.log(left)
                for x, n in kept.items():
                    before = self.p(s[1:], x)
                    gain += n * math.log(((n - 1.75) / (size - 1) * (n - 1 >= least) + left * before) / before)
                if kept and gain >= divergence * size:
                    found[s] = left, {x: (n - 0.75) / size for x, n in kept.items()}
            self.nodes |= found
            candidates = {(*s, x) for s in candidates for x, n in follow[s].items() if x is not None and n >= max(least, p_min * self.n)}

    def base(self, x):
        return (self.c[x] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p(self, context, x):
        p = self.base(x)
        for k in range(1, min(self.depth, len(context)) + 1):
            if node := self.nodes.get(tuple(context[-k:])):
                p = node[1].get(x, 0) + node[0] * p
        return p


def check(got, rows, **options):
    plain = Plain(rows, **options)
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        w = tokens(t)
        own = sum(math.log10(plain.p(w[max(0, k - plain.depth) : k], x)) for k, x in enumerate(w))
        want[i, len(w)] = (zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False, sum(x in plain.c for x in w), plain.n, sum(math.log10(plain.base(x)) for x in w), own)
    for r in got:
        held, known, n, base, own = want[r.doc_id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (held, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(own, rel=1e-9)
    return plain


@pytest.mark.parametrize("name", ["docs", "clashing"])
def test_tree_and_scores(request, corpus, name):
    options = {"depth": 2, "p_min": 0.001, "least": 2, "divergence": 0.001}
    plain = check(st.score_texts(request.getfixturevalue(name), chunk_bytes=20_000, **options).collect(), [(i, t) for i, t, *_ in corpus], **options)
    assert plain.nodes


def test_contexts_help_where_text_repeats(spark):
    rows = [(i, f"{'a b c d b e ' * 6}x{i}") for i in range(60)]
    options = {"depth": 3, "p_min": 0.01, "least": 4, "divergence": 0.01}
    got = st.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), **options).collect()
    plain = check(got, rows, **options)
    assert {len(s) for s in plain.nodes} >= {1, 2}
    assert all(r.score > r.base_score + 5 for r in got)


def test_each_state_sums_to_one(corpus):
    plain = Plain([(i, t) for i, t, *_ in corpus], 2, 0.001, 2, 0.001)
    for s in list(plain.nodes)[:20]:
        assert sum(plain.p(s, x) for x in [*plain.c, "unknown word"]) == pytest.approx(1)


def test_nothing_to_learn_from(spark, nothing):
    assert st.score_texts(nothing).count() == 0
    held = next(i for i in range(100) if not learned(i))
    r = st.score_texts(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_words_by_hash():
    t = st.Tokens([b"A b\tC", None, b"a"])
    assert t.sizes.tolist() == [4, 1, 2] and t.words[0] == t.words[5] and t.words[3] == t.words[4] == st.END
    at, h = t.contexts(1)
    assert at.tolist() == [1, 2, 3, 6] and h[0] == h[3] == st.step(np.array([st.ROOT]), t.words[:1])[0]
