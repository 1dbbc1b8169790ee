"""Periodic runs against the definition, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from engramite.llm import runs


def brute(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def row_of(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    found = brute(words)
    gone = {x for s, m, q in found for x in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    return (
        i, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for k, x in enumerate(words) if k not in gone).encode()).hexdigest(),
    )


def test_random_words():
    rng = random.Random(5)
    for _ in range(800):
        n, kinds = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(3) if n else 0):
            p, s = rng.randrange(1, 12), rng.randrange(n)
            for i in range(s + p, rng.randrange(s, n) + 1):
                w[i] = w[i - p]
        assert runs.find_runs(np.array(w, np.int64)) == brute(w)


def test_nested_and_long_runs():
    block = [1, 1, 1, 1, 1, 1, 2]
    w = np.array([9] + block * 5 + [7] * 300 + list(range(20, 60)) * 4, np.int64)
    assert runs.find_runs(w) == brute(w.tolist())
    assert runs.find_runs(np.zeros(30_000, np.int64)) == [(0, 30_000, 1)]
    assert runs.find_runs(np.arange(40_000, dtype=np.int64) % 9_000) == [(0, 40_000, 9_000)]


def test_kept_words_and_strongest():
    assert runs.collapse(8, [(1, 6, 1)]).tolist() == [True, True, False, False, False, False, False, True]
    assert runs.strongest([(0, 8, 2), (3, 12, 3), (40, 16, 4)]) == (0, 8, 2)
    assert runs.strongest([]) is None


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_rows_of_the_corpus(request, corpus, table):
    got = sorted(map(repr, (tuple(r) for r in runs.audit_runs(request.getfixturevalue(table)).collect())))
    short = [(i, t) for i, t, *_ in corpus if len(t or "") < 20_000]
    assert len(got) == len(corpus)
    missing = [x for x in (repr(row_of(i, t)) for i, t in short) if x not in got]
    assert not missing


def test_altered_rows_have_runs(docs, nothing):
    altered = [r for r in runs.audit_runs(docs).collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and r.doc_id < 240]
    assert altered and any(r.n_runs for r in altered)
    assert runs.audit_runs(nothing).count() == 0
    assert runs.audit_runs(docs, alter=False).where("doc_id < 240 and n_runs > 0").count() == 0
