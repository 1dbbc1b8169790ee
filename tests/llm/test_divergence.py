"""Source divergence against the contract's formulas in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from engramite.llm import divergence

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = [s for x, s in groups if x == lang]
        total = sum((counts[lang, s] for s in mine), Counter())

        def shares(c):
            size = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // size for t in kept}

        p, q = shares(counts[lang, source]), shares(total)
        found = [("pair", s, sum(f(p[t], o[t]) for t in kept)) for s in mine if s != source for o in [shares(counts[lang, s])]]
        found += [("term", t, f(p[t], q[t])) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, most in (("pair", len(found)), ("term", top)):
            chosen = sorted((x for x in found if x[0] == part), key=lambda x: (-x[2], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (_, item, value) in enumerate(chosen[:most])]
    return sorted(out)


def table(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["docs", "clashing"])
def test_rows_of_the_corpus(request, corpus, name):
    assert table(divergence.audit_sources(request.getfixturevalue(name))) == brute([(t, lang, s) for _, t, lang, s, _ in corpus])


def test_many_sources_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyzß日"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 12))), rng.choice(["en", "de", None]), f"s{rng.randrange(9)}") for _ in range(400)]
    got = divergence.audit_sources(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string"), min_documents=3, top=4)
    assert table(got) == brute(rows, 3, 4)


def test_select_with_ties(spark):
    rng = random.Random(9)
    rows = [("en", f"s{g}", "".join(rng.choices("aé日z", k=rng.randrange(1, 6))) + str(i), rng.choice([0, 5, 5, 5, 1 << 20, (1 << 29) + 1])) for g in range(6) for i in range(80)]
    rows += [("en", "few", "x", 7), ("en", "prefix", "a", 1), ("en", "prefix", "aa", 1), ("en", "prefix", "aaa", 1), ("en", "prefix", "𐀀", 1), ("en", "prefix", "￮", 1)]
    got = divergence.largest(spark.createDataFrame(rows, "lang string, source string, item string, value bigint"), 4)
    want = []
    for g in {r[1] for r in rows}:
        want += sorted((r for r in rows if r[1] == g), key=lambda r: (-r[3], r[2].encode()))[:4]
    assert table(got) == sorted(want)


def test_languages_without_kept_terms_and_empty_tables(spark, docs, nothing):
    assert divergence.audit_sources(nothing).count() == 0
    few = spark.createDataFrame([(1, None, "xx", "a"), (2, "one", "xx", "b"), (3, "", None, None)], "doc_id bigint, text string, lang string, source string")
    assert table(divergence.audit_sources(few)) == [("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)]


def test_terms_of_long_texts(monkeypatch):
    text = "Ab1ÄB " * 50 + "x" * 300
    whole = divergence.terms_of(text.encode())
    monkeypatch.setattr(divergence, "_PIECE", 7)
    assert divergence.terms_of(text.encode()) == whole == Counter({b"ab": 50, "Äb".encode(): 50, b"x" * 300: 1})
