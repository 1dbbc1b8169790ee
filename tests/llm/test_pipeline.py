"""The pipeline's stages, each against the rows that brute force keeps and changes."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402
from engramite.llm import decontam, langid, packing, pii  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{top}/documents.parquet")
    texts = [r.text for r in docs.where("doc_id in (10, 11)").orderBy("doc_id").collect()]
    spark.createDataFrame([(1, texts[0]), (2, " ".join(texts[1].split()[3:17]))], "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def table(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_names_and_columns(spark, docs, folder):
    assert [k for k, _ in cp.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "PII", "packing"]
    for _, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0
    for _, stage in cp.STAGES[:4]:
        assert stage(spark, docs, folder).columns == docs.columns


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_clashing_columns_change_nothing(spark, docs, clashing, folder, name):
    stage = dict(cp.STAGES)[name]
    plain, more = stage(spark, docs, folder), stage(spark, clashing, folder)
    if name != "packing":
        assert more.columns == clashing.columns
    assert table(plain) == table(more.select(*plain.columns))


def test_rows_that_repeat_an_id(spark, docs, folder):
    words = [f"w{k}" for k in range(40)]
    data = [(1, " ".join(words), "en", "b", 5), (1, " ".join(words), "en", "a", 5), (1, "another text of the same id", "en", "a", 5), (2, " ".join(words), "en", "a", 5), (3, "a third one", None, None, None), (None, "x", None, None, None)]
    rows = spark.createDataFrame(data, docs.schema)
    want = sorted(map(repr, [data[1], data[2], data[4], data[5]]))
    assert table(cp.near_dedup(spark, rows, folder)) == want == table(cp.near_dedup(spark, rows.repartition(3), folder))


def test_language_stage(spark, docs, folder):
    rejected = {tuple(r) for r in langid.identify_language(docs).where("rejected").select("doc_id").collect()}
    kept = [r.doc_id for r in cp.language_id(spark, docs, folder).collect()]
    assert {(i,) for i in (300, 301, 302, 303)} <= rejected
    assert set(kept) == {r.doc_id for r in docs.collect() if (r.doc_id,) not in rejected or r.doc_id is None}


def test_dedup_stage(spark, docs, folder):
    from test_operators import brute_components

    rows = [tuple(r) for r in docs.collect()]
    want = sorted({i for i, _, c in brute_components(rows) if i == c and i is not None})
    got = cp.near_dedup(spark, docs, folder).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got) == 2


def test_decontamination_stage(spark, docs, folder):
    from test_operators import brute_contamination

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    small = docs.where("text is null or length(text) < 5000")
    got = {r.doc_id: r for r in cp.decontaminate(spark, small, folder).collect()}
    for r in small.where("doc_id is not null").collect():
        _, hit, _, _, bad = brute_contamination(r.text, items)
        assert (r.doc_id in got) != bad
        if r.doc_id in got and not hit:
            assert got[r.doc_id].text == r.text and got[r.doc_id].n_chars == r.n_chars


def test_personal_data_stage(spark, folder):
    docs = spark.createDataFrame([(1, "x a@b.cd y", "en", "s", 10), (2, "clean", None, None, None), (3, None, None, None, 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.mask_personal_data(spark, docs, folder).collect()}
    assert got == {1: (pii.mask("x a@b.cd y"), 11), 2: ("clean", None), 3: (None, 0)}


def brute_hits(text, items):
    """Words of windows, by comparing every place with every window."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, windows = words(text), set()
    for _, t in items:
        x = words(t)
        windows |= {tuple(x[k : k + 13]) for k in range(max(1, len(x) - 12))} if x else set()
    hit = {p for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
    return len(w), hit


def brute_text(text, hit):
    """The text without the words that are hit and what lies between two neighbours of them."""
    out, pos = [], 0
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    for k, (a, b) in enumerate(spans):
        if k in hit:
            out.append("" if k - 1 in hit else text[pos:a])
            pos = b
    return "".join([*out, text[pos:]])


def test_run(spark, docs, folder, corpus):
    """All stages in one piece, against what plain code keeps, cuts, masks and counts."""
    from test_operators import brute_components

    model = langid.train(docs, ~(langid.fold(docs, 3) == 1))
    rows = [r for r in corpus if not model.predict(r[1])[2]]
    kept = {i for i, _, c in brute_components(rows) if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    encoder, want = packing.Encoder(packing.default_files()[0]), []
    for i, text in {(r[0], r[1]) for r in rows if r[0] in kept} | {(r[0], r[1]) for r in rows if r[0] is None}:
        n, hit = brute_hits(text, items)
        if not hit or 20 * len(hit) < n:
            want.append((i, len(encoder.ids(pii.mask(brute_text(text, hit)))) + 1))
    got = cp.run(spark, folder).collect()
    assert sorted(map(repr, {(r.doc_id, r.doc_tokens) for r in got})) == sorted(map(repr, set(want)))
    assert sum(r.length for r in got) == sum(n for _, n in want) and len(want) < len(rows)


def test_word_removal():
    text = "keep One, two THREE four; tail"
    spans = decontam.word_spans(decontam.lower_ascii(text))
    assert decontam.without(text, spans, [(1, 4)]) == "keep  four; tail"
