"""The engine's operators on small inputs with known results."""

import itertools
import json
import random
import re
import subprocess
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engramite.functions import embed as emb
from engramite.functions import text as tx
from engramite.functions import redact
from engramite.functions.redact import redact_pairs, redact_secrets
from engramite.operators import audit, context, curation, extraction, graph, history, retrieval, store, write
from engramite.plans import catalog
from engramite.plans.components import connected_components
from engramite.sources import files, model
from engramite.sources.model import MEMORIES, PROVENANCE
from engramite.streaming import tails

NOW, DAY = 1_700_000_000, 86400


def memory(i, content, importance=1.0, created=NOW, accessed=NOW, until=None, namespace="shared", parent=None):
    return (i, content, importance, created, accessed, 0, created, until, created, namespace, parent)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Tables of the generated kind, small enough to write here."""
    top, con, rng = tmp_path_factory.mktemp("sf"), duckdb.connect(), random.Random(2)
    words = "dark mode database port server password token error rule prefer the of and to in".split()

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", ".", "s"]) for _ in range(n))

    tables = {
        "documents": ("doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint", [(i, prose(rng.randrange(3, 30)), "en", f"src{i % 3}", 1) for i in range(60)]),
        "labels": ("doc_id bigint, quality int, toxic int", [(i, 1, int(i % 9 == 0)) for i in range(0, 60, 2)]),
        "embeddings": ("vec_id bigint, embedding float[], label int", [(i, [rng.gauss(0, 1) for _ in range(4)], 0) for i in range(60)]),
        "events": ("event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar", [(i, f"2024-01-{1 + i % 28:02d} 10:00:00", i % 7, ["view", "signup", "purchase", "error"][i % 4], i % 130 + 0.5, f'{{"k": {i}}}') for i in range(300)]),
        "benchmark": ("item_id bigint, text varchar", [(i, prose(20)) for i in range(12)]),
        "conversations": ("conv_id bigint, turn bigint, role varchar, text varchar", [(i, t, ["user", "assistant"][t % 2], prose(12)) for i in range(8) for t in range(4)]),
        "part": ("p_partkey bigint, p_name varchar", [(i, f"part {i % 5}") for i in range(1, 80)]),
        "customer": ("c_custkey bigint, c_name varchar, c_nationkey int", [(i, f"Customer {i}", i % 5) for i in range(1, 30)]),
        "lineitem": ("l_orderkey bigint, l_partkey bigint", [(rng.randrange(60), rng.randrange(1, 80)) for _ in range(200)]),
    }
    for name, (schema, rows) in tables.items():
        con.execute(f"create table {name}({schema})")
        con.executemany(f"insert into {name} values ({','.join('?' * len(rows[0]))})", rows)
        con.execute(f"copy {name} to '{top}/{name}.parquet' (format parquet)")
    return str(top), con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_equal_their_sql(spark, tables, name):
    folder, con = tables
    df = catalog.QUERIES[name](spark, folder)
    got = df.collect()
    if name in catalog.ORACLES:
        cur = con.execute(catalog.ORACLES[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        show = lambda v: repr(round(v, 6) + 0.0 if isinstance(v, float) else v)
        assert sorted([show(r[c]) for c in cols] for r in got) == sorted([show(v) for v in r] for r in cur.fetchall())


def test_lifecycle(spark):
    m = spark.createDataFrame([memory(1, "Note: old", created=NOW - 15 * DAY, accessed=NOW - 8 * DAY), memory(2, "Rule: old", created=NOW - 15 * DAY), memory(3, "fresh", 0.5)], MEMORIES)
    assert [r.importance_score for r in store.decay(m, NOW).orderBy("id").collect()] == [0.95, 1.0, 0.5]
    assert [r.valid_until for r in store.expire(m, NOW).orderBy("id").collect()] == [NOW, None, None]
    boosted = store.boost(m, spark.createDataFrame([(3,), (3,)], "id bigint"), NOW).where("id = 3").first()
    assert (boosted.importance_score, boosted.access_count) == (0.7, 2)
    with pytest.raises(ValueError):
        store.recent(m, 0)
    after, ledger = store.new_versions(m, spark.createDataFrame([(2, 9, "Rule: new")], "old_id bigint, new_id bigint, content string"), NOW)
    assert {(r.id, r.valid_until, r.parent_id) for r in after.where("id in (2, 9)").collect()} == {(2, NOW, None), (9, None, 2)} and ledger.count() == 1


def test_visibility_and_latest_provenance(spark):
    m = spark.createDataFrame([memory(1, "a"), memory(2, "b", namespace="agent-a"), memory(3, "c", namespace="agent-b")], MEMORIES)
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert ids(store.visible(m, "Agent-A")) == [1, 2] and ids(store.visible(m, None, True)) == [1] and ids(store.visible(m, "all")) == [1, 2, 3]
    p = spark.createDataFrame([(1, 1, "manual", "x", 0, 1.0), (2, 1, "agent", "y", 0, 0.5)], PROVENANCE)
    assert store.latest_provenance(p).first().source_id == "y"
    gone = store.delete({"memories": m, "provenance": p}, spark.createDataFrame([(1,)], "id bigint"))
    assert ids(gone["memories"]) == [2, 3] and gone["provenance"].count() == 0
    events = spark.createDataFrame([("Agent-A", "created"), ("agent-a", "confirmed"), ("AGENT-A", "contradicted"), ("user-dialogue", "created")], "agent_id string, action string")
    row = store.agent_stats(events).collect()
    assert [(r.memories_created, r.memories_confirmed, r.memories_contradicted, r.reputation_score) for r in row] == [(1, 1, 1, 1.0)]


def test_fallback_embedding_matches_synonyms():
    import numpy as np

    assert emb._hash("night") == 3873349473
    assert np.allclose(emb.embed("Night theme"), emb.embed("dark mode")) and not emb.embed("").any()


def test_mmr_prefers_variety():
    order = retrieval.mmr_order([1.0, 0.9, 0.6], ["dark mode on", "dark mode on", "port of the server"], 2)
    assert order == [0, 2] and retrieval.mmr_order([1.0, 0.5], ["a", "a"], 2) == [0, 1]


def test_packing_skips_and_stays_in_budget():
    rng = random.Random(1)
    for _ in range(200):
        texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))) for _ in range(8)]
        most = rng.randrange(5, 60)
        packer = context.Packer()
        taken = [i for i, t in enumerate(texts) if packer.offer(t, cost_of(t), most)]
        assert taken == plain_pack(list(enumerate(texts)), most) and packer.used == sum(cost_of(texts[i]) for i in taken) <= most
        for i, j in itertools.combinations(taken, 2):
            a, b = set(texts[i].split()), set(texts[j].split())
            assert not a or not b or len(a & b) / len(a | b) <= context.TOO_ALIKE


def test_redaction(spark):
    key = "sk-" + "a1B2" * 12
    cases = ["postgres://joe:hunter22@db/x", f"use {key} now", "password: hunter2222", 'token = "1beb58b8af68854f0e01"', "api_key=abcdef123456", "AKIA" + "Z9" * 10, "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"]
    cases += ["plain words only", None, "", "\ufdd0 \ufdd0. the password \ufdd0(abc12345\ufdd0) end", "the ssh a@ and é@abc12345"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", redact_secrets(F.col("t")).alias("t")).orderBy("i").collect()]
    for text, secret in zip(got, ["hunter22@", key, "hunter2222", "1beb58b8af68854f0e01", "abcdef123456", "AKIA" + "Z9" * 10, "abc"], strict=False):
        assert secret not in text and "[REDACTED]" in text
    assert got[7:10] == ["plain words only", None, ""] and got[0].startswith("postgres://joe:[REDACTED]@db")
    assert got[10] == "\ufdd0 \ufdd0. the password \ufdd0([REDACTED]\ufdd0) end"


def test_pairs_are_read_in_little_memory(spark):
    filler = "é" * 4_000
    values = pa.array([f"{filler} password: abc{i}" if i % 3 else None for i in range(6_000)])
    tracemalloc.start()
    got = redact._pairs(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6 and got.null_count == values.null_count and got[5_999].as_py() == f"{filler} password: [REDACTED]" and len(redact._pairs(values[:0])) == 0
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["password: abc1", None, "", "none here"] * 50)], "i int, t string").select("i", redact_secrets(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == ["password: [REDACTED]", None, "", "none here"] * 50


@pytest.mark.parametrize(
    ("text", "left"),
    [
        ("password: abc", "password: [REDACTED]"), ("'secret' = 'longer one' x", "'secret' = '[REDACTED]' x"), ("secret = 'abc' x", "secret = [REDACTED] x"), ("the api-key is set", "the api-key is [REDACTED]"),
        ("client secret to abc", "client secret to [REDACTED]"), ("password token x", "password to[REDACTED] x"), ("auth(abc)", "auth([REDACTED])"), ("github uses abc", "github uses [REDACTED]"), ("slack set  to abc", "slack set  to [REDACTED]"),
        ("pwd: a\nb\nc d", "pwd: [REDACTED]\nc d"), ("pwd: a\nkey: b", "pwd: [REDACTED]\nkey: b"), ("mypassword: abc", "mypassword: abc"), ("password", "password"), ("ssh-rsa: abc", "ssh-rsa: abc"), ("aws_secret=abc", "aws_secret=[REDACTED]"),
        ("auth( ) x", "auth( )[REDACTED] x"), ("", ""),
    ],
)
def test_values_of_keys(text, left):
    assert redact_pairs(text) == left


@pytest.mark.parametrize(
    ("text", "saved"),
    [
        ("Remember: the database port is 5433.", ["Note: the database port is 5433"]),
        ("Don't forget to rotate the keys tomorrow.", ["Reminder: rotate the keys tomorrow"]),
        ("We decided to use postgres for the api.", ["Decision: postgres for the api"]),
        ("I prefer dark mode over light mode.", ["Preference: dark mode over light mode"]),
        ("Remember: the staging server is flaky on Mondays", ["Note: the staging server is flaky on Mondays"]),
        ("Note that Ann handles migrations, dont touch those files", ["Note: Ann handles migrations, dont touch those files"]),
        ("Don't forget the certificate expires March 15", ["Reminder: the certificate expires March 15"]),
        ("FYI the client doesnt want emojis in any answers", ["Note: the client doesnt want emojis in any answers"]),
        ("Keep in mind that auth.js is old, leave it alone", ["Note: auth.js is old, leave it alone"]),
        ("Heads up: the rate limit is 100 requests per minute", ["Note: the rate limit is 100 requests per minute"]),
        ("take a notes that the build is slow. x", ["Note: the build is slow"]),
        ("make a note – the build is slow", ["Note: the build is slow"]),
        ("how do I use typescript", []),
        ("what is the weather today", []),
        ("we are using Postgres for our database", ["Stack: Using Postgres for database"]),
        ("I prefer camelCase over snake_case for variable naming", ["Preference: camelCase over snake_case for variable naming"]),
        ("I prefer camelCase code over snake_case", ["Preference: camelCase code over snake_case"]),
        ("the infrastructure runs on docker. our tech stack has v1.2 of react. x", ["Stack: v1.2 of react", "Stack: the infrastructure runs on docker."]),
        ("set the port to '5433'.", ["Config: set the port to '5433'."]),
        ("remember what?", []),
        ("hello there, how are you doing", []),
        ("```\nremember: this is inside a fence\n```", []),
        ("I prefer it.", []),
    ],
)
def test_extraction(text, saved):
    assert [f.content for f in extraction.extract(text)] == saved


def test_noise_is_told_by_how_lines_begin(spark):
    noise = ["import x", "  const a", "}", " ;", "// x", "  * x", "```", "", "   ", "ERROR: x", "Info: x", "  at f (x)", "DB_HOST=1", "2024-01-31 x"]
    told = ["important x", "constant", "a }", "an error: x", "at", " ERROR: x", " DB_HOST=1", "x 2024-01-31"]
    rows = spark.createDataFrame([(x,) for x in [*noise, *told]], "line string")
    got = {r.line: r.n for r in rows.select("line", extraction.noise(F.col("line")).alias("n")).collect()}
    assert got == {x: x in noise for x in [*noise, *told]} == {x: extraction.is_noise(x) for x in [*noise, *told]}
    texts = spark.createDataFrame([("we decided to use x",), ("hello, world",), ("fyi: x",), ("fyi: xyz abc",), (None,)], "text string")
    assert [r.s for r in texts.select(extraction.signal(F.col("text")).alias("s")).collect()] == [True, False, False, True, False]


def test_relationship_in_the_jvm_equals_python(spark):
    rng = random.Random(3)
    pairs = [(" ".join(rng.choice("abcdef.") for _ in range(rng.randrange(0, 12))), " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 12)))) for _ in range(300)]
    pairs += [("a b c d e f g h", "a b c d e f g h i"), ("a b c", "a, b. c!"), ("", "x")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", tx.relationship(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(curation.relationship_of(curation.bare_words(x.a), curation.bare_words(x.b)) == x.r for x in got) and len({x.r for x in got}) >= 4


def test_consolidation_keeps_the_most_trusted(spark):
    m = spark.createDataFrame([(1, "use port 3000 for the server", 1.0, 0.9), (2, "use port 3000 for the server", 1.0, 0.8), (3, "use port 3000 for the server now please today ok", 1.0, 0.5)], "id bigint, content string, trust double, importance double")
    pairs = spark.createDataFrame([(a, b, 1.0 if a == b else 0.9) for a in (1, 2, 3) for b in (1, 2, 3)], "a bigint, b bigint, similarity double")
    got = {(r.archived_id, r.canonical_id, r.reason) for r in curation.consolidate(m, pairs).collect()}
    assert (2, 1, "duplicate") in got and len(got) == 2
    c = spark.createDataFrame([(5, 1, 0.9), (5, 2, 0.8), (5, 3, 0.75)], "new_id bigint, old_id bigint, similarity double")
    trust = spark.createDataFrame([(5, 0.5), (1, 0.4), (2, 0.5), (3, 0.1)], "id bigint, trust double")
    assert [(r.old_id, r.outcome) for r in curation.resolve_contradictions(c, trust).orderBy("old_id").collect()] == [(1, "archived_old"), (2, "kept_old")]


def test_contradictions_equal_brute_force(spark, tables, tmp_path):
    import shutil

    import numpy as np

    folder, con = str(tmp_path / "sf"), tables[1]
    shutil.copytree(tables[0], folder)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["x", "y", w, w, w]) for w in "the database port of the server and the password in dark mode".split()) for _ in range(60)]
    con.execute("create table near_copies(doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into near_copies values (?, ?, 'en', ?, 1)", [(i, t, f"src{i % 3}") for i, t in enumerate(texts)])
    con.execute(f"copy near_copies to '{folder}/documents.parquet' (format parquet)")
    m = store.with_provenance(catalog.model.memories(spark, folder), catalog.model.provenance(spark, folder)).collect()
    trust = {r.id: r.trust for r in catalog._trusted(spark, folder).collect()}
    e = {r.id: np.array(emb.embed(r.content), np.float32).astype(float) for r in m}
    by, want, folds = {r.id: r for r in m}, {}, []
    for new in sorted((r for r in m if r.valid_until is None), key=lambda r: r.id):
        dist = {i: round(float(np.sqrt(((e[i] - e[new.id]) ** 2).sum())), 6) for i in e if i <= new.id}
        going = True
        for i in sorted(dist, key=lambda i: (dist[i], i))[:20]:
            old, s = by[i], max(0.0, 1 - dist[i] ** 2 / 2)
            x, y = set(new.content.lower().split()), set(old.content.lower().split())
            d = 1 - len(x & y) / len(x | y)
            same = old.source_type == new.source_type == "agent" and old.source_id == new.source_id
            if i == new.id or s <= 0.7 or old.valid_until is not None or old.namespace not in ("shared", new.namespace) or same or not 0 < d < 0.65:
                continue
            want[new.id, i] = round(d, 6)
            if going:
                going = trust[new.id] > trust[i]
                folds.append((new.id, i, i if going else new.id, "archived_old" if going else "kept_old"))
    got = {(r.new_id, r.old_id): r.distance for r in catalog.QUERIES["contradiction_candidates"](spark, folder).collect()}
    assert got == want and any(a - b > 1 for a, b in got)
    assert sorted(map(tuple, catalog.QUERIES["resolve_contradictions"](spark, folder).collect())) == sorted(folds)
    assert {a % 2 for a, *_ in folds} == {0, 1} and len({a for a, *_ in folds}) < len(folds) < len(want)


def test_word_diff():
    assert curation.word_diff("the port is 3000.", "the port is 8080.") == "the port is [-3000.-][+8080.+]"
    assert curation.word_diff("", "a") == "[+a+]" and curation.word_diff("a b", "a b") == "a b"


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 1), (5, None), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_graph_stops_at_its_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10)], "a bigint, b bigint")
    got = graph.expand(spark.createDataFrame([(0, 0)], "query_id bigint, node bigint"), edges, 6)
    assert {(r.node, r.depth) for r in got.collect()} == {(i, i) for i in range(7)}


def test_neighbourhoods(spark, tables):
    folder, con = tables
    ties = {}
    for o, p in con.execute("select distinct l_orderkey, l_partkey from lineitem").fetchall():
        ties.setdefault(2 * p, set()).add(2 * o + 1)
        ties.setdefault(2 * o + 1, set()).add(2 * p)
    want = set()
    for p in range(20, 80, 20):
        depth, frontier = {2 * p: 0}, [2 * p]
        for k in range(1, 7):
            frontier = {b for a in frontier for b in ties.get(a, ())} - depth.keys()
            depth |= dict.fromkeys(frontier, k)
        want |= {(p, n, k) for n, k in depth.items()}
    got = [tuple(r) for r in catalog.QUERIES["graph_bfs"](spark, folder).select("query_id", "node", "depth").collect()]
    assert len(got) == len(want) and set(got) == want and max(k for _, _, k in got) > 3
    assert len({r.entity_id for r in catalog.QUERIES["file_history"](spark, folder).collect()}) > 1


def test_context_holds_hits_hops_and_reputation(spark, tables):
    import math
    import re
    from collections import Counter

    folder, con = tables
    texts = dict(con.execute("select doc_id, lower(text) from documents").fetchall())
    df = Counter(t for text in texts.values() for t in set(re.split("[^a-z0-9]+", text)))
    names = [t for t, n in df.items() if len(t) >= 9 and 2 <= n <= 5]
    m = store.with_provenance(store.active(model.memories(spark, folder)), model.provenance(spark, folder))
    m = {r.id: r for r in store.reputation_of(m, store.agent_stats(model.agent_events(spark, folder))).collect()}
    pairs = [(f"e{p}", o) for o, p in con.execute("select distinct l_orderkey, l_partkey from lineitem").fetchall()] + [(n, i) for n in names for i in m if n in texts[i]]
    ties = {}
    for e, o in pairs:
        ties.setdefault(e, set()).add(o)
        ties.setdefault(o, set()).add(e)
    questions = {r.query_id: r.query for r in catalog._questions(spark, folder).collect()}
    hits, want = {}, {}
    for r in catalog.QUERIES["hybrid_search"](spark, folder).collect():
        hits.setdefault(r.query_id, {})[r.id] = r.score
    for q, query in questions.items():
        found = hits.get(q, {})
        seen = frontier = set(found) | {n for n in names if n in query.lower()}
        for _ in range(6):
            frontier = {b for a in frontier for b in ties.get(a, ())} - seen
            seen = seen | frontier
        for i in {n for n in seen if n in m}:
            base = found.get(i, 0.5 * max(found.values()) if found else 0.4)
            want[q, i] = ("search" if i in found else "hop", base * math.exp(-0.01 * max(0, catalog.NOW - m[i].last_accessed) / 3600) * m[i].reputation)
    rows = catalog.QUERIES["context_candidates"](spark, folder).collect()
    got = {(r.query_id, r.id): (r.source, r.score) for r in rows}
    assert len(rows) == len(want) and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)
    assert {x for x, _ in got.values()} == {"search", "hop"} and any(r.reputation != 1 for r in m.values())
    for r in catalog.QUERIES["optimized_context"](spark, folder).collect():
        ranked = sorted((-score, i) for (q, i), (_, score) in want.items() if q == r.query_id)
        assert r.memories == plain_pack([(i, m[i].content) for _, i in ranked], r.budget) and r.tokens == sum(cost_of(m[i].content) for i in r.memories) <= r.budget
        assert all(f"#{i}: {m[i].content}" in r.context for i in r.memories) and (r.memories or context.NOTHING in r.context)


def cost_of(text):
    return -(-len(text) // 4) + 3


def plain_pack(ranked, most):
    taken, used = [], 0
    for i, text in ranked:
        words = set(text.lower().split())
        alike = any(words and w and len(words & w) / len(words | w) > 0.60 for _, w in taken)
        if not alike and used + cost_of(text) <= most:
            taken.append((i, words))
            used += cost_of(text)
    return [i for i, _ in taken]


@pytest.mark.parametrize(("first", "growth"), [(1, 2), (3, 2), (128, 8)])
def test_packing_by_rounds_equals_one_walk(spark, first, growth):
    rng = random.Random(first)
    texts = {i: " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([0, 1, 3, 8, 30, 90]))) for i in range(80)}
    texts |= {90: None, 91: "a  A\ta", 92: "z" * 5000}
    rows, want = [], {}
    for q in range(12):
        most = rng.choice([0, 3, 10, 60, 400, 1500])
        some = [(rng.choice([1.0, 0.5, rng.random()]), i) for i in rng.sample(sorted(texts), rng.randrange(0, 80))]
        rows += [(q, i, cost_of(texts[i] or ""), s, most) for s, i in some for _ in range(rng.choice([1, 1, 2]))]
        want[q] = plain_pack([(i, texts[i] or "") for _, i in sorted((-s, i) for s, i in some)], most)
    found = spark.createDataFrame([*rows, (0, 999, 4, 9.0, 100), (None, 1, 4, 9.0, 100)], "query_id bigint, id bigint, cost bigint, score double, budget int")
    memories = spark.createDataFrame([*texts.items(), (None, "x")], "id bigint, content string")
    got = {}
    for r in sorted(context.pack_context(found, memories, first, growth).collect(), key=lambda r: (r.query_id, r.position)):
        got.setdefault(r.query_id, []).append(r.id)
        assert r.position == len(got[r.query_id]) and r.tokens == cost_of(texts[r.id] or "")
    assert got == {q: t for q, t in want.items() if t} and len(got) > 5
    assert context.pack_context(found.limit(0), memories).count() == context.pack_context(found, memories.limit(0)).count() == 0


def test_whole_prompts(spark):
    asked = spark.createDataFrame([(1, "debugging", "critical"), (2, "general", "low")], "query_id bigint, intent string, urgency string")
    packed = spark.createDataFrame([(1, 1, 7, "the port is 1"), (1, 2, 8, "rule: no tabs"), (1, 3, 9, None)], "query_id bigint, position int, id bigint, content string")
    made = {style: {r.query_id: r.prompt for r in context.system_prompt(asked, packed, 1718454600, style, agent).collect()} for style, agent in (("text", None), ("markdown", "a"), ("json", "a"))}
    acts = [context.CAUTION, context.INTENT_ACTIONS["debugging"], "Adhere to guideline: rule: no tabs..."]
    assert made["text"][1] == "=== MEMORY CONTEXT ===\nUpdated: 6/15/2024 12:30:00 | 3 memories\n\n[RULES & CONVENTIONS]\n• rule: no tabs\n\n[CONTEXT]\n• the port is 1\n• \n\n[SUGGESTED ACTIONS]\n" + "\n".join("• " + a for a in acts) + "\n\n=== END MEMORY CONTEXT ==="
    assert made["markdown"][2] == "# Memory Context\n> 0 memories | Updated: 6/15/2024 12:30:00 | Agent: `a`\n\n---"
    told = json.loads(made["json"][1])
    assert told["memories"] == [{"id": 7, "content": "the port is 1"}, {"id": 8, "content": "rule: no tabs"}, {"id": 9, "content": ""}] and told["suggested_actions"] == acts
    assert told["generated_at"] == "2024-06-15T12:30:00.000Z" and json.loads(made["json"][2])["memories"] == [] and context.NOTHING in json.loads(made["json"][2])["context"]


def test_audit_detects_changes_and_signatures(spark):
    rows = spark.createDataFrame([(i, "k", f"p{i}") for i in range(5)], "id bigint, key string, payload string")
    chained = audit.chain(rows, "key", "id", F.col("payload")).cache()
    assert audit.verify(chained, "key", "id", F.col("payload")).where("not (content_ok and link_ok)").count() == 0
    edited = chained.withColumn("payload", F.when(F.col("id") == 2, "x").otherwise(F.col("payload")))
    assert [r.id for r in audit.verify(edited, "key", "id", F.col("payload")).where("not content_ok").collect()] == [2]
    assert [r.id for r in audit.verify(chained.where("id <> 2"), "key", "id", F.col("payload")).where("not link_ok").collect()] == [3]
    keys = audit.Keys(spark)
    again = audit.Keys(spark, *keys.export())
    assert again.verify("text", keys.sign("text")) and not again.verify("text2", keys.sign("text")) and not again.verify("text", "AAAA")


def test_every_head_is_signed_as_the_jvm_would(spark):
    keys = audit.Keys(spark)
    heads = spark.createDataFrame([(i, f"head {i}") for i in range(60)], "user_id bigint, head string")
    got = audit.sign_heads(heads, keys).collect()
    assert sorted(r.user_id for r in got) == list(range(60)) and all(r.verified and not r.forged for r in got)
    assert all(r.signature == keys.sign(r.head) and keys.verify(r.head, r.signature) for r in got)


def test_signing_is_dealt_to_all_cores_and_short(spark):
    keys = audit.Keys(spark)
    heads = spark.range(200).select((F.col("id") % 50).alias("user_id")).groupBy("user_id").agg(F.concat(F.lit("head "), F.min("user_id")).alias("head"))
    signed = audit.sign_heads(heads, keys)
    assert len({r.p for r in signed.select(F.spark_partition_id().alias("p")).collect()}) > 1
    seed, public = keys.raw()
    assert sum(map(len, (audit._base_table(), audit._key_table(public)))) == 64  # a byte of a scalar is one addition, not eight doublings
    for text in (b"", b"a", bytes(range(256))):
        made = audit.sign_with(seed, public, text)
        assert audit.verify_with(public, text, made) and not audit.verify_with(public, text + b"x", made)
        other = [bytes([made[0] ^ 1]) + made[1:], made[:63] + bytes([made[63] ^ 1]), made[:-1], bytes(64), (2**255 - 18).to_bytes(32, "little") + made[32:], made[:32] + (int.from_bytes(made[32:], "little") + audit._Q).to_bytes(32, "little")]
        assert not any(audit.verify_with(public, text, x) for x in other)
    assert not audit.verify_with((2**255 - 19).to_bytes(32, "little"), b"a", audit.sign_with(seed, public, b"a"))


def test_signatures_of_every_user(spark, tables, tmp_path):
    import shutil

    folder, con = str(tmp_path / "sf"), tables[1]
    shutil.copytree(tables[0], folder)
    con.execute(f"copy (select * replace (event_id % 45 as user_id) from events) to '{folder}/events.parquet' (format parquet)")
    got = catalog.QUERIES["attestation_signatures"](spark, folder).collect()
    assert sorted(r.user_id for r in got) == list(range(45)) and all(r.verified and not r.forged and r.signature_chars == 88 for r in got)


def test_export_import_and_commits(spark, tmp_path):
    m = spark.createDataFrame([memory(1, "one"), memory(2, "two"), memory(3, "gone", until=NOW)], MEMORIES)
    p = spark.createDataFrame([(1, 1, "agent", "y", 0, 0.5)], PROVENANCE)
    files.write_jsonl(files.export_rows(m, p), str(tmp_path / "out"))
    (tmp_path / "out" / "extra.json").write_text('not json\n{"content": "  "}\n{"content": "three", "namespace": "shared"}\n')
    assert sorted(r.content for r in files.read_jsonl(spark, str(tmp_path / "out"), m.where("id = 1")).collect()) == ["three", "two"]
    repo = tmp_path / "r"
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    repo.mkdir()
    run("init")
    (repo / "f.txt").write_text("x")
    run("add", ".")
    run("commit", "-m", "feat: first")
    got = files.commit_memories(files.commit_log(spark, str(repo))).first()
    assert "Commit: feat: first — by n on " in got.content and got.importance_score == 0.9 and got.files == ["f.txt"]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(2):
        (src / f"{k}.jsonl").write_text(json.dumps({"step_index": k}) + "\nbroken\n")
    seen = []
    jobs = spark.readStream.schema("step_index int").json(str(src))

    def work(df):
        seen.append(df.count())
        raise RuntimeError

    tails.run_jobs(jobs, work, str(tmp_path / "dead"), str(tmp_path / "check")).awaitTermination()
    assert len(seen) == 3 and spark.read.json(str(tmp_path / "dead")).count() == 4


# --- cases that every operator defines


def _emptied(folder, top):
    """Tables without rows, and tables of three rows in which all is null."""
    con = duckdb.connect()
    for kind, body in (("empty", "limit 0"), ("null", None)):
        (top / kind).mkdir()
        for name in ("documents", "labels", "embeddings", "events", "benchmark", "conversations", "part", "customer", "lineitem"):
            src = f"read_parquet('{folder}/{name}.parquet')"
            cols = [r[0] for r in con.execute(f"describe select * from {src}").fetchall()]
            kinds = [r[1] for r in con.execute(f"describe select * from {src}").fetchall()]
            sql = f"select * from {src} limit 0" if body else f"select {', '.join(f'null::{k} as {c}' for c, k in zip(cols, kinds, strict=True))} from range(3)"
            con.execute(f"copy ({sql}) to '{top}/{kind}/{name}.parquet' (format parquet)")


@pytest.fixture(scope="module")
def bare(tables, tmp_path_factory):
    top = tmp_path_factory.mktemp("bare")
    _emptied(tables[0], top)
    return top


@pytest.mark.parametrize("kind", ["empty", "null"])
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_take_empty_tables_and_nulls(spark, bare, name, kind):
    rows = catalog.QUERIES[name](spark, str(bare / kind)).collect()
    if kind == "empty" and name not in ("content_stats", "delete_cascade", "audit_export"):
        assert rows == []


# --- nearest neighbours and consolidation


def test_nearest_neighbours_equal_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    data = [(int(i), [float(x) for x in rng.integers(0, 3, 4)]) for i in range(400)] + [(400, None), (None, [1.0, 0.0, 0.0, 0.0]), (401, [1.0, None, 0.0, 0.0]), (402, [1.0, 2.0])]
    v = spark.createDataFrame(data, "id bigint, embedding array<float>")
    good = {i: np.array(e) for i, e in data if i is not None and e is not None and None not in e}
    for block, least, earlier in ((10**6, 10**6, False), (64, 16, False), (64, 16, True)):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        monkeypatch.setattr(retrieval, "LEAST_BLOCK", least)
        got = retrieval.knn(v, v.select(F.col("id").alias("query_id"), "embedding"), 7, earlier).collect()
        want = set()
        for q, x in good.items():
            near = sorted((round(float(np.sqrt(((x - y) ** 2).sum())), 6), i) for i, y in good.items() if len(x) == len(y) and (not earlier or i <= q))[:7]
            want |= {(q, i, d, k + 1) for k, (d, i) in enumerate(near)}
        assert {(r.query_id, r.id, r.distance, r.rank) for r in got} == want and len(got) == len(want)


def _plain_consolidation(m, hits):
    """The walk in the order of ids, one seed after another."""
    gone, settled, out = set(), set(), []
    for seed in sorted(hits):
        if seed in settled:
            continue
        group = sorted((n for n in hits[seed] if n not in settled and n not in gone), key=lambda n: (-m[n][1], -m[n][2], n))
        if len(group) < 2:
            continue
        keep = group[0]
        settled.add(keep)
        for n in group[1:]:
            kind = curation.relationship_of(curation.bare_words(m[keep][0]), curation.bare_words(m[n][0]))
            if kind == "different":
                continue
            loser, winner = (keep, n) if kind == "subset:b" else (n, keep)
            out.append((loser, winner, kind.split(":")[0]))
            gone.add(loser)
            settled.add(n)
            keep = winner
    return out


def test_consolidation_equals_the_plain_walk(spark):
    rng = random.Random(9)
    for trial in range(3):
        m = {i: (" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))), rng.choice([0.5, 1.0, 1.0]), rng.choice([0.1, 0.9])) for i in range(60)}
        hits = {i: {i} | {j for j in range(60) if rng.random() < 0.08} for i in range(0, 60)}
        table = spark.createDataFrame([(i, *x) for i, x in m.items()] + [(None, "x", 1.0, 1.0)], "id bigint, content string, trust double, importance double")
        pairs = spark.createDataFrame([(i, j, 0.9) for i, x in hits.items() for j in x] + [(1, 999, 0.9)], "a bigint, b bigint, similarity double")
        want = sorted(_plain_consolidation(m, hits))
        for alone in (50_000,) if trial else (50_000, 40, 0):  # one walk, rounds and a walk, rounds only or components
            assert sorted(map(tuple, curation.consolidate(table, pairs, alone).collect())) == want
        assert {r[2] for r in want} >= {"contradiction", "subset"}


def test_consolidation_with_a_hub_and_seeds_that_are_not_their_own_neighbours(spark):
    """Every seed has one memory in common, so rounds close one at a time and components take over; seeds that others settle are passed over."""
    rng = random.Random(10)
    m = {i: (f"only {i} of its kind" if i else "hub of all", 1.0, rng.choice([0.1, 0.9])) for i in range(40)} | {i: ("copies of one text", 1.0, 0.5) for i in range(40, 60)}
    hits = {i: {0, i} for i in range(40)} | {i: {j for j in range(40, 60) if j != i and rng.random() < 0.3} for i in range(40, 60)}
    table = spark.createDataFrame([(i, *x) for i, x in m.items()], "id bigint, content string, trust double, importance double")
    pairs = spark.createDataFrame([(i, j, 0.9) for i, x in hits.items() for j in x], "a bigint, b bigint, similarity double")
    want = sorted(_plain_consolidation(m, hits))
    assert want and all(sorted(map(tuple, curation.consolidate(table, pairs, alone).collect())) == want for alone in (50_000, 0))
    assert curation.consolidate(table, pairs.where("false"), 0).count() == 0


def _plain_diff(x, y):
    """The whole table, read back from its end; the steps as they are told."""
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
    steps, i, j = [], len(x), len(y)
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            steps.append(("", x[i]))
        elif not j or (i and table[i - 1][j] > table[i][j - 1]):
            i -= 1
            steps.append(("-", x[i]))
        else:
            j -= 1
            steps.append(("+", y[j]))
    out = ""
    for sign, run in itertools.groupby(reversed(steps), key=lambda s: s[0]):
        text = "".join(w for _, w in run)
        out += f"[{sign}{text}{sign}]" if sign and text else text
    return out


def test_word_diff_is_a_shortest_edit():
    rng = random.Random(10)
    for _ in range(400):
        a, b = (" ".join(rng.choice("xyz") for _ in range(rng.randrange(0, 14))) for _ in range(2))
        diff = curation.word_diff(a, b)
        assert re.sub(r"\[-(.*?)-\]", r"\1", re.sub(r"\[\+.*?\+\]", "", diff)) == a and re.sub(r"\[\+(.*?)\+\]", r"\1", re.sub(r"\[-.*?-\]", "", diff)) == b
        assert diff == _plain_diff(re.split(r"(\s+)", a), re.split(r"(\s+)", b))


def test_word_diff_of_long_texts_in_little_memory():
    rng = random.Random(11)
    a = [rng.choice("abcdefgh") for _ in range(7_500)]
    b = [w for w in a if rng.random() < 0.9]
    tracemalloc.start()
    diff = curation.word_diff(" ".join(a), " ".join(b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and re.sub(r"\[-(.*?)-\]", r"\1", re.sub(r"\[\+.*?\+\]", "", diff)) == " ".join(a)


def test_names_of_any_number(spark, tables):
    texts = spark.createDataFrame([(1, "Has name3 and NAME1499 within"), (2, None), (3, ""), (4, "prename7post"), (1, "Has name3 and NAME1499 within")], "id bigint, content string")
    names = spark.createDataFrame([(i, f"Name{i}") for i in range(1500)] + [(2000, None), (2001, ""), (None, "has")], "id bigint, name string")
    want = sorted({(t, i) for t, low in ((1, "has name3 and name1499 within"), (4, "prename7post")) for i in range(1500) if f"name{i}" in low})
    for block in (10**6, 100):
        assert sorted(map(tuple, graph.implied_edges(texts, names, block).collect())) == want
    assert graph.implied_edges(texts, names.where("false")).count() == 0


def test_many_names_are_found_by_words_without_the_driver(spark, monkeypatch):
    rng = random.Random(5)
    plain = ["".join(rng.choice("ab1") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    long = "".join(rng.choice("ab1") for _ in range(500))
    told = [*plain, "A B", "b é", "é", "x\n", "x", long[60:124], long[64:129], long[100:300], long]
    texts = [(i, "".join(rng.choice(["a", "b", "1", "A", " ", "é", "-", "x\n"]) for _ in range(60))) for i in range(60)] + [(100, f"in {long.upper()}!"), (101, long[90:310]), (102, None), (103, "")]
    want = sorted({(i, n) for i, t in texts for n in map(str.lower, told) if t and n in t.lower()})
    seen, inner = [], graph._finder
    monkeypatch.setattr(graph, "_finder", lambda shared, *kind: (seen.append([n for n, _ in shared.value]), inner(shared, *kind))[1])
    rows = spark.createDataFrame(texts, "id bigint, content string")
    for block in (10**6, 7, 2):
        for kind in ("string", "bigint"):
            names = spark.createDataFrame([(n, n) if kind == "string" else (i, n) for i, n in enumerate(told)], f"id {kind}, name string")
            seen.clear()
            got = graph.implied_edges(rows, names, block).collect()
            assert sorted({(m, (e if kind == "string" else told[e]).lower()) for m, e in got}) == want
            if kind == "string":
                assert len(got) == len(set(got))
            if block < 100:
                assert {n for some in seen for n in some} == {"a b", "b é", "é", "x\n", long[64:129], long[100:300], long} and all(len(some) <= block for some in seen)


# --- the write path


def _store(spark):
    m = spark.createDataFrame([memory(1, "the database port of the server is 5432"), memory(2, "mine alone", namespace="agent-a"), memory(3, "gone", until=NOW)], MEMORIES)
    v = m.select("id", emb.embedding(F.col("content")).alias("embedding"))
    p = spark.createDataFrame([(1, 1, "agent", "Agent-B", 0, 0.5), (2, 2, "agent", "user-dialogue", 0, 0.4)], PROVENANCE)
    return m, v, p, spark.createDataFrame([], "agent_id string, action string")


ROW = "entry bigint, content string, importance double, agent_id string, shared boolean"


def test_adding_by_policy(spark):
    m, v, p, e = _store(spark)
    rows = [
        (0, "the database port of the server is 9999", 2.0, "Agent-A", True), (1, "mine alone", None, "AGENT-A", False), (2, "  ", 1.0, None, True), (3, None, 1.0, None, True), (4, "x" * 10_001, 1.0, None, True), (5, "gone", 0.5, None, None),
        (6, "gone", 0.5, "agent-a", False), (7, "for a only", 0.5, "agent-a", False), (8, "for a only", 0.5, "agent-c", False), (9, "password: hunter2222", 0.5, None, True),
    ]
    done = write.add_memories(m, v, p, e, spark.createDataFrame(rows, ROW), NOW + 5)
    got = {r.entry: (r.id, r.namespace, r.outcome) for r in done.results.collect()}
    assert got == {0: (4, "shared", "stored"), 1: (2, "agent-a", "exists"), 2: (None, "shared", "error"), 3: (None, "shared", "error"), 4: (None, "shared", "error"), 5: (9, "shared", "stored"), 6: (9, "agent-a", "exists"), 7: (11, "agent-a", "stored"), 8: (12, "agent-c", "stored"), 9: (13, "shared", "stored")}
    after = {r.id: r for r in done.memories.collect()}
    assert after[1].valid_until == NOW + 5 and after[4].parent_id == 1 and after[4].importance_score == 1.0 and after[13].content == "password: [REDACTED]" and len(after) == 8
    assert (after[2].access_count, after[2].importance_score, after[9].access_count) == (1, 1.0, 1)
    sources = {r.memory_id: (r.source_type, r.source_id, r.confidence) for r in done.provenance.collect()}
    assert sources[2] == ("agent", "agent-a", 1.0) and sources[4] == ("agent", "agent-a", 1.0) and sources[9] == ("manual", None, 1.0)
    ledger = done.contradictions.collect()
    assert [(r.old_memory_id, r.new_memory_id) for r in ledger] == [(1, 4)] and "new memory is more trustworthy" in ledger[0].resolution_reason
    stats = {r.agent_id: (r.memories_created, r.memories_confirmed, r.memories_contradicted) for r in store.agent_stats(done.events).collect()}
    assert stats == {"agent-a": (3, 1, 0), "agent-b": (0, 0, 1), "agent-c": (1, 0, 0)}
    assert sorted(r.id for r in done.vectors.collect()) == [1, 2, 3, 4, 9, 11, 12, 13]
    _, counts = write.batch_add(m, v, p, e, spark.createDataFrame(rows, ROW), NOW + 5)
    assert counts == {"stored": 5, "skipped": 2, "errors": 3}
    with pytest.raises(ValueError):
        write.batch_add(m, v, p, e, spark.createDataFrame(rows, ROW), NOW, most=9)
    nothing = write.add_memories(m, v, p, e, spark.createDataFrame([], ROW), NOW)
    assert nothing.memories.count() == 3 and nothing.results.count() == nothing.contradictions.count() == 0


def test_an_agent_completes_its_own_memories(spark):
    """The rule of visibility and of self-updates: same agent, in any namespace, is left out; no agent, and manual sources, are judged."""
    texts = ["the port of the server is 1", "the port of the server is 2"]
    m = lambda na, nb: spark.createDataFrame([memory(1, texts[0], namespace=na), memory(2, texts[1], namespace=nb)], MEMORIES)

    def judged(na, nb, old, new):
        p = spark.createDataFrame([(i, i, k, s, 0, 1.0) for i, (k, s) in enumerate((old, new), 1) if k], PROVENANCE)
        t = m(na, nb)
        return curation.contradictions(store.with_provenance(t, p), t.select("id", emb.embedding(F.col("content")).alias("embedding"))).count()

    a, b, manual, none = ("agent", "A"), ("agent", "b"), ("manual", None), (None, None)
    assert judged("shared", "shared", a, ("agent", "a")) == 0 and judged("x", "x", a, a) == 0 and judged("shared", "x", a, a) == 0
    assert judged("shared", "shared", a, b) == 1 and judged("x", "x", a, b) == 1 and judged("x", "y", a, b) == 0
    assert judged("shared", "x", none, none) == 1 and judged("shared", "shared", manual, manual) == 1 and judged("shared", "shared", manual, a) == 1


def test_links_imports_and_facts(spark):
    m, v, p, _ = _store(spark)
    e = spark.createDataFrame([(1, "auth.js"), (2, "db")], "id bigint, name string")
    asked = spark.createDataFrame([(0, "auth.js", 1, None, None), (1, "nope", 1, None, None), (2, "db", 2, "uses", "agent-b"), (3, "db", 3, None, None), (4, "db", 2, "uses", "Agent-A"), (5, None, None, None, None)], "entry bigint, entity_name string, memory_id bigint, relation string, agent_id string")
    edges, results = write.link(e, m, asked, NOW)
    assert sorted((r.source_id, r.target_id, r.relation) for r in edges.collect()) == [(1, 1, "mentions"), (2, 2, "uses")]
    assert {r.entry: r.error for r in results.collect()} == {0: None, 1: 'Entity "nope" not found.', 2: "Memory #2 not found", 3: "Memory #3 not found", 4: None, 5: 'Entity "" not found.'}
    lines = [(0, "the database port of the server is 5432", 1.0, None, None, None), (1, "The database port of the server is 5432!", 1.0, None, None, None), (2, "something else entirely new", None, "x", None, None), (3, "something else entirely new", None, "x", None, None), (4, " ", 1.0, None, None, None), (5, "old", 1.0, None, 5, None), (6, None, None, None, None, "bad")]
    records = spark.createDataFrame(lines, "line bigint, content string, importance_score double, namespace string, valid_until bigint, bad string")
    assert [r.outcome for r in write.import_memories(m, v, records).orderBy("line").collect()] == ["skipped", "skipped", "imported", "skipped", "error", "skipped", "error"]
    assert [r.outcome for r in write.import_memories(m, v, records, embed=None).orderBy("line").collect()][:2] == ["skipped", "imported"]
    facts = spark.createDataFrame([(1, 0, "gone", 0.9), (1, 1, "mine alone", 0.8), (2, 0, "gone", 0.7)], "id bigint, position int, content string, confidence double")
    rows, sources, told = write.store_facts(facts, m, 100, NOW)
    assert [(r.id, r.content, r.importance_score) for r in rows.collect()] == [(101, "gone", 0.9)] and sources.first().source_id == write.FACT_SOURCE
    assert sorted((r.id, r.position, r.stored) for r in told.collect()) == [(1, 0, True), (1, 1, False), (2, 0, False)]


def test_history_of_versions(spark):
    m = spark.createDataFrame([memory(1, "the port is 1", until=NOW, created=NOW), memory(2, "the port is 2", parent=1, created=NOW + 1), memory(3, "other 100% text", created=NOW + 2), memory(4, "replaced", until=NOW, created=NOW + 3)], MEMORIES)
    p = spark.createDataFrame([(1, 2, "agent", "X", 0, 0.5)], PROVENANCE)
    ties = spark.createDataFrame([(4, 3)], "old_memory_id bigint, new_memory_id bigint")
    q = spark.createDataFrame([(0, "2"), (1, "port"), (2, "00% t"), (3, "99"), (4, None), (5, " ")], "query_id bigint, query string")
    hits = history.history_hits(m, q)
    assert sorted((r.query_id, r.id, r.how) for r in hits.collect()) == [(0, 2, "id"), (1, 1, "words"), (1, 2, "words"), (2, 3, "part")]
    got = sorted((r.query_id, r.position, r.id, r.source_type, r.source_id, r.archived, r.diff) for r in history.memory_history(m, p, ties, hits).collect())
    chain = [(1, 1, "manual", None, True, None), (2, 2, "agent", "x", False, "the port is [-1-][+2+]")]
    assert got == [(q, *row) for q in (0, 1) for row in chain] + [(2, 1, 3, "manual", None, False, None), (2, 2, 4, "manual", None, True, "[-other 100% text-][+replaced+]")]


def test_batch_search_takes_the_last_of_a_query(spark):
    m, v, p, e = _store(spark)
    x = lambda t: [float(k) for k in emb.embed(t)]
    rows = [(0, "mine alone", x("mine alone"), None, None), (1, "mine alone", x("mine alone"), 1.0, "Agent-A"), (2, "port", x("port"), 0.0, None), (3, None, None, None, None), (4, "server", x("server"), None, None)]
    entries = spark.createDataFrame(rows, "entry bigint, query string, embedding array<double>, limit double, agent_id string")
    assert sorted((r.query, r.id) for r in retrieval.batch_search(m, v, p, e, entries).collect()) == [("mine alone", 2), ("server", 1)]
    with pytest.raises(ValueError):
        retrieval.batch_search(m, v, p, e, entries, most=4)


# --- audit records


def test_records_are_signed_over_link_items_and_text(spark):
    items = [(7, "ab", 9000)]
    data = [(f"c{i % 2}", i, f"id{i}", 'say "x"\n\u2028é', "2024-01-01T00:00:00.000Z", items if i % 3 else [], "a" if i else None, "") for i in range(10)]
    schema = "chain string, id bigint, attestation_id string, query string, timestamp string, memories_retrieved array<struct<id: bigint, content_hash: string, score: bigint>>, agent_id string, session_id string"
    keys = audit.Keys(spark)
    made = audit.attest(spark.createDataFrame(data, schema), keys).cache()
    public = keys.raw()[1]
    error = lambda df: {r.id: r.error for r in audit.verify_records(df, public).collect() if r.error}
    assert error(made) == {}
    by = {r.id: r for r in made.collect()}
    assert by[0].previous_hash is by[1].previous_hash is None and all(by[i].previous_hash == by[i - 2].hash for i in range(2, 10))
    signed = audit.document(by[4].asDict(True), by[4].previous_hash)
    assert json.loads(signed)["session_id"] is None and list(json.loads(signed)) == list(audit.FIELDS)
    import base64
    import hashlib

    assert keys.verify(signed, base64.b64encode(bytes.fromhex(by[4].signature)).decode())
    assert by[4].hash == hashlib.sha256(json.dumps(json.loads(signed) | {"signature": by[4].signature}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    one = F.col("id") == 4
    for edited in (F.when(one, "other").otherwise(F.col("query")).alias("query"), F.when(one, F.lit(None)).otherwise(F.col("agent_id")).alias("agent_id")):
        bad = error(made.withColumn(edited._jc.toString().split(" AS ")[-1], edited))
        assert bad[4] == audit.MISMATCH and set(bad) == {4, 6, 8} and bad[6].startswith(audit.BROKEN)
    assert set(error(made.where("id <> 4"))) == {6, 8}
    forged = audit.attest(made.select(*audit.RECORD), audit.Keys(spark))
    assert set(error(forged).values()) >= {audit.FORGED} and len(error(forged)) == 10
    assert audit.verify_records(made.where("false"), public).count() == 0
    lines = audit.export_report(audit.verify_records(made, public), spark.createDataFrame([("a", 1, 2, 3, 0.75)], "agent_id string, memories_created int, memories_confirmed int, memories_contradicted int, reputation_score double"), None, None, "now").collect()
    assert len(lines) == 12 and "SECURE" in lines[0].json and "| `a` | 1 | 2 | 3 | **0.75** |" in [r.line for r in lines]


def test_an_edit_with_its_hash_made_anew_shows_in_the_next_record(spark):
    rows = spark.createDataFrame([(i, "k", f"p{i}") for i in range(5)], "id bigint, key string, payload string")
    chained = audit.chain(rows, "key", "id", F.col("payload"))
    edited = chained.withColumn("payload", F.when(F.col("id") == 2, "x").otherwise(F.col("payload")))
    edited = edited.withColumn("own_hash", F.when(F.col("id") == 2, audit.linked(F.col("payload"), F.col("previous_hash"))).otherwise(F.col("own_hash")))
    got = audit.trusted_up_to(audit.verify(edited, "key", "id", F.col("payload")), "key", "id").orderBy("id").collect()
    assert [(r.content_ok, r.link_ok, r.chain_ok) for r in got] == [(True, True, True)] * 3 + [(True, False, False), (True, True, False)]


# --- sources and streams


def test_commit_sink_makes_entities_and_edges(spark):
    schema = "hash string, author string, date string, subject string, body string, notes string, files array<string>"
    commits = spark.createDataFrame([("a" * 40, "Ann", "2024-01-01T00", "feat: x", "", "", ["f.py", "g.py", "f.py"]), ("b" * 40, "Ann", "2024-01-02T00", "docs: y", "More", "PR 1", []), ("c" * 40, "Bob", "2024-01-02T00", "z", "", "", None)], schema)
    m = spark.createDataFrame([memory(5, "[ccccccc] Commit: known")], MEMORIES)
    made = files.ingest_commits(commits, m, spark.createDataFrame([(9, "f.py", "file", 0)], model.ENTITIES), NOW)
    rows = {r.id: r for r in made["memories"].collect()}
    assert [rows[i].content for i in sorted(rows)] == ["[aaaaaaa] Commit: feat: x — by Ann on 2024-01-01", "[bbbbbbb] Commit: docs: y — by Ann on 2024-01-02. More [PR Notes] PR 1"] and min(rows) == 6
    assert sorted((r.id, r.name, r.type) for r in made["entities"].collect()) == [(10, "Ann", "person"), (11, "g.py", "file")]
    assert sorted((r.source_id, r.target_id, r.relation) for r in made["edges"].collect()) == [(9, 6, "touches"), (10, 6, "authored"), (10, 7, "authored"), (11, 6, "touches")]


def test_a_store_is_saved_migrated_and_loaded(spark, tables, tmp_path):
    before = model.load(spark, tables[0])
    model.save_store(before, str(tmp_path / "store"))
    after = model.load_store(spark, str(tmp_path / "store"))
    assert sorted(map(str, after.memories.select(*before.memories.columns).collect())) == sorted(map(str, before.memories.collect()))
    old = spark.createDataFrame([(1, "x", "more")], "ID int, content string, extra string")
    new = model.migrate(old, MEMORIES)
    assert new.columns == [*(c.strip().split(" ")[0] for c in MEMORIES.split(",")), "extra"] and new.first().id == 1 and new.first().valid_until is None
    assert model.migrate(spark.createDataFrame([(1,)], "id bigint"), model.ATTESTATIONS).columns[4] == "memories_retrieved"


def test_task_histories_go_on_from_their_positions(spark, tmp_path):
    (tmp_path / "tasks").mkdir()
    path = tmp_path / "tasks" / "a.json"
    said = [{"role": "user", "content": "one"}, {"role": "system", "content": "two"}, {"role": "assistant", "content": ""}]
    path.write_text(json.dumps({"history": said}))
    (tmp_path / "tasks" / "b.json").write_text("{not whole")
    rows, after = tails.new_messages(spark, str(tmp_path), within="tasks")
    assert [(r.position, r.content) for r in rows.collect()] == [(0, "one")]
    saved = spark.createDataFrame(after.collect(), after.schema)
    assert [r.last_position for r in after.collect()] == [3]
    path.write_text(json.dumps({"history": [*said, {"role": "assistant", "content": "four"}]}))
    rows, after = tails.new_messages(spark, str(tmp_path), saved, within="tasks")
    assert [(r.position, r.role, r.content) for r in rows.collect()] == [(3, "assistant", "four")] and after.first().last_position == 4
    assert tails.new_messages(spark, str(tmp_path), saved, within="elsewhere")[0].count() == 0


def test_queue_rules(spark, tmp_path):
    import os
    import time

    queue, failed, now = tmp_path / "queue", str(tmp_path / "failed"), int(time.time())
    queue.mkdir()
    for k in range(4):
        tails.enqueue(spark, str(queue), f"{100 + k}-x", f"text {k}", "t", agent_id="a")
    (queue / "050-bad.json").write_text("{")
    (queue / "010-old.json").write_text(json.dumps({"text": "old"}))
    os.utime(queue / "010-old.json", (now - 8 * DAY, now - 8 * DAY))
    assert {r.name: r.state for r in tails.read_queue(spark, str(queue), now, 2).collect()} == {"010-old.json": "expired", "050-bad.json": "corrupt", "100-x.json": "pending", "101-x.json": "pending", "102-x.json": "waiting", "103-x.json": "waiting"}
    seen = []

    def work(job):
        row = job.first()
        seen.append((row.text, row.retries))
        if row.text == "text 1":
            raise RuntimeError

    counts = tails.work_queue(spark, str(queue), failed, now, work)
    assert counts == {"done": 3, "retried": 1, "failed": 0, "corrupt": 1, "expired": 1} and [t for t, _ in seen] == [f"text {k}" for k in range(4)]
    assert tails.work_queue(spark, str(queue), failed, now, work)["retried"] == 1 and tails.work_queue(spark, str(queue), failed, now, work)["failed"] == 1
    assert seen[-1] == ("text 1", 2) and sorted(os.listdir(failed))[-2:] == ["050-bad.json", "101-x.json"]
    assert [f for f in os.listdir(queue) if f.endswith(".json") and not f.startswith(".")] == []


def test_events_fan_out_and_sweeps_run(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    (src / "a.json").write_text('{"event": "memory_added"}\n{"event": "other"}\n{"event": "memory_added"}\n')
    stream = spark.readStream.schema("event string").json(str(src))
    got = {"a": 0, "b": 0}
    tails.fan_out(stream, {k: lambda df, n, k=k: got.update({k: got[k] + df.count()}) for k in got}, str(tmp_path / "check")).awaitTermination()
    assert got == {"a": 3, "b": 3}
    assert [tuple(r) for r in tails.drained(tails.event_counts(stream), "complete").collect()] == [("memory_added", 2)]
    runs = []
    query = tails.every(spark, 1, runs.append, str(tmp_path / "sweeps"))
    for _ in range(60):
        if len(runs) > 1:
            break
        query.awaitTermination(1)
    query.stop()
    assert runs[:2] == [0, 1]


def test_embedder_hook_and_its_fallback(spark):
    good, bad = (spark.createDataFrame(x, "id bigint, t string").repartition(1) for x in ([(1, "ab"), (2, None)], [(3, "boom")]))

    def load():
        def model_(texts):
            if "boom" in texts:
                raise RuntimeError
            return [[3.0, 4.0] if t else [0.0, 0.0] for t in texts]

        return model_

    got = {r.id: r.e for rows in (good, bad) for r in rows.select("id", emb.embedder(load)(F.col("t")).alias("e")).collect()}
    assert [round(x, 6) for x in got[1]] == [0.6, 0.8] and got[2] == [0.0, 0.0] and len(got[3]) == emb.DIMENSIONS


def test_newest_rows_within_the_watermark(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"ts": "2024-01-01T00:00:00Z", "content": "x"}\n{"ts": "2024-01-01T00:01:00Z", "content": "x"}\n{"ts": "2024-01-01T00:01:00Z", "content": "y"}\n')
    stream = spark.readStream.schema("ts timestamp, content string").json(str(src))
    assert sorted(r.content for r in tails.drained(tails.new_only(stream), "append").collect()) == ["x", "y"]
