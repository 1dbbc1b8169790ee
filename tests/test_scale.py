"""Plans without one task for all, walks, chains and bursts against plain code."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from engramite.operators import audit, context, graph, history, store, write
from engramite.plans.numbers import numbered
from engramite.sources import model
from engramite.streaming import tails


def test_numbers_follow_the_order(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", F.desc("b")], "n", 5).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda r: (r[0], -r[1]))
    assert sorted(r.n for r in got) == list(range(5, 305))
    assert numbered(spark.createDataFrame([], "a int"), ["a"], "n").count() == 0


def test_percentiles_of_equal_values_and_nulls(spark):
    rows = [("a", 1.0)] * 90 + [("a", float(k)) for k in range(10)] + [("b", None), ("c", 7.0), (None, 3.0), (None, 2.0)]
    want = []
    for key in {r[0] for r in rows}:
        x = sorted(v for k, v in rows if k == key and v is not None)
        want += [(key, len(x), x[len(x) // 2], x[min(int(len(x) * 0.9), len(x) - 1)])] if x else []
    got = [tuple(r) for r in store.latencies(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_for_all_rows(spark):
    memories = spark.createDataFrame([(1, "one text", None, 0), (2, "two", None, 0)], "id bigint, content string, valid_until bigint, created_at bigint")
    facts = spark.createDataFrame([(1, 0, "told", 0.9), (2, 0, "told too", 0.8)], "id bigint, position int, content string, confidence double")
    rows, _, _ = write.store_facts(facts, memories, 100, 1)
    assert sorted((r.id, r.content) for r in rows.collect()) == [(101, "told"), (102, "told too")]
    hits = history.history_hits(memories, spark.createDataFrame([(7, "ne te?"), (8, "NE T")], "query_id bigint, query string"))
    for df in (rows, hits, store.latencies(facts, "id", "confidence")):
        assert "NestedLoop" not in plans(df) and "SinglePartition" not in plans(df)
    assert [(r.query_id, r.id, r.how) for r in hits.collect()] == [(8, 1, "part")]


def test_one_memory_updated_twice(spark):
    m = spark.createDataFrame([(1, "a", 0.5, 0, 0, 0, 0, None, 0, "shared", None), (5, "b", 0.5, 0, 0, 0, 0, 9, 0, "shared", None)], tails.MEMORIES)
    after, ledger = store.new_versions(m, spark.createDataFrame([(1, 2, "x"), (1, 3, "y"), (1, 3, None), (5, 6, "z"), (8, 9, "none"), (None, 10, "n")], "old_id bigint, new_id bigint, content string"), 77)
    assert sorted((r.id, r.content, r.valid_until, r.parent_id) for r in after.collect()) == [(1, "a", 77, None), (3, "y", None, 1), (5, "b", 9, None)]
    assert [(r.old_memory_id, r.new_memory_id) for r in ledger.collect()] == [(1, 3)]


@pytest.mark.parametrize("text, want", [(" Warning: x\n", "Warning: x"), ("fyi: x", "fyi: x"), ("Naming: x", "Note: Naming: x"), ("\tplain ", "Note: plain")])
def test_categories(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(store.remembered(F.col("t"))).first()[0] == want


def test_walks_of_many_queries(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(150)] + [(0, k) for k in range(40)] + [(5, None), (None, 6), (7, 7)]
    seeds = [(q, rng.randrange(120)) for q in range(130) for _ in range(2)] + [(None, 3), (9, None), (200, 999)]
    links = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            links[a].add(b)
            links[b].add(a)
    want = set()
    for q in {q for q, _ in seeds}:
        depth = {n: 0 for s, n in seeds if s == q and n is not None}
        todo = deque(depth)
        while todo:
            n = todo.popleft()
            for b in links[n] if depth[n] < 4 else ():
                if b not in depth:
                    depth[b] = depth[n] + 1
                    todo.append(b)
        want |= {(q, n, d) for n, d in depth.items()}
    got = graph.expand(spark.createDataFrame(seeds, "query_id bigint, node bigint"), spark.createDataFrame(edges, "a bigint, b bigint"), 4).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_rows_of_a_walk_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graph.expand(spark.createDataFrame([(q, q % 5) for q in range(70)], "query_id bigint, node bigint"), spark.createDataFrame([(0, 9), (9, 1)], "a bigint, b bigint"))
        above, generate, _ = got._jdf.queryExecution().sparkPlan().toString().partition("Generate")
        assert generate and "Join" not in above and "Exchange" not in above
        assert got.count() == 70 + 2 * 28
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_candidates_of_contexts_are_not_shuffled(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    memories = make([(k, "a Kafka text", 0, 0, None, "shared") for k in range(4)] + [(9, "hidden", 0, 0, None, "own")], "id bigint, content string, created_at bigint, last_accessed bigint, valid_until bigint, namespace string")
    provenance = make([(1, 1, "agent", "a", 0, 1.0)], model.PROVENANCE)
    events = make([(1, "a", "contradicted", None)], "event_id bigint, agent_id string, action string, ts timestamp")
    edges = make([("memory", 9, "entity", 5)], "source_type string, source_id bigint, target_type string, target_id bigint")
    queries, hits = make([(20, "x"), (40, "kafka")], "query_id bigint, query string"), make([(20, 1, 0.8), (20, 9, 0.2)], "query_id bigint, id bigint, score double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = context.context_candidates(memories, provenance, events, make([(5, "Kafka")], "id bigint, name string"), edges, queries, hits, 0)
        above, generate, _ = got._jdf.queryExecution().sparkPlan().toString().partition("Generate")
        assert generate and "Join" not in above and "Exchange" not in above
        want = [(20, k, "hop", 0.4) for k in (0, 2, 3)] + [(20, 1, "search", 0.4), (20, 9, "search", 0.2)] + [(40, k, "hop", 0.2 if k == 1 else 0.4) for k in range(4)]
        assert sorted((r.query_id, r.id, r.source, round(r.score, 9)) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def links(spark, rows, **options):
    schema = "key bigint, id bigint, hash string, previous_hash string, own_error string"
    return {r.key: (r.depth, r.error) for r in audit.walk_links(spark.createDataFrame(rows, schema), **options).collect()}


def test_chains_by_hash(spark):
    rows = [(1, 1, "a", None, None), (2, 2, "b", "a", None), (3, 3, "c", "b", None), (4, 4, "d", "b", None), (5, 5, "e", "gone", None), (6, 6, "f", "e", None)]
    rows += [(7, 7, "g", "h", None), (8, 8, "h", "g", None), (9, 9, "i", "c", "bad"), (10, 10, "j", "i", None), (11, 11, "k", "", None), (12, 12, None, "k", None)]
    got = links(spark, rows)
    assert {k: got[k] for k in (1, 2, 3, 4, 11, 12)} == {1: (0, None), 2: (1, None), 3: (2, None), 4: (2, None), 11: (0, None), 12: (1, None)}
    assert got[5] == (0, "Broken chain: Previous attestation with hash gone not found") == (0, got[6][1]) and got[6][0] == 1
    assert got[7] == (0, "Broken chain: Invalid sequence order") and got[8] == (1, "Broken chain: Invalid sequence order")
    assert got[9] == (3, "bad") and got[10] == (0, "Broken chain: Previous link is invalid: bad")
    assert links(spark, []) == {}


def test_long_chains(spark):
    n = 10_050
    got = links(spark, [(k, k, f"h{k}", f"h{k - 1}" if k else None, None) for k in range(n)])
    assert all(got[k] == (k, None if k <= 10_000 else "Broken chain: chain length exceeds maximum") for k in range(n))
    assert links(spark, [(k, k, f"h{k}", f"h{k - 1}", None) for k in range(6)], most=3) == {k: (k, "Broken chain: Previous attestation with hash h-1 not found" if k < 3 else "Broken chain: chain length exceeds maximum") for k in range(6)}


def test_bursts_of_changes(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda ms: start + timedelta(milliseconds=ms)
    batches = [
        [("a", 0), ("a", 100), ("b", 50), ("a", 390), ("a", 1000), (None, 5)],  # a is quiet between 390 and 1000
        [("a", 1200), ("b", 349), ("b", 1000)],  # late, but in time to join its burst
        [("c", 60_000)],
        [("c", 60_100)],
        [("a", 1300)],  # too late
        [("d", 200_000)],
    ]
    src, schema = tmp_path / "in", "path string, ts timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame([(p, at(ms)) for p, ms in rows], schema).coalesce(1).write.parquet(str(src / f"{k}"))
    told = []

    def react(df, number):
        told.extend((r.path, round((r.due - start).total_seconds() * 1000), r.changes) for r in df.collect())

    for k in range(len(batches)):  # one query after another, from one checkpoint
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(src))
        tails.on_changes(tails.debounced(stream, late="10 seconds"), react, str(tmp_path / "check")).awaitTermination()
    assert sorted(told) == [("a", 1500, 5), ("b", 1300, 3), ("c", 60_400, 2)]  # two bursts of a and of b ended at once
    batch = tails.debounced(spark.createDataFrame([("a", at(0)), ("a", at(299)), ("a", at(600))], schema))
    assert sorted((r.changes for r in batch.collect())) == [1, 2]
