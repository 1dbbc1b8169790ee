"""The query language: grammar, and matches over small texts against a plain reading."""

import pytest
from pyspark.sql import functions as F

from engramite.operators import querylang as ql
from engramite.operators import retrieval

TEXTS = {1: "Node.js and Express server", 2: "The server runs Express", 3: "React is a library", 4: "react native, Vue", 5: "drop table users", 6: "", 7: None, 8: "server express server express"}


@pytest.mark.parametrize(
    "query, program, words",
    [
        ("a b", [0, 1, ql.AND], [["a"], ["b"]]), ('"a b" OR c', [0, 1, ql.OR], [["a", "b"], ["c"]]), ("a OR b AND c NOT d", [0, 1, 2, 3, ql.NOT, ql.AND, ql.OR], [["a"], ["b"], ["c"], ["d"]]),
        ("a b NOT c", [0, 1, ql.AND, 2, ql.NOT], [["a"], ["b"], ["c"]]), ("(a OR b) c*", [0, 1, ql.OR, 2, ql.AND], [["a"], ["b"], ["c"]]), ("and or", [0, 1, ql.AND], [["and"], ["or"]]),
        ('say ""', [0], [["say"]]), ('"" say', [0], [["say"]]), ('"" AND say', [ql.NOTHING, 0, ql.AND], [["say"]]), ("a + b", [0], [["a", "b"]]), ("^a", [0], [["a"]]), ('"a ""b"""', [0], [["a", "b"]]),
    ],
)
def test_programs(query, program, words):
    got = ql.parse(query)
    assert (got.program, [w for w, _, _ in got.leaves]) == (program, words)


@pytest.mark.parametrize("query", ["", "  ", None, "a AND", "NOT a", "OR", '"open', "(a", "a)", "()", "a-b", "what?", 'User OR "drop table" *x*y -', "*", "a ** b", "a 'b'", "x:y"])
def test_malformed(query):
    assert ql.parse(query) == ql.Parsed()


@pytest.mark.parametrize(
    "query, ids",
    [
        ('"Express" AND "server"', {1, 2, 8}), ('"express server"', {1, 8}), ("express NOT node", {2, 8}), ("rea*", {3, 4}), ("serv* expr*", {1, 2, 8}), ('"native v*"', set()), ('"native v"*', {4}), ("^server", {8}),
        ('React OR "drop table"', {3, 4, 5}), ("(vue OR library) react", {3, 4}), ("server -express", set()), ('"server express server express"', {8}), ('User OR "drop table" *', {5}), ("nothing", set()), ("a NOT a", set()),
    ],
)
def test_matches(spark, query, ids):
    texts = spark.createDataFrame(list(TEXTS.items()), "id bigint, content string")
    queries = spark.createDataFrame([(7, query), (8, None)], "query_id bigint, query string")
    assert {r.id for r in retrieval.keyword_and_match(texts, queries).collect()} == ids
    assert {(r.query_id, r.id) for r in retrieval.bm25(texts, queries, 10).collect()} == {(7, i) for i in ids}


def test_a_word_that_a_query_repeats_counts_once(spark):
    texts = spark.createDataFrame([(1, "sun sun sun moon"), (2, "sun moon moon moon"), (3, "tide")], "id bigint, content string")
    queries = spark.createDataFrame([(1, "sun moon moon"), (2, "sun moon"), (3, "sun moon")], "query_id bigint, query string")
    got = {}
    for r in retrieval.bm25(texts, queries, 10).collect():
        got.setdefault(r.query_id, {})[r.id] = (r.score, r["rank"])
    assert got[1] == got[2] == got[3] and got[1].keys() == {1, 2}


@pytest.mark.parametrize("block", [1, 2, 100])
def test_blocks_of_queries(spark, block):
    texts = spark.createDataFrame(list(TEXTS.items()), "id bigint, content string")
    asked = ql.parsed(spark.createDataFrame([(1, "server"), (2, "rea*"), (3, "express OR vue"), (4, "server"), (5, "^the + server")], "query_id bigint, query string"))
    got = {(r.query_id, r.id) for r in ql.matched(texts, asked, block=block).collect()}
    assert got == {(q, i) for q, ids in {1: (1, 2, 8), 2: (3, 4), 3: (1, 2, 4, 8), 4: (1, 2, 8), 5: (2,)}.items() for i in ids}
    rows = ql.matched(texts, asked, counts=True, block=block).collect()
    assert sum(r.df for r in rows if r.leaf == -1) == len(TEXTS) and sum(r.doc_len for r in rows if r.leaf == -1) == 23


def test_scores_are_rounded_as_doubles(spark):
    """0.36265 lies below the half as a double, as SQL rounds it."""
    row = spark.range(1).select(retrieval.rounded(F.lit(0.36265), 4).alias("a"), retrieval.rounded(F.lit(0.36266), 4).alias("b"), retrieval.rounded(F.lit(0.5), 0).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.3626, 0.3627, 1.0)
