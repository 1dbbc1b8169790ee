"""A small corpus with nulls, empty and long texts, copies, near copies, ties, repeated rows and columns with clashing names."""

import random

import pytest

EN = "the of and that was with from this have they which their would there could other about these first after where people water great".split()
DE = "der die und nicht eine auch nach werden oder über zwischen schon immer keine müssen können während weil große straße".split()
FR = "les des une dans pour pas sur avec être même très après où déjà leur nous vous était cette comme élève forêt".split()


def prose(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "x", "y", "ing", "s"]) for _ in range(n))


def documents() -> list[tuple]:
    rng, rows = random.Random(11), []
    for i in range(240):
        lang, words = [("en", EN), ("de", DE), ("fr", FR)][i % 3]
        rows.append((i, prose(rng, words, rng.randrange(12, 160)), lang, f"src{i % 4}", None))
    base = rows[0][1].split()
    for i in range(240, 280):  # near copies of one text, some near enough
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        rows.append((i, " ".join(w), "en", "src0", None))
    rows += [(i, rows[5][1], "fr", "src0", None) for i in range(280, 300)]
    rows += [
        (300, None, None, None, None), (301, "", "en", None, 0), (302, " \n\t ", "de", "src1", 3), (303, "!!! 123 ???", None, "src1", None), (304, "one two three", "en", "src1", 13),
        (305, "one two three", "en", "src2", 13), (306, prose(rng, EN, 60000), "en", "src2", None), (307, "a" * 200_000, None, "src3", None), (None, "the text of a row without an id", "en", "src3", 31),
        (None, None, None, None, None), (7, rows[7][1], "fr", "src3", None), (7, rows[7][1], "fr", "src3", None), (308, "ＡＢ ｃ\u00a0\u200bd", "en", None, None), (309, "\x00\x01 nul", "en", None, None),
    ]
    return [(i, t, lang, s, n if n is not None or t is None else len(t)) for i, t, lang, s, n in rows]


@pytest.fixture(scope="session")
def corpus():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The corpus with further columns named as operators name theirs."""
    from pyspark.sql import functions as F

    names = "host path n score kept component_id hub key keys first block q component node held_out spans media group order spread y half unit __id __text __key text_score hits items".split()
    return docs.select("*", *[F.lit(None).cast("int").alias(n) for n in names])


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
