"""Transcripts that grow, over several scans and restarts."""

import json

import pytest

from engramite.streaming import tail_source, tails

FIRST = {"step_index": 0, "source": "USER_EXPLICIT", "type": "USER_INPUT", "content": "I prefer TypeScript over JavaScript for all new source code files"}
SECOND = {"step_index": 1, "source": "MODEL", "type": "PLANNER_RESPONSE", "content": "Decision: We decided to adopt TailwindCSS for styling components"}


def line(record):
    return json.dumps(record) + "\n"


@pytest.fixture
def scan(spark, tmp_path):
    """Reads what is new, in a query of its own each time, and gives all lines read so far."""

    def run(**options):
        stream = tail_source.lines(spark, str(tmp_path / "in"), **options)
        sink = stream.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "offsets"))
        sink.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.file.rsplit("/", 2)[-2], r.position, r.line) for r in spark.read.schema(tail_source.SCHEMA).parquet(str(tmp_path / "rows")).collect())

    def write(name, text, mode="w"):
        path = tmp_path / "in" / name / "transcript.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        with open(path, mode) as f:
            f.write(text)

    run.write = write
    run.positions = lambda: {p.rsplit("/", 2)[-2]: n for p, n in tail_source.positions(spark, str(tmp_path / "offsets")).items()}
    return run


def test_appended_partial_and_rewritten(scan):
    scan.write("a", "one\ntwo\nthr")
    assert scan() == [("a", 0, "one"), ("a", 4, "two")] and scan.positions() == {"a": 8}
    assert len(scan()) == 2  # nothing new
    scan.write("a", "ee\n\nfour", "a")
    scan.write("b", "new\n")
    assert scan()[2:] == [("a", 8, "three"), ("b", 0, "new")] and scan.positions() == {"a": 15, "b": 4}
    scan.write("a", "\n", "a")
    assert ("a", 15, "four") in scan() and scan.positions()["a"] == 20
    scan.write("b", "x\n")  # shorter: from the start
    scan.write("a", "zero\none\ntwo\nthree\nfour\n")  # longer, but another file
    got = scan()
    assert ("b", 0, "x") in got and ("a", 0, "zero") in got and len(got) == 5 + 1 + 5
    assert len(scan()) == len(got)


def test_stretches_cut_no_line(scan):
    rows = [f"{'é' * (k % 40)}{k}" for k in range(500)]
    scan.write("a", "".join(f"{r}\n" for r in rows))
    assert [x[2] for x in scan(split=97)] == rows


def test_depth_and_names(scan, tmp_path):
    for name in ("a", "a/b/c", "a/b/c/d"):
        scan.write(name, f"{name}\n")
    (tmp_path / "in" / "other.jsonl").write_text("other\n")
    assert [x[2] for x in scan(depth=3)] == ["a", "a/b/c"]


def test_records(spark):
    said = [FIRST, SECOND, {**FIRST, "type": "SYSTEM"}, {**FIRST, "type": None, "source": "MODEL"}, {**FIRST, "content": ""}, {"type": "USER_INPUT"}, {**FIRST, "content": "<a href='x'>gone</b> short"}]
    said += [{**FIRST, "content": " \n<USER_REQUEST at='1'>hidden <i>words</i> stay when they are long </USER_REQUEST>\t"}]
    lines = spark.createDataFrame([("f", k, json.dumps(r)) for k, r in enumerate(said)] + [("f", 99, "broken"), ("f", 100, None)], tail_source.SCHEMA)
    got = [(r.position, r.source_id, r.content) for r in tails.transcript_rows(lines).orderBy("position").collect()]
    assert got == [(0, tails.USER_SOURCE, FIRST["content"]), (1, tails.MODEL_SOURCE, SECOND["content"]), (3, tails.MODEL_SOURCE, FIRST["content"]), (7, tails.USER_SOURCE, "stay when they are long </USER_REQUEST>")]


def test_transcripts_become_memories(spark, tmp_path):
    path = tmp_path / "in" / "transcript.jsonl"
    path.parent.mkdir()
    store, check = str(tmp_path / "store"), str(tmp_path / "check")

    def scan():
        tails.follow_transcripts(spark, str(path.parent), store, check, lambda: 1000).awaitTermination()
        return [r.content for r in spark.read.schema(tails.MEMORIES).parquet(f"{store}/memories").collect()]

    path.write_text(line(FIRST))
    assert [("TypeScript" in c) for c in scan()] == [True]
    first = sum(tail_source.positions(spark, check).values())
    assert first > 0 and len(scan()) == 1
    path.write_text(line(FIRST) + line(SECOND))
    got = scan()
    assert len(got) == 2 and any("TailwindCSS" in c for c in got)
    assert sum(tail_source.positions(spark, check).values()) > first
    path.write_text(line(FIRST) + line(SECOND) + line({**SECOND, "step_index": 2}))  # told before
    assert len(scan()) == 2
    sources = spark.read.parquet(f"{store}/provenance").collect()
    assert sorted(r.source_id for r in sources) == [tails.MODEL_SOURCE, tails.USER_SOURCE]
    assert {r.memory_id for r in sources} == {r.id for r in spark.read.parquet(f"{store}/memories").collect()} == {r.id for r in spark.read.parquet(f"{store}/vectors").collect()}


def test_later_rows_go_one_by_one(spark):
    rows = spark.range(8)
    pairs = [(0, 1), (1, 2), (2, 3), (4, 5), (4, 6), (5, 6), (3, 7), (6, 7)]
    stays: list[int] = []
    for k in range(8):
        if not any((e, k) in pairs for e in stays):
            stays.append(k)
    gone = {r.id for r in tails.later_ones(rows, spark.createDataFrame(pairs, "earlier bigint, later bigint")).collect()}
    assert gone == set(range(8)) - set(stays)


def test_many_files_share_partitions(tmp_path):
    for k in range(2500):
        (tmp_path / f"{k:04d}.transcript.jsonl").write_text(f"line {k}\nhalf")
    reader = tail_source.TailReader({"path": str(tmp_path), "split": "9000"})
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert len(parts) < 10 and all(sum(last - first for _, _, first, last in p.parts) <= 9000 for p in parts)
    got = [(b.column("file")[i].as_py(), b.column("line")[i].as_py()) for p in parts for b in reader.read(p) for i in range(b.num_rows)]
    assert sorted(got) == [(f"{tmp_path}/{k:04d}.transcript.jsonl", f"line {k}") for k in range(2500)]
    assert reader.partitions(end, end) == []
