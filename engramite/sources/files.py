"""JSONL export and import, commit logs, tracked events and lists for prompts."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.functions.text import commit_importance
from engramite.operators.store import active, visible
from engramite.plans.numbers import numbered
from engramite.plans.scratch import materialize


def export_rows(memories: DataFrame, provenance: DataFrame, namespace: str | None = None, everything: bool = False) -> DataFrame:
    """One row per memory and provenance row, the provenance nested."""
    m = visible(memories if everything else active(memories), namespace)
    p = provenance.select("memory_id", F.struct("source_type", "source_id", "confidence").alias("provenance"))
    return m.join(p, m["id"] == p["memory_id"], "left").drop("memory_id")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an export: (line, content, importance_score, namespace, valid_until, bad), bad holds a line that does not parse; blank lines are
    left out. line orders lines as the files hold them."""
    schema = "content string, importance_score double, namespace string, valid_until bigint, bad string"
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value").where("trim(value) <> ''")
    return rows.select("line", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}).alias("r")).select("line", "r.*")


def read_jsonl(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Lines that parse and hold an active, non-blank memory that is not known yet; ids and times are not kept. write.import_memories tells what
    becomes of each line, near copies among them."""
    rows = read_records(spark, path).where("bad is null and valid_until is null and trim(content) <> ''").select("content", "importance_score", "namespace").dropDuplicates(["content"])
    return rows if known is None else rows.join(known.select("content").distinct(), "content", "left_anti")


_FIELD, _END = "\x1f", "\x1e"


def commit_log(spark: SparkSession, repository: str, count: int = 20) -> DataFrame:
    """(hash, author, date, subject, body, notes, files) of the newest commits. The log is read on the driver, which has the repository; it is
    bounded by count."""
    form = _FIELD.join(("%H", "%an", "%aI", "%s", "%b", "%N")) + _FIELD
    out = subprocess.run(["git", "-C", repository, "log", f"-{int(count)}", "--name-only", f"--format={_END}{form}"], capture_output=True, text=True, check=True).stdout
    rows = []
    for part in out.split(_END)[1:]:
        h, author, date, subject, body, notes, files = part.split(_FIELD)
        rows.append((h, author, date, subject, " ".join(body.split()), " ".join(notes.split()), [f for f in files.strip().split("\n") if f]))
    return spark.createDataFrame(rows, "hash string, author string, date string, subject string, body string, notes string, files array<string>")


def commit_memories(commits: DataFrame, memories: DataFrame | None = None) -> DataFrame:
    """Commits as memories; those whose short hash opens an active memory are left out."""
    short, bare = F.substring("hash", 1, 7), lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.concat(F.lit("["), short, F.lit("] Commit: "), "subject", F.lit(" — by "), "author", F.lit(" on "), F.substring("date", 1, 10), F.when(bare("body") != "", F.concat(F.lit(". "), "body")).otherwise(""), F.when(bare("notes") != "", F.concat(F.lit(" [PR Notes] "), "notes")).otherwise(""))
    rows = commits.select("hash", text.alias("content"), commit_importance(F.col("subject")).alias("importance_score"), F.lit("git").alias("source_type"), F.col("hash").alias("source_id"), F.lit(0.8).alias("confidence"), "author", "files")
    if memories is None:
        return rows
    known = active(memories).select(F.regexp_extract("content", r"^(\[[0-9a-f]{7}\])", 1).alias("tag")).where("tag <> ''").distinct()
    return rows.withColumn("tag", F.substring("content", 1, 9)).join(known, "tag", "left_anti").drop("tag")


def ingest_commits(commits: DataFrame, memories: DataFrame, entities: DataFrame, now: int, namespace: str = "shared") -> dict[str, DataFrame]:
    """commits(hash, author, subject, body, notes, date, files): the new rows of memories, provenance, entities and edges. Commits that are known, and
    repeated rows of one, are left out; authors and files become entities where no entity has their name, linked by authored and
    touches. Ids follow the largest ones there are."""
    base_m, base_e = ((t.agg(F.max("id")).first()[0] or 0) for t in (memories, entities))
    rows = commit_memories(commits.dropDuplicates(["hash"]), memories)
    rows = materialize(numbered(rows.drop("id"), ["hash"], "id", base_m + 1), "commits")
    t, none = F.lit(now).cast("bigint"), F.lit(None).cast("bigint")
    fresh = rows.select("id", "content", "importance_score", t.alias("created_at"), t.alias("last_accessed"), F.lit(0).cast("bigint").alias("access_count"), t.alias("valid_from"), none.alias("valid_until"), t.alias("assertion_time"), F.lit(namespace).alias("namespace"), none.alias("parent_id"))
    authors = rows.select(F.col("id").alias("memory"), F.col("author").alias("name"), F.lit("person").alias("type"), F.lit("authored").alias("relation"))
    touched = rows.select(F.col("id").alias("memory"), F.explode(F.array_distinct("files")).alias("name"), F.lit("file").alias("type"), F.lit("touches").alias("relation"))
    told = authors.unionByName(touched).where("name <> ''")
    known = entities.groupBy("name").agg(F.min("id").alias("known"))
    added = told.groupBy("name").agg(F.max("type").alias("type")).join(known, "name", "left_anti")  # an author who is a file's name too is a person
    added = materialize(numbered(added, ["name"], "id", base_e + 1).select("id", "name", "type", t.alias("created_at")), "entities")
    ids = known.withColumnRenamed("known", "source_id").unionByName(added.select("name", F.col("id").alias("source_id")))
    edges = told.join(ids, "name").select("source_id", F.col("memory").alias("target_id"), "relation", F.lit("entity").alias("source_type"), F.lit("memory").alias("target_type"), t.alias("created_at"))
    return {"memories": fresh, "provenance": rows.select(F.col("id").alias("memory_id"), "source_type", "source_id", "confidence"), "entities": added, "edges": edges}


def tracked_content(content: Column, event: Column, workflow: Column, metadata: Column) -> Column:
    """What a tracked event is stored as: its content, or its name, workflow and metadata (a map of texts) in one line; null without either."""
    line = F.concat(F.lit("Event: "), event, F.coalesce(F.concat(F.lit(" in workflow: "), workflow), F.lit("")), F.coalesce(F.concat(F.lit(". Metadata: "), F.to_json(metadata)), F.lit("")))
    return F.when(F.coalesce(content, F.lit("")) != "", content).when(F.coalesce(event, F.lit("")) != "", line)


def prompt_lines(hits: DataFrame, prompts: DataFrame, head: str, foot: str, numbered: bool = False, least: int = 15) -> DataFrame:
    """hits(query_id, rank, id, content), prompts(query_id, prompt): (query_id, query, text), the memories found for a prompt as a list to put before
    it; query is what was searched for, 200 characters of the prompt. Short prompts, and those for which nothing was found, get nothing."""
    item = F.concat(F.lit("• "), F.concat(F.lit("[Memory #"), F.col("id").cast("string"), F.lit("] ")) if numbered else F.lit(""), F.coalesce("content", F.lit("")))
    listed = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]).alias("items"))
    p = prompts.where(F.length(F.trim("prompt")) >= least).select("query_id", F.substring("prompt", 1, 200).alias("query"))
    return p.join(listed, "query_id").select("query_id", "query", F.concat_ws("\n", F.lit(head), "items", F.lit(foot)).alias("text"))
