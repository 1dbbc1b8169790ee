"""Streams: appended transcripts, task histories, counters of agents, job queues and event fan-out, with Spark's checkpoints as offsets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engramite.functions.embed import embedding
from engramite.operators.extraction import extract_facts
from engramite.operators.retrieval import knn, similarity, within
from engramite.operators.store import active
from engramite.plans.scratch import discard, materialize, shared_dir
from engramite.streaming import tail_source

TRANSCRIPT = "step_index int, source string, type string, content string"
LEAST_CHARS, DEDUP = 15, 0.80
# The identities under which facts of transcripts are stored.
MODEL_SOURCE, USER_SOURCE = "antigravity-worker", "user-dialogue"
MEMORIES = "id bigint, content string, importance_score double, created_at bigint, last_accessed bigint, access_count bigint, valid_from bigint, valid_until bigint, assertion_time bigint, namespace string, parent_id bigint"
VECTORS = "id bigint, embedding array<float>"


def transcript_rows(lines: DataFrame) -> DataFrame:
    """lines(file, position, line) of JSONL transcripts, batch or stream: (file, position, step_index, source_id, content) of what people and models said. Wrappers
    in tags are taken out, from an opening tag to the next closing one. Lines that do not parse, other records, records without content and short ones are left out."""
    rows = lines.select("file", "position", F.from_json("line", TRANSCRIPT).alias("r")).select("file", "position", "r.*")
    model = F.coalesce(F.col("source") == "MODEL", F.lit(False))
    said = model | F.coalesce(F.col("type").isin("USER_INPUT", "PLANNER_RESPONSE"), F.lit(False))
    text = F.regexp_replace(F.regexp_replace("content", r"<[^>]+>[\s\S]*?</[^>]+>", ""), r"^\s+|\s+$", "")
    rows = rows.where(said & (F.col("content") != ""))
    rows = rows.select("file", "position", "step_index", F.when(model, MODEL_SOURCE).otherwise(USER_SOURCE).alias("source_id"), text.alias("content"))
    return rows.where(F.length("content") >= LEAST_CHARS)


def transcript_tail(spark: SparkSession, folder: str, suffix: str = "transcript.jsonl", depth: int = 3) -> DataFrame:
    """A stream of transcript_rows over transcripts that grow."""
    return transcript_rows(tail_source.lines(spark, folder, suffix, depth))


def new_facts(rows: DataFrame, memories: DataFrame, vectors: DataFrame, threshold: float = DEDUP, embed: Callable[[Column], Column] = embedding) -> DataFrame:
    """rows of transcript_rows: (file, position, source_id, content, confidence, embedding) of the facts that they tell and the store does not hold. A text that
    is an active shared memory is known, and so is one as similar as ``threshold`` to the nearest of them. Facts of the batch meet each other too, in the order of files, lines
    and facts: one that equals or is as similar to an earlier new one is left out. No rows give none; what a row tells twice is told once."""
    shared = active(memories).where("namespace = 'shared'")
    keyed = rows.withColumn("id", F.xxhash64("file", "position"))
    facts = extract_facts(keyed.select("id", "content"), "content").select("id", F.col("position").alias("part"), F.col("content").alias("fact"), "confidence")
    facts = keyed.select("id", "file", "position", "source_id").join(facts, "id").drop("id")
    facts = facts.join(shared.select(F.col("content").alias("fact")), "fact", "left_anti")
    place = F.struct("file", "position", "part")
    facts = facts.groupBy("fact").agg(F.min_by(F.struct("file", "position", "part", "source_id", "confidence"), place).alias("f")).select("fact", "f.*")
    facts = materialize(facts.withColumn("id", F.xxhash64("fact")).withColumn("embedding", embed(F.col("fact"))), "facts")
    own = vectors.join(shared.select("id"), "id", "left_semi")
    asked = facts.select(F.col("id").alias("query_id"), "embedding")
    held = knn(own, asked, 1).where(F.round(similarity(F.col("distance")), 4) >= threshold).select(F.col("query_id").alias("id"))
    open_ = materialize(facts.join(held, "id", "left_anti"), "open")
    near = similar_pairs(open_.select("id", "file", "position", "part", "embedding"), threshold)
    kept = materialize(open_.join(later_ones(open_.select("id"), near), "id", "left_anti").select("file", "position", "part", "source_id", F.col("fact").alias("content"), "confidence", "embedding"), "new")
    discard(facts)
    discard(open_)
    return kept


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(earlier, later) ids of rows(id, file, position, part, embedding) that are as similar as threshold, by file, position and part."""
    place = rows.select("id", F.struct("file", "position", "part").alias("place"))
    reach = float((2 * (1 - threshold + 1e-4)) ** 0.5)  # similarities are rounded to four places
    met = within(rows, rows.select(F.col("id").alias("query_id"), "embedding"), reach).where("id <> query_id").where(F.round(similarity(F.col("distance")), 4) >= threshold)
    a, b = place.select(F.col("id").alias("query_id"), F.col("place").alias("own")), place.select("id", F.col("place").alias("other"))
    return met.join(a, "query_id").join(b, "id").where("other < own").select(F.col("id").alias("earlier"), F.col("query_id").alias("later"))


def later_ones(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ids that an earlier kept row displaces, as if the rows came one by one: a row goes if an earlier similar one stays. Rounds: what has no earlier open
    neighbour stays, and its later neighbours go."""
    pairs, gone = materialize(pairs, "pairs"), rows.where("false")
    while not pairs.isEmpty():
        stays = pairs.select(F.col("earlier").alias("id")).distinct().join(pairs.select(F.col("later").alias("id")), "id", "left_anti")
        out = materialize(pairs.join(stays.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("id")).distinct(), "displaced")
        gone = gone.unionByName(out)
        left = pairs.join(stays.withColumnRenamed("id", "earlier"), "earlier", "left_anti")
        for side in ("earlier", "later"):
            left = left.join(out.withColumnRenamed("id", side), side, "left_anti")
        before, pairs = pairs, materialize(left.select("earlier", "later"), "pairs")
        discard(before)
    return gone


def follow_transcripts(spark: SparkSession, folder: str, store: str, checkpoint: str, now: Callable[[], int], load: Callable[[], tuple[DataFrame, DataFrame]] | None = None, suffix: str = "transcript.jsonl", depth: int = 3, **trigger) -> StreamingQuery:
    """Watches a folder of transcripts and keeps what they tell in ``store``: folders memories, vectors and provenance, one part for each batch, which a batch that
    comes again writes anew. load(): (memories, vectors) that the store has besides. Without a trigger it reads what is there now and ends."""

    def held(name: str, schema: str, number: int) -> DataFrame:
        path = f"{store}/{name}"
        if not _exists(spark, path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(f"{schema}, batch bigint").parquet(path).where(F.col("batch") != number).drop("batch")

    def batch(rows: DataFrame, number: int) -> None:
        memories, vectors = held("memories", MEMORIES, number), held("vectors", VECTORS, number)
        if load is not None:
            more = load()
            memories = memories.unionByName(more[0].select(*memories.columns))
            vectors = vectors.unionByName(more[1].select(*vectors.columns))
        t, none = F.lit(now()).cast("bigint"), F.lit(None).cast("bigint")
        # ids that stay the same when a batch comes again
        new = new_facts(rows, memories, vectors).withColumn("id", F.abs(F.xxhash64("file", "position", "part")))
        tables = {
            "memories": new.select("id", "content", F.col("confidence").alias("importance_score"), t.alias("created_at"), t.alias("last_accessed"), F.lit(0).cast("bigint").alias("access_count"), t.alias("valid_from"), none.alias("valid_until"), t.alias("assertion_time"), F.lit("shared").alias("namespace"), none.alias("parent_id")),
            "vectors": new.select("id", "embedding"),
            "provenance": new.select(F.col("id").alias("memory_id"), F.lit("agent").alias("source_type"), "source_id", t.alias("created_at"), "confidence"),
        }
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")
        discard(new)

    sink = transcript_tail(spark, folder, suffix, depth).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return sink.trigger(**(trigger or {"availableNow": True})).start()


def debounced(changes: DataFrame, quiet: str = "300 milliseconds", late: str | None = None) -> DataFrame:
    """changes(path, ts): (path, changed_from, due, changes), one row for each burst of changes of a path, due when the path has been quiet for so long. late: how much
    later than others a change may come; one that comes later still is left out, and a burst is told once no change can join it. Without it, and in a batch, all are told. Null paths and times make no burst."""
    changes = changes.where("path is not null and ts is not null")
    changes = changes.withWatermark("ts", late) if late is not None else changes
    bursts = changes.groupBy(F.session_window("ts", quiet).alias("burst"), "path").agg(F.count("*").alias("changes"))
    return bursts.select("path", F.col("burst.start").alias("changed_from"), F.col("burst.end").alias("due"), "changes")


def on_changes(bursts: DataFrame, react: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Hands the files whose bursts ended to react, a batch at a time: one row for each path, however many of its bursts ended."""

    def batch(df: DataFrame, number: int) -> None:
        react(df.groupBy("path").agg(F.max("due").alias("due"), F.sum("changes").alias("changes")), number)

    return bursts.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def agent_counters(events: DataFrame) -> DataFrame:
    """Counters per agent over a stream of (agent_id, action); update mode."""
    n = {a: F.count(F.when(F.col("action") == a, 1)) for a in ("created", "confirmed", "contradicted")}
    return events.groupBy(F.lower("agent_id").alias("agent_id")).agg(*[c.alias(a) for a, c in n.items()])


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives now, as a table in the shared folder: appended rows, or the last state of all groups. Nothing is held in the driver."""
    spark = stream.sparkSession
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    sink = stream.writeStream.option("checkpointLocation", f"{top}/offsets").trigger(availableNow=True)
    if mode == "append":
        query = sink.outputMode("append").format("parquet").option("path", f"{top}/rows").start()
    else:
        # each batch holds all groups and takes the place of the one before
        query = sink.outputMode(mode).foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{top}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/rows") if _exists(spark, f"{top}/rows") else spark.createDataFrame([], stream.schema)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return bool(fs.exists(p))


def table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What batches wrote below a folder, or no rows if none did."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


HISTORY = "history array<struct<role: string, content: string>>"


def new_messages(spark: SparkSession, folder: str, positions: DataFrame | None = None, pattern: str = "*.json", within: str = "") -> tuple[DataFrame, DataFrame]:
    """Task histories, each a whole JSON file that is written anew: (file, position, role, content) of the messages beyond each file's saved
    position, and the positions (file, last_position) to save. positions: those saved before. Files that do not parse yet, and those whose path lacks
    ``within``, are left for another time; so are other roles than user and assistant and messages without text."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", HISTORY)["history"].alias("history")).where(F.col("history").isNotNull() & F.col("file").contains(within))
    saved = positions if positions is not None else spark.createDataFrame([], "file string, last_position bigint")
    files = files.join(saved, "file", "left").select("file", "history", F.coalesce("last_position", F.lit(0)).alias("last_position"))
    rows = files.select("file", "last_position", F.posexplode("history").alias("position", "m")).where("position >= last_position")
    rows = rows.where("m.role in ('user', 'assistant') and trim(m.content) <> ''").select("file", "position", F.col("m.role").alias("role"), F.col("m.content").alias("content"))
    after = files.select("file", F.greatest(F.size("history").cast("bigint"), "last_position").alias("last_position"))
    return rows, after.unionByName(saved.join(files.select("file"), "file", "left_anti"))


JOB = "text string, session_id string, agent_id string, namespace string, cwd string, queued_at string, _retries int"
MAX_JOBS, MAX_JOB_AGE, TRIES = 50, 7 * 86400, 3


def read_queue(spark: SparkSession, folder: str, now: int, most: int = MAX_JOBS) -> DataFrame:
    """The files of a queue of jobs: (file, name, state, and the fields of a job), state pending, waiting, corrupt or expired. Names begin with the
    time of queueing, so the first ``most`` that parse and are no week old are pending; hidden files are none of the queue."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.unix_timestamp(F.col("_metadata.file_modification_time").cast("timestamp")).alias("changed"), F.from_json("value", JOB).alias("job"))
    state = F.when(F.lit(now) - F.col("changed") > MAX_JOB_AGE, "expired").when(F.col("job.text").isNull(), "corrupt").otherwise("pending")
    rows = rows.where(~F.col("name").startswith(".")).select("file", "name", state.alias("state"), "job.*")
    first = rows.where("state = 'pending'").orderBy("name").limit(most).select("name", F.lit(True).alias("__first"))
    taken = F.when((F.col("state") == "pending") & F.col("__first").isNull(), "waiting").otherwise(F.col("state"))
    return rows.join(F.broadcast(first), "name", "left").withColumn("state", taken).drop("__first").select("file", "name", "state", "text", "session_id", "agent_id", "namespace", "cwd", "queued_at", F.coalesce("_retries", F.lit(0)).alias("retries"))


def work_queue(spark: SparkSession, folder: str, failed: str, now: int, work: Callable[[DataFrame], None], most: int = MAX_JOBS, tries: int = TRIES) -> dict[str, int]:
    """One run over a queue: expired files go, corrupt ones move to ``failed``, each pending job is handed to work by itself, at least once, and goes
    when that succeeds; one that fails stays with one more try on its count, and moves to ``failed`` after the last. At most ``most`` jobs, so
    the loop is bounded. Returns how many were done, retried, failed, corrupt and expired."""
    rows = read_queue(spark, folder, now, most).where("state <> 'waiting'").orderBy("name").collect()
    counts = dict.fromkeys(("done", "retried", "failed", "corrupt", "expired"), 0)

    def away(row) -> None:
        p, fs = _hadoop(spark, row.file)
        target, _ = _hadoop(spark, failed)
        fs.mkdirs(target)
        fs.rename(p, _hadoop(spark, f"{failed}/{row.name}")[0])

    def gone(row) -> None:
        p, fs = _hadoop(spark, row.file)
        fs.delete(p, False)

    for row in rows:
        if row.state != "pending":
            (gone if row.state == "expired" else away)(row)
            counts[row.state] += 1
            continue
        job = spark.createDataFrame([row], "file string, name string, state string, text string, session_id string, agent_id string, namespace string, cwd string, queued_at string, retries int")
        try:
            work(job)
        except Exception:
            if row.retries + 1 >= tries:
                away(row)
                counts["failed"] += 1
            else:
                again = {"text": row.text, "session_id": row.session_id, "agent_id": row.agent_id, "namespace": row.namespace, "cwd": row.cwd, "queued_at": row.queued_at, "_retries": row.retries + 1}
                _write(spark, row.file, json.dumps(again))
                counts["retried"] += 1
            continue
        gone(row)
        counts["done"] += 1
    return counts


def enqueue(spark: SparkSession, folder: str, name: str, text: str, queued_at: str, **meta: str) -> None:
    """Writes one job file."""
    _write(spark, f"{folder}/{name}.json", json.dumps({"text": text, "session_id": None, "agent_id": None, "namespace": "shared", "cwd": None, **meta, "queued_at": queued_at, "_retries": 0}))


def _write(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def event_payload(tool: Column, query: Column, ids: Column, agent: Column, namespace: Column, token_budget: Column | None = None) -> Column:
    """What is told of a retrieval, as JSON: tool, query, count, agent, namespace, ids, and a budget where there is one."""
    fields = [tool.alias("tool"), query.alias("query"), F.size(ids).alias("count"), F.coalesce(agent, F.lit("unknown")).alias("agent_id"), F.coalesce(namespace, F.lit("shared")).alias("namespace"), ids.alias("memory_ids")]
    return F.to_json(F.struct(*fields, *([] if token_budget is None else [token_budget.alias("token_budget")])))


EVENTS = ("memory_added", "memory_deleted", "memory_updated", "memory_retrieved", "memories_consolidated")


def event_counts(events: DataFrame) -> DataFrame:
    """events(event, ...): how often each kind of event occurred, other names left out; batch or stream."""
    return events.where(F.col("event").isin(*EVENTS)).groupBy("event").agg(F.count("*").alias("count"))


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Hands each batch of events to every sink. A batch is read once; a sink that fails fails the batch, which comes again after a restart, so
    sinks take a batch by its number."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            for sink in sinks.values():
                sink(df, number)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def every(spark: SparkSession, seconds: int, job: Callable[[int], None], checkpoint: str) -> StreamingQuery:
    """Runs job(run number) every so many seconds until the query is stopped: the sweeps of decay, expiry and consolidation."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda df, number: job(number)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def run_jobs(jobs: DataFrame, work: Callable[[DataFrame], None], dead_letter: str, checkpoint: str, tries: int = 3) -> StreamingQuery:
    """Hands each batch of queued jobs to work, at least once; after so many failures the batch goes to the dead letter folder. Jobs with an ``id``
    column count once in a batch."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.dropDuplicates(["id"]) if "id" in df.columns else df
        for attempt in range(tries):
            try:
                work(df)
                return
            except Exception:
                if attempt + 1 == tries:
                    df.write.mode("append").json(dead_letter)

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_only(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """First rows of each content within the watermark; stream(ts, content)."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["content"])
