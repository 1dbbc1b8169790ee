"""The engine by the names of its tools, for one caller at a time: each call reads the tables, and one that writes puts new tables in their place.

Answers are dictionaries of plain values, bounded by the limits that callers give; a refusal is a dictionary with an error. Whole tables and many
queries at once are the business of the operators, which every tool is made of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.functions.embed import embedding
from engramite.operators import audit, context, curation, extraction, history, retrieval, store, write
from engramite.plans.scratch import materialize
from engramite.sources import files, model

CHAIN, ENTRY = "audit", "entry bigint, content string, importance double, agent_id string, shared boolean"
EVENTS = "agent_id string, action string"
KEPT = f"{model.ATTESTATIONS}, chain string"


@dataclass
class Tables:
    memories: DataFrame
    vectors: DataFrame
    provenance: DataFrame
    events: DataFrame
    entities: DataFrame
    edges: DataFrame
    contradictions: DataFrame
    attestations: DataFrame


def empty(spark: SparkSession) -> Tables:
    schemas = model.MEMORIES, model.VECTORS, model.PROVENANCE, EVENTS, model.ENTITIES, model.EDGES, model.CONTRADICTIONS, KEPT
    return Tables(*(spark.createDataFrame([], s) for s in schemas))


@dataclass
class Engine:
    spark: SparkSession
    clock: Callable[[], int]
    keys: audit.Keys
    project: str | None = None
    embed: Callable[[Column], Column] = embedding
    tables: Tables = field(default=None)

    def __post_init__(self):
        self.tables = self.tables or empty(self.spark)

    def call(self, tool_name: str, /, **given) -> dict:
        """Runs a tool by its name; unknown names and refused arguments are errors, not exceptions."""
        tool = TOOLS.get(tool_name)
        if tool is None:
            return {"error": f"Unknown tool: {tool_name}"}
        try:
            return tool(self, **given)
        except (TypeError, ValueError) as e:
            return {"error": str(e)}

    def _put(self, **changed: DataFrame) -> None:
        for name, df in changed.items():
            now = getattr(self.tables, name)
            setattr(self.tables, name, materialize(model.migrate(df, ", ".join(f"{n} {t}" for n, t in now.dtypes)).select(*now.columns), name))

    def _seen(self, i: int, agent: str | None) -> dict | None:
        row = store.visible(store.active(self.tables.memories), agent).where(F.col("id") == int(i)).first()
        return row.asDict() if row else None

    def _hits(self, query: str, limit: float, agent: str | None) -> list[dict]:
        t = self.tables
        row = self.spark.createDataFrame([(0, query, float(limit), agent)], "entry bigint, query string, limit double, agent_id string")
        found = retrieval.batch_search(t.memories, t.vectors, t.provenance, t.events, row.withColumn("embedding", self.embed(F.col("query"))))
        return [r.asDict() for r in found.join(t.memories.select("id", "content"), "id").orderBy("rank").collect()]

    def _attest(self, query: str, items: list[dict], agent: str | None, session: str | None) -> str:
        t, now = self.tables, self.clock()
        last = t.attestations.orderBy(F.desc("id")).limit(1).collect()
        i = last[0].id + 1 if last else 1
        shown = self.spark.createDataFrame([(0, k, x["id"], x["content"], float(x["score"])) for k, x in enumerate(items)], "q int, rank int, id bigint, content string, score double")
        stamp = F.date_format(F.timestamp_seconds(F.lit(now)), "yyyy-MM-dd'T'HH:mm:ss.000'Z'")
        record = audit.retrieved(shown, "q").select(F.lit(CHAIN).alias("chain"), F.lit(i).cast("bigint").alias("id"), F.lit(query).alias("query"), stamp.alias("timestamp"), "memories_retrieved", F.lit(agent).cast("string").alias("agent_id"), F.lit(session).cast("string").alias("session_id"))
        record = record.withColumn("attestation_id", audit.attestation_id(F.col("chain"), F.col("id"), F.col("query"), F.lit(now)))
        made = audit.attest(record, self.keys, {CHAIN: last[0].hash} if last else None)
        self._put(attestations=t.attestations.unionByName(made.select(*t.attestations.columns)))
        return self.tables.attestations.where(F.col("id") == i).first().attestation_id

    def _shown(self, ids: list[int]) -> None:
        self._put(memories=store.boost(self.tables.memories, self.spark.createDataFrame([(i,) for i in ids], "id bigint"), self.clock()))

    # --- tools

    def add_memory(self, content: str, importance: float = 1.0, agent_id: str | None = None, session_id: str | None = None, shared: bool = True) -> dict:
        t = self.tables
        row = self.spark.createDataFrame([(0, content, float(importance), agent_id, bool(shared))], ENTRY)
        done = write.add_memories(t.memories, t.vectors, t.provenance, t.events, row, self.clock(), self.project, self.embed)
        said = done.results.first()
        if said.error:
            return {"error": said.error}
        found = [r.asDict() for r in done.contradictions.collect()]
        ledger = t.contradictions.unionByName(done.contradictions.withColumn("id", F.lit(None).cast("bigint")))
        self._put(memories=done.memories, vectors=done.vectors, provenance=done.provenance, events=done.events, contradictions=ledger)
        return {"success": True, "id": said.id, "namespace": said.namespace, "outcome": said.outcome, "contradictions_detected": found}

    def search_memories(self, query: str, limit: float = 5, agent_id: str | None = None, session_id: str | None = None) -> dict:
        if not limit > 0:
            raise ValueError("the limit must be positive")
        hits = self._hits(query, limit, agent_id)
        if hits:
            self._shown([h["id"] for h in hits])
            return {"results": hits, "count": len(hits), "namespace": (agent_id or "shared").lower(), "attestation_id": self._attest(query, hits, agent_id, session_id)}
        return {"results": [], "count": 0, "namespace": (agent_id or "shared").lower()}

    def get_memory(self, id: int, agent_id: str | None = None) -> dict:
        if self._seen(id, agent_id) is None:
            return {"error": f"Memory #{id} not found"}
        self._shown([int(id)])
        return {"memory": store.with_provenance(self.tables.memories.where(F.col("id") == int(id)), self.tables.provenance).first().asDict()}

    def update_memory(self, id: int, content: str, agent_id: str | None = None) -> dict:
        old, t, now = self._seen(id, agent_id), self.tables, self.clock()
        if old is None:
            return {"error": f"Memory #{id} not found"}
        row = write.prepared(self.spark.createDataFrame([(0, content, 1.0, agent_id, True)], ENTRY)).first()
        if row.error:
            return {"error": row.error}
        new = t.memories.agg(F.max("id")).first()[0] + 1
        change = self.spark.createDataFrame([(int(id), new, row.content)], "old_id bigint, new_id bigint, content string")
        memories, ledger = store.new_versions(t.memories, change, now)
        source = self.spark.createDataFrame([((t.provenance.agg(F.max("id")).first()[0] or 0) + 1, new, "agent" if agent_id else "manual", agent_id and agent_id.lower(), now, 1.0)], model.PROVENANCE)
        vector = change.select(F.col("new_id").alias("id"), self.embed(F.col("content")).alias("embedding"))
        self._put(memories=memories, vectors=t.vectors.unionByName(vector), provenance=t.provenance.unionByName(source), contradictions=t.contradictions.unionByName(ledger.withColumn("id", F.lit(None).cast("bigint"))))
        return {"success": True, "old_id": int(id), "new_id": new}

    def delete_memory(self, id: int, agent_id: str | None = None) -> dict:
        if self._seen(id, agent_id) is None:
            return {"error": f"Memory #{id} not found"}
        names = ("memories", "vectors", "provenance", "contradictions", "edges")
        self._put(**store.delete({n: getattr(self.tables, n) for n in names}, self.spark.createDataFrame([(int(id),)], "id bigint")))
        return {"success": True, "id": int(id)}

    def _listed(self, rows: DataFrame) -> dict:
        found = [r.asDict() for r in rows.collect()]
        return {"memories": found, "count": len(found)}

    def get_recent_memories(self, limit: float = 10, agent_id: str | None = None) -> dict:
        return self._listed(store.recent(self.tables.memories, limit, agent_id))

    def get_important_memories(self, limit: float = 10, agent_id: str | None = None) -> dict:
        return self._listed(store.important(self.tables.memories, limit, agent_id))

    def ingest_git_commits(self, repo_path: str, count: int = 20) -> dict:
        t = self.tables
        commits = files.commit_log(self.spark, repo_path, count)
        made = {k: materialize(v, "commits") for k, v in files.ingest_commits(commits, t.memories, t.entities, self.clock(), self.project or "shared").items()}
        vectors = made["memories"].select("id", self.embed(F.col("content")).alias("embedding"))
        next_id = (t.provenance.agg(F.max("id")).first()[0] or 0) + 1
        sources = made["provenance"].withColumns({"id": F.col("memory_id") + next_id, "created_at": F.lit(self.clock()).cast("bigint")})
        added = made["memories"].count()
        edges = made["edges"].withColumn("id", F.lit(None).cast("bigint"))
        self._put(memories=t.memories.unionByName(made["memories"]), vectors=t.vectors.unionByName(vectors), provenance=t.provenance.unionByName(sources), entities=t.entities.unionByName(made["entities"]), edges=t.edges.unionByName(edges))
        return {"success": True, "added": added, "skipped": commits.count() - added}

    def add_entity(self, name: str, type: str = "concept") -> dict:
        t = self.tables
        new = self.spark.createDataFrame([((t.entities.agg(F.max("id")).first()[0] or 0) + 1, name, type, self.clock())], model.ENTITIES)
        self._put(entities=t.entities.unionByName(store.add_entities(t.entities, new).select(*t.entities.columns)))
        return {"success": True, "id": self.tables.entities.where(F.col("name") == name).first().id}

    def link_entity_memory(self, entity_name: str, memory_id: int, relation: str = "mentions", agent_id: str | None = None) -> dict:
        t = self.tables
        asked = self.spark.createDataFrame([(0, entity_name, int(memory_id), relation, agent_id)], "entry bigint, entity_name string, memory_id bigint, relation string, agent_id string")
        edges, results = write.link(t.entities, t.memories, asked, self.clock())
        if error := results.first().error:
            return {"error": error}
        self._put(edges=t.edges.unionByName(edges.withColumn("id", F.lit(None).cast("bigint"))))
        return {"success": True, "entity": entity_name, "memory_id": int(memory_id), "relation": relation}

    def search_by_entity(self, entity_name: str) -> dict:
        t = self.tables
        entity = t.entities.where(F.col("name") == entity_name)
        if not entity.limit(1).count():
            return {"error": f'Entity "{entity_name}" not found'}
        ids = store.entity_memories(entity, t.edges, t.memories).select(F.col("memory_id").alias("id"))
        return self._listed(t.memories.join(ids, "id", "left_semi").orderBy("id"))

    def get_memory_history(self, query: str) -> dict:
        t = self.tables
        hits = history.history_hits(t.memories, self.spark.createDataFrame([(0, str(query))], "query_id bigint, query string"))
        rows = history.memory_history(t.memories, t.provenance, t.contradictions, hits).orderBy("chain", "position").collect()
        chains: dict[int, list[dict]] = {}
        for r in rows:
            chains.setdefault(r.chain, []).append(r.asDict())
        return {"query": query, "histories": chains}

    def get_agent_stats(self) -> dict:
        return {"agents": [r.asDict() for r in store.leaderboard(self.tables.events).collect()]}

    def _verified(self) -> DataFrame:
        return audit.verify_records(self.tables.attestations, self.keys.raw()[1])

    def export_audit_log(self, start_date: str | None = None, end_date: str | None = None) -> dict:
        rows = audit.in_range(self.tables.attestations, start_date, end_date).collect()
        return {"attestations": [r.asDict(True) for r in rows], "count": len(rows)}

    def verify_attestation(self, attestation_id: str) -> dict:
        row = self._verified().where(F.col("attestation_id") == attestation_id).first()
        if row is None:
            return {"valid": False, "error": f"Attestation not found: {attestation_id}"}
        return {"valid": row.error is None, **({"error": row.error} if row.error else {})}

    def get_optimized_context(self, query: str, max_tokens: int = 4000, agent_id: str | None = None, session_id: str | None = None, intent: str | None = None) -> dict:
        t = self.tables
        hits = self._hits(query, 5, agent_id)
        asked = self.spark.createDataFrame([(0, query, intent)], "query_id bigint, query string, intent string")
        scored = self.spark.createDataFrame([(0, h["id"], h["score"]) for h in hits], "query_id bigint, id bigint, score double")
        found = materialize(context.context_candidates(t.memories, t.provenance, t.events, t.entities, t.edges, asked, scored, self.clock(), agent_id), "found")
        row = context.optimized_context(asked, found, t.memories, max_tokens).first().asDict()
        if row["memories"]:
            by = {r.id: r.asDict() for r in found.join(t.memories.select("id", "content"), "id").where(F.col("id").isin(row["memories"])).collect()}
            row["attestation_id"] = self._attest(query, [by[i] for i in row["memories"]], agent_id, session_id)
        return row

    def consolidate_memories(self) -> dict:
        t, now = self.tables, self.clock()
        m = store.reputation_of(store.with_provenance(store.active(t.memories), t.provenance), store.agent_stats(t.events))
        m = m.select("id", "content", (F.coalesce("confidence", F.lit(1.0)) * F.col("reputation")).alias("trust"), F.col("importance_score").alias("importance"))
        gone = curation.consolidate(m, curation.similarity_join(t.vectors))
        archived = gone.select(F.col("archived_id").alias("__id")).distinct()
        memories = t.memories.join(archived, F.col("id") == F.col("__id"), "left").withColumn("valid_until", F.when(F.col("__id").isNotNull(), F.lit(now).cast("bigint")).otherwise(F.col("valid_until"))).drop("__id")
        ledger = gone.select(F.lit(None).cast("bigint").alias("id"), F.col("archived_id").alias("old_memory_id"), F.col("canonical_id").alias("new_memory_id"), F.lit(now).cast("bigint").alias("resolved_at"), F.col("reason").alias("resolution_reason"))
        n = gone.count()
        self._put(memories=memories, contradictions=t.contradictions.unionByName(ledger))
        return {"success": True, "archived": n}

    def extract_facts(self, text: str) -> dict:
        """Facts of a text, stored where no memory has them; not a tool of its own but what transcripts and queues are worked by."""
        t = self.tables
        facts = extraction.extract_facts(self.spark.createDataFrame([(0, text)], "id bigint, text string"))
        rows, sources, told = write.store_facts(facts, t.memories, t.memories.agg(F.max("id")).first()[0] or 0, self.clock())
        rows = materialize(rows, "facts")
        next_id = (t.provenance.agg(F.max("id")).first()[0] or 0) + 1
        vectors = rows.select("id", self.embed(F.col("content")).alias("embedding"))
        self._put(memories=t.memories.unionByName(rows), vectors=t.vectors.unionByName(vectors), provenance=t.provenance.unionByName(sources.withColumn("id", F.col("memory_id") + next_id)))
        return {"facts": told.count(), "stored": rows.count()}


_NAMES = (
    "add_memory search_memories get_memory update_memory delete_memory get_recent_memories get_important_memories ingest_git_commits add_entity link_entity_memory search_by_entity "
    "get_memory_history get_agent_stats export_audit_log verify_attestation get_optimized_context consolidate_memories"
).split()
TOOLS = {name: getattr(Engine, name) for name in _NAMES} | {"get_file_history": lambda engine, file_path: engine.search_by_entity(file_path), "watch_git_repo": lambda engine, repo_path: engine.ingest_git_commits(repo_path)}
