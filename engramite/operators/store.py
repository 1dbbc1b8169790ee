"""Reads, statistics, ledgers and the life of memories. State changes return new DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.plans.numbers import numbered
from engramite.sources.model import DAY, NOW

# Identities of background writers, which earn no reputation and whose memories the first agent takes over.
INTERNAL_AGENTS = ("antigravity-worker", "user-dialogue")
CONTENT_CAP = 10_000
IDLE, EXPIRY = 7 * DAY, 14 * DAY


def active(memories: DataFrame) -> DataFrame:
    return memories.where(F.col("valid_until").isNull())


def visible(memories: DataFrame, namespace: str | None, listing: bool = False) -> DataFrame:
    """By id, None or 'all' shows everything; a listing or search takes None as 'shared'."""
    if namespace == "all" or (namespace is None and not listing):
        return memories
    return memories.where(F.col("namespace").isin(sorted({(namespace or "shared").lower(), "shared"})))


def latest_provenance(provenance: DataFrame) -> DataFrame:
    """The row with the largest id of each memory, by one pre-aggregated shuffle."""
    best = provenance.groupBy("memory_id").agg(F.max(F.struct("id", "source_type", "source_id", "created_at", "confidence")).alias("p"))
    return best.select("memory_id", "p.source_type", "p.source_id", "p.confidence", F.col("p.id").alias("provenance_id"))


def with_provenance(memories: DataFrame, provenance: DataFrame) -> DataFrame:
    return memories.join(latest_provenance(provenance), memories["id"] == F.col("memory_id"), "left").drop("memory_id")


def by_content(memories: DataFrame, wanted: DataFrame, namespace: str | None = None) -> DataFrame:
    """wanted(content): the smallest active id of each exact text."""
    hits = visible(active(memories), namespace).join(wanted.distinct(), "content")
    return hits.groupBy("content").agg(F.min("id").alias("id"))


def by_prefix(memories: DataFrame, prefix: str) -> DataFrame:
    return active(memories).where(F.lower("content").startswith(prefix.lower()))


def by_substring(memories: DataFrame, name: str) -> DataFrame:
    return active(memories).where(F.lower("content").contains(name.lower()))


def _limit(n: float) -> int:
    if not n > 0:
        raise ValueError("the limit must be positive")
    return int(n)


def recent(memories: DataFrame, n: float = 10, namespace: str | None = None) -> DataFrame:
    return visible(active(memories), namespace, True).orderBy(F.desc("created_at"), "id").limit(_limit(n))


def important(memories: DataFrame, n: float = 10, namespace: str | None = None) -> DataFrame:
    return visible(active(memories), namespace, True).orderBy(F.desc("importance_score"), "id").limit(_limit(n))


def newest_entities(entities: DataFrame, n: float = 50) -> DataFrame:
    return entities.orderBy(F.desc("created_at"), "id").limit(_limit(n))


def namespace_counts(memories: DataFrame) -> DataFrame:
    return active(memories).groupBy("namespace").agg(F.count("*").alias("count"))


def content_stats(memories: DataFrame) -> DataFrame:
    n = F.length("content")
    total = F.coalesce(F.sum(n), F.lit(0))
    return active(memories).agg(
        F.count("*").alias("count"), total.alias("total_chars"), F.round(F.coalesce(F.avg(n), F.lit(0.0))).cast("bigint").alias("avg_chars"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_chars"), F.coalesce(F.min(n), F.lit(0)).alias("min_chars"), F.ceil(total / 4).alias("estimated_tokens"),
    )


def namespace_content_stats(memories: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum(F.length("content")), F.lit(0))
    return active(memories).groupBy("namespace").agg(F.count("*").alias("count"), total.alias("total_chars"), F.ceil(total / 4).alias("estimated_tokens"))


def namespace_share(memories: DataFrame) -> DataFrame:
    """Share of all characters, null where there are none, and a bar of 1 to 20."""
    stats = namespace_content_stats(memories)
    share = F.try_divide(F.col("total_chars"), F.sum("total_chars").over(Window.partitionBy(F.lit(0))))  # one row for each namespace
    return stats.select("namespace", F.round(share * 100, 4).alias("percent"), F.greatest(F.round(share * 20), F.lit(1.0)).cast("bigint").alias("bar"))


def agent_stats(events: DataFrame) -> DataFrame:
    """Counters and reputation; ids are folded, internal agents are left out."""
    e = events.select(F.lower("agent_id").alias("agent_id"), "action").where(~F.col("agent_id").isin(*INTERNAL_AGENTS))
    n = {a: F.count(F.when(F.col("action") == a, 1)) for a in ("created", "confirmed", "contradicted")}
    return e.groupBy("agent_id").agg(*[c.alias(f"memories_{a}") for a, c in n.items()], ((n["confirmed"] + 1) / (n["contradicted"] + 1)).alias("reputation_score"))


def leaderboard(events: DataFrame) -> DataFrame:
    return agent_stats(events).orderBy(F.desc("reputation_score"), "agent_id")


def reputation_of(sources: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``reputation`` to rows with source_type and source_id: the agent's, else 1."""
    s = stats.select(F.col("agent_id").alias("__agent"), "reputation_score")
    joined = sources.join(s, (F.col("source_type") == "agent") & (F.col("source_id") == F.col("__agent")), "left")
    return joined.withColumn("reputation", F.coalesce("reputation_score", F.lit(1.0))).drop("__agent", "reputation_score")


def boosted(importance: Column, times: Column) -> Column:
    return F.round(F.least(importance + times * 0.1, F.lit(1.0)), 4)


def boost(memories: DataFrame, accesses: DataFrame, now: int = NOW) -> DataFrame:
    """accesses(id): one row per access. Importance rises by a tenth each, to 1 at most."""
    n = accesses.groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("__n"))
    m = memories.join(n, F.col("id") == F.col("__id"), "left")
    hit = F.col("__n").isNotNull()
    return m.withColumns(
        {
            "importance_score": F.when(hit, boosted(F.col("importance_score"), F.col("__n"))).otherwise(F.col("importance_score")),
            "access_count": F.col("access_count") + F.coalesce("__n", F.lit(0)),
            "last_accessed": F.when(hit, F.lit(now)).otherwise(F.col("last_accessed")),
        }
    ).drop("__id", "__n")


def decay(memories: DataFrame, now: int = NOW, ticks: int = 1) -> DataFrame:
    """Idle for over a week: a twentieth less each tick. Archived rows decay too."""
    x = F.col("importance_score")
    for _ in range(ticks):
        x = F.round(F.greatest(x * 0.95, F.lit(0.0)), 4)
    return memories.withColumn("importance_score", F.when(now - F.col("last_accessed") > IDLE, x).otherwise(F.col("importance_score")))


def expire(memories: DataFrame, now: int = NOW) -> DataFrame:
    """Notes and reminders end after two weeks."""
    due = F.col("valid_until").isNull() & F.col("content").rlike(r"(?i)^(?:reminder|note):") & (now - F.col("created_at") > EXPIRY)
    return memories.withColumn("valid_until", F.when(due, F.lit(now)).otherwise(F.col("valid_until")))


def clamp(importance: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), importance)), 4)


def namespace_for(shared: Column, agent: Column, project: Column) -> Column:
    return F.when(shared & project.isNull(), "shared").otherwise(F.coalesce(F.lower(agent), project, F.lit("shared")))


# Prefixes that already categorise a text.
CATEGORIES = "Note|Reminder|Rule|Decision|Preference|Stack|Architecture|Config|Warning|FYI"


def remembered(content: Column) -> Column:
    """A text without space around it, as a note if it is of no category."""
    text = F.regexp_replace(content, r"^\s+|\s+$", "")
    return F.when(text.rlike(f"(?i)^(?:{CATEGORIES}):"), text).otherwise(F.concat(F.lit("Note: "), text))


def new_versions(memories: DataFrame, updates: DataFrame, now: int = NOW) -> tuple[DataFrame, DataFrame]:
    """updates(old_id, new_id, content). Returns all memories, the old ones archived, the new with their importance and namespace, and the ledger. Of several
    updates of one memory the one of the greatest new id counts; null ids, and ids that are no active memory, change nothing; a null content stays null."""
    last = updates.where("new_id is not null").groupBy("old_id").agg(F.max_by(F.struct("new_id", F.col("content").alias("new_content")), F.struct("new_id", "content")).alias("u")).select("old_id", "u.*")
    old = active(memories).join(last, F.col("id") == F.col("old_id"))
    t = F.lit(now)
    new = old.select(F.col("new_id").alias("id"), F.col("new_content").alias("content"), "importance_score", t.alias("created_at"), t.alias("last_accessed"), F.lit(0).cast("bigint").alias("access_count"), t.alias("valid_from"), F.lit(None).cast("bigint").alias("valid_until"), t.alias("assertion_time"), "namespace", F.col("old_id").alias("parent_id"))
    archived = memories.join(old.select(F.col("old_id").alias("__old")).distinct(), F.col("id") == F.col("__old"), "left").withColumn("valid_until", F.when(F.col("__old").isNotNull() & F.col("valid_until").isNull(), t).otherwise(F.col("valid_until"))).drop("__old")
    ledger = old.select(F.col("old_id").alias("old_memory_id"), F.col("new_id").alias("new_memory_id"), t.alias("resolved_at"), F.lit("update_memory").alias("resolution_reason"))
    return archived.unionByName(new), ledger


def delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Takes memories, and what refers to them, out of each table given."""
    gone = ids.select(F.col("id").alias("__gone")).distinct()

    def without(df: DataFrame, condition) -> DataFrame:
        return df.join(gone, condition, "left_anti")

    rules = {
        "memories": lambda d: without(d, d["id"] == F.col("__gone")), "vectors": lambda d: without(d, d["id"] == F.col("__gone")), "provenance": lambda d: without(d, d["memory_id"] == F.col("__gone")),
        "contradictions": lambda d: without(without(d, d["old_memory_id"] == F.col("__gone")), d["new_memory_id"] == F.col("__gone")),
        "edges": lambda d: without(without(d, (d["source_type"] == "memory") & (d["source_id"] == F.col("__gone"))), (d["target_type"] == "memory") & (d["target_id"] == F.col("__gone"))),
    }
    return {name: rules[name](df) for name, df in tables.items()}


def add_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Names that are not there yet."""
    return new.dropDuplicates(["name"]).join(entities.select("name"), "name", "left_anti")


def entity_memories(entities: DataFrame, edges: DataFrame, memories: DataFrame) -> DataFrame:
    """(entity, memory id) over edges in both directions, for active memories."""
    out = edges.where("source_type = 'entity' and target_type = 'memory'").select(F.col("source_id").alias("e"), F.col("target_id").alias("m"))
    back = edges.where("source_type = 'memory' and target_type = 'entity'").select(F.col("target_id").alias("e"), F.col("source_id").alias("m"))
    pairs = out.union(back).distinct()
    return pairs.join(active(memories).select(F.col("id").alias("m")), "m").join(entities.select(F.col("id").alias("e"), "name"), "e").select(F.col("name").alias("entity"), F.col("m").alias("memory_id"))


def race_guard(facts: DataFrame, memories: DataFrame, now: int, newest: int = 20, seconds: int = 60) -> DataFrame:
    """facts(fact_id, fact): drops those of which over half of the words are in one of the newest shared memories, if it is of the last minute."""
    from engramite.functions.text import words

    fresh = active(memories).where("namespace = 'shared'").orderBy(F.desc("created_at"), F.desc("id")).limit(newest).where(now - F.col("created_at") <= seconds).select("content")
    near = facts.join(F.broadcast(fresh), F.size(F.array_intersect(words(F.col("fact")), words(F.col("content")))) > 0.5 * F.size(words(F.col("fact"))), "left_semi")
    return facts.join(near.select("fact_id"), "fact_id", "left_anti")


def by_substring_or_archived(memories: DataFrame, name: str, most: int = 5) -> DataFrame:
    """Active memories that hold a text; if there is none, the first archived ones that do."""
    held = memories.where(F.lower("content").contains(name.lower()))
    now = active(held)
    none = now.limit(1).select(F.lit(True).alias("__any"))
    before = held.where("valid_until is not null").orderBy("id").limit(most).join(F.broadcast(none), F.lit(True), "left_anti")
    return now.unionByName(before)


def read_and_boost(memories: DataFrame, provenance: DataFrame, wanted: DataFrame, now: int = NOW) -> tuple[DataFrame, DataFrame]:
    """wanted(id), a row for each read: the active memories that were read, with their latest provenance, and all memories after the boosts. Ids that
    are no active memory change nothing."""
    seen = wanted.join(active(memories).select("id"), "id", "left_semi")
    after = boost(memories, seen, now)
    return with_provenance(active(after).join(seen.distinct(), "id", "left_semi"), provenance), after


def latencies(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Of the values of each key, null ones left out: how many, the one in the middle and the one nine tenths up, both of the sorted list and not
    between two of it."""
    own = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v")).withColumn("row", F.monotonically_increasing_id())
    placed = numbered(own, ["k", "v", "row"], "place")
    sizes = placed.groupBy("k").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    wanted = sizes.select("k", "n", (F.col("first") + F.expr("n div 2")).alias("middle"), (F.col("first") + F.least(F.floor(F.col("n") * 0.9), F.col("n") - 1)).alias("up"))
    found = placed.join(wanted.withColumnRenamed("k", "__k"), F.col("k").eqNullSafe(F.col("__k"))).where(F.col("place").isin(F.col("middle"), F.col("up")))
    value_at = lambda c: F.max(F.when(F.col("place") == F.col(c), F.col("v")))
    return found.groupBy(F.col("k").alias(key), "n").agg(value_at("middle").alias("median"), value_at("up").alias("p90"))


def compression(raw: Column, packed: Column) -> Column:
    """By how many hundredths a text became shorter, to a tenth; null where there was none."""
    return F.round(100 - packed / F.nullif(raw, F.lit(0)) * 100, 1)
