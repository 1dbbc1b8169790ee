"""Versions of memories by a query: the chains of what it finds, each version with its provenance and its difference to the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramite.operators.curation import version_diffs
from engramite.operators.graph import history_components, implied_edges
from engramite.operators.retrieval import bm25
from engramite.operators.store import latest_provenance
from engramite.plans.scratch import materialize

FOUND = 5


def history_hits(memories: DataFrame, queries: DataFrame, most: int = FOUND) -> DataFrame:
    """queries(query_id, query): (query_id, id, how). A whole number that is an id finds that memory; anything else the best texts that hold all of
    its words, archived ones too; if there is none, the first texts that hold it as it stands, in either case. Empty and null queries, and those
    that nothing matches, find nothing."""
    q = queries.where("trim(query) <> ''").select("query_id", "query")
    ids = memories.select("id").distinct()
    number = F.expr("try_cast(trim(query) as bigint)")
    by_id = q.select("query_id", number.alias("id")).join(ids, "id").select("query_id", "id", F.lit("id").alias("how"))
    rest = materialize(q.join(by_id.select("query_id"), "query_id", "left_anti"), "rest")
    texts = memories.select("id", "content")
    by_words = materialize(bm25(texts, rest, most).select("query_id", "id", F.lit("words").alias("how")), "words")
    plain = rest.join(by_words.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lower("query").alias("low"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    held = implied_edges(texts, plain.select(F.col("query_id").alias("id"), F.col("low").alias("name"))).select(F.col("entity_id").alias("query_id"), F.col("memory_id").alias("id"))
    by_part = held.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "id", F.lit("part").alias("how"))
    return by_id.unionByName(by_words).unionByName(by_part)


def memory_history(memories: DataFrame, provenance: DataFrame, contradictions: DataFrame | None, hits: DataFrame) -> DataFrame:
    """hits(query_id, id): (query_id, chain, position, id, source_type, source_id, confidence, archived, diff) of all versions of each chain that a
    query finds, each chain once, from the oldest. A memory without provenance is a manual one at full confidence."""
    chains = materialize(history_components(memories, contradictions), "chains")
    wanted = hits.join(chains, "id").select("query_id", "chain").distinct()
    versions = memories.select("id", "content", "created_at", "valid_until").join(chains, "id").join(wanted.select("chain").distinct(), "chain", "left_semi")
    versions = materialize(versions, "versions")
    diffs = version_diffs(versions.select("chain", "id", "created_at", "content")).select("id", "diff")
    position = F.row_number().over(Window.partitionBy("chain").orderBy("created_at", "id"))
    told = versions.withColumn("position", position).join(diffs, "id").join(latest_provenance(provenance), F.col("id") == F.col("memory_id"), "left")
    return wanted.join(told, "chain").select(
        "query_id", "chain", "position", "id", F.coalesce("source_type", F.lit("manual")).alias("source_type"), F.when(F.col("source_type") == "agent", F.lower("source_id")).otherwise(F.col("source_id")).alias("source_id"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.col("valid_until").isNotNull().alias("archived"), "diff",
    )
