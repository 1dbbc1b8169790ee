"""The engine's tables, and the mapping of the generated tables to them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Schemas as DDL.
MEMORIES = "id bigint, content string, importance_score double, created_at bigint, last_accessed bigint, access_count bigint, valid_from bigint, valid_until bigint, assertion_time bigint, namespace string, parent_id bigint"
PROVENANCE = "id bigint, memory_id bigint, source_type string, source_id string, created_at bigint, confidence double"
CONTRADICTIONS = "id bigint, old_memory_id bigint, new_memory_id bigint, resolved_at bigint, resolution_reason string"
ENTITIES = "id bigint, name string, type string, created_at bigint"
EDGES = "id bigint, source_id bigint, target_id bigint, relation string, source_type string, target_type string, created_at bigint"
VECTORS = "id bigint, embedding array<float>"
ATTESTATIONS = "id bigint, attestation_id string, query string, timestamp string, memories_retrieved array<struct<id: bigint, content_hash: string, score: bigint>>, agent_id string, session_id string, signature string, previous_hash string, hash string"

#: Every time-dependent operator takes the time as a parameter; this is the one of the registered queries (2024-02-01).
NOW = 1706745600
DAY = 86400


@dataclass
class Store:
    memories: DataFrame
    vectors: DataFrame
    provenance: DataFrame
    agent_events: DataFrame
    entities: DataFrame
    edges: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    d = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    created = F.lit(1704067200) + F.col("doc_id") * 3600
    return d.select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.round((F.col("doc_id") % 100) / 100, 4).alias("importance_score"), created.alias("created_at"),
        (created + (F.col("doc_id") % 30) * DAY).alias("last_accessed"), (F.col("doc_id") % 7).alias("access_count"), created.alias("valid_from"),
        F.when(F.col("toxic") == 1, created + DAY).alias("valid_until"), created.alias("assertion_time"), F.when(F.col("source") == "src0", "shared").otherwise(F.col("source")).alias("namespace"),
        F.when((F.col("doc_id") % 10).isin(1, 2), F.col("doc_id") - 1).alias("parent_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'contradicted' END")
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Agent-"), "user_id").alias("agent_id"), kind.alias("action"), "ts")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "documents").count()
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("event_id") % max(n, 1)).alias("memory_id"), F.when(F.col("event_type") != "view", "agent").otherwise("manual").alias("source_type"),
        F.lower(F.concat(F.lit("Agent-"), "user_id")).alias("source_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" #", "p_name", "p_partkey").alias("name"), F.lit("concept").alias("type"), (F.lit(1704067200) + F.col("p_partkey") * 60).alias("created_at"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_orderkey").alias("target_id"), F.lit("touches").alias("relation"), F.lit("entity").alias("source_type"), F.lit("memory").alias("target_type")).distinct()


def load(spark: SparkSession, sf_dir: str) -> Store:
    return Store(memories(spark, sf_dir), vectors(spark, sf_dir), provenance(spark, sf_dir), agent_events(spark, sf_dir), entities(spark, sf_dir), edges(spark, sf_dir))


def load_store(spark: SparkSession, path: str) -> Store:
    """A store as ``save_store`` wrote it."""
    return Store(*(spark.read.parquet(f"{path}/{t}") for t in Store.__dataclass_fields__))


def save_store(store: Store, path: str) -> None:
    """Memories are partitioned by namespace, so reads of one namespace prune the others."""
    for t in Store.__dataclass_fields__:
        df = getattr(store, t)
        (df.write.partitionBy("namespace") if t == "memories" else df.write).mode("overwrite").parquet(f"{path}/{t}")


def migrate(table: DataFrame, schema: str) -> DataFrame:
    """A table of an older schema in the columns of another: what is missing is null, types are cast, further columns stay at the end."""
    wanted = [x.strip().split(" ", 1) for x in re.split(r",(?![^<]*>)", schema)]
    have = {c.lower(): c for c in table.columns}
    cols = [(F.col(have[n.lower()]) if n.lower() in have else F.lit(None)).cast(t).alias(n) for n, t in wanted]
    return table.select(*cols, *[c for c in table.columns if c.lower() not in {n.lower() for n, _ in wanted}])
