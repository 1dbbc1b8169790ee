"""Keyword and vector retrieval, merged, weighted and re-ranked, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.functions.text import tokens
from engramite.operators import querylang
from engramite.operators.store import agent_stats, latest_provenance, reputation_of
from engramite.plans.scratch import materialize
from engramite.plans.ship import ship_package

K1, B = 1.2, 0.75
KEYWORD_BONUS, GATE, MMR_LAMBDA, TOO_NEAR = 0.2, 0.30, 0.7, 0.80
#: Vectors of a block, the least of one, and of a tile of the product of two; bytes of pairs of blocks that are handed to Python at once.
BLOCK, LEAST_BLOCK, TILE, PAIRS = 4096, 256, 1024, 1 << 26
DENSE = 1 << 14  # pairs of a tile from which one product of all of them costs less
_ALL = 1 << 40


def document_frequency(texts: DataFrame) -> DataFrame:
    return spread(texts.select("content")).select(F.explode(tokens(F.col("content"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the files hold fewer pieces than there are cores; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows


def keyword_and_match(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id): texts that queries(query_id, query) match, in the language of querylang. Null and empty texts, and null, blank and malformed
    queries, match nothing."""
    return querylang.matched(spread(texts.select("id", "content")), materialize(querylang.parsed(queries), "asked"))


def bm25(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best texts that each query matches, in the language of querylang: (query_id, id, score, rank). The score sums over the query's words and phrases that a text
    holds, each once. Archived texts count as any other. Null and empty texts match nothing but count; null, blank and malformed queries find nothing. One pass over the
    texts finds the leaves that each holds and counts texts, words, and texts of each leaf; matches are judged and scored from these, and of each task only the k best of a query are
    shuffled, so no row is made for each text that matches. Queries of one text are scored once; of texts of one id the best counts."""
    asked = materialize(querylang.parsed(queries), "asked")
    held, blocks = querylang.counted(spread(texts.select("id", "content")), asked)
    held = materialize(held, "held")
    n = held.where("leaf = -1").agg(F.sum("df").alias("n"), F.sum("doc_len").alias("words")).first()
    df = held.where("leaf >= 0").groupBy("leaf").agg(F.sum("df").alias("df"))
    idf = df.select("leaf", F.log(1 + (F.lit(n.n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"))
    average = float((n.words or 0) / (n.n or 1) or 1.0)
    found = querylang.best(held.where("leaves is not null"), blocks, idf, k, _bm25_part, average, asked.schema["ids"].dataType.elementType)
    scored = found.groupBy("query_id", "id").agg(F.round(F.max("score"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select(F.col("ids")[0].alias("query_id"), F.explode("ids").alias("own")), "query_id").select(F.col("own").alias("query_id"), "id", "score", "rank")


def _bm25_part(idf: np.ndarray, tf: np.ndarray, size: np.ndarray, average: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))


def knn(vectors: DataFrame, queries: DataFrame, k: int, earlier: bool = False, above: float = -1.0) -> DataFrame:
    """Exact neighbours by distance: (query_id, id, distance, rank). vectors(id, embedding), queries(query_id, embedding).
    With earlier, a query meets only ids up to its own, as when it was stored. Of the k nearest, those that are less similar than ``above`` may be missing.

    Both sides are packed into blocks of at most BLOCK vectors, written once; each block of queries meets each of vectors by a join of the two tables that
    reads them again instead of shuffling copies. The queries of a block are held, the vectors stream by, and each query keeps its k best; so a task holds a
    few blocks, nothing goes through the driver, and what is merged in the end is at most k rows for each query and part of the vectors. Null ids, null vectors and
    vectors with a null element meet nothing; vectors meet queries of their own length only; no queries or no vectors give no rows; rows that repeat are found as
    often as they occur, for a query that repeats its neighbours are ranked together."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    reach = np.inf if above < 0 else float(np.sqrt(2 * max(1 - above, 0))) + 1e-5  # distances and similarities have six places
    return _met(vectors, queries, k, earlier, reach).withColumn("rank", rank).where(F.col("rank") <= k)


def within(vectors: DataFrame, queries: DataFrame, reach: float) -> DataFrame:
    """(query_id, id, distance) of all that are no further apart than reach; blocks and defined cases are those of knn."""
    return _met(vectors, queries, _ALL, False, reach)


def _packed(rows: DataFrame, name: str, ordered: bool) -> DataFrame:
    """rows(id, embedding) as a table of blocks: (dim, least, most, ids, data), numbers as they lie in memory."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    single = rows.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind, size = (np.float32 if single else np.float64), BLOCK
    rows = rows.where("id is not null and embedding is not null and not exists(embedding, x -> x is null)")
    rows = rows.select(F.col("id").cast("bigint").alias("id"), "embedding" if single else F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    blocks = max(-(-n // BLOCK), min(parts, -(-n // LEAST_BLOCK)), 1)
    rows = rows.repartitionByRange(blocks, "id") if ordered else rows.repartition(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "least": pa.array([ids.min()], pa.int64()), "most": pa.array([ids.max()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([x.tobytes()], pa.binary())})

        for batch in batches:
            ids, lists = batch.column("id").to_numpy(), batch.column("embedding")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
            dims = np.diff(at)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = flat[at[own][:, None] + np.arange(dim)]
                for first in range(0, len(own), size):
                    some = held.setdefault(dim, [])
                    some.append((ids[own[first : first + size]], x[first : first + size]))
                    if sum(len(i) for i, _ in some) >= size:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return materialize(rows.mapInArrow(run, "dim int, least bigint, most bigint, ids binary, data binary"), name)


def _met(vectors: DataFrame, queries: DataFrame, k: int, earlier: bool, reach: float = np.inf) -> DataFrame:
    """The k nearest to each query within reach, of each part of the vectors."""
    spark = vectors.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PAIRS))  # a row is two blocks
    q = _packed(queries.select(F.col("query_id").alias("id"), "embedding"), "queries", earlier)
    v = _packed(vectors.select("id", "embedding"), "vectors", earlier)
    q, v = q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns]), v.select(*[F.col(c).alias(f"v_{c}") for c in v.columns])
    meet = F.abs(F.col("q_dim") - F.col("v_dim")) < 1  # no equality, which would shuffle all blocks to one key
    pairs = q.join(v, meet & (F.col("v_least") <= F.col("q_most")) if earlier else meet).select("q_dim", "q_ids", "q_data", "v_ids", "v_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
            ids = np.frombuffer(ids, np.int64)
            kind = np.float64 if len(data) == 8 * dim * len(ids) else np.float32
            return ids, np.frombuffer(data, kind).astype(np.float64).reshape(len(ids), dim)

        held, cell = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                dim, q_ids, q_data, v_ids, v_data = (batch.column(c)[row].as_py() for c in range(5))
                if held != (q_ids, q_data):
                    if cell is not None:
                        yield cell.best()
                    held, cell = (q_ids, q_data), _Cell(k, earlier, reach)
                    cell.add(False, *block(q_ids, q_data, dim))
                cell.add(True, *block(v_ids, v_data, dim))
        if cell is not None:
            yield cell.best()

    return pairs.mapInArrow(run, "query_id bigint, id bigint, distance double")


def _wider(x: np.ndarray, last: np.ndarray, kind: type) -> np.ndarray:
    """Vectors with one more number, in the precision given."""
    out = np.empty((x.shape[0], x.shape[1] + 1), kind)
    out[:, :-1], out[:, -1] = x, last
    return out


class _Cell:
    """Queries of one block, and the k nearest to each of the vectors that were added; equally near ones by id.

    Products are made in single precision first, with a bound of their error; only pairs that may be near by it are worked out in double precision, so what
    is found is as if all were. Vectors too long for single precision go in double from the start."""

    def __init__(self, k: int, earlier: bool, reach: float = np.inf):
        self.k, self.earlier, self.reach = k, earlier, reach
        self.ids, self.rows = [], []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, vectors: bool, ids: np.ndarray, x: np.ndarray) -> None:
        if not vectors:
            self.ids.append(ids)
            self.rows.append(x)
            return
        if not self.ids:
            return
        if len(self.ids) > 1 or not self.held:
            self.ids, self.rows = [np.concatenate(self.ids)], [np.concatenate(self.rows)]
        if not self.held:
            self.square = (self.rows[0] ** 2).sum(1)
            self.limit = np.full(len(self.ids[0]), self.reach)
            self.rough = {}
        square = (x * x).sum(1)
        longest = np.fmax.reduce(np.concatenate([self.square, square]), initial=0.0)
        kind = np.float32 if longest < 1e30 else np.float64
        if kind not in self.rough:
            self.rough[kind] = _wider(self.rows[0], np.ones(len(self.rows[0])), kind)
        rough = _wider(x, square / -2, kind)
        error = (x.shape[1] + 8) * 2.0**-23 * longest * 1.5 + 1e-30  # of a product and half a square, sums and what is cut off the numbers
        for at in range(0, len(ids), TILE):
            for first in range(0, len(self.ids[0]), TILE):
                tile = slice(at, at + TILE)
                self._tile(slice(first, first + TILE), ids[tile], x[tile], square[tile], self.rough[kind][first : first + TILE] @ rough[tile].T, error, float(np.sqrt(longest)))

    def _tile(self, some: slice, ids: np.ndarray, x: np.ndarray, square: np.ndarray, rough: np.ndarray, error: float, longest: float) -> None:
        """rough: products less half the squares of x, which fall as distances grow."""
        least = (self.square[some] - (self.limit[some] + 1e-6) ** 2) / 2 - error
        near = rough >= least.astype(rough.dtype)[:, None]
        own = self.ids[0][some]
        if self.earlier and ids.max() > own.min():
            near &= ids[None, :] <= own[:, None]
        if len(ids) > self.k and np.count_nonzero(near) > 2 * self.k * len(own):
            told = np.where(near, rough, -np.inf)
            kth = np.partition(told, len(ids) - self.k, axis=1)[:, len(ids) - self.k].astype(np.float64)
            near &= rough >= (kth - 2 * error - 4e-6 * longest).astype(rough.dtype)[:, None]  # distances that are equal to six places
        at, col = np.divmod(np.flatnonzero(near), len(ids))
        if len(at) > DENSE:
            dot = (self.rows[0][some] @ x.T)[at, col]
        else:
            m = self.rows[0][some]
            dot = np.concatenate([np.einsum("ij,ij->i", m[at[i : i + TILE]], x[col[i : i + TILE]]) for i in range(0, len(at), TILE)] or [np.empty(0)])
        at = at + some.start
        d = np.round(np.sqrt(np.maximum(self.square[at] + square[col] - 2 * dot, 0)), 6)
        keep = (d <= self.limit[at]) & (d < np.inf)
        self.found.append((at[keep], d[keep], ids[col[keep]]))
        self.held += int(keep.sum()) + 1
        if self.held > 4 * TILE * self.k:
            self._cut()

    def _cut(self) -> None:
        row, d, ids = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((ids, d, row))
        row, d, ids = row[order], d[order], ids[order]
        start = np.searchsorted(row, np.arange(len(self.limit)))
        keep = np.arange(len(row)) - start[row] < self.k
        self.found, self.held = [(row[keep], d[keep], ids[keep])], int(keep.sum()) + 1
        full = np.flatnonzero(np.bincount(row[keep], minlength=len(self.limit)) == self.k)
        self.limit[full] = d[start[full] + self.k - 1]

    def best(self) -> pa.RecordBatch:
        if self.found:
            self._cut()
            row, d, ids = self.found[0]
            return pa.RecordBatch.from_arrays([pa.array(self.ids[0][row], pa.int64()), pa.array(ids, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "id", "distance"])
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "id", "distance"])


def similarity(distance):
    """Cosine of unit vectors from their distance."""
    return F.greatest(F.lit(0.0), 1 - distance * distance / 2)


def hybrid_merge(near: DataFrame, keyword: DataFrame) -> DataFrame:
    """near(query_id, id, distance), keyword(query_id, id): similarity, keyword flag and score of every candidate that passes the gate."""
    a = near.select("query_id", "id", F.round(similarity(F.col("distance")), 6).alias("similarity"))
    both = a.join(keyword.select("query_id", "id", F.lit(True).alias("keyword_match")), ["query_id", "id"], "full")
    both = both.select("query_id", "id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("keyword_match", F.lit(False)).alias("keyword_match"))
    both = both.where(F.col("keyword_match") | (F.col("similarity") >= GATE))
    return both.withColumn("hybrid_score", F.col("similarity") + F.when(F.col("keyword_match"), KEYWORD_BONUS).otherwise(0.0))


def hybrid_search(memories: DataFrame, vectors: DataFrame, provenance: DataFrame, events: DataFrame, queries: DataFrame, limit: int = 5, namespace: str | None = None, mmr: bool = False, filter_first: bool = False) -> DataFrame:
    """queries(query_id, query, embedding). The batch form of hybrid search: 2 * limit candidates of either kind are merged, filtered,
    weighted by the reputation of their source and cut to the best. With filter_first, hidden rows take no candidate's place. A query without
    words, or without a vector, has candidates of the other kind only; no queries give no rows."""
    m = memories.select("id", "content", "valid_until", "namespace")
    ok = F.col("valid_until").isNull() & (F.lit(True) if namespace == "all" else F.col("namespace").isin(sorted({(namespace or "shared").lower(), "shared"})))
    pool, vecs = (m.where(ok), vectors.join(m.where(ok).select("id"), "id", "left_semi")) if filter_first else (m, vectors)
    words = bm25(pool.select("id", "content"), queries, 2 * limit).select("query_id", "id")
    merged = hybrid_merge(knn(vecs, queries, 2 * limit), words)
    shown = weighted(merged.join(m.where(ok), "id"), provenance, events)
    if mmr:
        return rerank(shown, limit)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return shown.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "id", rounded(F.col("similarity"), 4).alias("similarity"), "keyword_match", "reputation", "score", "warning")


def rounded(x: Column, places: int) -> Column:
    """The nearest number of so many places to the double itself; F.round takes its shortest decimal form, which may lie on a half where the double does not."""
    return F.round(x * 10**places) / 10**places


def weighted(rows: DataFrame, provenance: DataFrame, events: DataFrame) -> DataFrame:
    """Adds the latest source, its reputation, the score that it weighs, and a warning where it is low."""
    known = rows.join(latest_provenance(provenance).withColumnRenamed("memory_id", "id"), "id", "left")
    known = reputation_of(known, agent_stats(events)).withColumn("score", rounded(F.col("hybrid_score") * F.col("reputation"), 4))
    return known.withColumn("warning", F.col("reputation") < 0.5)


def batch_search(memories: DataFrame, vectors: DataFrame, provenance: DataFrame, events: DataFrame, entries: DataFrame, limit: int = 5, most: int = 50) -> DataFrame:
    """entries(entry, query, embedding, limit, agent_id), at most ``most``: (query, rank, id, similarity, keyword_match, reputation, score, warning). An
    entry with an agent sees what that agent sees, another one what is shared; its own limit goes before the common one. Of entries with one query the
    last counts; entries without a query, and those with a limit that is no positive number, find nothing; no entries give no rows."""
    if entries.limit(most + 1).count() > most:
        raise ValueError(f"a batch has at most {most} queries")
    e = entries.where("query <> ''").groupBy("query").agg(F.max_by(F.struct("embedding", F.coalesce("limit", F.lit(limit)).alias("limit"), F.lower("agent_id").alias("agent")), "entry").alias("e"))
    e = e.select(F.xxhash64("query").alias("query_id"), "query", "e.*").where("limit > 0")
    widest = e.agg(F.max("limit")).first()[0] or 1
    own = e.select("query_id", "query", F.floor("limit").alias("limit"), "agent")
    near = knn(vectors, e.select("query_id", "embedding"), 2 * int(widest)).join(own.select("query_id", "limit"), "query_id").where("rank <= 2 * limit").select("query_id", "id", "distance")
    words = bm25(memories.select("id", "content"), e.select("query_id", "query"), 2 * int(widest)).join(own.select("query_id", "limit"), "query_id").where("rank <= 2 * limit").select("query_id", "id")
    rows = hybrid_merge(near, words).join(own, "query_id").join(memories.where("valid_until is null").select("id", "namespace"), "id")
    rows = rows.where((F.col("namespace") == "shared") | (F.col("namespace") == F.col("agent")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    shown = weighted(rows, provenance, events).withColumn("rank", rank).where("rank <= limit")
    return shown.select("query", "rank", "id", rounded(F.col("similarity"), 4).alias("similarity"), "keyword_match", "reputation", "score", "warning")


def mmr_order(scores: list[float], contents: list[str], limit: int, weight: float = MMR_LAMBDA) -> list[int]:
    """Positions in the order of maximal marginal relevance; candidates come sorted by score. No more than the limit: as they are."""
    if len(scores) <= limit:
        return list(range(len(scores)))
    sets = [set((c or "").lower().split()) if c else set() for c in contents]
    chosen, left, worst = [0], list(range(1, len(scores))), [0.0] * len(scores)
    while len(chosen) < limit and left:
        last = sets[chosen[-1]]
        for i in left:
            union = len(sets[i] | last)
            worst[i] = max(worst[i], len(sets[i] & last) / union if union and sets[i] and last else 0.0)
        best = max(left, key=lambda i: (weight * scores[i] - (1 - weight) * worst[i], -i))
        chosen.append(best)
        left.remove(best)
    return chosen


def rerank(shown: DataFrame, limit: int) -> DataFrame:
    """At most 4 * limit candidates of a query meet in one group."""
    ship_package(shown.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        rows = rows.loc[mmr_order(rows["score"].tolist(), rows["content"].tolist(), limit)].head(limit)
        return rows.assign(rank=np.arange(1, len(rows) + 1))[["query_id", "rank", "id", "similarity", "keyword_match", "reputation", "score", "warning"]]

    cols = ["query_id", "id", "content", rounded(F.col("similarity"), 4).alias("similarity"), "keyword_match", "reputation", "score", "warning"]
    return shown.select(*cols).groupBy("query_id").applyInPandas(run, "query_id bigint, rank int, id bigint, similarity double, keyword_match boolean, reputation double, score double, warning boolean")


def semantic_gate(best: DataFrame, threshold: float = TOO_NEAR) -> DataFrame:
    """best(query_id, distance, rank): queries whose nearest text is too near to be stored again."""
    return best.where((F.col("rank") == 1) & (F.round(similarity(F.col("distance")), 6) >= threshold)).select("query_id")
