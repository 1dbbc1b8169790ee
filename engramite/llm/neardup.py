"""Near duplicates: MinHash signatures under a multi-index Hamming join, confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Its signature is SYMBOLS
b-bit symbols (the low b bits of as many minima), split into CHUNKS. Two signatures that differ in at most DISTANCE
symbols have, by pigeonhole, a chunk with at most DISTANCE // CHUNKS differing symbols; so each chunk enters the index once
for each way to leave out that many symbols, and every such pair shares an index key. (With the defaults that is
15 of 32; at a similarity of 0.75 a pair shares a key with probability 0.99998, above it with more.)

Nothing emits all pairs of a key. Exact copies first shrink to one document. The smallest document of a key is its hub; the
documents of all keys with one hub form a group. A group is dealt to blocks of bounded size; each block is compared on full
sets with the hub and within itself, one row per document. Where a hub leaves documents of a group of several blocks unlinked, as
documents with a passage in common do, the documents of all such groups get exact keys instead: with shingles ordered from the rare to the
frequent, two sets of that similarity share one of the first ``n - ceil(0.75 n) + 1`` of either, whatever the order. These keys are compared by
hubs in the same way, and a passage in common is no key any more, so rows stay in proportion to documents; only what a hub leaves
again, in a group of several blocks, meets the other blocks of its group. A task emits only links that join what was apart.
Components then follow from the links by joins.

Defined cases: documents without words, and null texts, have empty sets and are linked with nothing; fewer than
``width`` words make one shingle; vertices are document ids, so rows that repeat an id are one document, and its component holds what any of
its texts is linked to; a null id is linked with nothing, its component is null and it is kept; empty tables give empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramite.llm.common import bound_batches, discard, doc_id, map_batches, materialize
from engramite.plans.components import connected_components

WIDTH, BITS, CHUNKS, CHUNK = 5, 16, 8, 4
SYMBOLS = CHUNKS * CHUNK
DISTANCE = 2 * CHUNKS - 1
BLOCK_SHINGLES, BLOCK_DOCS = 200_000, 256
#: Shingles that are told apart by how frequent they are; the others go by their hash. Any order is exact, this one is short of keys.
RANKED = 50_000
_PIECE = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64, as many as the longest word needs."""

    def __init__(self):
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            factor = np.uint64(pow(_BASE, len(self.table), 1 << 64))
            self.table = np.concatenate((self.table, self.table * factor))
        return self.table


_POWERS = _Powers()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased bytes, and where each starts."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    at = np.flatnonzero(inside)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    powers = _POWERS.upto(int(lengths.max()))
    return _mix(np.add.reduceat(_BYTE[raw[at]] * powers[at - np.repeat(starts, lengths)], first)), starts


def pieces_of(data: bytes) -> Iterator[bytes]:
    """Cuts a long text at white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def _shingles_of(words: np.ndarray, width: int) -> np.ndarray:
    if len(words) < width:
        h = np.array([len(words)], np.uint64)
        for k in range(len(words)):
            h = _mix(h) + words[k : k + 1]
        return _mix(h, 0x5EED)
    n = len(words) - width + 1
    h = words[:n].copy()
    for k in range(1, width):
        h = _mix(h) + words[k : k + n]
    return _mix(h, 0x5EED + width)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text; empty without words."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    batch: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal batch, size
        if not batch:
            return
        words, starts = word_hashes(b"\n".join(d for _, d in batch))
        bounds = np.cumsum([0, *(len(d) + 1 for _, d in batch)])
        cut = np.searchsorted(starts, bounds)
        for k, (i, _) in enumerate(batch):
            if cut[k + 1] > cut[k]:
                out[i] = _distinct(_shingles_of(words[cut[k] : cut[k + 1]], width))
        batch, size = [], 0

    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode().lower()
        if len(data) > _PIECE:
            words = np.concatenate([word_hashes(p)[0] for p in pieces_of(data)])
            if len(words):
                out[i] = _distinct(_shingles_of(words, width))
            continue
        batch.append((i, data))
        size += len(data)
        if size > _PIECE:
            flush()
    flush()
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SYMBOLS) symbols of b bits; the sets are not empty."""
    flat = np.concatenate(sets)
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), SYMBOLS), np.uint64)
    for k in range(SYMBOLS):
        h = flat * _MULTIPLY[k] + _ADD[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = np.minimum.reduceat(h, first)
    return out & np.uint64((1 << BITS) - 1)


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """(sets, CHUNKS * CHUNK) keys: for each chunk and each symbol left out of it, the others, with where they stand."""
    keys = []
    for m in range(CHUNKS):
        for leave in range(CHUNK):
            key = np.full(len(symbols), m * CHUNK + leave, np.uint64)
            for j in range(CHUNK):
                if j != leave:
                    key = (key << np.uint64(BITS)) | symbols[:, m * CHUNK + j]
            keys.append(key)
    return np.column_stack(keys).view(np.int64)


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate(sets)
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    return np.add.reduceat(_mix(flat, 0xA5A5), first).view(np.int64), np.add.reduceat(_mix(flat, 0x5A5A5A), first).view(np.int64)


def sign(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, size of the set, its fingerprint and its index keys (none for an empty set)."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            a, b = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            keys: list = [[]] * len(sets)
            if full:
                some = [sets[i] for i in full]
                a[full], b[full] = _fingerprints(some)
                for i, row in zip(full, index_keys(signatures(some)), strict=True):
                    keys[i] = row
            return {"doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "set_a": pa.array(a), "set_b": pa.array(b), "keys": pa.array(keys, pa.list_(pa.int64()))}

        return work

    return map_batches(documents.select(doc_id(documents).alias("doc_id"), documents["text"]), make, "doc_id bigint, n bigint, set_a bigint, set_b bigint, keys array<bigint>")


def _full_sets(documents: DataFrame, width: int) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            return {"doc": batch.column("doc_id"), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())}

        return work

    return map_batches(documents, make, "doc bigint, shingles binary")


def _intersection(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def link_group(ids: list[int], blocks: list[int], sets: list[np.ndarray], percent: int, same_block: bool) -> list[tuple[int, int]]:
    """Links of a group that join what no earlier link of it joins. Block -1 is the hub; it is compared with all, others
    within their block or, unless same_block, with the other block."""
    order = sorted(range(len(ids)), key=lambda i: (blocks[i] >= 0, ids[i], len(sets[i])))
    ids, blocks, sets = [ids[i] for i in order], np.array([blocks[i] for i in order]), [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    if len(ids) == 2:
        both = _intersection(*sets) if ids[0] != ids[1] else 0
        return [(ids[0], ids[1])] if ids[0] != ids[1] and 100 * both >= percent * (size.sum() - both) else []
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate(([0], np.cumsum(size)))
    seen, label, key = np.zeros(int(codes.max()) + 1, np.int32), np.arange(len(ids)), np.array(ids)
    for i in range(1, len(ids)):  # rows that repeat an id are one vertex
        if ids[i] == ids[i - 1]:
            label[label == label[i]] = label[i - 1]
    links = []
    for x in range(len(ids) - 1):
        y = np.arange(x + 1, len(ids))
        ok = (label[y] != label[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))
        if blocks[x] >= 0 and not same_block:
            ok &= blocks[y] != blocks[x]
        y = y[ok]
        if not len(y):
            continue
        own = codes[first[x] : first[x + 1]]
        seen[own] = 1
        if size[y].sum() * 3 > first[-1] - first[x + 1]:
            counts = np.add.reduceat(seen[codes[first[x + 1] :]], first[x + 1 : -1] - first[x + 1])[y - x - 1]
        else:
            counts = np.array([int(seen[codes[first[k] : first[k + 1]]].sum()) for k in y])
        seen[own] = 0
        for k in y[100 * counts >= percent * (size[x] + size[y] - counts)]:
            if label[k] != label[x]:
                links.append((int(key[x]), int(key[k])))
                label[label == label[k]] = label[x]
    return links


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """rows: (hub, i, j, block, doc, shingles), a group's rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, blocks, sets, out = None, [], [], [], []

        def done() -> None:
            if len(ids) > 1:
                out.extend(link_group(ids, blocks, sets, percent, group[1] == group[2]))

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("hub", "i", "j", "block", "doc", "shingles")]
            for hub, i, j, block, doc, shingles in zip(*cols, strict=True):
                if (hub, i, j) != group:
                    done()
                    group, ids, blocks, sets = (hub, i, j), [], [], []
                if shingles:
                    ids.append(doc)
                    blocks.append(block)
                    sets.append(np.frombuffer(shingles, np.uint64))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
                out.clear()
        done()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicate_links(documents: DataFrame, copies: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """Confirmed links (a, b) between different sets, enough of them to connect all that are linked.

    copies: (doc_id, n, keys) with one row per distinct set."""
    members = _members(copies.where("n > 0").select(F.col("doc_id").alias("doc"), "n", F.explode("keys").alias("key")))
    # texts are shuffled once and never sorted, whatever the number of ids; all comparisons read the sets
    wanted = members.select("doc").union(members.select("hub")).distinct()
    docs = documents.select(doc_id(documents).alias("doc_id"), documents["text"])
    sets = materialize(_full_sets(docs.join(wanted.hint("shuffle_hash"), docs["doc_id"] == wanted["doc"], "left_semi"), width), "sets")
    links, several = _by_hubs(members, sets, percent)
    parts, tables = [links], [members, sets]
    if several is not None:
        left = several.join(several.where("rest").select("hub").distinct(), "hub", "left_semi")
        left = left.select("doc").union(left.select("hub")).distinct()
        chosen = materialize(sets.join(left, "doc", "left_semi"), "left")
        again = _members(_exact_keys(chosen, percent))
        links, unsettled = _by_hubs(again, chosen, percent)
        parts.append(links)
        tables += [several, chosen, again]
        if unsettled is not None:
            parts.append(_all_blocks(unsettled, chosen, percent))
            tables.append(unsettled)
    for t in tables:
        discard(t)
    return functools.reduce(DataFrame.unionByName, parts)


def _members(keyed: DataFrame) -> DataFrame:
    """keyed(doc, n, key): (hub, doc, n) of the documents that share a key with a smaller one, its hub."""
    hubs = keyed.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("top")).where("hub <> top").select("key", "hub")
    return materialize(keyed.join(hubs, "key").where("doc <> hub").select("hub", "doc", "n").distinct(), "members")


def _by_hubs(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Links of each block with its hub and within itself; and, if hubs of groups of several blocks leave any document, the
    members of these groups (hub, doc, n, rest)."""
    sizes = materialize(members.groupBy("hub").agg(_blocks().alias("q")), "sizes")
    placed = members.join(sizes, "hub").select("hub", _dealt(F.col("q")).alias("i"), "doc")
    own = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("i"), F.col("hub").alias("doc"))
    rows = placed.withColumn("block", F.col("i")).unionByName(own.withColumn("block", F.lit(-1))).withColumn("j", F.col("i"))
    links = _compared(sets, rows, percent)
    several = members.join(sizes.where("q > 1").select("hub"), "hub", "left_semi")
    found = links.select(F.col("a").alias("hub"), F.col("b").alias("doc"), F.lit(True).alias("found"))
    several = materialize(several.join(found.distinct(), ["hub", "doc"], "left").select("hub", "doc", "n", F.col("found").isNull().alias("rest")), "several")
    discard(sizes)
    return links, several if several.where("rest").limit(1).count() else None


def _exact_keys(sets: DataFrame, percent: int) -> DataFrame:
    """sets(doc, shingles): (doc, n, key) so that any two sets of the similarity share a key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kinds, n = np.unique(np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], names=["key", "n"])

    counted = sets.select("shingles").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    frequent = np.array([r.key for r in counted.where("n > 1").orderBy("n", "key", ascending=[False, True]).limit(RANKED).collect()], np.int64)
    order = np.argsort(frequent)
    shared = sets.sparkSession.sparkContext.broadcast((frequent[order], len(frequent) - order))  # at most RANKED shingles

    def make():
        known, rank = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            docs, sizes, keys = [], [], []
            for doc, data in zip(batch.column("doc").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                own = np.frombuffer(data, np.int64)
                ranks = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    ranks = np.where(known[at] == own, rank[at], 0)
                first = own[np.lexsort((own, ranks))[: len(own) + percent * len(own) // -100 + 1]]
                docs.append(np.full(len(first), doc))
                sizes.append(np.full(len(first), len(own)))
                keys.append(first)
            return {name: pa.array(np.concatenate(x).astype(np.int64)) for name, x in (("doc", docs), ("n", sizes), ("key", keys))}

        return work

    return map_batches(sets, make, "doc bigint, n bigint, key bigint")


def _all_blocks(several: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of what hubs left with all other blocks of its group."""
    rest, linked = several.where("rest"), several.where("not rest")
    most = rest.groupBy("hub").agg(_blocks().alias("r")).join(linked.groupBy("hub").agg(_blocks().alias("l")), "hub", "left").fillna(0, ["l"])
    placed = several.join(most, "hub").withColumn("block", F.when(F.col("rest"), _dealt(F.col("r"))).otherwise(F.col("r") + _dealt(F.greatest("l", F.lit(1)))))
    others = F.when(F.col("rest"), F.sequence(F.lit(0), F.col("r") + F.col("l") - 1)).otherwise(F.sequence(F.lit(0), F.col("r") - 1))
    rows = placed.select("hub", "doc", "block", F.explode(others).alias("other")).select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc")
    return _compared(sets, rows, percent)


def _blocks() -> Column:
    """How many blocks of bounded size the rows of a group fill."""
    return F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int")


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc", "hub"), blocks).cast("int")


def _compared(sets: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links within the groups of rows (hub, i, j, block, doc), on full sets."""
    rows = rows.join(sets, "doc").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "block", "doc")
    return materialize(_linked(rows, percent), "links")


def near_duplicates(documents: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept for each row of documents."""
    bound_batches(documents.sparkSession)
    signed = materialize(sign(documents, width), "signed")
    firsts = materialize(signed.where("n > 0 and doc_id is not null").groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("first")), "firsts")
    copies = signed.join(firsts.select(F.col("first").alias("doc_id"), "set_a", "set_b", "n"), ["doc_id", "set_a", "set_b", "n"], "left_semi").dropDuplicates(["doc_id", "set_a", "set_b", "n"])
    links = near_duplicate_links(documents, copies, percent, width)
    small = signed.select("doc_id", "n", "set_a", "set_b")
    labelled = small.join(firsts, ["set_a", "set_b", "n"], "left").select("doc_id", "n", F.coalesce("first", "doc_id").alias("first"))
    # an id that repeats with other texts, or is a copy by one text only, ties the sets together
    twice = labelled.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    repeated = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    if repeated.limit(1).count():
        links = links.unionByName(twice.join(repeated.select(F.col("doc_id").alias("a")), "a", "left_semi"))
    groups = connected_components(links)
    labelled = labelled.join(groups, labelled["first"] == groups["node"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first"))
    out = materialize(labelled.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "near-duplicates")
    for t in (signed, firsts, links, groups):
        discard(t)
    return out
