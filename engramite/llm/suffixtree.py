"""Language-model scores by a probabilistic suffix tree over words.

The tree's nodes are contexts of up to ``DEPTH`` words. A context is a candidate if it makes up at least ``P_MIN`` of the training tokens, so there are at
most 1 / P_MIN candidates of a depth, and its next words are counted over the whole corpus. It is retained if its next words diverge from those of its
longest retained suffix: the gain in log likelihood, each occurrence being foretold by the others (leave-one-out, as the plain divergence is large for any
context that is rare), is at least ``DIVERGENCE`` nats an occurrence. Its distribution is smoothed by absolute discounting: words that followed it at
least ``LEAST`` times keep their count less DISCOUNT, and what is left of the mass goes to the distribution of that suffix. The root is the contract's base
distribution, which leaves room for one unknown word. So the distribution of each state sums to one.

Scoring: each token is foretold by the longest retained suffix of the words before it in its text. Documents are dealt to chunks of bounded size; a chunk
asks for the counts of its distinct words and for those of its distinct (context, word) pairs that a bitmap of fixed size holds as likely entries; a join
answers, and the chunk's documents are scored from the answers. So counts of words and entries, which grow with the corpus, are neither collected nor
broadcast; what is broadcast are the retained contexts (at most DEPTH / P_MIN of 16 bytes) and the bitmap.

Words, contexts and entries are 64-bit hashes; two of n collide with a probability of n squared over 2 to the power of 65.

Defined cases: a null text is empty and has the end as its only token; without training rows all tokens are unknown, with a probability of one each; ids decide only what is
learned from, and a null id is scored, but neither held out nor learned from; repeated rows count as often as they occur and are scored alike; extra columns are ignored; an empty
table gives an empty result; a text of any length is read whole: it is held as 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.llm.common import bound_batches, discard, doc_id, fold, map_batches, materialize
from engramite.llm.neardup import _mix as mix
from engramite.llm.neardup import pieces_of, word_hashes

DEPTH, P_MIN, LEAST, DISCOUNT, DIVERGENCE = 3, 1e-4, 4, 0.75, 0.01
#: Bytes of text in a chunk, and slots of the bitmap of entries.
CHUNK_BYTES, SLOTS = 16 << 20, 1 << 25
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
END = np.uint64(0xE4D0F7E87)
ROOT = np.uint64(0x9E3779B97F4A7C15)
_HELD = 1 << 20


def tokens_of(data: bytes | None) -> np.ndarray:
    """Hashes of a whole text's words, then the end."""
    parts = [word_hashes(p)[0] for p in pieces_of((data or b"").lower())]
    return np.concatenate((*parts, [END])).astype(np.uint64)


def step(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context with one more word behind it; of an entry too."""
    return mix(context * np.uint64(0xD6E8FEB86659FD93) + word, 0x57E9)


class Tokens:
    """The words of several texts in one array, each behind the words before it in its own text."""

    def __init__(self, texts: list[bytes | None]):
        parts = [tokens_of(t) for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        self.place = np.arange(len(self.words)) - np.repeat(self.bounds[:-1], self.sizes)

    def contexts(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions with at least so many words before them in their text, and the hash of these words."""
        at = np.flatnonzero(self.place >= depth)
        h = np.full(len(at), ROOT)
        for k in range(depth, 0, -1):
            h = step(h, self.words[at - k])
        return at, h


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key lies among sorted ones, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def count_keys(texts: DataFrame, make_keys, first: str) -> DataFrame:
    """(first, word, n): how often each pair that make_keys()(tokens) gives for a text's tokens occurs in all texts; first is a small integer. A task sums up before it writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of, held, size = make_keys(), [], 0

        def summed(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            kind, word, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, at, which = np.unique(mix(word, 0) + kind.astype(np.uint64), return_index=True, return_inverse=True)
            return kind[at], word[at], np.bincount(which, n, len(at)).astype(np.int64)

        def written(parts: list) -> pa.RecordBatch:
            kind, word, n = summed(parts)
            return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), _signed(word), pa.array(n)], names=[first, "word", "n"])

        for batch in batches:
            if batch.num_rows:
                kind, word = keys_of(Tokens(batch.column(0).to_pylist()))
                held.append(summed([(kind, word, np.ones(len(word), np.int64))]))
                size += len(held[-1][0])
            if size > _HELD:
                yield written(held)
                held, size = [], 0
        if held:
            yield written(held)

    return texts.mapInArrow(run, f"{first} int, word bigint, n bigint").groupBy(first, "word").agg(F.sum("n").alias("n"))


class Contexts:
    """Candidates of one depth: hashes of the contexts and of their suffixes, and how often they occur. At most 1 / P_MIN of them."""

    def __init__(self, key: np.ndarray, suffix: np.ndarray, n: np.ndarray):
        order = np.argsort(key)
        self.key, self.suffix, self.n = key[order], suffix[order], n[order]

    def after(self, rows: pa.Table) -> Contexts:
        """The contexts that one more word makes. rows: context, as a place in this list, word and n."""
        at, word = rows.column("context").to_numpy(), rows.column("word").to_numpy().view(np.uint64)
        return Contexts(step(self.key[at], word), step(self.suffix[at], word), rows.column("n").to_numpy())


def _frame(spark: SparkSession, columns: dict[str, np.ndarray], schema: str) -> DataFrame:
    return spark.createDataFrame(list(zip(*(c.tolist() for c in columns.values()), strict=True)), schema)


class Tree:
    """What scoring needs: counts of words and discounted shares of entries as one table (key, value), the retained contexts, a bitmap of entries."""

    def __init__(self, total: int, kinds: int, values: DataFrame, key: np.ndarray, left: np.ndarray, bitmap: np.ndarray, tables: list[DataFrame]):
        self.total, self.kinds, self.values, self.key, self.left, self.bitmap, self.tables = total, kinds, values, key, left, bitmap, tables


def grow(texts: DataFrame, depth: int = DEPTH, p_min: float = P_MIN, least: int = LEAST, divergence: float = DIVERGENCE) -> Tree:
    """Learns the tree from texts, one column of binary."""
    spark = texts.sparkSession
    bound_batches(spark)
    words = materialize(count_keys(texts, lambda: lambda t: (np.zeros(len(t.words), np.int64), t.words), "context").drop("context"), "words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    base = ((F.col("total_n") + 0.5) / F.lit(total + 0.5 * (kinds + 1))).alias("before")
    frequent = words.where((F.col("n") >= p_min * total) & (F.col("word") != int(END))).toArrow()  # at most 1 / p_min rows, here and below
    now = Contexts(np.array([ROOT]), np.array([ROOT]), np.array([total])).after(frequent.append_column("context", pa.array(np.zeros(frequent.num_rows, np.int64))))
    now.suffix[:] = ROOT
    entries, tables, kept_keys, kept_left, earlier, probabilities = [], [words], [], [], None, None
    for k in range(1, depth + 1):
        if not len(now.key):
            break
        shared = spark.sparkContext.broadcast(now.key)

        def make(k=k, shared=shared):
            def pairs(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
                at, h = t.contexts(k)
                place = member(shared.value, h)
                return place[place >= 0], t.words[at[place >= 0]]

            return pairs

        counted = count_keys(texts, make, "context").where(F.col("n") >= least)
        if k == 1:
            joined = counted.join(words.select("word", F.col("n").alias("total_n")), "word").select("context", "word", "n", base)
        else:
            suffix = _frame(spark, {"context": np.arange(len(now.key)), "suffix": member(earlier.key, now.suffix)}, "context int, suffix int")
            joined = counted.join(F.broadcast(suffix), "context").join(probabilities.withColumnRenamed("context", "suffix"), ["suffix", "word"]).select("context", "word", "n", F.col("p").alias("before"))
        found = materialize(joined, "entries")
        tables.append(found)
        sizes = _frame(spark, {"context": np.arange(len(now.key)), "size": now.n}, "context int, size bigint")
        mass = found.groupBy("context").agg(F.sum(F.col("n") - DISCOUNT).alias("mass"), F.sum("n").alias("seen")).join(F.broadcast(sizes), "context")
        mass = mass.select("context", "size", (1 - F.col("mass") / F.col("size")).alias("left"), (F.col("size") - F.col("seen")).alias("rest"))
        mass = _frame(spark, {c: x.to_numpy() for c, x in zip(("context", "size", "left", "rest"), mass.toArrow().columns, strict=True)}, "context int, size bigint, left double, rest bigint")
        others = F.when(F.col("n") - 1 >= least, F.col("n") - 1 - DISCOUNT).otherwise(0.0) / (F.col("size") - 1)
        gain = F.col("n") * F.log((others + F.col("left") * F.col("before")) / F.col("before"))
        tested = found.join(F.broadcast(mass), "context").groupBy("context", "size", "left", "rest").agg(F.sum(gain).alias("gain"))
        tested = tested.where(F.col("gain") + F.col("rest") * F.log("left") >= divergence * F.col("size")).toArrow()
        place, left = tested.column("context").to_numpy().astype(np.int64), tested.column("left").to_numpy()
        retained = F.broadcast(_frame(spark, {"context": place, "size": now.n[place], "left": left}, "context int, size bigint, left double"))
        share = (F.col("n") - DISCOUNT) / F.col("size")
        probabilities = found.join(retained, "context", "left").select("context", "word", F.coalesce(share + F.col("left") * F.col("before"), "before").alias("p"))
        entries.append(_keyed(found.join(retained, "context").select("context", "word", share.alias("value")), shared))
        kept_keys.append(now.key[place])
        kept_left.append(left)
        earlier, now = now, now.after(found.where((F.col("n") >= p_min * total) & (F.col("word") != int(END))).select("context", "word", "n").toArrow())
    key, left = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((kept_keys, np.uint64), (kept_left, np.float64)))
    order = np.argsort(key)
    values, bitmap = words.select(F.col("word").alias("key"), F.col("n").cast("double").alias("value")), np.zeros(SLOTS // 64, np.uint64)
    for e in entries:
        e = materialize(e, "keyed")
        tables.append(e)
        values = values.unionByName(e)
        bits = _bitmap(e).toArrow()  # a row for each 64 slots at most
        bitmap[bits.column("slot").to_numpy()] |= bits.column("bits").to_numpy().view(np.uint64)
    return Tree(total, kinds, values, key[order], left[order], bitmap, tables)


def _keyed(entries: DataFrame, shared) -> DataFrame:
    """(key, value) of entries (context, word, value)."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            return {"key": _signed(step(shared.value[batch.column("context").to_numpy()], batch.column("word").to_numpy().view(np.uint64))), "value": batch.column("value")}

        return work

    return map_batches(entries, make, "key bigint, value double")


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot = keys % np.uint64(SLOTS)
    return (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63))


def _bitmap(entries: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(SLOTS // 64, np.uint64)
        for batch in batches:
            slot, bit = _slots(batch.column("key").to_numpy().view(np.uint64))
            np.bitwise_or.at(own, slot, bit)
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), _signed(own[used])], names=["slot", "bits"])

    return entries.select("key").mapInArrow(run, "slot int, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits"))


def score_texts(documents: DataFrame, tree: Tree | None = None, chunk_bytes: int = CHUNK_BYTES, depth: int = DEPTH, **options) -> DataFrame:
    """One row per document, with the columns of SCHEMA. options: those of grow()."""
    spark = documents.sparkSession
    bound_batches(spark)
    held_out = fold(documents, 5) == 1
    data = documents["text"].cast("binary").alias("data")
    own = tree is None
    if own:
        tree = grow(documents.where(~held_out).select(data), depth, **options)
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(-(-size // chunk_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = documents.select(doc_id(documents).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), data, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).alias("chunk"))
    dealt = dealt.repartition(chunks, "chunk")
    shared = spark.sparkContext.broadcast((tree.key, tree.left, tree.bitmap))
    total, floor = tree.total, tree.total + 0.5 * (tree.kinds + 1)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, _, bitmap = shared.value
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            of = batch.column("chunk").to_numpy()
            for chunk in np.unique(of).tolist():
                tokens = Tokens(batch.column("data").filter(pa.array(of == chunk)).to_pylist())
                keys = [tokens.words]
                for k in range(1, depth + 1):
                    at, h = tokens.contexts(k)
                    known = member(key, h) >= 0
                    entry = np.unique(step(h[known], tokens.words[at[known]]))
                    slot, bit = _slots(entry)
                    keys.append(entry[bitmap[slot] & bit != 0])
                held.setdefault(chunk, []).append(np.unique(np.concatenate(keys)))
        for chunk, parts in held.items():
            keys = np.unique(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk, np.int64)), _signed(keys)], names=["chunk", "key"])

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        contexts, left, _ = shared.value
        order = np.argsort(key := answers.column("key").to_numpy().view(np.uint64))
        key, value = key[order], answers.column("value").to_numpy()[order]
        look = lambda keys: np.where((at := member(key, keys)) >= 0, value[at] if len(value) else 0.0, 0.0)
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for batch in texts.select(["data"]).to_batches(max_chunksize=256):
            tokens = Tokens(batch.column(0).to_pylist())
            count = look(tokens.words)
            base = (count + 0.5) / floor
            p = base.copy()
            for k in range(1, depth + 1):
                at, h = tokens.contexts(k)
                place = member(contexts, h)
                at, h, place = at[place >= 0], h[place >= 0], place[place >= 0]
                p[at] = look(step(h, tokens.words[at])) + left[place] * p[at]
            for column, x in zip(columns, (np.ones(len(p)), count > 0, np.log10(base), np.log10(p)), strict=True):
                column.append(np.add.reduceat(x.astype(np.float64), tokens.bounds[:-1]))
        n, known, base, own = (np.concatenate(c) for c in columns)
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(n), total, np.int64)), "base_score": pa.array(base), "score": pa.array(own),
        })

    answers = dealt.mapInArrow(asked, "chunk bigint, key bigint").join(tree.values, "key").select("chunk", "key", "value")
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, SCHEMA)
    if own:
        out = materialize(out, "scores")
        for table in tree.tables:
            discard(table)
    return out
