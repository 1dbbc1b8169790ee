"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

Each whole text becomes token ids and a closing id. Whole sequences are cut off the front; what remains is packed
first-fit decreasing: the tournament tree holds the free room of the bins, so the first bin with enough room is found in
the logarithm of their number. Pieces fall into groups of about ``group_docs`` documents by a hash of id, text and place in the table, so
neither a long text nor a row that repeats fills one group; each group is packed by itself, in windows of at most ``WINDOW`` pieces, so
memory is bounded and groups run in parallel.

Only lengths and checksums of pieces are shuffled. Ids come from the public vocabulary: texts of common characters
by a faster encoder of the same merges, all others, and whatever that encoder refuses, by the tokenizer file itself; both give equal ids.

Defined cases: a null or empty text is the closing id alone; rows that repeat an id are packed one by one; null ids are packed; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.llm.common import doc_id, map_batches, texts_of

CAPACITY, END_ID, GROUP_DOCS, WINDOW = 1024, 0, 4096, 1 << 16
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, spread bigint, place bigint"
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_UNCOMMON = re.compile(r"[^\t\n\r\x20-\x7E¡-ɏ‘’“”–—…€]")


class Encoder:
    """Ids of a byte-level BPE vocabulary, given as a tokenizers file and as ranks of the same merges."""

    def __init__(self, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer_file)
        self.exact.encode_special_tokens = True
        self.fast = None
        if ranks_file and pattern:
            from engramite.llm.secrets import load_encoding

            self.fast = load_encoding(ranks_file, pattern)

    def ids(self, text: str) -> list[int]:
        if not text:
            return []
        if self.fast is not None and (text.isascii() or _UNCOMMON.search(text) is None):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the encoder's limits end in a panic, which is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return self.exact.encode(text, add_special_tokens=False).ids


def default_files() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


class TournamentTree:
    """Free room of bins; the first bin with at least so much room, found from the root."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        left = room[at] - size
        room[at] = left
        bin_ = at - self.leaves
        at //= 2
        while at:
            a, b = room[2 * at], room[2 * at + 1]
            room[at] = a if a > b else b
            at //= 2
        return bin_


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the given order; ties keep that order."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    tree, used = TournamentTree(max(1, len(lengths)), capacity), {}
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        b = tree.place(lengths[i])
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = offsets[i] + lengths[i]
    return bins, offsets


def pieces(documents: DataFrame, files: tuple[str, str | None, str | None] | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids cut into pieces of at most ``capacity``, without the ids. place: the row's number within its task."""

    def make():
        encoder, rows = Encoder(*(files or default_files())), itertools.count()

        def work(batch: pa.RecordBatch) -> dict:
            out: list[tuple] = []
            for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = np.array(encoder.ids(text) + [end_id], "<u4")
                n, spread, place = len(ids), zlib.crc32(ids), next(rows)
                for start in range(0, n, capacity):
                    part = ids[start : start + capacity]
                    out.append((key, start, len(part), zlib.crc32(part), n, spread, place))
            names = [x.split(" ")[0] for x in PIECES.split(", ")]
            return {name: pa.array([r[k] for r in out], pa.int64()) for k, name in enumerate(names)}

        return work

    return map_batches(documents.select(doc_id(documents).alias("doc_id"), documents["text"]), make, PIECES)


def pack(documents: DataFrame, files: tuple[str, str | None, str | None] | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece, with its sequence and offset."""
    groups = max(1, -(-documents.count() // group_docs))
    hashed = pieces(documents, files, capacity, end_id)
    hashed = hashed.withColumn("order", F.xxhash64("doc_id", "spread", "start", "place")).withColumn("group", F.pmod("order", F.lit(groups)))
    placed = hashed.repartition("group").sortWithinPartitions("group", "order", "doc_id", "spread", "start", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "group"]
        held: list[tuple] = []
        current, next_id = None, 0

        def packed() -> pa.RecordBatch:
            nonlocal next_id
            bins, offsets = first_fit_decreasing([r[2] for r in held], capacity)
            base = (current << 32) + next_id
            next_id += max(bins) + 1
            cols = [pa.array([r[k] for r in held], pa.int64()) for k in range(5)]
            cols += [pa.array([base + b for b in bins], pa.int64()), pa.array(offsets, pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=[*names[:5], "sequence_id", "offset"])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if row[5] != current or len(held) >= WINDOW:
                    if held:
                        yield packed()
                    if row[5] != current:
                        current, next_id = row[5], 0
                held.append(row)
        if held:
            yield packed()

    return placed.mapInArrow(run, SCHEMA)
