"""Benchmark decontamination by a generalised suffix automaton.

The items' words (A-Z lower-cased, runs of what is no ASCII separator) build one automaton over words. Each
document streams through it; after every word the automaton knows the longest run of words, ending there,
that occurs in an item. A run of ``window`` words or more is an occurrence of a window; an item shorter than
that is one window, found as a whole. All words inside an occurrence are hit.

Items fill blocks of at most ``max_words`` words, each with an automaton held in flat arrays; at most ``per_pass`` of them are broadcast
for one pass over the documents, so what workers hold is bounded whatever the benchmark's size. A benchmark of several passes
never rewrites texts: each pass writes only a digest of each text that it hits, with the hits, and the last step joins them by digest.

Defined cases: a null or empty text has no words and is never contaminated; items that are null or without
words have no window; without items nothing is hit; rows of one item_id are one item for counting; a null item_id still marks words, but is no item to
list; documents are judged one by one, so repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.llm.common import doc_id, map_batches, materialize

WINDOW, SHARE, MAX_WORDS, PER_PASS = 13, 20, 200_000, 4
_DIGEST, _RANGES, _ITEMS = "__decontam_digest", "__decontam_ranges", "__decontam_items"
SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.encode().lower().decode()


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(lower_ascii(text)) if text else []


class SuffixAutomaton:
    """Generalised over items: each item starts again at the root. Symbols are words, numbered. A state's first transition lies in arrays,
    further ones in a dictionary of the few states that have them."""

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int = WINDOW):
        self.window = window
        self.words: dict[str, int] = {}
        numbered = [(i, [self.words.setdefault(x, len(self.words)) for x in w]) for i, w in items if w]
        self._next: list[dict[int, int]] = [{}]
        self.link, self.len = array("i", [-1]), array("i", [0])
        for _, w in numbered:
            self._add(w)
        self.names = sorted({i for i, _ in numbered if i is not None})
        number = {n: k for k, n in enumerate(self.names)}
        #: items by the state of a window or of a whole short item: one in an array, several in a dictionary
        self.item, self.items = array("i", [-1]) * len(self.len), {}
        #: states that hold a whole short item, and the nearest of them among a state's suffixes
        self.short: set[int] = set()
        for name, w in numbered:
            at = 0
            for k, x in enumerate(w):
                at = self._next[at][x]
                if k + 1 >= window:
                    self._mark(self._window_state(at), number.get(name, -1))
            if len(w) < window:
                self.short.add(at)
                self._mark(at, number.get(name, -1))
        self.nearest = array("i", [-1]) * len(self.len)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__) if self.short else ():
            self.nearest[s] = s if s in self.short else self.nearest[self.link[s]]
        self.first_word, self.first_next, self.more = array("i"), array("i"), {}
        for s, edges in enumerate(self._next):
            x, t = next(iter(edges.items()), (-1, -1))
            self.first_word.append(x)
            self.first_next.append(t)
            if len(edges) > 1:
                self.more[s] = edges
        #: the root's transitions: it has one for every word that has a number
        self.root = array("i", [self._next[0][x] for x in range(len(self.words))])
        del self._next

    def _mark(self, s: int, item: int) -> None:
        if item >= 0 and self.item[s] != item:
            if self.item[s] < 0:
                self.item[s] = item
            else:
                self.items.setdefault(s, set()).add(item)

    def _window_state(self, s: int) -> int:
        while self.len[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def _add(self, w: list[int]) -> None:
        nxt, link, length, last = self._next, self.link, self.len, 0
        for x in w:
            if (q := nxt[last].get(x)) is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, x)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and x not in nxt[p]:
                nxt[p][x] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][x]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, x)
            last = cur

    def _clone(self, p: int, q: int, x: int) -> int:
        c = len(self._next)
        self._next.append(dict(self._next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = c
        while p != -1 and self._next[p].get(x) == q:
            self._next[p][x] = c
            p = self.link[p]
        return c

    def scan(self, w: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges that are hit (may overlap), and the items with occurring windows."""
        number, first_word, first_next, more, link, length, window = self.words.get, self.first_word, self.first_next, self.more, self.link, self.len, self.window
        root, short = self.root, bool(self.short)
        s, n, hits, states = 0, 0, [], set()
        for i, x in enumerate(map(number, w)):
            if x is None:
                s = n = 0
                continue
            while s:
                if first_word[s] == x:
                    s = first_next[s]
                    break
                if s in more and (t := more[s].get(x)) is not None:
                    s = t
                    break
                s = link[s]
                n = length[s]
            else:
                s, n = root[x], 0
            n += 1
            if n >= window:
                hits.append((i - n + 1, i + 1))
                states.add(self._window_state(s))
            if short:
                # the state's longest word run may be longer than what matched: shorter items by suffix links
                q = s if length[s] <= n else link[s]
                q = self.nearest[q] if q > 0 else -1
                while q > 0:
                    hits.append((i - length[q] + 1, i + 1))
                    states.add(q)
                    q = self.nearest[link[q]] if link[q] > 0 else -1
        found = {self.item[q] for q in states}.union(*(self.items.get(q, ()) for q in states)) - {-1}
        return hits, {self.names[k] for k in found}


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, max_words: int):
    """Yields (item_id as text, words) lists of bounded size; rows arrive one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(benchmark["item_id"].cast("string").alias("i"), benchmark["text"].alias("t")).toLocalIterator():
        if w := words_of(row.t):
            if block and size + len(w) > max_words:
                yield block
                block, size = [], 0
            block.append((row.i, w))
            size += len(w)
    yield block


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS, per_pass: int = PER_PASS) -> DataFrame:
    """One row per document, with the columns of SCHEMA."""
    data = documents.select(doc_id(documents).alias("doc_id"), documents["text"])

    def build(batch: pa.RecordBatch, found: list[Found]) -> dict:
        return {
            "doc_id": batch.column("doc_id"), "n_words": pa.array([f.n_words for f in found], pa.int64()), "n_hit": pa.array([f.n_hit for f in found], pa.int64()),
            "n_items": pa.array([len(f.items) for f in found], pa.int64()), "items_sha256": [hashlib.sha256(",".join(sorted(f.items)).encode()).hexdigest() for f in found], "contaminated": [f.contaminated for f in found],
        }

    return _over(data, benchmark, build, SCHEMA, window, max_words, per_pass)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS, per_pass: int = PER_PASS) -> DataFrame:
    """documents without those that are contaminated; from the others go the words that are hit, with the separators between them. Where a
    text changed, n_chars, if there, follows."""
    columns = documents.columns

    def build(batch: pa.RecordBatch, found: list[Found]) -> dict:
        texts = batch.column("text").to_pylist()
        out = {n: batch.column(n) for n in columns}
        edited = [without(t, word_spans(lower_ascii(t)), f.hits) if f.hits else t for t, f in zip(texts, found, strict=True)]
        out["text"] = pa.array(edited, batch.schema.field("text").type)
        if "n_chars" in out:
            sizes = [n if not f.hits else len(t) for t, f, n in zip(edited, found, out["n_chars"].to_pylist(), strict=True)]
            out["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
        stay = pa.array([not f.contaminated for f in found], pa.bool_())
        return {n: x.filter(stay) for n, x in out.items()}

    return _over(documents, benchmark, build, documents.schema, window, max_words, per_pass)


@dataclass
class Found:
    """What was found in a text: how many words it has, disjoint word ranges that are hit, and items with occurring windows."""

    n_words: int
    hits: list[tuple[int, int]]
    items: set[str]

    @property
    def n_hit(self) -> int:
        return sum(b - a for a, b in self.hits)

    @property
    def contaminated(self) -> bool:
        return bool(self.hits) and SHARE * self.n_hit >= self.n_words


def scan_all(text: str | None, automata: list[SuffixAutomaton]) -> Found:
    words, hits, items = words_of(text), [], set()
    for automaton in automata:
        h, i = automaton.scan(words)
        hits += h
        items |= i
    return Found(len(words), union(hits), items)


def _over(data: DataFrame, benchmark: DataFrame, build, schema, window: int, max_words: int, per_pass: int) -> DataFrame:
    """build(batch, found for each row) -> columns, over data(text, ...)."""
    spark = data.sparkSession
    blocks = blocks_of(benchmark, max_words)
    passes = iter(lambda: [spark.sparkContext.broadcast(SuffixAutomaton(b, window)) for b in islice(blocks, per_pass)], [])
    first, second = next(passes), next(passes, None)
    if second is None:

        def direct():
            automata = [b.value for b in first]
            return lambda batch: build(batch, [scan_all(t, automata) for t in batch.column("text").to_pylist()])

        return map_batches(data, direct, schema)
    texts = data.select(data["text"]).where(data["text"].isNotNull())
    parts = [_hit_texts(texts, shared) for shared in chain((first, second), passes)]
    together = functools.reduce(DataFrame.unionByName, parts).groupBy("digest")  # a row for each pass at most
    merged = together.agg(F.flatten(F.collect_list("ranges")).alias(_RANGES), F.array_distinct(F.flatten(F.collect_list("items"))).alias(_ITEMS))
    joined = data.withColumn(_DIGEST, F.sha2(data["text"], 256)).join(merged.withColumnRenamed("digest", _DIGEST), _DIGEST, "left").drop(_DIGEST)

    def later():
        def work(batch: pa.RecordBatch):
            ranges, items = batch.column(_RANGES).to_pylist(), batch.column(_ITEMS).to_pylist()
            found = []
            for text, r, i in zip(batch.column("text").to_pylist(), ranges, items, strict=True):
                r = r or []
                found.append(Found(len(words_of(text)), union(list(zip(r[::2], r[1::2], strict=True))), set(i or ())))
            return build(batch, found)

        return work

    return map_batches(joined, later, schema)


def _hit_texts(texts: DataFrame, shared: list) -> DataFrame:
    """(digest, ranges, items) of the distinct texts that one pass hits."""

    def make():
        automata = [b.value for b in shared]

        def work(batch: pa.RecordBatch) -> dict:
            out = {}
            for text in batch.column("text").to_pylist():
                if (f := scan_all(text, automata)).hits:
                    out[hashlib.sha256(text.encode()).hexdigest()] = ([x for h in f.hits for x in h], sorted(f.items))
            return {"digest": pa.array(out, pa.string()), "ranges": pa.array([r for r, _ in out.values()], pa.list_(pa.int64())), "items": pa.array([i for _, i in out.values()], pa.list_(pa.string()))}

        return work

    return materialize(map_batches(texts, make, "digest string, ranges array<bigint>, items array<string>").dropDuplicates(["digest"]), "hits")


def word_spans(low: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORDS.finditer(low)]


def without(text: str, spans: list[tuple[int, int]], hits: list[tuple[int, int]]) -> str:
    """The text without the words that are hit and the separators between them. hits: disjoint word ranges in order."""
    out, pos = [], 0
    for a, b in hits:
        out.append(text[pos : spans[a][0]])
        pos = spans[b - 1][1]
    return "".join([*out, text[pos:]])
