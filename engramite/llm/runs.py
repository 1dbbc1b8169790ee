"""Periodic runs of words: aligned blocks of two to the power of k words, found again by an automaton over word numbers.

A run of period q holds, with B the power of two at or below q, an aligned block of B words that occurs again q words later, as a run is
four periods long. So for each B the aligned blocks are the keys of an Aho-Corasick automaton over integer sequences, which reads the document
once; an occurrence at x belongs to the one aligned block from which it is B to 2B - 1 words away, and where that block holds the same words, the pair is a
seed. Seeds that a run of a shorter period explains are left out, the others are extended word by word to both sides.

For a block size only those stretches are read in which every word occurs again within 2B words, for 3B words on end: every run of that size lies
in one. In prose there are hardly any, so a document costs one sort of its words and a scan for each size.

Defined cases: a null text has no words; without a run the four columns of the run are null and the digest of the runs is that of nothing; a null id is
never altered; rows are worked on one by one, so repeated rows, ties and extra columns change nothing. A whole text is held as an integer for each word and
its distinct words; the automaton holds a node for each word of the stretches at most.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from engramite.llm.common import doc_id, map_batches
from engramite.llm.neardup import pieces_of

#: A run is at least so many words and so many periods long.
MIN_LENGTH, MIN_PERIODS = 6, 4
SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
_NEVER = np.iinfo(np.int64).max


def words_of(data: bytes | None) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word of a text, and the distinct words by number."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    parts = [np.fromiter(map(numbers.__getitem__, piece.split()), np.int64) for piece in pieces_of(data or b"")]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), list(numbers)


def planted(words: np.ndarray, document: int | None) -> np.ndarray:
    """The words as the query reads them: those of every tenth id, by crc32, become periodic from one word on."""
    n = len(words)
    h = zlib.crc32(str(document).encode()) if document is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return np.concatenate((words[:first], words[first + np.arange(n - first) % period]))


def _next_distance(words: np.ndarray) -> np.ndarray:
    """How far away each word occurs again."""
    order = np.argsort(words, kind="stable")
    same = words[order[:-1]] == words[order[1:]]
    out = np.full(len(words), _NEVER)
    out[order[:-1][same]] = order[1:][same] - order[:-1][same]
    return out


def _stretches(distance: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Where all words occur again within twice the size, for three times the size on end; with the words that they meet."""
    n = len(distance)
    bad = np.concatenate(([-1], np.flatnonzero(distance >= 2 * size), [n]))
    return [(int(bad[i]) + 1, min(n, int(bad[i + 1]) + 2 * size)) for i in np.flatnonzero(np.diff(bad) > 3 * size)]


class _Names:
    """Numbers for the blocks of a size at every position of a document, equal ones for equal blocks; the size only grows."""

    def __init__(self, words: np.ndarray):
        self.size, self.of = 1, words

    def grow(self, size: int) -> np.ndarray:
        while self.size < size:
            left, right = self.of[: len(self.of) - self.size], self.of[self.size :]
            self.of = np.unique(left * (int(self.of.max()) + 1) + right, return_inverse=True)[1]
            self.size *= 2
        return self.of


def _digits(numbers: np.ndarray, places: int) -> np.ndarray:
    """Each number by its digits to the base 64, each place with symbols of its own: nodes of the automaton have few children then."""
    return np.stack([(numbers >> 6 * k & 63) + 64 * k for k in range(places)], axis=-1)


def _seeds(names: np.ndarray, low: int, high: int, size: int) -> np.ndarray:
    """(position of a block, position at which it occurs again) for one stretch of the document. A block is spelled by the names of its two halves,
    so the stretch is read once for each remainder of positions by that half."""
    half, per_key = (size // 2, 2) if size > 1 else (1, 1)
    part = names[low : high - half + 1]
    places = max(1, (int(part.max()).bit_length() + 5) // 6)
    end_of_row = 64 * places
    width = -(-len(part) // half) + 1
    grid = np.full((width * half, places), end_of_row, np.int64)
    grid[: len(part)] = _digits(part, places)
    symbols = tuple(grid.reshape(width, half, places).transpose(1, 0, 2).ravel().tolist())
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    at = np.arange(-low % size, len(part) - half * (per_key - 1), size)
    spelled = np.concatenate([_digits(part[at + k * half], places) for k in range(per_key)], axis=1).tolist()
    for first, key in zip(at.tolist(), map(tuple, spelled), strict=True):
        if not automaton.exists(key):
            automaton.add_word(key, first)
    block = np.full(len(part), -1, np.int64)
    if len(at):
        automaton.make_automaton()
        hits = np.array(list(automaton.iter(symbols)), np.int64).reshape(-1, 2)
        row, column = np.divmod(hits[:, 0] // places, width)
        block[row + (column - per_key + 1) * half] = hits[:, 1]
    again = np.flatnonzero(block >= 0)
    start = ((again + low) // size - 1) * size - low
    again, start = again[start >= 0], start[start >= 0]
    same = block[start] == block[again]
    return np.stack((start[same], again[same]), axis=1) + low


def _agree(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The widest range around ``at`` in which each word is the one a period later."""
    last, step, right = len(words) - period, 64, at
    while right < last:
        end = min(last, right + step)
        differ = words[right:end] != words[right + period : end + period]
        if differ.any():
            right += int(differ.argmax())
            break
        right, step = end, min(2 * step, 1 << 16)
    left, step = at, 64
    while left > 0:
        end = max(0, left - step)
        differ = words[end:left][::-1] != words[end + period : left + period][::-1]
        if differ.any():
            left -= int(differ.argmax())
            break
        left, step = end, min(2 * step, 1 << 16)
    return left, right


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """Every run as (start, length, period), by start, then period."""
    found: list[tuple[int, int, int]] = []
    if len(words) < MIN_LENGTH:
        return found
    distance, names, size = _next_distance(words), _Names(words), 1
    while MIN_PERIODS * size <= len(words):
        earlier = [r for r in found if r[1] >= 2 * size]
        stretches = _stretches(distance, size)
        parts = [_seeds(names.grow(max(1, size // 2)), low, high, size) for low, high in stretches]
        pairs = np.unique(np.concatenate(parts)[:, ::-1], axis=0)[:, ::-1] if parts else np.zeros((0, 2), np.int64)
        keep = np.ones(len(pairs), bool)
        for start, length, period in earlier:  # a multiple of its period inside a run says nothing new
            a, b = np.searchsorted(pairs[:, 1], (start + size, start + length - size + 1))
            keep[a:b] &= (pairs[a:b, 0] < start) | ((pairs[a:b, 1] - pairs[a:b, 0]) % period != 0)
        reached: dict[int, int] = {}
        for at, again in pairs[keep].tolist():
            period = again - at
            if at < reached.get(period, 0):
                continue
            left, reached[period] = _agree(words, at, period)
            if reached[period] + period - left >= max(MIN_LENGTH, MIN_PERIODS * period):
                found.append((left, reached[period] + period - left, period))
        size *= 2
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run keeps its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length over period; of equal ones the first, then the one of the shorter period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def audit_runs(documents: DataFrame, alter: bool = True) -> DataFrame:
    """One row per document, with the columns of SCHEMA. alter: whether every tenth document is made periodic first, as the query asks."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {name: [] for name in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
            for document, data in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                words, kinds = words_of(data)
                if alter:
                    words = planted(words, document)
                runs = find_runs(words)
                best = strongest(runs)
                out["n_runs"].append(len(runs))
                for name, value in zip(("start", "length", "period"), best or (None, None, None), strict=True):
                    out[name].append(value)
                out["exponent_milli"].append(1000 * best[1] // best[2] if best else None)
                out["runs_sha256"].append(hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest())
                out["collapsed_sha256"].append(_digest(words[collapse(len(words), runs)] if runs else words, kinds))
            numbers = {name: pa.array(out[name], pa.int64()) for name in ("n_runs", "start", "length", "period", "exponent_milli")}
            return {"doc_id": batch.column("doc_id")} | numbers | {name: pa.array(out[name], pa.string()) for name in ("runs_sha256", "collapsed_sha256")}

        return work

    return map_batches(documents.select(doc_id(documents).alias("doc_id"), documents["text"].cast("binary").alias("data")), make, SCHEMA)


def _digest(words: np.ndarray, kinds: list[bytes], step: int = 1 << 16) -> str:
    digest = hashlib.sha256()
    for at in range(0, len(words), step):
        digest.update(b" " * (at > 0) + b" ".join([kinds[i] for i in words[at : at + step].tolist()]))
    return digest.hexdigest()
