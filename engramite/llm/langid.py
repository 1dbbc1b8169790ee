"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its hashed subwords (letters, bigrams, trigrams and
4-grams of its lower-cased letters, words marked by their borders). The model is trained by stochastic gradient descent in
numpy on the driver, over about ``max_rows`` labelled documents (the documented bound of the sample): of each language its share
of them, but ``least_rows`` of a rare one, chosen by a hash of id and text. Executors count the subwords of the whole texts; a text's
counts, at most BUCKETS of them, reach the driver. A part of the sample is kept from the descent to fit a temperature and the
threshold of rejection.

Scoring needs one table only: embedding times softmax weights, a row of class scores for each subword. The
mean over whole texts of these rows equals the softmax layer over the mean embedding.

Defined cases: a null text, or one without a letter, gets ``und``, score 0 and is rejected; without any
labelled row all get ``und``; repeated rows are scored alike; extra columns are ignored; an empty table gives
an empty result; null ids are scored, and never learned from or held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramite.llm.common import bound_batches, doc_id, fold, map_batches

UNDETERMINED = "und"
UNDECIDED = 0.4
BUCKETS = 1 << 16
DIM = 24
ORDERS = (1, 2, 3, 4)
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"
_CHUNK = 1 << 17  # characters that are hashed at once


def _letter_table() -> np.ndarray:
    """For each code point below 0x3000, its lower-case letter, or 32 for what is no letter."""
    table = np.full(0x3000, 32, np.uint32)
    for i in range(0x3000):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(low) if len(low := c.lower()) == 1 else i
    return table


_TABLE = _letter_table()


def _letters(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes) or codes.max() < len(_TABLE):
        return _TABLE[codes]
    high = codes >= len(_TABLE)
    out = _TABLE[np.where(high, 0, codes)]
    kinds, at = np.unique(codes[high], return_inverse=True)
    out[high] = np.array([ord(low) if (c := chr(k)).isalpha() and len(low := c.lower()) == 1 else k if c.isalpha() else 32 for k in kinds.tolist()], np.uint32)[at]
    return out


def subwords(text: str, chunk: int = _CHUNK):
    """Yields arrays of subword buckets of the whole text, piece by piece; pieces overlap so that none is lost."""
    most = max(ORDERS)
    for at in range(0, max(1, len(text)), chunk):
        before = min(at, most - 1)
        x = _letters(text[at - before : at + chunk])
        # a border before the first character and after the last
        x = np.concatenate(([32] if at == 0 else [], x, [32] if at + chunk >= len(text) else [])).astype(np.uint32)
        skip = before
        h, found = x * np.uint32(0x9E3779B1), []
        letter = x != 32
        for n in ORDERS:
            if n > 1:
                if len(x) < n:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + x[n - 1 :] * np.uint32(0xC2B2AE35)
                letter = letter[:-1] | (x[n - 1 :] != 32)
            ends = slice(max(0, skip - n + 1), None)
            mixed = h[ends] ^ (h[ends] >> np.uint32(16))
            found.append(((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16))[letter[ends]])
        yield np.concatenate(found)


@dataclass
class Model:
    """scores: (BUCKETS, classes), the embedding times the softmax weights."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.langs)), 0
        for ids in subwords(text):
            if len(ids):
                total += self.scores.take(ids, axis=0).sum(axis=0, dtype=np.float64)
                n += len(ids)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        z = self.logits(text) if text and self.langs else None
        if z is None:
            return UNDETERMINED, 0.0, True
        p = softmax(z[None, :] / self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, p[k])), bool(p[k] < self.reject_below)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text's subwords and how often each occurs."""
    counts = np.zeros(BUCKETS, np.int64)
    for ids in subwords(text):
        counts += np.bincount(ids, minlength=BUCKETS)
    kinds = np.flatnonzero(counts)
    return kinds, counts[kinds]


def fit(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 6, rate: float = 0.6, seed: int = 7) -> Model:
    """SGD over documents, one at a time; a document's subwords enter by count, so no order of rows matters but the seeded one."""
    classes = sorted(set(langs))
    rng = np.random.default_rng(seed)
    y_all = np.array([classes.index(x) for x in langs], dtype=np.int64)
    usable = np.array([i for i, b in enumerate(bags) if len(b[0])], dtype=np.int64)
    if not len(usable):
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    order = rng.permutation(usable)
    n_cal = len(order) // 5 if len(order) >= 20 else 0
    cal, train = order[:n_cal], order[n_cal:]
    emb = rng.normal(0, 1.0 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (DIM, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.02
        for i in rng.permutation(train):
            ids, counts = bags[i]
            share = (counts / counts.sum()).astype(np.float32)
            vec = share @ emb[ids]
            p = softmax((vec @ weights + bias)[None, :])[0]
            p[y_all[i]] -= 1.0
            back = weights @ p
            weights -= step * np.outer(vec, p)
            bias -= step * 0.1 * p
            emb[ids] -= (step * 20.0) * share[:, None] * back[None, :]
    model = Model(classes, (emb @ weights).astype(np.float32), bias.astype(np.float64))
    if n_cal:
        z = np.array([(bags[i][1] / bags[i][1].sum()) @ model.scores[bags[i][0]] + model.bias for i in cal])
        calibrate(model, z, y_all[cal])
    return model


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, most_lost: float = 0.002) -> None:
    """Temperature of least log loss on rows that the descent never saw; a text is rejected if no class reaches
    UNDECIDED, so that a page in two languages stays, and the threshold sinks below that where it would reject
    over ``most_lost`` of the rightly classified rows."""
    grid = np.geomspace(0.05, 5.0, 61)
    rows = np.arange(len(y))
    loss = [-np.log(softmax(z / t)[rows, y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    model.reject_below = UNDECIDED if not len(right) else float(min(UNDECIDED, right[int(most_lost * len(right))]))


def sample_rows(labelled: DataFrame, max_rows: int, least_rows: int) -> DataFrame:
    """Distinct (doc_id, text, lang), chosen by a hash of id and text: of each language its share of max_rows, or least_rows where that is more."""
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    total, least = sum(sizes.values()), min(least_rows, max_rows // max(len(sizes), 1))
    shares = {x: min(1.0, max(max_rows * n / total, least) / n) for x, n in sizes.items()}
    rows = labelled.where(labelled["text"].isNotNull()).select(labelled["doc_id"].cast("bigint").alias("doc_id"), labelled["text"], labelled["lang"])
    if not shares:
        return rows
    table = labelled.sparkSession.createDataFrame([(x, int(s * (1 << 30)) + 1) for x, s in shares.items()], "__lang string, __below bigint")
    key = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30))
    return rows.join(F.broadcast(table), (rows["lang"] == table["__lang"]) & (key < table["__below"]), "left_semi").distinct()


def train(documents: DataFrame, learn: Column, max_rows: int = 4000, least_rows: int = 100) -> Model:
    """learn: which rows may be learned from."""
    bound_batches(documents.sparkSession)
    lang = documents["lang"].cast("string")
    rows = documents.where(learn & lang.isNotNull() & documents["doc_id"].isNotNull()).select(documents["doc_id"], documents["text"], lang.alias("lang"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            bags = [bag(t) for t in batch.column("text").to_pylist()]
            return {
                "doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "kinds": pa.array([k.astype("<u2").tobytes() for k, _ in bags], pa.binary()),
                "counts": pa.array([c.astype("<u4").tobytes() for _, c in bags], pa.binary()),
            }

        return work

    got = map_batches(sample_rows(rows, max_rows, least_rows), make, "doc_id bigint, lang string, kinds binary, counts binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], r["kinds"], r["counts"]))
    return fit([(np.frombuffer(r["kinds"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.int64)) for r in got], [r["lang"] for r in got])


def identify_language(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Label, calibrated score and rejection of each whole text."""
    held_out = fold(documents, 3) == 1
    if model is None:
        model = train(documents, ~held_out)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def make():
        m = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            got = [m.predict(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array([x[0] for x in got], pa.string()), "score": pa.array([x[1] for x in got], pa.float64()), "rejected": pa.array([x[2] for x in got], pa.bool_())}

        return work

    return map_batches(documents.select(doc_id(documents).alias("doc_id"), documents["text"], F.coalesce(held_out, F.lit(False)).alias("held_out")), make, SCHEMA)
