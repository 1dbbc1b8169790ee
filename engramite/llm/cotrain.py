"""Quality: co-training of a text view and a metadata view.

The text view sees the whole text and nothing else: its hashed words and pairs of words, and the shape of its writing. The metadata view
sees the page's columns and nothing of the text: language, source and recorded length. Each is a logistic regression. In every round each view
labels the unlabelled documents it is surest of, and gives them to the other view as pseudo-labels. The views are then calibrated on
labelled rows that neither was fitted on, nor gave labels to, and combined by their calibrated log-odds.

Features of every whole text are worked out once and written to the shared folder. In each round both views score all of them, and the
``exchange`` surest documents of each view are gathered. Fitting is done on the driver over these and about ``max_rows`` labelled documents (the
documented bound; chosen by a hash): ``max_rows`` and ``exchange`` are the two bounds of what is fitted, the second for each view and round, whatever the size of the corpus. Documents of the
labelled sample, and copies of their texts, are never given pseudo-labels. Every document is scored, from its whole text.

Defined cases: a null or empty text has the features of no words; null metadata are a value of their own; without labels of
both classes every score is 0.5; repeated rows are scored alike, rows that repeat an id are one row of the sample, the smallest, and equal texts
get one pseudo-label of a view; documents of which a view is equally sure go by a hash of their texts; extra columns are ignored; null ids are
scored and never learned from.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice
from operator import eq, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramite.llm.common import bound_batches, discard, doc_id, fold, map_batches, materialize, shared_dir, texts_of
from engramite.llm.neardup import pieces_of, word_hashes

SCHEMA = "doc_id bigint, held_out boolean, text_score double, meta_score double, score double, predicted int"
FEATURES = "doc_id bigint, held_out boolean, digest bigint, s binary, m binary, k binary, c binary"
SHAPES, META_FEATURES, HASHED, BUCKETS = 16, 40, 32, 1 << 15
SLICES = 16  # of candidates, so that no task ranks those of all tasks; what the slices leave, at most exchange rows of each view, class and slice, is ranked on the driver
_Bag = tuple[np.ndarray, np.ndarray]
_WORD = re.compile(r"[^\W\d_]+")
_SYMBOL = re.compile(r"[#$%&*|~^<>{}\[\]\\=+_@]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_DIGITS = re.compile(r"[0-9]+")


def shape_features(text: str) -> list[float]:
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if x]
    n, chars = max(len(words), 1), max(len(text), 1)
    distinct = len(set(words)) / n
    symbols = sum(map(len, _SYMBOL.findall(text)))
    sentences = text.count(".") + text.count("?") + text.count("!")
    letters = sum(map(len, words))
    again = sum(map(eq, words, words[1:])) / n
    return [
        letters / chars, sum(map(len, _UPPER.findall(text))) / chars, symbols / chars, text.count("!") / n, text.count("|") / n, sum(map(len, _DIGITS.findall(text))) / chars,
        distinct, 1 - len(set(lines)) / max(len(lines), 1), letters / n, min(n / max(sentences, 1), 200) / 50, text.count(",") / n, np.log1p(len(words)) / 5, float(not words),
        (text.count("…") + text.count("...")) / max(len(lines), 1), again, float(again > 0.5),
    ]


def word_buckets(text: str):
    """Yields arrays of buckets of a whole text's lower-cased words and pairs of words, piece by piece."""
    before = np.zeros(0, np.uint64)
    for piece in pieces_of(text.encode("utf-8", "surrogatepass").lower()):
        words = np.concatenate((before, word_hashes(piece)[0]))
        pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ words[1:]
        yield (np.concatenate((words[len(before) :], pairs * np.uint64(0xC2B2AE3D27D4EB4F))) >> np.uint64(49)).astype(np.int64)
        before = words[-1:]


def bag(text: str) -> _Bag:
    """Buckets that occur and their counts."""
    counts = np.zeros(BUCKETS, np.int64)
    for ids in word_buckets(text):
        counts += np.bincount(ids, minlength=BUCKETS)
    kinds = np.flatnonzero(counts)
    return kinds, counts[kinds]


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Hashed categories and the recorded length."""
    x = [0.0] * META_FEATURES
    for kind, value in (("lang", lang), ("source", source)):
        x[zlib.crc32(f"{kind}={value}".encode()) % HASHED] += 1.0
    size = float(np.log1p(max(n_chars or 0, 0)))
    x[HASHED] = float(n_chars is None)
    x[HASHED + 1] = size / 8
    x[HASHED + 2 + min(int(size / 2), 5)] = 1.0
    return x


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights[1:] + self.weights[0]

    def log_odds(self, raw: np.ndarray) -> np.ndarray:
        """Calibrated."""
        return np.clip(self.slope * raw + self.offset, -15, 15)


@dataclass
class TextModel:
    """A logistic regression over standardised shapes and over shares of hashed words."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    table: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, shapes: np.ndarray, by_words: np.ndarray) -> np.ndarray:
        """by_words: the mean of the table over each text's words."""
        return np.clip((shapes - self.mean) / self.scale, -8, 8) @ self.weights[1:] + self.weights[0] + by_words

    def over_bag(self, b: _Bag) -> float:
        return float(self.table[b[0]] @ b[1] / b[1].sum()) if len(b[0]) else 0.0

    def over_text(self, text: str) -> float:
        total, n = 0.0, 0
        for ids in word_buckets(text):
            total += float(self.table.take(ids).sum(dtype=np.float64))
            n += len(ids)
        return total / n if n else 0.0

    def raw_rows(self, x: Texts) -> np.ndarray:
        return self.raw(x.shapes, np.array([self.over_bag(b) for b in x.bags]))

    def log_odds(self, raw: np.ndarray) -> np.ndarray:
        """Calibrated."""
        return np.clip(self.slope * raw + self.offset, -15, 15)


@dataclass
class Texts:
    """The text view of some rows."""

    shapes: np.ndarray
    bags: list[_Bag]

    def __len__(self) -> int:
        return len(self.bags)

    def rows(self, at: np.ndarray) -> Texts:
        return Texts(self.shapes[at], [self.bags[i] for i in at])

    def plus(self, other: Texts) -> Texts:
        return Texts(np.vstack([self.shapes, other.shapes]), self.bags + other.bags)


def fit_text(x: Texts, y: np.ndarray, weight: np.ndarray, epochs: int = 4, rate: float = 0.4, seed: int = 9) -> TextModel:
    """Stochastic gradient descent with a step of its own for each weight."""
    scale = x.shapes.std(0)
    m = TextModel(x.shapes.mean(0), np.where(scale > 1e-9, scale, 1.0), np.zeros(x.shapes.shape[1] + 1), np.zeros(BUCKETS))
    z = np.column_stack([np.ones(len(x)), np.clip((x.shapes - m.mean) / m.scale, -8, 8)])
    shares = [b[1] / max(b[1].sum(), 1) for b in x.bags]
    dense, words, rng = np.full(z.shape[1], 1e-6), np.full(BUCKETS, 1e-8), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            kinds, share = x.bags[i][0], shares[i]
            g = weight[i] * (sigmoid(np.clip(z[i] @ m.weights + m.table[kinds] @ share, -30, 30)) - y[i])
            step = g * z[i]
            dense += step * step
            m.weights -= rate * 0.25 * step / np.sqrt(dense)
            step = g * share
            words[kinds] += step * step
            m.table[kinds] -= rate * step / np.sqrt(words[kinds])
    return m


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0) -> Logistic:
    """Newton steps on the weighted, ridge-penalised log loss."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], l2)
    ridge[0] = 1e-6
    for _ in range(25):
        p = sigmoid(np.clip(z @ w, -30, 30))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)


def calibrate(m: Logistic | TextModel, raw: np.ndarray, y: np.ndarray) -> None:
    """A straight line of the log-odds (Platt), on rows that the view was not fitted on."""
    if len(y) < 20 or y.min() == y.max():
        return
    line = fit_logistic(raw[:, None], y, np.ones(len(y)), l2=0.01)
    slope = float(line.weights[1] / line.scale[0])
    if slope > 0:
        m.slope, m.offset = slope, float(line.weights[0] - slope * line.mean[0])


@dataclass
class Model:
    text: TextModel | None = None
    meta: Logistic | None = None
    blend: tuple[float, float, float] = (0.0, 1.0, 1.0)

    def scores(self, texts: list[str], xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text view, of the metadata view and of both."""
        return self.scores_of(Texts(np.array([shape_features(t) for t in texts]), [bag(t) for t in texts]), xm)

    def scores_of(self, x: Texts, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            half = np.full(len(x), 0.5)
            return half, half, half
        a = self.text.log_odds(self.text.raw_rows(x))
        b = self.meta.log_odds(self.meta.raw(xm))
        return sigmoid(a), sigmoid(b), sigmoid(self.blend[0] + self.blend[1] * a + self.blend[2] * b)


def surest(p: np.ndarray, taken: dict[int, float], share: float, base: float, sure: float) -> dict[int, float]:
    """Pseudo-labels: of each class the rows that the view is surest of and that have none yet, in proportion to the classes."""
    n, out = max(1, int(share * len(p))), {}
    for order, label, most in ((np.argsort(-p, kind="stable"), 1.0, int(n * base) + 1), (np.argsort(p, kind="stable"), 0.0, int(n * (1 - base)) + 1)):
        certain = [int(i) for i in order if (p[i] if label else 1 - p[i]) >= sure and i not in taken]
        out.update(dict.fromkeys(certain[:most], label))
    return out


@dataclass
class Given:
    """Pseudo-labelled rows of one round: those that the metadata view gives the text view, and those that it is given."""

    texts: Texts
    text_labels: np.ndarray
    meta: np.ndarray
    meta_labels: np.ndarray

    def __len__(self) -> int:
        return len(self.text_labels) + len(self.meta_labels)


class HeldPool:
    """Unlabelled rows in memory."""

    def __init__(self, ut: Texts, um: np.ndarray, share: float, sure: float):
        self.ut, self.um, self.share, self.sure = ut, um, share, sure
        self.to_text, self.to_meta = {}, {}  # rows and labels given so far

    def give(self, text: TextModel, meta: Logistic, base: float) -> Given:
        new_meta = surest(sigmoid(text.log_odds(text.raw_rows(self.ut))), self.to_meta, self.share, base, self.sure) if len(self.ut) else {}
        new_text = surest(sigmoid(meta.log_odds(meta.raw(self.um))), self.to_text, self.share, base, self.sure) if len(self.ut) else {}
        self.to_meta.update(new_meta)
        self.to_text.update(new_text)
        kt, km = (np.fromiter(d, int, len(d)) for d in (new_text, new_meta))
        return Given(self.ut.rows(kt), np.array([*new_text.values()]), self.um[km], np.array([*new_meta.values()]))


def co_train(xt: Texts, xm: np.ndarray, y: np.ndarray, ut: Texts, um: np.ndarray, rounds: int = 4, share: float = 0.05, sure: float = 0.95, seed: int = 3) -> Model:
    """xt, xm, y: labelled rows; ut, um: unlabelled rows in memory."""
    return co_train_with(xt, xm, y, HeldPool(ut, um, share, sure), rounds, seed)


def co_train_with(xt: Texts, xm: np.ndarray, y: np.ndarray, pool: HeldPool | StoredPool, rounds: int = 4, seed: int = 3) -> Model:
    """A pseudo-label weighs half of a label."""
    if len(y) < 20 or y.min() == y.max():
        return Model()
    order = np.random.default_rng(seed).permutation(len(y))
    n_cal = len(y) // 4 if len(y) >= 80 else 0
    cal, tr = order[:n_cal], order[n_cal:]
    if y[tr].min() == y[tr].max():
        return Model()
    base = float(y[tr].mean())
    given = Given(Texts(np.zeros((0, SHAPES)), []), np.zeros(0), np.zeros((0, META_FEATURES)), np.zeros(0))

    def fitted() -> tuple[TextModel, Logistic]:
        weights = [np.concatenate([np.ones(len(tr)), np.full(len(labels), 0.5)]) for labels in (given.text_labels, given.meta_labels)]
        text = fit_text(xt.rows(tr).plus(given.texts), np.concatenate([y[tr], given.text_labels]), weights[0])
        meta = fit_logistic(np.vstack([xm[tr], given.meta]), np.concatenate([y[tr], given.meta_labels]), weights[1])
        calibrate(text, text.raw_rows(xt.rows(cal)), y[cal])
        calibrate(meta, meta.raw(xm[cal]), y[cal])
        return text, meta

    text, meta = fitted()
    for _ in range(rounds):
        new = pool.give(text, meta, base)
        if not len(new):
            break
        given = Given(
            given.texts.plus(new.texts), np.concatenate([given.text_labels, new.text_labels]), np.vstack([given.meta, new.meta]), np.concatenate([given.meta_labels, new.meta_labels])
        )
        text, meta = fitted()
    model = Model(text, meta)
    if n_cal and y[cal].min() < y[cal].max():
        both = fit_logistic(np.column_stack([text.log_odds(text.raw_rows(xt.rows(cal))), meta.log_odds(meta.raw(xm[cal]))]), y[cal], np.ones(n_cal), l2=0.01)
        w = both.weights[1:] / both.scale
        if (w >= 0).all():
            model.blend = (float(both.weights[0] - (w * both.mean).sum()), float(w[0]), float(w[1]))
        else:
            best = int(np.argmax(w))
            model.blend = (0.0, 1.0 - best, float(best))
    return model


def _meta(batch: pa.RecordBatch) -> list[list[float]]:
    return [meta_features(*m) for m in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]


def _binary(values: list, dtype: str) -> pa.Array:
    return pa.array([np.asarray(v, dtype).tobytes() for v in values], pa.binary())


def features(documents: DataFrame) -> DataFrame:
    """Both views of each document: shapes and hashed words of its whole text, page columns; and a digest of the text."""
    views = documents.select(
        doc_id(documents).alias("doc_id"), documents["text"], documents["lang"].cast("string").alias("lang"), documents["source"].cast("string").alias("source"),
        documents["n_chars"].cast("bigint").alias("n_chars"), F.coalesce(fold(documents, 5) == 0, F.lit(False)).alias("held_out"),
        F.xxhash64(F.coalesce(documents["text"], F.lit(""))).alias("digest"),
    )

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch)
            bags = [bag(t) for t in texts]
            same = {c: batch.column(c) for c in ("doc_id", "held_out", "digest")}
            return same | {"s": _binary([shape_features(t) for t in texts], "<f8"), "m": _binary(_meta(batch), "<f8"), "k": _binary([k for k, _ in bags], "<u2"), "c": _binary([c for _, c in bags], "<u4")}

        return work

    return map_batches(views, make, FEATURES)


def _rows_of(values: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), width)


def _both(table: pa.RecordBatch | pa.Table) -> tuple[Texts, np.ndarray]:
    """The views of rows of features."""
    s, m, k, c = (table.column(x).to_pylist() for x in "smkc")
    bags = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)) for a, b in zip(k, c, strict=True)]
    return Texts(_rows_of(s, SHAPES), bags), _rows_of(m, META_FEATURES)


def _gather(rows: DataFrame, key: list[str]) -> pa.Table:
    """Rows of features at the driver, one of each key, by key. key must bound their number."""
    cut = rows.select(*key, "y", F.col("digest").alias("d"), "s", "m", "k", "c")
    one = cut.groupBy(*key).agg(F.min(F.struct("y", "d", "s", "m", "k", "c")).alias("r")).select(*key, "r.*")
    return one.toArrow().sort_by([(c, "ascending") for c in key])


@dataclass
class Best:
    """The rows that a view is surest of, each text once: log-odds for the class, digests of texts, ids."""

    odds: np.ndarray
    digest: np.ndarray
    ids: np.ndarray

    def with_rows(self, odds: np.ndarray, digest: np.ndarray, ids: np.ndarray, most: int) -> Best:
        odds, digest, ids = np.concatenate([self.odds, odds]), np.concatenate([self.digest, digest]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, digest, -odds))
        first = np.sort(np.unique(digest[order], return_index=True)[1])[:most]
        return Best(odds[order][first], digest[order][first], ids[order][first])


class StoredPool:
    """All documents of a table of features but those of the labelled sample: what each view is surest of is found by tasks over the whole table."""

    def __init__(self, table: DataFrame, ids: np.ndarray, digests: np.ndarray, exchange: int, sure: float):
        self.table, self.ids, self.exchange, self.sure = table, ids, exchange, sure
        self.gone = {"text": digests, "meta": digests}  # by the view that gave labels

    def candidates(self, text: TextModel, meta: Logistic, most: dict[int, int]) -> DataFrame:
        """Of each task the surest rows by view and class, which bounds what is ranked."""
        shared = self.table.sparkSession.sparkContext.broadcast((text, meta, self.ids, self.gone))
        least = float(np.log(self.sure / (1 - self.sure)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            text, meta, known, gone = shared.value
            best: dict[tuple[str, int], Best] = {}
            none = Best(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
            for batch in batches:
                batch = batch.filter(batch.column("doc_id").is_valid())
                if not batch.num_rows:
                    continue
                x, xm = _both(batch)
                ids, digest = (batch.column(c).to_numpy() for c in ("doc_id", "digest"))
                free = ~np.isin(ids, known)
                for view, odds in (("text", text.log_odds(text.raw_rows(x))), ("meta", meta.log_odds(meta.raw(xm)))):
                    odds = np.round(odds, 9)  # what is equal stays so in batches of any size
                    mine = free & ~np.isin(digest, gone[view])
                    for label, towards in ((1, odds), (0, -odds)):
                        at = np.flatnonzero(mine & (towards >= least))
                        best[view, label] = best.get((view, label), none).with_rows(towards[at], digest[at], ids[at], most[label])
            for (view, label), b in best.items():
                n = len(b.ids)
                yield pa.RecordBatch.from_arrays([pa.array([view] * n, pa.string()), pa.array([label] * n, pa.int32()), pa.array(b.odds), pa.array(b.digest), pa.array(b.ids)], names=["view", "label", "odds", "digest", "doc_id"])

        return self.table.select("doc_id", "digest", "s", "m", "k", "c").mapInArrow(run, "view string, label int, odds double, digest bigint, doc_id bigint")

    def give(self, text: TextModel, meta: Logistic, base: float) -> Given:
        """The surest of each view and class, in proportion to the classes; equally sure ones by their digests."""
        most = {1: int(self.exchange * base) + 1, 0: int(self.exchange * (1 - base)) + 1}
        texts = self.candidates(text, meta, most).groupBy("view", "label", "digest").agg(F.max(F.struct("odds", -F.col("doc_id"))).alias("r"))
        texts = texts.select("view", "label", "digest", F.col("r.odds").alias("odds"), (-F.col("r.col2")).alias("doc_id"))
        by_slice = Window.partitionBy("view", "label", F.pmod("digest", F.lit(SLICES))).orderBy(F.col("odds").desc(), "digest")
        left = texts.withColumn("rank", F.row_number().over(by_slice)).where(F.col("rank") <= max(most.values())).drop("rank").toArrow()
        left = left.sort_by([("view", "ascending"), ("label", "ascending"), ("odds", "descending"), ("digest", "ascending")])
        chosen = [r for (_, label), of in groupby(left.to_pylist(), itemgetter("view", "label")) for r in islice(of, most[label])]
        if not chosen:
            return Given(Texts(np.zeros((0, SHAPES)), []), np.zeros(0), np.zeros((0, META_FEATURES)), np.zeros(0))
        for view in ("text", "meta"):
            self.gone[view] = np.concatenate([self.gone[view], np.array([r["digest"] for r in chosen if r["view"] == view], np.int64)])
        picked = self.table.sparkSession.createDataFrame([(r["view"], r["doc_id"], r["digest"], r["label"]) for r in chosen], "view string, doc_id bigint, digest bigint, y int")
        got = _gather(self.table.join(F.broadcast(picked), ["doc_id", "digest"]), ["view", "doc_id"])
        by_meta, by_text = (got.filter(pa.array([v == view for v in got.column("view").to_pylist()], pa.bool_())) for view in ("meta", "text"))
        return Given(_both(by_meta)[0], by_meta.column("y").to_numpy().astype(float), _both(by_text)[1], by_text.column("y").to_numpy().astype(float))


def _stored(documents: DataFrame) -> DataFrame:
    """Features as a table in the shared folder."""
    bound_batches(documents.sparkSession)
    path = f"{shared_dir(documents.sparkSession)}/quality-features-{uuid.uuid4().hex}"
    found = features(documents)
    found.write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(found.schema).parquet(path)


def _trained(table: DataFrame, labels: DataFrame, max_rows: int, target: str, exchange: int, sure: float) -> Model:
    rows = labels.where((fold(labels, 5) != 0) & labels[target].isNotNull())
    part = int(min(1.0, max_rows / max(rows.count(), 1)) * (1 << 30)) + 1
    sample = rows.where(F.pmod(F.xxhash64(rows["doc_id"].cast("string"), F.lit("sample")), F.lit(1 << 30)) < part)
    picked = sample.groupBy(sample["doc_id"].cast("bigint").alias("doc_id")).agg(F.max(sample[target].cast("int")).alias("y"))
    got = _gather(table.join(F.broadcast(picked), "doc_id"), ["doc_id"])
    xt, xm = _both(got)
    y = (got.column("y").to_numpy() > 0).astype(float)
    pool = StoredPool(table, got.column("doc_id").to_numpy(), got.column("d").to_numpy(), exchange, sure)
    return co_train_with(xt, xm, y, pool)


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 8000, target: str = "quality", exchange: int = 400, sure: float = 0.95) -> Model:
    """Learns labels only from rows whose crc32(doc_id as text) mod 5 is not 0."""
    table = _stored(documents)
    model = _trained(table, labels, max_rows, target, exchange, sure)
    discard(table)
    return model


def _scored(table: DataFrame, model: Model) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            a, b, s = m.scores_of(*_both(batch))
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "text_score": pa.array(a), "meta_score": pa.array(b), "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())}

        return work

    return map_batches(table, make, SCHEMA)


def classify_quality(
    documents: DataFrame, labels: DataFrame, max_rows: int = 8000, model: Model | None = None, target: str = "quality", exchange: int = 400, sure: float = 0.95
) -> DataFrame:
    """Scores of both views and of their combination for each document; 1 is good. Without a model one is learned, and the scores are written to the shared folder."""
    if model is not None:
        return _scored(features(documents), model)
    table = _stored(documents)
    out = materialize(_scored(table, _trained(table, labels, max_rows, target, exchange, sure)), "quality")
    discard(table)
    return out
