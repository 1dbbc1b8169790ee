"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of insults (plain, near a second-person word, in the worst stretch of words), rates of
obfuscated insults (digits and signs for letters, masked or stretched letters), second-person, capital and
punctuation densities, and length. Insults come from a fixed word list and from a learned one: words, and beginnings of words, that
labelled toxic texts use and others hardly do, counted by a Spark aggregation over distinct texts. Trees are grown in
numpy on the driver over dense features. The learned list and the trees see different halves of at most ``max_rows``
labelled documents (the documented bound of the sample, chosen by a hash), and a fifth of the trees' half is kept from
them to fit the calibration.

Defined cases: a null or empty text has the features of no words and is scored as any other; without usable labels every
score is 0; rows are scored one by one, so repeated rows, null ids and extra columns change nothing; labels without a
document, or null, are not learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.llm.common import bound_batches, doc_id, fold, map_batches, texts_of

SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"

# Insults and slurs against persons, in four languages.
INSULTS = frozenset(
    """
    arse arsehole ass asshole bastard bitch bollocks bullshit clown cockroach coward crap cretin cunt degenerate despicable dick dickhead
    dimwit dipshit disgrace disgusting douche douchebag dumb dumbass dumbo dunce filth filthy fool freak fuck fucker fucking
    garbage goon halfwit hate hateful hideous idiot idiotic imbecile inbred jackass jerk kill lame lazy leech liar loser lowlife lunatic
    maggot moron moronic motherfucker nasty nitwit nobody numbskull parasite pathetic pest phony pig piss prick psycho puke
    rat repulsive retard retarded rubbish savage scum scumbag shit shithead shitty shut sick sicko simpleton skank slut slimy snake sucker sucks
    stupid subhuman swine thug toad trash troll twat twit ugly useless vermin vile wanker weasel weirdo whore wimp worthless wretch
    abruti connard connasse crétin débile enculé imbécile merde ordure pourriture putain salaud salope
    abschaum arschloch blödmann depp drecksack dummkopf hurensohn miststück scheiße schlampe trottel vollidiot wichser
    basura cabrón estúpido gilipollas hijoputa idiota imbécil mierda pendejo puta tonto
    """.split()
)
# Words that address the reader.
SECOND_PERSON = frozenset("you your yours yourself youre u ur tu te toi ton tes vous votre vos du dich dir dein deine ihr euch sie usted ti tuyo vosotros".split())
FEATURES = ("insults", "distinct", "log_insults", "obfuscated", "addressed", "densest", "second_person", "capitals", "exclamations", "punctuation", "stretched", "log_words", "learned", "distinct_learned", "log_learned")
_NEAR, _STRETCH = 6, 50
_WORD = re.compile(r"[^\W\d_]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]+")
_STRETCHED = re.compile(r"(\w)\1{2,}")
_EDGE = ".,;:!?\"'()[]{}<>«»„“”…-"
# Signs that stand for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None, "_": None, "#": None, "+": "t"})
_ONE_LEFT_OUT = {w[:i] + w[i + 1 :] for w in INSULTS if len(w) >= 4 for i in range(1, len(w))}
_LONG_INSULTS = frozenset(w for w in INSULTS if len(w) >= 4)
_LONGEST = max(map(len, INSULTS))


def _disguised(token: str) -> bool:
    token = token.strip(_EDGE)
    if len(token) < 4 or token.isalpha() or not any(c.isalpha() for c in token):
        return False
    plain = token.translate(_LEET)
    if len(plain) > _LONGEST + 1:
        return False
    if plain in _LONG_INSULTS or plain.rstrip("s") in _LONG_INSULTS:
        return True
    return any(c in token for c in "*#") and plain in _ONE_LEFT_OUT


PREFIXES, MIN_WORD = (4, 5, 6), 4


class Lexicon:
    """Learned words, and beginnings of words, which end in a tilde."""

    def __init__(self, units: list[str] = ()):
        self.units = frozenset(units)
        self.starts = frozenset(u[:MIN_WORD] for u in self.units)

    def hit(self, word: str) -> bool:
        return word in self.units or any(f"{word[:k]}~" in self.units for k in PREFIXES if len(word) > k)


def units_of(text: str) -> set[str]:
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= MIN_WORD}
    return words | {f"{w[:k]}~" for w in words for k in PREFIXES if len(w) > k}


def features(text: str, lexicon: Lexicon = Lexicon()) -> list[float]:
    low = text.lower()
    words = _WORD.findall(low)
    n = max(len(words), 1)
    hits = [i for i, w in enumerate(words) if w in INSULTS or (w[-1] == "s" and w[:-1] in INSULTS)]
    disguised = sum(_disguised(t) for t in low.split() if not t.isalpha())
    stretched = 0
    if m := _STRETCHED.search(low):
        squeezed = _STRETCHED.sub(r"\1", low[m.start() - 24 if m.start() > 24 else 0 :])
        stretched = max(0, sum(w in INSULTS for w in _WORD.findall(squeezed)) - sum(w in INSULTS for w in _WORD.findall(low[m.start() - 24 if m.start() > 24 else 0 :])))
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    addressed = densest = 0
    if hits:
        at = np.array(hits)
        if you:
            j = np.searchsorted(you, at)
            y = np.array([-(10**9), *you, 10**9])
            addressed = int(np.count_nonzero(np.minimum(at - y[j], y[j + 1] - at) <= _NEAR))
        densest = int((np.searchsorted(at, at + _STRETCH) - np.arange(len(at))).max())
    chars, starts = max(len(text), 1), lexicon.starts
    learned = [w for w in words if w[:MIN_WORD] in starts and lexicon.hit(w)] if starts else []
    return [
        len(hits) / n, float(len({words[i] for i in hits})), float(np.log1p(len(hits))), disguised / n, addressed / n, float(densest), len(you) / n,
        sum(map(len, _UPPER.findall(text))) / chars, (text.count("!") + text.count("?")) / chars, sum(map(len, _PUNCTUATION.findall(text))) / chars, stretched / n, float(np.log1p(len(words))),
        len(learned) / n, float(len(set(learned))), float(np.log1p(len(learned))),
    ]


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, depth = np.zeros(len(x), np.int64), int(np.log2(len(self.feature) + 1))
        for _ in range(depth):
            right = x[np.arange(len(x)), self.feature[at]] > self.threshold[at]
            at = 2 * at + 1 + right
        return self.value[at - len(self.feature)]


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, l2: float, least: float) -> Tree:
    """A complete binary tree by levels; a node without a gainful split sends all its rows to the left."""
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(grad), np.int64)
    bins = max(len(e) for e in edges) + 1
    for level in range(depth):
        first = 2**level - 1
        local, width = node - first, 2**level
        best = np.full(width, 1e-9)
        pick = np.full((width, 2), -1)
        for f in range(binned.shape[1]):
            cell = local * bins + binned[:, f]
            g = np.bincount(cell, grad, width * bins).reshape(width, bins).cumsum(1)
            h = np.bincount(cell, hess, width * bins).reshape(width, bins).cumsum(1)
            gt, ht = g[:, -1:], h[:, -1:]
            ok = (h >= least) & (ht - h >= least)
            gain = np.where(ok, g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2), 0.0)
            k = gain.argmax(1)
            top = gain[np.arange(width), k]
            better = top > best
            best[better], pick[better, 0], pick[better, 1] = top[better], f, k[better]
        for i in range(width):
            f, k = pick[i]
            if f >= 0 and k < len(edges[f]):
                feature[first + i], threshold[first + i] = f, edges[f][k]
        code = np.array([pick[i][1] if pick[i][0] >= 0 else bins for i in range(width)])
        right = binned[np.arange(len(node)), feature[node]] > code[local]
        node = 2 * node + 1 + right
    leaf = node - inner
    g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
    return Tree(feature, threshold, -g / (h + l2))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending positions and non-decreasing values."""
    order = np.argsort(x, kind="stable")
    xs, start = np.unique(x[order], return_index=True)
    weight = np.diff([*start, len(x)]).astype(float)
    mean = np.add.reduceat(y[order].astype(float), start) / weight
    blocks: list[list[float]] = []
    for i in range(len(xs)):
        blocks.append([mean[i], weight[i], 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, k = blocks.pop()
            u = blocks[-1]
            u[0], u[1], u[2] = (u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + k
    return xs, np.concatenate([np.full(int(b[2]), b[0]) for b in blocks])


@dataclass
class Model:
    base: float = 0.0
    rate: float = 0.15
    trees: list[Tree] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] | None = None
    lexicon: Lexicon = field(default_factory=Lexicon)

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += self.rate * t.predict(x)
        return 1 / (1 + np.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a hundredth of the raw score keeps the order within a step of the calibration."""
        if not self.trees:
            return np.zeros(len(x))
        p = self.raw(x)
        if self.knots is None:
            return p
        return np.clip(0.99 * np.interp(p, *self.knots) + 0.01 * p, 0.0, 1.0)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, max_bins: int = 48, seed: int = 5) -> Model:
    if len(y) < 20 or y.min() == y.max():
        return Model()
    order = np.random.default_rng(seed).permutation(len(y))
    n_cal = len(y) // 5 if len(y) >= 100 else 0
    cal, tr = order[:n_cal], order[n_cal:]
    if y[tr].min() == y[tr].max():
        return Model()
    edges = []
    for f in range(x.shape[1]):
        v = np.unique(x[tr, f])
        if len(v) > max_bins:
            v = np.unique(np.quantile(v, np.linspace(0, 1, max_bins)))
        edges.append((v[1:] + v[:-1]) / 2)
    binned = np.column_stack([np.searchsorted(edges[f], x[tr, f]) for f in range(x.shape[1])])
    prior = y[tr].mean()
    model = Model(float(np.log(prior / (1 - prior))))
    z = np.full(len(tr), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(binned, edges, p - y[tr], p * (1 - p), depth, 1.0, 1.0)
        model.trees.append(tree)
        z += model.rate * tree.predict(x[tr])
    if n_cal and y[cal].min() < y[cal].max():
        model.knots = isotonic(model.raw(x[cal]), y[cal])
    return model


def sample(documents: DataFrame, labels: DataFrame, target: str, max_rows: int) -> DataFrame:
    """(doc_id, text, y, half) of at most max_rows labelled documents, chosen by a hash of the id; an id that has
    several labels counts once, as toxic if one of them says so. Only the sample's ids and labels are broadcast: about max_rows rows, as a hash deals them."""
    bound_batches(documents.sparkSession)
    rows = labels.where((fold(labels, 5) != 0) & labels[target].isNotNull() & labels["doc_id"].isNotNull())
    rows = rows.groupBy(rows["doc_id"].cast("bigint").alias("__key")).agg((F.max(target) > 0).cast("int").alias("y"))
    share = min(1.0, max_rows / max(rows.count(), 1))
    key = F.pmod(F.xxhash64(rows["__key"].cast("string"), F.lit("sample")), F.lit(1 << 30))
    picked = rows.where(key < int(share * (1 << 30)) + 1)
    docs = documents.select(doc_id(documents).alias("doc_id"), documents["text"])
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    return docs.join(F.broadcast(picked), docs["doc_id"] == picked["__key"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y", half.alias("half"))


def learn_lexicon(rows: DataFrame, least: int = 4, purity: float = 0.7) -> Lexicon:
    """Units of at least ``least`` distinct toxic texts, at least ``purity`` of their texts being toxic. Tasks count before the shuffle.
    The sample bounds the list: each unit takes ``least`` of its toxic texts."""
    distinct = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("y").alias("y"), F.max("text").alias("text")).select("text", "y")

    def run(batches):
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, y in zip(texts_of(batch), batch.column("y").to_pylist(), strict=True):
                (toxic if y else other).update(units_of(text))
        units = list(toxic.keys() | other.keys())
        for i in range(0, len(units), 10_000):
            part = units[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[u] for u in part], pa.int64()), pa.array([other[u] for u in part], pa.int64())], names=["unit", "a", "b"])

    counts = distinct.mapInArrow(run, "unit string, a bigint, b bigint").groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    best = counts.where((F.col("a") >= least) & (F.col("a") + 0.5 >= purity * (F.col("a") + F.col("b") + 1)))
    return Lexicon([r.unit for r in best.select("unit").collect()])


def dense_features(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": pa.array([features(t, lexicon) for t in texts_of(batch)], pa.list_(pa.float64()))}

        return work

    # an id that repeats counts once, so what reaches the driver stays within the sample's bound
    got = map_batches(rows.select("doc_id", "text", "y"), make, "doc_id bigint, y int, x array<double>").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toArrow()
    if not got.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    x, y = np.array(got["x"].to_pylist()), np.array(got["y"].to_pylist(), float)
    order = np.lexsort((*x.T, y, np.array(got["doc_id"].to_pylist())))
    return x[order], y[order]


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 20000, target: str = "toxic") -> Model:
    rows = sample(documents, labels, target, max_rows)
    lexicon = learn_lexicon(rows.where("half = 0"))
    model = fit(*dense_features(rows.where("half = 1"), lexicon))
    model.lexicon = lexicon
    return model


def score_toxicity(documents: DataFrame, labels: DataFrame, max_rows: int = 20000, model: Model | None = None) -> DataFrame:
    """Calibrated score and class of each whole text."""
    model = model or train(documents, labels, max_rows)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            s = m.score(np.array([features(t, m.lexicon) for t in texts_of(batch)]))
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())}

        return work

    held_out = F.coalesce(fold(documents, 5) == 0, F.lit(False))
    return map_batches(documents.select(doc_id(documents).alias("doc_id"), documents["text"], held_out.alias("held_out")), make, SCHEMA)
