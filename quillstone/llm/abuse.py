"""Scores of abusive, hateful or sexual passages: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A text is a row of passages (sentences and lines). A passage's features are hashes of its words, of runs of two and three
words and of pairs that skip one or two words, over words undone of common disguises (look-alike letters, digits and signs
for letters, spaced-out and starred-out words, invisible characters, damage by markup). A document's score is that of
its worst passage, so that long texts score like short ones. Labels say only that some passage of a document is
abusive: training runs over passages, taking the worst one by the present weights of every document each round.

Reviewers err: labels that a model fitted on the other folds contradicts strongly are left out of the final fit.
Fitted on at most ``MAX_LABELLED`` labelled documents of at most ``MAX_CHARS`` characters together, whole texts chosen by a
hash of their id, and the threshold by cross-validation on the same; scores cover all documents. The fit runs in one task of an
executor. L1 leaves a few thousand weights other than 0; they alone come back and are sent to the workers.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_LABELLED = 8_000  # labelled documents that the fit sees at most
MAX_CHARS = 64_000_000  # and their characters together
BITS = 21
RATE = 0.05  # of abusive documents for which the threshold is chosen, where labels are an enriched sample; a higher share of the labels stands
DOUBT = (-1.0, 1.5)  # a positive label below, a negative label above this held-out score is taken for a reviewer's slip
CHARS_AT_ONCE = 1_000_000
KEPT_WORDS = 300_000

# Letters of other scripts, and signs and digits inside words, that stand for a Latin letter
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e"}

_ALIKE = str.maketrans(LOOK_ALIKES)
_SIGN = str.maketrans(SIGNS)
_DROP = re.compile("[\u200b-\u200f\u202a-\u202e\u2060-\u206f\u00ad\ufeff\ufffd\u0300-\u036f\ufe00-\ufe0f]+")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W\d_])")
_TAG = re.compile(r"<[^<>]{1,80}>|\[[A-Z]{2,5}\]")
_EDGE = "\"'“”„«»‘’‚()[]{}<>,;:…—–-/\\#~^`=&%_"
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_PIECE = re.compile(r"[^\W\d_]+|\d+")
_NEW, _JOINED = "\x01", "\x02"  # stand for the end of a passage, and for a word that was spaced out


def plain_text(text: str) -> str:
    """Without markup, invisible characters and accents, in lower case, with spaced-out words joined."""
    if "&" in text:
        text = html.unescape(text)
    text = re.sub(r"[\r\n  ]+", f" {_NEW} ", _TAG.sub(" ", text))
    if not text.isascii():
        text = _DROP.sub("", unicodedata.normalize("NFKD", text))
    text = text.lower()
    return _SPACED.sub(lambda m: f" {_JOINED} " + re.sub(r"[ .\-_*]", "", m.group()) + " ", text)


def _words(chunk: str) -> tuple[list[int], bool, list[int]]:
    """Hashes of the words of a piece of text without blanks, whether it ends a passage, and marks of disguise.

    Marks don't stand between words, so that a disguised word keeps its neighbours.
    """
    hashes = lambda ws: [crc32(w.encode()) | 1 for w in ws]
    if chunk == _NEW:
        return [], True, []
    if chunk == _JOINED:
        return [], False, hashes(["\x02spaced"])
    core = chunk.strip(_EDGE)
    ends = core[-1:] in ".!?。！？"
    body = core.rstrip(".!?。！？")
    out: list[str] = []
    marks: list[str] = []
    if not body:
        return [], ends, []
    if _CJK.search(body):
        out = [c for c in body if c.isalnum()]
        ends = ends or "。" in body
    elif "*" in body and re.search(r"[^\W\d_]\*+", body):
        out, marks = [f"{body[0]}*{len(body)}*{body[-1]}"], ["\x02starred", re.sub(r"\*+", "*", body)]
    else:
        if not body.isascii():
            latin = body.translate(_ALIKE)
            if latin.isascii() and latin != body:
                body = latin
        if not body.isalpha() and re.search(r"[^\W\d_]", body) and re.fullmatch(r"[^\W_@$!|+€'’-]*(?:[@$!|+€\d][^\W_'’-]*)+", body) and not re.fullmatch(r"[a-z]{0,2}\d+[a-z]{0,2}|[$€]?[\d.,]+[a-z]?", body):
            out, marks = _PIECE.findall(body.translate(_SIGN)), ["\x02signs"]
        else:
            out = ["0" if p[0].isdigit() else p for p in _PIECE.findall(body)]
    return hashes(out), ends, hashes(marks)


class Featurizer:
    """Texts to hashed features."""

    def __init__(self, bits: int = BITS):
        self.bits, self.known = bits, {}

    def _rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids: list[int] = []
        passages: list[int] = []
        docs = [0]
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known = self.known
        for t in texts:
            start, marks = len(ids), []
            for chunk in plain_text(t).split() if t else ():
                w = known.get(chunk)
                if w is None:
                    w = known[chunk] = _words(chunk)
                if w[0]:
                    ids += w[0]
                if w[2]:
                    marks += w[2]
                if w[1] and len(ids) > start:
                    ids += marks
                    passages.append(start)
                    start, marks = len(ids), []
            if len(ids) > start:
                ids += marks
                passages.append(start)
            docs.append(len(passages))
        return np.array(ids, np.uint64), np.array(passages, np.int64), np.array(docs, np.int64)

    def _runs(self, w: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(feature ids, passage of each) by kind: words, runs of two and three, pairs that skip one and two."""
        n = len(w)
        mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - self.bits)
        if n:
            yield (w * mix) >> shift, of
        for kind, gaps in ((2, (1,)), (3, (1, 2)), (4, (2,)), (5, (3,))):
            far = gaps[-1]
            if n <= far:
                continue
            same = of[:-far] == of[far:]
            h = w[:-far] * np.uint64(kind * 0x100000001B3) + np.uint64(kind)
            for g in gaps:
                h = (h ^ (h >> np.uint64(29))) * mix + w[g : n - far + g]
            h = (h ^ (h >> np.uint64(31))) * mix
            yield h[same] >> shift, of[:-far][same]

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature ids by passage, start of each passage, start of each document in passages)."""
        w, at, docs = self._rows(texts)
        runs = list(self._runs(w, np.repeat(np.arange(len(at)), np.diff(np.append(at, len(w))))))
        if not runs:
            return np.zeros(0, np.int32), at, docs
        feature, passage = np.concatenate([f for f, _ in runs]).astype(np.int32), np.concatenate([p for _, p in runs])
        order = np.argsort(passage, kind="stable")
        return feature[order], np.searchsorted(passage[order], np.arange(len(at))), docs

    def weighed(self, texts: list[str | None], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the weights of each passage's differing features, start of each document in passages)."""
        w, at, docs = self._rows(texts)
        keys = []
        for feature, passage in self._runs(w, np.repeat(np.arange(len(at)), np.diff(np.append(at, len(w))))):
            hit = np.flatnonzero(weight[feature])  # few: most weights are 0
            keys.append(passage[hit].astype(np.int64) << 32 | feature[hit].astype(np.int64))
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key  # a passage's feature counts once
        return np.bincount(key >> 32, weight[key & 0xFFFFFFFF], len(at)), docs


@dataclass
class Model:
    """Weights other than 0, the bias, and the score from which a document counts as abusive."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    threshold: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w


class Passages:
    """Feature sets of the passages of documents, end to end, over the features that occur at all."""

    def __init__(self, features: np.ndarray, starts: np.ndarray, docs: np.ndarray):
        """``starts``: where each passage's features begin; ``docs``: where each document's passages begin, and their number at the end."""
        self.index, self.at = np.unique(features, return_inverse=True)
        self.starts, self.docs = starts, docs
        self.ends = np.append(starts[1:], len(features))

    def of(self, passage: int) -> np.ndarray:
        return self.at[self.starts[passage] : self.ends[passage]]

    def sums(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.at], self.starts) if len(self.starts) else np.zeros(0)


class Ftrl:
    """FTRL-proximal with rates for each coordinate and L1, over sets of features. Weights and roots are kept up to date with what they follow from."""

    def __init__(self, n: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1.0, l2: float = 4.0):
        self.z, self.n, self.root, self.w = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias = self.bz = self.bn = 0.0

    def update(self, f: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.w[f]
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, w.sum() + self.bias))))
        g = (p - label) * weight
        n = self.n[f] + g * g
        root = np.sqrt(n)
        z = self.z[f] + (g - (root - self.root[f]) / self.alpha * w)
        self.z[f], self.n[f], self.root[f] = z, n, root
        self.w[f] = (np.clip(z, -self.l1, self.l1) - z) / ((self.beta + root) / self.alpha + self.l2)
        self.bz += g - ((self.bn + g * g) ** 0.5 - self.bn**0.5) / self.alpha * self.bias
        self.bn += g * g
        self.bias = -self.bz / ((self.beta + self.bn**0.5) / self.alpha)


def _worst(scores: np.ndarray, docs: np.ndarray, none: float) -> np.ndarray:
    out = np.full(len(docs) - 1, none)
    full = np.flatnonzero(np.diff(docs))
    if len(full):
        out[full] = np.maximum.reduceat(scores, docs[full])
    return out


def _fit(p: Passages, y: np.ndarray, use: np.ndarray, rounds: int = 6) -> Ftrl:
    """A model of the documents ``use``. Each round takes a document's worst passage by the weights at the round's start, of a negative one the second worst too, for a margin."""
    m = Ftrl(len(p.index))
    positive = max(1, int(y[use].sum()))
    up = min(3.0, max(1.0, (len(use) - positive) / positive))
    for r in range(rounds):
        sums = p.sums(m.w) if r else None
        for i in use[np.random.default_rng(7 + r).permutation(len(use))]:
            a, z = p.docs[i], p.docs[i + 1]
            if a == z:
                continue
            if r == 0:  # no weights yet: every passage carries the label of its document, a positive one in part
                share = up / (z - a) if y[i] else 1.0
                for k in range(a, z):
                    m.update(p.of(k), y[i], share)
                continue
            order = a + np.argsort(sums[a:z])
            m.update(p.of(order[-1]), y[i], up if y[i] else 1.0)
            if not y[i] and z - a > 1:
                m.update(p.of(order[-2]), 0)
    return m


def _held_out(p: Passages, y: np.ndarray, use: np.ndarray, folds: int = 3) -> np.ndarray:
    """Scores of all documents by models that saw the other folds' ``use``."""
    out = np.zeros(len(y))
    for k in range(folds):
        m = _fit(p, y, use[use % folds != k])
        at = np.arange(k, len(y), folds)
        out[at] = (_worst(p.sums(m.w), p.docs, -30.0) + m.bias)[at]
    return out


def best_threshold(scores: np.ndarray, y: np.ndarray, rate: float = 1.0) -> float:
    """The middle of the longest run of thresholds with the best F1, with negatives weighed as if at most ``rate`` of all were positive."""
    steps = np.arange(-60, 61) / 20
    weight = max(1.0, (1 - rate) / rate * (y == 1).sum() / max(1, (y == 0).sum()))
    caught = [((scores >= t) & (y == 1)).sum() for t in steps]
    f1 = [2 * c / max(1, c + weight * ((scores >= t) & (y == 0)).sum() + (y == 1).sum()) for c, t in zip(caught, steps)]
    runs, best = [], max(f1)
    for t, f in zip(steps, f1):
        if f == best:
            if runs and t - runs[-1][1] < 0.06:
                runs[-1][1] = t
            else:
                runs.append([t, t])
    a, z = max(runs, key=lambda r: (r[1] - r[0], -abs(r[0])))
    return float((a + z) / 2)


def train(p: Passages, y: np.ndarray) -> Model:
    held = _held_out(p, y, np.arange(len(y)))
    kept = np.flatnonzero(~(((y == 1) & (held < DOUBT[0])) | ((y == 0) & (held > DOUBT[1]))))
    threshold = best_threshold(_held_out(p, y, kept)[kept], y[kept], RATE)
    m = _fit(p, y, kept)
    on = np.flatnonzero(m.w)
    return Model(p.index[on].astype(np.int32), m.w[on].astype(np.float32), m.bias, threshold)


def _sample(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """(doc_id, text, label) of the labelled documents that the fit sees. Only ids and lengths pass through the one task that chooses."""
    rows = labelled.where(F.col(label).isNotNull()).select("doc_id", F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    sizes = rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "n").limit(MAX_LABELLED)
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "n").rowsBetween(Window.unboundedPreceding, 0))  # over the chosen few
    chosen = sizes.withColumn("upto", upto).where(F.col("upto") <= MAX_CHARS).select("doc_id").distinct()
    return rows.join(F.broadcast(chosen), "doc_id")  # at most MAX_LABELLED ids


def fit(labelled: DataFrame, text: str = "text", label: str = "abusive") -> Model:
    """A model from rows (doc_id, text, label 0 or 1), one a document; those of ``_sample`` are used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer()
        for b in batches:
            feature, starts, docs = make.features(b.column(1).to_pylist())
            ends = np.append(starts[1:], len(feature))
            sets = [[np.unique(feature[s:e]) for s, e in zip(starts[a:z], ends[a:z])] for a, z in zip(docs, docs[1:])]
            sizes = pa.array([[len(x) for x in ss] for ss in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), sizes, pa.array([np.concatenate(ss) if ss else [] for ss in sets], pa.list_(pa.int32()))], ["doc_id", "label", "sizes", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, sizes, features = [], [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
            sizes += [np.array(x, np.int64) for x in b.column(2).to_pylist()]
            features += [x.values.to_numpy() for x in b.column(3)]
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        y = np.array(labels, np.int64)[order]
        if y.any():
            lengths = np.concatenate([sizes[i] for i in order])
            docs = np.append(0, np.cumsum([len(sizes[i]) for i in order]))
            m = train(Passages(np.concatenate([features[i] for i in order]), np.append(0, np.cumsum(lengths)[:-1]), docs), y)
            yield pa.RecordBatch.from_arrays([pa.array([m.index], pa.list_(pa.int32())), pa.array([m.weight], pa.list_(pa.float32())), pa.array([m.bias]), pa.array([m.threshold])], ["index", "weight", "bias", "threshold"])

    made = _sample(labelled, text, label).mapInArrow(run, "doc_id bigint, label int, sizes array<int>, features array<int>")
    got = made.repartition(1).mapInArrow(learn, "index array<int>, weight array<float>, bias double, threshold double").toArrow()
    if not got.num_rows:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), -30.0, 0.0)
    return Model(got["index"][0].values.to_numpy(), got["weight"][0].values.to_numpy(), got["bias"][0].as_py(), got["threshold"][0].as_py())


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score double, abusive boolean)`` of every row. Null and empty texts have the score 0 and aren't abusive.

    The score is the probability of the worst passage; repeated rows are scored each.
    """

    source = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, w = Featurizer(model.bits), model.dense()
        for b in batches:
            texts, out, i = b.column(1).to_pylist(), [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < CHARS_AT_ONCE):
                    size += len(texts[j] or "")
                    j += 1
                sums, docs = make.weighed(texts[i:j], w)
                out.append(_worst(sums + model.bias, docs, -60.0))
                i = j
            s = np.concatenate(out) if out else np.zeros(0)
            p = np.where(s <= -60, 0.0, 1 / (1 + np.exp(-np.clip(s, -30, 30))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((s >= model.threshold) & (s > -60))], ["doc_id", "score", "abusive"])

    return source.mapInArrow(run, "doc_id bigint, score double, abusive boolean")


def settled_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, abusive) where the reviewers' votes other than null have a majority."""
    votes = labels.where("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("abusive").alias("mean"))
    return votes.where("mean <> 0.5").select("doc_id", (F.col("mean") > 0.5).cast("int").alias("abusive"))


def fit_documents(documents: DataFrame, labels: DataFrame) -> Model:
    return fit(settled_labels(labels).join(documents.select("doc_id", "text"), "doc_id"))


def rates(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """``(source, n_docs, n_abusive, rate, mean_score)``."""
    both = documents.select("doc_id", "source").join(scored, "doc_id")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
