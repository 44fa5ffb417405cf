"""Toxicity scores from a sparse linear model that is indifferent to identity terms.

Features of a text are its words and their first 4 to 8 letters, each counted once. A logistic
regression with an L1 penalty is fitted to a bounded, documented sample of the labelled rows; a
second penalty takes every sentence of the sample that names a group, swaps the name for the others
of its set, and charges the squared change of the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rowtide.llm.common import keep, map_batches, same, table

#: At most so many labelled rows of each class are learned from, by a hash of their id.
SAMPLE = 4_000
#: Features that the fit sees: those most associated with the label in the sample.
FEATURES = 2_048
#: A feature must occur in so many rows of the sample.
LEAST_ROWS = 4
THRESHOLD = 0.3
#: Distinct words whose features a worker remembers.
MEMO = 500_000

#: Sets of terms that may stand for one another; a parameter of ``fit``.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("immigrant", "native"), ("immigrants", "natives"), ("deaf", "blind", "disabled"),
    ("old", "young"), ("american", "mexican", "chinese", "african", "european", "arab"),
)

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in range(4, 9) if len(word) > n)]


def text_features(text: str | None) -> set[str]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}


def swaps(text: str | None, groups: Iterable[tuple[str, ...]] = IDENTITIES) -> Counter:
    """``(term, stand-in)`` -> number of sentences that name the term and in which it can be swapped."""
    others = {t: [u for u in g if u != t] for g in groups for t in g}
    out: Counter = Counter()
    for sentence in _SENTENCE.split((text or "").lower()):
        named = set(_WORD.findall(sentence)) & others.keys()
        out.update((t, u) for t in named for u in others[t])
    return out


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, text: str | None, memo: dict[str, tuple[str, ...]]) -> float:
        """Probability of label 1; ``memo`` holds the known features of words met before."""
        if len(memo) > MEMO:
            memo.clear()
        words = set(_WORD.findall((text or "").lower()))
        for w in words:
            if w not in memo:
                memo[w] = tuple(f for f in word_features(w) if f in self.weights)
        found = {f for w in words for f in memo[w]}
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + exp(-z)) if z > -700 else 0.0


def held_out(name: str = "doc_id") -> Column:
    """Rows that nothing is learned from; those without an id have no labels."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, bound: int) -> tuple[DataFrame, list[int]]:
    """At most ``bound`` texts of each class, with the number of rows each class has."""
    known = same(labels, ["doc_id", "toxic"]).where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = dict(map(tuple, known.groupBy("toxic").count().collect()))
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for y in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * bound rows of two numbers
    texts = same(docs, ["doc_id", "text"]).select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    return keep(rows, "labelled"), [counts.get(y, 0) for y in (0, 1)]


def _count(sample: DataFrame, groups) -> tuple[dict[str, tuple[int, int]], dict[tuple[str, str], int]]:
    """Rows of each class that have a feature, and sentences for each swap."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[tuple[str, str], list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for f in text_features(text):
                rows.setdefault((f, ""), [0, 0])[toxic] += 1
            for pair, n in swaps(text, groups).items():
                rows.setdefault(pair, [0, 0])[toxic] += n
        cols = ([k[0] for k in rows], [k[1] for k in rows], [v[0] for v in rows.values()], [v[1] for v in rows.values()])
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["f", "u", "neg", "pos"])

    counted = map_batches(sample.select("text", "toxic"), run, "f string, u string, neg long, pos long")
    counted = keep(counted.groupBy("f", "u").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")), "features")
    pairs = {(r.f, r.u): r.neg + r.pos for r in counted.where("u <> ''").collect()}  # one for each pair of the term sets
    n = sample.agg(F.count_if(F.expr("toxic = 0")), F.count_if(F.expr("toxic = 1"))).first()
    odds = F.log((F.col("pos") + 0.5) / (n[1] + 1)) - F.log((F.col("neg") + 0.5) / (n[0] + 1))
    strength = F.abs(odds) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = counted.where((F.col("u") == "") & (F.col("neg") + F.col("pos") >= LEAST_ROWS)).orderBy(strength.desc(), "f").limit(FEATURES)
    return {r.f: (r.neg, r.pos) for r in best.collect()}, pairs


def _descend(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, size: int, swaps_: list[tuple[np.ndarray, np.ndarray, float]], l1: np.ndarray, l2: float, fair: float, steps: int) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the last coordinate is the bias, which is not penalised."""
    at = np.concatenate(rows) if len(rows) else np.array([], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weight = weight / weight.sum()

    def gradient(w: np.ndarray) -> np.ndarray:
        z = np.bincount(row, w[at], len(rows)) + w[-1]
        pull = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        g = np.append(np.bincount(at, pull[row], size) + l2 * w[:-1], pull.sum())
        for plus, minus, n in swaps_:
            change = 2 * fair * n * (w[plus].sum() - w[minus].sum())
            g[plus] += change
            g[minus] -= change
        return g

    # a diagonal bound of the curvature, so that rare features take long steps and swapped ones short ones
    spread = 0.25 * weight * (np.bincount(row, minlength=len(rows)) + 1)
    bound = np.append(np.bincount(at, spread[row], size) + l2, spread.sum())
    for plus, minus, n in swaps_:
        bound[plus] += 2 * fair * n * (len(plus) + len(minus))
        bound[minus] += 2 * fair * n * (len(plus) + len(minus))
    rate = 1 / np.maximum(bound, 1e-12)
    w = ahead = np.zeros(size + 1)
    t = 1.0
    for _ in range(steps):
        moved = ahead - rate * gradient(ahead)
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - rate[:-1] * l1, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = moved + (t - 1) / s * (moved - w)
        w, t = moved, s
    return float(w[-1]), w[:-1]


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, groups: Iterable[tuple[str, ...]] = IDENTITIES, strictness: float = 0.5, fair: float = 1.0, steps: int = 400) -> Model:
    """Fit to at most ``bound`` rows of each class that are not held out; classes count by their
    numbers of labelled rows. An L1 penalty at the level of the noise, times ``strictness``, chooses
    the features, a light L2 penalty fits them. Without rows of both classes every score is near 0
    or near 1, near 0 where there is nothing to learn from."""
    sample, counts = _sample(docs, labels, bound)
    groups = tuple(tuple(g) for g in groups)
    chosen, pairs = _count(sample, groups)
    names = sorted(chosen)
    for t in sorted({t for p in pairs for t in p}):
        names += [f for f in word_features(t) if f not in chosen and f not in names]
    index = {f: i for i, f in enumerate(names)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(index[f] for f in text_features(t) if f in index) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "at"])

    rows = map_batches(sample.select("text", "toxic"), run, "toxic int, at array<int>").collect()
    y = np.array([r.toxic for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Model(float(20 * (y.mean() - 0.5)) if len(y) else -20.0, {})
    shares = np.array([counts[0] / max(1, (y == 0).sum()), counts[1] / max(1, (y == 1).sum())])
    total = sum(pairs.values())
    apart = [([index[f] for f in word_features(u)], [index[f] for f in word_features(t)], n / total) for (t, u), n in sorted(pairs.items())]
    swaps_ = [(np.array(p), np.array(m), n) for p, m, n in apart]
    at, weight = [np.array(r["at"], np.int64) for r in rows], shares[y.astype(int)]
    share = np.bincount(np.concatenate(at), minlength=len(names)) / len(at)
    toxic = counts[1] / sum(counts)
    noise = np.sqrt(2 * np.log(max(2, len(names))) / len(at) * toxic * (1 - toxic) * np.maximum(share * (1 - share), 1 / len(at)))
    _, w = _descend(at, y, weight, len(names), swaps_, strictness * noise, 0.0, fair, steps)
    named = {i for p, m, _ in swaps_ for i in (*p.tolist(), *m.tolist())}
    chosen_at = sorted(set(np.flatnonzero(w).tolist()) | named)
    place = {old: new for new, old in enumerate(chosen_at)}
    at = [np.array([place[i] for i in a.tolist() if i in place], np.int64) for a in at]
    swaps_ = [(np.array([place[i] for i in p]), np.array([place[i] for i in m]), n) for p, m, n in apart]
    bias, w = _descend(at, y, weight, len(place), swaps_, np.zeros(len(place)), 1e-5, fair, steps)
    return Model(bias, {names[i]: float(x) for i, x in zip(chosen_at, w) if x})


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its whole text; null and empty texts get the bias.
    A column that already has the name is replaced."""
    docs = docs.drop(name)
    place = docs.columns.index("text")
    memo: dict[str, tuple[str, ...]] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [model.score(t, memo) for t in batch.column(place).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return map_batches(docs, run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, with their columns. Rows with null
    text or id are scored like any other; repeated rows are each kept or dropped."""
    model = fit(docs, labels, **options)
    name = "score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, model, name).where(F.col(name) < threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = same(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    scored = with_score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
