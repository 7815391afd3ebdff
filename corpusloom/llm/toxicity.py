"""Toxicity: classifier chains over words and their beginnings.

A chain predicts categories in order, each with a linear model of the words and of
the probabilities of the categories before it. For training, those probabilities
come from models that have not seen the row (out of fold); for use, from models of
all rows. The last category is the label ``toxic`` itself, and the threshold on it
is the one with the best F1 out of fold.

The categories before it come from the data. First every other column of the labels
that holds 0 and 1 (here: quality). Then ``KINDS`` kinds of toxic text: the toxic rows
of the training sample are grouped by the telling words that they hold, those that
are rare in clean rows, by spherical k-means from starts that lie far apart; a
kind's label is set in its rows. No word list is given, so the kinds are whatever
vocabularies, of whatever language, the toxic rows have; they carry numbers, not
meanings. A toxic row without any telling word is of no kind.

Training reads at most ``TRAIN_DOCS`` labelled documents, toxic and clean alike,
picked by a hash of the id, to find at most ``FEATURES`` words and beginnings of
words (3 to 6 letters, written ``^abc``: compounds and inflections of one stem) that
tell the two apart (documented bounds, both parameters). Every document is then
judged by its whole text.

Edge cases: null text is empty and gets the base rate; without labels of both
kinds nothing is toxic and scores are the base rate (0 without any label);
labels of unknown documents and null labels are left out, of several labels for
an id the greatest counts; rows with equal ids are judged one by one; very long
texts are judged whole; ``keep_clean`` returns all columns of its input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .shingles import words

WORD = re.compile(r"\w+")
TRAIN_DOCS, FEATURES, FOLDS, KINDS = 4000, 512, 4, 3
STEMS = (3, 4, 5, 6)
#: A telling word is in this many toxic rows at least, and in so many times the share of clean rows.
LEAST, PURE = 5, 20


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 400) -> np.ndarray:
    """Weights of a logistic model (last: intercept) by accelerated gradient descent."""
    x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    w = np.zeros(x.shape[1], dtype=x.dtype)
    decay = np.full(x.shape[1], l2 / len(x), dtype=x.dtype)
    decay[-1] = 0
    v = w.copy()
    z = np.ones(x.shape[1], dtype=x.dtype)
    for _ in range(12):  # the largest curvature, by power iteration
        z = x.T @ (x @ z)
        z /= np.linalg.norm(z) or 1
    rate = 1 / (0.25 * np.linalg.norm(x @ z) ** 2 / len(x) + decay[0] + 1e-9)
    for i in range(steps):
        step = v - rate * (x.T @ (sigmoid(x @ v) - y) / len(x) + decay * v)
        v, w = step + i / (i + 3) * (step - w), step
    return w


class Features(dict):
    """Word -> numbers of its features in ``vocabulary``, remembered up to ``most`` words."""

    def __init__(self, vocabulary: dict[str, int], most: int = 200_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        names = (word, *(f"^{word[:n]}" for n in STEMS if len(word) > n))
        found = self[word] = tuple(self.vocabulary[x] for x in names if x in self.vocabulary)
        return found


@dataclass
class Chain:
    vocabulary: dict[str, int] = field(default_factory=dict)
    categories: list[str] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5
    base: float = 0.0

    def fit(self, x: np.ndarray, labels: np.ndarray, folds: np.ndarray, clean_weight: float = 1.0) -> Chain:
        """``labels``: a column a category, the label itself last; ``clean_weight``: clean documents that a clean row stands for, by toxic ones."""
        self.base = float(labels[:, -1].mean()) if len(labels) else 0.0
        if not 0 < self.base < 1 or not x.shape[1]:  # nothing to tell apart, or by
            return self
        x = x.astype(np.float32)
        before = np.zeros((len(x), 0), dtype=np.float32)
        for c in range(labels.shape[1]):
            y, full = labels[:, c].astype(np.float32), np.concatenate([x, before], axis=1)
            out = np.zeros(len(x), dtype=np.float32)
            for k in np.unique(folds):
                held = folds == k
                w = logistic(full[~held], y[~held]) if (~held).any() else np.zeros(full.shape[1] + 1, dtype=np.float32)
                out[held] = sigmoid(full[held] @ w[:-1] + w[-1])
            self.weights.append(logistic(full, y))
            before = np.concatenate([before, out[:, None]], axis=1)
        truth = labels[:, -1] > 0
        tried = np.linspace(0.02, 0.98, 97)
        caught = np.array([(truth & (out >= t)).sum() for t in tried], dtype=np.float64)
        wrong = np.array([(~truth & (out >= t)).sum() for t in tried]) * clean_weight
        f1 = 2 * caught / (truth.sum() + caught + wrong)
        best = tried[f1 >= f1.max() - 1e-9]
        bare = float(self.score([None], Features(self.vocabulary))[0, -1])
        self.threshold = max(float((best[0] + best[-1]) / 2), float(np.nextafter(bare, 1)))  # no text is toxic for want of telling words
        return self

    def rejects(self, probs: np.ndarray) -> np.ndarray:
        return (probs[:, -1] >= self.threshold) & bool(self.weights)

    def score(self, texts: list[str | None], known: Features) -> np.ndarray:
        """Probabilities: a row a text, a column a category."""
        if not self.weights:
            return np.full((len(texts), max(1, len(self.categories))), self.base)
        n = len(self.vocabulary)
        z = np.stack([w[:n] for w in self.weights], axis=1)
        linear = np.zeros((len(texts), len(self.weights)))
        for i, text in enumerate(texts):
            hits = {f for w in WORD.findall(text.lower()) for f in known[w]} if text else ()
            if hits:
                linear[i] = z[sorted(hits)].sum(axis=0)
        probs = np.zeros_like(linear)
        for c, w in enumerate(self.weights):
            probs[:, c] = sigmoid(linear[:, c] + probs[:, :c] @ w[n:-1] + w[-1])
        return probs


def kinds(x: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """The kind, from 0, of each row of ``x`` (0 or 1 a telling word), -1 for a row of zeros: spherical k-means, a pure function of ``x``."""
    out = np.full(len(x), -1)
    rows = np.flatnonzero(x.any(axis=1))
    if not len(rows) or not k:
        return out
    unit = x[rows] / np.linalg.norm(x[rows], axis=1, keepdims=True)
    near = unit @ (unit.sum(axis=0) / np.linalg.norm(unit.sum(axis=0)))
    centres = [unit[near.argmax()]]
    while len(centres) < k:  # the row furthest from all so far
        centres.append(unit[(unit @ np.stack(centres).T).max(axis=1).argmin()])
    centres = np.stack(centres)
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(axis=1)
        sums = np.stack([unit[of == c].sum(axis=0) if (of == c).any() else centres[c] for c in range(k)])
        then = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        if np.allclose(then, centres):
            break
        centres = then
    out[rows] = (unit @ centres.T).argmax(axis=1)
    return out


def _features(text: Column) -> Column:
    named = lambda w: F.concat(F.array(w), *(F.when(F.length(w) > n, F.array(F.concat(F.lit("^"), F.substring(w, 1, n)))).otherwise(F.array().cast("array<string>")) for n in STEMS))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(words(text)), named)))


def train(documents: DataFrame, labels: DataFrame, categories: list[str] | None = None, n_kinds: int = KINDS, most: int = TRAIN_DOCS, features: int = FEATURES) -> Chain:
    """``categories``: columns of ``labels`` (0, 1 or null) to begin the chain with; by default all integer ones but doc_id and toxic."""
    if categories is None:
        categories = [f.name for f in labels.schema.fields if f.name not in ("doc_id", "toxic") and f.dataType.typeName() in ("byte", "short", "integer", "long", "boolean")]
    names = [*categories, *(f"kind_{i + 1}" for i in range(n_kinds))]
    chain = Chain(categories=[*names, "toxic"])
    most_of = lambda c: F.coalesce(F.max(F.col(f"`{c}`").cast("int")), F.lit(0))
    given = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), F.array(*map(most_of, categories)).cast("array<int>").alias("other"))
    picked = given.withColumn("u", F.xxhash64("doc_id", F.lit("toxicity")))
    halves = [picked.filter(F.col("toxic") == v).orderBy("u", "doc_id").limit(most // 2) for v in (1, 0)]
    picked = halves[0].unionByName(halves[1])  # at most ``most`` rows of a few numbers
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "other", "u", _features(F.col("text")).alias("w")).distinct().persist()
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        rows.unpersist()
        total = sum(sizes.values())
        chain.base = sizes.get(1, 0) / total if total else 0.0
        return chain
    by_word = rows.select("toxic", F.explode("w").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    pt, pc = (F.col("t") + 0.5) / (sizes[1] + 1), (F.col("c") + 0.5) / (sizes[0] + 1)
    gain = F.abs(pt - pc) / F.sqrt((pt * (1 - pt)) / sizes[1] + (pc * (1 - pc)) / sizes[0])
    best = by_word.filter((F.col("t") + F.col("c") >= 5) & (gain >= 3)).withColumn("gain", gain).orderBy(F.desc("gain"), "word").limit(features).collect()
    chain.vocabulary = {r["word"]: i for i, r in enumerate(best)}
    pure = by_word.filter((F.col("t") >= LEAST) & (F.col("t") * sizes[0] >= PURE * F.col("c") * sizes[1])).orderBy(F.desc("t"), "word").limit(features).collect()
    telling = {r["word"]: i for i, r in enumerate(pure)}
    wanted = F.array(*[F.lit(w) for w in sorted({*chain.vocabulary, *telling})]).cast("array<string>")
    sample = rows.select("doc_id", "toxic", "other", "u", F.array_intersect("w", wanted).alias("w")).orderBy("u", "doc_id", "w").collect()
    rows.unpersist()
    x, tells = (np.zeros((len(sample), len(v)), dtype=np.float32) for v in (chain.vocabulary, telling))
    y = np.zeros((len(sample), len(names) + 1), dtype=np.int64)
    for i, r in enumerate(sample):
        for place, table in ((x, chain.vocabulary), (tells, telling)):
            place[i, [table[w] for w in r["w"] if w in table]] = 1
        y[i, : len(categories)], y[i, -1] = r["other"], r["toxic"]
    toxic = np.flatnonzero(y[:, -1])
    of_kind = kinds(tells[toxic], n_kinds)
    for c in range(n_kinds):
        y[toxic[of_kind == c], len(categories) + c] = 1
    of = {r["toxic"]: r["n"] for r in given.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    return chain.fit(x, y, np.arange(len(sample)) % FOLDS, (of[0] / sizes[0]) / (of[1] / sizes[1]))


def score(documents: DataFrame, chain: Chain) -> DataFrame:
    """``documents`` with toxic (boolean), toxic_score and p_<category> columns; columns of these names are replaced."""
    ship(documents.sparkSession)
    names = [f"p_{k}" for k in chain.categories[:-1]]
    keep = documents.select(*[c for c in documents.columns if c not in {"toxic", "toxic_score", *names}])
    schema = T.StructType([*keep.schema.fields, T.StructField("toxic", T.BooleanType()), T.StructField("toxic_score", T.DoubleType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(chain.vocabulary)
        for part in batches:
            probs = chain.score(part.column("text").to_pylist(), known)
            made = [pa.array(chain.rejects(probs)), pa.array(probs[:, -1]), *(pa.array(probs[:, i] if probs.shape[1] > i else np.zeros(len(probs))) for i in range(len(names)))]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "toxic", "toxic_score", *names])

    return keep.mapInArrow(judge, schema)


def keep_clean(documents: DataFrame, chain: Chain) -> DataFrame:
    """``documents`` that the chain does not find toxic, with their own columns."""
    ship(documents.sparkSession)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(chain.vocabulary)
        for part in batches:
            yield part.filter(pa.array(~chain.rejects(chain.score(part.column("text").to_pylist(), known))))

    return documents.mapInArrow(clean, documents.schema)
