"""Language ID: a byte convolutional network, trained and applied in NumPy.

Filters of widths 2, 3 and 4 slide over the UTF-8 bytes of a fixed-length
window; each is max-pooled over the window and rectified, a dense layer with
softmax follows. Bytes are one-hot, so a filter is a table of one row a byte
and place; for use, the tables of two neighbouring bytes are added up front.
Every window of a whole text is judged, in batches, and a text's language is
that of the greatest mean probability, windows weighted by their bytes.

Training reads at most ``DOCS_PER_LANGUAGE`` different texts of each language, picked
by a hash of the text, and of each at most ``WINDOWS_PER_DOC`` windows, evenly spread
(documented bounds, both parameters).

Edge cases: null text, or text without a letter, is ``und`` with score 0; a
text shorter than a window is padded; very long texts are judged window by
window; without labelled text everything is ``und``; equal texts get equal
answers; repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
DOCS_PER_LANGUAGE = 1000
WINDOWS_PER_DOC = 3
#: Letters, and some numbers that Python counts as parts of words.
LETTER = re.compile(r"[^\W\d_]")
#: Windows judged at once.
BATCH = 512


def has_letter(text: str) -> bool:
    """Whether a character of ``text`` is a letter by its Unicode category."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def windows(data: bytes) -> np.ndarray:
    """All windows of ``data``, zero-padded: rows of WINDOW bytes."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    def __init__(self, classes: list[str], filters: int = FILTERS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.params = {f"w{w}": rng.normal(0, 0.1, (w, 256, filters)) for w in WIDTHS}
        self.params |= {f"b{w}": np.zeros(filters) for w in WIDTHS}
        self.params |= {"v": rng.normal(0, 0.1, (filters * len(WIDTHS), len(classes))), "c": np.zeros(len(classes))}

    def gradient(self, xb: np.ndarray, yb: np.ndarray, decay: float = 1e-4) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy (and ``decay`` / 2 times the squares of v); a pooled filter passes it at its best place only."""
        p, best, pooled = self.params, {}, []
        for w in WIDTHS:
            n = WINDOW - w + 1
            conv = sum(p[f"w{w}"][j][xb[:, j : j + n]] for j in range(w))
            best[w] = conv.argmax(axis=1)
            pooled.append(np.take_along_axis(conv, best[w][:, None, :], axis=1)[:, 0] + p[f"b{w}"])
        h = np.maximum(np.concatenate(pooled, axis=1), 0)
        z = h @ p["v"] + p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(len(xb)), yb] -= 1
        d /= len(xb)
        grad = {"v": h.T @ d + decay * p["v"], "c": d.sum(axis=0)}
        dh = (d @ p["v"].T) * (h > 0)
        f = p["b2"].shape[0]
        for i, w in enumerate(WIDTHS):
            g = dh[:, i * f : (i + 1) * f]
            grad[f"b{w}"] = g.sum(axis=0)
            dw = np.zeros_like(p[f"w{w}"])
            lane = np.broadcast_to(np.arange(f), g.shape)
            for j in range(w):
                np.add.at(dw[j], (np.take_along_axis(xb, best[w] + j, axis=1), lane), g)
            grad[f"w{w}"] = dw
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
        """Adam on the gradient of shuffled batches."""
        rng, p = np.random.default_rng(seed), self.params
        moments = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                step += 1
                for k, g in self.gradient(x[rows], y[rows]).items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self) -> tuple[np.ndarray, ...]:
        """For two neighbouring bytes a row: width 2; the two parts of width 3; the two of width 4."""
        w2, w3, w4 = (self.params[f"w{w}"].astype(np.float32) for w in WIDTHS)
        pair = lambda a, b: a[:, None, :] + b[None, :, :]
        none = np.zeros_like(w3[0])
        parts = [pair(w2[0], w2[1]), pair(w3[0], w3[1]), pair(none, w3[2]), pair(w4[0], w4[1]), pair(w4[2], w4[3])]
        bias = np.concatenate([self.params[f"b{w}"] for w in WIDTHS]).astype(np.float32)
        return np.concatenate(parts, axis=2).reshape(65536, -1), bias, self.params["v"].astype(np.float32), self.params["c"].astype(np.float32)


def probabilities(tables: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Class probabilities of each window in ``x``."""
    both, bias, v, c = tables
    f = both.shape[1] // 5
    out = []
    for at in range(0, len(x), BATCH):
        t = np.ascontiguousarray(x[at : at + BATCH].T)
        g = both[(t[:-1].astype(np.uint16) << 8) | t[1:]]
        two = g[..., :f].max(axis=0)
        three = (g[:-1, :, f : 2 * f] + g[1:, :, 2 * f : 3 * f]).max(axis=0)
        four = (g[:-2, :, 3 * f : 4 * f] + g[2:, :, 4 * f :]).max(axis=0)
        z = np.maximum(np.concatenate([two, three, four], axis=1) + bias, 0) @ v + c
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out.append(z / z.sum(axis=1, keepdims=True))
    return np.concatenate(out)


def train(labelled: DataFrame, per_language: int = DOCS_PER_LANGUAGE, windows_per_doc: int = WINDOWS_PER_DOC) -> Network | None:
    """A network from ``labelled`` (text, lang), none where nothing is labelled."""
    given = labelled.filter("lang is not null and text is not null").withColumn("key", F.xxhash64("text", F.lit("lang")))
    counts = {r["lang"]: r["n"] for r in given.select("lang", "key").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    u = F.shiftrightunsigned("key", 11) / F.lit(float(2**53))
    share = F.lit(None).cast("double")
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(1.1 * per_language / n)).otherwise(share)
    room = F.greatest(F.length("text") - WINDOW, F.lit(0))
    cuts = [F.substring(F.col("text"), (room * i / max(1, windows_per_doc - 1)).cast("int") + 1, F.lit(WINDOW)) for i in range(windows_per_doc)]
    rows = given.filter(u < share).select("lang", u.alias("u"), F.array_distinct(F.array(*cuts)).alias("cuts")).distinct().collect()
    classes = sorted(counts)
    x, y, taken = [], [], dict.fromkeys(classes, 0)
    for r in sorted(rows, key=lambda r: (r["u"], r["cuts"])):
        if taken[r["lang"]] < per_language:
            taken[r["lang"]] += 1
            for cut in r["cuts"]:
                if has_letter(cut):
                    x.append(windows(cut.encode())[0])
                    y.append(classes.index(r["lang"]))
                    if len(cut) > 40:  # short texts are to be told as well
                        at = len(x) % 5 * 4
                        x.append(windows(cut[at : at + 24].encode())[0])
                        y.append(y[-1])
    return Network(classes).fit(np.array(x), np.array(y)) if x else None


def predict(documents: DataFrame, network: Network | None) -> DataFrame:
    """``documents`` without text, with lang_pred and score; columns of these names are replaced."""
    ship(documents.sparkSession)
    kept = documents.select(*[c for c in documents.columns if c not in {"text", "lang_pred", "score"}])
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    tables, classes = (network.tables(), network.classes) if network else (None, [])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lang, score = np.full(part.num_rows, "und", dtype=object), np.zeros(part.num_rows)
            held: list[tuple[int, np.ndarray, int]] = []

            def flush(held=held, lang=lang, score=score) -> None:
                if held:
                    p = probabilities(tables, np.concatenate([w for _, w, _ in held]))
                    at = 0
                    for i, w, n in held:
                        weight = np.full(len(w), WINDOW, dtype=np.float64)
                        weight[-1] = max(1, n - WINDOW * (len(w) - 1))
                        mean = weight @ p[at : at + len(w)] / weight.sum()
                        lang[i], score[i] = classes[int(mean.argmax())], min(1.0, float(mean.max()))
                        at += len(w)
                    held.clear()

            waiting = 0
            for i, text in enumerate(part.column("text").to_pylist()):
                if tables is not None and text and has_letter(text):
                    data = text.encode("utf-8", "surrogatepass")
                    held.append((i, windows(data), len(data)))
                    waiting += len(held[-1][1])
                    if waiting >= BATCH:
                        flush()
                        waiting = 0
            flush()
            made = [pa.array(lang, type=pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], names=[*names, "lang_pred", "score"])

    return documents.select(*names, "text").mapInArrow(judge, schema)
