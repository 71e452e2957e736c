"""Convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

A word's vector joins rows of four hashed tables: two by independent hashes of the whole word (two words
share both rows with probability 2**-(2 * bits)) and two by its first PREFIXES bytes, which tell words of
one stem that training did not see. Filters of each width slide over the words of the whole
text; the largest activation of each goes into a logistic layer. Words are maximal runs of bytes
other than ASCII punctuation, space and control characters, A-Z lower-cased.

Training is numpy on the driver over at most `most_rows` labelled rows of `most_bytes` in all, those with the
smallest hash of doc_id, so the sample is the same at every run and does not depend on the order of rows. Tables start
from the words' log odds in the sample, then all parameters are trained by Adam through the pooled
positions. A fifth of the rows is kept back to calibrate the score (Platt) and one threshold per
language; languages with too few rows take the common threshold. Labels, language, source and id are no
inputs of a score.

Defined cases: a null or empty text has the score of a text without words; very long texts are pooled
piece by piece with overlap, which gives the same maxima; no or only one class of labelled rows gives
the base rate as score; a null language takes the common threshold; repeated rows score alike, and a null id is
scored like any; columns named score, threshold or toxic are replaced, others kept; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import PLAIN, prefix_hashes

CHUNK_WORDS = 1 << 16
PREFIXES = (5, 7)
TABLES = 2 + len(PREFIXES)


@dataclass
class Model:
    bits: int = 17
    dim: int = 4
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 6
    tables: list[np.ndarray] = field(default_factory=list)
    kernels: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    offset: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3

    def rows(self, h: np.ndarray) -> list[np.ndarray]:
        """Table rows of words. h: [words, hashes of the word and of its prefixes]."""
        mask = np.uint64((1 << self.bits) - 1)
        return [(h[:, 0] & mask).astype(np.int64), *(((h[:, i] >> np.uint64(32)) & mask).astype(np.int64) for i in range(h.shape[1]))]

    def embed(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([t[r] for t, r in zip(self.tables, rows)], axis=1)

    def activations(self, words: np.ndarray) -> list[np.ndarray]:
        """Per width, the rectified activation at every position (the text is followed by zeros)."""
        n, out = len(words), []
        for w, kernel, bias in zip(self.widths, self.kernels, self.biases):
            a = words @ kernel[0]
            for k in range(1, w):
                a[: n - k] += words[k:] @ kernel[k]
            out.append(np.maximum(a + bias, 0, out=a))
        return out

    def pooled(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """[documents, filters of all widths] for the word hashes of a batch."""
        reach = max(self.widths) - 1
        n_docs, size = len(counts) - 1, len(self.widths) * self.filters
        out = np.zeros((n_docs, size), np.float32)
        pieces = [(d, a, min(a + CHUNK_WORDS + reach, e)) for d, (s, e) in enumerate(zip(counts[:-1].tolist(), counts[1:].tolist())) for a in range(s, e, CHUNK_WORDS)]
        i = 0
        while i < len(pieces):
            j, total = i, 0
            while j < len(pieces) and (j == i or total < CHUNK_WORDS):
                total += pieces[j][2] - pieces[j][1] + reach
                j += 1
            part = pieces[i:j]
            words, starts, _, pads = self.layout([h[s:e] for _, s, e in part])
            for at, (d, s, e) in zip(starts.tolist(), part):
                if s + CHUNK_WORDS < counts[d + 1]:  # the next piece begins with these words
                    pads[at + CHUNK_WORDS : at + e - s] = True
            values = []
            for a in self.activations(words):
                a[pads] = 0
                values.append(np.maximum.reduceat(a, starts, axis=0))
            np.maximum.at(out, np.array([d for d, _, _ in part]), np.concatenate(values, axis=1))
            i = j
        return out

    def layout(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """(word vectors of all texts, each followed by zeros; starts; table rows; which vectors are padding)."""
        reach = max(self.widths) - 1
        sizes = np.array([len(t) + reach for t in texts])
        starts = np.cumsum(sizes) - sizes
        keep = np.concatenate([np.arange(a, a + n - reach) for a, n in zip(starts.tolist(), sizes.tolist())])
        pads = np.ones(int(sizes.sum()), bool)
        pads[keep] = False
        found = self.rows(np.concatenate(texts))
        words = np.zeros((len(pads), TABLES * self.dim), np.float32)
        words[keep] = self.embed(found)
        rows = [np.zeros(len(pads), np.int64) for _ in found]
        for r, f in zip(rows, found):
            r[keep] = f
        return words, starts, rows, pads

    def score(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = self.pooled(h, counts) @ self.out + self.offset
        return 1 / (1 + np.exp(-(self.scale[0] * z.astype(np.float64) + self.scale[1])))


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """([words, hashes of the word and of its prefixes], words before each document and in all)."""
    h, counts = prefix_hashes(column, (0, *PREFIXES), PLAIN)
    return np.stack(h, axis=1), counts


def start(model: Model, docs: list[np.ndarray], y: np.ndarray, seed: int) -> None:
    """Tables from log odds of words in toxic and other texts, the rest small and random."""
    rng = np.random.default_rng(seed)
    model.tables = []
    for t in range(TABLES):
        seen = np.zeros((2, 1 << model.bits))
        for h, label in zip(docs, y):
            seen[label][np.unique(model.rows(h)[t])] += 1
        odds = np.log((seen[1] + 0.05) / (y.sum() + 0.1)) - np.log((seen[0] + 0.5) / ((1 - y).sum() + 1))
        table = rng.normal(0, 0.05, (1 << model.bits, model.dim)).astype(np.float32)
        table[:, 0] = np.where(seen[1] >= 3, np.clip(odds, -2, 4), -1)
        model.tables.append(table)
    model.kernels = [rng.normal(0, 0.1, (w, TABLES * model.dim, model.filters)).astype(np.float32) for w in model.widths]
    model.biases = [np.zeros(model.filters, np.float32) for _ in model.widths]
    for kernel, bias in zip(model.kernels, model.biases):
        kernel[0, 0, 0] = kernel[0, model.dim, 0] = 0.5
        kernel[0, 2 * model.dim :: model.dim, 1] = 0.5
        bias[:2] = -1.0
    model.out = np.full(len(model.widths) * model.filters, 0.1, np.float32)
    model.out[:: model.filters] = model.out[1 :: model.filters] = 0.4
    model.offset = -2.0


def train(model: Model, docs: list[np.ndarray], y: np.ndarray, epochs: int, rate: float, seed: int) -> None:
    rng = np.random.default_rng(seed)
    state: dict[str, list[np.ndarray]] = {}
    step = 0

    def adam(name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)

    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for b in range(0, len(order), 64):
            step += 1
            batch = order[b : b + 64]
            words, starts, rows, pads = model.layout([docs[d] for d in batch])
            n, place = len(batch), np.arange(len(words))
            which = np.repeat(np.arange(n), np.diff(np.append(starts, len(words))))
            pool, best = [], []
            for a in model.activations(words):
                a[pads] = 0
                top = np.maximum.reduceat(a, starts, axis=0)
                first = np.minimum.reduceat(np.where(a == top[which], place[:, None], len(words)), starts, axis=0)
                pool.append(top)
                best.append(first)
            pool = np.concatenate(pool, axis=1)
            g = ((1 / (1 + np.exp(-(pool @ model.out + model.offset))) - y[batch]) / n).astype(np.float32)
            grads = {"out": pool.T @ g, "offset": float(g.sum())}
            back = g[:, None] * model.out * (pool > 0)
            kernels, biases, touched = [], [], []
            for i, (w, p) in enumerate(zip(model.widths, best)):
                f = back[:, i * model.filters : (i + 1) * model.filters]
                biases.append(f.sum(axis=0))
                kernel = np.zeros_like(model.kernels[i])
                for k in range(w):
                    at = np.minimum(p + k, len(words) - 1)
                    kernel[k] = np.einsum("bfd,bf->df", words[at], f)
                    live = (f != 0) & ~pads[at]
                    delta = model.kernels[i][k].T[None, :, :] * f[:, :, None]
                    touched.append(([r[at][live] for r in rows], delta[live]))
                kernels.append(kernel)
            adam("out", model.out, grads["out"])
            offset = np.array([model.offset])
            adam("offset", offset, np.array([grads["offset"]]))
            model.offset = float(offset[0])
            for i in range(len(model.widths)):
                adam(f"k{i}", model.kernels[i], kernels[i])
                adam(f"b{i}", model.biases[i], biases[i])
            deltas = np.concatenate([t[1] for t in touched])
            for t in range(TABLES):
                ids, inverse = np.unique(np.concatenate([x[0][t] for x in touched]), return_inverse=True)
                if len(ids):
                    total = np.zeros((len(ids), model.dim), np.float32)
                    np.add.at(total, inverse, deltas[:, t * model.dim : (t + 1) * model.dim])
                    adam(f"t{t}", model.tables[t], total, ids)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a * z + b) by Newton steps with a weak prior towards (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * z).sum() + 0.5 * (a - 1), (p - y).sum() + 0.05 * b])
        hess = np.array([[(w * z * z).sum() + 0.5, (w * z).sum()], [(w * z).sum(), w.sum() + 0.05]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    return max(a, 0.05), b


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The cut between scores with the largest F1; ties take the highest cut."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    low = score[order[k + 1]] if k + 1 < len(y) else 0.0
    return float(np.clip((score[order[k]] + low) / 2, 0.05, 0.95))


def fit(sample: pd.DataFrame, epochs: int = 4, rate: float = 0.01, seed: int = 7, least: int = 40, **shape) -> Model:
    """sample: text, lang, toxic. A fifth of it calibrates."""
    model = Model(**shape)
    y = sample["toxic"].to_numpy(np.int64)
    docs: list[np.ndarray] = []
    for i in range(0, len(y), 256):  # the hashes of a few texts at a time, for the driver's memory
        h, counts = hashed(pa.array(sample["text"].iloc[i : i + 256].tolist(), pa.string()))
        docs += [h[a:b].copy() for a, b in zip(counts[:-1], counts[1:])]
    held = np.arange(len(y)) % 5 == 4
    start(model, [d for d, x in zip(docs, held) if not x], y[~held], seed)
    if len(set(y[~held].tolist())) < 2:
        base = float(y.mean()) if len(y) else 0.0
        model.out[:] = 0
        model.offset = float(np.log((base + 1e-3) / (1 - base + 1e-3)))
        return model
    train(model, [d for d, x in zip(docs, held) if not x], y[~held], epochs, rate, seed)
    z = np.concatenate([model.pooled(d, np.array([0, len(d)])) for d in docs]).astype(np.float64) @ model.out + model.offset
    if held.sum() and 0 < y[held].sum() < held.sum():
        model.scale = platt(z[held], y[held])
        score = 1 / (1 + np.exp(-(model.scale[0] * z[held] + model.scale[1])))
        model.threshold = best_threshold(score, y[held])
        langs = sample["lang"].to_numpy()[held]
        for lang in {x for x in langs if isinstance(x, str)}:
            own = langs == lang
            if own.sum() >= least and y[held][own].sum() >= 10:
                model.thresholds[lang] = best_threshold(score[own], y[held][own])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, most_bytes: int = 24 << 20) -> pd.DataFrame:
    """At most most_rows labelled rows (text, lang, toxic) of most_bytes in all: those of the smallest hash of
    doc_id, then of the text, that fit. Different texts of one labelled doc_id are rows of their own, repeated rows
    count once, and the larger of two labels holds. Sizes and hashes of the candidates reach the driver first, then
    the texts of the rows taken, in one piece."""
    chosen = (
        labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most_rows)
    )
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").withColumn("t", F.xxhash64("text"))
    sizes = rows.groupBy("h", "doc_id", "t").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).orderBy("h", "doc_id", "t").limit(most_rows)
    found, kept, total = sizes.toPandas(), [], 0
    for size in found["size"]:  # most_rows at most; a text that doesn't fit is passed over, not those after it
        kept.append(total + size <= most_bytes)
        total += size * kept[-1]
    taken = found[np.array(kept, bool)][["doc_id", "t"]]
    if not len(taken):
        return rows.limit(0).toPandas()
    keys = docs.sparkSession.createDataFrame(taken, "doc_id long, t long")
    return rows.join(F.broadcast(keys), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).toPandas().sort_values(["h", "doc_id", "t"])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with text, lang) and score, threshold of the language, toxic (the score reaches it); columns
    of these names that docs may have are replaced."""
    docs = docs.drop("score", "threshold", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, cut = judged(shared.value, b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array(cut), pa.array(score >= cut)], names=[*b.schema.names, "score", "threshold", "toxic"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double, threshold double, toxic boolean")


def judged(model: Model, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(score, threshold) of each row."""
    score = model.score(*hashed(b.column("text")))
    return score, np.array([model.thresholds.get(x, model.threshold) for x in b.column("lang").to_pylist()], np.float64)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score stays under their language's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, cut = judged(shared.value, b)
            yield b.filter(pa.array(score < cut))

    return docs.mapInArrow(run, docs.schema)
