"""Toxicity: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import byte_blocks, id_remainder, mix, read_table, text_bytes, token_hashes

#: Expected number of labelled rows of each label that the model is fitted on, drawn by a hash of the id.
SAMPLE_ROWS = 3000
THRESHOLD = 0.7

# ASCII punctuation ends a word here, so that a word means the same before a comma.
_TO_SPACE = np.arange(256, dtype=np.uint8)
_TO_SPACE[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 32


def gram_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, word pair, and pair that skips one word, of a block of texts."""
    words, rows = token_hashes(_TO_SPACE[data], offsets)
    grams, at = [words], [rows]
    for step, salt in ((1, 0xA5A5A5A5A5A5A5A5), (2, 0x5DEECE66D1234567)):
        if len(words) > step:
            whole = rows[step:] == rows[:-step]
            grams.append(mix(words[:-step] * np.uint64(0x9E3779B97F4A7C15) + words[step:] + np.uint64(salt))[whole])
            at.append(rows[step:][whole])
    return np.concatenate(grams), np.concatenate(at)


def _distinct(grams: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each gram once per row, ordered by row."""
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return grams[new], rows[new]


class Ftrl:
    """FTRL-proximal with per-coordinate rates: coordinates whose summed gradient stays below ``l1`` have weight zero."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias_z = self.bias_n = 0.0

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return -self.bias_z * self.alpha / (self.beta + np.sqrt(self.bias_n))

    def learn(self, at: np.ndarray, label: int) -> None:
        w, bias = self.weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - label
        rise = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rise * w
        self.n[at] += g * g
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha * bias
        self.bias_n += g * g


def _fit(batches: Iterator[pa.RecordBatch], epochs: int) -> Iterator[pa.RecordBatch]:
    """One bounded sample, one task: rows (label, grams) in, rows (gram, weight) out; gram 0 is the intercept."""
    parts = [(int(label), np.frombuffer(grams, np.uint64), mark) for b in batches for label, grams, mark in
             zip(*(b.column(i).to_pylist() for i in range(3)))]
    out = ["gram", "weight"]
    share = sum(p[0] for p in parts) / max(len(parts), 1)
    if len({p[0] for p in parts}) < 2:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([35.0 if parts and parts[0][0] else -35.0])], out)
        return
    parts.sort(key=lambda p: p[2])
    held, count = np.unique(np.concatenate([p[1] for p in parts]), return_counts=True)
    l1 = 0.12 * np.sqrt(len(parts))  # the gradient of a gram without meaning grows like this root
    held = held[count * epochs > l1]  # a gradient is below 1 and without weight only gradients add up: rarer grams stay at zero
    docs = []
    for label, grams, _ in parts:
        at = np.searchsorted(held, grams)
        docs.append((label, at[held[np.minimum(at, max(len(held) - 1, 0))] == grams] if len(held) else at[:0]))
    model = Ftrl(len(held), l1=l1)
    for _ in range(epochs):
        for label, at in docs:
            model.learn(at, label)
    weights = model.weights()
    kept = np.flatnonzero(weights)
    even = model.bias() - np.log(share / (1 - share))  # the share of toxic rows in the sample is no evidence about a text
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.uint64(0), held[kept]].view(np.int64)), pa.array(np.r_[even, weights[kept]])], out)


class ToxicityModel:
    """Sparse weights by 64-bit gram hash, and the intercept."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, intercept: float):
        order = np.argsort(grams)
        self.grams, self.weights, self.intercept = grams[order], weights[order], intercept

    def scorer(self):
        grams, weights, intercept = self.grams, self.weights, self.intercept

        def score(column: pa.Array) -> np.ndarray:
            out = np.full(len(column), intercept)
            maybe = np.zeros(1 << 20, bool)
            maybe[grams & np.uint64((1 << 20) - 1)] = True
            for first, end, data, offsets in byte_blocks(column):
                h, rows = gram_hashes(data, offsets)
                pick = maybe[h & np.uint64((1 << 20) - 1)]
                h, rows = _distinct(h[pick], rows[pick])
                at = np.minimum(np.searchsorted(grams, h), max(len(grams) - 1, 0))
                hit = grams[at] == h if len(grams) else np.zeros(len(h), bool)
                out[first:end] += np.bincount(rows[hit], weights[at[hit]], minlength=end - first)
            return 1 / (1 + np.exp(-np.clip(out, -35, 35)))
        return score


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = 8) -> ToxicityModel:
    """Fit on about ``sample_rows`` labelled documents of each label, drawn by a hash of doc_id; scores are for an even prior.

    The drawn ids, about twice ``sample_rows`` of them whatever the input, are sent to the tasks: texts are not shuffled to be drawn.
    Rows with a null id, label or text are not used; of equal texts under one label one is used. Without both labels the score
    is constant. Features are built by the tasks; one task fits the bounded sample; its non-zero weights come back.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rate = {k: min(1.0, sample_rows / n) for k, n in counts.items()}
    bar = F.when(F.col("toxic") == 1, int(rate.get(1, 0) * (1 << 30))).otherwise(int(rate.get(0, 0) * (1 << 30)))
    rows = docs.where("text is not null").select("doc_id", text_bytes().alias("text")).join(F.broadcast(known.where(place < bar)), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, end, data, offsets in byte_blocks(batch.column(1)):
                h, at = _distinct(*gram_hashes(data, offsets))
                cuts = np.searchsorted(at, np.arange(end - first + 1))
                out += [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            marks = [int(np.bitwise_xor.reduce(np.frombuffer(x, np.uint64), initial=0)) >> 1 for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(marks, pa.int64())], ["label", "grams", "mark"])
    drawn = rows.select("toxic", "text").mapInArrow(features, "label int, grams binary, mark long").dropDuplicates(["label", "mark"])
    found = drawn.repartition(1).mapInArrow(lambda batches: _fit(batches, epochs), "gram long, weight double").toPandas()
    grams, weights = found["gram"].to_numpy().view(np.uint64), found["weight"].to_numpy()
    intercept = float(weights[grams == 0][0]) if (grams == 0).any() else -35.0
    return ToxicityModel(grams[grams != 0], weights[grams != 0], intercept)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) per row from whole texts; null and empty texts get the score of a text without words."""
    score = model.scorer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)))], ["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(id_remainder("doc_id", 3) != 1))
    return score_toxicity(docs, model).select(
        "doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
