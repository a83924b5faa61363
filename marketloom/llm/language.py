"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import byte_blocks, id_remainder, read_table

#: Expected number of training rows of each language, drawn by a hash of the id.
SAMPLE_ROWS = 3000
BUCKETS = 1 << 15
GRAM = 3
UNDETERMINED = "und"
#: A decoding is called ambiguous when the two nearest codewords are closer than this in score.
AMBIGUOUS = 0.2

# Bytes that are letters, or part of one; all others become a blank.
_LETTER = np.full(256, 32, np.uint8)
for _b in (*range(65, 91), *range(97, 123), *range(128, 256)):
    _LETTER[_b] = _b


def _prepared(column: str = "text") -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("binary")


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every run of GRAM bytes of a block; runs of blanks count as one, runs never cross rows."""
    if len(data) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letters = _LETTER[data]
    blank = letters == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[keep]
    letters = letters[keep].astype(np.uint32)
    code = letters[: len(letters) - GRAM + 1].copy()
    for k in range(1, GRAM):
        code = (code << np.uint32(8)) | letters[k: len(letters) - GRAM + 1 + k]
    whole = rows[: len(code)] == rows[GRAM - 1:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 15))[whole].astype(np.int64), rows[: len(code)][whole]


def codewords(n: int) -> np.ndarray:
    """Codeword bits of ``n`` classes: all distinct splits for up to seven, else splits drawn with a fixed seed (10 log2 n bits),
    no two codewords equal."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return ((splits[None, :] >> np.arange(n - 1, -1, -1)[:, None]) & 1).astype(np.int8)
    rng = np.random.default_rng(n)
    while True:
        code = rng.integers(0, 2, (n, int(10 * np.log2(n)) + 1), dtype=np.int8)
        useful = code[:, (code.sum(axis=0) > 0) & (code.sum(axis=0) < n)]
        if len(np.unique(useful, axis=0)) == n:
            return useful


class LanguageModel:
    """Weights of one binary classifier per codeword bit, and how far each is to be trusted for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        frequency = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
        ones = self.code.astype(float)
        share = lambda member: (member.T @ frequency) / np.maximum(member.sum(axis=0)[:, None], 1)
        self.weights = np.log(share(ones) / share(1 - ones)).T.astype(np.float32) if len(languages) > 1 else np.zeros((counts.shape[1], 0), np.float32)
        self.trust = np.ones(self.code.shape)
        self.scale = np.ones(self.code.shape[1])

    def margins(self, column: pa.Array) -> np.ndarray:
        """Mean log-odds of each bit over the n-grams of each text; 0 for a text without any."""
        out = np.zeros((len(column), self.weights.shape[1]))
        for first, end, data, offsets in byte_blocks(column):
            buckets, rows = gram_buckets(data, offsets)
            if len(buckets) == 0 or self.weights.shape[1] == 0:
                continue
            n = np.bincount(rows, minlength=end - first)
            present = np.flatnonzero(n)
            starts = np.searchsorted(rows, present)
            for bit in range(self.weights.shape[1]):
                out[first + present, bit] = np.add.reduceat(self.weights[buckets, bit], starts, dtype=np.float64) / n[present]
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its score, and whether another is about as near.

        The distance of a codeword is the logistic loss of the margins on its bits, weighted by trust; the score is
        the share of the nearest one when distances are turned into weights.
        """
        if self.code.shape[1] == 0:
            n = len(margins)
            return np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
        signs = 2.0 * self.code - 1
        loss = np.logaddexp(0, -signs[None] * (margins / self.scale)[:, None, :] * 2)
        distance = (loss * self.trust[None]).sum(axis=2) / self.trust.sum(axis=1)[None]
        closeness = np.exp(-3 * (distance - distance.min(axis=1, keepdims=True)))
        closeness /= closeness.sum(axis=1, keepdims=True)
        ranked = np.sort(closeness, axis=1)
        return distance.argmin(axis=1), ranked[:, -1], ranked[:, -1] - ranked[:, -2] < AMBIGUOUS


def fit_language(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on about ``sample_rows`` rows of each ``lang``; rows with a null text, lang or id are not used.

    N-gram counts per language give every bit's classifier; a second pass over the same rows measures how often each
    classifier is right for each language and how large its margins are. Both passes return one number per language
    and bucket or bit.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    number = {v: i for i, v in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    if not languages:
        return LanguageModel([], counts)
    bars = F.create_map(*[F.lit(x) for v in languages for x in (v, int(min(1.0, sample_rows / sizes[v]) * (1 << 30)))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bars[F.col("lang")]).select("lang", _prepared().alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            langs = np.array([number[v] for v in batch.column(0).to_pylist()], np.int64)
            for first, end, data, offsets in byte_blocks(batch.column(1)):
                buckets, at = gram_buckets(data, offsets)
                total += np.bincount(langs[first:end][at] * BUCKETS + buckets, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])
    found = sample.mapInArrow(counted, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[found["lang"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    model = LanguageModel(languages, counts)
    if model.code.shape[1] == 0:
        return model

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, size, seen = np.zeros(model.code.shape), np.zeros(model.code.shape), np.zeros(len(languages))
        for batch in batches:
            langs = np.array([number[v] for v in batch.column(0).to_pylist()], np.int64)
            margins = model.margins(batch.column(1))
            np.add.at(right, langs, (margins > 0) == (model.code[langs] > 0))
            np.add.at(size, langs, np.abs(margins))
            np.add.at(seen, langs, 1)
        lang, bit = (x.ravel() for x in np.indices(model.code.shape))
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bit), pa.array(right.ravel()), pa.array(size.ravel()), pa.array(seen[lang])],
                                         ["lang", "bit", "right", "size", "seen"])
    sums = sample.mapInArrow(judged, "lang long, bit long, right double, size double, seen double").groupBy("lang", "bit").agg(
        *[F.sum(c).alias(c) for c in ("right", "size", "seen")]).toPandas()
    at = sums["lang"].to_numpy(), sums["bit"].to_numpy()
    seen = np.maximum(sums["seen"].to_numpy(), 1)
    model.trust[at] = np.maximum(sums["right"].to_numpy() / seen - 0.5, 0.01)
    size = np.ones(model.code.shape)
    size[at] = sums["size"].to_numpy() / seen
    model.scale = np.maximum(size.mean(axis=0), 1e-9)
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) per row from whole texts.

    A null text, one without a letter, or any text where nothing was learned is ``und`` with score 0 and ambiguous. Repeated rows each get a row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = np.array(batch.column(2).to_pylist(), bool)
            names, score, unsure = [UNDETERMINED] * len(letters), np.zeros(len(letters)), np.ones(len(letters), bool)
            if model.languages and len(letters):
                best, score, unsure = model.decode(model.margins(batch.column(1)))
                names = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, letters)]
                score, unsure = np.where(letters, score, 0.0), unsure | ~letters
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)],
                                             ["doc_id", "lang_pred", "score", "ambiguous"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _prepared().alias("text"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, fit_language(docs.where(id_remainder("doc_id", 3) != 1)))
    return found.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")
