"""Quality by hierarchical empirical Bayes: evidence of the document, shrunk with what its path and host show."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import byte_blocks, fresh, id_remainder, read_table, tidy, token_hashes, token_spans, written

#: Expected number of labelled rows that the document classifier is fitted on, drawn by a hash of the id.
SAMPLE_ROWS = 20_000
KEEP = 0.5
#: Limit of the pseudo-counts with which a host or path is drawn to what stands above it.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e4
_LOGIT = 12.0

FEATURES = ["words", "distinct", "repeats", "upper", "marks", "marked_words", "digits", "word_length", "line_length", "long_words"]

_UPPER, _LOWERCASE, _DIGIT, _MARK, _LINE = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91], _LOWERCASE[97:123], _DIGIT[48:58], _LINE[10] = True, True, True, True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-"]] = True


def text_features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text: shares of words and characters, 0 for an empty text; all between 0 and about 2."""
    out = np.zeros((len(column), len(FEATURES)))
    for first, end, data, offsets in byte_blocks(column):
        if len(data) == 0:
            continue
        n = end - first
        chars = np.maximum(np.diff(offsets), 1)
        row_of = np.repeat(np.arange(n), np.diff(offsets))
        per_row = lambda mask: np.bincount(row_of[mask], minlength=n)
        starts, ends, rows = token_spans(data, offsets)
        h, _ = token_hashes(data, offsets)
        count = np.bincount(rows, minlength=n)
        words = np.maximum(count, 1)
        same = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        order = np.lexsort((h, rows))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
        mark = _MARK[data]
        total = np.r_[0, np.cumsum(mark)]
        upper, lower = per_row(_UPPER[data]), per_row(_LOWERCASE[data])
        size = ends - starts
        out[first:end] = np.c_[
            np.log1p(count) / 10, np.bincount(rows[order][new], minlength=n) / words, np.bincount(rows[1:][same], minlength=n) / words,
            upper / np.maximum(upper + lower, 1), per_row(mark) / chars, np.bincount(rows[total[ends] > total[starts]], minlength=n) / words,
            per_row(_DIGIT[data]) / chars, np.minimum(np.bincount(rows, size, minlength=n) / words / 10, 2),
            np.log1p(chars / (1 + per_row(_LINE[data]))) / 10, np.bincount(rows[size > 30], minlength=n) / words]
    return out


class QualityModel:
    def __init__(self, weights: np.ndarray, intercept: float, prior: float):
        self.weights, self.intercept, self.prior = weights, intercept, prior


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-5)), F.lit(1 - 1e-5))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Logistic regression over the text features of about ``sample_rows`` labelled documents, drawn by a hash of doc_id.

    Rows with a null id, label or text are not used. Without both labels the evidence is nil and every document keeps the prior.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("double").alias("label")).dropDuplicates(["doc_id"])
    n, good = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    prior = (float(good or 0) + 1) / (n + 2)
    bar = int(min(1.0, sample_rows / max(n, 1)) * (1 << 30))
    rows = docs.where("text is not null").select("doc_id", "text").join(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bar), "doc_id").select(
        "label", F.col("text").cast("binary").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])
    sample = written(rows.mapInArrow(features, "label double, x array<double>"), "sample")
    seen = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if len(seen) < 2:
        return QualityModel(np.zeros(len(FEATURES)), 0.0, prior)
    fitted = LogisticRegression(featuresCol="v", labelCol="label", regParam=1e-4, maxIter=60).fit(sample.select("label", array_to_vector("x").alias("v")))
    drawn_odds = np.log(seen[1.0] / seen[0.0])  # what is left is evidence: log of P(text | good) / P(text | bad)
    return QualityModel(fitted.coefficients.toArray(), float(fitted.intercept - drawn_odds), prior)


def with_evidence(docs: DataFrame, model: QualityModel, name: str = "_evidence") -> DataFrame:
    """``docs`` with the log likelihood ratio of good against bad of each whole text, within +-12; 0 for a null or empty text."""
    at, weights, intercept = docs.columns.index("text"), model.weights, model.intercept
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).fill_null(b"")
            full = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset: texts.offset + len(texts) + 1]) > 0 if len(texts) else np.zeros(0, bool)
            value = np.clip(text_features(texts) @ weights + intercept, -_LOGIT, _LOGIT) * full
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.mapInArrow(tidy(run), schema)


def _strength(rates: DataFrame, n: str, good: str, mean: Column) -> Column:
    """Pseudo-count by the method of moments: the less the groups' rates differ beyond chance, the stronger the pull."""
    p = F.col(good) / F.col(n)
    between = F.sum(F.col(n) * (p - mean) ** 2)
    chance = F.sum(mean * (1 - mean))
    spare = F.greatest((between - chance) / F.sum(n), F.lit(1e-9))
    return F.least(F.greatest(F.avg(mean * (1 - mean)) / spare - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def site_posteriors(evidence: DataFrame, model: QualityModel) -> DataFrame:
    """(_host, _path, n, good, host_rate, host_strength, path_strength): per path the soft counts and the shrunk rate of its host.

    ``evidence`` has _host, _path, _evidence. A hot host is summed before the shuffle; the shrinkage strengths
    are estimated from all hosts and from all paths. Null hosts and paths are groups like any other.
    """
    p = _sigmoid(F.col("_evidence") + F.lit(float(np.log(model.prior / (1 - model.prior)))))
    paths = written(evidence.select("_host", "_path", p.alias("p")).groupBy("_host", "_path").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("good")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    everything = paths.agg(F.sum("n"), F.sum("good")).first()
    rate = F.lit(float((everything[1] + 1) / (everything[0] + 2)) if everything[0] else 0.5)
    found = hosts.agg(_strength(hosts, "host_n", "host_good", rate)).first()[0]
    host_strength = F.lit(float(found if found is not None else LEAST_STRENGTH))
    shrunk = hosts.select(F.col("_host").alias("_h"), ((F.col("host_good") + host_strength * rate) / (F.col("host_n") + host_strength)).alias("host_rate"))
    joined = written(paths.join(shrunk, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h"), "sites")
    found = joined.agg(_strength(joined, "n", "good", F.col("host_rate"))).first()[0]
    return joined.withColumn("path_strength", F.lit(float(found if found is not None else LEAST_STRENGTH)))


def score_quality(docs: DataFrame, model: QualityModel, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """``docs`` and, last, its host, its path, the evidence of its text, its site's prior and the posterior probability that it is good.

    These five columns are called host, path, evidence, site_prior and quality, lengthened by underscores where ``docs`` has such a
    column. The prior of a document is the rate of its path without itself, shrunk to its host's rate, which is shrunk to the
    overall one; the evidence of its text moves it from there. By default the host is ``source`` and the path ``lang``.
    A null or empty text has its site's prior. Repeated rows are scored each; an empty table gives no rows.
    """
    out = fresh(docs, "host", "path", "evidence", "site_prior", "quality")
    host_of, path_of = (F.col("source") if host is None else host).cast("string"), (F.col("lang") if path is None else path).cast("string")
    seen = with_evidence(docs.select(host_of.alias("_host"), path_of.alias("_path"), "text"), model)
    h, p, n, good, rate, strength = fresh(docs, "_site_host", "_site_path", "_site_n", "_site_good", "_site_rate", "_site_strength")
    sites = site_posteriors(seen, model).select(F.col("_host").alias(h), F.col("_path").alias(p), F.col("n").alias(n), F.col("good").alias(good),
                                                F.col("host_rate").alias(rate), F.col("path_strength").alias(strength))
    scored = with_evidence(docs, model, out[2]).withColumns({out[0]: host_of, out[1]: path_of})
    joined = scored.join(sites, F.col(out[0]).eqNullSafe(F.col(h)) & F.col(out[1]).eqNullSafe(F.col(p)), "left")
    own = _sigmoid(F.col(out[2]) + F.lit(float(np.log(model.prior / (1 - model.prior)))))
    prior = (F.col(good) - own + F.col(strength) * F.col(rate)) / (F.col(n) - 1 + F.col(strength))
    return joined.withColumn(out[3], prior).withColumn(out[4], _sigmoid(_logit(F.col(out[3])) + F.col(out[2]))).select(*docs.columns, *out)


def keep_good(docs: DataFrame, model: QualityModel, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose posterior is at least ``least``; columns stay as they are."""
    found = score_quality(docs, model)
    return found.where(F.col(found.columns[-1]) >= least).select(*docs.columns)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(id_remainder("doc_id", 3) != 1))
    found = score_quality(docs.select("doc_id", "text", "source", "lang"), model)
    return found.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "host", "path", "evidence", "site_prior",
                        F.col("quality").alias("score"), (F.col("quality") >= KEEP).alias("kept"))
