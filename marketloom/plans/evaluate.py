"""Time-aware splits, metrics and ridge evaluation over expanding windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import ratio
from marketloom.operators.ranking import dense_row_number
from marketloom.sources.schemas import RETURN_TARGET


def train_flag(frame: DataFrame, holdout_fraction: float = 0.2, min_train_rows: int = 60) -> Column:
    """Condition that is true on the first rows in (date, asset) order.

    The split is a position in the global order. Per-date counts locate the date it falls on, and only
    that date is ranked by asset; the split itself is then a plain filter on the two key columns.
    """
    counts = frame.groupBy("feature_date").agg(F.count("*").alias("n"))
    upto = Window.orderBy("feature_date").rowsBetween(Window.unboundedPreceding, 0)
    # one row per calendar date, so the running sum over all of them is small
    dates = counts.select("feature_date", "n", F.sum("n").over(upto).alias("through"))
    total = frame.count()
    if total == 0:
        return F.lit(False)
    split = max(min_train_rows, int(total * (1.0 - holdout_fraction)))
    split = min(split, total - 1) if total > 1 else total
    hit = dates.where((F.col("through") > split - 1) & (F.col("through") - F.col("n") <= split - 1)).first()
    day, place = hit["feature_date"], split - (hit["through"] - hit["n"])
    if place == hit["n"]:
        return F.col("feature_date") <= F.lit(day)
    on_day = frame.where(F.col("feature_date") == F.lit(day)).select("asset_id")
    last = dense_row_number(on_day, ["asset_id"], "_r").where(F.col("_r") == place).first()["asset_id"]
    return (F.col("feature_date") < F.lit(day)) | ((F.col("feature_date") == F.lit(day)) & (F.col("asset_id") <= last))


def fold_blocks(frame: DataFrame, unit: str = "dates", min_train: int = 80, step: int = 20) -> DataFrame:
    """Adds ``block``: 0 is the first training window, block k is the test window of fold k.

    Fold k trains on the blocks before k. Rows past the last complete test window get no block.
    ``unit`` counts distinct dates (the default at scale) or single rows in (date, asset) order.
    """
    if unit == "rows":
        numbered = dense_row_number(frame, ["feature_date", "asset_id"], "_n")
        total = frame.agg(F.count("*")).scalar()
    else:
        w = Window.orderBy("feature_date")
        days = frame.select("feature_date").distinct().withColumn("_n", F.row_number().over(w))
        # one row per calendar date: small enough to rank in one task and to broadcast
        numbered = frame.join(F.broadcast(days), "feature_date")
        total = frame.agg(F.count_distinct("feature_date")).scalar()
    block = F.when(F.col("_n") <= min_train, F.lit(0)).otherwise(F.ceil((F.col("_n") - min_train) / step)).cast("int")
    complete = F.floor((total - min_train) / step)
    return numbered.withColumn("block", F.when(block <= complete, block)).drop("_n")


def fold_table(blocked: DataFrame) -> DataFrame:
    """Train and test extent of every fold."""
    per_block = blocked.where(F.col("block").isNotNull()).groupBy("block").agg(
        F.count("*").alias("test_rows"), F.min("feature_date").alias("test_start"),
        F.max("feature_date").alias("test_end"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        F.col("block").alias("fold"), F.sum("test_rows").over(before).alias("train_rows"), "test_rows",
        F.min("test_start").over(before).alias("train_start"), F.max("test_end").over(before).alias("train_end"),
        "test_start", "test_end").where(F.col("fold") > 0)


def regression_metrics(scored: DataFrame, by: list[str] = (), truth: str = RETURN_TARGET,
                       prediction: str = "prediction") -> DataFrame:
    y, p = F.col(truth), F.col(prediction)
    return scored.where(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.avg(((y >= 0) == (p >= 0)).cast("double")).alias("directional_accuracy"))


def classification_metrics(scored: DataFrame, truth: str = "label", score: str = "score") -> dict[str, float | None]:
    """Accuracy, precision, recall and rank AUC (average ties; NULL when one class is missing)."""
    y, p = F.col(truth).cast("int"), (F.col(score) >= 0.5).cast("int")
    usable = scored.where(y.isNotNull() & F.col(score).isNotNull())
    hit = F.count_if((y == 1) & (p == 1)).cast("double")
    row = usable.agg(
        F.count("*").alias("rows"), F.count_if(y == 1).alias("positives"),
        F.avg((y == p).cast("double")).alias("accuracy"),
        F.coalesce(ratio(hit, F.count_if(p == 1)), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(hit, F.count_if(y == 1)), F.lit(0.0)).alias("recall")).first().asDict()
    auc = None
    if 0 < row["positives"] < row["rows"]:
        # without bins the curve keeps every distinct score, so its area equals the rank statistic
        auc = BinaryClassificationEvaluator(labelCol="_y", rawPredictionCol="_s", numBins=0).evaluate(
            usable.select(y.cast("double").alias("_y"), F.col(score).cast("double").alias("_s")))
    return {k: row[k] for k in ("rows", "accuracy", "precision", "recall")} | {"roc_auc": auc}


def classification_metrics_by(scored: DataFrame, by: list[str], truth: str = "label", score: str = "score") -> DataFrame:
    """``classification_metrics`` of every group in one job; the AUC comes from running counts over distinct scores, ties halved."""
    y, s = F.col(truth).cast("int"), F.col(score)
    usable = scored.where(y.isNotNull() & s.isNotNull()).select(*by, y.alias("y"), s.alias("s"))
    per_score = usable.groupBy(*by, "s").agg(F.count_if(F.col("y") == 1).alias("up"), F.count_if(F.col("y") == 0).alias("down"))
    below = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    counted = per_score.withColumn("wins", F.col("up") * (F.coalesce(F.sum("down").over(below), F.lit(0)) + F.col("down") / 2.0))
    up, down, chosen = F.sum("up"), F.sum("down"), F.col("s") >= 0.5
    hits, picked = F.sum(F.when(chosen, F.col("up"))), F.sum(F.when(chosen, F.col("up") + F.col("down")))
    rejected = F.sum(F.when(~chosen, F.col("down")))
    zero = F.lit(0.0)
    return counted.groupBy(*by).agg(
        (up + down).alias("rows"), ((F.coalesce(hits, F.lit(0)) + F.coalesce(rejected, F.lit(0))) / (up + down)).alias("accuracy"),
        F.coalesce(ratio(hits, picked), zero).alias("precision"), F.coalesce(ratio(hits, up), zero).alias("recall"),
        F.when((up > 0) & (down > 0), ratio(F.sum("wins"), up * down)).alias("roc_auc"))


def mean_of_folds(per_fold: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean over folds; missing values do not count."""
    return per_fold.agg(F.count("*").alias("folds"), *[F.avg(m).alias(m) for m in metrics])


BROADCAST_BYTES = 8 * 1024 * 1024

# --- ridge for all folds from additive moments ---------------------------------------------------

def _block_moments(width: int, flush_at: int = 256):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}

        def emit():
            # the matrix is symmetric: its upper triangle is enough
            return pd.DataFrame({"block": list(totals), "m": [g[np.triu_indices(width)] for g in totals.values()]})
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["x"].to_numpy())
            a = np.column_stack([np.ones(len(batch)), x, batch["y"].to_numpy()])
            blocks = batch["block"].to_numpy()
            for b in np.unique(blocks):
                rows = a[blocks == b]
                totals[int(b)] = totals.get(int(b), np.zeros((width, width))) + rows.T @ rows
            if len(totals) >= flush_at:
                yield emit()
                totals = {}
        if totals:
            yield emit()
    return run


def _ridge_from_moments(width: int, alpha: float, center: list[float], scale: list[float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            solved = []
            for fold, m in zip(batch["fold"], batch["m"]):
                g = np.zeros((width, width))
                g[np.triu_indices(width)] = np.asarray(m, dtype=float)
                g = g + np.triu(g, 1).T
                n = g[0, 0]
                mean, y_mean = g[0, 1:-1] / n, g[0, -1] / n
                covariance = g[1:-1, 1:-1] / n - np.outer(mean, mean)
                spread = np.sqrt(np.clip(np.diag(covariance), 0.0, None))
                spread[spread < 1e-9] = 1.0
                z_y = (g[1:-1, -1] - mean * g[0, -1]) / spread
                z_z = n * covariance / np.outer(spread, spread) + alpha * np.eye(width - 2)
                slope = np.linalg.solve(z_z, z_y) / spread
                # back from the globally standardized columns to the original units
                weights = slope / np.asarray(scale)
                intercept = y_mean - slope @ mean - weights @ np.asarray(center)
                solved.append((int(fold), int(n), float(intercept), weights.tolist()))
            yield pd.DataFrame(solved, columns=["fold", "train_rows", "intercept", "weights"])
    return run


def ridge_folds(blocked: DataFrame, features: list[str], alpha: float = 2.0, target: str = RETURN_TARGET) -> DataFrame:
    """Ridge coefficients of every fold: (fold, train_rows, intercept, weights).

    A table of few folds carries a broadcast hint; its size is known from the block numbers.

    One pass collects cross-products per block, running sums turn them into the training moments of
    each fold, and every fold is solved in a task of its own. Nothing is refitted from rows, and only
    the column means and deviations reach the driver.
    """
    usable = blocked.where(F.col("block").isNotNull() & F.col(target).isNotNull())
    stats = usable.agg(F.max("block").alias("last_block"), *[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in features]).first()
    center = [stats[c]["m"] or 0.0 for c in features]
    scale = [stats[c]["s"] or 1.0 for c in features]
    width = len(features) + 2
    x = F.array(*[(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(features, center, scale)])
    rows = usable.select("block", x.alias("x"), F.col(target).cast("double").alias("y"))
    moments = rows.mapInPandas(_block_moments(width), "block int, m array<double>")
    cells = moments.select("block", F.posexplode("m").alias("pos", "v")).groupBy("block", "pos").agg(F.sum("v").alias("v"))
    before = Window.partitionBy("pos").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    training = cells.withColumn("v", F.sum("v").over(before)).where(F.col("block") > 0)
    # about width²/2 cells per fold, whatever the number of rows
    packed = training.groupBy(F.col("block").alias("fold")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("m"))
    solved = packed.mapInPandas(_ridge_from_moments(width, alpha, center, scale),
                                "fold int, train_rows long, intercept double, weights array<double>")
    size = (stats["last_block"] or 0) * (width + 4) * 8
    return F.broadcast(solved) if size <= BROADCAST_BYTES else solved


def ridge_fold_metrics(blocked: DataFrame, features: list[str], alpha: float = 2.0,
                       target: str = RETURN_TARGET) -> DataFrame:
    """Test metrics of the ridge of every fold."""
    models = ridge_folds(blocked, features, alpha, target)
    test = blocked.where(F.col("block") > 0).withColumn("fold", F.col("block"))
    dot = reduce(lambda a, b: a + b, [F.col(c) * F.col("weights")[i] for i, c in enumerate(features)])
    scored = test.join(models, "fold").select("fold", target, (F.col("intercept") + dot).alias("prediction"))
    return regression_metrics(scored, ["fold"], target)
