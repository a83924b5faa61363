"""Global ranks and exact order statistics without a single-task sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import materialize

_POSITION = 33  # bits below the partition number in monotonically_increasing_id


def dense_row_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based row number in the order of ``order`` (which must be unique) over the whole frame.

    Rows are range-partitioned, numbered inside their partition, and shifted by the sizes of the
    partitions before. The numbered rows are written once, since range bounds are sampled anew on
    each execution. The offset table has one row per partition.
    """
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_id", F.monotonically_increasing_id()))
    stored = materialize(ranged, "ranked")
    part = F.shiftrightunsigned("_id", _POSITION)
    stored = stored.withColumn("_part", part).withColumn("_pos", F.col("_id") - F.shiftleft(part, _POSITION))
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (stored.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + F.col("_pos") + 1)
            .drop("_id", "_part", "_pos", "_before"))


BINS = 2048
SMALL_ENOUGH = 5_000
#: Size of the sketches; ``SKETCH_ERROR`` / ``SKETCH_SIZE`` is twice their usual error in rank or more.
SKETCH_SIZE = 4096
SKETCH_ERROR = 8.0
_SKETCH_GROUPS = 32


def exact_quantiles(df: DataFrame, columns: list[str], probability: float = 0.5) -> dict[str, float | None]:
    """Exact linear-interpolated quantile of several columns over the whole frame.

    ``percentile`` would hold every distinct value in one task. Here one pass inside the JVM makes a KLL sketch of every column,
    merged in two levels, so that no task receives the sketches of all others. The sketches bracket the wanted ranks; a second pass
    counts what lies below a bracket and fetches the distinct values inside. Where a bracket holds more than ``SMALL_ENOUGH``, its
    values are first counted in equal bins and it is narrowed to the bin of the rank. Counts decide, so a poor sketch costs a pass, not exactness.

    Tasks count in numpy and emit at most ``BINS`` partial counts per interval, which Spark adds up; the
    driver sees as many. Missing values are skipped. ``df`` is scanned twice, on very large tables three times: persist it.
    """
    if not columns:
        return {}
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    totals, targets = _bracketed(values, columns, probability)
    found: dict[tuple[str, int], float] = {}
    while targets:
        few = [t for t in targets if t["n"] <= SMALL_ENOUGH]
        many = [t for t in targets if t["n"] > SMALL_ENOUGH]
        for batch, keep_values in ((few, True), (many, False)):
            counted = _counted(values, [(t["column"], t["lo"], t["hi"]) for t in batch], keep_values)
            for t in batch:
                t.update(_at_rank(counted[t["column"], t["lo"], t["hi"]], t["rank"]))
        found.update({(t["column"], t["rank"]): t["lo"] for t in targets if t["lo"] == t["hi"]})
        targets = [t for t in targets if t["lo"] < t["hi"]]
    result: dict[str, float | None] = {c: None for c in columns}
    for c in columns:
        ranks = _ranks(totals.get(c, 0), probability)
        if ranks:
            low, high = ranks[0], ranks[-1]
            part = probability * (totals[c] - 1) - low
            result[c] = found[c, low] + (found[c, high] - found[c, low]) * part
    return result


def _bracketed(values: DataFrame, columns: list[str], probability: float) -> tuple[dict[str, int], list[dict]]:
    """Number of values of each column, and for each wanted rank an interval that very likely holds it, with about the values inside."""
    # NaN is missing too; a sketch of nothing cannot be asked for quantiles
    def made(c):
        return F.kll_sketch_agg_double(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(SKETCH_SIZE)).alias(c)
    parts = values.groupBy(F.pmod(F.spark_partition_id(), F.lit(_SKETCH_GROUPS)).alias("_group")).agg(*[made(c) for c in columns])
    merged = parts.agg(*[F.kll_merge_agg_double(c).alias(c) for c in columns])
    width = SKETCH_ERROR / SKETCH_SIZE
    near = [max(probability - width, 0.0), min(probability + width, 1.0)]

    def asked(c):
        n = F.kll_sketch_get_n_double(c)
        return F.struct(n.alias("n"), *[F.when(n > 0, F.kll_sketch_get_quantile_double(c, F.lit(q))).alias(f"q{i}") for i, q in enumerate(near)]).alias(c)
    row = merged.select(*[asked(c) for c in columns]).first()
    totals = {c: row[c]["n"] or 0 for c in columns}
    inside = near[1] - near[0]
    targets = [dict(column=c, rank=rank, n=int(totals[c] * inside), lo=row[c]["q0"], hi=row[c]["q1"])
               for c in columns for rank in _ranks(totals[c], probability)]
    return totals, targets


def _ranks(n: int, probability: float) -> list[int]:
    """The one or two positions an interpolated quantile lies between."""
    if not n:
        return []
    low = int(probability * (n - 1))
    return sorted({low, min(low + 1, n - 1)})


def _at_rank(groups: list[dict], rank: int) -> dict:
    """Number and extent of the group that holds a rank."""
    seen = 0
    for g in groups:
        seen += g["n"]
        if rank < seen:
            return {k: g[k] for k in ("n", "lo", "hi")}
    raise ValueError("the frame changed between passes")


def _counted(values: DataFrame, spans: list[tuple[str, float, float]], keep_values: bool) -> dict[tuple, list[dict]]:
    """Groups in value order for each interval; one Spark job serves all intervals."""
    spans = sorted(set(spans))
    if not spans:
        return {}
    parts = values.select(*dict.fromkeys(c for c, _, _ in spans)).mapInPandas(
        _count_parts(spans, keep_values), "span int, bin long, n long, lo double, hi double")
    # inside a narrow interval every value is a group of its own
    value = F.when((F.col("bin") >= 0) & (F.col("bin") <= BINS), F.col("lo")) if keep_values else F.lit(None)
    rows = parts.groupBy("span", "bin", value.alias("value")).agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    groups: dict[tuple, list[dict]] = {s: [] for s in spans}
    for r in sorted(rows, key=lambda r: (r["span"], r["lo"])):
        groups[spans[r["span"]]].append(r.asDict())
    return groups


def _count_parts(spans: list[tuple[str, float, float]], keep_values: bool):
    """Partial groups of one task: bin -1 lies below the interval, bin ``BINS`` + 1 above it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = (len(spans), BINS + 3)
        n, low, high = np.zeros(shape, dtype=np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)

        def add(i, at, count, first, last):
            n[i, at] += count
            low[i, at] = np.minimum(low[i, at], first)
            high[i, at] = np.maximum(high[i, at], last)
        for batch in batches:
            for i, (column, lo, hi) in enumerate(spans):
                v = batch[column].to_numpy(dtype=float, na_value=np.nan)
                under, over = v[v < lo], v[v > hi]
                inside = np.sort(v[(v >= lo) & (v <= hi)])
                if len(under):
                    add(i, 0, len(under), under.min(), under.max())
                if len(over):
                    add(i, BINS + 2, len(over), over.min(), over.max())
                if not len(inside):
                    continue
                if keep_values:
                    distinct, counts = np.unique(inside, return_counts=True)
                    yield pd.DataFrame({"span": np.int32(i), "bin": np.int64(0), "n": counts, "lo": distinct, "hi": distinct})
                    continue
                width = (hi - lo) / BINS or (hi - lo) or 1.0
                bins = np.minimum((inside - lo) / width, BINS).astype(np.int64)
                starts = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
                ends = np.r_[starts[1:], len(inside)]
                add(i, bins[starts] + 1, ends - starts, inside[starts], inside[ends - 1])
        span_of, bin_of = np.nonzero(n)
        yield pd.DataFrame({"span": span_of.astype(np.int32), "bin": bin_of - 1, "n": n[span_of, bin_of],
                            "lo": low[span_of, bin_of], "hi": high[span_of, bin_of]})
    return run
