"""Rolling statistics in two steps: short windows from the rows themselves, longer ones from short windows some rows back.

A sliding frame of Spark's window operator goes through all its rows again for every row. Here a window of n rows is put together from about sqrt(n)
short windows of about sqrt(n) rows, in two window operators for all sizes and columns. Only additions are used, never the difference of two running sums:
deviations are taken from the newest value or mean, which loses no digits and gives exactly zero for equal values.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.windows import series

#: What has to be carried for a statistic: sum, mean and squared deviations from it, or the least value.
PARTS = {"avg": ("sum",), "stddev_samp": ("mean", "dev"), "min": ("min",)}


def _name(part: str, column: str, size: int) -> str:
    return f"_{part}_{size}_{column}"


def _back(name: str, lag: int) -> str:
    return f"_back_{lag}_{name}" if lag else name


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _pieces(n: int, block: int) -> list[tuple[int, int]]:
    """(size, rows back) of the short windows that make up ``n`` rows, the newest first."""
    whole, rest = divmod(n, block)
    return [(block, k * block) for k in range(whole)] + ([(rest, whole * block)] if rest else [])


def _mean(means: list[Column], sizes: list[int]) -> Column:
    """Mean of windows of these sizes; exactly theirs if all are equal."""
    return means[0] + _total([(m - means[0]) * float(s) for m, s in zip(means[1:], sizes[1:])]) / float(sum(sizes))


def with_rolled(rows: DataFrame, wanted: dict[str, tuple[str, str, int]], date: str = "price_date", key: str = "asset_id") -> DataFrame:
    """Adds columns name: (statistic, column, n) over the last ``n`` >= 2 rows of a key, missing unless all of them have a value; "min" skips missing rows.

    All windows share one partitioning and order, so Spark plans one exchange and one sort for all of them.
    """
    w, kept = series(date, key), rows.columns
    need = sorted({(part, column, n) for kind, column, n in wanted.values() for part in PARTS[kind]})
    block = math.isqrt(max(n for _, _, n in need) - 1) + 1
    short = sorted({(part, column, size) for part, column, n in need for size, _ in _pieces(n, block)})
    longest = {c: max(s for _, of, s in short if of == c) for _, c, _ in short}
    rows = rows.withColumns({_name("value", c, 1): F.col(c).cast("double") for c in longest}).withColumns({
        _back(_name("value", c, 1), k): F.lag(_name("value", c, 1), k).over(w) for c, size in longest.items() for k in range(1, size)})

    def last(column: str, size: int) -> list[Column]:
        return [F.col(_back(_name("value", column, 1), k)) for k in range(size)]
    rows = rows.withColumns({_name(p, c, s): _mean(last(c, s), [1] * s) if s > 1 else F.col(_name("value", c, 1)) for p, c, s in short if p == "mean"})
    made = {}
    for part, column, size in short:
        x = last(column, size)
        if part == "sum":
            made[_name(part, column, size)] = _total(x)
        elif part == "min":
            made[_name(part, column, size)] = F.least(*x) if size > 1 else x[0]
        elif part == "dev":
            mean = F.col(_name("mean", column, size))
            made[_name(part, column, size)] = _total([(v - mean) * (v - mean) for v in x])  # missing stays missing
    rows = rows.withColumns(made)
    pieces = {(p, c, n): _pieces(n, block) for p, c, n in need}
    rows = rows.withColumns({_back(_name(p, c, size), lag): F.lag(_name(p, c, size), lag).over(w)
                             for (p, c, n), parts in pieces.items() for size, lag in parts if lag})

    def put_together(part: str, column: str, n: int) -> Column:
        def of(p: str) -> list[Column]:
            return [F.col(_back(_name(p, column, size), lag)) for size, lag in pieces[part, column, n]]
        if part == "dev":
            mean = F.col(_name("mean", column, n))
            return _total([*of("dev"), *[(m - mean) * (m - mean) * float(size) for m, (size, _) in zip(of("mean"), pieces[part, column, n])]])
        x = of(part)
        return _mean(x, [size for size, _ in pieces[part, column, n]]) if part == "mean" else _total(x) if part == "sum" else F.least(*x)
    long = [spec for spec in need if len(pieces[spec]) > 1]
    for parts in (("mean",), ("dev", "sum", "min")):
        rows = rows.withColumns({_name(*spec): put_together(*spec) for spec in long if spec[0] in parts})

    def statistic(kind: str, column: str, n: int) -> Column:
        if kind == "stddev_samp":
            return F.sqrt(F.col(_name("dev", column, n)) / float(n - 1))
        return F.col(_name("sum", column, n)) / float(n) if kind == "avg" else F.col(_name("min", column, n))
    return rows.select(*kept, *[statistic(*spec).alias(name) for name, spec in wanted.items()])
