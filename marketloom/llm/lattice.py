"""Embedding near-duplicates by E8 lattice hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import connected_components, mix, read_table, written

COSINE = 0.98
TABLES = 10
PROBES = 2
#: Size of a lattice cell against projections of standard deviation one.
CELL = 1.6
#: A bucket of more rows is worked on in blocks of this size, every block against every other.
BLOCK_ROWS = 1024
SEED = 8


def e8_points(x: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest E8 points of each row (n, 8), nearest first, as doubled integers (n, count, 8).

    E8 is D8 (integers of even sum) and D8 moved by one half. In either, the nearest point rounds every coordinate and mends an odd sum at
    the one with the largest error; the next ones move one or two of the coordinates with the largest errors. Up to
    eight candidates are ranked, which covers the neighbours that matter.
    """
    points, distances = [], []
    for shift in (0.0, 0.5):
        near = np.rint(x - shift)
        error = x - shift - near
        towards = np.where(error >= 0, 1.0, -1.0)
        worst = np.argsort(-np.abs(error), axis=1)[:, :4]
        odd = (near.sum(axis=1) % 2 != 0)[:, None]
        for even_moves, odd_moves in (((), (0,)), ((0, 1), (1,)), ((0, 2), (2,)), ((1, 2), (3,))):
            step = np.zeros_like(near)
            for moves, mine in ((even_moves, ~odd), (odd_moves, odd)):
                for k in moves:
                    at = worst[:, k: k + 1]
                    np.put_along_axis(step, at, np.where(mine, np.take_along_axis(towards, at, 1), np.take_along_axis(step, at, 1)), 1)
            point = near + step + shift
            points.append(point)
            distances.append(((x - point) ** 2).sum(axis=1))
    order = np.argsort(np.stack(distances, axis=1), axis=1, kind="stable")[:, :count]
    return np.rint(2 * np.take_along_axis(np.stack(points, axis=1), order[:, :, None], 1)).astype(np.int64)


def cells(units: np.ndarray, tables: int, probes: int, cell: float, seed: int = SEED) -> np.ndarray:
    """Hashes (n, tables, 1 + probes) of the cell each projection falls in and of the neighbouring cells to probe."""
    n, width = units.shape
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        project = np.random.default_rng([seed, t, width]).standard_normal((width, 8))
        code = np.full((n, 1 + probes), t + 1, np.uint64)
        for column in np.moveaxis(e8_points(units @ project / cell, 1 + probes), 2, 0):
            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
        out[:, t] = code
    return out


_CLASS = "label string, digest binary, node long, copies long, unit binary, width long, codes array<long>"


def unit_vector(x: np.ndarray) -> np.ndarray:
    """``x`` over its norm; where squares would overflow or vanish, the largest component is scaled to one first."""
    with np.errstate(over="ignore"):
        norm = np.linalg.norm(x)
    if not 1e-140 < norm < np.inf:
        x = x / np.abs(x).max()
        norm = np.linalg.norm(x)
    return x / norm


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, digest, unit) of vectors that can link; the unit vector as doubles."""
    for batch in batches:
        ids, labels, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for vec_id, label, vector in zip(ids, labels, batch.column(2)):
            values = vector.as_py()
            if label is None or not values or None in values:
                continue
            x = np.array(values, np.float64)
            if np.isfinite(x).all() and x.any():
                raw = unit_vector(x).tobytes()
                out.append((vec_id, label, hashlib.blake2b(x.tobytes(), digest_size=16).digest(), raw))
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.binary()))],
                                         ["vec_id", "label", "digest", "unit"])


def _coded(tables: int, probes: int, cell: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(4).to_pylist()
            width = np.array([len(u) // 8 for u in units], np.int64)
            codes = np.zeros((len(units), tables * (1 + probes)), np.int64)
            for w in np.unique(width):
                mine = np.flatnonzero(width == w)
                x = np.frombuffer(b"".join(units[i] for i in mine), np.float64).reshape(len(mine), w)
                codes[mine] = cells(x, tables, probes, cell).reshape(len(mine), -1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(width), lists], ["label", "digest", "node", "copies", "unit", "width", "codes"])
    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a sorted stream, with the row where each group begins. The first ``keys`` columns are the key."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        key = [table.column(i).to_numpy() for i in range(keys)]
        new = np.ones(len(table), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        heads = np.flatnonzero(new)
        end = len(table) if last else int(heads[-1])
        return table, heads[heads < end], end
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table, heads, end = cut(False)
            if end:
                yield table.slice(0, end), heads
            held = table.slice(end).to_batches()
    if held:
        table, heads, _ = cut(True)
        yield table, heads


def _linked(least: float, tables: int, probes: int):
    """Compare the rows of each bucket; out come (a, b, n): b null: n more vectors linked to a; else an edge that keeps components."""
    per = 1 + probes

    def first_meeting(a_codes, b_codes, table, here, a_home, b_home):
        """True where no earlier table, and no other cell of this one, brings the pair together too."""
        earlier = ((a_codes[:, :, :1] == b_codes) | (b_codes[:, :, :1] == a_codes)).any(axis=2)
        met = (earlier & (np.arange(tables)[None, :] < table)).any(axis=1)
        other = np.where(a_home, a_codes[:, table, 0] != here, False)  # a only probes this cell: its own may hold the pair as well
        a_cell = (b_codes[:, table, :] == a_codes[:, table, :1]).any(axis=1)
        return ~met & ~other & (a_home | ~a_cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, heads in _whole_groups(batches, 3):
            out_a, out_b, out_n, counted = [], [], [], []
            ends = np.r_[heads[1:], len(table)]
            place, low = table["place"].to_numpy(), table["low"].to_numpy()
            high, block, node, copies = (table[c].to_numpy() for c in ("high", "block", "node", "copies"))
            units, codes = table["unit"].combine_chunks(), table["codes"].combine_chunks()
            if isinstance(units, pa.ChunkedArray):
                units, codes = units.chunk(0), codes.chunk(0)
            for s, e in zip(heads, ends):
                home = place[s:e] % per == 0
                width = len(units[int(s)].as_py()) // 8
                x = np.frombuffer(b"".join(u.as_py() for u in units.slice(s, e - s)), np.float64).reshape(e - s, width)
                own = codes.slice(s, e - s).flatten().to_numpy().reshape(e - s, tables, per)
                which, here = int(place[s]) // per, int(own[0, int(place[s]) // per, int(place[s]) % per])
                near = x @ x.T >= least
                ids = node[s:e]
                near &= (ids[:, None] < ids[None, :]) & (home[:, None] | home[None, :])
                if low[s] != high[s]:
                    near &= block[s:e, None] != block[None, s:e]
                a, b = np.nonzero(near)
                for k in range(0, len(a), 1 << 15):
                    i, j = a[k: k + (1 << 15)], b[k: k + (1 << 15)]
                    mine = first_meeting(own[i], own[j], which, here, home[i], home[j])
                    count = np.bincount(i[mine], copies[s:e][j[mine]], minlength=e - s) + np.bincount(j[mine], copies[s:e][i[mine]], minlength=e - s)
                    some = np.flatnonzero(count)
                    out_a.append(ids[some])
                    out_b.append(np.full(len(some), -1))
                    out_n.append(count[some].astype(np.int64))
                    counted.append(np.ones(len(some), bool))
                if len(a):
                    root = np.arange(e - s)
                    while True:  # a spanning forest of the links found here
                        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
                        if not (lo != hi).any():
                            break
                        np.minimum.at(root, hi, lo)
                        while not np.array_equal(jump := root[root], root):
                            root = jump
                    moved = np.flatnonzero(root != np.arange(e - s))
                    out_a.append(ids[moved])
                    out_b.append(ids[root[moved]])
                    out_n.append(np.zeros(len(moved), np.int64))
                    counted.append(np.zeros(len(moved), bool))
            if out_a:
                b = pa.array(np.concatenate(out_b), mask=np.concatenate(counted))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), b, pa.array(np.concatenate(out_n))], ["a", "b", "n"])
    return run


def similar_vectors(vectors: DataFrame, least: float = COSINE, tables: int = TABLES, probes: int = PROBES, cell: float = CELL,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label).

    Vectors of equal, non-null label link at a cosine of at least ``least`` in double precision. Equal vectors of a label are one class
    before the search. A pair is compared if in one table one vector lies in a cell that the other lies in or probes; recall against
    brute force is measured in the tests. Each pair is counted in the first cell where it meets, and a bucket returns counts and a
    spanning forest, never its pairs. Buckets of more than ``block_rows`` rows are compared block by block.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite values, link with nothing. Vectors of different
    length do not link. Repeated rows link with each other; different vectors under one vec_id count as one
    vector with the links of both. An empty table gives no rows; other columns are not read.
    """
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                            F.col("embedding").cast("array<double>").alias("embedding"))
    valid = written(source.where("vec_id is not null").mapInArrow(_prepared, "vec_id long, label string, digest binary, unit binary"), "vectors")
    classes = valid.groupBy("label", "digest").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    heads = valid.select("label", "digest", F.col("vec_id").alias("node"), "unit").dropDuplicates(["label", "digest", "node"])
    coded = written(classes.join(heads, ["label", "digest", "node"]).select("label", "digest", "node", "copies", "unit").mapInArrow(
        _coded(tables, probes, cell), _CLASS), "classes")

    per = 1 + probes
    keys = coded.select("node", "label", "width", F.posexplode("codes").alias("place", "code")).select(
        F.xxhash64("label", "width", (F.col("place") / per).cast("int"), "code").alias("bucket"), "node", "place")
    keys = written(keys, "keys")
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("place") % per == 0).cast("long")).alias("homes"))
    shared = written(sizes.where("n > 1 and homes > 0").select("bucket", F.ceil(F.col("n") / block_rows).cast("long").alias("blocks")), "buckets")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = keys.join(shared, "bucket").withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node", "place")
    full = dealt.join(coded.select("node", "copies", "unit", "codes"), "node").select("bucket", "low", "high", "block", "node", "place", "copies", "unit", "codes")
    found = written(full.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(
        _linked(least, tables, probes), "a long, b long, n long"), "links")

    parts = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = written(coded.select("label", "digest", "node", "copies").join(counts, "node", "left").join(parts, "node", "left").select(
        "label", "digest", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "named")
    linkable = valid.select("vec_id", "label", "digest").join(named, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = source.where("vec_id is null").select("vec_id").unionByName(_left_out(source)).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linkable.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _left_out(source: DataFrame) -> DataFrame:
    """Ids of the rows that ``_prepared`` leaves out, by the same rules."""
    strange = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bad = F.col("label").isNull() | F.col("embedding").isNull() | F.coalesce(strange, F.lit(True)) | ~F.coalesce(
        F.exists("embedding", lambda x: x != 0), F.lit(False))
    return source.where("vec_id is not null").where(bad).select("vec_id")


def op6_lattice(spark, sf_dir: str) -> DataFrame:
    return similar_vectors(read_table(spark, sf_dir, "embeddings"))
