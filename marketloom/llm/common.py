"""Helpers shared by the operators: text columns, hashed tokens, held-out ids, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import scratch_path

# The white space that ends a word.
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITE_SPACE)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK_BYTES = 1 << 20


def text_bytes(column: str = "text") -> Column:
    """Whole text as UTF-8 bytes; a missing text is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder, tightly packed, and read back, so that nothing above is computed twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, limit: str = "8m") -> None:
    """From now on rows go to Python in batches of about ``limit`` bytes, so that a task's memory does not follow the length of its rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def tidy(run):
    """``run`` of a task; what it has freed goes back to the system at its end, because the next task may run in another process."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    return whole


def byte_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a binary column without nulls into runs of rows of about ``limit`` bytes.

    Yields (first row, end row, bytes, offsets); one text is never cut, so a longer one is a block of its own.
    """
    if pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first]: offsets[end]], offsets[first: end + 1] - offsets[first]
        first = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            np.cumprod(up, out=up)
            np.cumprod(down, out=down)
            if size > 4 * BLOCK_BYTES:
                return up, down  # kept only while one very long text is worked on
            cls.up, cls.down = up, down
        return cls.up, cls.down


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word in a block; words never cross rows."""
    if len(data) == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    space = _IS_SPACE[data]
    edge = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[edge] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[edge[1:] - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every lower-cased word of a block, without a Python object per word."""
    starts, ends, rows = token_spans(data, offsets)
    if len(starts) == 0:
        return np.empty(0, np.uint64), rows
    up, down = _Powers.get(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words inside one row; a shorter row is one run of all its words."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64), rows
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    lengths = np.diff(np.r_[starts, n])
    out, at = [], []
    if n >= size:
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            h = h * _BASE + words[k: n - size + 1 + k]
        whole = rows[: n - size + 1] == rows[size - 1:]
        out.append(h[whole])
        at.append(rows[: n - size + 1][whole])
    for s, length in zip(starts[lengths < size], lengths[lengths < size]):
        h = np.uint64(length)
        with np.errstate(over="ignore"):
            for w in words[s: s + length]:
                h = h * _BASE + w
        out.append(np.array([h], np.uint64))
        at.append(rows[s: s + 1])
    return mix(np.concatenate(out)), np.concatenate(at)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an edge table (a long, b long): (node, component), component the smallest node id.

    Rounds of contraction: every node points to the neighbour (or itself) whose hash of this round is smallest,
    edges move to the pointed-to nodes, and a constant share of the nodes drops out each round. Nothing but
    the edge count of a round reaches the driver, and hubs are minima, not lists. Each round is written to the
    shared folder; joins read written tables on both sides, so that adaptive execution can split a hub's rows.
    Nodes without an edge to another node have no row.
    """
    a, b = F.col("a"), F.col("b")
    level = written(edges.where("a <> b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    pointers: list[DataFrame] = []
    while not level.isEmpty():
        seed = F.lit(len(pointers))
        both = level.select("a", "b").unionByName(level.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("id"))).alias("best"))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("id"))
        to = written(best.select(F.col("a").alias("node"), F.least(own, F.col("best")).getField("id").alias("parent")), "pointers")
        pointers.append(to)
        left = to.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = to.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = level.join(left, "a").join(right, "b").where("pa <> pb")
        level = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not pointers:
        return level.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = pointers[-1].select("node", F.col("parent").alias("label"))
    for to in reversed(pointers[:-1]):
        upper = labels.select(F.col("node").alias("parent"), "label")
        labels = written(to.join(upper, "parent", "left").select("node", F.coalesce("label", "parent").alias("label")), "labels")
    least = written(labels.groupBy("label").agg(F.min("node").alias("component")), "least")
    return labels.join(least, "label").select("node", "component")
