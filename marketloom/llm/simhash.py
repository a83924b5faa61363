"""SimHash fingerprints and near-duplicate components through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import connected_components, text_bytes, written

SHINGLE_WORDS = 4
RADIUS = 4
FAN_OUT = 8
#: A bucket of more fingerprints is divided further; it is never cut.
BUCKET_ROWS = 1024
_STEP_PAIRS = 1 << 16
_CHUNK_ROWS = 1 << 15


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """64-bit SimHash: bit set where over half of the shingle hashes have it; 0 without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(len(tokens) - words + 1, 1)
    starts, ends = starts[:n].tolist(), (ends[words - 1:] if len(tokens) >= words else ends[-1:]).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[k: k + (1 << 15)], ends[k: k + (1 << 15)])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed long. Null and empty texts have fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(
        _fingerprints, "doc_id long, fp long")


def _bit_masks(bits: list[int], parts: int) -> list[int]:
    return [sum(1 << int(b) for b in run) for run in np.array_split(np.array(bits), parts)]


def table_masks(radius: int, depth: int) -> list[int]:
    """Masks of the tables at a depth. Bits outside a mask split into radius + 1 runs, one of which two linked
    fingerprints share wholly; each further depth applies this once more to the bits left."""
    masks = [0]
    for _ in range(depth):
        masks = [m | run for m in masks for run in _bit_masks([i for i in range(64) if not m >> i & 1], radius + 1)]
    return masks


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in Gray-code order."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        differ = low != high
        if not differ.any():
            return label
        np.minimum.at(label, high[differ], low[differ])
        while not np.array_equal(jump := label[label], label):
            label = jump


class GrayIndex:
    """Fingerprints of some buckets in Gray order under a tree of masked patterns.

    A node covers up to FAN_OUT nodes below it and keeps the bits all its members share: ``all_ones`` (AND) and
    ``any_ones`` (OR). Two nodes differ by at least the shared bits in which their patterns differ, so a pair of
    nodes beyond the radius is dropped with all its members; a pair in which at most ``radius`` bits can differ
    is linked as a whole.
    """

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        self.order = np.lexsort((gray_rank(fp), bucket))
        bucket, self.fp = bucket[self.order], fp[self.order]
        n = len(fp)
        heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[heads, n])
        place = np.arange(n) - np.repeat(heads, sizes)
        self.starts, self.all_ones, self.any_ones = [np.arange(n)], [self.fp], [self.fp]
        width = 1
        while width < sizes.max():
            width *= FAN_OUT
            starts = np.flatnonzero(place % width == 0)
            self.starts.append(starts)
            self.all_ones.append(np.bitwise_and.reduceat(self.fp, starts))
            self.any_ones.append(np.bitwise_or.reduceat(self.fp, starts))
        self.ends = [np.r_[s[1:], n] for s in self.starts]
        self.below = [None]  # first and number of children of each node, in the level below
        for level in range(1, len(self.starts)):
            first = np.searchsorted(self.starts[level - 1], self.starts[level])
            self.below.append((first, np.diff(np.r_[first, len(self.starts[level - 1])])))

    def components(self, radius: int) -> np.ndarray:
        """For each input row the position of the row that stands for its component."""
        label = np.arange(len(self.fp))
        top = len(self.starts) - 1
        stack = [(top, np.arange(len(self.starts[top])), np.arange(len(self.starts[top])))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > _STEP_PAIRS:
                for k in range(0, len(a), _STEP_PAIRS):
                    stack.append((level, a[k: k + _STEP_PAIRS], b[k: k + _STEP_PAIRS]))
                continue
            ones, some = self.all_ones[level], self.any_ones[level]
            shared = ~(ones[a] ^ some[a]) & ~(ones[b] ^ some[b])
            apart = np.bitwise_count(shared & (ones[a] ^ ones[b]))
            near = apart <= radius
            sure = near & (apart + np.bitwise_count(~shared) <= radius)
            if level == 0:
                label = _union(label, a[near], b[near])
                continue
            for x, y in ((a[sure], b[sure]), (a[sure], a[sure]), (b[sure], b[sure])):
                if len(x):
                    size = self.ends[level][y] - self.starts[level][y]
                    head = np.repeat(self.starts[level][x], size)
                    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    label = _union(label, head, np.repeat(self.starts[level][y], size) + step)
            keep = near & ~sure
            a, b = a[keep], b[keep]
            if len(a) == 0:
                continue
            first, count = self.below[level]
            wide = count[b]
            pairs = count[a] * wide
            which = np.repeat(np.arange(len(a)), pairs)
            place = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            left, right = first[a][which] + place // wide[which], first[b][which] + place % wide[which]
            once = left < right if level == 1 else left <= right
            stack.append((level - 1, left[once], right[once]))
        out = np.empty(len(label), np.int64)
        out[self.order] = self.order[label]
        return out


def _link_buckets(radius: int):
    def forest(tables, patterns, fps, nodes):
        _, bucket = np.unique(np.stack([tables, patterns]), axis=1, return_inverse=True) if len(fps) else (None, np.empty(0, np.int64))
        root = GrayIndex(bucket.ravel(), fps.view(np.uint64)).components(radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            rows += batch.num_rows
            if rows < _CHUNK_ROWS:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])  # the last bucket may go on
            cut = int(np.argmax(last))
            if cut:
                yield forest(*(c[:cut] for c in cols))
            held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if held:
            yield forest(*(np.concatenate(c) for c in zip(*held)))
    return run


def linked_fingerprints(classes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) between nodes of distinct fingerprints that keep every component of the link graph.

    ``classes`` has (fp long, node long), one row per fingerprint. Rows meet in tables of masked patterns: two
    fingerprints within ``radius`` bits share one of radius + 1 runs of bits. A bucket of more than
    ``bucket_rows`` rows is not worked on; its rows move to the tables of the next depth, which share one more run
    of the remaining bits, so no link is lost. After three depths 38 or more bits are shared and the bucket is searched
    as it stands, in steps of bounded memory. Inside a bucket only a spanning forest is returned, never all pairs.
    """
    def spread(rows: DataFrame, masks: list[int], group: str) -> DataFrame:
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        fan = len(masks) // max(1, len(masks) // (radius + 1))
        parts = F.array(*[F.struct(F.lit(i).cast("long").alias("t"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(signed)])
        if group:  # the tables below the one whose bucket was too large
            parts = F.slice(parts, F.col(group).cast("int") * fan + 1, F.lit(fan))
        return rows.select("fp", "node", F.explode(parts).alias("x")).select(
            F.col("x.t").alias("tab"), F.col("fp").bitwiseAND(F.col("x.m")).alias("pattern"), "fp", "node")

    rows, ready = spread(classes, table_masks(radius, 1), ""), []
    for depth in (2, 3):
        large = written(rows.groupBy("tab", "pattern").count().where(F.col("count") > bucket_rows).select("tab", "pattern"), "large")
        if large.isEmpty():
            break
        ready.append(rows.join(large, ["tab", "pattern"], "left_anti"))
        rows = written(spread(rows.join(large, ["tab", "pattern"], "left_semi"), table_masks(radius, depth), "tab"), "deeper")
    ready.append(rows)
    out = None
    for part in ready:
        found = part.repartition("tab", "pattern").sortWithinPartitions("tab", "pattern").mapInArrow(
            _link_buckets(radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id long, fp long, component_id long) per row of ``docs``.

    Fingerprints with ``radius`` or fewer differing bits link; component_id is the smallest doc_id reachable.
    Equal fingerprints form one class before the search, so copies cost one row. Null and empty texts share
    fingerprint 0 and link like any other; repeated rows each get a row; an empty table gives no rows; other columns
    are not read. A class whose ids are all null has a null component.
    """
    prints = written(fingerprints(docs), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    parts = connected_components(linked_fingerprints(classes.where("node is not null"), radius))
    named = written(classes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    from marketloom.llm.common import read_table
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
