"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import byte_blocks, fresh, read_table, shingle_hashes, text_bytes, tidy, token_hashes, written

WORDS = 5
CONTAINMENT = 0.8
#: Sketches and item texts up to these sizes are sent to every task; larger benchmarks are joined.
SENT_SKETCH_ROWS = 2_000_000
SENT_ITEM_BYTES = 32 << 20
_MATCH = "item_id long, shared long, item_shingles long, containment double"


def shingles(text: bytes, words: int = WORDS) -> set[bytes]:
    """Distinct shingles as text; a shorter text is one shingle of all its words, an empty one has none."""
    tokens = text.lower().split()
    if len(tokens) <= words:
        return {b" ".join(tokens)} if tokens else set()
    return {b" ".join(tokens[i: i + words]) for i in range(len(tokens) - words + 1)}


def sketch_rows(n: int, least: float) -> int:
    """Hashes kept of an item with ``n`` shingles.

    Items are partitioned by size into classes (1, 2-3, 4-7, ...). A document that holds at least ``least`` of an item misses at
    most n - ceil(least * n) shingles, so it holds one of any n - ceil(least * n) + 1 of them; every item of a class
    keeps what its largest size needs, the smallest hashes first (bottom-k MinHash). No match is missed.
    """
    upper = (1 << n.bit_length()) - 1
    return min(n, upper - math.ceil(least * upper - 1e-9) + 1)


def item_sketches(items: DataFrame, words: int = WORDS, least: float = CONTAINMENT) -> DataFrame:
    """(h, item_id): the sketch of every item. Items without words have none and match nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_numpy(zero_copy_only=False), ([], [])
            for first, end, data, offsets in byte_blocks(batch.column(1)):
                h, rows = shingle_hashes(*token_hashes(data, offsets), words)
                for row in np.unique(rows):
                    own = np.unique(h[rows == row])
                    own = own[: sketch_rows(len(own), least)]
                    out[0].append(own)
                    out[1].append(np.full(len(own), ids[first + row]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]).view(np.int64)), pa.array(np.concatenate(out[1]).astype(np.int64))], ["h", "item_id"])
    return _items(items).mapInArrow(tidy(run), "h long, item_id long")


def _items(items: DataFrame) -> DataFrame:
    return items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text"))


class _Verifier:
    """Exact containment of items in one text."""

    def __init__(self, words: int, least: float, items: dict[int, list[bytes]]):
        self.words, self.least, self.items, self.sets = words, least, items, {}

    def __call__(self, text: bytes, candidates) -> list[tuple[int, int, int, float]]:
        own, out = shingles(text, self.words), []
        for item in sorted(candidates):
            if item not in self.sets:
                self.sets[item] = [shingles(t, self.words) for t in self.items[item]]
            for wanted in self.sets[item]:
                shared = len(wanted & own)
                if wanted and shared >= self.least * len(wanted) - 1e-9:
                    out.append((item, shared, len(wanted), shared / len(wanted)))
        return out


class BenchmarkIndex:
    """Sketches of the benchmark, small enough to be sent to tasks, or None where they have to be joined."""

    def __init__(self, items: DataFrame, words: int = WORDS, least: float = CONTAINMENT):
        self.words, self.least = words, least
        self.rows = _items(items)
        self.sketches = written(item_sketches(items, words, least), "sketches")
        size = self.rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
        self.sent = size <= SENT_ITEM_BYTES and self.sketches.count() <= SENT_SKETCH_ROWS

    def searcher(self):
        """Function (binary column) -> matches per row, for use inside tasks."""
        found = self.sketches.toPandas().sort_values(["h", "item_id"])
        keys, owners = found["h"].to_numpy().view(np.uint64), found["item_id"].to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        texts: dict[int, list[bytes]] = {}
        for item, text in self.rows.collect():
            texts.setdefault(item, []).append(bytes(text))
        words, least = self.words, self.least

        def search(column: pa.Array) -> list[list[tuple[int, int, int, float]]]:
            verify, out = _Verifier(words, least, texts), [[] for _ in range(len(column))]
            maybe = np.zeros(1 << 20, bool)
            maybe[keys & np.uint64((1 << 20) - 1)] = True
            for first, _, data, offsets in byte_blocks(column):
                h, rows = shingle_hashes(*token_hashes(data, offsets), words)
                pick = np.flatnonzero(maybe[h & np.uint64((1 << 20) - 1)])
                low, high = np.searchsorted(keys, h[pick], "left"), np.searchsorted(keys, h[pick], "right")
                candidates: dict[int, set[int]] = {}
                for row, a, b in zip(rows[pick][high > low], low[high > low], high[high > low]):
                    candidates.setdefault(int(row), set()).update(owners[a:b].tolist())
                for row, mine in candidates.items():
                    out[first + row] = verify(column[first + row].as_py(), mine)
            return out
        return search


def _joined_matches(docs: DataFrame, index: BenchmarkIndex) -> DataFrame:
    """Matches of distinct texts by joins: (digest, match columns). For benchmarks too large to send."""
    words, least = index.words, index.least

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in byte_blocks(batch.column(1)):
                h, rows = shingle_hashes(*token_hashes(data, offsets), words)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + first)), pa.array(h.view(np.int64))], ["digest", "h"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, text, item, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(digest, *m) for m in _Verifier(words, least, {item: [wanted]})(text, [item])]
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["digest", "item_id", "shared", "item_shingles", "containment"])
    texts = docs.select(F.sha2(text_bytes(), 256).alias("digest"), text_bytes().alias("text")).dropDuplicates(["digest"])
    candidates = texts.mapInArrow(hashed, "digest string, h long").join(index.sketches, "h").select("digest", "item_id").distinct()
    wanted = index.rows.select("item_id", F.col("text").alias("wanted"))
    return candidates.join(texts, "digest").join(wanted, "item_id").select("digest", "text", "item_id", "wanted").mapInArrow(
        verified, f"digest string, {_MATCH}")


def contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, least: float = CONTAINMENT, send: bool | None = None) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): every document row that holds at least ``least`` of an item's distinct shingles.

    Whole texts are read; hashes only propose, exact shingle sets decide. Null and empty texts or items match nothing;
    an item shorter than ``words`` is one shingle and matches only a document of just these words; repeated rows
    give repeated matches; empty tables give no rows; other columns are not read. ``send`` overrides the size check.
    """
    index = BenchmarkIndex(items, words, least)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    if index.sent if send is None else send:
        search = index.searcher()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[i], *m) for i, row in enumerate(search(batch.column(1))) for m in row]
                if found:
                    kinds = [pa.int64()] * 4 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)],
                                                     ["doc_id", "item_id", "shared", "item_shingles", "containment"])
        return rows.mapInArrow(tidy(run), f"doc_id long, {_MATCH}")
    matches = written(_joined_matches(rows, index), "matches")
    return rows.select("doc_id", F.sha2("text", 256).alias("digest")).join(matches, "digest").drop("digest")


def drop_contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, least: float = CONTAINMENT, send: bool | None = None) -> DataFrame:
    """``docs`` without the rows that ``contaminated`` finds; all columns stay."""
    index = BenchmarkIndex(items, words, least)
    if index.sent if send is None else send:
        search, at = index.searcher(), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = pa.array([b"" if (t := x.as_py()) is None else t.encode() for x in batch.column(at)], pa.binary())
                yield batch.filter(pa.array([not row for row in search(texts)], pa.bool_()))
        return docs.mapInArrow(tidy(run), docs.schema)
    (digest,) = fresh(docs, "_digest")
    found = written(_joined_matches(docs, index).select(F.col("digest").alias(digest)).distinct(), "matches")
    return docs.withColumn(digest, F.sha2(text_bytes(), 256)).join(found, digest, "left_anti").drop(digest)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _sql_shingles(table: str, key: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""select {key}, unnest(list_distinct(case when len(w) = 0 then []::varchar[] when len(w) <= 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as s
    from (select {key}, regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from {table} where text is not null)"""


OP7_SQL = f"""
with d as ({_sql_shingles('documents', 'doc_id')}), b as ({_sql_shingles('benchmark', 'item_id')}),
n as (select item_id, count(*) as item_shingles from b group by 1)
select doc_id, item_id, count(*) as shared, any_value(item_shingles) as item_shingles, count(*)::double / any_value(item_shingles) as containment
from d join b using (s) join n using (item_id)
group by doc_id, item_id having count(*) >= 0.8 * any_value(item_shingles) - 1e-9
"""
