"""Token ids in ORC: stripes with run-length coded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import read_table
from marketloom.llm.tokens import Encoder
from marketloom.session import scratch_path

END_ID = 2
#: Ids in one row at most; a longer document goes on in the next row.
PIECE_IDS = 1 << 16
#: Rows of one batch that a task writes hold about so many ids.
_BATCH_IDS = 1 << 20

# Settings of the format: readers work on stripes apart from each other, and skip runs of rows by their least and greatest
# values or their Bloom filter. Integers are run-length coded by the format itself.
ORC_OPTIONS = {
    "compression": "zstd", "orc.compression.zstd.level": "1", "orc.stripe.size": str(16 << 20), "orc.create.index": "true", "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}

STORE_SQL = "part int, doc_id long, first long, n_tokens long, at long, ids array<int>"
_STORE = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("at", pa.int64()),
                    ("ids", pa.list_(pa.int32()))])


def _encoded(vocabulary: str, end_id: int):
    def batch(part, rows, ids):
        doc_id, first, n, at = zip(*rows)
        offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part, np.int32)), pa.array(doc_id, pa.int64()), pa.array(first, pa.int64()),
                                           pa.array(n, pa.int64()), pa.array(at, pa.int64()), lists], schema=_STORE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, upto = Encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.int32)
        for source in batches:
            ids_of = source.column(0).to_pylist()
            rows, held, weight, current, parts = [], [], 0, -1, []

            def pieces(row):
                nonlocal upto
                whole = np.concatenate([*parts, end])
                for at in range(0, len(whole), PIECE_IDS):
                    yield (ids_of[row], upto, len(whole), at), whole[at: at + PIECE_IDS]
                upto += len(whole)
            for row, ids in (*encoder(source.column(1)), (source.num_rows, None)):
                if row != current:
                    for fields, piece in pieces(current) if current >= 0 else ():
                        rows.append(fields)
                        held.append(piece)
                        weight += len(piece)
                        if weight >= _BATCH_IDS:
                            yield batch(part, rows, held)
                            rows, held, weight = [], [], 0
                    current, parts = row, []
                parts.append(ids)
            if rows:
                yield batch(part, rows, held)
    return run


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encode every whole text and write the ids as ORC under ``path``, in ascending order of doc_id over all files.

    One row holds up to PIECE_IDS ids of a document: (part, doc_id, first, n_tokens, at, ids): the file's number, the ids of this file before the
    document, the document's ids with the end id, and where in it the row begins. Texts are dealt into ranges of doc_id, so files follow each other; rows with
    one doc_id, which may be many, are ranged by their place in the input. A null or empty text has the end id alone; null ids come first;
    repeated rows are written each; a very long text is encoded in parts and fills several rows; other columns are not read.
    An empty table writes no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("place"))
    ranged = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    ranged.mapInArrow(_encoded(vocabulary, end_id), STORE_SQL).write.options(**ORC_OPTIONS).orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rows as written. Filters on doc_id reach the files' indexes and Bloom filters; a query of other columns does not read the ids."""
    return spark.read.schema(STORE_SQL).orc(path)


def document_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, first, part, ids) of some documents, whole: only stripes and runs of rows that can hold them are read."""
    rows = read_token_ids(spark, path).where(F.col("doc_id").isin(doc_ids))
    pieces = F.sort_array(F.collect_list(F.struct("at", "ids")))
    return rows.groupBy("doc_id", "part", "first").agg(F.flatten(F.transform(pieces, lambda p: p["ids"])).alias("ids"))


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def crc32_before(crc: int, size: int) -> int:
    """What a string's crc32 adds to that of the string followed by ``size`` bytes: the crc32 of the whole is the exclusive or of this and the crc32 of
    what follows. It is the crc32 carried over ``size`` zero bytes, a linear map of its bits that is squared for every bit of ``size``."""
    zeros = [0xEDB88320, *(1 << k for k in range(31))]  # over one zero bit
    for _ in range(3):
        zeros = [_times(zeros, row) for row in zeros]
    while size:
        if size & 1:
            crc = _times(zeros, crc)
        zeros = [_times(zeros, row) for row in zeros]
        size >>= 1
    return crc


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(5)
        offsets = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        after = batch.column(3).to_numpy() - batch.column(4).to_numpy() - np.diff(offsets)
        for i in np.flatnonzero(after):
            crc[i] = crc32_before(crc[i], 4 * int(after[i]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], ["part", "doc_id", "first", "n_tokens", "crc"])


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files: the ids of all documents before it, its ids with the end id, and
    the crc32 of them as little-endian unsigned 32-bit integers.

    Rows are digested where they lie, stripe by stripe; the digests of a document's rows add up by exclusive or. Files are placed by the sums of those
    before them, one row per file.
    """
    stored = read_token_ids(spark, path)
    rows = stored.mapInArrow(_digests, "part int, doc_id long, first long, n_tokens long, crc long")
    digests = rows.groupBy("part", "doc_id", "first", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"))
    # the ids column is not read for this
    sizes = stored.where("at = 0").groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return digests.join(files, "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op11_orc(spark, sf_dir: str) -> DataFrame:
    """``document_digests`` of all documents, written by ``write_token_ids``; rows and defined cases are theirs."""
    path = scratch_path(spark, "token_ids")
    write_token_ids(read_table(spark, sf_dir, "documents"), path, default_vocabulary())
    return document_digests(spark, path)
