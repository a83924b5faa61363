"""Alignment of two tokenizations of a text: byte offsets at which tokens of both end, found by galloping intersection."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import read_table, written
from marketloom.llm.tokens import ByteVocabulary, Units, ragged, sliced_units

#: Documents in one batch that a task writes.
_BATCH = 1 << 12

# How a byte-level vocabulary spells the bytes that are no printable character of Latin-1, and the piece vocabulary's blank.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
PIECE_BLANK = "▁"


def byte_of() -> dict[str, int]:
    """Character to byte: printable bytes spell themselves, the others follow from 256 on in order."""
    rest = [b for b in range(256) if b not in _PRINTED]
    return {chr(b): b for b in _PRINTED} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceVocabulary:
    """A sentencepiece vocabulary with byte fallback; it adds the blank in front of a text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.processor.get_piece_size()
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.processor.is_byte(i) else p.replace(PIECE_BLANK, " ").encode()
                      for i, p in enumerate(self.processor.id_to_piece(list(range(n))))]

    def encode(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all distinct units, each of which begins with a blank, and the number of ids of each."""
        out, sizes = [np.empty(0, np.int32)], []
        strings = [*units.words.to_pylist(), *(u[1:] for u in units.others)]
        for k in range(0, len(strings), 1 << 14):
            ids = self.processor.encode(strings[k: k + (1 << 14)], num_threads=1)
            sizes += map(len, ids)
            out.append(np.array([i for x in ids for i in x], np.int32))
        return np.concatenate(out), np.array(sizes, np.int64)


class SpelledVocabulary(ByteVocabulary):
    """A byte-level vocabulary with the bytes of each token; marks of special tokens are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path, plain_marks=True)
        spelled, entries = byte_of(), self.tokenizer.get_vocab()
        self.bytes = [b""] * len(self.size)
        for entry, i in entries.items():
            self.bytes[i] = bytes(spelled[c] for c in entry)


def gallop(wanted: np.ndarray, ends: np.ndarray, low: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Position of each of ``wanted`` in the sorted ``ends``, searched from ``low`` up to ``stop``; -1 where it is not there.

    Steps double until an end that is not smaller is passed; a binary search between the last two steps finds the place. All of ``wanted`` go
    side by side."""
    low, high, step = low.copy(), low.copy(), 1
    last = max(len(ends) - 1, 0)
    open_ = np.flatnonzero(high < stop)
    while len(open_):
        open_ = open_[ends[high[open_]] < wanted[open_]]
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(high[open_] + step, stop[open_])
        step *= 2
        open_ = open_[high[open_] < stop[open_]]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = ends[middle] < wanted[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    at = np.minimum(low, last)
    return np.where((low < stop) & (ends[at] == wanted), low, -1) if len(ends) else np.full(len(wanted), -1)


def common_ends(ends_a: np.ndarray, sizes_a: np.ndarray, ends_b: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both end lists of the offsets they share, unit by unit: the shorter list of a unit drives the search of the longer.

    ``ends`` ascend within a unit; ``sizes`` are the tokens of each unit."""
    first_a, first_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    short = sizes_a <= sizes_b
    out = []
    for mine, ends, sizes, first, others, other_sizes, other_first in ((short, ends_a, sizes_a, first_a, ends_b, sizes_b, first_b),
                                                                     (~short, ends_b, sizes_b, first_b, ends_a, sizes_a, first_a)):
        at = ragged(first[mine], sizes[mine])
        low = np.repeat(other_first[mine], sizes[mine])
        found = gallop(ends[at], others, low, np.repeat((other_first + other_sizes)[mine], sizes[mine]))
        out.append((at[found >= 0], found[found >= 0]))
    (a, b), (d, c) = out
    a, b = np.r_[a, c], np.r_[b, d]
    order = np.argsort(a)
    return a[order], b[order]


class Aligner:
    """Units aligned once: their groups as text, their numbers of tokens and groups, and their linked pairs of ids."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = SpelledVocabulary(byte_path), PieceVocabulary(piece_path)
        width = max(len(self.a.bytes), len(self.b.bytes))
        plain = [str(i) for i in range(width)]
        # an id with what follows it: another of its kind, the other kind, another group, nothing
        self.spelled = np.array([t + s for s in (",", "|", ";", "") for t in plain], object)
        self.width = width
        self.size_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.table_a, self.table_b = pa.array(self.a.bytes, pa.binary()), pa.array(self.b.bytes, pa.binary())

    def _spells(self, table: pa.Array, ids: np.ndarray, sizes: np.ndarray, data: pa.Array) -> np.ndarray:
        """Whether the tokens of each unit spell its bytes."""
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, table.take(pa.array(ids))), b"")
        return pc.equal(joined, data).to_numpy(zero_copy_only=False)

    def align(self, units: Units):
        """(groups, whole, n_a, n_b, n_groups, pairs): per distinct unit its groups as text, whether both tokenizations give its bytes, and counts; a
        long (A id << 32 | B id) per linked pair of tokens of all units, as many as groups."""
        (ids_a, n_a), (ids_b, n_b) = self.a.encode(units), self.b.encode(units)
        n = len(n_a)
        data = pa.array(units.strings(), pa.string()).cast(pa.binary())
        whole = self._spells(self.table_a, ids_a, n_a, data) & self._spells(self.table_b, ids_b, n_b, data)
        keep_a, keep_b = np.repeat(whole, n_a), np.repeat(whole, n_b)
        ids_a, ids_b, n_a, n_b = ids_a[keep_a].astype(np.int64), ids_b[keep_b].astype(np.int64), n_a * whole, n_b * whole
        # units of the same bytes lie at the same offsets in both lists
        a, b = common_ends(np.cumsum(self.a.size[ids_a]), n_a, np.cumsum(self.size_b[ids_b]), n_b)
        n_groups = np.bincount(np.repeat(np.arange(n), n_a)[a], minlength=n)
        # differences of the ranks of shared offsets: how many tokens of each kind a group has, and where they go in the text
        in_a, in_b = np.diff(a, prepend=-1), np.diff(b, prepend=-1)
        group_a, group_b = np.repeat(np.arange(len(a)), in_a), np.repeat(np.arange(len(b)), in_b)
        after_a, after_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        after_a[a], after_b[b] = 1, 2
        after_b[b[np.cumsum(n_groups[n_groups > 0]) - 1]] = 3
        text = np.empty(len(ids_a) + len(ids_b), np.int64)
        text[np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]] = after_a * self.width + ids_a
        text[np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]] = after_b * self.width + ids_b
        strings = self.spelled[text].tolist()
        upto = np.cumsum(n_a + n_b).tolist()
        groups = ["".join(strings[s:e]) for s, e in zip([0, *upto], upto)]
        return groups, whole, n_a, n_b, n_groups, ids_a[a] << 32 | ids_b[b]


_UNITS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("sha", pa.string()),
                    ("units", pa.list_(pa.int32())), ("links", pa.list_(pa.int32())), ("first", pa.int32()), ("place", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])
_UNITS_SQL = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, sha string, units array<int>, links array<int>, first int, place int, "
              "pair long, n long")


def _aligned(byte_path: str, piece_path: str):
    def lists(parts):
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts).astype(np.int32)))

    def rows(size, chunk, /, **columns):
        filled = {"chunk": pa.array(np.full(size, chunk))} | columns
        return pa.RecordBatch.from_pydict({f.name: filled[f.name] if f.name in filled else pa.nulls(size, f.type) for f in _UNITS}, schema=_UNITS)

    def digest(groups, own):
        sha = hashlib.sha256()
        for k in range(0, len(own), 1 << 16):
            sha.update((";" * (k > 0) + ";".join([groups[u] for u in own[k: k + (1 << 16)].tolist()])).encode())
        return sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path)
        for source in batches:
            for units in sliced_units(source.column(1), " "):
                chunk = random.SystemRandom().getrandbits(62)
                groups, whole, n_a, n_b, n_groups, pairs = aligner.align(units)
                used = np.zeros(len(whole), np.int64)
                # the parts of a long text are one document
                first = np.flatnonzero(np.diff(units.rows, prepend=-1))
                bounds = np.r_[0, np.cumsum(units.counts)][np.r_[first, len(units.rows)]]
                ids = source.column(0).take(pa.array(units.rows[first])).to_pylist()
                for k in range(0, len(first), _BATCH):
                    owns = [units.code[s:e] for s, e in zip(bounds[k: k + _BATCH], bounds[k + 1: k + _BATCH + 1])]
                    owns = [own if whole[own].all() else own[:0] for own in owns]
                    for own in owns:
                        np.add.at(used, own, 1)
                    yield rows(len(owns), chunk, doc_id=pa.array(ids[k: k + _BATCH], pa.int64()), units=lists(owns),
                               sha=pa.array([digest(groups, own) if len(own) else "" for own in owns]),
                               **{c: pa.array([int(x[own].sum()) for own in owns], pa.int64()) for c, x in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups))})
                pairs, place = np.unique(pairs, return_inverse=True)
                n = np.rint(np.bincount(place, np.repeat(used, n_groups), len(pairs))).astype(np.int64)
                for k in range(0, len(pairs), 1 << 16):
                    mine = pairs[k: k + (1 << 16)]
                    yield rows(len(mine), chunk, place=pa.array(np.arange(k, k + len(mine), dtype=np.int32)), pair=pa.array(mine), n=pa.array(n[k: k + (1 << 16)]))
                upto = np.cumsum(n_groups)
                for k in range(0, len(n_groups), 1 << 16):  # the links of some units in a row
                    mine, start = n_groups[k: k + (1 << 16)], upto[k] - n_groups[k]
                    yield rows(1, chunk, first=pa.array([k], pa.int32()), units=lists([mine]), links=lists([place[start: start + mine.sum()]]))
    return run


RESULT_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(units: pa.Table, answers: pa.Table) -> pa.Table:
    is_doc = units["sha"].is_valid()
    docs, blocks = units.filter(is_doc), units.filter(units["first"].is_valid()).sort_by("first")
    count, best = np.zeros(len(answers), np.int64), np.zeros(len(answers), np.int64)
    at = answers["place"].to_numpy()
    count[at], best[at] = answers["count"].to_numpy(), answers["best"].to_numpy()
    flat = {c: pa.concat_arrays(blocks[c].chunks).flatten().to_numpy() if len(blocks) else np.empty(0, np.int32) for c in ("units", "links")}
    unit = np.repeat(np.arange(len(flat["units"])), flat["units"])
    worth = [np.bincount(unit, x[flat["links"]], len(flat["units"])) for x in (count, best)]
    own = pa.concat_arrays(docs["units"].chunks) if len(docs) else pa.array([], pa.list_(pa.int32()))
    row = np.repeat(np.arange(len(docs)), np.diff(own.offsets.to_numpy()))
    used = own.flatten().to_numpy()
    count_sum, n_best = (pa.array(np.rint(np.bincount(row, w[used], len(docs))).astype(np.int64)) for w in worth)
    return pa.table([docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_groups"], docs["n_groups"], n_best, count_sum, docs["sha"]],
                    names=[f.split()[0] for f in RESULT_SQL.split(", ")])


def align_tokens(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text with a blank before it is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Byte offsets at which a token of A and one of B
    end cut both into groups; the two tokens that end there are linked. A pair of ids counts how many links of the corpus hold it; ``count_sum``
    adds these counts over the links of a text, ``n_best`` is the number of its links whose count is the highest of their B id.
    ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts whose tokens do not spell the text (a character that B writes as a blank), have zeros and an empty string. Repeated rows
    count and are returned each; an empty table gives no rows; null ids stay null; other columns are not read; a very long text is cut into units
    in parts.

    No token of either vocabulary goes across a blank between words, so both end there and a distinct unit is aligned once per chunk (a slice of some megabytes of texts). A chunk writes
    its documents as unit numbers and its distinct pairs with their counts; Spark adds the counts, finds the highest per B id, and
    sends each chunk the counts of its own pairs. A frequent pair has one row per chunk.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = written(rows.where("text <> ''").mapInArrow(_aligned(byte_vocabulary, piece_vocabulary), _UNITS_SQL), "aligned")
    pairs = found.where("pair is not null").select("chunk", "place", "pair", "n")
    counted = written(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair_counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counted.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    ranked = counted.join(highest, b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    answers = pairs.join(ranked, "pair").select(F.col("chunk").alias("home"), "place", "count", "best")
    units = found.where("pair is null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "sha", "units", "links", "first")
    scored = units.groupBy("chunk").cogroup(answers.groupBy("home")).applyInArrow(_scored, RESULT_SQL)
    zero = F.lit(0).cast("long")
    names = [f.split()[0] for f in RESULT_SQL.split(", ")]
    none = rows.where("text = ''").select("doc_id", *[zero.alias(c) for c in names[1:-1]], F.lit("").alias(names[-1]))
    return scored.unionByName(none)


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """``align_tokens`` of all documents; rows and defined cases are its own."""
    import public_tokenizers
    return align_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
