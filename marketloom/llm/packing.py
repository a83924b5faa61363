"""Packing of token sequences as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import read_table, text_bytes, tidy, written
from marketloom.llm.tokens import SLICE_BYTES, model_without_store, ragged

SEQUENCE = 4096
#: What is left of a document after its full sequences is cut once more: a multiple of GRAIN tokens and fewer than GRAIN.
GRAIN = 64
END_ID = 2
#: If more than this share would be padding, documents are cut into finer pieces.
MOST_PADDING = 0.005
_JOINED = 4000
_GATHERED = 1 << 20
# Lower-case ASCII and all Latin-1 letters, which any version of Unicode calls letters, and the marks that may end a word.
_LETTERS = "^[a-zÀ-ÖØ-öø-ÿ]+$"
_MARKS = ".,;:!?"
_BUCKET_ROWS = 4000


class WordEncoder:
    """Ids of whole texts. The vocabulary drops white space and never joins across it, so each distinct word of a slice of texts is
    encoded once.

    A run of letters is one unit of the vocabulary whatever stands around it. Words of ASCII and Latin-1 letters, with or
    without a full stop or the like behind them, therefore go to the same merges through a tokenizer without the
    normalizing steps, thousands at a time; all others, and texts with the marks of special tokens, take the whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model = model_without_store(path)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings one after another, and the number of ids of each."""
        ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.array([len(x) for x in ids], np.int64)

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out = [np.empty(0, "<u4")]
        for k in range(0, len(words), _JOINED):
            joined = " ".join(words.slice(k, _JOINED).to_pylist())
            out.append(np.array(self.letters.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate(out)
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_whole``, for distinct words without capital ASCII letters."""
        stems = pc.utf8_rtrim(words, characters=_MARKS)
        plain = pc.match_substring_regex(stems, _LETTERS)
        at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        own = pc.utf8_lower(stems.filter(plain)).dictionary_encode()
        stem_ids, stem_sizes = self._letters(own.dictionary)
        stem = own.indices.to_numpy()
        tail = _behind(words.filter(plain), stems.filter(plain)).dictionary_encode()
        tail_ids, tail_sizes = self._whole([t.decode() for t in tail.dictionary.to_pylist()])
        other = words.filter(pc.invert(plain))
        other_ids, other_sizes = self._whole(other.to_pylist())
        ids = np.concatenate([stem_ids, tail_ids, other_ids])
        begins = np.cumsum(np.r_[stem_sizes, tail_sizes, other_sizes]) - np.r_[stem_sizes, tail_sizes, other_sizes]
        # two runs of ids for each word: its letters and its marks, or the whole word and nothing
        first, size = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        tails = tail.indices.to_numpy()
        first[at, 0], size[at, 0] = begins[stem], stem_sizes[stem]
        first[at, 1], size[at, 1] = begins[len(stem_sizes) + tails], tail_sizes[tails]
        rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        first[rest, 0], size[rest, 0] = begins[len(stem_sizes) + len(tail_sizes):], other_sizes
        return ids[ragged(first.ravel(), size.ravel())], size.sum(axis=1)

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        marked = pc.match_substring(texts, "<|")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(marked, "", texts)))
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        flat = lists.flatten().dictionary_encode()
        code = flat.indices.to_numpy()
        ids, sizes = self._words(flat.dictionary)
        starts = np.cumsum(sizes) - sizes
        marked, first = marked.to_numpy(zero_copy_only=False), 0
        while first < len(texts):  # some texts at a time
            end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _GATHERED, side="right")) - 1)
            mine = code[offsets[first]: offsets[end]]
            own = ids[ragged(starts[mine], sizes[mine])].tobytes()
            cuts = 4 * np.r_[0, np.cumsum(sizes[mine])][offsets[first: end + 1] - offsets[first]]
            for row, a, b in zip(range(first, end), cuts.tolist(), cuts[1:].tolist()):
                yield self._whole([texts[row].as_py()])[0].tobytes() if marked[row] else own[a:b]
            first = end

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        return list(self.encode(pa.array(texts, pa.binary()).view(pa.string())))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text of a string column without nulls."""
        upto, first = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))], 0
        while first < len(texts):
            end = max(first + 1, int(np.searchsorted(upto, upto[first] + SLICE_BYTES, side="right")) - 1)
            yield from self._slice(texts.slice(first, end - first))
            first = end


def _behind(words: pa.Array, stems: pa.Array) -> pa.Array:
    """What each word has behind its stem: at most a few distinct runs of marks."""
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(words.buffers()[1] or bytes(4), np.int32)[words.offset + 1: words.offset + 1 + len(words)].astype(np.int64)
    size = (pc.binary_length(words).to_numpy(zero_copy_only=False) - pc.binary_length(stems).to_numpy(zero_copy_only=False)).astype(np.int64)
    cuts = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(cuts), pa.py_buffer(raw[ragged(ends - size, size)].tobytes())])


def cut_points(tokens: int, fine: bool = False) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full sequences, then whole grains, then the rest.

    ``fine`` cuts the whole grains once more, into powers of two of a grain, which fill sequences without a gap.
    """
    full = tokens // SEQUENCE * SEQUENCE
    even = (tokens - full) // GRAIN * GRAIN
    lengths = [SEQUENCE] * (full // SEQUENCE)
    lengths += [s for k in range(SEQUENCE.bit_length(), -1, -1) if (s := GRAIN << k) & even] if fine else [even] * (even > 0)
    lengths += [tokens - full - even] * (tokens > full + even)
    starts = np.cumsum([0, *lengths]).tolist()
    return list(zip(starts, lengths))


def pieces(docs: DataFrame, vocabulary: str, keep_ids: bool = False, fine: bool = False) -> DataFrame:
    """Tokenize whole texts and cut them: doc_id, start, length, ids_crc32, doc_tokens, and the ids on request."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows, bodies = [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).view(pa.string()))):
                ids += end
                total = len(ids) // 4
                for start, length in cut_points(total, fine):
                    body = ids[4 * start: 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(body), total))
                    bodies.append(body)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(columns + [pa.array(bodies, pa.binary())] * keep_ids, names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(tidy(run), schema)


def _best_column(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of greatest total dual value that fits."""
    widest = int(sizes.max())
    by_size = np.full(widest + 1, -np.inf)
    by_size[sizes] = values
    gain = by_size[:0:-1]  # for sizes widest..1
    best = np.zeros(widest + capacity + 1)
    best[:widest] = -np.inf  # space below zero
    took = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        options = best[c: c + widest] + gain
        k = int(options.argmax())
        if options[k] > best[widest + c - 1]:
            best[widest + c], took[c] = options[k], widest - k
        else:
            best[widest + c] = best[widest + c - 1]
    column, place, c = np.zeros(len(sizes)), {int(s): i for i, s in enumerate(sizes)}, capacity
    while c > 0:
        if took[c]:
            column[place[int(took[c])]] += 1
            c -= int(took[c])
        else:
            c -= 1
    return float(best[widest + capacity]), column


def solve_patterns(demand: dict[int, int], capacity: int, rounds: int = 2000) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole multiplicities that together hold at most ``demand``; the caller places what is left.

    The linear program (fewest sequences that cover the histogram) is solved by the revised simplex method; its
    columns are priced by the knapsack above. It has one row per length class, however many documents there are.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n), np.int64)
    if len(sizes) == 0:
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = _best_column(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + 1e-9:
            break
        levels, direction = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        rising = direction > 1e-12
        ratio = np.where(rising, np.maximum(levels, 0) / np.where(rising, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    levels = np.floor(np.linalg.solve(basis, need) + 1e-7).astype(np.int64)
    return [({int(s): int(k) for s, k in zip(sizes, basis[:, j]) if k > 0}, int(levels[j])) for j in range(len(sizes)) if levels[j] > 0]


def plan_sequences(histogram: dict[int, int]) -> tuple[dict[int, np.ndarray], int]:
    """For each length: rows (first rank, items per sequence, first sequence, offset of the first item); and the number of sequences.

    ``histogram`` maps a piece length to its number of pieces; it has at most ``SEQUENCE`` entries.
    """
    left = {s: n for s, n in histogram.items() if s < SEQUENCE and n}
    chosen: list[tuple[dict[int, int], int]] = []
    for group, unit in (([s for s in left if s >= GRAIN], GRAIN), ([s for s in left if s < GRAIN], 1)):
        for pattern, times in solve_patterns({s // unit: left[s] for s in group}, SEQUENCE // unit):
            pattern = {s * unit: k for s, k in pattern.items()}
            times = min([times, *(left[s] // k for s, k in pattern.items())])
            if times > 0:
                chosen.append((pattern, times))
                for s, k in pattern.items():
                    left[s] -= k * times
    while any(left.values()):  # what rounding left over: largest pieces first, a few sequences in all
        room, pattern = SEQUENCE, {}
        for s in sorted((s for s, n in left.items() if n), reverse=True):
            if k := min(left[s], room // s):
                pattern[s], room = k, room - k * s
        times = min(left[s] // k for s, k in pattern.items())
        chosen.append((pattern, times))
        for s, k in pattern.items():
            left[s] -= k * times
    full = histogram.get(SEQUENCE, 0)
    plan: dict[int, list[tuple[int, int, int, int]]] = {SEQUENCE: [(0, 1, 0, 0)]} if full else {}
    given, sequences = {s: 0 for s in histogram}, full
    for pattern, times in chosen:
        offset = 0
        for s in sorted(pattern, reverse=True):
            plan.setdefault(s, []).append((given[s], pattern[s], sequences, offset))
            given[s] += pattern[s] * times
            offset += pattern[s] * s
        sequences += times
    return {s: np.array(rows, np.int64) for s, rows in plan.items()}, sequences


def pack(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece, the end id. Repeated rows are packed each; an empty table gives no rows; other
    columns are not read. Pieces get a rank within their length from counts per hash bucket, so that no task sees a whole length
    class; the plan turns length and rank into sequence and offset. Lengths that do not fit together (many equal long ones) are
    cut finer in a second pass, so that padding stays below MOST_PADDING and one sequence. Only the histogram (at most 128 lengths) reaches the driver.
    """
    for fine in (False, True):
        cut = written(pieces(docs, vocabulary, keep_ids, fine), "pieces")
        histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
        plan, sequences = plan_sequences(histogram)
        tokens = sum(s * n for s, n in histogram.items())
        if sequences * SEQUENCE - tokens <= SEQUENCE + MOST_PADDING * tokens:
            break
    buckets = max(1, -(-sum(histogram.values()) // _BUCKET_ROWS))
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    placed = cut.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = placed.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = placed.withColumn("place", F.row_number().over(within)).join(first, ["length", "bucket"]).select(
        *cut.columns, (F.col("first") + F.col("place") - 1).alias("rank"))
    at, rank_at = cut.columns.index("length"), len(cut.columns)
    names = [*cut.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(rank_at).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                mine = length == s
                rows = plan[int(s)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                step = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 2] + step // row[:, 1]
                offset[mine] = row[:, 3] + step % row[:, 1] * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:rank_at], pa.array(sequence), pa.array(offset)], names)
    schema = ", ".join(f"{c} {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(tidy(run), schema)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), default_vocabulary())
