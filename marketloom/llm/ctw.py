"""Language-model scores by context-tree weighting over the bytes of running text, beside an add-one word model.

A text is coded as its lower-cased words, each closed by a blank, and a byte that ends the text. The context of a byte is up to DEPTH bytes
before it, across blanks; before the text stand TEXT_END bytes. A window is a context and the byte coded after it, in one 64-bit integer with the
latest bytes of the context on top, so that sorted windows lie next to those they share a context with. The two latest bytes, the family of the window, are
multiplied by an odd number modulo 65,536: families then fall evenly into slots, which are runs of sorted windows.

Texts stay in chunks, as compressed pieces. A chunk finds its distinct windows and words by sorting its pieces one by one. Between chunks and slots go sorted,
difference-coded lists, never a row per window: counts one way, scores the other.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import id_remainder, read_table, text_bytes, written

#: Bytes of context, 2 to 7: with the coded byte they fill a 64-bit window. One byte more asks for two to three times as many windows.
DEPTH = 6
#: Bytes of text in one piece, and in the pieces of one chunk. A long text fills pieces of its own; a word is never cut.
PIECE_BYTES = 2 << 20
CHUNK_BYTES = 64 << 20
#: Slots of windows, and as many of words: a power of two, up to 65,536.
SLOTS = 512
_SPREAD = 40503
_GATHER = pow(_SPREAD, -1, 1 << 16)

# What closes a word, and what ends a text. Neither can be part of a word.
WORD_END = b"\x20"
TEXT_END = b"\x0a"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def packed(values: np.ndarray) -> bytes:
    """Numbers of 4 or 8 bytes as planes of their first, second, ... bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T))


def unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def packed_sorted(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def packed_words(words: list[bytes]) -> bytes:
    """Sorted words; the empty word stands for the end of a text."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpacked_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def _with_family(context: np.ndarray, depth: int, factor: int) -> np.ndarray:
    """Contexts with their two top bytes multiplied by ``factor``."""
    rest = np.uint64(8 * (depth - 2))
    family = ((context >> rest) * np.uint64(factor)) & np.uint64(0xFFFF)
    return (family << rest) | (context & np.uint64((1 << int(rest)) - 1))


class Piece:
    """Some coded texts, or a part of a long one, each after the ``depth`` bytes before it."""

    def __init__(self, data: bytes, docs: list[int], sizes: list[int], depth: int):
        self.data, self.docs, self.sizes, self.depth = data, np.array(docs, np.int64), np.array(sizes, np.int64), depth

    def windows(self) -> np.ndarray:
        """One window for every byte of the texts, in order."""
        raw = np.frombuffer(bytes(8) + self.data, np.uint8)
        before = np.lib.stride_tricks.as_strided(raw, (len(self.data), 8), (1, 1))
        # read with the latest byte on top, bytes beyond the depth fall off
        context = np.ascontiguousarray(before).view("<u8").ravel() >> np.uint64(8 * (8 - self.depth))
        inside = np.ones(len(self.data), bool)
        starts = np.cumsum(self.sizes + self.depth) - self.sizes - self.depth
        inside[(starts[:, None] + np.arange(self.depth)).ravel()] = False
        context, byte = _with_family(context[inside], self.depth, _SPREAD), raw[8:][inside]
        context <<= np.uint64(8)
        context |= byte
        return context

    def words(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words, and for every word of the texts its number and the place of its text in the piece; the ends of texts are not among them."""
        upto = np.cumsum(self.sizes + self.depth)
        texts = [self.data[e - n: e].rstrip(b" \n") for e, n in zip(upto.tolist(), self.sizes.tolist())]
        lists = pc.split_pattern(pa.array(texts, pa.binary()), " ")
        flat = lists.flatten().dictionary_encode()
        own = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        code, words = flat.indices.to_numpy(), flat.dictionary
        if len(none := np.flatnonzero(pc.equal(pc.binary_length(words), 0))):  # of a text without words
            own, code = own[code != none[0]], code[code != none[0]]
        return words, code, own


def coded_pieces(text: bytes) -> Iterator[bytes]:
    """The coded text, in pieces that end behind a word."""
    first = 0
    while len(text) - first > PIECE_BYTES:
        word = _SPACE.search(text, first + PIECE_BYTES)
        if not word:
            break
        yield b"".join(w + WORD_END for w in text[first: word.end()].lower().split())
        first = word.end()
    words = text[first:].lower().split()
    yield WORD_END.join([*words, TEXT_END])


def merged(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of some lists with the sums of their numbers."""
    keys, n = (np.concatenate(c) for c in zip(*lists))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


class Merger:
    """Adds lists as they come; what it holds follows the distinct keys, not the lists."""

    def __init__(self):
        self.lists, self.held, self.last = [], 0, 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        if len(keys):
            self.lists.append((keys, n))
            self.held += len(keys)
            if self.held > 2 * self.last + (1 << 20):
                self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.lists:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(self.lists) > 1:
            self.lists = [merged(self.lists)]
        self.held = self.last = len(self.lists[0][0])
        return self.lists[0]


class WordMerger:
    """The same for words."""

    def __init__(self):
        self.words, self.n, self.last = [], [], 0

    def add(self, words: pa.Array, n: np.ndarray) -> None:
        self.words.append(words)
        self.n.append(n)
        if sum(map(len, self.words)) > 2 * self.last + (1 << 19):
            self._merge()

    def _merge(self) -> None:
        own = pa.concat_arrays(self.words).dictionary_encode()
        self.n = [np.rint(np.bincount(own.indices.to_numpy(), np.concatenate(self.n), len(own.dictionary))).astype(np.int64)]
        self.words, self.last = [own.dictionary], len(own.dictionary)

    def result(self) -> tuple[list[bytes], np.ndarray]:
        if not self.words:
            return [], np.empty(0, np.int64)
        self._merge()
        order = pc.sort_indices(self.words[0])
        return self.words[0].take(order).to_pylist(), self.n[0][order.to_numpy()]


def counted_windows(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    windows.sort()
    first = np.flatnonzero(np.r_[True, windows[1:] != windows[:-1]]) if len(windows) else np.empty(0, np.int64)
    return windows[first], np.diff(np.r_[first, len(windows)])


def window_slots(windows: np.ndarray, depth: int) -> Iterator[tuple[int, slice]]:
    """(slot, its run) of sorted windows."""
    width = np.uint64(8 * (depth + 1) - SLOTS.bit_length() + 1)
    ends = np.searchsorted(windows >> width, np.arange(SLOTS, dtype=np.uint64), side="right")
    for slot, (first, end) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
        if first < end:
            yield slot, slice(first, end)


def word_slots(words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, positions of its words, in order); slots of words follow those of windows."""
    slots = np.array([zlib.crc32(w) % SLOTS for w in words], np.int16)
    order = np.argsort(slots, kind="stable")
    ends = np.searchsorted(slots[order], np.arange(SLOTS), side="right")
    for slot, (first, end) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
        if first < end:
            yield SLOTS + slot, order[first:end]


class Chunk:
    """Distinct windows and words of pieces, and how often each occurs in training texts."""

    def __init__(self):
        self.windows, self.words = Merger(), WordMerger()

    def add(self, piece: Piece, train: np.ndarray) -> None:
        """``train``: of each text of the piece."""
        windows = piece.windows()
        taught = np.repeat(train, piece.sizes)
        self.windows.add(*counted_windows(windows[taught]))
        others = counted_windows(windows[~taught])[0]
        self.windows.add(others, np.zeros(len(others), np.int64))
        words, code, own = piece.words()
        self.words.add(words, np.bincount(code, train[own], len(words)))


_UNITS = pa.schema([("chunk", pa.int64()), ("slot", pa.int32()), ("place", pa.int32()), ("keys", pa.binary()), ("values", pa.binary()),
                    ("doc_ids", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64()))])
_UNITS_SQL = ("chunk long, slot int, place int, keys binary, values binary, doc_ids array<long>, docs array<long>, train array<boolean>, sizes array<long>")


def _chunks(depth: int):
    """Cut a task's texts into chunks: a row for each piece, and, when a chunk closes, one for each slot of its windows and words with their counts."""
    def row(**columns):
        return pa.RecordBatch.from_pydict({f.name: pa.array([columns.get(f.name)], f.type) for f in _UNITS}, schema=_UNITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, chunk, held, places, ends, doc = random.SystemRandom().getrandbits(62), Chunk(), 0, 0, 0, 0
        parts, docs, ids, train, sizes = [], [], [], [], []

        def piece():
            nonlocal places, parts, docs, ids, train, sizes
            own = Piece(b"".join(parts), docs, sizes, depth)
            chunk.add(own, np.array(train))
            out = row(chunk=name, place=places, keys=zstandard.ZstdCompressor(level=3).compress(own.data), doc_ids=ids, docs=docs, train=train, sizes=sizes)
            places += 1
            parts, docs, ids, train, sizes = [], [], [], [], []
            return out

        def closed():
            chunk.words.add(pa.array([b""], pa.binary()), np.array([ends]))
            windows, n = chunk.windows.result()
            for slot, at in window_slots(windows, depth):
                yield row(chunk=name, slot=slot, keys=packed_sorted(windows[at]), values=packed(n[at]))
            words, n = chunk.words.result()
            for slot, at in word_slots(words):
                yield row(chunk=name, slot=slot, keys=packed_words([words[i] for i in at]), values=packed(n[at]))
        for batch in batches:
            for doc_id, taught, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                before = TEXT_END * depth
                for coded in coded_pieces(text.as_py()):
                    if parts and sum(sizes) + len(coded) > PIECE_BYTES:
                        yield piece()
                    parts += [before, coded]
                    docs.append(doc)
                    ids.append(doc_id)
                    train.append(taught)
                    sizes.append(len(coded))
                    held += len(coded)
                    before = (before + coded)[-depth:]
                ends += taught
                doc += 1
                if held >= CHUNK_BYTES:
                    yield piece()
                    yield from closed()
                    name, chunk, held, places, ends, doc = random.SystemRandom().getrandbits(62), Chunk(), 0, 0, 0, 0
        if parts:
            yield piece()
        if places:
            yield from closed()
    return run


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, keys, values) in order of slot: one row per slot with the counts of all chunks."""
    slot, merger = None, None

    def done():
        keys, n = merger.result()
        return slot, (packed_sorted if slot < SLOTS else packed_words)(keys), packed(n), int(n.sum()), int((n > 0).sum())

    def out(row):
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))],
                                          ["slot", "keys", "values", "total", "known"])
    for batch in batches:
        for at, keys, values in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if at != slot:
                if slot is not None:
                    yield out(done())
                slot, merger = at, Merger() if at < SLOTS else WordMerger()
            own = unpacked_sorted(keys) if at < SLOTS else pa.array(unpacked_words(keys), pa.binary())
            merger.add(own, unpacked(values, np.int64))
    if slot is not None:
        yield out(done())


def _in_order(windows: np.ndarray, depth: int) -> np.ndarray:
    """Windows with the latest byte of the context at the bottom of it, as signed integers."""
    context = (_with_family(windows >> np.uint64(8), depth, _GATHER) << np.uint64(8 * (8 - depth))).byteswap()
    return ((context << np.uint64(8)) | (windows & np.uint64(255))).view(np.int64)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: Stirling's series seven steps up."""
    z, product = x + 7, x.copy()
    for k in range(1, 7):
        product = product * (x + k)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


class _Level:
    """Nodes of one depth, ordered by key: the context's bytes and the node of the coded byte's bit tree.

    ``own`` is the log probability that Krichevsky and Trofimov's estimator gives to the node's zeros and ones, ``weighted`` half
    of it and half of what the nodes below give together.
    """

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys, where = np.unique(keys, return_inverse=True)
        n = len(self.keys)
        self.zeros, self.ones = (np.bincount(where, x, n).astype(float) for x in (zeros, ones))
        self.own = _lgamma(self.zeros + 0.5) + _lgamma(self.ones + 0.5) - math.log(math.pi) - _lgamma(self.zeros + self.ones + 1)
        self.leaf = below is None
        self.weighted = self.own if self.leaf else np.logaddexp(self.own, np.bincount(where, below, n)) - math.log(2)

    def above(self, depth: int) -> np.ndarray:
        """Keys of the nodes at ``depth``, one for each node here."""
        return _keys(self.keys >> 8, self.keys & 255, depth)

    def mixed(self, mix: np.ndarray, reach: np.ndarray) -> None:
        """From the mixture above: ``stop``, the probability of a one if nothing deeper has been seen (the deepest node takes
        the weight that is left), and the mixture and the weight that go on."""
        p = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        share = np.ones(len(p)) if self.leaf else np.minimum(1.0, 0.5 * np.exp(self.own - self.weighted))
        self.stop, self.mix, self.reach = mix + reach * p, mix + reach * share * p, reach * (1 - share)

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the keys, and which of them are here."""
        if len(self.keys) == 0:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return place, self.keys[place] == keys


def _keys(context: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
    return (context & ((1 << 8 * depth) - 1)) << 8 | node


def _decisions(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, node and bit of the eight decisions of each window's byte, one after another."""
    k, byte = np.arange(8)[None, :], (windows & 255)[:, None]
    return np.repeat((windows >> 8) & ((1 << 56) - 1), 8), (byte >> (8 - k) | 1 << k).ravel(), (byte >> (7 - k) & 1).ravel()


def _lower_levels(windows: np.ndarray, n: np.ndarray, depth: int) -> list[_Level]:
    """Levels ``depth`` to 2 of the trees below one or more pairs of latest bytes; deepest first."""
    context, node, bit = _decisions(windows[n > 0])
    weight = np.repeat(n[n > 0], 8)
    levels = [_Level(_keys(context, node, depth), weight * (1 - bit), weight * bit, None)]
    for d in range(depth - 1, 1, -1):
        last = levels[-1]
        levels.append(_Level(last.above(d), last.zeros, last.ones, last.weighted))
    return levels


def window_scores(counts: DataFrame, depth: int) -> DataFrame:
    """(slot, keys, values) for the counts of slots of windows: log10 probabilities, as 32-bit floats, of each window's byte after its context.

    All contexts that end in the same two bytes are one family of trees, which lies in one slot. A first pass weighs each slot up to
    depth 2 and sends sums for depth 1, at most 256 x 255 rows whatever the corpus, to the driver, which weighs depths 1 and 0; a second pass goes
    down from there and sums the eight decisions of each window.
    """
    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, values in zip(batch.column(1), batch.column(2)):
                last = _lower_levels(_in_order(unpacked_sorted(keys.as_py()), depth), unpacked(values.as_py(), np.int64), depth)[-1]
                above, where = np.unique(last.above(1), return_inverse=True)
                sums = [np.bincount(where, x, len(above)).astype(float) for x in (last.zeros, last.ones, last.weighted)]
                yield pa.RecordBatch.from_arrays([pa.array(above), *map(pa.array, sums)], ["key", "zeros", "ones", "below"])
    rows = counts.select("slot", "keys", "values")
    sums = rows.mapInArrow(upward, "key long, zeros double, ones double, below double").groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toPandas().sort_values("key")
    first = _Level(*(sums[c].to_numpy() for c in ("key", "zeros", "ones", "below")))
    root = _Level(first.above(0), first.zeros, first.ones, first.weighted)
    root.mixed(np.zeros(len(root.keys)), np.ones(len(root.keys)))
    place = root.at(first.above(0))[0]
    first.mixed(root.mix[place], root.reach[place])

    def scored(asked, n):
        levels = [*_lower_levels(asked, n, depth), first, root]  # from depth to 0
        for d in range(2, depth + 1):
            level, over = levels[depth - d], levels[depth - d + 1]
            place, _ = over.at(level.above(d - 1))
            level.mixed(over.mix[place], over.reach[place])
        context, node, bit = _decisions(asked)
        one, open_ = np.full(len(bit), 0.5), np.arange(len(bit))
        for d, level in zip(range(depth, -1, -1), levels):
            place, here = level.at(_keys(context[open_], node[open_], d))
            one[open_[here]] = level.stop[place[here]]
            open_ = open_[~here]
        return np.log10(np.where(bit == 1, one, 1 - one)).reshape(-1, 8).sum(axis=1).astype(np.float32)

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [packed(scored(_in_order(unpacked_sorted(k.as_py()), depth), unpacked(n.as_py(), np.int64))) for k, n in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.binary())], ["slot", "keys", "values"])
    return rows.mapInArrow(downward, "slot int, keys binary, values binary")


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, chunk, keys, values) in order of slot, a slot's own row (no chunk) first: (chunk, slot, keys, values), the slot's values of the chunk's keys."""
    keys = values = None
    for batch in batches:
        out = []
        for slot, chunk, own, given in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if chunk is None:
                words = slot >= SLOTS
                values = unpacked(given, np.int64 if words else np.float32)
                keys = {w: i for i, w in enumerate(unpacked_words(own))} if words else unpacked_sorted(own)
                continue
            at = [keys[w] for w in unpacked_words(own)] if slot >= SLOTS else np.searchsorted(keys, unpacked_sorted(own))
            out.append((chunk, slot, own, packed(values[at])))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["chunk", "slot", "keys", "values"])


RESULT = ("doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, "
          "bits_per_byte double")


class _Scores:
    """A chunk on its way back: its pieces, compressed, and the windows and words of its slots with their values."""

    def __init__(self, depth: int, total: int, known: int):
        self.depth, self.total, self.floor = depth, total, math.log10(total + known + 1)
        self.pieces, self.windows, self.lp, self.words, self.docs = [], [], [], {}, {}

    def add_piece(self, data, doc_ids, docs, train, sizes) -> None:
        self.pieces.append((data, docs, sizes))
        self.docs.update(zip(docs, zip(doc_ids, train)))

    def add_slot(self, slot, keys, values) -> None:
        if slot < SLOTS:
            self.windows.append(unpacked_sorted(keys))
            self.lp.append(unpacked(values, np.float32))
        else:
            self.words.update(zip(unpacked_words(keys), unpacked(values, np.int64).tolist()))

    def rows(self) -> pa.RecordBatch:
        windows, lp = np.concatenate(self.windows), np.concatenate(self.lp)
        self.windows = self.lp = None
        n = len(self.docs)
        tokens, had, base, score, size = (np.zeros(n) for _ in range(5))
        for data, docs, sizes in self.pieces:
            piece = Piece(zstandard.ZstdDecompressor().decompress(data), docs, sizes, self.depth)
            own = piece.windows()
            order = np.argsort(own)  # sorted questions are answered several times as fast
            own = own[order]
            found = np.empty(len(own), np.float32)
            found[order] = lp[np.searchsorted(windows, own)]
            np.add.at(score, piece.docs, np.add.reduceat(found, np.cumsum(piece.sizes) - piece.sizes, dtype=float))
            np.add.at(size, piece.docs, piece.sizes)
            names, code, text = piece.words()
            count = np.array([self.words.get(w, 0) for w in names.to_pylist()], np.int64)
            for total, value in ((tokens, np.ones(len(count))), (had, (count > 0).astype(float)), (base, np.log10(count + 1.0))):
                np.add.at(total, piece.docs, np.bincount(text, value[code], len(docs)))
        ends = self.words[b""]
        tokens, had, base = tokens + 1, had + (ends > 0), base + math.log10(ends + 1)
        ids, train = zip(*(self.docs[i] for i in range(n)))
        columns = [pa.array(ids, pa.int64()), pa.array(train, pa.bool_()), pa.array(tokens.astype(np.int64)), pa.array(np.rint(had).astype(np.int64)),
                   pa.array(np.full(n, self.total, np.int64)), pa.array(base - tokens * self.floor), pa.array(score), pa.array(size.astype(np.int64)),
                   pa.array(-score * math.log2(10) / size)]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RESULT.split(", ")])


def _scored(depth: int, total: int, known: int):
    """Rows in order of chunk, place and slot, pieces first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, scores = None, None
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if row["chunk"] != current:
                    if scores:
                        yield scores.rows()
                    current, scores = row["chunk"], _Scores(depth, total, known)
                if row["place"] is not None:
                    scores.add_piece(row["keys"], row["doc_ids"], row["docs"], row["train"], row["sizes"])
                else:
                    scores.add_slot(row["slot"], row["keys"], row["values"])
        if scores:
            yield scores.rows()
    return run


def score_texts(docs: DataFrame, train: Column, depth: int = DEPTH) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) per row of ``docs``.

    Rows where ``train`` holds teach both models. ``score`` is the log10 probability of the coded bytes under the weighted
    context tree, ``base_score`` that of the words and the end under add-one counts. Null and empty texts have one token, the end. Repeated
    rows count and are scored each. Without training rows every bit has probability one half. A null ``train`` is false. An empty table gives no rows; other
    columns are not read. A very long text is coded, sorted and looked up in pieces.

    Lists meet by slot once to be counted and once to be answered; pieces meet their chunk's answers once. A frequent window or word has one entry per chunk.
    A task holds the distinct windows of one chunk, or of one slot.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), text_bytes().alias("text"))
    units = written(rows.mapInArrow(_chunks(depth), _UNITS_SQL), "units")
    lists, pieces = units.where("slot is not null"), units.where("slot is null")
    counts = written(lists.select("slot", "keys", "values").repartition("slot").sortWithinPartitions("slot").mapInArrow(
        _slot_counts, "slot int, keys binary, values binary, total long, known long"), "counts")
    total, known = counts.where(F.col("slot") >= SLOTS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    scores = window_scores(counts.where(F.col("slot") < SLOTS), depth).unionByName(
        counts.where(F.col("slot") >= SLOTS).select("slot", "keys", "values"))
    none = F.lit(None).cast("long").alias("chunk")
    asked = lists.select("slot", "chunk", "keys", F.lit(None).cast("binary").alias("values")).unionByName(written(scores, "scores").select("slot", none, "keys", "values"))
    answers = asked.repartition("slot").sortWithinPartitions("slot", F.asc_nulls_first("chunk")).mapInArrow(_answers, "chunk long, slot int, keys binary, values binary")
    back = pieces.unionByName(answers, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_last("place"), "slot")
    return back.mapInArrow(_scored(depth, total, known), RESULT)


def op3_ctw(spark, sf_dir: str) -> DataFrame:
    """``score_texts`` of all documents, learned from those whose crc32(doc_id) modulo 7 is not 2; rows and defined cases are its own."""
    found = score_texts(read_table(spark, sf_dir, "documents"), id_remainder("doc_id", 7) != 2)
    return found.select("doc_id", (id_remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                        "n_bytes", "bits_per_byte")
