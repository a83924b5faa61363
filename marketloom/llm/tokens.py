"""Whole texts to token ids: a text is cut into units that no token crosses, and each distinct unit of a slice of texts is encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut into units together; a longer text is cut in parts.
SLICE_BYTES = 16 << 20
_JOINED = 4000
_GATHERED = 1 << 20

# A blank after something else than a blank and before something that is no white space: neither vocabulary has a token across it.
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")
# Letters that any version of Unicode calls letters, and the marks that may end a word.
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_MARKS = ".,;:!?"


@dataclass
class Units:
    """Units of some texts. ``words``: distinct units that are a blank and a word; ``others``: distinct units as they stand. ``code`` numbers the units of
    all texts one after another, words first; ``counts`` has the units of each text, ``rows`` the row each text or part of a text comes from."""
    words: pa.Array
    others: list[str]
    code: np.ndarray
    counts: np.ndarray
    rows: np.ndarray

    def strings(self) -> list[str]:
        return [" " + w for w in self.words.to_pylist()] + self.others


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs given by start and size, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _odd_units(text: str, lead: str) -> list[str]:
    whole = lead + text
    cuts = [m.start() for m in _CUT.finditer(whole)]
    return [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])] if whole else []


def cut_units(texts: pa.Array, leads: list[str], rows: np.ndarray) -> Units:
    """Units of each ``lead + text``; a lead is a blank or nothing. Texts with runs of blanks and the like are cut one by one."""
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten().dictionary_encode()
    words, code = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
    odd = pc.or_(pc.equal(pc.binary_length(words), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(words, 0, 1))).to_numpy(zero_copy_only=False)
    is_odd = np.logical_or.reduceat(odd[code], offsets[:-1])
    others: dict[str, int] = {}

    def other(unit):
        return len(words) + others.setdefault(unit, len(others))
    bare = np.flatnonzero(~is_odd & np.array([not x for x in leads]))  # texts that begin without a blank
    first = code[offsets[bare]]
    code[offsets[bare]] = [other(w) for w in words.take(pa.array(first)).to_pylist()]
    counts = np.diff(offsets).astype(np.int64)
    if is_odd.any():
        runs, last = [], 0
        for i in np.flatnonzero(is_odd):
            own = [other(u) for u in _odd_units(texts[int(i)].as_py(), leads[i])]
            runs += [code[offsets[last]: offsets[i]], np.array(own, np.int64)]
            counts[i], last = len(own), i + 1
        code = np.concatenate([*runs, code[offsets[last]:]])
    return Units(words, list(others), code, counts, rows)


def _parts(text: str) -> Iterator[str]:
    """Parts of a long text that begin at a cut; all but the first lack the blank they begin with."""
    first = 0
    while len(text) - first > SLICE_BYTES // 4:
        cut = _CUT.search(text, first + SLICE_BYTES // 4)
        if not cut:
            break
        yield text[first: cut.start()]
        first = cut.end()
    yield text[first:]


def sliced_units(texts: pa.Array, lead: str) -> Iterator[Units]:
    """``cut_units`` for slices of a column without nulls. A text is never in two slices; one beyond SLICE_BYTES is a slice of its own, cut in parts."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, first = np.r_[0, np.cumsum(size)], 0
    while first < len(texts):
        end = int(np.searchsorted(upto, upto[first] + SLICE_BYTES, side="right")) - 1
        if end > first:
            yield cut_units(texts.slice(first, end - first), [lead] * (end - first), np.arange(first, end))
        else:
            end = first + 1
            parts = list(_parts(texts[first].as_py()))
            yield cut_units(pa.array(parts, pa.string()), [lead, *[" "] * (len(parts) - 1)], np.full(len(parts), first))
        first = end


def model_without_store(path: str):
    """The vocabulary's merges without the library's own store of words, which only costs time where every word comes once."""
    from tokenizers import models
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    options = {k: model[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback") if model.get(k)}
    return models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **options)


def _encoded(tokenizer, strings: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]


class ByteVocabulary:
    """A byte-level vocabulary of the tokenizers library. ``plain_marks``: strings of special tokens inside a text are ordinary text."""

    def __init__(self, path: str, plain_marks: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_marks
        self.tokenizer.model = model_without_store(path)
        # a blank and letters are one unit of the vocabulary's pattern, which need not be looked for there
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        entries = self.tokenizer.get_vocab()
        #: Bytes of each token: the entries spell one byte as one character.
        self.size = np.zeros(max(entries.values()) + 1, np.int64)
        self.size[list(entries.values())] = [len(e) for e in entries]
        self.marks = {ord(m): _encoded(self.tokenizer, [m])[0] for m in _MARKS}

    def _words(self, tokenizer, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = [np.empty(0, np.int32)], np.zeros(len(words), np.int64)
        spelled = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        for k in range(0, len(words), _JOINED):
            ids = _encoded(tokenizer, [" " + " ".join(words.slice(k, _JOINED).to_pylist())])[0]
            upto = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(spelled[k: k + _JOINED]), side="right")
            sizes[k: k + _JOINED] = np.diff(upto, prepend=0)
            out.append(ids)
        return np.concatenate(out), sizes

    def encode(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all distinct units and the number of ids of each. A word of letters and a mark behind it share no token: such words are
        encoded without the mark."""
        words = units.words
        stems = pc.utf8_rtrim(words, characters=_MARKS)
        one = pc.equal(pc.subtract(pc.binary_length(words), pc.binary_length(stems)), 1)
        marked = pc.and_(one, pc.match_substring_regex(stems, _LETTERS))
        base = pc.if_else(marked, stems, words).dictionary_encode()
        plain = pc.match_substring_regex(base.dictionary, _LETTERS)
        (ids, sizes), (more_ids, more_sizes) = (self._words(self.letters, base.dictionary.filter(plain)),
                                                self._words(self.tokenizer, base.dictionary.filter(pc.invert(plain))))
        ids, sizes = np.concatenate([ids, more_ids]), np.r_[sizes, more_sizes]
        place = np.empty(len(sizes), np.int64)  # of each distinct word among the encoded ones
        plain = plain.to_numpy(zero_copy_only=False)
        place[np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]] = np.arange(len(sizes))
        at = place[base.indices.to_numpy()]
        starts, sizes = (np.cumsum(sizes) - sizes)[at], sizes[at]
        marked = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        raw, ends = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1:]
        mark = raw[ends[marked] - 1]
        more = np.zeros(len(words), np.int64)
        for m, own in self.marks.items():
            more[marked[mark == m]] = len(own)
        whole = np.empty(int((sizes + more).sum()), np.int32)
        first = np.cumsum(sizes + more) - sizes - more
        whole[ragged(first, sizes)] = ids[ragged(starts, sizes)]
        for m, own in self.marks.items():
            of = marked[mark == m]
            for k, i in enumerate(own):
                whole[first[of] + sizes[of] + k] = i
        others = _encoded(self.tokenizer, units.others)
        return np.concatenate([whole, *others]), np.r_[sizes + more, np.array([len(x) for x in others], np.int64)]


class Encoder:
    """Ids of whole texts, equal to those the library gives for the text in one piece."""

    def __init__(self, path: str):
        self.vocabulary = ByteVocabulary(path)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of each text or, for long texts, of its parts one after another; ``texts`` has no nulls."""
        for units in sliced_units(texts, ""):
            ids, sizes = self.vocabulary.encode(units)
            starts = np.cumsum(sizes) - sizes
            upto = np.r_[0, np.cumsum(units.counts)]
            first = 0
            while first < len(units.rows):  # some texts at a time
                end = max(first + 1, int(np.searchsorted(upto, upto[first] + _GATHERED, side="right")) - 1)
                code = units.code[upto[first]: upto[end]]
                own = ids[ragged(starts[code], sizes[code])]
                cuts = np.r_[0, np.cumsum(sizes[code])][upto[first + 1: end] - upto[first]]
                yield from zip(units.rows[first: end].tolist(), np.split(own, cuts))
                first = end
