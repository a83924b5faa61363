"""Alignment of two tokenizations, against both libraries on whole texts and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from marketloom.llm import alignment, tokens

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  lead", "a  b", "a\n b", "tab\tq  ", "<|endoftext|> a <s>b</s>", "don't we'll  I'm", "日本語 テキスト 😀", "trail ", "a" * 2000, "x▁y z",
         "a\x00b c", "\n", "a   b    c", "　 q 　", "été à la plage", "the cat sat on the mat", "The cat sat. The cat sat!", "the cat sat on the mat"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    spelled = alignment.byte_of()
    a_bytes = {i: bytes(spelled[c] for c in e) for e, i in a.get_vocab().items()}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def brute(rows, libraries):
    a, b, a_bytes, b_bytes = libraries
    docs = []
    for doc_id, text in rows:
        whole = " " + (text or "")
        ids_a, ids_b = a.encode(whole, add_special_tokens=False).ids, b.encode(text or "")
        spelled_a, spelled_b = [a_bytes[i] for i in ids_a], [b_bytes(i) for i in ids_b]
        if not text or b"".join(spelled_a) != whole.encode() or b"".join(spelled_b) != whole.encode():
            docs.append((doc_id, 0, 0, "", []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in spelled_a]).tolist(), np.cumsum([len(x) for x in spelled_b]).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            links.append((ids_a[x - 1], ids_b[y - 1]))
            i, j = x, y
        docs.append((doc_id, len(ids_a), len(ids_b), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    count = Counter(link for d in docs for link in d[4])
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(((i, n_a, n_b, len(links), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), sha)
                   for i, n_a, n_b, sha, links in docs), key=str)


def rows_of(found):
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_equals_both_libraries(spark, libraries, monkeypatch, small):
    if small:
        monkeypatch.setattr(alignment, "_BATCH", 3)
        monkeypatch.setattr(tokens, "SLICE_BYTES", 50)
    rows = [*enumerate(TEXTS), (None, "the cat"), (18, "the cat sat on the mat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert rows_of(alignment.align_tokens(docs, BYTES, PIECES)) == brute(rows, libraries)


def test_query_on_documents(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(alignment.op13_alignment(spark, sf)) == brute(rows, libraries)


def test_awkward_rows(spark, awkward, no_docs, libraries):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert rows_of(alignment.align_tokens(awkward, BYTES, PIECES)) == brute(rows, libraries)
    assert alignment.align_tokens(no_docs, BYTES, PIECES).count() == 0
    assert alignment.align_tokens(awkward.where(F.col("text").isNull()), BYTES, PIECES).count() == 2


def test_gallop_finds_every_place():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 300, rng.integers(0, 200)))
        b = np.unique(rng.integers(0, 300, rng.integers(0, 200)))
        cut = rng.integers(0, len(b) + 1)
        found = alignment.gallop(a, b, np.full(len(a), cut), np.full(len(a), len(b)))
        place = {x: i for i, x in enumerate(b.tolist()) if i >= cut}
        assert found.tolist() == [place.get(x, -1) for x in a.tolist()]
