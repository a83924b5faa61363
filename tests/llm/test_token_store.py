"""Token ids in ORC: ids against the library, files read back, pruning by index and Bloom filter."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marketloom.llm import token_store, tokens
from marketloom.session import scratch_path

ODD = ["", " ", "  lead", "a  b", "a\n b", "a \n b\t c", "tab\tq  ", "<|endoftext|> a <|endoftext|>b", "don't we'll  I'm", "日本語 テキスト 😀", "\x1c a",
       "trail ", "a" * 3000, "x▁y z", "a\x00b c", "\n", "a   b    c", "　 q 　", "été à la plage"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(token_store.default_vocabulary())


def want_rows(rows, library):
    """(doc_id, start, n_tokens, crc) in order of doc_id, and of place for equal ids."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("slice_bytes", [16 << 20, 40])
def test_units_give_the_ids_of_the_whole_text(library, monkeypatch, slice_bytes):
    monkeypatch.setattr(tokens, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(tokens, "_GATHERED", 9)
    texts = ODD + [" ".join(f"w{k % 7}x, end{k}." for k in range(200)), *ODD]
    got = [[] for _ in texts]
    for row, ids in tokens.Encoder(token_store.default_vocabulary())(pa.array(texts)):
        got[row] += ids.tolist()
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


_ENCODERS = []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'sét.,  \n\t▁1<|>endoftx　 😀", max_size=60))
def test_units_of_random_texts(library, text):
    if not _ENCODERS:
        _ENCODERS.append(tokens.Encoder(token_store.default_vocabulary()))
    got = [i for _, ids in _ENCODERS[0](pa.array([text])) for i in ids.tolist()]
    assert got == library.encode(text, add_special_tokens=False).ids


def test_round_trip_with_ties_and_rows_of_pieces(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "PIECE_IDS", 16)
    rows = [(i % 23 - 2, t) for i, t in enumerate(ODD * 3)] + [(None, "no id"), (None, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = scratch_path(spark, "ids")
    token_store.write_token_ids(docs, path, token_store.default_vocabulary())
    got = [tuple(r) for r in token_store.document_digests(spark, path).orderBy("start").collect()]
    # equal ids may follow each other in any order
    assert sorted((r[0] or -99, r[2], r[3]) for r in got) == sorted((r[0] or -99, r[2], r[3]) for r in want_rows(rows, library))
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    whole = {tuple(r.ids) for r in token_store.document_ids(spark, path, [5]).collect()}
    assert whole == {(*library.encode(t, add_special_tokens=False).ids, 2) for d, t in rows if d == 5}


def test_query_on_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in token_store.op11_orc(spark, sf).collect()) == sorted(want_rows(rows, library))


def test_indexes_and_bloom_filters_skip_rows(spark):
    """Ids are all even: an odd one lies between the least and the greatest of its run of rows, so only the Bloom filter can rule it out."""
    path = scratch_path(spark, "pruned")
    docs = spark.range(20_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).coalesce(1)
    token_store.write_token_ids(docs, path, token_store.default_vocabulary())

    def rows_read(doc_id):
        found = token_store.read_token_ids(spark, path).where(F.col("doc_id") == doc_id)
        assert "EqualTo(doc_id," in found._jdf.queryExecution().toString()
        found.write.format("noop").mode("overwrite").save()
        scan = found.select("doc_id")
        scan.collect()
        plan = scan._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
        return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    assert 0 < rows_read(20_000) <= 2000 and sum(rows_read(d) for d in range(10_001, 10_201, 20)) <= 3000


def test_awkward_rows(spark, awkward, no_docs, library):
    path = scratch_path(spark, "awkward")
    token_store.write_token_ids(awkward, path, token_store.default_vocabulary())
    got = [tuple(r) for r in token_store.document_digests(spark, path).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want_rows([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()], library)))
    none = scratch_path(spark, "none")
    token_store.write_token_ids(no_docs, none, token_store.default_vocabulary())
    assert token_store.document_digests(spark, none).count() == 0


def test_crc32_of_joined_strings():
    rng = np.random.default_rng(1)
    for a, b in rng.integers(0, 5000, (20, 2)):
        x, y = rng.bytes(a), rng.bytes(b)
        assert token_store.crc32_before(zlib.crc32(x), len(y)) ^ zlib.crc32(y) == zlib.crc32(x + y)
