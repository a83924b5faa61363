"""Near duplicates by five-word Jaccard similarity, against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import jaccard
from marketloom.llm.simhash import RADIUS, fingerprint


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i:i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()


def brute(texts, similarity=0.8):
    label, sets = {i: i for i in texts}, {i: shingles(t) for i, t in texts.items()}
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x == y or (x | y and len(x & y) / len(x | y) >= similarity):
                low, high = sorted((label[a], label[b]))
                if low != high:
                    label = {i: low if c == high else c for i, c in label.items()}
    return label


@pytest.fixture(scope="module")
def copies():
    """Copies of 60 texts, in each of which some words are changed, so that similarities lie on both sides of 0.8, and short and empty texts."""
    rng = np.random.default_rng(3)
    out = []
    for _ in range(60):
        base = [f"w{k}" for k in rng.integers(0, 5000, rng.integers(20, 300))]
        out.append(" ".join(base))
        for _ in range(4):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(1, max(2, len(words) // 30))):
                words[at] = f"v{rng.integers(0, 5000)}"
            out.append(" ".join(words).upper())
    out += ["", None, " \n", "one two", "One  two", "two one", "a b c d e", "a b c d e f"]
    return dict(enumerate(out))


def test_components_equal_brute_force(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 3)
    docs = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    want = brute(copies)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == want and len(set(want.values())) > 70


def test_stage_drops_texts_of_similarity_0_8(spark, copies):
    docs = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    kept = {r[0] for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert kept == {i for i, c in brute(copies).items() if i == c}


def test_rows_without_ids_and_repeated_rows(spark, awkward, no_docs):
    rows = jaccard.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count() and {r.component_id for r in rows if r.doc_id in (1, 6)} == {1}
    assert {r.component_id for r in rows if r.doc_id is None} == {None} and jaccard.near_duplicates(no_docs).count() == 0
    assert jaccard.near_duplicates(awkward.where(F.col("doc_id").isNotNull())).where("doc_id = 3").first().component_id == 2


def test_links_of_the_index_do_not_need_a_band(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard, "band_count", lambda similarity: 1)  # one band of six bytes misses many pairs
    texts = {i: t for i, t in copies.items() if t and len(t.split()) > 5}
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    fps, sets = {i: fingerprint(t.encode()) for i, t in texts.items()}, {i: shingles(t) for i, t in texts.items()}
    near = [(a, b) for a in texts for b in texts if a < b and (fps[a] ^ fps[b]).bit_count() <= RADIUS and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) >= 10 and all(got[a] == got[b] for a, b in near)
    want = brute(texts)
    assert all(want[i] == want[c] for i, c in got.items())


def test_rows_without_ids_are_compared_too(spark):
    words = [f"w{k}" for k in range(100)]
    near, other = " ".join(["new", *words[1:]]), " ".join(f"x{k}" for k in range(50))
    docs = spark.createDataFrame([(7, " ".join(words), 1), (None, near, 2), (None, other, 3), (None, other.upper(), 4), (None, "one of its kind", 5),
                                  (9, " ".join(words), 6), (9, "another text", 7), (9, "another text", 8)], "doc_id long, text string, _own int")
    left = corpus_pipeline.near_dedup(spark, docs, "")
    got = {(r.doc_id, r._own) for r in left.collect()}
    assert left.columns == docs.columns and (7, 1) in got and (None, 5) in got and len(got & {(None, 3), (None, 4)}) == 1
    assert (None, 2) not in got and not got & {(9, 6), (9, 7), (9, 8)}
