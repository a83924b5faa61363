"""Classifiers by held-out accuracy, archives by round trip, lattice and decontamination against brute force, and the pipeline."""

import io

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from marketloom.llm import decontaminate, language, lattice, quality, toxicity, warc
from marketloom.llm.queries import ORACLES, QUERIES
from marketloom.session import scratch_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


def test_toxicity_on_held_out_rows(spark, labels):
    rows = toxicity.op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted == 1 for r in rows if r.toxic == 1) / sum(r.toxic == 1 for r in rows)
    false = sum(r.predicted == 1 for r in rows if r.toxic == 0) / sum(r.toxic == 0 for r in rows)
    assert hit > 0.7 and false < 0.02


def test_ftrl_keeps_only_grams_that_matter():
    rng = np.random.default_rng(0)
    model = toxicity.Ftrl(200, l1=4.0)
    for _ in range(600):
        label = int(rng.integers(0, 2))
        model.learn(np.unique(np.r_[rng.integers(1, 200, 20), [0] if label else []]).astype(int), label)
    weights = model.weights()
    assert weights[0] > 3 and np.count_nonzero(weights) < 60 and np.abs(weights[1:]).max() < 1


def test_language_on_held_out_rows(spark, docs):
    rows = language.op10_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_codewords_differ():
    for n in (2, 3, 4, 7, 8, 20):
        code = language.codewords(n)
        distance = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(distance) >= (1 if n == 2 else 2) and ((code.sum(axis=0) > 0) & (code.sum(axis=0) < n)).all()


def test_one_wrong_bit_is_corrected():
    model = language.LanguageModel(["a", "b", "c", "d"], np.ones((4, 8)))
    margins = np.where(model.code == 1, 1.0, -1.0)
    for wrong in range(model.code.shape[1]):
        flipped = margins.copy()
        flipped[:, wrong] *= -1
        best, score, ambiguous = model.decode(flipped)
        assert best.tolist() == [0, 1, 2, 3]
    assert model.decode(np.zeros((1, model.code.shape[1])))[2].all()


def test_quality_on_held_out_rows(spark, labels):
    rows = quality.op4_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert all(r.kept for r in rows if r.quality == 1) and np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_sparse_sites_are_drawn_to_the_overall_rate(spark):
    # host "good": 200 good documents; host "bad": 200 bad ones; host "new": one document
    rows = [("good", "p", 6.0)] * 200 + [("bad", "p", -6.0)] * 200 + [("new", "p", 6.0)]
    evidence = spark.createDataFrame(rows, "_host string, _path string, _evidence double")
    found = {r._host: r for r in quality.site_posteriors(evidence, quality.QualityModel(np.zeros(len(quality.FEATURES)), 0.0, 0.5)).collect()}
    assert found["good"].host_rate > 0.95 and found["bad"].host_rate < 0.05 and 0.5 < found["new"].host_rate < 0.9


def test_models_on_awkward_rows(spark, awkward, no_docs, labels, docs):
    tox, lang, good = toxicity.fit_toxicity(docs, labels), language.fit_language(docs), quality.fit_quality(docs, labels)
    assert toxicity.score_toxicity(awkward, tox).where("score >= 0 and score <= 1").count() == awkward.count()
    found = {r.doc_id: r for r in language.identify(awkward, lang).collect()}
    assert {found[i].lang_pred for i in (2, 3, 4, 8, 11)} == {"und"} and found[2].score == 0 and found[5].lang_pred in lang.languages
    scored = quality.score_quality(awkward, good)
    assert scored.columns[: len(awkward.columns)] == awkward.columns and scored.where("quality between 0 and 1").count() == awkward.count()
    assert quality.keep_good(awkward, good).columns == awkward.columns
    for got in (toxicity.score_toxicity(no_docs, tox), language.identify(no_docs, lang), quality.score_quality(no_docs, good)):
        assert got.count() == 0
    none = labels.where("false")
    assert toxicity.score_toxicity(awkward, toxicity.fit_toxicity(awkward, none)).count() == awkward.count()
    assert quality.score_quality(awkward, quality.fit_quality(awkward, none)).count() == awkward.count()
    assert {r.lang_pred for r in language.identify(awkward, language.fit_language(no_docs)).collect()} == {"und"}


def test_decontamination_on_awkward_rows(spark, awkward, no_docs):
    items = spark.createDataFrame([(1, "Plain words make a plain text, and it is long enough"), (2, None), (3, ""), (4, "one"), (5, "nowhere to be found in any of these texts"), (None, "one"),
                                   (1, "Plain words make a plain text, and it is long enough")], "item_id long, text string")
    want = {(1, 1), (6, 1), (9, 4)}
    for send in (True, False):
        got = decontaminate.contaminated(awkward, items, send=send)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
        kept = decontaminate.drop_contaminated(awkward, items, send=send)
        assert kept.columns == awkward.columns and kept.count() == awkward.count() - 4
        assert decontaminate.contaminated(no_docs, items, send=send).count() == 0
        assert decontaminate.contaminated(awkward, items.where("false"), send=send).count() == 0


def test_sketches_are_long_enough():
    for n in range(1, 300):
        for least in (0.5, 0.8, 1.0):
            missing = n - int(np.ceil(least * n - 1e-9))
            assert min(n, missing + 1) <= decontaminate.sketch_rows(n, least) <= n


def test_benchmark_passage_inside_a_very_long_text(spark):
    filler = [f"f{i}" for i in range(60_000)]
    item = [f"b{i}" for i in range(24)]
    damaged = item[:]
    damaged[-1] = "x"
    rows = [(1, " ".join(filler[:30_000] + item + filler[30_000:])), (2, " ".join(filler[:40_000] + damaged + filler[40_000:])), (3, " ".join(filler)), (4, " ".join(filler + item[:15]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.shared, r.item_shingles) for r in got) == [(1, 20, 20), (2, 19, 20)]


def test_archives_round_trip(spark):
    big = "<p>" + "x y z " * 30
    rows = [(5, "http://a/ b\r\n", big), (3, None, big), (4, "u", None), (None, "u", big), (6, "u", ""), (7, "u", "short"), (8, "v", "short"), (3, "again", big), (9, "é", "<html>é</html>" * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("head", F.lit(1)).withColumn("first", F.lit(2))
    records = warc.page_records(pages)
    for dictionary in (b"", warc.train_dictionary(warc.page_records(spark.read.parquet(f"{SF}/pages.parquet")))):
        archives = warc.write_archives(records, scratch_path(spark, "warc"), dictionary, file_bytes=200)
        got = warc.read_archives(archives, payloads=True).collect()
        assert sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes, bytes(r.payload).decode()) for r in got) == sorted(
            (str(i), "revisit" if html == big and i != 3 else "response", "3" if html == big and i != 3 else "None", len((html or "").encode()),
             "" if html == big and i != 3 else html or "") for i, _, html in rows)
    assert warc.read_archives(warc.write_archives(records.where("false"), scratch_path(spark, "warc"), b"")).count() == 0
    assert warc.train_dictionary(records.where("false")) == b""


def test_dictionary_frame_leads_the_file(spark):
    records = warc.page_records(spark.read.parquet(f"{SF}/pages.parquet"))
    dictionary = warc.train_dictionary(records)
    with_one = warc.write_archives(records.coalesce(1), scratch_path(spark, "warc"), dictionary).collect()
    without = warc.write_archives(records.coalesce(1), scratch_path(spark, "warc"), b"").collect()
    assert with_one[0].bytes < without[0].bytes
    data = open(with_one[0].file.removeprefix("file:"), "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    heads = [h["warc-type"] for h, _ in warc.read_records(io.BytesIO(data))]
    assert heads[0] == "warcinfo" and len(heads) == 251
    with open(with_one[0].file.removeprefix("file:"), "wb") as f:
        f.write(data[:-20])
    with pytest.raises(Exception, match="records instead of"):
        warc.read_archives(spark.createDataFrame(with_one)).collect()


def brute_links(rows, least):
    unit = {}
    for k, (vec_id, vector, label) in enumerate(rows):
        if label is not None and vector and None not in vector and np.isfinite(vector).all() and np.any(vector):
            unit[k] = np.array(vector) / np.linalg.norm(vector)
    links = {k: set() for k in range(len(rows))}
    for a in unit:
        for b in unit:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a].add(b)
                links[b].add(a)
    return links


def test_lattice_equals_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(250).collect()]
    rows += [(i + 5000, v, l) for i, v, l in rows[:20]] + [(9001, None, 1), (9002, [0.0] * 64, 1), (9003, [1.0] * 64, None), (9004, [float("nan")] + [1.0] * 63, 2),
                                                          (9005, [1.0, 2.0], 1), (9006, [], 1), (9007, [None] + [1.0] * 63, 1), (9008, [float("inf")] + [1.0] * 63, 1)]
    rng = np.random.default_rng(1)
    for k in range(120):  # one hot group of near copies
        rows.append((7000 + k, (np.array(rows[3][1]) + rng.normal(0, 0.004, 64)).tolist(), rows[3][2]))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("n", F.lit(1))
    links = brute_links(rows, lattice.COSINE)
    for options in ({}, {"block_rows": 16}):
        got = {r.vec_id: r for r in lattice.similar_vectors(table, **options).collect()}
        assert len(got) == len(rows)
        found, wanted = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
        assert 0.9 * wanted <= found <= wanted
        assert all(got[rows[k][0]].n_links <= len(links[k]) for k in links)
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9001, 9009))
    assert lattice.similar_vectors(table.where("false")).count() == 0


def test_lattice_points_are_nearest():
    x = np.random.default_rng(2).normal(0, 1.5, (300, 8))
    got = lattice.e8_points(x, 3) / 2
    assert (np.all(got == np.rint(got), axis=2) | np.all(got - 0.5 == np.rint(got - 0.5), axis=2)).all() and (got.sum(axis=2) % 2 == 0).all()
    offsets = np.array([o for o in np.ndindex(*[3] * 8)]) - 1.0
    for row, point in zip(x[:20], got):
        all_points = np.concatenate([s + np.rint(row - s) + offsets for s in (0.0, 0.5)])
        all_points = all_points[all_points.sum(axis=1) % 2 == 0]
        best = np.sort(((all_points - row) ** 2).sum(axis=1))
        assert ((point[0] - row) ** 2).sum() == pytest.approx(best[0]) and ((point[1] - row) ** 2).sum() == pytest.approx(best[1])


def test_pipeline_stages_take_effect(spark, docs, labels):
    kept = docs
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
        ids[name] = {r[0] for r in kept.select("doc_id").collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert all((i in ids["quality"]) == (q == 1) for i, q in marks.items() if i in {r[0] for r in docs.select("doc_id").collect()})
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    groups = {r.doc_id: r.component_id for r in corpus_pipeline.near_duplicates(first).collect()}
    assert ids["near_dedup"] == {i for i, c in groups.items() if i == c}
    leaks = {r[0] for r in decontaminate.op7_decontamination(spark, SF).select("doc_id").collect()}
    assert ids["decontamination"] == ids["near_dedup"] - leaks and ids["secrets"] == ids["decontamination"]
    from marketloom.llm.secret_scan import find_secrets
    assert find_secrets(kept).where(F.size("spans") > 0).count() == 0 and kept.where("text like '%[SECRET]%'").count() > 0
    pieces = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == ids["secrets"]


def test_stages_on_awkward_rows(spark, awkward, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, awkward, SF)
        if name != "packing":
            assert got.columns == awkward.columns
        assert got.count() > 0 and stage(spark, no_docs, SF).count() == 0
    left = corpus_pipeline.near_dedup(spark, awkward, SF)
    assert left.where("doc_id = 1").count() == 1 and left.where("doc_id = 6").count() == 0 and left.where("doc_id is null").count() == 1
    assert left.where("doc_id in (2, 3, 4, 11)").count() == 1  # texts without words are copies of each other


def test_every_operator_is_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
