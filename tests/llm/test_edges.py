"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import corpus_pipeline
import pytest
from textloom.llm import decontaminate, html, licenses, media, packing, pii, quality, simhash, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over a lazy dog again " * 12_000  # 576,000 characters
TEXTS = [None, "", "   \n\t ", "one", "one", "two words", "A b C d e f g h i j. " * 3, LONG, LONG, "mail a.b@c.example or +1 (212) 555-0100", "Released under the MIT License.", "idiot! you idiot, you moron"]


def rows(n=len(TEXTS)):
    out = [(k, TEXTS[k % len(TEXTS)], "en", "s", 1) for k in range(n)]
    return [*out, out[3], (None, "no id at all", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 3 > 0), int(k == 11)) for k in range(12)] + [(None, 1, 1), (5, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over a lazy dog again the quick"), (2, None), (3, ""), (4, "two words"), (4, "two words")], "item_id long, text string")


def apply(name, docs, labels, benchmark):
    return {
        "media": lambda: media.text_media(docs), "simhash": lambda: simhash.near_duplicates(docs), "toxicity": lambda: toxicity.toxicity(docs, labels),
        "pii": lambda: pii.find_pii(docs), "licenses": lambda: licenses.scan(docs), "decontaminate": lambda: decontaminate.contaminated(docs, benchmark),
        "packing": lambda: packing.pack(docs), "quality": lambda: quality.quality(docs, labels),
    }[name]()


NAMES = ["media", "simhash", "toxicity", "pii", "licenses", "decontaminate", "packing", "quality"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, docs, labels, benchmark):
    got = apply(name, docs, labels, benchmark).collect()
    if name == "decontaminate":
        assert {(r.doc_id, r.item_id) for r in got} == {(7, 1), (8, 1), (5, 4)}
    elif name == "packing":
        assert sum(r.length for r in got if r.start == 0) > 0 and {r.doc_id for r in got} == {*range(12), None}
    else:
        assert sorted((r.doc_id is None, r.doc_id) for r in got if r.doc_id is not None) == sorted((False, r[0]) for r in rows() if r[0] is not None)
        assert sum(r.doc_id is None for r in got) == 1


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, spark, labels, benchmark):
    assert apply(name, spark.createDataFrame([], DOCS), labels, benchmark).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(name, docs, labels, benchmark, spark):
    more = docs
    for c in ("score", "predicted", "held_out", "label", "fp", "component_id", "rank", "length", "part", "words", "low", "w", "edits", "start", "_kept", "DOC"):
        more = more.withColumn(c, docs.source)
    plain, clash = (sorted(map(str, apply(name, d, labels, benchmark).collect())) for d in (docs, more))
    assert plain == clash


def test_no_labels_and_no_benchmark(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert {r.predicted for r in quality.quality(docs, none).collect()} == {1}
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_simhash_ties(docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got[0].fingerprint == got[1].fingerprint == got[2].fingerprint == "0" * 16
    assert got[2].component_id == 0 and got[4].component_id == 3 and got[8].component_id == 7


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "no scheme", "", "x"), (3, "HTTP://A.Example.COM/en/x?q#f", "<p>a&amp;b\n c</p>", "x"), (3, "HTTP://A.Example.COM/en/x?q#f", "<p>a&amp;b\n c</p>", "x"), (20, "ftp://q.org", "plain", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.main_text(pages).collect()}
    assert (got[1].text, got[2].text, got[3].text, got[20].text) == ("", "", "a&b c", "plain") and got[3].n_chars == 5
    judged = sorted(map(tuple, urls.judge(pages, urls.every_twentieth(pages)).drop("listed").collect()))
    x = (3, "a.example.com", "/en/x", "example.com/en/", "block")
    assert judged == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), x, x, (20, "q.org", "", None, "block")]
    assert html.main_text(pages.limit(0)).collect() == [] and urls.judge(pages.limit(0), urls.every_twentieth(pages)).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages(stage, spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, f = corpus_pipeline.STAGES[stage]
    for d in (docs, docs.limit(0), docs.withColumn("score", docs.lang)):
        out = f(spark, d, str(tmp_path))
        got = out.collect()
        assert name == "packing" or out.columns == d.columns
        if d is docs and name == "near_dedup":
            assert sorted(r.doc_id for r in got if r.doc_id is not None) == [0, 3, 5, 6, 7, 9, 10, 11] and len(got) == 9
        if d is docs and name == "decontaminate":
            assert sorted(r.doc_id for r in got if r.doc_id is not None) == [0, 1, 2, 3, 3, 4, 6, 9, 10, 11]
        if d is docs and name == "pii":
            assert [r.text for r in got if r.doc_id == 9] == ["mail <email> or <phone>"] and len(got) == 14


def test_pages_with_nulls_repeats_long_rows_and_clashing_names(spark):
    long = "word, " * 200_000
    rows = [(1, "http://a.com/x", "<p>t</p>"), (1, "http://a.com/x", "<p>t</p>"), (None, None, None), (2, "no scheme", ""), (3, "http://b.net/es/" + "p" * 1_000_000, f"<article><p>{long}</article>")]
    names = ["host", "path", "rule", "verdict", "block", "w0", "text", "n_chars", "said", "canon", "maybe", "listed"]
    pages = spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names))
    got = html.main_text(pages).collect()
    assert sorted((r.page_id or 0, r.text[:9], r.n_chars) for r in got) == [(0, "", 0), (1, "t", 1), (1, "t", 1), (2, "", 0), (3, "word, wor", len(long) - 1)]
    listed = spark.createDataFrame([("a.com/x",), ("a.com/x",), (None,)], "canon string")
    got = urls.judge(pages, listed).collect()
    assert sorted((r.page_id or 0, r.host, len(r.path), r.rule, r.verdict, r.listed) for r in got) == [(0, "", 0, None, "allow", False), (1, "a.com", 2, "com/", "allow", True), (1, "a.com", 2, "com/", "allow", True), (2, "", 0, None, "allow", False), (3, "b.net", 1_000_004, "net/es/", "block", False)]
    assert html.main_text(pages.limit(0)).count() == urls.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_bloom_filter_of_every_size(spark):
    assert [urls.blocks_for(n) for n in (0, 1_000, 2_000, 10**6, 10**9)] == [64, 64, 128, 65_536, 1 << 18]
    pages = spark.range(4000).selectExpr("id as page_id", "concat('http://h', id % 97, '.org/', id) as url")
    listed = spark.range(0, 4000, 3).selectExpr("concat('h', id % 97, '.org/', id) as canon")
    assert {r.page_id: r.verdict for r in urls.judge(pages, listed).collect()} == {k: "allow" if k % 3 else "block" for k in range(4000)}


def test_scores_against_plain_python(spark):
    """Every row's score is what the fitted model gives its text alone."""
    from tests.conftest import TINY

    docs, labels = (spark.read.parquet(f"{TINY}/{n}.parquet") for n in ("documents", "labels"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    model = quality.train(docs, labels)
    for r in quality.score(docs, model).collect():
        assert abs(r.score - float(model.score([text[r.doc_id]])[0])) < 1e-9 and r.predicted == (r.score >= 0.7)
    lexicon, w = toxicity.train(docs, labels)
    for r in toxicity.score(docs, (lexicon, w)).collect():
        z = sum(a * b for a, b in zip(toxicity.features(lexicon, text[r.doc_id]), w))
        assert abs(r.score - 1 / (1 + 2.718281828459045 ** -max(-30, min(30, z)))) < 1e-9


def test_no_table_stays_but_the_result(spark, docs, tmp_path):
    import os

    from textloom.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    simhash.near_duplicates(docs).collect()
    assert len(set(os.listdir(folder)) - before) == 1


def test_stages_with_nulls_repeats_long_rows_and_clashing_names(spark):
    import corpus_pipeline

    from tests.conftest import TINY

    long = " ".join(f"w{k % 9973}x" for k in range(120_000))
    rows = [(1, "Some plain words that make a text of its own kind."), (1, "Some plain words that make a text of its own kind."), (2, None), (3, ""), (None, "Nobody numbered this text, write to a@b.co."), (4, long), (5, long + " end"), (6, "Call +1 212 555 0100 now, all of you out there.")]
    names = ["key", "row", "kept", "place", "least", "node", "label", "score", "path", "n", "part", "local", "length", "start", "id", "bands", "predicted", "held_out", "hit"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["z"] * len(names)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in names))
    want = {"quality": None, "near_dedup": {1, 2, None, 4, 6}, "decontaminate": {1, 2, 3, None, 4, 5, 6}, "pii": {1, 2, 3, None, 4, 5, 6}}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, TINY)
        got = out.collect()
        assert out.columns == docs.columns and all(r.key == "z" and r.place == "z" for r in got)
        assert want[name] is None or {r.doc_id for r in got} == want[name], name
        if name == "near_dedup":
            assert len(got) == 5
        assert stage(spark, docs.limit(0), TINY).count() == 0
    assert {r.text for r in corpus_pipeline.pii_stage(spark, docs, TINY).collect()} >= {None, "Call <phone> now, all of you out there."}
    pieces = corpus_pipeline.packing_stage(spark, docs, TINY).collect()
    assert sum(r.start == 0 for r in pieces) == len(rows) and corpus_pipeline.packing_stage(spark, docs.limit(0), TINY).count() == 0
