"""Every operator and stage over nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import fingerprint, gif, html_text, mixing, near_dedup, packing, quality, toxicity, url_filter, warc
from tarn.llm.common import shared_path, stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, y int, `a.b` map<string,int>, rep long, target double, _mix_size string, _mix_copies long, _kept long"
LONG = "word " * 30_000 + "end"


def documents(spark):
    texts = [None, "", "   \n", "one", "one two", "the same text of some words that repeats here", "the same text of some words that repeats here", LONG, "é ü ß ñ", "x" * 9000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None, 7, 1, {"k": i}, 5, 1.5, "own", 3, None) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "without an id", None, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def labels(spark):
    rows = [(i, 1 if i % 2 else 0, 1 if i % 3 == 0 else 0) for i in range(10)] + [(3, 0, 0), (None, 1, 1), (4, None, None), (5, 7, 9)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def pages(spark):
    html = "<html><body><nav><a>m</a></nav><article><h1>T</h1><p>" + "a b " * 600 + "</p></article></body></html>"
    rows = [(1, "https://A.com/x", html, 1), (2, None, html, 1), (3, "no scheme", None, 1), (4, "http://h.net/es/1?q=1", "", 1), (4, "http://h.net/es/1?q=1", "", 1), (None, "http://h.org/\n", html, None), (9, "https://a.com/x", "<p>" + LONG, 2)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, content int")


OPERATORS = {
    "quality": lambda s, d: quality.score(d, quality.fit(d, labels(s))),
    "quality keep": lambda s, d: quality.keep(d, labels(s)),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s))),
    "toxicity keep": lambda s, d: toxicity.keep(d, labels(s)),
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "mixing": lambda s, d: mixing.plan(d, prefix="_own_"),
    "mix": lambda s, d: mixing.mix(d),
    "fingerprints": lambda s, d: fingerprint.fingerprints(d),
    "packing": lambda s, d: packing.pack(d),
}
#: Rows out of the 13 of documents(); None: depends on the model or the mix.
ROWS = {"quality": 13, "toxicity": 13, "near": 13, "mixing": 13, "fingerprints": 13}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(spark, name):
    docs = documents(spark)
    found = OPERATORS[name](spark, docs).collect()
    if name in ROWS:
        assert len(found) == ROWS[name]
    assert OPERATORS[name](spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, tmp_path, k):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark)
    for rows in (docs, docs.limit(0)):
        found = corpus_pipeline.STAGES[k][1](spark, rows, str(tmp_path))
        if k < 4:
            assert found.columns == docs.columns
        found.write.mode("overwrite").parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 0


def test_no_labels(spark):
    docs, none = documents(spark), labels(spark).limit(0)
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert {round(r["score"], 6) for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}


def test_pages(spark):
    rows = pages(spark)
    assert html_text.extract(rows).count() == 7
    texts = {(r["page_id"], r["url"]): r["text"] for r in html_text.extract(rows).collect()}
    assert texts[(3, "no scheme")] == "" and texts[(2, None)].startswith("T\na b a b") and texts[(9, "https://a.com/x")] == LONG
    judged = {(r["page_id"], r["url"]): r for r in url_filter.judge(rows).collect()}
    assert judged[(1, "https://A.com/x")]["host"] == "a.com" and judged[(2, None)]["host"] == ""
    manifest = stored(warc.write_archives(rows, shared_path(spark, "warc")), "manifest")
    back = warc.resolved(warc.read_records(warc.index_entries(manifest))).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in back) == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (3, "response", 0), (4, "response", 0), (4, "response", 0), (9, "response", 0)]
    assert all(r["payload_bytes"] == (len(LONG) + 3 if r["page_id"] == 9 else 0 if r["page_id"] in (3, 4) else back[0]["payload_bytes"] if r["page_id"] == back[0]["page_id"] else r["payload_bytes"]) for r in back)
    none = rows.limit(0)
    assert html_text.extract(none).count() == url_filter.judge(none).count() == 0
    manifest = stored(warc.write_archives(none, shared_path(spark, "warc")), "manifest")
    assert warc.read_records(warc.index_entries(manifest)).count() == 0


def test_media(spark):
    media = spark.createDataFrame([(1, bytearray(gif.encode(b"abc" * 384))), (2, None)], "k long, g binary")
    assert [(r["k"], r["frame"], r["at_ms"], sum(r["histogram"])) for r in gif.frame_rows(media, "g", "k").collect()] == [(1, 0, 0, 576), (1, 1, 40, 576)]
    assert gif.frame_rows(media.limit(0), "g", "k").count() == 0
    assert [r[:2] for r in gif.measured([None, "", "é" * 288, "x" * 577])] == [(0, 576), (0, 576), (576, 576), (577, 1152)]


def test_planned_copies(spark):
    mixed = mixing.mix(documents(spark)).collect()
    assert mixed and all((r["_mix_size"], r["_mix_copies"]) == ("own", 3) for r in mixed if r["doc_id"] is not None)
    found = mixing.plan(documents(spark).drop("_mix_size", "_mix_copies")).collect()
    assert {r["_mix_size"] for r in found if r["text"] is None or not r["text"].strip()} == {0}
    assert all(0 <= r["_mix_copies"] <= 2 for r in found)
    assert len({r["_mix_target"] for r in found if r["source"] is None}) == 1


def test_near_dedup_values(spark):
    found = {(r["doc_id"], r["n_shingles"]): r for r in near_dedup.near_duplicates(documents(spark)).collect()}
    assert found[(6, 7)]["component_id"] == 5 and not found[(6, 7)]["kept"]
    assert found[(3, 1)]["kept"] and found[(0, 0)]["component_id"] == 0
    assert found[(7, 2)]["kept"]
