"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessel.llm import bpe, embeddings, hmm, langid, line_dedup, packing, pii, simhash, topk, warc
from tessel.llm.common import carried, work_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, ids string, row string, matches string, _1 int"
LONG = "alpha beta gamma delta " * 9000


def docs(spark, rows=None):
    rows = [(1, "One line of some length here\nAnother  line", "en"), (1, "One line of some length here\nAnother  line", "en"), (None, "no id at all", "fr"), (2, None, None), (3, "", "en"), (4, LONG, None), (5, "é😀 " * 50, "fr"), (6, "   \n\t", "en")] if rows is None else rows
    return spark.createDataFrame([(*r, "s", 7, "clash", "k", "i", "r", "m", 1) for r in rows], SCHEMA)


def test_line_dedup(spark):
    out = line_dedup.dedup_lines(docs(spark)).orderBy("id").collect()
    assert len(out) == 8
    assert {(r["id"], r["n_lines"], r["n_dropped"]) for r in out} == {(1, 2, 0), (None, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (5, 1, 0), (6, 2, 0)}
    assert all(r["kept_text"] is not None and r["_rest"]["key"] == "k" for r in out)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_rule(spark):
    line = "A line that is long enough"
    rows = [(i, f"{' ' * i}{line.upper() if i % 2 else line}\t\nown {i}\n{line}", "en") for i in range(1, 5)]
    out = {r["id"]: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert [out[i]["n_dropped"] for i in range(1, 5)] == [2, 2, 2, 0]
    assert out[1]["kept_text"] == "own 1"
    assert line_dedup.dedup_lines(docs(spark, rows[:2])).agg(F.sum("n_dropped")).first()[0] == 0  # two documents are too few
    few = line_dedup.dedup_lines(docs(spark, rows), max_filter_bits=1 << 16)
    assert {(r["id"], r["kept_text"]) for r in few.collect()} == {(i, r["kept_text"]) for i, r in out.items()}


def test_simhash(spark):
    out = simhash.simhash_groups(docs(spark)).collect()
    assert len(out) == 8
    by = {r["id"]: r for r in out}
    assert by[1]["component_id"] == 1 and by[2]["fp"] == by[3]["fp"] == by[6]["fp"] == 0 and by[6]["component_id"] == 2
    assert by[None]["component_id"] is None
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


def test_bpe(spark):
    out = bpe.decode(bpe.encode(docs(spark))).collect()
    assert len(out) == 8
    assert {r["id"]: r["decoded"] for r in out} == {1: "One line of some length here\nAnother  line", None: "no id at all", 2: "", 3: "", 4: LONG, 5: "é😀 " * 50, 6: "   \n\t"}
    assert bpe.encode(docs(spark, [])).count() == 0


def test_packing(spark):
    out = packing.pack(docs(spark)).collect()
    assert sum(r["length"] for r in out if r["doc_id"] == 2) == 1
    assert all(len(r["ids"]) == 4 * r["length"] for r in out)
    assert packing.pack(docs(spark, [])).count() == 0


def test_langid(spark):
    d = docs(spark)
    net = langid.Network(["en", "fr"])
    out = langid.identify(d, net)
    assert {r["id"]: r["lang_pred"] for r in out.collect() if r["id"] in (2, 3, 6)} == dict.fromkeys((2, 3, 6), "und")
    assert out.count() == 8 and carried(d, out, doc_id="id", text="text", lang="lang_pred").columns == d.columns
    assert {r["score"] for r in langid.identify(d, None).collect()} == {0.0}
    assert langid.fit(docs(spark, []), "doc_id", "text", "lang") is None
    assert langid.identify(docs(spark, []), net).count() == 0


def test_hmm(spark):
    out = hmm.score_texts(docs(spark), F.col("doc_id") != 4, states=3, symbols=5, table=8, rounds=2).collect()
    assert len(out) == 8 and all(r["score"] <= 0 and r["base_score"] <= 0 for r in out)
    assert {r["n_tokens"] for r in out if r["id"] in (2, 3, 6)} == {1}
    assert hmm.score_texts(docs(spark, []), F.col("doc_id") > 0).count() == 0
    none = hmm.score_texts(docs(spark), F.lit(False), states=2).collect()
    assert {(r["base_score"], r["train_tokens"], r["n_known"]) for r in none} == {(0.0, 0, 0)}


def test_pii(spark):
    d = docs(spark, [(1, "call +1 (265) 555-5428", "en"), (2, None, "en"), (None, "a@b.org", "en"), (3, "", "en"), (4, LONG, "en")])
    out = {r["id"]: r for r in pii.pseudonymize(d, "key").collect()}
    assert out[2]["safe_text"] is None and out[3]["safe_text"] == "" and out[4]["safe_text"] == LONG
    assert [x["kind"] for x in out[1]["found"]] == ["phone"] and [x["kind"] for x in out[None]["found"]] == ["email"]
    assert pii.pseudonymize(docs(spark, []), "key").count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep long, cell int, id string")


VECTORS = [
    (1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
    (7, [float("nan"), 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [], 1),
]


def test_embeddings(spark):
    out = embeddings.embedding_groups(vectors(spark, [(*r, 0, 0, "x") for r in VECTORS])).collect()
    assert len(out) == len(VECTORS)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in out}
    assert got[1] == got[2] == got[9] == (3, 1) and got[3] == (0, 3) and got[None] == (0, None)
    assert all(got[i] == (0, i) for i in (4, 5, 6, 7, 8, 10, 11))
    assert embeddings.embedding_groups(vectors(spark, [])).count() == 0


def test_top_k(spark):
    rows = [(*r, 0, 0, "x") for r in [(50, [1.0, 0.5], 1), *VECTORS]]
    out = topk.top_k(vectors(spark, rows)).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in out] == [(50, v, 65536) for v in (1, 2, 3, 4, 9)]
    assert topk.top_k(vectors(spark, [])).count() == 0


def test_warc(spark):
    big, fake = "p" * 150, "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "u", big), (2, "u\nv", big), (2, "u", big), (3, None, None), (4, "u", ""), (5, "u", fake), (None, "u", big), (6, "u", "é" * 100), (7, "u", "short")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string")
    archives = warc.write_warc(pages, work_path(spark, "warc"))
    for step in (64, 1 << 20):
        out = warc.read_warc(archives, step).collect()
        assert len(out) == len(rows)
        assert sorted(bytes(r["payload"]) for r in out if r["fields"]["warc-type"] == "response") == sorted((t or "").encode() for _, t in ((1, big), (3, ""), (4, ""), (5, fake), (0, big), (6, "é" * 100), (7, "short")))
        assert all(hashlib.sha256(bytes(r["payload"])).hexdigest() == r["fields"]["warc-payload-digest"][7:] for r in out if r["fields"]["warc-type"] == "response")
    assert warc.write_warc(pages.limit(0), work_path(spark, "warc")).count() == 0
    assert warc.read_warc(warc.write_warc(pages.limit(0), work_path(spark, "warc"))).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None, None), (None, None, None)], [(1, "One text with words.\nAnd a line", "en"), (1, "One text with words.\nAnd a line", "en"), (2, "", "en")]])
def test_pipeline(spark, rows):
    import corpus_pipeline

    d = docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, stage(spark, d, "")
        d.collect()
        assert name == "packing" or d.columns == before.columns
