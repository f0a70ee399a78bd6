"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import (
    contamination,
    html_text,
    line_dedup,
    packing,
    secrets,
    shingle_join,
    substring_dedup,
    token_files,
    topk,
    toxicity,
)

PATH = public_tokenizers.path("word_bpe_49k.json")
# Columns that operators use as names of their own.
DOCS = (
    "key string, doc_id long, text string, n int, sid string, line int, component string, score double, start string, "
    "length int, n_lines long, ids array<int>, lang string, source string, n_chars long"
)


def docs_of(spark, rows):
    full = [("k", i, t, 1, "s", 2, "c", 0.5, "st", 3, 4, [1], "en", "src", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


WORDS = [f"word{i}" for i in range(4000)]
LONG = " ".join(WORDS)
ROWS = [
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two"),
    (5, LONG),
    (6, LONG),
    (7, LONG + " end"),
    (7, LONG + " end"),
    (None, "short text without a number"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def test_substrings(docs, empty):
    rows = {(r["doc_id"], r["n_bytes"]): r for r in substring_dedup.remove_repeated_substrings(docs).collect()}
    n = len(LONG)
    assert rows[5, n]["n_removed"] == n and rows[5, n]["n_spans"] == 1
    assert rows[7, n + 4]["n_removed"] == n + 4
    assert rows[None, 0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[4, 7]["n_removed"] == 0 and rows[4, 7]["kept"] == b"one two"
    assert substring_dedup.remove_repeated_substrings(docs).count() == len(ROWS)
    assert substring_dedup.remove_repeated_substrings(empty).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, i) for i in range(1, 8)], "doc_id long, toxic int, text long")
    model = toxicity.train(docs, labels)
    scores = toxicity.score_documents(docs, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scores)
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    assert toxicity.score_documents(empty, model).count() == 0
    assert toxicity.remove_toxic(docs, none).count() == len(ROWS)
    assert toxicity.remove_toxic(docs, none).columns == docs.columns


def test_token_files(spark, docs, empty, tmp_path):
    token_files.write_token_files(docs, str(tmp_path / "a"), PATH)
    rows = token_files.read_token_files(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert len(rows) == len(ROWS) and [r["start"] for r in rows] == sorted(r["start"] for r in rows)
    assert [r["doc_id"] for r in rows][:2] == [None, None]
    assert [r["ids"] for r in rows if r["doc_id"] == 2] == [[1]]
    at = 0
    for row in rows:
        assert row["start"] == at
        at += row["n_tokens"]
    token_files.write_token_files(empty, str(tmp_path / "b"), PATH)
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_secrets(docs, empty):
    found = secrets.scan_secrets(docs)
    assert {r["secret"] for r in found.collect()} <= {False}
    assert secrets.scan_secrets(empty).count() == 0


def test_pages(spark):
    rows = [(None, None, None, 1), (1, None, "", 2), (2, "http://[bad", "<p>a", 3), (2, "http://[bad", "<p>a", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key int")
    got = sorted((r["page_id"] or 0, r["text"]) for r in html_text.extract_main_text(pages).collect())
    assert got == [(0, ""), (1, ""), (2, "a"), (2, "a")]
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


def test_contamination(spark, docs, empty):
    items = [(1, " ".join(WORDS[100:130])), (2, None), (3, ""), (4, "two"), (None, "without a number"), (1, "nothing here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination.report_contamination(docs, benchmark).collect()
    assert len(rows) == len(ROWS)
    by = {(r["doc_id"], r["n_words"]): r for r in rows}
    assert by[5, 4000]["n_hit"] == 30 and by[5, 4000]["n_items"] == 1
    assert by[4, 2]["n_hit"] == 1 and by[1, 0]["contaminated"] is False
    assert by[None, 5]["n_hit"] == 3
    kept = contamination.remove_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == 4
    assert contamination.report_contamination(empty, benchmark).count() == 0
    assert contamination.report_contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_lines(docs, empty):
    left = line_dedup.delete_repeated_lines(docs)
    rows = {(r["doc_id"], r["text"]) for r in left.collect()}
    assert (5, LONG) in rows and (6, "") in rows and (7, LONG + " end") in rows and (1, None) in rows
    assert left.count() == len(ROWS) and set(docs.columns) <= set(left.columns)
    assert line_dedup.delete_repeated_lines(empty).count() == 0


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, PATH).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS)
    assert [r["ids_crc32"] for r in rows if r["doc_id"] == 2] == [zlib.crc32(bytes(4))]
    assert packing.pack_documents(empty, PATH).count() == 0


def test_topk(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (5, None), (40, [None, 1.0]), (7, [nan]), (None, [1.0]), (8, [])]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, ids string, rank int")
    got = [tuple(r) for r in topk.exact_top_k(vectors, "vec_id % 20 = 0", k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 4096), (0, 2, 4, 4096), (20, 1, 0, 4096), (20, 2, 3, 4096)]
    assert topk.exact_top_k(vectors.limit(0), "vec_id % 20 = 0").count() == 0


def test_similar(docs, empty):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingle_join.similar_documents(docs).collect()]
    assert len(rows) == len(ROWS)
    assert {r for r in rows if r[1] > 1000} == {(5, 3997, 5), (6, 3997, 5), (7, 3998, 5)}
    assert (4, 1, 4) in rows and (1, 0, 1) in rows and (None, 0, None) in rows and (None, 2, None) in rows
    assert shingle_join.similar_documents(empty).count() == 0
    kept = shingle_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("n_chars > 1000").count() == 1 and kept.count() == 7


def test_pipeline(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where("piece = 0").count() == 7
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert docs.where(F.col("doc_id").isNull()).count() == 2
    lines = corpus_pipeline.drop_repeated_lines(spark, docs.withColumn("n_removed", F.lit(777)), str(tmp_path))
    assert {tuple(r) for r in lines.select("n_lines", "n_removed").collect()} == {(4, 777)}
    assert lines.schema["n_removed"].dataType.simpleString() == "int"
