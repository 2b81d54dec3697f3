"""The pipeline, stage by stage, on the smallest tables."""

import os

import pytest

import corpus_pipeline as pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    sizes = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, DATA).checkpoint()
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] < before and sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[4] == sizes[3]
    assert sorted(map(tuple, pipeline.run(spark, DATA).collect())) == sorted(map(tuple, docs.collect()))


def odd_documents(spark):
    prose = [" ".join(f"{w}{k}" for w in ("the", "river", "ran", "past", "the", "old", "mill", "and", "on", "to", "the", "sea")) + "." for k in range(12)]
    rows = [(i, prose[i], "en", ("a", None, "b")[i % 3], len(prose[i])) for i in range(12)]
    rows += [rows[0], rows[0], (50, prose[0], None, None, None), (None, prose[1] + " again and again it ran.", "en", "a", 1), (None, None, None, None, None)]
    rows += [(60, None, "en", "a", 0), (61, "", "en", "a", 0), (62, " \n", "en", "a", 3), (63, "\n".join(f"Line number {k} tells of ship w{k} and of harbour x{k} again." for k in range(3000)), "en", "b", 9)]
    rows = [(*r, "x", 7, True) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, node string, `h` int, kept boolean")


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    docs = odd_documents(spark)
    columns, copies = docs.columns, docs.where("doc_id = 0").count()
    assert copies == 3
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name == "quality rules":
            assert 60 not in ids and 61 not in ids and 62 not in ids and 63 in ids and ids.count(0) == 3 and ids.count(None) == 1
        if name == "near duplicates":
            assert ids.count(0) == 1 and 50 not in ids and set(range(12)) <= set(ids)
    assert docs.where("n_tokens IS NULL OR ids_sha256 IS NULL").count() == 0


def test_an_empty_table_goes_through_every_stage(spark, tmp_path):
    docs = odd_documents(spark).limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
        assert docs.count() == 0
