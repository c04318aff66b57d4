"""The pipeline's stages against the brute-force versions of their operators."""

import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from placewise.llm import language_id, neighbour_vote

from test_text_operators import _check_packing, _classes, _fingerprint, _quality_rows


def test_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = _quality_rows()
    texts = [(i, t, "en", "s", len(t)) for i, t in rows] + [(1000 + i, rows[i][1], "en", "s", 1) for i in range(1, 200, 3)] + [(2000, None, "en", "s", 0), (2001, "", None, None, None)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    quality = corpus_pipeline.quality(spark, docs, folder)
    good = {r.doc_id for r in neighbour_vote.score(docs, neighbour_vote.train(docs, labels)).collect() if r.score >= 0.3}
    assert quality.columns == docs.columns and {r.doc_id for r in quality.collect()} == good
    language = corpus_pipeline.language(spark, quality, folder)
    known = {r.doc_id for r in language_id.predict(quality, language_id.train(quality)).collect() if r.accepted}
    assert language.columns == docs.columns and {r.doc_id for r in language.collect()} == known
    distinct = corpus_pipeline.near_duplicates(spark, language, folder)
    label = _classes([(r.doc_id, _fingerprint(r.text)) for r in language.collect()])
    assert distinct.columns == docs.columns and {r.doc_id for r in distinct.collect()} == {i for i in label if label[i] == i}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in distinct.collect()}
    _check_packing(rows, 4096)
    clean = {i for i, q in _quality_rows()[1] if q == 1}
    assert clean <= good and clean <= known


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").filter("false").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
