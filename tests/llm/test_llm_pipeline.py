"""The whole pipeline on a small table: each stage's decisions worked out apart from it, and planted rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_corpus import corpus, marks  # noqa: F401

import corpus_pipeline
from kindred.llm import language_id, mixing, neardup, pieces, quality_classifier
from kindred.llm.common import words


@pytest.fixture
def folder(tmp_path, corpus, marks):  # noqa: F811
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def one_of_each_class(rows, idf):
    """Plain comparison of all texts: the smallest doc_id of each class, null last."""
    sets = [next(iter(neardup.shingles(*words(pa.array([r["text"]], pa.string()))))) for r in rows]
    head = list(range(len(rows)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a][0]) and len(sets[b][0]) and neardup.weighted_jaccard(*sets[a], *sets[b], idf) >= 0.8:
            head[root(b)] = root(a)
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(root(i), []).append(r)
    first = lambda own: min(own, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    return [first(own) for own in classes.values()]


def test_run_equals_its_stages_worked_out_plainly(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}

    # Language: the model's predictions over the whole table, text by text.
    learned = docs.filter("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 3 <> 1")
    model = language_id.train(learned)
    judged = language_id.predict(docs, model).collect()
    certain = {(r["doc_id"]) for r in judged if r["lang_pred"] != "und" and r["score"] >= 0.4}
    rows = [r for r in docs.collect() if r["doc_id"] in certain and re.search("[^\\W\\d_]", r["text"] or "")]
    # Quality: the classifier of what is left.
    left = spark.createDataFrame(rows, docs.schema)
    good = {r["doc_id"] for r in quality_classifier.score(left, labels).collect() if r["score"] >= 0.3}
    rows = [r for r in rows if r["doc_id"] in good]
    # Near copies: all pairs.
    rows = one_of_each_class(rows, neardup.inverse_frequencies(spark.createDataFrame(rows, docs.schema)))
    # Mixture: rates and draws of the rest.
    rated = mixing.rates(spark.createDataFrame(rows, docs.schema), labels, corpus_pipeline.WEIGHTS).collect()
    drawn = {r["doc_id"] for r in rated if r["copies"] > 0}
    expected = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in drawn}

    assert set(found) == set(expected)
    model = pieces.load()
    for doc, text in expected.items():
        ids, offsets, _ = pieces.encode(pa.array([text]), model)
        assert found[doc]["pieces"] == ids.tolist() and found[doc]["exact"]
        back = pieces.decode(np.array(found[doc]["pieces"]), np.array([0, len(ids)]), model)[0]
        assert back == text and found[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_planted_rows(spark, folder):
    found = [r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()]
    assert len(found) == len(set(found))
    assert {123, 124, 125, 126}.isdisjoint(found)  # no text, no letter
    assert len({7, 120, 121} & set(found)) <= 1 and len({8, 122} & set(found)) <= 1
    assert sum(i in found for i in range(120) if i % 5 == 4) <= 3
    # Before the mixture, which takes what its weights say, clean documents are all there.
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
    kept = {r["doc_id"] for r in docs.collect()}
    clean = [i for i in range(120) if i % 5 != 4]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_empty_tables(spark, tmp_path, corpus, marks):  # noqa: F811
    corpus.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    marks.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "pieces"} <= set(out.columns)


def test_training_rows_are_those_of_the_checksum():
    # The rule that the plain version above states in SQL.
    assert [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
