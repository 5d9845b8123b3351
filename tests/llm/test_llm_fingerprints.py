import hashlib
import re

from pyspark.sql import functions as F

from llm_corpus import corpus  # noqa: F401

from kindred.llm import fingerprints as fp


def digests(text):
    return {int(hashlib.md5(p.encode()).hexdigest()[:15], 16) for p in re.findall(fp.PIECE, text)}


def test_against_plain_sets(spark, corpus):
    distinct = sorted({(r["doc_id"], r["text"] or "") for r in corpus.collect()}, key=lambda r: (r[0] is not None, r[0] or 0))
    rows = {r["doc_id"]: r for r in fp.fingerprints(corpus).collect()}
    assert fp.fingerprints(corpus).count() == corpus.count()
    for at, (doc, text) in enumerate(distinct):
        after = distinct[(at + 1) % len(distinct)][1]
        changed = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        row = rows[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        for name, other in (("near_edited", changed), ("near_next", after)):
            a, b = digests(text), digests(other)
            assert abs(row[name] - (1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0)) < 1e-12
    assert rows[7]["fingerprint"] == rows[120]["fingerprint"]


def test_peeling_recovers_both_sides(spark):
    a, b = list(range(10**15, 10**15 + 40)), list(range(10**15 + 35, 10**15 + 42))
    row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(
        fp.difference(F.col("a"), F.col("b"), fp.fingerprint_cells(F.col("a")), fp.fingerprint_cells(F.col("b"))).alias("d")
    ).first()
    assert {x["d"] for x in row["d"] if x["s"] == 1} == set(a) - set(b)
    assert {x["d"] for x in row["d"] if x["s"] == -1} == set(b) - set(a)


def test_small_difference_needs_the_fingerprint_alone(spark):
    a = list(range(10**15, 10**15 + 300))
    cells = fp.minus(fp.fingerprint_cells(F.col("a")), fp.fingerprint_cells(F.col("b")))
    frame = spark.createDataFrame([(a, a[2:])], "a array<long>, b array<long>")
    assert {x["d"] for x in frame.select(fp.peeled(cells, fp.SMALL).alias("d")).first()["d"]} == set(a[:2])


def test_no_python_in_the_plan_and_empty_table(corpus):
    found = fp.fingerprints(corpus)
    assert "Python" not in found._jdf.queryExecution().toString()
    assert fp.fingerprints(corpus.limit(0)).count() == 0
