import collections
import re

from llm_corpus import corpus, marks  # noqa: F401

from kindred.llm import quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    found = WORD.findall(text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    times = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(found) < 10 or 100 * len(covered) > 20 * len(found)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def test_base_columns_equal_plain_ones(spark, corpus, marks):
    extra = spark.createDataFrame(
        [(500, "a b\n\na b\n \na b\r\n"), (501, "a b c d e f a b c d e"), (502, "é<é> " * 12)], "doc_id long, text string"
    )
    docs = corpus.select("doc_id", "text").union(extra)
    rows = quality_rules.by_labels(docs, marks).collect()
    expected = sorted((str(r["doc_id"]), *plain(r["text"])) for r in docs.collect())
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in rows) == expected
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_ratio_equals_plain_counts(corpus, marks):
    import math

    texts = [(r["doc_id"], r["text"] or "") for r in corpus.collect()]
    good = {r["doc_id"] for r in marks.collect() if r["quality"] == 1}

    def trigrams(t):
        return [t[i : i + 3] for i in range(len(t) - 2)]

    raw = collections.Counter(g for _, t in texts for g in trigrams(t))
    target = collections.Counter(g for d, t in texts if d in good for g in trigrams(t))
    a, b = sum(raw.values()) + 0.5 * quality_rules.BUCKETS, sum(target.values()) + 0.5 * quality_rules.BUCKETS
    rows = {r["doc_id"]: r for r in quality_rules.by_labels(corpus, marks).collect()}
    for doc, text in texts[:40]:
        own = [math.log((target[g] + 0.5) / b) - math.log((raw[g] + 0.5) / a) for g in trigrams(text)]
        # Hash collisions of trigrams move the mean a little.
        assert abs(rows[doc]["ratio"] - (sum(own) / len(own) if own else 0)) < 0.05
    assert all(rows[i]["kept"] == (i % 5 != 4) for i in range(110))


def test_no_trusted_rows_and_empty_table(corpus, marks):
    assert {r["ratio"] for r in quality_rules.by_labels(corpus, marks.limit(0)).collect()} == {0.0}
    assert quality_rules.by_labels(corpus.limit(0), marks).count() == 0


def test_classifier_learns_and_scores_every_row(corpus, marks):
    rows = quality_classifier.score(corpus, marks).collect()
    assert len(rows) == corpus.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 110]
    assert sum(r["predicted"] == (r["doc_id"] % 5 != 4) for r in held) >= 0.95 * len(held)
    kept = {r["doc_id"] for r in quality_classifier.keep_good(corpus, marks).collect()}
    assert kept == {r["doc_id"] for r in rows if r["predicted"] == 1}


def test_classifier_without_labels_and_rows(corpus, marks):
    assert {r["score"] for r in quality_classifier.score(corpus, marks.limit(0)).collect()} == {0.5}
    assert quality_classifier.score(corpus.limit(0), marks).count() == 0


def test_labels_of_the_held_out_fifth_change_nothing(corpus, marks):
    from pyspark.sql import functions as F

    from kindred.llm.common import remainder

    other = marks.withColumn("quality", F.when(remainder("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = (
        sorted((str(r["doc_id"]), r["score"]) for r in quality_classifier.score(corpus, m).collect()) for m in (marks, other)
    )
    assert first == second
