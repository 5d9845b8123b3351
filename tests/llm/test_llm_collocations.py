"""Phrase collocations against plain counting, and the summaries behind them."""

import re
from collections import Counter

import numpy as np
import pytest

from kindred.llm import collocations as c

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=10, longest=3, top=2000, share=50):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for width in range(1, longest + 1):
                for i in range(len(words) - width + 1):
                    counts[lang, tuple(words[i : i + width])] += 1
    found = {}
    for (lang, words), a in counts.items():
        if len(words) > 1 and a >= least:
            cuts = []
            for k in range(1, len(words)):
                l, r = counts[lang, words[:k]], counts[lang, words[k:]]
                cuts.append((1_000_000 * a * a // (l * r), k, l, r))
            found[lang, words] = (a, *min(cuts))
    inside = set()
    for (lang, words), (longer, *_) in found.items():
        for width in range(2, len(words)):
            for i in range(len(words) - width + 1):
                key = (lang, words[i : i + width])
                if 100 * longer >= share * found[key][0]:
                    inside.add(key)
    out = []
    for lang in totals:
        own = [(-f[1], -f[0], " ".join(w).encode(), f) for (g, w), f in found.items() if g == lang and (g, w) not in inside]
        for rank, (_, _, phrase, (a, score, _, l, r)) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, totals[lang], score))
    return sorted(out, key=str)


def corpus(seed=1, size=60):
    draw = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(40)] + ["Über", "ÜBER", "New", "YORK", "city", "日本", "x\x00y"]
    rows = []
    for i in range(size):
        words = [names[min(int(draw.pareto(0.8)), len(names) - 1)] for _ in range(draw.integers(0, 120))]
        words = [w + draw.choice(["", "", "", ".", ",", "\n", "\t", "?!"]) for w in words]
        if i % 3 == 0:
            words += ["New", "York", "City", "hall"] * 3
        rows.append((str(" ".join(words)), str(draw.choice(["en", "de", ""]))))
    rows += [(None, "en"), ("", "fr"), (" \t\n", None), ("same same " * 30, None), ("a b " * 400, "en"), rows[0], rows[0]]
    return rows


def found(spark, rows, **options):
    data = [(i, t, lang, "s", 1, "p", 0) for i, (t, lang) in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n int, phrase string, part int")
    return sorted((tuple(r) for r in c.collocations(docs.repartition(3), **options).select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"least": 3, "longest": 4, "share": 80}, {"least": 4, "top": 7}])
def test_equal_plain_counting(spark, options):
    rows = corpus()
    expected = plain(rows, **options)
    assert expected and found(spark, rows, **options) == expected


def test_tight_summaries_lose_nothing(spark, monkeypatch):
    # Small partitions, small bitmaps and flushes after a few phrases: only exactness is left the same.
    for name, value in {"LEAST_PARTS": 1, "LEAST_BITS": 5, "PART_MASS": 50, "HELD": 40, "HELD_TEXTS": 60}.items():
        monkeypatch.setattr(c, name, value)
    rows = corpus(2)
    assert found(spark, rows) == plain(rows)


def test_no_rows_and_no_phrases(spark):
    assert found(spark, [("one", "en"), (None, None)]) == []
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert c.collocations(docs).count() == 0 and c.collocations(docs).columns == COLUMNS


def test_ties_are_broken_down_to_the_phrase(spark):
    rows = [(f"b{i} c{i} . a{i} z{i}", "en") for i in (2, 1)] * 10
    got = found(spark, rows)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == ["a1 z1", "a2 z2", "b1 c1", "b2 c2"]


@pytest.mark.parametrize("least", [2, 5, 10])
def test_every_frequent_key_survives_any_order_of_merges(least):
    draw = np.random.default_rng(least)
    for _ in range(20):
        keys = np.minimum(draw.pareto(0.7, 3000).astype(np.uint64), 10_000)
        counts = Counter(keys.tolist())
        summary = c.Summary(len(keys) // least + 1)
        for part in np.array_split(keys, draw.integers(1, 40)):
            some, n = np.unique(part, return_counts=True)
            summary.add(some, n)
            if draw.random() < 0.7:
                summary.settle()
        kept = set(summary.possible(least).tolist())
        assert {k for k, n in counts.items() if n >= least} <= kept
        assert summary.lost < least and len(summary.keys) <= summary.capacity


def test_small_capacity_really_subtracts():
    summary = c.Summary(101)
    summary.add(np.arange(1000, dtype=np.uint64), np.ones(1000, np.int64))
    summary.settle()
    assert summary.lost == 1 and len(summary.keys) == 0


def test_packed_rows_come_back():
    keys = np.sort(np.random.default_rng(3).integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2))
    counts = np.arange(1, 501)
    rows = c.packed(keys, counts, 4).to_pylist()
    assert sum(r["mass"] for r in rows) == counts.sum() and [r["part"] for r in rows] == sorted({int(k) >> 60 for k in keys})
    back = [c.unpacked(r["keys"], r["counts"]) for r in rows]
    assert np.concatenate([n for _, n in back]).tolist() == counts.tolist()
    assert np.concatenate([k for k, _ in back]).tolist() == [(int(k) >> 20) & (2**40 - 1) for k in keys]
