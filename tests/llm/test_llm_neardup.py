import itertools

import numpy as np
import pyarrow as pa
import pytest

from llm_corpus import corpus  # noqa: F401

from kindred.llm import neardup
from kindred.llm.common import words
from kindred.llm.components import components


def brute(docs, idf):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [next(iter(neardup.shingles(*words(pa.array([t], pa.string()))))) for _, t in rows]
    head = list(range(len(rows)))

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a][0]) and len(sets[b][0]) and neardup.weighted_jaccard(*sets[a], *sets[b], idf) >= 0.8:
            head[root(b)] = root(a)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return sorted((tuple(sorted(g, key=str)) for g in groups.values()), key=str)


def test_classes_equal_brute_force(corpus):
    idf = neardup.inverse_frequencies(corpus)
    found = neardup.near_duplicates(corpus).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted((tuple(sorted(g, key=str)) for g in groups.values()), key=str) == brute(corpus, idf)
    by = {r["doc_id"]: r["class_id"] for r in found}
    assert by[120] == by[121] == 7 and by[122] == 8
    assert by[123] == 123 and by[124] == 124 and by[125] == 125


def test_one_of_each_class_stays(corpus):
    kept = neardup.keep_one(corpus)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == corpus.columns
    assert {120, 121, 122}.isdisjoint(ids) and {7, 8, 123, 124, 125, None} <= set(ids)
    assert ids.count(130) == 1


def test_large_group_of_near_copies_is_one_class(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:50] + [f"own{i}"] + base[51:])) for i in range(300)]
    rows += [(1000 + i, " ".join(base[:40] + [f"v{i}_{j}" for j in range(60)])) for i in range(100)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in found if r["doc_id"] < 1000} == {0}
    assert all(r["class_id"] == r["doc_id"] for r in found if r["doc_id"] >= 1000)


def two_groups_and_a_bridge(seed, size=150):
    """Two groups of near copies, not alike, but for one member of each."""
    draw = np.random.default_rng(seed)
    base, spots = [f"s{seed}w{i}" for i in range(240)], [10 + 28 * i for i in range(8)]

    def text(own, changed=None):
        out = list(base)
        for spot, side in zip(spots, own):
            out[spot] = f"s{seed}{side}{spot}"
        if changed is not None:
            out[draw.integers(0, 240)] = f"s{seed}own{changed}"
        return " ".join(out)

    rows = [text("aaaaaaaa", f"a{i}") for i in range(size)] + [text("bbbbbbbb", f"b{i}") for i in range(size)]
    return [*rows, text("bbaaaaaa"), text("bbbbbbaa")]


@pytest.mark.parametrize("members", [10_000, 40])
def test_two_large_groups_joined_by_one_pair(spark, monkeypatch, members):
    # Small parts: buckets and groups are dealt over many tasks.
    monkeypatch.setattr(neardup, "BUCKET_MEMBERS", members)
    monkeypatch.setattr(neardup, "GROUP_MEMBERS", members)
    monkeypatch.setattr(neardup, "LEADERS", 3)
    rows = [t for seed in range(2) for t in two_groups_and_a_bridge(seed)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    groups = {}
    for r in neardup.near_duplicates(docs).collect():
        groups.setdefault(r["class_id"], []).append(r["doc_id"])
    assert set(map(frozenset, groups.values())) == set(map(frozenset, brute(docs, neardup.inverse_frequencies(docs))))


def test_rows_stay_in_proportion_to_a_large_group(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:50] + [f"own{i}"] + base[51:])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf = neardup.inverse_frequencies(docs)
    nodes = neardup.signed(docs, idf).cache()
    assert neardup.candidate_links(nodes).count() < 400 * neardup.BANDS
    assert neardup.verified_links(nodes, docs, idf, 0.8).count() == 399


def test_weights_do_not_flatten_with_the_corpus():
    # A shingle of all documents weighs 1, one of a thousandth of them or fewer 2, at any number of documents.
    for texts in (1000, 10**9):
        shares = np.array([1, 0.1, 0.001, 1 / texts])
        weights = 1 + np.log(np.clip(1 / shares, 1, neardup.RAREST)) / np.log(neardup.RAREST)
        assert np.allclose(weights, [1, 4 / 3, 2, 2])


def test_samples_estimate_weighted_jaccard():
    draw = np.random.default_rng(1)
    a = np.unique(draw.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:300], draw.integers(0, 2**63, 100).astype(np.uint64)]))
    hashes = np.concatenate([a, b])
    drawn = neardup.samples(hashes, np.zeros(len(hashes)), np.array([0, len(a), len(hashes)]), 2000)
    assert abs((drawn[0] == drawn[1]).mean() - 300 / (len(a) + len(b) - 300)) < 0.04


def test_components_of_a_chain_and_empty_table(spark, corpus):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 91), (95, 95)], "a long, b long")
    found = {r["node"]: r["label"] for r in components(links).collect()}
    assert all(found[i] == 0 for i in range(51)) and found[91] == 90 and found[95] == 95
    assert neardup.near_duplicates(corpus.limit(0)).count() == 0
    assert neardup.keep_one(corpus.limit(0)).count() == 0
