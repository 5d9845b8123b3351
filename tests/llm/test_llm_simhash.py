"""SimHash near-duplicates against comparing all pairs."""

import re

import numpy as np
import pytest
import xxhash
from llm_corpus import corpus, prose  # noqa: F401

from kindred.llm import simhash as s


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: list of (doc_id, fingerprint). Smallest doc_id reachable, nulls aside."""
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for doc, p in prints:
        if doc is not None:
            least[root(p)] = min(doc, least.get(root(p), doc))
    return {p: least.get(root(p)) for p in distinct}


@pytest.mark.parametrize("text_bytes", [1 << 22, 7])
def test_fingerprints_equal_the_rule(monkeypatch, text_bytes):
    monkeypatch.setattr(s, "TEXT_BYTES", text_bytes)
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "a a a a a a", "Straße ÄÖÜ\x0bx\x0cy\x1cz q", prose(1, 400), "x" * 5000, "A b\r\nC  d"]
    texts += [" ".join("same words again".split() * 300)]
    for text in texts:
        assert s.fingerprint(text) == plain_fingerprint(text), text


def test_all_pairs_within_reach_meet_at_an_anchor():
    draw = np.random.default_rng(2)
    left = draw.integers(0, 2**64, 300, dtype=np.uint64)
    for flips in range(4):
        right = left.copy()
        for row in range(len(right)):
            for bit in draw.choice(64, flips, replace=False):
                right[row] ^= np.uint64(1) << np.uint64(bit)
        met = np.zeros(len(left), bool)
        for half in range(2):
            a, b = ((x >> np.uint64(32 * half)).astype(np.uint32) for x in (left, right))
            rows, anchor, home = s.anchors(a)
            assert home.sum() == len(a) and (np.bitwise_count(anchor ^ a[rows]) <= 2).all()
            there = set(zip(*(x.tolist() for x in s.anchors(b)[:2])))
            for row, place in zip(rows[home].tolist(), anchor[home].tolist()):
                met[row] |= (row, place) in there
        assert met.all()


def with_bits(value, bits):
    for bit in bits:
        value ^= 1 << int(bit)
    return value


def planted():
    draw = np.random.default_rng(4)
    prints = [int(x) for x in draw.integers(0, 2**63, 200)]
    chain = prints[0]
    for _ in range(12):  # a chain of links
        chain = with_bits(chain, draw.choice(64, 3, replace=False))
        prints.append(chain)
    prints += [with_bits(prints[5], draw.choice(64, n % 4, replace=False)) for n in range(400)]  # a large group
    prints += [with_bits(prints[9], draw.choice(64, 4, replace=False)) for _ in range(5)]  # too far
    prints += [0, 0, 7, 15, 2**64 - 1]
    return prints


@pytest.mark.parametrize("block, pairs", [(4096, 1 << 22), (16, 50)])
def test_links_equal_all_pairs(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(s, "BLOCK", block)
    monkeypatch.setattr(s, "PAIRS", pairs)
    prints = planted()
    signed = [(int(np.uint64(p).view(np.int64)),) for p in sorted(set(prints))]
    found = s.links(spark.createDataFrame(signed, "fp long").repartition(3)).collect()
    parent = {p: p for (p,) in signed}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for r in found:
        parent[root(r["a"])] = root(r["b"])
    expected = plain_components([(i, p) for i, p in enumerate(prints)])
    groups = {}
    for p, component in expected.items():
        groups.setdefault(component, set()).add(root(int(np.uint64(p).view(np.int64))))
    assert all(len(roots) == 1 for roots in groups.values())
    assert len({r for roots in groups.values() for r in roots}) == len(groups)


def test_documents_equal_all_pairs(spark, corpus):
    rows = corpus.select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]
    component = plain_components(prints)
    expected = sorted(((d, f"{p:016x}", component[p]) for d, p in prints), key=str)
    got = s.near_duplicates(corpus)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == expected
    same = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert same[120] == same[121] == 7 and same[123] == same[124] == same[125] == 123


def test_no_documents(spark):
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [r["component_id"] for r in s.near_duplicates(only).collect()] == [None, None]


def test_forest_keeps_components():
    draw = np.random.default_rng(7)
    a, b = draw.integers(0, 300, 250), draw.integers(0, 300, 250)
    x, y = s.forest(a, b)

    def parts(left, right):
        parent = list(range(300))

        def root(n):
            while parent[n] != n:
                n = parent[n]
            return n

        for i, j in zip(left, right):
            parent[max(root(i), root(j))] = min(root(i), root(j))
        return [root(n) for n in range(300)]

    assert parts(a, b) == parts(x, y) and len(x) < 300
