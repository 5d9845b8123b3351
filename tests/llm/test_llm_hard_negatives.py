"""Hard negatives against plain integer products, and the lookups behind them."""

import math

import numpy as np
import pytest

from kindred.llm import hard_negatives as h

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SHAPE = "vec_id long, embedding array<float>, label int, id long, vector string, planes string, score int"


def plain(rows):
    kept = []
    for i, vector, label in dict.fromkeys((i, None if v is None else tuple(v), n) for i, v, n in rows):
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        kept.append((i, tuple(math.floor(256 * float(np.float32(x))) for x in vector), label))
    out = set()
    for anchor, a, label in kept:
        if anchor % 100:
            continue
        scored = {(-sum(x * y for x, y in zip(a, v)), i, n == label) for i, v, n in kept}
        positives = sorted(s for s in scored if s[2] and s[1] != anchor)[:5]
        for p, positive, _ in positives:
            inside = sorted(s for s in scored if not s[2] and -30 * p <= -100 * s[0] <= -90 * p)[:10]
            out |= {(anchor, positive, rank, i, -p, -s) for rank, (s, i, _) in enumerate(inside, 1)}
    return sorted(out)


def found(spark, rows):
    data = [(i, v, n, 5, "v", "p", 0) for i, v, n in rows]
    df = spark.createDataFrame(data, SHAPE).repartition(3)
    return sorted(tuple(r) for r in h.from_embeddings(df).select(COLUMNS).collect())


def table(seed=0, rows=900, width=12, scale=1.0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(5, width))
    out = []
    for i in range(rows):
        label = 3 if i < rows // 3 else int(draw.integers(0, 10))
        vector = (centres[label % 5] + draw.normal(size=width)) * scale / math.sqrt(width)
        out.append((i, vector.astype(np.float32).tolist(), label))
    out[7] = (7, None, 1)
    out[8] = (8, [float("nan")] * width, 1)
    out[9] = (9, [None] * width, 1)
    out[10] = (10, [float("inf")] * width, 1)
    out[11] = (11, out[12][1], None)
    out[13] = (13, out[300][1], out[300][2])  # equal vectors tie
    out[200] = (200, [0.0] * width, 3)
    out[14], out[15] = (14, [], 3), (15, out[15][1][:5], 3)  # filled up with zeros
    return out


def test_equal_plain_products(spark):
    rows = table()
    rows += [rows[200]] * 40 + [rows[21]] * 3 + [(None, rows[0][1], 2), (100, rows[1][1], 6), (-100, rows[2][1], 2)]
    expected = plain(rows)
    assert expected and found(spark, rows) == expected


@pytest.mark.parametrize("scale", [1e-4, 60.0, 5000.0])
def test_any_size_of_components(spark, scale):
    rows = table(3, 320, 9, scale)
    assert found(spark, rows) == plain(rows)


def test_rounds_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(h, "TABLE_BYTES", 3 * 2 * 256 * 4)
    monkeypatch.setattr(h, "BLOCK_ROWS", 37)
    monkeypatch.setattr(h, "BLOCK_ANCHORS", 2)
    rows = [(10 * i if i % 4 else 100 * i, v, n) for i, v, n in table(5, 400)]
    assert found(spark, rows) == plain(rows)


def test_no_rows_no_anchors_no_others(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []
    assert found(spark, [(100, [1.0], 1), (1, [0.5], 2)]) == []


def test_scores_that_do_not_fit_are_an_error(spark):
    with pytest.raises(ValueError, match="64 bits"):
        found(spark, [(100, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)])


@pytest.mark.parametrize("width, most", [(8, 1), (16, 300), (24, 2**20), (64, 2**27)])
def test_lookups_give_the_inner_products(width, most):
    draw = np.random.default_rng(width)
    rows, anchors = (draw.integers(-most, most, (n, width)) for n in (50, 20))
    shape = h.shape_of(width, float(min(rows.min(), anchors.min())), float(max(rows.max(), anchors.max())))
    planes = h.packed(rows, shape)
    assert (h.unpacked(planes) == rows).all()
    assert (h.scores(planes, h.subset_sums(anchors, shape)) == rows @ anchors.T).all()


def test_bounds_are_exact_beyond_64_bits():
    scores = [0, 1, 7, 10, 99, 100, 101, 2**62, -1, -7, -(2**62)]
    low, high = h.bounds(np.array(scores))
    for p, a, b in zip(scores, low.tolist(), high.tolist()):
        assert a == -((-30 * p) // 100) and b == 90 * p // 100
