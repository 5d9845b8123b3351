import collections
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from llm_corpus import corpus, marks  # noqa: F401

from kindred.llm import language_id, language_model, mixing


def test_language_of_every_row(corpus):
    rows = language_id.identify(corpus).collect()
    assert len(rows) == corpus.count()
    by = {r["doc_id"]: r for r in rows}
    right = [by[i]["lang_pred"] == ("de" if i % 3 == 0 else "en") for i in range(120)]
    assert sum(right) >= 118
    for odd in (123, 124, 125, 126):
        assert (by[odd]["lang_pred"], by[odd]["score"]) == ("und", 0.0)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    kept = {r["doc_id"] for r in language_id.keep_identified(corpus).collect()}
    assert set(range(120)) <= kept and kept.isdisjoint({123, 124, 125, 126})


def test_language_without_training_rows(corpus):
    from pyspark.sql import functions as F

    unmarked = corpus.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unmarked).collect()} == {"und"}
    assert language_id.identify(corpus.limit(0)).count() == 0


def test_temperature_softens_wrong_certainty():
    logits = np.array([[8.0, 0.0]] * 10)
    labels = np.array([0] * 7 + [1] * 3)
    assert language_id._temperature(logits, labels) > 4


def test_base_score_equals_plain_counts(corpus):
    small = corpus.filter("doc_id is null or doc_id <> 129")
    rows = language_model.score(small).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def crc(doc):
        return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1

    docs = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(lower)) + [None]) for r in small.collect()]
    counts = collections.Counter(w for d, t in docs if not crc(d) for w in t)
    total, size = sum(counts.values()), len(counts)
    expected = sorted(
        (str(d), crc(d), len(t), sum(counts[w] > 0 for w in t), total,
         round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (size + 1))) for w in t), 6))
        for d, t in docs
    )
    found = sorted(
        (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
        for r in rows
    )
    assert found == expected
    known = [r for r in rows if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] > r["base_score"] for r in known) > len(known) / 2


def test_probabilities_sum_to_one_and_state_is_carried():
    counts = np.arange(2025, 0, -1).astype(float)
    net = language_model.Network.fresh(counts)
    rows = np.arange(2025)
    tokens = np.concatenate([[5, 9, w] for w in rows])
    whole = language_model.log10_likelihoods(net, tokens, np.arange(0, len(tokens) + 1, 3))
    two = language_model.log10_likelihoods(net, np.array([5, 9]), np.array([0, 2]))
    assert abs((10 ** (whole - two[0])).sum() - 1) < 1e-4
    # One long document equals the sum over windows only if the state goes on between them.
    long = np.random.default_rng(0).integers(2, 2025, 30_000)
    alone = language_model.log10_likelihoods(net, long, np.array([0, len(long)]))[0]
    beside = language_model.log10_likelihoods(net, np.concatenate([long, long[:9]]), np.array([0, 30_000, 30_009]))[0]
    assert abs(alone - beside) < 1e-3 * abs(alone)


def test_training_gradient_lowers_the_loss():
    draw = np.random.default_rng(3)
    pattern = np.tile([2, 3, 4, 5, 6, 7], 4000)
    stream = np.where(draw.random(len(pattern)) < 0.05, 1, pattern)
    counts = np.bincount(stream, minlength=2025).astype(float)
    fresh = language_model.Network.fresh(counts)
    before = language_model.log10_likelihoods(fresh, stream[:600], np.array([0, 600]))[0]
    net = language_model.Network.fresh(counts)
    # What does not fill the parts is left over, fewer tokens than there are parts.
    assert 0 <= len(stream) - 1 - language_model.train(net, stream, most_streams=64) < 64
    language_model.train(net, stream, most_streams=64)
    after = language_model.log10_likelihoods(net, stream[:600], np.array([0, 600]))[0]
    assert after > 0.5 * before  # less than half the loss of the unigram model


def test_network_learns_from_every_training_token_and_its_vocabulary_grows(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 3000}" for j in range(60_000)), i < 20) for i in range(22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _train boolean").repartition(4)
    counts = language_model.count_words(docs)
    vocabulary, known = language_model._vocabulary(language_model.frequent_words(counts), counts)
    assert len(vocabulary) == 3000 and known.sum() == 20 * 60_001
    net = language_model._trained(docs, vocabulary, known)
    assert net.learned == 20 * 60_001
    # What follows is fixed by the word before.
    where = {w: i + 2 for i, w in enumerate(vocabulary.to_pylist())}
    tokens = np.array([where[f"w{j % 3000}"] for j in range(6000)])
    fresh = language_model.Network.fresh(known)
    before, after = (language_model.log10_likelihoods(n, tokens, np.array([0, 6000]))[0] for n in (fresh, net))
    assert after > before


def test_changes_travel_in_two_bytes_and_their_average_is_near(spark):
    draw = np.random.default_rng(5)
    moved = [draw.normal(size=(300, 72)).astype(np.float32) * size for size in (1e-9, 0.3, 4e4)]
    moved[1][::7] *= 1e-4
    grown = [np.abs(m) for m in moved]
    pieces = [r for k in (1, 3) for b in language_model._pieces([k * m for m in moved + grown], 10 * k) for r in b.to_pylist()]
    # As floats the two shards' pieces would have 4 bytes a value.
    assert sum(len(r["changes"]) for r in pieces) == 2 * 2 * sum(m.size for m in moved + grown)
    found, tokens = language_model._averaged(spark.createDataFrame(pieces, language_model.PIECES_SQL).repartition(3), 3)
    assert tokens == 40
    for got, mean in zip(found, [2.5 * m for m in moved] + [7 * m.astype(float) ** 2 for m in moved]):
        assert np.allclose(got, mean.ravel(), rtol=2e-3, atol=1e-6 * np.abs(mean).max())
    assert language_model._averaged(spark.createDataFrame([], language_model.PIECES_SQL), 3) == ([], 0)


def test_model_of_an_empty_table(corpus):
    assert language_model.score(corpus.limit(0)).count() == 0


def test_likelihoods_equal_a_step_by_step_network():
    draw = np.random.default_rng(8)
    net = language_model.Network.fresh(draw.integers(1, 50, 2025).astype(float))
    for part in net.parts():
        part += draw.normal(size=part.shape).astype(np.float32) * 0.2
    docs = [draw.integers(0, 2025, n) for n in (1, 2, 5, 33, 70, 0)]
    hidden, expected = language_model.HIDDEN, []
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for tokens in docs:
        state, before, total = np.zeros(hidden), language_model.END, 0.0
        for token in tokens:
            if before == language_model.END:
                state = np.zeros(hidden)
            given, kept = net.inputs[before].astype(float), state @ net.recurrent.astype(float)
            update, reset = (sigmoid(given[at : at + hidden] + kept[at : at + hidden]) for at in (0, hidden))
            state = state + update * (np.tanh(given[2 * hidden :] + reset * kept[2 * hidden :]) - state)
            group, place = divmod(int(token), 45)
            for logits, at in (
                (net.class_weights @ state + net.class_bias, group),
                (net.word_weights[group] @ state + net.word_bias[group], place),
            ):
                total += logits[at] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
            before = token
        expected.append(total / np.log(10))
    offsets = np.cumsum([0, *map(len, docs)])
    found = language_model.log10_likelihoods(net, np.concatenate(docs), offsets)
    assert np.allclose(found, expected, rtol=1e-4, atol=1e-4)


def test_gradients_agree_with_differences():
    draw = np.random.default_rng(2)
    stream = draw.integers(0, 2025, 12)
    fresh = language_model.Network.fresh(np.ones(2025))

    def loss(net):
        return -language_model.log10_likelihoods(net, stream[1:], np.array([0, 11]))[0] * np.log(10)

    # One window, one part: a small step follows the gradient, which the memory of squares shows.
    stream[0] = language_model.END
    memory = [np.zeros_like(p) for p in fresh.parts()]
    net = language_model.Network(*[p.copy() for p in fresh.parts()])
    with np.errstate(invalid="ignore", divide="ignore"):
        language_model.train(net, stream, rate=0.0, memory=memory, most_streams=1)
    for at in (1, 2, 4):
        place = np.unravel_index(np.argmax(memory[at]), memory[at].shape)
        moved = []
        for side in (0.01, -0.01):
            near = language_model.Network(*[p.copy() for p in fresh.parts()])
            near.parts()[at][place] += side
            moved.append(loss(near))
        slope = (moved[0] - moved[1]) / 0.02
        assert abs(abs(slope) - np.sqrt(memory[at][place])) < 0.05 * abs(slope) + 1e-3


def test_gradients_of_outputs_equal_plain_softmax():
    draw = np.random.default_rng(4)
    given = np.concatenate([np.tanh(draw.normal(size=(900, 24))), np.ones((900, 1))], axis=1).astype(np.float32)
    which = draw.integers(0, 158, 900)
    for size in (0.5, 40.0):  # the larger outputs could not be raised as they are
        joined = (draw.normal(size=(158, 25)) * size).astype(np.float32)
        bounded = bool(language_model._bounded(joined))
        assert bounded == (size < 1)
        logits = given.astype(float) @ joined.T.astype(float)
        chances = np.exp(logits - logits.max(1, keepdims=True))
        chances /= chances.sum(1, keepdims=True)
        own = logits[np.arange(900), which] - logits.max(1)
        own -= np.log(np.exp(logits - logits.max(1, keepdims=True)).sum(1))
        assert np.allclose(language_model._chosen(given, joined, bounded, which), own, rtol=1e-3, atol=1e-3)
        chances[np.arange(900), which] -= 1
        back = np.empty((900, 24), np.float32)
        found = language_model._errors(given, joined, bounded, which, back)
        assert np.allclose(found, chances.T @ given, rtol=1e-2, atol=1e-2)
        assert np.allclose(back, chances @ joined[:, :-1], rtol=1e-2, atol=2e-3 * size)


def test_rows_of_a_word_are_added_up():
    draw = np.random.default_rng(6)
    ids = np.concatenate([np.full(500, 3), np.full(24, 70_001), np.full(23, 9), draw.integers(0, 80_000, 2000)])
    rows = draw.normal(size=(len(ids), 72)).astype(np.float32)
    order = language_model._order(ids)
    assert np.array_equal(order, np.argsort(ids, kind="stable"))
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    expected = np.add.reduceat(rows.astype(float)[order], first)
    assert np.allclose(language_model._added(rows, order, first), expected, atol=1e-4)


def test_outputs_of_a_window_are_never_held_whole():
    # Passing over them in memory, step by step, took most of the time of learning.
    counts = np.ones(158 * 158)
    net = language_model.Network.fresh(counts)
    memory, outputs = language_model.fresh_memory(net), language_model.STREAMS * language_model.WINDOW * 158 * 4
    draw = np.random.default_rng(7)
    stream = draw.integers(0, 158, 128 * language_model.STREAMS + 1).astype(np.int32)  # all of one class
    tracemalloc.start()
    language_model.train(net, stream, memory=memory)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 36 MB, of which weights and squares have 13 and the states and gates of a window most of the others; it was 67.
    assert peak < 5 * outputs


def members_of(spark, seed, shape, rows=1500):
    """Rows whose memberships lean to the domains in the given proportion; soft is how little they differ."""
    draw = np.random.default_rng(seed)
    supply, soft = shape
    chances = draw.dirichlet(np.array(supply) * 3, rows) * (1 - soft) + soft / 3
    tokens = draw.integers(1, 900, rows).astype(float)
    data = [(float(n), [float(x) for x in p]) for n, p in zip(tokens, chances)]
    return tokens, chances, spark.createDataFrame(data, "_kd_tokens double, _kd_chances array<double>").cache()


def long_solution(tokens, chances, targets, most):
    """Residual of many plain accelerated projected-gradient steps."""
    sides = chances * tokens[:, None]
    rates = ahead = np.full(len(tokens), 0.5)
    size, moment = 1 / np.linalg.norm(sides, 2) ** 2, 1.0
    for _ in range(20_000):
        new = np.clip(ahead + size * sides @ (targets - ahead @ sides), 0, most)
        grown = (1 + np.sqrt(1 + 4 * moment * moment)) / 2
        ahead, rates, moment = new + (moment - 1) / grown * (new - rates), new, grown
    return np.linalg.norm(targets - rates @ sides)


@pytest.mark.parametrize("shape", [([1, 1, 1], 0.0), ([0.8, 0.1, 0.1], 0.05), ([0.6, 0.3, 0.1], 0.7)])
def test_mixture_has_the_smallest_residual(spark, shape):
    tokens, chances, members = members_of(spark, 4, shape)
    mixtures = []
    for weights in ([0.5, 0.3, 0.2], [0.8, 0.1, 0.1], [0.2, 0.3, 0.5]):
        found = mixing.fit(members, np.array(weights), mixing.Settings())
        # The scarcest domain gives all it has.
        supply = tokens @ chances
        assert np.allclose(found.targets, np.array(weights) * min(supply / weights), rtol=1e-9)
        best = long_solution(tokens, chances, found.targets, 1.0)
        assert np.linalg.norm(found.targets - found.totals) <= 1.01 * best + 1e-3 * found.targets.sum()
        rates = [r[0] for r in members.select(mixing.rate(found.first, found.multipliers, 1.0)).collect()]
        assert min(rates) >= 0 and max(rates) <= 1
        assert np.allclose(np.array(rates) * tokens @ chances, found.totals, rtol=1e-6)
        mixtures.append(found.totals / found.totals.sum())
    assert min(np.abs(a - b).max() for i, a in enumerate(mixtures) for b in mixtures[:i]) > 0.01


def test_mixture_that_can_be_met_is_met(spark):
    tokens, chances, members = members_of(spark, 5, ([1, 1, 1], 0.0))
    for share in (0.6, 0.3):
        found = mixing.fit(members, np.array([4.0, 3.0, 3.0]), mixing.Settings(budget_share=share))
        assert np.abs(found.totals - found.targets).max() < 1e-4 * found.targets.sum()
        assert np.allclose(found.totals / found.totals.sum(), [0.4, 0.3, 0.3], atol=1e-4)


def test_mixture_of_domains_that_cannot_be_told_apart(spark):
    rows = [(10.0 + i % 7, [(i % 11) / 11, (1 - (i % 11) / 11) * 0.6, (1 - (i % 11) / 11) * 0.4]) for i in range(500)]
    members = spark.createDataFrame(rows, "_kd_tokens double, _kd_chances array<double>")
    found = mixing.fit(members, np.array([0.6, 0.2, 0.2]), mixing.Settings(budget_share=0.7))
    # The first domain and the two others together are met as nearly as the fixed ratio of the others lets them.
    assert abs(found.totals[1] / found.totals[2] - 1.5) < 1e-6
    assert abs(found.totals[0] - found.targets[0]) < 0.03 * found.targets.sum()


def test_weights_of_nothing_and_domains_without_tokens(spark):
    assert mixing.allowed_tokens(np.array([100.0, 10.0, 0.0]), np.array([0.5, 0.4, 0.1]), 1.0) == 25.0
    _, _, members = members_of(spark, 6, ([1, 1, 1], 0.0), 50)
    found = mixing.fit(members, np.zeros(3), mixing.Settings())
    assert found.first == 1.0 and not found.multipliers.any()
    empty = mixing.fit(members.limit(0), np.ones(3), mixing.Settings())
    assert empty.first == 1.0 and not empty.totals.any()


def test_mixing_every_row(corpus, marks):
    rows = mixing.rates(corpus, marks).collect()
    assert len(rows) == corpus.count()
    assert all(0 <= r["rate"] <= 1 and r["copies"] in (0, 1) for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[123] == 0
    drawn = mixing.draw(corpus, marks)
    assert drawn.columns == corpus.columns
    assert drawn.count() == sum(r["copies"] for r in rows)
    assert mixing.rates(corpus.limit(0), marks).count() == 0


def test_rare_languages_are_not_learned(spark, monkeypatch):
    from llm_corpus import prose

    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 20)
    rows = [(i, prose(i, 60, "de" if i % 2 else "en"), "de" if i % 2 else "en") for i in range(60)]
    rows += [(100 + i, prose(i, 60), f"x{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id._sample(docs, 1000).collect()
    assert {r["lang"] for r in sample} == {"de", "en"} and len(sample) <= 20
    assert {r["lang_pred"] for r in language_id.identify(docs).collect()} <= {"de", "en"}


def test_an_id_of_many_rows_is_one_example(spark):
    from kindred.llm import quality_classifier

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (4, 1)], "doc_id long, label int")
    sample = quality_classifier._sample(docs, labels, 100).collect()
    assert sorted((r["_label"], r["text"]) for r in sample if r["text"]) == [(0, "other"), (1, "text 0")] and len(sample) == 3
