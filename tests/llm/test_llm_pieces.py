import os

import numpy as np
import pyarrow as pa
import pytest

from llm_corpus import corpus  # noqa: F401

from kindred.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL_PATH), reason="no piece model")
TEXTS = ["Hello world", "  Hello  world\n x ", "", None, " ", "a", "é\tü  ", "日本語 テキスト 😀😀 x", "   ", "the the", "\0 q", "x" * 300]


def best_score(text, known, unknown):
    """Plain Viterbi over characters."""
    if not text:
        return 0.0
    text = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-np.inf] * len(text)
    for a in range(len(text)):
        for b in range(a + 1, min(len(text), a + 20) + 1):
            score = known.get(text[a:b], unknown if b == a + 1 else None)
            if score is not None:
                best[b] = max(best[b], best[a] + score)
    return best[-1]


def test_scores_are_the_best_ones():
    model = pieces.load()
    with open(pieces.MODEL_PATH, "rb") as file:
        listed = pieces.read_pieces(file.read())
    known = {text: score for text, score, kind in listed if kind == pieces.NORMAL}
    ids, offsets, scores = pieces.encode(pa.array(TEXTS), model)
    assert scores.tolist() == [best_score(t, known, model.unknown_score) for t in TEXTS]
    for text, a, b, score in zip(TEXTS, offsets[:-1], offsets[1:], scores):
        if all(i >= 259 for i in ids[a:b]):
            assert sum(model.scores[ids[a:b]]) == score


def test_best_ways_of_the_public_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    with open(pieces.MODEL_PATH, "rb") as file:
        data = file.read()
    # The same pieces and scores, declared to be a unigram model.
    given = data.replace(b"\x06tok_v0\x18\x02", b"\x06tok_v0\x18\x01", 1)
    library = sentencepiece.SentencePieceProcessor(model_proto=given)
    model = pieces.load()
    for text in ("Hello world", "the", "é\tü", "日本語 テキスト 😀 x", "tion of the eau"):
        ids, _, _ = pieces.encode(pa.array([text]), model)
        assert ids.tolist() == library.nbest_encode_as_ids(text, 2)[0]


def test_round_trip():
    model = pieces.load()
    ids, offsets, _ = pieces.encode(pa.array(TEXTS), model)
    assert pieces.decode(ids, offsets, model) == [t or "" for t in TEXTS]


def test_double_array_holds_all_keys():
    keys = [(word.encode(), i) for i, word in enumerate(["a", "ab", "abc", "b", "ba", "é", "ö"])]
    base, check, value = pieces.double_array(keys)
    for key, expected in keys:
        node = 0
        for byte in key:
            assert check[base[node] + byte] == node
            node = base[node] + byte
        assert value[node] == expected


def test_table(spark, corpus):
    rows = pieces.encoded(corpus).collect()
    assert len(rows) == corpus.count()
    assert all(r["exact"] for r in rows if r["doc_id"] != 123)
    assert {r["doc_id"]: r["n_pieces"] for r in rows}[124] == 0
    assert pieces.encoded(corpus.limit(0)).count() == 0
