"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

A model file gives pieces with scores. A text is prefixed with one space, spaces become the marker U+2581, and of all ways
to cut it into pieces the one with the highest sum of scores is taken. A character that is in no piece costs
`UNKNOWN_PENALTY` less than the worst piece and is written as its UTF-8 bytes (byte fallback). Decoding joins pieces and
bytes and turns markers into spaces again.

No piece holds a marker behind another character, so a text falls into chunks (spaces and what follows) that are cut
independently; the distinct chunks of a slice of texts are worked through together, as arrays: all trie walks step
by step, then best scores by place, then the way back. One map over the table, without a shuffle.

Defined results: null and empty texts have no pieces and score 0; of equally good ways the one whose piece ending at the
place in question starts first is taken, as the public library does; markers in the text itself decode to spaces
(`exact` is then false); copies and repeated rows are encoded one by one. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kindred.llm.common import in_batches, slices, sums

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, BYTE = 1, 2, 6


@dataclass
class Model:
    """Double array (base, check, piece at a node or -1), scores, and the bytes that each id decodes to."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    scores: np.ndarray
    unknown: int
    unknown_score: float
    byte_ids: np.ndarray
    texts: np.ndarray
    text_offsets: np.ndarray


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


def read_pieces(data: bytes) -> list[tuple[str, float, int]]:
    """Piece, score and type of every id of a model file."""
    found = []
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            found.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
    return found


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double array of (key, value) pairs: the child of node s by byte c is base[s] + c if its check is s."""
    nodes: list[dict[int, int]] = [{}]
    values = [-1]
    for key, value in keys:
        node = 0
        for byte in key:
            if byte not in nodes[node]:
                nodes[node][byte] = len(nodes)
                nodes.append({})
                values.append(-1)
            node = nodes[node][byte]
        values[node] = value
    size = 2 * len(nodes) + 1024
    base, check, piece = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    # Each search goes on from where the last one of its kind fitted: nodes with one child fill the gaps of the others.
    place, fits, waiting = {0: 0}, {False: 1, True: 1}, [0]
    while waiting:
        node = waiting.pop()
        at, children = place[node], nodes[node]
        piece[at] = values[node]
        if not children:
            continue
        least = min(children)
        wide = len(children) > 1
        free = max(fits[wide], least)
        while True:
            offset = free - least
            if check[free] == -1 and all(check[offset + byte] == -1 for byte in children):
                fits[wide] = max(fits[wide], free - 64 * wide)
                break
            free += 1
            if free + 512 >= size:
                grown = size
                base += [0] * grown
                check += [-1] * grown
                piece += [-1] * grown
                size += grown
        base[at] = offset
        for byte, child in children.items():
            check[offset + byte] = at
            place[child] = offset + byte
            waiting.append(child)
    end = max(place.values()) + 257
    cut = [np.array((values + [-1] * 257)[:end], np.int32) for values in (base, check, piece)]
    return cut[0], cut[1], cut[2]


def model_of(pieces: list[tuple[str, float, int]]) -> Model:
    normal = [(text.encode(), i) for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL]
    if any(MARKER in text.lstrip(MARKER) for text, _, kind in pieces if kind == NORMAL):
        raise ValueError("a piece holds a marker behind another character")
    base, check, piece = double_array(normal)
    byte_ids = np.full(256, -1, np.int32)
    texts = []
    for i, (text, _, kind) in enumerate(pieces):
        if kind == BYTE:
            byte_ids[int(text[3:5], 16)] = i
            texts.append(bytes([int(text[3:5], 16)]))
        else:
            texts.append(text.replace(MARKER, " ").encode() if kind == NORMAL else b"")
    unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
    byte_ids[byte_ids < 0] = unknown
    scores = np.array([score for _, score, _ in pieces])
    worst = min(scores[i] for _, i in normal)
    return Model(
        base,
        check,
        piece,
        scores,
        unknown,
        worst - UNKNOWN_PENALTY,
        byte_ids,
        np.frombuffer(b"".join(texts), np.uint8),
        np.concatenate([[0], np.cumsum([len(t) for t in texts])]),
    )


@lru_cache(maxsize=4)
def load(path: str = MODEL_PATH) -> Model:
    with open(path, "rb") as file:
        return model_of(read_pieces(file.read()))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _arcs(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, model: Model):
    """Every piece that fits at a character: its start, its end and its id; unknown characters as the unknown id.

    ends: for each byte the end of its chunk; starts: the places where a character starts.
    """
    begins, stops, ids = [], [], []
    lead = data[starts]
    width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    single = np.zeros(len(data), bool)
    node, at, begin = np.zeros(len(starts), np.int64), starts, starts
    character = np.zeros(len(data), np.int64)
    character[starts] = width
    while len(at):
        step = model.base[node] + data[at]
        inside = model.check[step] == node
        node, begin, at = step[inside], begin[inside], at[inside] + 1
        found = model.piece[node]
        hit = found >= 0
        begins.append(begin[hit])
        stops.append(at[hit])
        ids.append(found[hit])
        single[begin[hit & (at - begin == character[begin])]] = True
        more = at < ends[begin]
        node, begin, at = node[more], begin[more], at[more]
    missing = starts[~single[starts]]
    begins.append(missing)
    stops.append(missing + character[missing])
    ids.append(np.full(len(missing), model.unknown, np.int32))
    return np.concatenate(begins), np.concatenate(stops), np.concatenate(ids)


def encode_chunks(chunks: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all chunks one after the other, the offset of each chunk, and its score."""
    raw = chunks.cast(pa.binary())
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    first = np.repeat(bounds[:-1], sizes)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    begin, stop, piece = _arcs(data, np.repeat(bounds[1:], sizes), starts, model)
    score = model.scores[piece]
    score[piece == model.unknown] = model.unknown_score
    # Arcs by the place of their start in the chunk: one step serves that place of all chunks.
    place = begin - first[begin]
    order = np.argsort(place, kind="stable")
    begin, stop, piece, score = begin[order], stop[order], piece[order], score[order]
    steps = np.concatenate([[0], np.cumsum(np.bincount(place))])
    # A chunk of n bytes has n + 1 places, so places are shifted by the number of chunks before.
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    shift = chunk[begin]
    begin, stop = begin + shift, stop + shift
    best = np.full(len(data) + len(sizes), -np.inf)
    best[bounds[:-1] + np.arange(len(sizes))] = 0
    back = np.zeros(len(best), np.int64)
    for a, b in zip(steps[:-1], steps[1:]):
        value = best[begin[a:b]] + score[a:b]
        better = np.flatnonzero(value > best[stop[a:b]])
        best[stop[a:b][better]] = value[better]
        back[stop[a:b][better]] = a + better
    ends = bounds[1:] + np.arange(len(sizes))
    heads = bounds[:-1] + np.arange(len(sizes))
    # The way back of all chunks at once; an unknown character counts as many ids as it has bytes.
    open_, at = np.flatnonzero(ends > heads), ends[ends > heads]
    ways = []
    counts = np.zeros(len(sizes), np.int64)
    while len(open_):
        arc = back[at]
        length = np.where(piece[arc] == model.unknown, stop[arc] - begin[arc], 1)
        counts[open_] += length
        ways.append((open_, arc, counts[open_]))
        at = begin[arc]
        more = at > heads[open_]
        open_, at = open_[more], at[more]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(offsets[-1], np.int32)
    for own, arc, behind in ways:
        target = offsets[own + 1] - behind
        known = piece[arc] != model.unknown
        out[target[known]] = piece[arc[known]]
        odd, odd_at = arc[~known], target[~known]
        length = stop[odd] - begin[odd]
        source = _ranges(begin[odd] - own[~known], length)
        out[_ranges(odd_at, length)] = model.byte_ids[data[source]]
    return out, offsets, np.where(sizes > 0, best[ends], 0.0)


def encode(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, the offset of each text, and its score."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    flat = lists.flatten()
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(length)), length)
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    last = np.zeros(len(flat), bool)
    last[np.cumsum(length)[length > 0] - 1] = True
    # Spaces before a word: its own and those of the empty words before it in the text.
    index = np.arange(len(flat))
    previous = np.maximum.accumulate(np.where(~empty, index, -1))
    previous = np.concatenate([[-1], previous[:-1]]) if len(flat) else previous
    head = np.repeat(np.cumsum(length) - length, length)
    spaces = index - np.maximum(previous, head - 1)
    taken = ~empty | (last & ~((length == 1)[owner]))
    coded = flat.filter(pa.array(taken)).dictionary_encode()
    spaces, owner = spaces[taken], owner[taken]
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Distinct (word, spaces): nearly always one space.
    pair = codes + len(coded.dictionary) * spaces
    distinct, which = (np.unique(pair, return_inverse=True)) if (spaces > 1).any() else (None, codes)
    if distinct is None:
        chunks = pc.binary_join_element_wise(MARKER, coded.dictionary, "")
    else:
        words = coded.dictionary.take(pa.array(distinct % len(coded.dictionary)))
        marks = pc.binary_repeat(pa.array([MARKER] * len(distinct)), pa.array(distinct // len(coded.dictionary)))
        chunks = pc.binary_join_element_wise(marks, words, "")
    ids, offsets, scores = encode_chunks(chunks, model)
    sizes = np.diff(offsets)[which]
    words_before = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(length)))])
    out = ids[_ranges(offsets[:-1][which], sizes)]
    running = np.concatenate([[0], np.cumsum(sizes)])
    return out, running[words_before], sums(scores[which], words_before)


def decode(ids: np.ndarray, offsets: np.ndarray, model: Model) -> list[str]:
    """The text of each range of ids; bytes that are not UTF-8 become U+FFFD."""
    sizes = np.diff(model.text_offsets)[ids]
    data = model.texts[_ranges(model.text_offsets[:-1][ids], sizes)].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
    # The first byte is the space that encoding put before the text.
    return [
        data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())
    ]


def encoded(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, pieces (ids), n_pieces, score, decoded_sha256 and exact (decodes to the text) of every document."""
    model = load(model_path)
    ids_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                ids, offsets, scores = encode(texts, model)
                back = decode(ids, offsets, model)
                given = pc.fill_null(texts, "").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                        pa.array(np.diff(offsets)),
                        pa.array(scores),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                        pa.array([a == b for a, b in zip(back, given)]),
                    ],
                    ["doc_id", "pieces", "n_pieces", "score", "decoded_sha256", "exact"],
                )

    return in_batches(
        docs.select("doc_id", "text"),
        run,
        f"doc_id {ids_type}, pieces array<int>, n_pieces long, score double, decoded_sha256 string, exact boolean",
    )
