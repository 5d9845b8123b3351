"""Language model scores: a gated recurrent network over words, beside a unigram base over the whole corpus.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered, followed by one end token. Word counts are taken over every
document; they give the base score `sum log10((c + 0.5) / (N + 0.5 (V + 1)))` and the vocabulary. The network
knows every frequent word with at least `LEAST_TIMES` training occurrences, and the `VOCABULARY` most frequent ones if
those are more; any other word is predicted as unknown and then by its share of the base's unknown mass, so all words have
a probability. Its output is factored: first a class of words, then the word within the class.

The network is trained on all training documents. Their token ids are stored in `ROUNDS` rounds; in a round each task
learns from its own shard in numpy, by back-propagation truncated to windows of `WINDOW` steps, and what the shards have changed
is averaged by tokens before the next round; on its way there a change has 16 bits. In scoring the hidden state goes on from window to window, so the score of a document is
the log-likelihood of the whole of it.

Scoring is one map. Frequent words (at most `FREQUENT`, found by a histogram of the counts) are looked up in the task; the
rare words of a document are joined with the count table, and no rare word is frequent enough to be a hot key.

Defined results: null and empty texts are one end token; repeated rows are scored one by one and counted each; without any
training document N is 0, every score is that of uniform counts. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import in_batches, mixed, remainder, slices, sums, words
from kindred.runtime import stored

# Least classes of the output and words in each: the vocabulary has their product as its size.
CLASSES = 45
PER_CLASS = 45
VOCABULARY = CLASSES * PER_CLASS - 2
# Beyond those the network knows the words with so many training occurrences, so it grows with the counts.
LEAST_TIMES = 400
END, OTHER = 0, 1
HIDDEN = 24
WINDOW = 32
# Streams that are learned from side by side, at most, and windows that each then has at least.
STREAMS = 512
STREAM_WINDOWS = 4
# The pass over the training tokens is cut into rounds; every token is learned from in one of them.
ROUNDS = 3
# A shard has at least so many tokens a round, so that averages are over weights that have moved.
SHARD_TOKENS = 200_000
# Tokens a task holds at a time.
HELD_TOKENS = 2_000_000
# Values in one piece of a round's changes on its way to their average.
PIECE = 1 << 14
PIECES = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("tokens", pa.int64()), ("scale", pa.float64()), ("changes", pa.binary())])
PIECES_SQL = "part int, place int, tokens long, scale double, changes binary"
# Bound of the words that every task knows.
FREQUENT = 200_000
# Outputs held at a time, so that they stay in a core's cache, and how large they may get before the largest is taken off.
CACHED = 1 << 16
SAFE = 60.0
# Rows of one word from which on they are added up apart.
LONG = 24
# Documents that are scored side by side, and tokens of one of their windows.
BESIDE = 1024
BESIDE_TOKENS = 1 << 16
# Tokens that a task scores together; texts of one such group are stepped through side by side.
GROUP_TOKENS = 1_500_000


@dataclass
class Counts:
    """Stored (word, n_all, n_train), and what the base needs: N, V, and the count of the end token."""

    table: DataFrame
    tokens: int
    distinct: int
    ends: int

    @property
    def whole(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def log10(self, counts):
        return np.log10((np.asarray(counts, np.float64) + 0.5) / self.whole)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts, ""))


def count_words(docs: DataFrame) -> Counts:
    """Counts over docs (text, _train). Each task adds up its words before they are shuffled."""

    def count(batches):
        held: list[pa.Table] = []

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n_all", "sum"), ("n_train", "sum")]).rename_columns(
                ["word", "n_all", "n_train"]
            )

        for batch in batches:
            for part in slices(batch):
                offsets, codes, distinct = words(lowered(part.column("text")))
                train = np.repeat(part.column("_train").to_numpy(zero_copy_only=False).astype(bool), np.diff(offsets))
                size = len(distinct)
                held.append(
                    pa.table(
                        {
                            "word": distinct,
                            "n_all": np.bincount(codes, minlength=size),
                            "n_train": np.bincount(codes[train], minlength=size),
                        }
                    )
                )
            if sum(t.num_rows for t in held) > 1_000_000:
                held[:] = [added()]
                if held[0].num_rows > 500_000:
                    yield from held.pop().to_batches()
        if held:
            yield from added().to_batches()

    found = in_batches(docs.select("text", "_train"), count, "word string, n_all long, n_train long")
    table = stored(found.groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train")), "words")
    ends = docs.agg(F.coalesce(F.sum(F.col("_train").cast("long")), F.lit(0))).first()[0]
    row = table.agg(F.sum("n_train").alias("n"), F.sum((F.col("n_train") > 0).cast("long")).alias("v")).first()
    return Counts(table, (row["n"] or 0) + ends, (row["v"] or 0) + (ends > 0), ends)


def frequent_words(counts: Counts, most: int = FREQUENT) -> list[tuple[str, int]]:
    """At most `most` words with their training counts: all that occur at least so often, in ascending order."""
    step = F.floor(F.log2("n_all") * 64)
    bins = counts.table.groupBy(step.alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect()
    least, taken = None, 0
    for row in bins:  # at most 64 bins for each power of two
        taken += row["n"]
        if taken > most:
            break
        least = row["bin"]
    if least is None:
        return []
    rows = counts.table.filter(step >= least).select("word", "n_train").collect()
    return sorted((r["word"], r["n_train"]) for r in rows)


@dataclass
class Network:
    """Input rows of the three gates, recurrent weights, and the factored output."""

    inputs: np.ndarray  # words x 3 hidden
    recurrent: np.ndarray  # hidden x 3 hidden
    class_weights: np.ndarray  # classes x hidden
    class_bias: np.ndarray
    word_weights: np.ndarray  # classes x words of a class x hidden
    word_bias: np.ndarray  # classes x words of a class
    learned: int = 0  # tokens it has learned from

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 11) -> Network:
        """Small random weights, and biases that make the first predictions those of the counts."""
        draw = np.random.default_rng(seed)
        side = round(len(counts) ** 0.5)
        share = (counts + 0.5).reshape(side, side)

        def small(*shape):
            return (draw.standard_normal(shape) * 0.1).astype(np.float32)

        return cls(
            small(len(counts), 3 * HIDDEN),
            small(HIDDEN, 3 * HIDDEN),
            small(side, HIDDEN) * 0.1,
            np.log(share.sum(1) / share.sum()).astype(np.float32),
            small(side, side, HIDDEN) * 0.1,
            np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.class_weights, self.class_bias, self.word_weights, self.word_bias]


def _order(ids: np.ndarray) -> np.ndarray:
    """Stable order of ids; those of 16 bits are sorted by digits."""
    return np.argsort(ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, kind="stable")


def _joined(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights with the bias as last column, for states with a one behind them."""
    return np.concatenate([weights, bias[..., None]], axis=-1)


def _bounded(joined: np.ndarray) -> np.ndarray:
    """Whether the outputs can be raised as they are: states lie between -1 and 1, so that weights bound them."""
    return (np.abs(joined) @ np.ones(joined.shape[-1], np.float32)).max(-1) < SAFE


def _raised(given: np.ndarray, joined: np.ndarray, bounded: bool) -> np.ndarray:
    """Unnormalised logits of the rows; the largest is taken off where they are not bounded."""
    outputs = given @ joined.T
    if not bounded:
        outputs -= outputs.max(-1, keepdims=True)
    return outputs


def _chosen(given: np.ndarray, joined: np.ndarray, bounded: bool, which: np.ndarray) -> np.ndarray:
    """Log-probability of the chosen output of each row, in slices that stay in the cache."""
    rows, ones = max(1, CACHED // len(joined)), np.ones(len(joined), np.float32)
    out, each = np.empty(len(which), np.float32), np.arange(rows)
    for at in range(0, len(which), rows):
        part = slice(at, at + rows)
        outputs = _raised(given[part], joined, bounded)
        own = outputs[each[: len(outputs)], which[part]]
        out[part] = own - np.log(np.exp(outputs, out=outputs) @ ones)
    return out


def _errors(given: np.ndarray, joined: np.ndarray, bounded: bool, which: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Gradient of joined weights in the loss of the chosen outputs; that of the states is written to `back`.

    Products are taken of the raised outputs, and the few columns beside them are divided by their sums.
    """
    rows, ones = max(1, CACHED // len(joined)), np.ones(len(joined), np.float32)
    total, each = 0, np.arange(rows)
    for at in range(0, len(which), rows):
        part = slice(at, at + rows)
        outputs = _raised(given[part], joined, bounded)
        np.exp(outputs, out=outputs)
        sums = outputs @ ones
        outputs[each[: len(outputs)], which[part]] -= sums
        shares = np.reciprocal(sums, out=sums)[:, None]
        np.multiply(outputs @ joined[:, :-1], shares, out=back[part])
        total = total + outputs.T @ (given[part] * shares)
    return total


def _added(rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows[order] over the ranges that begin at `first`: long ranges one by one, all others row by row together."""
    counts = np.diff(first, append=len(order))
    by_count = np.argsort(-counts, kind="stable")
    falling, at = -counts[by_count], first[by_count]
    long = int(np.searchsorted(falling, -LONG, side="right"))
    sums = rows.take(order[at], axis=0)
    for i in range(long):
        sums[i] = np.ones(-falling[i], np.float32) @ rows.take(order[at[i] : at[i] - falling[i]], axis=0)
    for k in range(1, LONG):
        more = int(np.searchsorted(falling, -k, side="left"))
        sums[long:more] += rows.take(order[at[long:more] + k], axis=0)
    out = np.empty_like(sums)
    out[by_count] = sums
    return out


def step(recurrent: np.ndarray, state: np.ndarray, given: np.ndarray, goes_on: np.ndarray):
    """The next state from the state and the words before, one column each; a document starts from zero behind an end token.

    `recurrent` is transposed, `given` holds the input rows of the words as columns, `goes_on` is 0 behind an end token.
    """
    state = state * goes_on
    kept = recurrent @ state
    gates = given[: 2 * HIDDEN] + kept[: 2 * HIDDEN]
    np.exp(np.negative(gates, out=gates), out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    update, reset = gates[:HIDDEN], gates[HIDDEN:]
    past = kept[2 * HIDDEN :]
    proposed = reset * past
    proposed += given[2 * HIDDEN :]
    np.tanh(proposed, out=proposed)
    moved = proposed - state
    moved *= update
    moved += state
    return moved, (state, update, reset, past, proposed)


def fresh_memory(net: Network) -> list[np.ndarray]:
    """Sums of squared gradients before the first step."""
    return [np.full(p.shape, 1e-4, np.float32) for p in net.parts()]


def streams_of(tokens: int, most: int = STREAMS) -> int:
    """Parts side by side for a stream in which so many tokens are to be predicted."""
    return max(1, min(most, tokens // (WINDOW * STREAM_WINDOWS)))


def train(
    net: Network,
    stream: np.ndarray,
    epochs: int = 1,
    rate: float = 0.08,
    memory: list[np.ndarray] | None = None,
    most_streams: int = STREAMS,
) -> int:
    """Back-propagation through windows of the token stream, cut into parts of one length that run side by side.

    The first token only stands before the second. Returns how many of the tokens behind it were predicted and learned from; the
    rest, fewer than there are parts, are for the next call, behind the last one used. The network is changed in place, and
    so is the memory of squared gradients, which can go on from stream to stream.
    """
    parts = net.parts()
    memory = memory or fresh_memory(net)
    classes, per_class = net.word_bias.shape
    streams = streams_of(len(stream) - 1, most_streams)
    steps = (len(stream) - 1) // streams
    if steps < 1:
        return 0
    length = steps + 1
    lanes = stream[np.arange(length)[:, None] + np.arange(streams) * steps]
    scale = np.float32(1 / streams)
    class_joined, class_squares = _joined(net.class_weights, net.class_bias), _joined(memory[2], memory[3])
    word_joined, word_squares = _joined(net.word_weights, net.word_bias), _joined(memory[4], memory[5])

    def learn(weights: np.ndarray, squares: np.ndarray, gradient: np.ndarray) -> None:
        squares += gradient * gradient
        gradient *= rate
        gradient /= np.sqrt(squares)
        weights -= gradient

    for _ in range(epochs):
        state = np.zeros((HIDDEN, streams), np.float32)
        for start in range(0, length - 1, WINDOW):
            span = range(start, min(start + WINDOW, length - 1))
            before = lanes[span.start : span.stop]
            goes_on = (before != END).astype(np.float32)
            before = before.ravel()
            given = np.ascontiguousarray(
                net.inputs.take(before, axis=0).reshape(len(span), streams, 3 * HIDDEN).transpose(0, 2, 1)
            )
            recurrent = np.ascontiguousarray(net.recurrent.T)
            saved, hidden = [], np.ones((len(span), streams, HIDDEN + 1), np.float32)
            for i in range(len(span)):
                state, tape = step(recurrent, state, given[i], goes_on[i])
                saved.append(tape)
                hidden[i, :, :-1] = state.T
            hidden = hidden.reshape(-1, HIDDEN + 1)
            target = lanes[span.start + 1 : span.stop + 1].ravel()
            group, place = np.divmod(target, per_class)
            back = np.empty((len(target), HIDDEN), np.float32)
            class_back = _errors(hidden, class_joined, _bounded(class_joined), group, back)
            order = _order(group)
            edges = np.searchsorted(group[order], np.arange(classes + 1))
            hidden, place = hidden.take(order, axis=0), place[order]
            word_back = np.empty_like(back)
            bounded = _bounded(word_joined)
            for c in np.flatnonzero(np.diff(edges)):
                own = slice(edges[c], edges[c + 1])
                gradient = _errors(hidden[own], word_joined[c], bounded[c], place[own], word_back[own])
                gradient *= scale
                learn(word_joined[c], word_squares[c], gradient)
            back[order] += word_back
            back = np.ascontiguousarray(back.reshape(len(span), streams, HIDDEN).transpose(0, 2, 1))
            recurrent_back = np.zeros_like(net.recurrent)
            ahead = np.zeros((HIDDEN, streams), np.float32)
            flow = given  # no longer needed: its place is taken by the gradients of the gates
            for i in reversed(range(len(span))):
                past_state, update, reset, past, proposed = saved[i]
                delta, gates = back[i], flow[i]
                delta += ahead
                raw = proposed * proposed
                np.subtract(1, raw, out=raw)
                raw *= update
                raw *= delta
                rest = 1 - update
                own = np.subtract(proposed, past_state, out=gates[:HIDDEN])
                own *= delta
                own *= update
                own *= rest
                through = np.multiply(raw, reset, out=gates[2 * HIDDEN :])
                own = np.multiply(through, past, out=gates[HIDDEN : 2 * HIDDEN])
                own *= 1 - reset
                recurrent_back += past_state @ gates.T
                ahead = net.recurrent @ gates
                rest *= delta
                ahead += rest
                ahead *= goes_on[i]
                gates[2 * HIDDEN :] = raw
            by_word = _order(before)
            first = np.flatnonzero(np.diff(before[by_word], prepend=-1))
            seen = before[by_word[first]]
            gradient = _added(flow.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN), by_word, first)
            gradient *= scale
            rows, squares = net.inputs.take(seen, axis=0), memory[0].take(seen, axis=0)
            learn(rows, squares, gradient)
            net.inputs[seen], memory[0][seen] = rows, squares
            learn(net.recurrent, memory[1], np.clip(recurrent_back * scale, -1, 1))
            class_back *= scale
            learn(class_joined, class_squares, class_back)
    for at, joined in ((2, class_joined), (4, word_joined)):
        parts[at][:], parts[at + 1][:] = joined[..., :-1], joined[..., -1]
    for at, joined in ((2, class_squares), (4, word_squares)):
        memory[at][:], memory[at + 1][:] = joined[..., :-1], joined[..., -1]
    return streams * steps


def log10_likelihoods(net: Network, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of each document's tokens; documents of like length step through their windows side by side."""
    class_joined, word_joined = _joined(net.class_weights, net.class_bias), _joined(net.word_weights, net.word_bias)
    outputs = class_joined, _bounded(class_joined), word_joined, _bounded(word_joined)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros(len(lengths))
    for at in range(0, len(order), BESIDE):
        own = order[at : at + BESIDE]
        out[own] = _log_likelihoods(net, outputs, tokens, offsets[own], lengths[own]) / np.log(10)
    return out


def _log_likelihoods(net: Network, outputs: tuple, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log probability of the documents' tokens, longest document first."""
    class_joined, class_bounded, word_joined, word_bounded = outputs
    classes, per_class = net.word_bias.shape
    recurrent = np.ascontiguousarray(net.recurrent.T)
    total = np.zeros(len(lengths))
    state = np.zeros((HIDDEN, len(lengths)), np.float32)
    longest = int(lengths[0]) if len(lengths) else 0
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
    at = 0
    while at < longest:
        # Fewer documents go on to later windows, which may then be longer.
        end = min(longest, at + max(WINDOW, BESIDE_TOKENS // max(int(active[at]), 1)))
        edges = np.concatenate([[0], np.cumsum(active[at:end])])
        hidden = np.ones((edges[-1], HIDDEN + 1), np.float32)
        target = np.empty(edges[-1], tokens.dtype)
        for t in range(at, end):
            n, own = int(active[t]), slice(edges[t - at], edges[t - at + 1])
            before = tokens[starts[:n] + t - 1] if t else np.full(n, END)
            given = np.ascontiguousarray(net.inputs.take(before, axis=0).T)
            state, _ = step(recurrent, state[:, :n], given, before != END)
            hidden[own, :-1] = state.T
            target[own] = tokens[starts[:n] + t]
        owner = np.arange(edges[-1]) - np.repeat(edges[:-1], active[at:end])
        group, place = np.divmod(target, per_class)
        chance = _chosen(hidden, class_joined, class_bounded, group)
        by_class = _order(group)
        edges = np.searchsorted(group[by_class], np.arange(classes + 1))
        hidden, place = hidden.take(by_class, axis=0), place[by_class]
        inner = np.empty_like(chance)
        for c in np.flatnonzero(np.diff(edges)):
            own = slice(edges[c], edges[c + 1])
            inner[own] = _chosen(hidden[own], word_joined[c], word_bounded[c], place[own])
        chance[by_class] += inner
        total[: int(active[at])] += np.bincount(owner, chance.astype(np.float64), minlength=int(active[at]))
        at = end
    return total


def with_ends(offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids with an end token behind each document, and their offsets."""
    new = offsets + np.arange(len(offsets))
    tokens = np.full(len(codes) + len(offsets) - 1, END, np.int64)
    tokens[np.arange(len(codes)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = codes
    return tokens, new


def _vocabulary(frequent: list[tuple[str, int]], counts: Counts) -> tuple[pa.Array, np.ndarray]:
    """Words of the network (ids from 2 on) and the training count of every id."""
    ranked = sorted((w for w in frequent if w[1] > 0), key=lambda w: (-w[1], w[0]))
    top = ranked[: max(VOCABULARY, sum(n >= LEAST_TIMES for _, n in ranked))]
    side = max(CLASSES, math.isqrt(len(top) + 1) + 1)
    known = np.zeros(side * side)
    known[END] = counts.ends
    known[2 : 2 + len(top)] = [n for _, n in top]
    known[OTHER] = counts.tokens - known.sum()
    return pa.array([w for w, _ in top], pa.string()), known


def _pieces(arrays: list[np.ndarray], tokens: int):
    """Pieces (PIECES) of arrays: 16 bits a value, as shares of the largest one in the piece."""
    for part, values in enumerate(arrays):
        flat = values.ravel()
        for place, at in enumerate(range(0, len(flat), PIECE)):
            piece = flat[at : at + PIECE].astype(np.float64)
            scale = float(np.abs(piece).max()) or 1.0
            shares = (piece / scale).astype(np.float16).tobytes()
            row = {"part": part, "place": place, "tokens": tokens, "scale": scale, "changes": shares}
            yield pa.RecordBatch.from_pylist([row], PIECES)


def _averaged(pieces: DataFrame, roots: int) -> tuple[list[np.ndarray], int]:
    """Arrays (float32, flat) averaged over the shards' pieces, by tokens; all tokens. From part `roots` on, squares are averaged."""

    def add(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                kept = held.setdefault((row["part"], row["place"]), [0, 0.0])
                values = np.frombuffer(row["changes"], np.float16).astype(np.float64) * row["scale"]
                kept[0] += row["tokens"]
                kept[1] = kept[1] + row["tokens"] * (values * values if row["part"] >= roots else values)
        for (part, place), (tokens, total) in held.items():
            own = pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([tokens], pa.int64()), own],
                ["part", "place", "tokens", "mean"],
            )

    dealt = pieces.repartition("part", "place")
    rows = sorted(map(tuple, in_batches(dealt, add, "part int, place int, tokens long, mean binary").collect()))
    arrays = [
        np.concatenate([np.frombuffer(raw, np.float32) for at, _, _, raw in rows if at == part])
        for part in sorted({row[0] for row in rows})
    ]
    return arrays, rows[0][2] if rows else 0


def shards_of(tokens: int, net: Network) -> int:
    """Shards of a round: as many as have SHARD_TOKENS tokens, and whose weights are no larger than half the tokens."""
    held = 2 * sum(p.nbytes for p in net.parts())
    return max(1, min(tokens // (ROUNDS * SHARD_TOKENS), 2 * tokens // held))


def _trained(docs: DataFrame, vocabulary: pa.Array, known: np.ndarray) -> Network:
    """The network after training on all training documents, in rounds of shards whose weights are averaged."""
    net = Network.fresh(known)
    tokens_held = int(known.sum())
    if not tokens_held:
        return net

    def coded(batches):
        partition, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch):
                offsets, codes, distinct = words(lowered(part.column("text")))
                found = pc.fill_null(pc.index_in(distinct, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                tokens, ends = with_ends(offsets, np.where(found < 0, OTHER, found + 2)[codes])
                rows = [tokens[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])]
                turn = mixed((partition << 33) + row + np.arange(part.num_rows)) % np.uint64(ROUNDS)
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(turn.astype(np.int32))], ["tokens", "turn"])

    table = stored(in_batches(docs.filter("_train").select("text"), coded, "tokens binary, turn int"), "tokens", ("turn",))
    shards = shards_of(tokens_held, net)
    memory = fresh_memory(net)
    for turn in range(ROUNDS):
        # Pickled with the task: every shard starts a round from the same weights.
        start, squares = net.parts(), memory

        def learn(batches):
            own = Network(*[p.copy() for p in start])
            own_squares, taken = [m.copy() for m in squares], 0
            held, size = [np.array([END], np.int32)], 0

            def step_on(most_streams: int = STREAMS) -> None:
                """Learn from what is held; what does not fill the streams is held on."""
                nonlocal taken, size
                whole = np.concatenate(held)
                used = train(own, whole, memory=own_squares, most_streams=most_streams)
                held[:] = [whole[used:]]
                taken, size = taken + used, size - used

            for batch in batches:
                for raw in batch.column("tokens"):
                    held.append(np.frombuffer(raw.as_buffer(), np.int32))
                    size += len(held[-1])
                    if size >= HELD_TOKENS:
                        step_on()
            if size:
                step_on()
                step_on(1)
            if not taken:
                return
            # What the round has changed. Squares only grow; their roots span fewer magnitudes.
            moved = [now - was for now, was in zip(own.parts(), start)]
            grown = [np.sqrt(np.maximum(now - was, 0)) for now, was in zip(own_squares, squares)]
            yield from _pieces(moved + grown, taken)

        # Merged without a shuffle; files that are fewer than the shards are shards themselves.
        own_turn = table.filter(F.col("turn") == turn).select("tokens").coalesce(shards)
        found, taken = _averaged(in_batches(own_turn, learn, PIECES_SQL), len(start))
        if found:
            arrays = [was + change.reshape(was.shape) for was, change in zip([*start, *squares], found)]
            net, memory = Network(*arrays[: len(start)], net.learned + taken), arrays[len(start) :]
    return net


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learned from the rows whose crc32(doc_id) mod 5 is not 1.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", (remainder("doc_id", 5) != 1).alias("_train"))
    counts = count_words(docs)
    frequent = frequent_words(counts)
    vocabulary, known = _vocabulary(frequent, counts)
    net = _trained(docs, vocabulary, known)
    shared = pa.array([w for w, _ in frequent], pa.string())
    shared_counts = np.array([n for _, n in frequent], np.int64)
    shared_logs = counts.log10(shared_counts)
    shared_ids = np.full(len(frequent), OTHER, np.int64)
    shared_ids[pc.index_in(vocabulary, value_set=shared).to_numpy(zero_copy_only=False).astype(np.int64)] = (
        np.arange(len(vocabulary)) + 2
    )
    end_log, end_known = float(counts.log10(counts.ends)), int(counts.ends > 0)

    def run(batches):
        partition, row = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def scored():
            tokens = np.concatenate([h[1] for h in held])
            starts = np.cumsum([0, *[len(h[1]) for h in held]])
            offsets = np.concatenate([h[2][:-1] + s for h, s in zip(held, starts)] + [starts[-1:]])
            likely, at = log10_likelihoods(net, tokens, offsets), 0
            for batch, _, _ in held:
                own = likely[at : at + batch.num_rows]
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "likely"])
            held.clear()

        for batch in batches:
            for part in slices(batch):
                offsets, codes, distinct = words(lowered(part.column("text")))
                found = pc.fill_null(pc.index_in(distinct, value_set=shared), -1).to_numpy(zero_copy_only=False)
                at = found[codes]
                rare = at < 0
                logs = np.where(rare, 0, shared_logs[at] if len(shared_logs) else 0)
                word_ids = np.where(rare, OTHER, shared_ids[at] if len(shared_ids) else OTHER)
                seen = ~rare & ((shared_counts[at] if len(shared_counts) else 0) > 0)
                tokens, ends = with_ends(offsets, word_ids)
                # Rare words of each document with their number.
                owner = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                pair, times = np.unique(owner[rare] * (len(distinct) + 1) + codes[rare], return_counts=True)
                pair_owner, pair_code = np.divmod(pair, len(distinct) + 1)
                bounds = np.searchsorted(pair_owner, np.arange(part.num_rows + 1)).astype(np.int32)
                listed = pa.StructArray.from_arrays([distinct.take(pa.array(pair_code)), pa.array(times)], ["word", "times"])
                batch_out = pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("_train"),
                        pa.array((partition << 33) + row + np.arange(part.num_rows)),
                        pa.array(np.diff(offsets) + 1),
                        pa.array(sums(seen.astype(np.int64), offsets) + end_known),
                        pa.array(sums(logs, offsets) + end_log),
                        pa.array(sums(np.where(word_ids == OTHER, logs, 0), offsets)),
                        pa.array(sums((word_ids == OTHER).astype(np.int64), offsets)),
                        pa.ListArray.from_arrays(pa.array(bounds), listed),
                    ],
                    ["doc_id", "train", "row", "n_tokens", "n_known", "base", "other_base", "n_other", "rare"],
                )
                row += part.num_rows
                held.append((batch_out, tokens.astype(np.int32), ends))
                if sum(len(h[1]) for h in held) >= GROUP_TOKENS:
                    yield from scored()
        if held:
            yield from scored()

    found = stored(
        in_batches(
            docs,
            run,
            f"doc_id {ids}, train boolean, row long, n_tokens long, n_known long, base double, other_base double, "
            "n_other long, rare array<struct<word: string, times: long>>, likely double",
        ),
        "scores",
    )
    listed = found.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    chance = F.log10((F.col("n_train") + 0.5) / F.lit(counts.whole))
    rare = (
        listed.join(counts.table.select("word", "n_train"), "word")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * chance).alias("rare_base"),
            F.sum(F.when(F.col("n_train") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    # The share of all words outside the vocabulary, seen or not, among the base's words.
    others = known[OTHER] + 0.5 * (counts.distinct - len(vocabulary) - end_known) + 0.5
    other_log = float(np.log10(others / counts.whole))
    rare_base = F.coalesce("rare_base", F.lit(0.0))
    return found.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_base).alias("base_score"),
        (F.col("likely") + F.col("other_base") + rare_base - F.col("n_other") * other_log).alias("score"),
    )
