"""Phrase collocations: frequent n-grams by Misra-Gries summaries of hash partitions, then exact counts and scores.

Texts are lower-cased (A to Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words `[^\\x20\\x09]+`; everything is
counted for each language by itself. A phrase is a run of words within a piece; one that occurs `least` times or more is frequent.

First pass, for phrases of one word, then two, then three: tasks add up the hashes of phrases they read, which are dealt to
2^b hash partitions. Each partition has a Misra-Gries summary with a capacity above its mass (number of occurrences) / least:
what the tasks have counted is merged into it, and whenever it holds more entries than the capacity, the count just beyond it
is subtracted from all. What is subtracted sums up to less than `least`, whatever the order of merges, so every frequent phrase
is left, and those whose count plus the sum of subtractions stays below `least` go. The survivors are marked in a bitmap of
at most 2^MOST_BITS bits, and the next width only looks at phrases both of whose shorter ends are marked.

Second pass: occurrences of marked phrases are counted exactly, by their words, and those below `least` dropped. Scores are
whole numbers computed as decimals of 38 digits, exact up to 10^16 occurrences of a phrase.

Defined results: null and empty texts have no words, a null language is `und`, and an empty one is a language of its own;
repeated rows count as often as they are given; ties are broken as the order says, down to the phrase itself, in byte order;
an empty table gives an empty result. Only text and lang are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import mixed, slices, word_hashes
from kindred.runtime import stored

LEAST, LONGEST, TOP, SHARE = 10, 3, 2000, 50
NO_LANGUAGE = "und"
STEP = np.uint64(0x9E3779B97F4A7C15)
# Mass of a hash partition that is aimed at, and limits of their number (as powers of two).
PART_MASS = 1 << 22
LEAST_PARTS, MOST_PARTS = 5, 20
# Bytes of a hash that tell the phrases of a partition apart; phrases that share them are only counted together here.
KEY_BYTES = 5
# Size of the bitmap of survivors, as a power of two: 32 MB at most. A fuller map lets more phrases through to the exact count.
LEAST_BITS, MOST_BITS = 16, 28
# Phrases that a task adds up before it hands them on: hashes, and phrases as text.
HELD, HELD_TEXTS = 1 << 21, 1 << 20

# Bytes: 0 belongs to a word, 1 stands between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Tokens:
    """Words of some texts in order: code (into vocabulary), piece, language (into languages) and hash of each."""

    def __init__(self, batch: pa.RecordBatch):
        langs = pc.fill_null(batch.column("lang").cast(pa.string()), NO_LANGUAGE).dictionary_encode()
        self.languages = langs.dictionary
        raw = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
        joined = b"\n".join(raw).lower() + b"\n"  # of bytes: A to Z only
        data = np.frombuffer(joined, np.uint8)
        kind = KIND[data]
        in_word = kind == 0
        edges = np.diff(in_word.view(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[in_word]))]
        )
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        text_starts = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
        row = np.searchsorted(text_starts, starts, side="right") - 1
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        self.hash = word_hashes(self.vocabulary)[self.code]
        self.lang_hash = word_hashes(self.languages)[self.lang]

    def __len__(self) -> int:
        return len(self.code)

    def phrases(self, marks: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a phrase of the width starts whose shorter ends are all marked, and the phrases' hashes."""
        place = np.arange(len(self))
        hashes = mixed(self.hash ^ self.lang_hash)
        for longer in range(2, width + 1):
            marked = is_marked(marks[longer - 2], hashes)
            place, hashes = place[marked], hashes[marked]
            # The phrase that starts at the next word must be marked as well, and in the same piece.
            followed = np.flatnonzero((place[1:] == place[:-1] + 1) & (self.piece[place[1:] + longer - 2] == self.piece[place[:-1]]))
            place, hashes = place[followed], hashes[followed]
            hashes = mixed(hashes * STEP + self.hash[place + longer - 1])
        return place, hashes


def is_marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = int(bitmap.size * 8).bit_length() - 1
    at = hashes >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Summary:
    """A Misra-Gries summary of one hash partition: keys, counts, and what was subtracted so far.

    capacity is more than the partition's whole mass / least. A subtraction of d takes d from capacity + 1 entries at least,
    out of the mass, so all subtractions together are less than least, in whatever order entries come or summaries merge.
    """

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._entries = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._entries += len(keys)
        if self._entries > max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        """Merge what was added, then cut to the capacity."""
        held = [(self.keys, self.counts), *self._waiting]
        self.keys, self.counts = added_up(*map(np.concatenate, zip(*held)))
        self._waiting, self._entries = [], 0
        if len(self.keys) > self.capacity:
            beyond = len(self.counts) - self.capacity - 1
            least = int(np.partition(self.counts, beyond)[beyond])
            kept = self.counts > least
            self.keys, self.counts = self.keys[kept], self.counts[kept] - least
            self.lost += least

    def possible(self, least: int) -> np.ndarray:
        """The keys that may occur least times."""
        self.settle()
        return self.keys[self.counts + self.lost >= least]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for batch in batches:
        for part in slices(batch):
            yield Tokens(part)


def packed(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Distinct hashes (ascending) and their counts as one row for each hash partition: part, mass, keys and counts.

    A key is KEY_BYTES of the hash below those bits that say its partition.
    """
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    low = (keys << np.uint64(bits)) >> np.uint64(64 - 8 * KEY_BYTES)
    raw = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    ends = np.r_[starts[1:], len(part)].astype(np.int64)
    columns = [
        pa.array(part[starts].astype(np.int32)),
        pa.array(np.add.reduceat(counts, starts) if len(starts) else counts, pa.int64()),
        pa.array([raw[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        pa.array([counts[a:b].astype("<i8").tobytes() for a, b in zip(starts, ends)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "mass", "keys", "counts"])


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.zeros((len(keys) // KEY_BYTES, 8), np.uint8)
    raw[:, :KEY_BYTES] = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BYTES)
    return raw.view("<u8").ravel(), np.frombuffer(counts, "<i8")


def occurrences(docs: DataFrame, marks: list, width: int, bits: int) -> DataFrame:
    """Possible phrases and their counts, packed by hash partition, added up within what a task holds at once."""
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, held = [], 0
        for tokens in _tokens(batches):
            fresh.append(np.unique(tokens.phrases(sent.value, width)[1], return_counts=True))
            held += len(fresh[-1][0])
            if held >= HELD:
                yield packed(*added_up(*map(np.concatenate, zip(*fresh))), bits)
                fresh, held = [], 0
        if fresh:
            yield packed(*added_up(*map(np.concatenate, zip(*fresh))), bits)

    return docs.mapInArrow(run, "part int, mass long, keys binary, counts binary")


def survivors(found: DataFrame, bits: int, tasks: int, least: int, size: int) -> DataFrame:
    """part and its piece of the bitmap (2^size bits in all) with the phrases that may occur `least` times marked."""
    own_bits = size - bits

    def piece(summary: Summary) -> bytes:
        marked = np.zeros(1 << own_bits, np.uint8)
        marked[(summary.possible(least) >> np.uint64(8 * KEY_BYTES - own_bits)).astype(np.int64)] = 1
        return np.packbits(marked, bitorder="little").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, current = None, None
        for batch in batches:
            parts, masses = (batch.column(c).to_pylist() for c in ("part", "whole"))
            for row, part in enumerate(parts):
                if part != current:
                    if summary is not None:
                        yield pa.RecordBatch.from_pydict({"part": [current], "marks": [piece(summary)]}, shape)
                    summary, current = Summary(masses[row] // least + 1), part
                summary.add(*unpacked(batch.column("keys")[row].as_py(), batch.column("counts")[row].as_py()))
        if summary is not None:
            yield pa.RecordBatch.from_pydict({"part": [current], "marks": [piece(summary)]}, shape)

    shape = pa.schema([("part", pa.int32()), ("marks", pa.binary())])
    # The mass of a partition is known before its first entry is summarised; its rows then follow each other.
    weighed = found.repartition(tasks, "part").withColumn("whole", F.sum("mass").over(Window.partitionBy("part")))
    return weighed.mapInArrow(run, "part int, marks binary")


def sizes(docs: DataFrame, least: int) -> tuple[int, int]:
    """Bits of a hash that say its partition, and that say its place in the bitmap, for the size of the texts."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    words = max(size // 6, 1)
    bits = min(MOST_PARTS, max(LEAST_PARTS, math.ceil(math.log2(words / PART_MASS))))
    return bits, max(bits + 3, min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(4 * words / least)))))


def possible(docs: DataFrame, least: int, longest: int, bits: int, map_bits: int) -> list[np.ndarray]:
    """For each width a bitmap of hashes in which every phrase that occurs at least `least` times is marked."""
    marks: list[np.ndarray] = []
    for width in range(1, longest + 1):
        found = occurrences(docs, marks, width, bits)
        pieces = survivors(found, bits, _tasks(docs, 1 << bits), least, map_bits).toArrow()
        bitmap = np.zeros((1 << bits, 1 << (map_bits - bits - 3)), np.uint8)  # at most 2^MOST_BITS bits
        for part, piece in zip(pieces["part"].to_pylist(), pieces["marks"].to_pylist()):
            bitmap[part] = np.frombuffer(piece, np.uint8)
        marks.append(bitmap.ravel())
    return marks


def counted(docs: DataFrame, marks: list, least: int, bits: int) -> DataFrame:
    """lang, width, phrase and n: exact counts of frequent phrases, and at width 0 of all words of a language.

    Tasks add up what they read and send it packed, by hash partition and language; a partition is added up in one task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def table(tokens: Tokens, lang: np.ndarray, part: np.ndarray, phrase: pa.Array, n: np.ndarray) -> pa.Table:
        columns = [pa.array(part.astype(np.int32)), tokens.languages.take(pa.array(lang)), phrase, pa.array(n)]
        return pa.Table.from_arrays(columns, ["part", "lang", "phrase", "n"])

    def of_width(tokens: Tokens, marks: list, width: int) -> pa.Table:
        place, hashes = tokens.phrases(marks, width)
        marked = is_marked(marks[width - 1], hashes)
        place, hashes = place[marked], hashes[marked]
        # Exact numbers of the phrases of these texts, from the language and the words' codes.
        key, words = tokens.lang[place], max(len(tokens.vocabulary), 1)
        for step in range(width):
            if step:
                key = np.unique(key, return_inverse=True)[1]
            key = key * words + tokens.code[place + step]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        place = place[first]
        parts = [tokens.vocabulary.take(pa.array(tokens.code[place + step])) for step in range(width)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if width > 1 else parts[0]
        return table(tokens, tokens.lang[place], hashes[first] >> np.uint64(64 - bits), phrase, n)

    def total(tokens: Tokens) -> pa.Table:
        words = np.bincount(tokens.lang, minlength=len(tokens.languages))
        nothing = pa.array([b""] * len(words), pa.large_binary())
        return table(tokens, np.arange(len(words)), np.zeros(len(words)), nothing, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for tokens in _tokens(batches):
            held += [total(tokens), *(of_width(tokens, sent.value, width) for width in range(1, len(sent.value) + 1))]
            if sum(map(len, held)) >= HELD_TEXTS:
                held = [added(held)]
                if len(held[0]) >= HELD_TEXTS // 2:
                    yield packed_texts(held[0])
                    held = []
        if held:
            yield packed_texts(added(held))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        current = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != current and held:
                    yield frequent(added(held), least)
                    held = []
                current = row["part"]
                held.append(unpacked_texts(row))
                if sum(map(len, held)) >= HELD_TEXTS:
                    held = [added(held)]
        if held:
            yield frequent(added(held), least)

    rows = docs.mapInArrow(run, "part int, lang string, rows long, size long, phrases binary, counts binary")
    dealt = rows.repartition(_tasks(docs, 1 << bits), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(sums, "lang string, width int, phrase string, n long")


def added(held: list[pa.Table]) -> pa.Table:
    """Rows with equal phrases of a language added up."""
    keys = ["part", "lang", "phrase"]
    return pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


def packed_texts(table: pa.Table) -> pa.RecordBatch:
    """One row for each part and language: its phrases, a line each, and their counts, compressed."""
    table = table.sort_by([("part", "ascending"), ("lang", "ascending")])
    part = table["part"].to_numpy()
    lang = table["lang"].combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (lang[1:] != lang[:-1])]) if len(table) else []
    rows = []
    for a, b in zip(starts, [*starts[1:], len(table)]):
        own = table.slice(a, b - a)
        lines = b"\n".join(own["phrase"].to_pylist())
        squeezed = pa.compress(lines, codec="zstd", asbytes=True)
        counts = pa.compress(own["n"].to_numpy().astype("<i8").tobytes(), codec="zstd", asbytes=True)
        rows.append((int(part[a]), own["lang"][0].as_py(), b - a, len(lines), squeezed, counts))
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    names = ["part", "lang", "rows", "size", "phrases", "counts"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def unpacked_texts(row: dict) -> pa.Table:
    lines = pa.decompress(row["phrases"], row["size"], codec="zstd", asbytes=True)
    counts = pa.decompress(row["counts"], 8 * row["rows"], codec="zstd", asbytes=True)
    columns = [
        pa.array(np.full(row["rows"], row["part"], np.int32)),
        pa.array([row["lang"]]).take(pa.array(np.zeros(row["rows"], np.int32))),
        pa.array(lines.split(b"\n"), pa.large_binary()),
        pa.array(np.frombuffer(counts, "<i8")),
    ]
    return pa.Table.from_arrays(columns, ["part", "lang", "phrase", "n"])


def frequent(table: pa.Table, least: int) -> pa.RecordBatch:
    """Phrases that occur least times or more, and the languages' totals, whose phrase is empty."""
    empty = pc.equal(pc.binary_length(table["phrase"]), 0)
    table = table.filter(pc.or_(empty, pc.greater_equal(table["n"], least)))
    text = table["phrase"].cast(pa.large_string()).cast(pa.string()).combine_chunks()
    spaces = pc.count_substring(text, " ").to_numpy(zero_copy_only=False)
    width = np.where(pc.binary_length(text).to_numpy(zero_copy_only=False) == 0, 0, spaces + 1).astype(np.int32)
    columns = [table["lang"].combine_chunks(), pa.array(width), text, table["n"].combine_chunks()]
    return pa.RecordBatch.from_arrays(columns, ["lang", "width", "phrase", "n"])


def _tasks(docs: DataFrame, parts: int) -> int:
    """Tasks that merge: those of any shuffle, or so many that each gets about a partition's mass."""
    return max(1, min(parts, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // 4)))


def _part(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the strongest phrases of 2 to `longest` words of each language."""
    docs = docs.select("text", F.col("lang").cast("string").alias("lang"))
    bits, map_bits = sizes(docs, least)
    counts = stored(counted(docs, possible(docs, least, longest, bits, map_bits), least, bits), "phrases")
    words = F.split("phrase", " ")
    phrases = counts.filter("width > 1").select("lang", "phrase", F.col("width").alias("w"), F.col("n").alias("a"))

    # A cut after the first k words: counts of both sides, looked up among the frequent phrases.
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w") - 1))).select(
        "lang", "phrase", "a", "k",
        _part(words, F.lit(1), F.col("k")).alias("head"),
        _part(words, F.col("k") + 1, F.col("w") - F.col("k")).alias("tail"),
    )
    known = counts.filter("width > 0")
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    score = F.expr(
        "CAST((CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0)) * CAST(1000000 AS DECIMAL(7,0)))"
        " DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)"
    )
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))

    # Phrases that mostly stand inside a longer one.
    inner = phrases.filter("w > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("w") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("w") - F.col("length") + 1)))
    held = inner.select("lang", _part(words, F.col("start"), F.col("length")).alias("phrase"), F.col("a").alias("longer"))
    most = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = lowest.join(most, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(19,0)") < share * F.col("cut.a").cast("decimal(19,0)"))
    )

    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("cut.a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("width = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "cut.a", "cut.l", "cut.r", "n", "cut.score")


def sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), worded AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), totals AS (
            SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
        ), grams AS (
            SELECT lang, length, unnest(list_transform(range(1, len(w) - length + 2), lambda i: array_to_string(w[i:i + length - 1], ' '))) AS phrase
            FROM worded, (VALUES (1), (2), (3)) AS lengths(length)
        ), f AS (
            SELECT lang, phrase, length, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 10
        ), cuts AS (
            SELECT lang, phrase, n AS a, unnest(range(1, length)) AS k, string_split(phrase, ' ') AS w FROM f WHERE length > 1
        ), scored AS (
            SELECT c.lang, c.phrase, c.a, c.k, h.n AS l, t.n AS r,
                ((1000000::HUGEINT * c.a * c.a) // (h.n::HUGEINT * t.n))::BIGINT AS score
            FROM cuts c
            JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.k], ' ')
            JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.k + 1:], ' ')
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inner_phrases AS (
            SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer
            FROM cuts WHERE len(w) = 3 AND k = 1
        ), most AS (
            SELECT lang, phrase, max(longer) AS longer FROM inner_phrases GROUP BY ALL
        ), ranked AS (
            SELECT x.*, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase) AS rank
            FROM lowest x LEFT JOIN most m ON m.lang = x.lang AND m.phrase = x.phrase
            WHERE m.longer IS NULL OR 100 * m.longer < 50 * x.a
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """
