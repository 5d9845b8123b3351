"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line of the text; long lines are cut behind sentence ends (or after `PIECE_MOST` characters). Each distinct
paragraph has a 60-bit digest, and a sketch of m cells holds, for the digests that hash to a cell (one cell in each of
three parts), their number, the xor of the digests and the xor of their checks. Subtracting the sketches of two versions
leaves the paragraphs that differ; a cell with a single one gives it away, taking it out of its other cells makes more such
cells, and so on until all cells are zero. If that does not succeed the sketch was too small, and larger ones are made: first one
whose cells grow with the number of paragraphs (in blocks of bounded size, so the work stays in proportion to the text),
then four times as many cells for a block that failed, then the plain difference of that block's digests.

The fingerprint is the smallest sketch as text. The likeness of two texts is `1 - d / (a + b)` with d differing paragraphs
of a and b. All of it is column expressions: no Python on the main path.

Defined results: null is the empty text; two texts without any paragraph are alike (1), one without and one with are not
(0). The next document is the one with the next doc_id, nulls first; texts under one doc_id follow each other by their hash, rows
repeated whole count once there and come out once each; a single document is its own next. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.positions import numbered
from kindred.runtime import stored

PARTS = 3
PIECE_LEAST = 40
PIECE_MOST = 100
PIECE = f"[^\\n]{{1,{PIECE_LEAST}}}[^\\n.!?]{{0,{PIECE_MOST - PIECE_LEAST}}}[.!?]*"
# Cells of each part: of the fingerprint, of a block, and of a block that is tried again.
SMALL, BLOCK, LARGE = 8, 12, 48
# Digests that a block is to hold, both versions counted.
BLOCK_DIGESTS = 12
ROUNDS = 6
# Multipliers of the hash functions; the first three choose cells.
FACTORS = (1103515245, 69069, 1664525)
BLOCK_FACTORS = (22695477, 134775813)
CHECK_FACTOR = 48271
NO_ID = -(2**63)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mix(digest: Column, factor: int) -> Column:
    """A number below 2**31 from a digest; nothing overflows."""
    return ((digest % F.lit(2147483647)) * F.lit(factor) + F.shiftright(digest, 31)) % F.lit(2147483629)


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    return F.array_distinct(
        F.transform(
            F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)),
            lambda p: F.conv(F.substring(F.md5(p), 1, 15), 16, 10).cast("bigint"),
        )
    )


def _item(digest: Column, sign: Column, cells: int) -> Column:
    """A digest with its sign, check and cells."""
    own = [
        (mix(digest, factor) % F.lit(cells) + F.lit(part * cells)).cast("int").alias(f"c{part}")
        for part, factor in enumerate(FACTORS)
    ]
    return F.struct(digest.alias("d"), sign.cast("bigint").alias("s"), mix(digest, CHECK_FACTOR).alias("k"), *own)


def _hits(item: Column, cell: Column) -> Column:
    return (item["c0"] == cell) | (item["c1"] == cell) | (item["c2"] == cell)


def _cell(count: Column, xor: Column, check: Column) -> Column:
    return F.struct(count.alias("n"), xor.alias("x"), check.alias("k"))


def sketch(items: Column, cells: int) -> Column:
    """The cells of items (see _item)."""
    zero = _cell(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))

    def filled(cell: Column) -> Column:
        return F.aggregate(
            F.filter(items, lambda i: _hits(i, cell)),
            zero,
            lambda a, i: _cell(a["n"] + i["s"], a["x"].bitwiseXOR(i["d"]), a["k"].bitwiseXOR(i["k"])),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(PARTS * cells - 1)), filled)


def minus(a: Column, b: Column) -> Column:
    """The sketch of what two sketches do not share."""
    return F.zip_with(
        a, b, lambda p, q: _cell(p["n"] - q["n"], p["x"].bitwiseXOR(q["x"]), p["k"].bitwiseXOR(q["k"]))
    )


def peeled(difference: Column, cells: int) -> Column:
    """Recovered digests of a difference sketch as (d, s) with the sign of their side; null if cells are left."""

    def single(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (mix(c["x"], CHECK_FACTOR) == c["k"])

    def round_of(state: Column, _: Column) -> Column:
        known = F.array_distinct(
            F.transform(F.filter(state["cells"], single), lambda c: _item(c["x"], c["n"], cells))
        )

        def after(found: Column) -> Column:
            left = F.transform(
                state["cells"],
                lambda c, at: F.aggregate(
                    F.filter(found, lambda i: _hits(i, at)),
                    c,
                    lambda a, i: _cell(a["n"] - i["s"], a["x"].bitwiseXOR(i["d"]), a["k"].bitwiseXOR(i["k"])),
                ),
            )
            signed = F.transform(found, lambda i: F.struct(i["d"].alias("d"), i["s"].alias("s")))
            # Without a single cell nothing changes any more.
            return F.when(F.size(found) == 0, state).otherwise(
                F.struct(left.alias("cells"), F.concat(state["found"], signed).alias("found"))
            )

        return let(known, after)

    start = F.struct(
        difference.alias("cells"), F.array().cast("array<struct<d:bigint,s:bigint>>").alias("found")
    )
    ended = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_of)
    return let(
        ended,
        lambda e: F.when(
            ~F.exists(e["cells"], lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["k"] != 0)), e["found"]
        ),
    )


def _block_difference(items: Column) -> Column:
    """Differing digests among the (d, s) items of one block."""

    def tried(cells: int) -> Column:
        own = F.transform(items, lambda i: _item(i["d"], i["s"], cells))
        return let(own, lambda o: peeled(sketch(o, cells), cells))

    plain = F.filter(
        items, lambda i: ~F.exists(items, lambda j: (j["d"] == i["d"]) & (j["s"] == -i["s"]))
    )
    return F.coalesce(tried(BLOCK), tried(LARGE), plain)


def _in_blocks(a: Column, b: Column) -> Column:
    """Differing digests of two sets, from sketches whose size goes with that of the sets."""

    def signed(values: Column, sign: int) -> Column:
        return F.transform(values, lambda d: F.struct(d.alias("d"), F.lit(sign).cast("bigint").alias("s")))

    items = F.concat(signed(a, 1), signed(b, -1))
    blocks = F.greatest(F.ceil(F.size(items) / F.lit(BLOCK_DIGESTS)), F.lit(1))
    outer = F.ceil(F.sqrt(blocks)).cast("int")

    # Digests are dealt out in two steps, so that the work does not grow with the square of their number.
    def share(values: Column, parts: Column, factor: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), parts - 1), lambda at: F.filter(values, lambda i: mix(i["d"], factor) % parts == at)
        )

    return let(
        F.struct(items.alias("items"), outer.alias("outer")),
        lambda v: F.flatten(
            F.transform(
                share(v["items"], v["outer"], BLOCK_FACTORS[0]),
                lambda some: F.flatten(
                    F.transform(share(some, v["outer"], BLOCK_FACTORS[1]), lambda block: _block_difference(block))
                ),
            )
        ),
    )


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Differing digests (d, s) of two sets with their fingerprint cells; s is 1 for those of the first only."""
    return F.coalesce(peeled(minus(cells_a, cells_b), SMALL), _in_blocks(a, b))


def fingerprint_cells(values: Column) -> Column:
    return let(F.transform(values, lambda d: _item(d, F.lit(1), SMALL)), lambda items: sketch(items, SMALL))


def as_text(cells: Column) -> Column:
    """Cells as `number:xor:check`, separated by commas."""
    return F.concat_ws(",", F.transform(cells, lambda c: F.concat_ws(":", *[c[f].cast("string") for f in "nxk"])))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(1.0 - F.size(difference(a, b, cells_a, cells_b)) / total)


def with_next(docs: DataFrame) -> DataFrame:
    """Every document with `prefix` (as much of the next one's start as the edit takes) and the next one's digests.

    Texts move once by their own key; the start and the digests of a text go on to the document before it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")
    )
    narrow = own.groupBy("id", "h").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("copies"))
    placed = stored(numbered(narrow, "id", "h"), "places")
    facts = placed.agg(F.count("*").alias("rows"), F.max("copies").alias("copies")).first()
    before = placed.select(
        F.col("id").alias("before_id"),
        F.col("h").alias("before_h"),
        F.floor(F.col("n") / 4).cast("int").alias("quarter"),
        ((F.col("position") + 1) % F.lit(max(facts["rows"], 1))).alias("position"),
    )
    order = placed.select("id", "h", "position").join(before, "position").drop("position")
    forward = own.join(order.hint("merge"), ["id", "h"]).select(
        F.col("before_id").alias("id"),
        F.col("before_h").alias("h"),
        F.substring(F.col("text"), F.lit(1), F.col("quarter")).alias("prefix"),
        digests(F.col("text")).alias("next_digests"),
    )
    if (facts["copies"] or 1) > 1:
        forward = forward.dropDuplicates(["id", "h"])
    return own.join(forward.hint("merge"), ["id", "h"])


def edited(text: Column, prefix: Column) -> Column:
    """The text whose last quarter is replaced by the prefix."""
    length = F.length(text)
    return F.concat(F.substring(text, F.lit(1), length - F.floor(length / 4).cast("int")), prefix)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses of every document."""
    paired = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("prefix")))
    sets = paired.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"),
        digests(F.col("edited")).alias("new"),
        F.col("next_digests").alias("next"),
    )
    cells = sets.select("*", *[fingerprint_cells(F.col(c)).alias(f"{c}_cells") for c in ("own", "new", "next")])
    return cells.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own_cells")).alias("fingerprint"),
        as_text(F.col("new_cells")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new"), F.col("own_cells"), F.col("new_cells")).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), F.col("own_cells"), F.col("next_cells")).alias("near_next"),
    )


def _sql_mix(digest: str, factor: int) -> str:
    return f"((({digest} % 2147483647) * {factor} + ({digest} >> 31)) % 2147483629)"


def sql() -> str:
    """The same for the table `documents` as DuckDB SQL, with plain set differences instead of peeling."""
    cells = " UNION ALL ".join(
        f"SELECT row, side, {_sql_mix('d', factor)} % {SMALL} + {part * SMALL} AS cell, d FROM sets"
        for part, factor in enumerate(FACTORS)
    )
    check = _sql_mix("d", CHECK_FACTOR)

    def differing(other: str) -> str:
        return f"""
            SELECT a.row, 1.0 - (len(a.ds) + len(b.ds) - 2 * len(list_intersect(a.ds, b.ds)))
                / nullif(len(a.ds) + len(b.ds), 0) AS near
            FROM lists a JOIN lists b ON a.row = b.row AND a.side = 'own' AND b.side = '{other}'
        """

    return f"""
        WITH base AS (
            SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, count(*) OVER () AS rows, doc_id,
                coalesce(text, '') AS text
            FROM documents
        ), pairs AS (
            SELECT a.row, a.doc_id, a.text, b.text AS next,
                substr(a.text, 1, length(a.text) - length(a.text) // 4) || substr(b.text, 1, length(a.text) // 4) AS edited
            FROM base a JOIN base b ON b.row = (a.row + 1) % a.rows
        ), sides AS (
            SELECT row, 'own' AS side, text FROM pairs UNION ALL SELECT row, 'new', edited FROM pairs
            UNION ALL SELECT row, 'next', next FROM pairs
        ), sets AS (
            SELECT DISTINCT row, side, ('0x' || substr(md5(p), 1, 15))::BIGINT AS d
            FROM (SELECT row, side, unnest(regexp_extract_all(text, '{PIECE}')) AS p FROM sides)
        ), lists AS (
            SELECT s.row, s.side, coalesce(ds, []::BIGINT[]) AS ds
            FROM sides s LEFT JOIN (SELECT row, side, list(d) AS ds FROM sets GROUP BY row, side) USING (row, side)
        ), cells AS (
            SELECT row, side, cell, count(*) AS n, bit_xor(d) AS x, bit_xor({check}) AS k FROM ({cells})
            GROUP BY row, side, cell
        ), texts AS (
            SELECT row, side, string_agg(coalesce(n, 0) || ':' || coalesce(x, 0) || ':' || coalesce(k, 0), ',' ORDER BY cell) AS t
            FROM (SELECT row, side, unnest(range({PARTS * SMALL})) AS cell FROM sides) LEFT JOIN cells USING (row, side, cell)
            GROUP BY row, side
        ), near_new AS ({differing("new")}), near_next AS ({differing("next")})
        SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, o.t AS fingerprint,
            e.t AS edited_fingerprint, coalesce(near_new.near, 1.0)::DOUBLE AS near_edited,
            coalesce(near_next.near, 1.0)::DOUBLE AS near_next
        FROM pairs JOIN texts o ON o.row = pairs.row AND o.side = 'own' JOIN texts e ON e.row = pairs.row AND e.side = 'new'
            JOIN near_new ON near_new.row = pairs.row JOIN near_next ON near_next.row = pairs.row
    """
