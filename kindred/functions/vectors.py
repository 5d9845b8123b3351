"""Vectors, bits and pixels as column expressions; sums are double."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.constants import (
    BGR_MEAN,
    NORM_ADDEND,
    NORM_FLOOR,
    RGB_MEAN,
    RGB_STD,
    STAGE_WEIGHTS,
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where body uses it inside an array lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def positions(length: Column) -> Column:
    """0 .. length-1; empty for length 0, where sequence would count down."""
    return F.when(length > 0, F.sequence(F.lit(0), length.cast("int") - 1)).otherwise(
        F.array().cast("array<int>")
    )


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit_vector(v: Column, mode: str = "floor") -> Column:
    """v over its norm. mode "floor" bounds the norm from below, "add" adds to it."""
    if mode not in ("floor", "add"):
        raise ValueError(f"mode must be 'floor' or 'add', not {mode!r}")
    length = norm(v)
    divisor = F.greatest(length, F.lit(NORM_FLOOR)) if mode == "floor" else length + NORM_ADDEND
    return bound(divisor, lambda d: F.transform(v, lambda x: x.cast("double") / d))


def channel_means(values: Column, channels: int, layout: str = "HWC") -> Column:
    """Mean of each channel of a flat feature map."""
    if layout not in ("HWC", "CHW"):
        raise ValueError(f"layout must be 'HWC' or 'CHW', not {layout!r}")

    def means(flat: Column) -> Column:
        area = (F.size(flat) / channels).cast("int")

        def one(channel: Column) -> Column:
            if layout == "CHW":
                picked = F.slice(flat, channel * area + 1, area)
            else:
                picked = F.transform(positions(area), lambda p: F.get(flat, p * channels + channel))
            return total(picked) / area

        return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), one)

    return bound(values, means)


def top_channels(means: Column, k: int) -> Column:
    """Indices of the k highest means, highest first, lower index first among equals."""
    keyed = F.transform(
        means, lambda x, i: F.struct((-x.cast("double")).alias("key"), i.cast("int").alias("channel"))
    )
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["channel"]), 1, k)


def stage_slices(v: Column, sizes: Sequence[int]) -> list[Column]:
    """Consecutive parts of v with the given lengths."""
    starts = [sum(sizes[:i]) + 1 for i in range(len(sizes))]
    return [F.slice(v, start, size) for start, size in zip(starts, sizes)]


def stage_signature(stages: Sequence[Column], weights: Sequence[float] = tuple(STAGE_WEIGHTS)) -> Column:
    """Pooled stage vectors made unit length, weighted and joined."""
    if len(stages) != len(weights):
        raise ValueError("one weight per stage")

    def scaled(stage: Column, weight: float) -> Column:
        return F.transform(unit_vector(stage, "add"), lambda x: x * weight)

    return F.concat(*[scaled(s, w) for s, w in zip(stages, weights)])


def binarize(v: Column) -> Column:
    """1 where a value reaches the mean of the nonzero values; that mean is 0 when all are zero."""
    mean = bound(
        F.filter(v, lambda x: x != 0),
        lambda nz: F.when(F.size(nz) > 0, total(nz) / F.size(nz)).otherwise(F.lit(0.0)),
    )
    return bound(mean, lambda m: F.transform(v, lambda x: (x.cast("double") >= m).cast("int")))


def _bit_text(bits: Column, width: int) -> Column:
    """Bits as a text of 0 and 1, padded with 0 on the right to a multiple of width."""
    padded = (F.ceil(F.size(bits) / width) * width).cast("int")
    return F.rpad(F.array_join(bits.cast("array<string>"), ""), padded, "0")


def _pieces(bits: Column, width: int, convert: Callable[[Column], Column]) -> Column:
    return bound(
        _bit_text(bits, width),
        lambda text: F.transform(
            positions(F.length(text) / width),
            lambda i: convert(F.substr(text, i * width + 1, F.lit(width))),
        ),
    )


def packed_bytes(bits: Column) -> Column:
    """Bits packed eight to a byte as numbers 0..255, first bit highest, zero padded."""
    return _pieces(bits, 8, lambda piece: F.conv(piece, 2, 10).cast("int"))


def pack_bits(bits: Column) -> Column:
    """Bits packed eight to a byte, first bit highest, zero padded, as binary."""
    digits = F.transform(packed_bytes(bits), lambda b: F.lpad(F.hex(b), 2, "0"))
    return F.unhex(F.array_join(digits, ""))


def bit_words(bits: Column) -> Column:
    """Bits as 32-bit words held in bigint, so that none is negative."""
    return _pieces(bits, 32, lambda piece: F.conv(piece, 2, 10).cast("bigint"))


def words_of_signature(signature: Column) -> Column:
    """32-bit words of a packed binary signature, zero padded at the end."""
    return bound(
        F.hex(signature),
        lambda text: F.transform(
            positions(F.ceil(F.length(text) / 8)),
            lambda i: F.conv(F.rpad(F.substr(text, i * 8 + 1, F.lit(8)), 8, "0"), 16, 10).cast("bigint"),
        ),
    )


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two word arrays."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n
    )


def _literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def channel_standardize(pixels: Column) -> Column:
    """RGB pixels 0..255 in HWC order, standardised by channel, in CHW order."""

    def converted(flat: Column) -> Column:
        area = (F.size(flat) / 3).cast("int")

        def one(i: Column) -> Column:
            channel = F.floor(i / area).cast("int")
            value = F.get(flat, (i - channel * area) * 3 + channel).cast("double") / 255
            return (value - F.get(_literal(RGB_MEAN), channel)) / F.get(_literal(RGB_STD), channel)

        return F.transform(positions(F.size(flat)), one)

    return bound(pixels, converted)


def channel_center_bgr(pixels: Column) -> Column:
    """RGB pixels in HWC order turned to BGR, channel means subtracted."""

    def converted(flat: Column) -> Column:
        def one(i: Column) -> Column:
            channel = F.pmod(i, F.lit(3))
            return F.get(flat, i - channel + 2 - channel).cast("double") - F.get(_literal(BGR_MEAN), channel)

        return F.transform(positions(F.size(flat)), one)

    return bound(pixels, converted)
