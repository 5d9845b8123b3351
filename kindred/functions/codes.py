"""Codes at the file edge: float16 bytes, base64 text, integer lists as text."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


@F.arrow_udf(T.BinaryType())
def float16_encode(v: pa.Array) -> pa.Array:
    """Float vectors as float16 bytes; null stays null."""
    counts = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    halves = v.flatten().to_numpy(zero_copy_only=False).astype(np.float16)
    offsets = _offsets(counts * 2)
    valid = v.is_valid()
    bits = None if v.null_count == 0 else valid.buffers()[1]
    return pa.Array.from_buffers(
        pa.binary(), len(v), [bits, pa.py_buffer(offsets.tobytes()), pa.py_buffer(halves.tobytes())]
    )


@F.arrow_udf(T.ArrayType(T.FloatType()))
def float16_decode(codes: pa.Array) -> pa.Array:
    """Float16 bytes as float vectors; null stays null."""
    counts = pc.fill_null(pc.binary_length(codes), 0).to_numpy(zero_copy_only=False)
    start = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + 1] if len(codes) else [0]
    raw = codes.buffers()[2]
    # A null takes no bytes, so the values of all rows lie one after the other.
    data = np.frombuffer(raw, np.uint8)[int(start[0]) : int(start[0]) + int(counts.sum())] if raw else np.zeros(0, np.uint8)
    values = data.view(np.float16).astype(np.float32)
    offsets = pa.array(_offsets(counts.astype(np.int64) // 2))
    mask = None if codes.null_count == 0 else codes.is_null()
    return pa.ListArray.from_arrays(offsets, pa.array(values), mask=mask)


def base64_text(code: Column) -> Column:
    """Base64 in one line; an absent code is the empty text."""
    return F.coalesce(F.replace(F.base64(code), F.lit("\r\n"), F.lit("")), F.lit(""))


def base64_code(text: Column) -> Column:
    return F.unbase64(text)


def int_list_text(values: Column) -> Column:
    """[1, 2, 3] with a blank after each comma."""
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))


def int_list(text: Column) -> Column:
    return F.from_json(text, "array<int>")
