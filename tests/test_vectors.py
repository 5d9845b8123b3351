import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import codes, vectors

V = F.col("v")
ARRAY = "v array<float>"


def test_unit_vector(one):
    assert one(vectors.unit_vector(V), ARRAY, [3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(vectors.unit_vector(V), ARRAY, [0.0, 0.0]) == [0.0, 0.0]
    assert one(vectors.unit_vector(V, "add"), ARRAY, [3.0, 4.0]) == pytest.approx([3 / (5 + 1e-8), 4 / (5 + 1e-8)])
    with pytest.raises(ValueError):
        vectors.unit_vector(V, "other")


def test_dot_sums_in_double(one):
    assert one(vectors.dot(V, V), ARRAY, [1e8, 1.0]) == 1e16 + 1


def test_channel_means(one):
    fmap = [1.0, 10.0, 2.0, 20.0, 3.0, 30.0, 4.0, 40.0]  # 2 x 2 x 2
    assert one(vectors.channel_means(V, 2), ARRAY, fmap) == [2.5, 25.0]
    assert one(vectors.channel_means(V, 2, "CHW"), ARRAY, fmap) == [8.25, 19.25]


def test_top_channels_prefers_the_lower_index(one):
    assert one(vectors.top_channels(V, 3), ARRAY, [1.0, 5.0, 5.0, 0.0, 2.0]) == [1, 2, 4]
    assert one(vectors.top_channels(V, 9), ARRAY, [1.0, 2.0]) == [1, 0]


def test_stage_signature(one):
    stages = vectors.stage_slices(V, [2, 1])
    got = one(vectors.stage_signature(stages, [0.5, 2.0]), ARRAY, [3.0, 4.0, 7.0])
    assert got == pytest.approx([0.3, 0.4, 2.0], abs=1e-7)
    with pytest.raises(ValueError):
        vectors.stage_signature(stages, [1.0])


@pytest.mark.parametrize(
    "values, bits",
    [
        ([0.0, 1.0, 3.0], [0, 0, 1]),
        ([0.0, 2.0, 2.0], [0, 1, 1]),
        ([0.0, 0.0, 0.0], [1, 1, 1]),
        ([-1.0, 0.0, -3.0], [1, 1, 0]),
    ],
)
def test_binarize(one, values, bits):
    assert one(vectors.binarize(V), ARRAY, values) == bits


@pytest.mark.parametrize("length", [1, 8, 9, 31, 32, 33, 64, 100])
def test_bits_pack_like_numpy(one, length):
    bits = np.random.default_rng(length).integers(0, 2, length).tolist()
    packed = np.packbits(np.array(bits, dtype=np.uint8))
    schema = "v array<int>"
    assert one(vectors.packed_bytes(V), schema, bits) == packed.tolist()
    assert bytes(one(vectors.pack_bits(V), schema, bits)) == packed.tobytes()
    padded = packed.tobytes() + bytes(-len(packed) % 4)
    words = np.frombuffer(padded, dtype=">u4").tolist()
    assert one(vectors.bit_words(V), schema, bits) == words
    assert one(vectors.words_of_signature(vectors.pack_bits(V)), schema, bits) == words


def test_no_bits(one):
    assert one(vectors.bit_words(V), "v array<int>", []) == []
    assert bytes(one(vectors.pack_bits(V), "v array<int>", [])) == b""


def test_hamming_uses_the_high_bit(one):
    assert one(vectors.hamming(F.col("a"), F.col("b")), "a array<bigint>, b array<bigint>", [2**32 - 1, 1], [0, 3]) == 33


def test_pixels(one):
    pixels = [0.0, 255.0, 0.0, 255.0, 0.0, 255.0, 51.0, 102.0, 153.0, 0.0, 0.0, 0.0]  # 2 x 2 x 3
    chw = np.array(pixels).reshape(2, 2, 3).transpose(2, 0, 1) / 255
    mean, std = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
    expected = (chw - mean.reshape(3, 1, 1)) / std.reshape(3, 1, 1)
    assert one(vectors.channel_standardize(V), ARRAY, pixels) == pytest.approx(expected.ravel().tolist())
    bgr = np.array(pixels).reshape(-1, 3)[:, ::-1] - np.array([103.939, 116.779, 123.68])
    assert one(vectors.channel_center_bgr(V), ARRAY, pixels) == pytest.approx(bgr.ravel().tolist())


def test_float16_round_trip(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=1280).astype(np.float32).tolist()) for i in range(5)] + [(5, None), (6, [])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    out = df.select("id", "v", codes.float16_encode("v").alias("c")).withColumn("back", codes.float16_decode("c"))
    for row in out.collect():
        if row["v"] is None:
            assert row["c"] is None and row["back"] is None
            continue
        expected = np.array(row["v"], dtype=np.float32).astype(np.float16)
        assert bytes(row["c"]) == expected.tobytes()
        assert row["back"] == expected.astype(np.float32).tolist()


def test_base64_is_one_line(one):
    code = bytes(range(256)) * 2
    text = one(codes.base64_text(F.col("c")), "c binary", bytearray(code))
    assert "\r" not in text and "\n" not in text
    assert bytes(one(codes.base64_code(F.col("t")), "t string", text)) == code
    assert one(codes.base64_text(F.col("c")), "c binary", None) == ""


def test_int_list_text(one):
    assert one(codes.int_list_text(V), "v array<int>", [3, 1, 2]) == "[3, 1, 2]"
    assert one(codes.int_list(F.col("t")), "t string", "[3, 1, 2]") == [3, 1, 2]
    assert one(codes.int_list_text(V), "v array<int>", []) == "[]"


def test_norm_floor_keeps_tiny_vectors_small(one):
    got = one(vectors.unit_vector(V), "v array<double>", [1e-13, 0.0])
    assert math.isclose(got[0], 0.1)
