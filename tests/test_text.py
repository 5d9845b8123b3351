import pytest
from pyspark.sql import functions as F

from kindred.functions import text

S = F.col("s")


@pytest.mark.parametrize(
    "url, category",
    [
        ("/upload/가방/x.jpg", "bag"),
        ("upload/의류/x.jpg/", "clothes"),
        ("/upload/bag/x.jpg", None),
        ("가방", None),
        ("", None),
        ("/가방/신발", "shoes"),
        ("//upload//가방/x.jpg", None),
    ],
)
def test_category_from_url(one, url, category):
    assert one(text.category_from_url(S), "s string", url) == category


def test_url_to_english_replaces_everywhere(one):
    assert one(text.url_to_english(S), "s string", "/upload/가방/가방_신발.jpg") == "/upload/bag/bag_shoes.jpg"


@pytest.mark.parametrize(
    "url, path",
    [
        ("/upload/가방/x.jpg", "/img/bag/x.jpg"),
        ("/upload//upload/x.jpg", "/img/x.jpg"),
        ("//식음료/x.jpg", "/img/food/x.jpg"),
    ],
)
def test_resolve_path(one, url, path):
    assert one(text.resolve_path(S, "/img"), "s string", url) == path
    assert one(text.resolve_path(S, "/img/"), "s string", url) == path


@pytest.mark.parametrize(
    "query_id, category",
    [("bag_00", "bag"), ("sunglass_12", "sunglass"), ("bag00", None), ("bags_1", None), ("_bag_1", None)],
)
def test_category_from_query_id(one, query_id, category):
    assert one(text.category_from_query_id(S), "s string", query_id) == category


@pytest.mark.parametrize(
    "name, class_id",
    [
        ("[가방] a 1.json", 0),
        ("[ 의류\t] a.json", 4),
        ("[의류", None),
        ("x [가방] a.json", None),
        ("[모자] a.json", None),
        ("[] a.json", None),
    ],
)
def test_class_id_from_file_name(one, name, class_id):
    assert one(text.class_id_from_file_name(S), "s string", name) == class_id


@pytest.mark.parametrize(
    "stem, name",
    [
        ("[가방] 빨간 bag (1)", "bag_빨간_bag__1_"),
        ("[가방] a] b-c", "bag_b-c"),
        ("no bracket", "bag_no_bracket"),
    ],
)
def test_safe_name(one, stem, name):
    assert one(text.safe_name(F.lit("bag"), S), "s string", stem) == name


def test_class_name(one):
    assert one(text.class_name(F.col("i"), "unknown"), "i int", 4) == "clothes"
    assert one(text.class_name(F.col("i"), "unknown"), "i int", 5) == "unknown"
    assert one(text.class_name(F.col("i")), "i int", 5) is None


def test_formats(one):
    assert one(text.query_id(F.lit("bag"), F.col("i")), "i int", 7) == "bag_07"
    assert one(text.query_id(F.lit("bag"), F.col("i")), "i int", 123) == "bag_123"
    assert one(text.similarity_percent(F.col("x")), "x double", 0.98765) == "98.8%"
    line = text.label_line(F.lit(2), *[F.lit(v) for v in (0.5, 0.25, 1.0, 1 / 3)])
    assert one(line, "i int", 0) == "2 0.500000 0.250000 1.000000 0.333333"
