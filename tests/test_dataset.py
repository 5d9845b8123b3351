import json
from pathlib import Path

import pytest

from kindred.operators import dataset
from kindred.plans import checks
from kindred.sinks import files as file_sinks
from kindred.sources import images, labels

RECT = {"shape_type": "rectangle", "points": [[30.0, 40.0], [10.0, 20.0]]}
WIDE = {"shape_type": "rectangle", "points": [[-50.0, 0.0], [150.0, 300.0]]}
LINE = {"shape_type": "line", "points": [[0.0, 0.0], [1.0, 1.0]]}
FILES = {
    "[가방] a": (100, 100, [RECT, LINE, WIDE]),
    "[가방] no width": (0, 100, [RECT]),
    "[의류] only lines": (100, 100, [LINE]),
    "[모자] unknown": (100, 100, [RECT]),
    "plain +1%20": (100, 100, [RECT]),
    "[신발] no image": (100, 100, [RECT]),
}


def write_files(folder):
    for stem, (w, h, shapes) in FILES.items():
        with open(f"{folder}/{stem}.json", "w", encoding="utf-8") as f:
            json.dump({"imageWidth": w, "imageHeight": h, "shapes": shapes}, f, indent=2, ensure_ascii=False)
        if stem != "[신발] no image":
            Path(f"{folder}/{stem}.png").write_text("png")
    Path(f"{folder}/[가방] a.jpg").write_text("jpg")


def test_files_to_training_data(spark, tmp_path):
    write_files(tmp_path)
    labelme = labels.read_labelme(spark, f"{tmp_path}/*.json")
    assert {r["stem"] for r in labelme.collect()} == set(FILES)
    found = images.read_image_files(spark, str(tmp_path))
    assert found.count() == 12

    boxes = dataset.labelme_to_yolo(labelme).orderBy("stem", "position").collect()
    assert [(r["stem"], r["position"], r["cx"], r["cy"], r["w"], r["h"]) for r in boxes] == [
        ("[가방] a", 0, 0.2, 0.3, 0.2, 0.2),
        ("[가방] a", 1, 0.5, 1.0, 1.0, 1.0),
        ("[신발] no image", 0, 0.2, 0.3, 0.2, 0.2),
    ]

    rows = dataset.manifest(labelme, found.select("stem", "ext"))
    got = {r["stem"]: r for r in rows.collect()}
    assert set(got) == {"[가방] a", "[가방] no width", "[의류] only lines", "[신발] no image"}
    assert {s for s, r in got.items() if r["ok"]} == {"[가방] a"}
    assert got["[가방] a"]["ext"] == ".jpg" and got["[가방] no width"]["ext"] == ".png"
    assert got["[신발] no image"]["ext"] is None
    files = dataset.label_files(rows).collect()
    assert [tuple(r) for r in files] == [
        ("train", "bag_a", "0 0.200000 0.300000 0.200000 0.200000\n0 0.500000 1.000000 1.000000 1.000000")
    ]
    assert tuple(dataset.split_stats(labelme, rows).first()) == (1, 0, 3, 2)


def test_last_file_of_a_name_stands(spark):
    rows = spark.createDataFrame(
        [("[가방] a.b", "train", "bag_a_b", "first", True), ("[가방] a_b", "train", "bag_a_b", "second", True)],
        "stem string, split string, safe_name string, label_text string, ok boolean",
    )
    assert dataset.label_files(rows).first()["label_text"] == "second"


def test_split_is_exact_and_repeatable(spark):
    rows = [(f"[{k}] {i}", f"[{k}] {i}.json") for k, n in (("가방", 101), ("신발", 4), ("의류", 10)) for i in range(n)]
    labelme = spark.createDataFrame(rows, "stem string, file_name string")
    first = dataset.stratified_split(labelme).collect()
    val = [r for r in first if r["split"] == "val"]
    assert {c: sum(r["class_id"] == c for r in val) for c in (0, 3, 4)} == {0: 20, 3: 0, 4: 2}
    again = dataset.stratified_split(labelme.repartition(7)).collect()
    assert {tuple(r) for r in first} == {tuple(r) for r in again}
    other = dataset.stratified_split(labelme, seed=1).collect()
    assert {tuple(r) for r in first} != {tuple(r) for r in other}


def test_label_lines_and_counts(spark, tmp_path):
    for kind, split, name, text in [
        ("labels", "train", "a.txt", "0 0.1 0.1 0.1 0.1\n2 0.1 0.1 0.1 0.1\n"),
        ("labels", "val", "b.txt", "0  0.1 0.1 0.1 0.1\n\n"),
        ("images", "train", "a.jpg", "x"),
        ("images", "train", "c.jpg", "x"),
        ("images", "val", "b.jpg", "x"),
    ]:
        folder = tmp_path / kind / split
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    lines = labels.read_label_lines(spark, f"{tmp_path}/labels/*")
    assert {(r["split"], r["class_id"]) for r in lines.collect()} == {("train", 0), ("train", 2), ("val", 0)}
    got = {r["class"]: r["labels"] for r in dataset.class_distribution(lines).collect()}
    assert got == {"bag": 2, "sunglass": 0, "food": 1, "shoes": 0, "clothes": 0}
    counts = dataset.split_file_counts(labels.read_split_files(spark, str(tmp_path))).collect()
    assert {(r["split"], r["kind"]): r["files"] for r in counts} == {
        ("train", "images"): 2, ("train", "labels"): 1, ("val", "images"): 1, ("val", "labels"): 1
    }


def test_image_match_prefers_jpg(spark):
    stems = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    found = spark.createDataFrame(
        [("a", ".png"), ("a", ".jpg"), ("b", ".png"), ("c", ".gif")], "stem string, ext string"
    )
    got = {r["stem"]: r["ext"] for r in dataset.label_image_match(stems, found).collect()}
    assert got == {"a": ".jpg", "b": ".png", "c": None}


def test_a_file_for_each_row_and_nothing_beside_it(spark, tmp_path):
    rows = [("a b", ), ("a b", ), ("가방\r", ), ("", ), (None, )]
    file_sinks.write_each(spark.createDataFrame(rows, "value string"), f"{tmp_path}/new folder+%20")
    found = [p for p in (tmp_path / "new folder+%20").iterdir()]
    assert sorted(p.read_bytes().decode() for p in found) == sorted(f"{v or ''}\n" for (v,) in rows)
    assert all(p.suffix == ".txt" and not p.name.startswith((".", "_")) for p in found)
    file_sinks.write_each(spark.createDataFrame([], "value string"), f"{tmp_path}/none")
    assert images.read_image_files(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", ["split_file_counts", "scan_image_files", "scan_labelme"])
def test_file_queries_make_one_file_a_row(spark, tmp_path, monkeypatch, name):
    rows = [(i, f"Supplier {i}", i % 25, float(i % 3)) for i in range(60)] + [(60, None, 3, None)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(
        f"{tmp_path}/supplier.parquet"
    )
    monkeypatch.setattr(checks, "fresh_path", lambda spark, of: f"{tmp_path}/made/{of}")
    found = checks.all_queries()[name](spark, str(tmp_path)).collect()
    # No checksum file beside any of them: a file and its permissions are made once.
    made = [p for p in (tmp_path / "made").rglob("*") if p.is_file()]
    assert len(made) == {"split_file_counts": 61 + 40, "scan_image_files": 61, "scan_labelme": 61}[name]
    if name == "scan_labelme":
        assert sorted(r["y1"] for r in found) == [float(i) for i in range(61)]
    else:
        assert sum(r["files"] for r in found) == len(made)
