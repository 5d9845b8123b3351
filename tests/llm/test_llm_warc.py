import hashlib

from llm_corpus import corpus  # noqa: F401

from kindred.llm import licenses, warc

LONG = "<html>" + "z" * 200


def pages(spark):
    rows = [(i, f"http://host/{i}", f"<html>{i} " + "a" * (i * 7)) for i in range(60)]
    rows += [(100 + i, "http://copy/", LONG) for i in range(40)]
    rows += [(201, "u", None), (202, None, "é"), (203, "u", "é"), (None, "x y", LONG), (None, "x", "n" * 150), (60, "a", "q" * 99)]
    rows += [(61, "b", "q" * 99), (62, "c", "r" * 100), (62, "c", "r" * 100), (63, "d", "r" * 100)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(4)


def test_round_trip(spark):
    given = pages(spark)
    firsts = {}
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in given.collect()]
    for page, payload in rows:
        if len(payload) >= 100 and page is not None:
            firsts[payload] = min(page, firsts.get(payload, page))
    expected = []
    for page, payload in rows:
        first = firsts.get(payload)
        again = len(payload) >= 100 and first is not None and first != page
        kind = "revisit" if again else "response"
        expected.append((page, len(payload), hashlib.sha256(payload).hexdigest(), kind, first if again else None))
    found = [tuple(r) for r in warc.round_trip(given).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_same_pages_same_files_and_rolling(spark, tmp_path):
    manifests = []
    for at, given in enumerate((pages(spark), pages(spark).repartition(7))):
        listed = warc.write(given, f"file://{tmp_path}/{at}", roll_bytes=2000, shard_rows=25).collect()
        manifests.append(sorted(tuple(r) for r in listed))
    assert manifests[0] == manifests[1]
    assert len(manifests[0]) > 4
    assert all(size < 2000 + 1000 for _, _, size, _ in manifests[0])
    assert sum(n for _, n, _, _ in manifests[0]) == pages(spark).count()


def test_files_outside_the_manifest_are_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    warc.write(pages(spark), folder)
    count = warc.read(spark, folder).count()
    (tmp_path / "a" / "pages-999999-00000.warc.gz").write_bytes(b"half a file")
    assert warc.read(spark, folder).count() == count == pages(spark).count()


def test_empty_table(spark):
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_licences(spark, corpus):
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore", "MIT"),
        (2, "intro words. Licensed under the Apache License, Version 2.0. The end", "Apache-2.0"),
        (3, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3", "GPL-3.0"),
        (4, "licensed under cc by-nc 4.0!", "CC-BY-NC-4.0"),
        (5, "we license nothing under the sun", None),
        (6, None, None),
        (7, "", None),
    ]
    frame = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, license string, dice double")
    found = licenses.scan(frame)
    assert {r["doc_id"]: r["license"] for r in found.collect()} == {r[0]: r[2] for r in rows}
    plan = found._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert licenses.scan(corpus).count() == corpus.count()
    assert licenses.scan(corpus.limit(0)).count() == 0


def test_size_bounds_lose_no_match():
    for count in range(1, 40):
        low, high = licenses.sizes_within(count, 0.8)
        for other in range(1, 80):
            reachable = 2 * min(count, other) / (count + other) >= 0.8
            assert reachable == (low <= other <= high)


def test_folders_have_the_scheme_that_spark_gives_them(spark, tmp_path):
    assert warc.qualified(spark, f"{tmp_path}/a") == f"file://{tmp_path}/a"
    assert warc.qualified(spark, f"file:{tmp_path}/a") == f"file://{tmp_path}/a"
    # Another default file system: a path without a scheme lies there, as Spark's own tables do.
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    before = settings.get("fs.defaultFS")
    settings.set("fs.defaultFS", "viewfs://store/")
    settings.set("fs.viewfs.mounttable.store.link./shared", f"file://{tmp_path}")
    try:
        assert warc.qualified(spark, "/shared/a").startswith("viewfs://store")
    finally:
        settings.set("fs.defaultFS", before)
