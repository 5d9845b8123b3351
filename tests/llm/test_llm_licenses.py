"""Licence scans of hand-made texts, against the same rule in SQL."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from kindred.llm import licenses

REST = " and many other words that say nothing of the kind " * 5


def texts():
    mit, gpl = licenses.TEMPLATES[5][1], licenses.TEMPLATES[11][1]
    rows = [
        (f"{REST}\nLicensed under the Apache License,\nVersion 2.0\n{REST}", "Apache-2.0", "Apache-2.0"),
        (f"{REST} which is, as told, licensed under the MIT License {REST}", "MIT", None),
        (REST, None, ""),
        ("", None, ""),
        (None, None, ""),
        ("word", None, ""),
        ("license", None, ""),
        (REST + mit.replace(" copy", "\ncopy") + REST, "MIT", "MIT"),
        (f"{REST}. {gpl}. All rights\nreserved. {REST}", "GPL-3.0", None),
        # A passage does not hide a wrapped notice beside it.
        (f"All rights reserved\n{REST} Licensed under the Apache License,\nVersion 2.0 {REST}", "Apache-2.0", "Apache-2.0,proprietary"),
        (f"{gpl}\n{REST}\nReleased under the MIT License", "MIT", None),
        ("Released under the MIT License " * 30, "MIT", None),
        ("license licensed licenses " * 200, None, ""),
    ]
    rows += [(f"{REST}\n{text}\n{REST}", name, None) for name, text in licenses.TEMPLATES]
    rows += [(f"{REST} {text.upper()[:-1].replace(' ', chr(10), 5)} {REST}", None, None) for _, text in licenses.TEMPLATES]
    return rows


def test_equal_to_sql_and_to_what_was_planted(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 1.0, 3) for i, (t, *_) in enumerate(rows)], "doc_id long, text string, near string, dice double, n int")
    found = {r["doc_id"]: r for r in licenses.scan(docs.repartition(3)).collect()}
    connection = duckdb.connect()
    connection.register("documents", pa.table({"doc_id": list(range(len(rows))), "text": [t for t, *_ in rows]}))
    expected = connection.sql(licenses.sql())
    assert sorted(tuple(found[i]) for i in found) == sorted(expected.project("doc_id, license, dice, licenses, n_passages").fetchall())
    for i, (_, name, listed) in enumerate(rows):
        if i < 13 or name:
            assert found[i]["license"] == name, (i, found[i])
        if listed is not None:
            assert found[i]["licenses"] == listed, (i, found[i])


def test_no_signal_is_missing(spark):
    for least in (0.6, 0.8, 0.95, 1.0):
        known = [(name, licenses.template_bigrams(text)) for name, text in licenses.TEMPLATES]
        signals = set(licenses.signal_bigrams(known, least))
        for _, pairs in known:
            # Whatever is left of a template when as much is taken as may lack, it has a signal.
            assert len(set(pairs) - signals) < licenses.fewest_shared(len(pairs), least)
    texts = spark.createDataFrame([(f"x {a},\n{b}. y",) for a, b in map(str.split, licenses.signal_bigrams(known, 0.8))], "t string")
    assert texts.filter(licenses.has_signal(F.col("t"), licenses.signal_bigrams(known, 0.8))).count() == texts.count()


def test_empty_table_and_other_templates(spark):
    shape = "doc_id long, text string"
    assert licenses.scan(spark.createDataFrame([], shape)).count() == 0
    own = [("a", "one two three four"), ("b", "one two three four")]
    docs = spark.createDataFrame([(1, "zero one two three four five"), (1, "zero one two three four five")], shape)
    got = licenses.scan(docs, templates=own).collect()
    # Equally near templates: the first is named.
    assert [(r["license"], r["dice"], r["licenses"]) for r in got] == [("a", 1.0, "a,b")] * 2
