import random

import pytest

WORDS = {
    "en": "the of and to in that was with this from re tion ing er ndsh thble oned".split(),
    "de": "der die und ist mit den von sch ung keit heit zu ge ver tzpf ach lich".split(),
}


def prose(seed, words=80, lang="en"):
    draw = random.Random(seed)
    out = []
    for _ in range(words):
        out.append(draw.choice(WORDS[lang]) + draw.choice(["", draw.choice(WORDS[lang])]))
        if draw.random() < 0.1:
            out[-1] += "."
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents in two languages, some bad ones, copies, and every odd case; columns whose names clash with inner ones."""
    rows = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        text = prose(i, 60 + i, lang)
        if i % 5 == 4:
            text = " ".join(w.upper() + "!!###" for w in text.split())
        rows.append((i, text, lang))
    rows.append((120, rows[7][1], "en"))  # exact copy
    rows.append((121, rows[7][1], None))
    rows.append((122, rows[8][1] + " ending", "en"))  # near copy
    rows += [(123, None, "en"), (124, "", "en"), (125, " \t\n ", "en"), (126, "1 2 3 !", "en"), (127, "word", "en")]
    rows.append((128, "x" * 50_000, "en"))
    rows.append((129, prose(9, 20_000), "en"))
    rows.append((None, prose(1000), "en"))
    rows += [(130, prose(1001), "en")] * 2  # a row given twice
    rows.append((131, "same words " * 60, "en"))
    data = [(*r, r[1], 1, 0.5, 7, "k", "r") for r in rows]
    names = (
        "doc_id long, text string, lang string, source string, label int, score double, row long, key string, bucket string"
    )
    return spark.createDataFrame(data, names).repartition(3).cache()


@pytest.fixture(scope="session")
def marks(spark):
    """Labels: every fifth document is bad; repeated, null and unknown ids among them."""
    rows = [(i, 0 if i % 5 == 4 else 1, 1 if i % 17 == 0 else 0) for i in range(110)]
    rows += [(3, 1, 0), (None, 1, 0), (5, None, None), (9_999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
