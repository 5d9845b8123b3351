"""The recorded evaluation: 50 queries, whose summary is known."""

from kindred.operators import evaluation

# category: (query number, hit, retrieved, relevant)
RECORDED = {
    "bag": [(0, 7, 10, 20), (39, 9, 10, 20), (4, 4, 10, 19), (35, 4, 10, 19), (17, 2, 10, 18),
            (6, 6, 10, 16), (23, 2, 10, 16), (31, 0, 9, 16), (9, 6, 10, 15), (18, 1, 10, 15)],
    "sunglass": [(1, 2, 10, 20), (5, 6, 10, 20), (7, 8, 10, 20), (12, 6, 10, 20), (38, 1, 10, 20),
                 (37, 5, 10, 20), (36, 4, 10, 20), (34, 1, 10, 20), (10, 1, 10, 19), (28, 1, 10, 19)],
    "food": [(6, 3, 10, 20), (15, 9, 10, 20), (35, 2, 10, 19), (38, 0, 10, 19), (5, 5, 10, 18),
             (22, 0, 10, 17), (29, 3, 10, 17), (4, 3, 10, 16), (8, 5, 10, 16), (19, 5, 10, 16)],
    "shoes": [(5, 2, 10, 20), (17, 5, 10, 20), (19, 3, 10, 20), (35, 2, 10, 20), (31, 2, 10, 20),
              (0, 0, 10, 19), (37, 7, 10, 19), (3, 2, 10, 18), (39, 2, 10, 18), (28, 0, 9, 18)],
    "clothes": [(7, 7, 10, 20), (8, 6, 10, 20), (34, 1, 10, 20), (37, 1, 10, 20), (38, 7, 10, 20),
                (3, 8, 10, 19), (6, 3, 10, 19), (12, 7, 10, 19), (15, 6, 10, 19), (20, 6, 10, 19)],
}
SUMMARY = {
    "bag": (10, 0.41, 0.23),
    "sunglass": (10, 0.35, 0.176),
    "food": (10, 0.35, 0.197),
    "shoes": (10, 0.25, 0.129),
    "clothes": (10, 0.52, 0.268),
}


def test_recorded_counts_give_the_recorded_summary(spark):
    rows = [(c, f"{c}_{i:02d}", h, ret, rel) for c, qs in RECORDED.items() for i, h, ret, rel in qs]
    counts = spark.createDataFrame(
        rows, "category string, query_id string, hit bigint, retrieved bigint, relevant bigint"
    )
    evaluated = evaluation.with_ratios(counts)
    first = evaluated.filter("query_id = 'bag_00'").first()
    assert (first["precision"], first["recall"]) == (0.7, 0.35)
    got = {r["category"]: tuple(r)[1:] for r in evaluation.summary(evaluated).collect()}
    assert got == SUMMARY


def test_pairs_reproduce_the_counts(spark):
    retrieved, relevant = [], []
    for c, queries in RECORDED.items():
        for i, hit, ret, rel in queries:
            query = f"{c}_{i:02d}"
            retrieved += [(query, f"r{j}") for j in range(ret)]
            relevant += [(query, f"r{j}") for j in range(hit)] + [(query, f"x{j}") for j in range(rel - hit)]
    shape = "query_id string, image_uuid string"
    got = evaluation.per_query(
        spark.createDataFrame(retrieved + retrieved[:5], shape), spark.createDataFrame(relevant, shape)
    )
    expected = {f"{c}_{i:02d}": (h, ret, rel) for c, qs in RECORDED.items() for i, h, ret, rel in qs}
    assert {r["query_id"]: (r["hit"], r["retrieved"], r["relevant"]) for r in got.collect()} == expected


def test_query_without_retrieval_counts_zero(spark):
    shape = "query_id string, image_uuid string"
    got = evaluation.per_query(spark.createDataFrame([("a", "1")], shape), spark.createDataFrame([("b", "1")], shape))
    assert {tuple(r) for r in got.collect()} == {("a", 0, 1, 0, 0.0, 0.0), ("b", 0, 0, 1, 0.0, 0.0)}


def test_reviewed_precision_and_comparison(spark):
    shape = "run string, query_id string, selected_image_ids array<string>, total_results int"
    rows = [
        ("a", "bag_00", ["1", "2"], 10),
        ("a", "bag_01", [], 9),
        ("b", "bag_00", ["2", "3", "4"], 10),
        ("b", "clothes_06", ["1"], 8),
    ]
    runs = spark.createDataFrame(rows, shape)
    got = {(r["run"], r["category"]): (r["query_count"], r["precision"]) for r in evaluation.reviewed_precision(runs).collect()}
    assert got == {("a", "bag"): (2, 0.1), ("b", "bag"): (1, 0.3), ("b", "clothes"): (1, 0.125)}
    compared = evaluation.compare_reviews(runs.filter("run = 'a'"), runs.filter("run = 'b'"))
    assert {tuple(r) for r in compared.collect()} == {
        ("bag_00", True, True, 1, 1, 2),
        ("bag_01", True, False, 0, 0, 0),
        ("clothes_06", False, True, 0, 0, 1),
    }
