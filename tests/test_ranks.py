from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lamina.operators import learning, monitoring, ranks


def test_running_counts_of_a_frequent_and_a_null_key(spark):
    """Places are those of a plain sort, with a key that holds most rows, a null key and descending order."""
    made = [(None if i % 11 == 0 else ("hot" if i % 3 else "cold"), i * 7919 % 1009, i) for i in range(1200)]
    rows = spark.createDataFrame(made, "k string, v long, id long")
    got = {r["id"]: (r["__end"], r["__total"]) for r in ranks.running(rows, ["k"], [F.desc("v"), F.col("id")]).collect()}
    groups = defaultdict(list)
    for k, v, i in made:
        groups[k].append((-v, i))
    wanted = {i: (nth, len(g)) for g in groups.values() for nth, (_, i) in enumerate(sorted(g), 1)}
    assert got == wanted


def test_nearest_rank_with_one_value_for_most_rows(spark):
    values = [5.0] * 700 + [float(i) for i in range(300)] + [None] * 3
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 2.5)], "k string, v double")
    got = {r["k"]: (r["p50"], r["p95"], r["n"]) for r in monitoring.nearest_rank(rows, "v", {"p50": 0.5, "p95": 0.95}, "k").collect()}
    ordered = sorted(values, key=lambda v: float("-inf") if v is None else v)
    assert got == {"a": (ordered[501], ordered[952], 1003), "b": (2.5, 2.5, 1)}


def test_folds_splits_and_first_of_class(spark):
    rows = spark.createDataFrame([(i, "x" if i < 90 else "y" if i < 99 else "z") for i in range(100)], "id long, c string")
    folds = learning.stratified_folds(rows, "c", [F.col("id")], 3)
    assert {(r["c"], r["fold"]): r["count"] for r in folds.groupBy("c", "fold").count().collect()} == {**{("x", f): 30 for f in range(3)}, **{("y", f): 3 for f in range(3)}, ("z", 0): 1}
    tested = {r["id"] for r in learning.stratified_split(rows, "c", [F.col("id")]).filter("is_test").collect()}
    assert tested == {i for i in range(90) if i / 89 > 0.8} | {90 + i for i in range(9) if i / 8 > 0.8}
    kept = {r["id"] for r in learning.first_of_class(rows, "c", [F.col("id")], 4).filter("kept").collect()}
    assert kept == {0, 1, 2, 3, 90, 91, 92, 93, 99} == {r["id"] for r in learning.top_of_class(rows, "c", [F.col("id")], 4).collect()}


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "id long, c string, v double")
    assert learning.stratified_folds(rows, "c", [F.col("id")], 3).count() == 0
    assert monitoring.nearest_rank(rows, "v", {"p50": 0.5}, "c").count() == 0


def test_queries_in_blocks_find_what_broadcast_ones_find(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 4, (150, 3)).astype(float)  # small whole numbers, so many ties
    rows = spark.createDataFrame([(i, p.tolist(), i % 5) for i, p in enumerate(points)], "id long, v array<double>, label int")
    found = lambda: {(r["query"], r["nth"], r["id"], r["distance"], r["label"]) for r in learning.nearest(rows, rows.filter("id % 4 = 0"), "id", "v", "label").collect()}
    at_once = found()
    monkeypatch.setattr(learning, "QUERIES_AT_ONCE", 10)
    monkeypatch.setattr(learning, "ROWS_AT_ONCE", 40)
    assert found() == at_once
    for query in range(0, 150, 4):
        order = sorted((((points[i] - points[query]) ** 2).sum(), i) for i in range(150) if i != query)[:5]
        assert [i for _, i in order] == [i for q, _, i, *_ in sorted(at_once) if q == query]
