"""Nested reports, and neighbours kept by task whatever the size of its batches."""

import json

import numpy as np

from lamina.operators import evaluation, learning


def test_confusion_of_similar_characters_is_nested(spark):
    rates = spark.createDataFrame([("8", "B", 0.25, 1, 4), ("B", "8", 0.0, 0, 2), ("0", "O", 0.5, 2, 4), ("0", "8", 0.25, 1, 4), ("Q", "O", 0.0, 0, 0)], "truth string, guess string, rate double, n long, total long")
    report = json.loads(evaluation.nested_confusion(rates, {"eight": "8B", "round": "0OQ", "none": "XY"}).first()["report"])
    assert report == {
        "eight": {"8->B": {"confusion_rate": 0.25, "count": 1, "total": 4}, "B->8": {"confusion_rate": 0.0, "count": 0, "total": 2}},
        "round": {"0->O": {"confusion_rate": 0.5, "count": 2, "total": 4}},
        "none": {},
    }
    empty = evaluation.nested_confusion(rates.limit(0), {"eight": "8B"}).first()["report"]
    assert json.loads(empty) == {"eight": {}}


def test_neighbours_do_not_depend_on_batches(spark):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 4, (300, 3)).astype(float)
    rows = spark.createDataFrame([(i, p.tolist(), i % 5) for i, p in enumerate(points)], "id long, v array<double>, label int").repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        found = learning.nearest(rows, rows.filter("id % 20 = 0"), "id", "v", "label", 4).collect()
    finally:
        spark.conf.set(name, before)
    for q in range(0, 300, 20):
        distance = ((points - points[q]) ** 2).sum(1)
        expected = sorted((d, i) for i, d in enumerate(distance) if i != q)[:4]
        assert sorted((r["distance"], r["id"]) for r in found if r["query"] == q) == expected
