import heapq
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lamina.functions import statistics
from lamina.operators import learning, monitoring, series


def answer(*values, status="success"):
    return json.dumps({"status": status, "data": {"result": [{"value": [0, v]} for v in values]}})


def test_prometheus_value(spark):
    wanted = {answer("0.125"): 0.125, answer("-3", "8"): -3.0, answer(): None, answer("nan"): None, answer("-Infinity"): None, answer("7", status="failed"): None, answer("seven"): None, "no json": None}
    rows = spark.createDataFrame([(body,) for body in wanted], "b string").select("b", monitoring.prometheus_value(F.col("b")).alias("v"))
    assert {r["b"]: r["v"] for r in rows.collect()} == wanted


RULES = [("yield", "<", 0.25, "quality", True), ("wait", ">", 12.0, "speed", True), ("faults", ">", 3.0, "health", False)]
#: predictions, yield, wait, faults -> broken rules
RUNS = {
    "on the limits": ((20.0, 0.25, 12.0, 3.0), ""), "all beyond": ((21.0, 0.2, 12.5, 4.0), "faults wait yield"), "too few": ((19.0, 0.0, 99.0, 3.5), "faults"),
    "nothing known": ((None, None, None, None), ""), "no volume": ((None, 0.0, 50.0, 9.0), "faults"),
}


def test_rules(spark):
    rows = spark.createDataFrame([(name, *row) for name, (row, _) in RUNS.items()], "run string, predictions double, yield double, wait double, faults double")
    found = {name: [] for name in RUNS}
    for r in monitoring.rule_violations(rows, RULES, 20).collect():
        found[r["run"]].append(r["metric"])
    assert {name: " ".join(sorted(v)) for name, v in found.items()} == {name: broken for name, (_, broken) in RUNS.items()}


def test_alert_waits_for_its_hold(spark):
    rows = spark.createDataFrame([(t, t not in (0, 30)) for t in range(0, 70, 10)], "at long, active boolean").withColumn("k", F.lit("a"))
    got = [r["state"] for r in monitoring.alert_states(rows, 20, "k").orderBy("at").collect()]
    assert got == ["inactive", "pending", "pending", "inactive", "pending", "pending", "firing"]


def test_rate_limit_is_greedy(spark):
    """Against seats that are taken for a window: who finds one free is let in, others wait for the next that is given back."""
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 1600) / 4, i) for i in range(300)]
    expected = {}
    for client in "ab":
        seats = [-math.inf] * 5  # when each is free again
        for _, now, i in sorted((r for r in rows if r[0] == client), key=lambda r: r[1:]):
            soonest = heapq.heappop(seats)
            expected[i] = (True, 0) if soonest <= now else (False, max(1, math.floor(soonest - now) + 1))
            heapq.heappush(seats, now + 60 if soonest <= now else soonest)
    out = monitoring.rate_limited(spark.createDataFrame(rows, "client string, at double, i long"), "client", "at", 60.0, 5, "i").collect()
    assert {r["i"]: (r["allowed"], r["retry_after"]) for r in out} == expected
    assert monitoring.rate_limited(spark.createDataFrame([], "client string, at double, i long"), "client", "at", 60.0, 5, "i").count() == 0


def test_bucket_quantile(spark):
    rows = spark.createDataFrame([("a", v) for v in (0.5, 1.5, 1.5, 9.0)] + [("b", 50.0)], "k string, v double")
    buckets = monitoring.cumulative_buckets(rows, "v", [1.0, 2.0], "k")
    got = {r["k"]: r["quantile"] for r in monitoring.bucket_quantiles(buckets, 0.5, "k").collect()}
    assert got == {"a": 1.5, "b": 2.0}


def test_promotion(spark):
    """Versions of one name in turn: a gate of 0.8, and no worse than the champion so far."""
    steps = [(0.79, False), (0.8, True), (0.95, True), (0.9, False), (0.95, True), (0.2, False)]
    rows = spark.createDataFrame([("m", i, a) for i, (a, _) in enumerate(steps)], "name string, version long, accuracy double")
    assert [r["promoted"] for r in learning.promotions(rows, 0.8).orderBy("version").collect()] == [p for _, p in steps]


def test_gate_fails_the_job(spark):
    rows = spark.createDataFrame([(False,)], "passed boolean")
    with pytest.raises(Exception, match="too few classes"):
        learning.require(rows, "passed", "too few classes").collect()


def test_wilson_of_nothing_is_null(spark):
    assert spark.range(1).select(statistics.wilson(F.lit(0), F.lit(0)).alias("w")).first()["w"] is None


def test_alert_flattening_defaults(spark):
    body = '{"alerts":[{"status":"firing","labels":{"alertname":"APIDown","severity":"critical"},"annotations":{"summary":"down"}},{"labels":{}}]}'
    rows = monitoring.flattened_alerts(spark.createDataFrame([(body,)], "b string"), "b").collect()
    assert [(r["status"], r["alertname"], r["severity"], r["summary"]) for r in rows] == [("firing", "APIDown", "critical", "down"), ("unknown", "unknown", "none", "")]


def test_selectors_match_whole_labels(spark):
    rows = spark.createDataFrame([(1, "m", {"a": "xy"}), (2, "m", {"a": "x"}), (3, "m", {}), (4, "n", {"a": "x"})], "ts long, name string, labels map<string,string>").withColumn("value", F.col("ts"))
    ask = lambda *m: sorted(r["ts"] for r in series.selected(rows, "m", list(m)).collect())
    assert ask() == [1, 2, 3] and ask(("a", "=", "x")) == [2] and ask(("a", "!=", "x")) == [1, 3] and ask(("a", "=~", "x|z")) == [2] and ask(("a", "!~", "x.")) == [2, 3] and ask(("a", "=", "")) == [3]


def test_notifications_repeat(spark):
    rows = spark.createDataFrame([(k, t) for k, ts in {"a": [0, 5, 10, 21, 40], "b": [3, 4]}.items() for t in ts], "k string, at long")
    assert sorted(map(tuple, monitoring.notifications(rows, F.lit(20), "k").collect())) == [("a", 0), ("a", 21), ("b", 3)]
