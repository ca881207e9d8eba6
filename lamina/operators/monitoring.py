"""Service telemetry: windowed rates, histograms, drift, rules, alert states and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from lamina.functions import statistics
from lamina.functions.sliding import SlidingLog
from lamina.operators import ranks


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the fixed window that a time falls into, as epoch seconds."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)).cast("long") * seconds


def rates(events: DataFrame, ts: str, seconds: int, *keys: str) -> DataFrame:
    """Events and events per second of each window and key."""
    out = events.groupBy(bucket_start(F.col(ts), seconds).alias("start"), *keys).agg(F.count("*").alias("n"))
    return out.withColumn("rate", F.col("n") / seconds)


def cumulative_buckets(values: DataFrame, value: str, bounds: list[float], *keys: str) -> DataFrame:
    """Keys, le (null: open) and the number of values up to it: one pass, one row of counters a key, then unfolded."""
    counters = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = values.groupBy(*keys).agg(*counters, F.count("*").alias("all"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))
    return wide.select(*keys, F.explode(rows).alias("b")).select(*keys, "b.le", "b.n")


def bucket_quantiles(buckets: DataFrame, q: float, *keys: str) -> DataFrame:
    return buckets.groupBy(*keys).agg(F.collect_list(F.struct("le", "n")).alias("b")).select(*keys, statistics.bucket_quantile(q, F.col("b")).alias("quantile"))


def nearest_rank(values: DataFrame, value: str, qs: dict[str, float], *keys: str) -> DataFrame:
    """The values at place floor(q n) of each key's ordered values, by rank and not by interpolation.

    Equal values are counted first and places come from running counts in two levels, so neither a frequent value nor a
    frequent key has to fit one task.
    """
    counted = values.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    placed = ranks.running(counted, list(keys), [F.col(value)], "__n")
    place = lambda q: F.floor(F.lit(q) * F.col("__total"))
    holds = lambda q: (place(q) < F.col("__end")) & (place(q) >= F.col("__end") - F.col("__n"))
    return placed.groupBy(*keys).agg(*[F.max(F.when(holds(q), F.col(value))).alias(name) for name, q in qs.items()], F.max("__total").alias("n"))


def counter_increase(samples: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """Increase of a counter over its samples; a fall is a restart, whose value counts whole."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    step = F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return samples.withColumn("step", step).groupBy(*keys).agg(F.sum("step").alias("increase"), F.count("*").alias("samples"))


def rule_violations(metrics: DataFrame, rules: list[tuple[str, str, float, str, bool]], least: float) -> DataFrame:
    """run, metric, value, threshold, kind of broken rules over one wide row of metrics a run.

    A rule is (metric, '<' or '>', threshold, kind, needs volume); nulls break none, and rules that need
    volume are silent below ``least`` predictions.
    """
    enough = F.coalesce("predictions", F.lit(0.0)) >= least
    checks = []
    for metric, side, threshold, kind, volume in rules:
        value = F.col(metric)
        broken = (value < threshold if side == "<" else value > threshold) & (enough if volume else F.lit(True))
        checks.append(F.when(broken, F.struct(F.lit(metric).alias("metric"), F.bround(value, 4).cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"), F.lit(kind).alias("kind"))))
    found = metrics.select("run", F.explode(F.array_compact(F.array(*checks))).alias("v"))
    return found.select("run", "v.*")


def alert_states(evaluations: DataFrame, hold: int, *keys: str) -> DataFrame:
    """evaluations(at, active) with state: pending until a run of active evaluations is ``hold`` seconds old, then firing."""
    w = W.partitionBy(*keys).orderBy("at")
    started = F.when(F.col("active") & ~F.coalesce(F.lag("active").over(w), F.lit(False)), F.col("at"))
    since = F.last(started, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = evaluations.withColumn("since", F.when(F.col("active"), since))
    return out.withColumn("state", F.when(~F.col("active"), "inactive").when(F.col("at") - F.col("since") >= hold, "firing").otherwise("pending"))


def uninhibited(alerts: DataFrame, source: str, targets: list[str]) -> DataFrame:
    """Alerts(at, alertname, severity) less those of a target severity while the source alert fires; no severity is no target."""
    firing = alerts.filter(F.col("alertname") == source).select("at").distinct()
    target = F.coalesce(F.col("severity").isin(targets), F.lit(False))
    targeted, others = alerts.filter(target), alerts.filter(~target)
    return targeted.join(firing, "at", "left_anti").unionByName(others)


def notifications(firing: DataFrame, repeat: Column, *keys: str) -> DataFrame:
    """firing(at) with sent: the first of a group, then whenever ``repeat`` seconds have passed since the last one sent.

    Rows are sorted within tasks and read once; a task remembers one time, whatever the length of a group.
    """
    rows = firing.select(*keys, "at", repeat.cast("long").alias("__repeat"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = last = None
        for batch in batches:
            sent = []
            for *own, at, wait in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                due = own != group or at >= last + wait
                group, last = own, at if due else last
                sent.append(due)
            yield batch.select([*keys, "at"]).filter(pa.array(sent, pa.bool_()))

    return rows.mapInArrow(run, rows.select(*keys, "at").schema)


def rate_limited(requests: DataFrame, client: str, at: str, window: float, most: int, *keep: str) -> DataFrame:
    """requests with allowed and retry_after of a sliding log per client.

    The log is greedy: refused requests are not recorded, so only the last ``most`` allowed times matter. Requests are
    sorted within tasks by client and time and read once, so a client of any length costs a task ``most`` times of memory.
    """
    rows = requests.select(client, F.col(at).cast("double").alias(at), *keep)
    rows = rows.repartition(client).sortWithinPartitions(client, at, *keep)
    schema = T.StructType([*rows.schema, T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, whose = SlidingLog(window, most), None
        for batch in batches:
            waits = []
            for name, now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != whose:
                    log, whose = SlidingLog(window, most), name
                waits.append(log.wait(now))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([not w for w in waits], pa.bool_()), pa.array(waits, pa.int32())], schema.names)

    return rows.mapInArrow(run, schema)


def exposition(counts: DataFrame, metric: str, label: str, column: str, value: str) -> DataFrame:
    """One line of the text format for each value of the column that gives the label."""
    return counts.select(F.format_string("%s{%s=\"%s\"} %d", F.lit(metric), F.lit(label), F.col(column), F.col(value)).alias("line"))


def prometheus_value(payload: Column) -> Column:
    """The scalar of an instant query's answer; null where there is none, NaN or infinite."""
    schema = "status string, data struct<result array<struct<value array<string>>>>"
    parsed = F.from_json(payload, schema)
    value = F.get(F.get(parsed["data"]["result"], 0)["value"], 1).try_cast("double")
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when((parsed["status"] == "success") & finite, value)


def flattened_alerts(payloads: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row an alert of a webhook payload, with the defaults of missing parts."""
    schema = "status string, alerts array<struct<status string, labels map<string,string>, annotations map<string,string>, startsAt string, endsAt string>>"
    rows = payloads.select(*keep, F.from_json(column, schema).alias("p")).select(*keep, F.col("p.status").alias("outer"), F.explode("p.alerts").alias("a"))
    part = lambda m, k, default: F.coalesce(F.try_element_at(F.col(f"a.{m}"), F.lit(k)), F.lit(default))
    return rows.select(*keep, F.coalesce("a.status", "outer", F.lit("unknown")).alias("status"), part("labels", "alertname", "unknown").alias("alertname"), part("labels", "severity", "none").alias("severity"), part("annotations", "summary", "").alias("summary"), F.col("a.startsAt").alias("starts_at"), F.col("a.endsAt").alias("ends_at"))


def upload_status(data: Column, encoded: Column, most: int) -> Column:
    """HTTP status of a base64 upload: 400 empty or not base64, 413 too large, else 200."""
    shape = encoded.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(encoded) % 4 == 0)
    return F.when(F.coalesce(F.length(encoded), F.lit(0)) == 0, 400).when(F.floor(F.length(encoded) * 3 / 4) > most, 413).when(~shape, 400).otherwise(200)


def availability_violations(runs: DataFrame) -> DataFrame:
    """run, metric, value, threshold, kind of runs(run, api_up, health, canary_status, canary_detail) that show a service not available.

    ``health`` is a struct with model_loaded, null where nothing answered; a canary that was merely limited breaks no rule.
    """
    row = lambda metric, value, threshold: F.struct(F.lit(metric).alias("metric"), value.alias("value"), F.lit(threshold).alias("threshold"))
    checks = F.array(
        F.when(F.col("api_up") == 0, row("api_up", F.lit("0"), "1")),
        F.when(F.col("health").isNotNull() & ~F.coalesce("health.model_loaded", F.lit(False)), row("model_loaded", F.lit("false"), "true")),
        F.when(F.col("canary_status") == "error", row("canary_prediction", F.col("canary_detail"), "HTTP 200")),
    )
    return runs.select("run", F.explode(F.array_compact(checks)).alias("v")).select("run", "v.*", F.lit("availability").alias("kind"))
