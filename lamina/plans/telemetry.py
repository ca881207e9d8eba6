"""Queries over ``events`` as service telemetry: rates, histograms, drift, rules, alert states, limits."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lamina.functions import geometry, plates, statistics
from lamina.operators import monitoring, series
from lamina.session import table

BOUNDS = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0]
DAY = 86_400
RANGES = {"1h": 3600, "24h": DAY, "7d": 7 * DAY}


def metric_rate(spark, sf_dir):
    return monitoring.rates(table(spark, sf_dir, "events"), "ts", 900, "event_type").select("start", "event_type", "n", F.round("rate", 9).alias("rate"))


def status_by_label(spark, sf_dir):
    """Requests by type and status, the status told from the event."""
    status = F.when(F.col("event_type") == "error", "5xx").when(F.col("event_id") % 17 == 0, "429").otherwise("2xx")
    return table(spark, sf_dir, "events").groupBy("event_type", status.alias("status")).agg(F.count("*").alias("n"))


def hist_buckets(spark, sf_dir):
    return monitoring.cumulative_buckets(table(spark, sf_dir, "events"), "value", BOUNDS, "event_type")


def hist_quantile(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("day", monitoring.bucket_start(F.col("ts"), DAY))
    out = monitoring.bucket_quantiles(monitoring.cumulative_buckets(rows, "value", BOUNDS, "day"), 0.95, "day")
    return out.select("day", F.round("quantile", 9).alias("p95"))


def nearest_rank(spark, sf_dir):
    return monitoring.nearest_rank(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type")


def metrics_by_day(spark, sf_dir):
    """One wide row of metrics for each day; the baseline is all days up to it."""
    rows = table(spark, sf_dir, "events").withColumn("day", monitoring.bucket_start(F.col("ts"), DAY))
    per = rows.groupBy("day").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.max("value").alias("slowest"),
    )
    past = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)  # a row a day
    baseline = F.sum("cents").over(past) / F.sum("n").over(past)
    return per.select(
        F.col("day").alias("run"), F.col("n").cast("double").alias("predictions"), F.try_divide("ok", "n").alias("success_rate"), (F.col("errors") / DAY).alias("error_rate"),
        statistics.drift_ratio(F.col("cents") / F.col("n"), baseline).alias("brightness_drift"), F.col("slowest").alias("p95_latency"),
    )


METRICS_SQL = """
WITH per AS (
  SELECT floor(epoch_us(ts) / 86400000000)::BIGINT * 86400 AS day, count(*) AS n, count_if(event_type <> 'error') AS ok, count_if(event_type = 'error') AS errors,
    sum(round(value * 100)::BIGINT) AS cents, max(value) AS slowest FROM events GROUP BY 1),
metrics AS (
  SELECT day AS run, n::DOUBLE AS predictions, ok / n AS success_rate, errors / 86400 AS error_rate,
    abs(1 - (cents / n) / (sum(cents) OVER (ORDER BY day) / sum(n) OVER (ORDER BY day))) AS brightness_drift, slowest AS p95_latency FROM per)"""


def drift_ratio(spark, sf_dir):
    return metrics_by_day(spark, sf_dir).select("run", F.round("brightness_drift", 9).alias("drift"))


def success_rate_guarded(spark, sf_dir):
    """Success rate of each hour of each user group: null without judged traffic, silent below five requests."""
    rows = table(spark, sf_dir, "events").groupBy(monitoring.bucket_start(F.col("ts"), 3600).alias("start"), (F.col("user_id") % 4).alias("part")).agg(
        F.count_if(F.col("event_type").isin("purchase", "click")).alias("ok"), F.count_if(F.col("event_type").isin("purchase", "click", "error")).alias("judged"), F.count("*").alias("n"))
    rate = F.try_divide("ok", "judged")
    return rows.select("start", "part", "n", F.round(rate, 9).alias("rate"), F.coalesce((rate < 0.5) & (F.col("n") >= 5), F.lit(False)).alias("alarm"))


RULES = [
    ("success_rate", "<", 0.8, "drift", True), ("p95_latency", ">", 90.0, "performance", True), ("error_rate", ">", 0.0008, "performance", False), ("brightness_drift", ">", 0.05, "drift", True),
]


def violations(spark, sf_dir):
    return monitoring.rule_violations(metrics_by_day(spark, sf_dir), RULES, 20)


def evaluations(spark, sf_dir):
    """Four rules evaluated each hour: active where a type's hourly count is high."""
    rows = table(spark, sf_dir, "events").groupBy(monitoring.bucket_start(F.col("ts"), 3600).alias("at"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    name = F.concat(F.lit("High_"), F.col("event_type"))
    return rows.select("at", name.alias("alertname"), (F.col("top") > 20).alias("active"))


STATES_SQL = """
WITH ev AS (
  SELECT floor(epoch_us(ts) / 3600000000)::BIGINT * 3600 AS moment, 'High_' || event_type AS alertname, max(value) > 20 AS active FROM events GROUP BY 1, 2),
m AS (SELECT *, active AND NOT coalesce(lag(active) OVER w, FALSE) AS opens FROM ev WINDOW w AS (PARTITION BY alertname ORDER BY moment)),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY alertname ORDER BY moment) AS island FROM m),
s AS (SELECT *, CASE WHEN active THEN min(CASE WHEN active THEN moment END) OVER (PARTITION BY alertname, island) END AS since FROM g),
states AS (SELECT moment, alertname, active, since, CASE WHEN NOT active THEN 'inactive' WHEN moment - since >= 7200 THEN 'firing' ELSE 'pending' END AS state FROM s)"""


def alert_states(spark, sf_dir):
    return monitoring.alert_states(evaluations(spark, sf_dir), 7200, "alertname").select(F.col("at").alias("moment"), "alertname", "active", F.coalesce("since", F.lit(-1)).alias("since"), "state")


def firing(spark, sf_dir):
    severity = F.when(F.col("alertname") == "High_error", "critical").when(F.col("alertname") == "High_view", "info").otherwise("warning")
    rows = monitoring.alert_states(evaluations(spark, sf_dir), 7200, "alertname").filter("state = 'firing'")
    return rows.select("at", "alertname", severity.alias("severity"))


FIRING_SQL = STATES_SQL + """, firing AS (SELECT moment, alertname, CASE alertname WHEN 'High_error' THEN 'critical' WHEN 'High_view' THEN 'info' ELSE 'warning' END AS severity FROM states WHERE state = 'firing')"""


def alert_inhibit(spark, sf_dir):
    return monitoring.uninhibited(firing(spark, sf_dir), "High_error", ["warning", "info"]).withColumnRenamed("at", "moment")


def firing_count(spark, sf_dir):
    return firing(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("alertname").alias("alerts"))


def alert_notifications(spark, sf_dir):
    repeat = F.when(F.col("severity") == "critical", 3600).when(F.col("severity") == "info", 12 * 3600).otherwise(4 * 3600).cast("long")
    return monitoring.notifications(firing(spark, sf_dir), repeat, "alertname", "severity").withColumnRenamed("at", "moment")


def last_alerts(spark, sf_dir):
    """The 50 latest firing alerts as log lines."""
    line = plates.alert_line(F.lit("firing"), F.col("severity"), F.col("alertname"), F.lit("over its limit"))
    return firing(spark, sf_dir).orderBy(F.desc("at"), "alertname").limit(50).select(F.col("at").alias("moment"), line.alias("line"))


def rate_limit(spark, sf_dir):
    """Sliding log of each user: three events in a day."""
    rows = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id")
    return monitoring.rate_limited(rows, "user_id", "at", float(DAY), 3, "event_id").select("user_id", "event_id", "allowed", "retry_after")


def json_props(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("report"))


def prometheus_values(spark, sf_dir):
    """Answers of an instant query made of events, some empty, not a number, or failed, and their scalar."""
    value = F.when(F.col("event_id") % 11 == 0, "NaN").when(F.col("event_id") % 13 == 0, "oops").otherwise(F.col("value").cast("string"))
    answer = F.concat(F.lit('{"status":"'), F.when(F.col("event_type") == "error", "error").otherwise("success"), F.lit('","data":{"result":['), F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit('{"value":["1","'), value, F.lit('"]}'))), F.lit("]}}"))
    return table(spark, sf_dir, "events").select("event_id", monitoring.prometheus_value(answer).alias("scalar"))


def alert_flatten(spark, sf_dir):
    """Webhook payloads of two alerts for each tenth event, one without annotations and status."""
    body = F.concat(
        F.lit('{"status":"resolved","alerts":[{"status":"firing","labels":{"alertname":"'), F.col("event_type"), F.lit('","severity":"warning"},"annotations":{"summary":"v='), F.floor("value").cast("string"),
        F.lit('"},"startsAt":"'), F.col("user_id").cast("string"), F.lit('"},{"labels":{},"annotations":{}}]}'),
    )
    flat = monitoring.flattened_alerts(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body", "event_id")
    return flat.select("event_id", "status", "alertname", "severity", "summary", "starts_at", plates.alert_line(F.col("status"), F.col("severity"), F.col("alertname"), F.col("summary")).alias("line"))


def counter_increase(spark, sf_dir):
    """A counter of each user's events that restarts after every tenth."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return monitoring.counter_increase(table(spark, sf_dir, "events").select("user_id", "event_id", (n % 10).alias("v")), "v", "event_id", "user_id")


def exposition(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return monitoring.exposition(counts, "api_requests_total", "type", "event_type", "n")


def upload_checks(spark, sf_dir):
    """Uploads made of conversation turns: some empty, some broken, some too large."""
    data = F.when(F.col("turn") % 5 == 4, "").otherwise(F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", ""))
    sent = F.when(F.col("conv_id") % 9 == 0, F.concat(data, F.lit("!"))).otherwise(data)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", sent.alias("sent"))
    rows = rows.withColumn("status", monitoring.upload_status(F.col("text"), F.col("sent"), 300))
    decoded = F.when(F.col("status") == 200, F.length(F.unbase64("sent")))
    return rows.select("conv_id", "turn", "status", F.length("sent").alias("sent_length"), decoded.alias("image_bytes"))


def summary_text(spark, sf_dir):
    m = metrics_by_day(spark, sf_dir)
    return m.select("run", F.concat(F.lit("success_rate "), plates.shown(F.col("success_rate")), F.lit(" drift "), plates.shown(F.when(F.col("brightness_drift") > 0, F.col("brightness_drift")))).alias("summary"))


def weighted_median(spark, sf_dir):
    """Each user's weighted median of angles told from events; steep ones are dropped."""
    dx, dy = F.col("value") - 20, (F.col("event_id") % 41) - 20.0
    angle = geometry.folded_angle(dx, dy)
    rows = table(spark, sf_dir, "events").select("user_id", F.round(angle, 6).alias("value"), F.round(F.sqrt(dx * dx + dy * dy)).alias("weight")).filter("abs(value) <= 35")
    # One row for each angle first; the median is where the running weight reaches half, so no list of a user is held.
    steps = rows.groupBy("user_id", "value").agg(F.sum("weight").alias("weight"))
    user = W.partitionBy("user_id")
    run, whole = F.sum("weight").over(user.orderBy("value").rowsBetween(W.unboundedPreceding, 0)), F.sum("weight").over(user)
    reached = steps.select("user_id", "value", (run >= whole / 2).alias("reached")).filter("reached")
    return reached.groupBy("user_id").agg(F.min("value").alias("angle"))


def islands(spark, sf_dir):
    """Runs of successive days on which a user was active."""
    days = table(spark, sf_dir, "events").select("user_id", F.floor(monitoring.bucket_start(F.col("ts"), DAY) / DAY).cast("long").alias("day")).distinct()
    island = F.col("day") - F.row_number().over(W.partitionBy("user_id").orderBy("day"))
    return days.withColumn("island", island).groupBy("user_id", "island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days")).drop("island")


def simulator_stats(spark, sf_dir):
    """Status classes, matches and latency ranks of simulated requests by day."""
    rows = table(spark, sf_dir, "events").withColumn("day", monitoring.bucket_start(F.col("ts"), DAY))
    stats = rows.groupBy("day").agg(F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.get_json_object("props", "$.k").cast("int") < 50).alias("matches"))
    return stats.join(monitoring.nearest_rank(rows, "value", {"p50": 0.5, "p95": 0.95}, "day"), "day")


def samples(spark, sf_dir):
    """Events as metric samples: one request each, and its value in hundredths as brightness."""
    rows = table(spark, sf_dir, "events")
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("part"), (F.col("user_id") % 4).cast("string"))
    ts = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("ts")
    both = F.array(F.struct(F.lit("api_requests_total").alias("name"), F.lit(1).cast("long").alias("value")), F.struct(F.lit("brightness").alias("name"), F.round(F.col("value") * 100).cast("long").alias("value")))
    return rows.select(ts, labels.alias("labels"), F.explode(both).alias("s")).select("ts", "s.name", "labels", "s.value")


def range_increases(spark, sf_dir):
    """Requests but errors of two parts over 1 h, 24 h and 7 d, by type and hour."""
    chosen = series.selected(samples(spark, sf_dir), "api_requests_total", [("type", "!=", "error"), ("part", "=~", "0|2")])
    ranged = series.over_ranges(series.in_steps(chosen, 3600, "type"), 3600, RANGES, "type")
    return ranged.select("type", "step", *[F.col(f"total_{r}").alias(f"increase_{r}") for r in RANGES], F.round(F.col("total_24h") / RANGES["24h"], 9).alias("rate_24h"))


def window_drift(spark, sf_dir):
    """Brightness of the last hour against the last day, by part."""
    chosen = series.selected(samples(spark, sf_dir), "brightness", [("type", "!~", "err.*"), ("part", "!=", "3")])
    ranged = series.over_ranges(series.in_steps(chosen, 3600, "part"), 3600, RANGES, "part")
    return series.drift(ranged, "1h", "24h", "part").select("part", "step", F.round("drift", 9).alias("drift"))


def availability(spark, sf_dir):
    """Runs of every sixth hour with a probe, a health answer and a canary, told from the hour."""
    hour = F.floor(monitoring.bucket_start(F.col("ts"), 21_600) / 21_600).cast("long")
    runs = table(spark, sf_dir, "events").select(hour.alias("run")).distinct()
    by = lambda n: F.col("run") % n
    return monitoring.availability_violations(runs.select(
        "run", F.when(by(7) == 0, 0).when(by(5) != 0, 1).alias("api_up"), F.when(by(4) != 0, F.struct((by(6) != 1).alias("model_loaded"))).alias("health"),
        F.when(by(3) == 0, "error").when(by(3) == 1, "limited").alias("canary_status"), F.concat(F.lit("code "), by(10).cast("string")).alias("canary_detail"),
    ))


QUERIES = {
    f.__name__: f
    for f in (
        metric_rate, status_by_label, hist_buckets, hist_quantile, nearest_rank, drift_ratio, success_rate_guarded, violations, alert_states, alert_inhibit, firing_count, alert_notifications,
        last_alerts, rate_limit, json_props, prometheus_values, alert_flatten, counter_increase, exposition, upload_checks, summary_text, weighted_median, islands, simulator_stats, range_increases, window_drift, availability,
    )
}

_BUCKETS = ", ".join(f"count_if(value <= {b}) AS b{i}" for i, b in enumerate(BOUNDS))
_UNFOLDED = "unnest([" + ", ".join(f"{{'le': {b}::DOUBLE, 'n': b{i}}}" for i, b in enumerate(BOUNDS)) + ", {'le': NULL::DOUBLE, 'n': total}])"
ORACLES = {
    "metric_rate": "SELECT floor(epoch_us(ts) / 900000000)::BIGINT * 900 AS start, event_type, count(*) AS n, round(count(*) / 900, 9) AS rate FROM events GROUP BY 1, 2",
    "status_by_label": "SELECT event_type, CASE WHEN event_type = 'error' THEN '5xx' WHEN event_id % 17 = 0 THEN '429' ELSE '2xx' END AS status, count(*) AS n FROM events GROUP BY 1, 2",
    "hist_buckets": f"WITH w AS (SELECT event_type, {_BUCKETS}, count(*) AS total FROM events GROUP BY 1), u AS (SELECT event_type, {_UNFOLDED} AS b FROM w) SELECT event_type, b.le AS le, b.n::BIGINT AS n FROM u",
    "hist_quantile": f"""WITH w AS (SELECT floor(epoch_us(ts) / 86400000000)::BIGINT * 86400 AS day, {_BUCKETS}, count(*) AS total FROM events GROUP BY 1),
u AS (SELECT day, total, {_UNFOLDED} AS b FROM w), c AS (SELECT day, total, b.le AS le, b.n AS n FROM u WHERE b.le IS NOT NULL),
l AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS done FROM c WINDOW w AS (PARTITION BY day ORDER BY le)),
h AS (SELECT day, min_by(low + (le - low) * (0.95 * total - done) / (n - done), le) AS q FROM l WHERE n >= 0.95 * total GROUP BY day)
SELECT d.day, round(coalesce(q, {BOUNDS[-1]}), 9) AS p95 FROM (SELECT DISTINCT day FROM c) d LEFT JOIN h USING (day)""",
    "nearest_rank": "WITH r AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, v[floor(0.5 * len(v))::INT + 1] AS p50, v[floor(0.95 * len(v))::INT + 1] AS p95, len(v)::BIGINT AS n FROM r",
    "drift_ratio": METRICS_SQL + " SELECT run, round(brightness_drift, 9) AS drift FROM metrics",
    "success_rate_guarded": """WITH a AS (SELECT floor(epoch_us(ts) / 3600000000)::BIGINT * 3600 AS start, user_id % 4 AS part, count(*) AS n, count_if(event_type IN ('purchase', 'click')) AS ok,
  count_if(event_type IN ('purchase', 'click', 'error')) AS judged FROM events GROUP BY 1, 2)
SELECT start, part, n, round(ok / nullif(judged, 0), 9) AS rate, coalesce(ok / nullif(judged, 0) < 0.5 AND n >= 5, FALSE) AS alarm FROM a""",
    "violations": METRICS_SQL + """, rules AS (
SELECT run, predictions, 'success_rate' AS metric, success_rate AS value, 0.8 AS threshold, 'drift' AS kind FROM metrics WHERE success_rate < 0.8 AND predictions >= 20
UNION ALL SELECT run, predictions, 'p95_latency', p95_latency, 90.0, 'performance' FROM metrics WHERE p95_latency > 90 AND predictions >= 20
UNION ALL SELECT run, predictions, 'error_rate', error_rate, 0.0008, 'performance' FROM metrics WHERE error_rate > 0.0008
UNION ALL SELECT run, predictions, 'brightness_drift', brightness_drift, 0.05, 'drift' FROM metrics WHERE brightness_drift > 0.05 AND predictions >= 20)
SELECT run, metric, round_even(value, 4)::DOUBLE AS value, threshold::DOUBLE AS threshold, kind FROM rules""",
    "alert_states": STATES_SQL + " SELECT moment, alertname, active, coalesce(since, -1) AS since, state FROM states",
    "alert_inhibit": FIRING_SQL + " SELECT * FROM firing f WHERE severity NOT IN ('warning', 'info') OR NOT EXISTS (SELECT 1 FROM firing e WHERE e.alertname = 'High_error' AND e.moment = f.moment)",
    "firing_count": FIRING_SQL + " SELECT severity, count(*) AS n, count(DISTINCT alertname) AS alerts FROM firing GROUP BY 1",
    "alert_notifications": FIRING_SQL.replace("WITH ev", "WITH RECURSIVE ev") + """, f AS (SELECT *, CASE severity WHEN 'critical' THEN 3600 WHEN 'info' THEN 43200 ELSE 14400 END AS rep FROM firing),
sent AS (SELECT alertname, severity, rep, min(moment) AS moment FROM f GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT f.alertname, f.severity, f.rep, min(f.moment) AS moment FROM sent s JOIN f ON f.alertname = s.alertname AND f.moment >= s.moment + s.rep GROUP BY ALL))
SELECT alertname, severity, moment FROM sent""",
    "last_alerts": FIRING_SQL + " SELECT moment, '[FIRING] ' || severity || ' ' || alertname || ': over its limit' AS line FROM firing ORDER BY moment DESC, alertname LIMIT 50",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS moment, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS nth FROM events),
f AS (SELECT user_id, event_id, nth, TRUE AS allowed, 0 AS retry_after, [moment] AS log FROM e WHERE nth = 1
  UNION ALL SELECT user_id, event_id, nth, len(kept) < 3, CASE WHEN len(kept) < 3 THEN 0 ELSE greatest(1, floor(86400 - (moment - kept[1]))::INT + 1) END, CASE WHEN len(kept) < 3 THEN list_append(kept, moment) ELSE kept END
  FROM (SELECT e.user_id, e.event_id, e.nth, e.moment, list_filter(f.log, lambda t: e.moment - t < 86400) AS kept FROM f JOIN e ON e.user_id = f.user_id AND e.nth = f.nth + 1))
SELECT user_id, event_id, allowed, retry_after FROM f""",
    "json_props": """SELECT event_id, (props->>'$.k')::INT AS k, '{"k":' || (props->>'$.k') || ',"type":"' || event_type || '"}' AS report FROM events""",
    "prometheus_values": "SELECT event_id, CASE WHEN event_type <> 'error' AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 THEN value END AS scalar FROM events",
    "alert_flatten": """SELECT event_id, 'firing' AS status, event_type AS alertname, 'warning' AS severity, 'v=' || floor(value)::BIGINT AS summary, user_id::VARCHAR AS starts_at, '[FIRING] warning ' || event_type || ': v=' || floor(value)::BIGINT AS line FROM events
UNION ALL SELECT event_id, 'resolved', 'unknown', 'none', '', NULL, '[RESOLVED] none unknown: ' FROM events""",
    "counter_increase": """WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 10 AS v FROM events), l AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM c)
SELECT user_id, sum(CASE WHEN b IS NULL THEN 0 WHEN v < b THEN v ELSE v - b END)::BIGINT AS increase, count(*) AS samples FROM l GROUP BY 1""",
    "exposition": """SELECT 'api_requests_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""",
    "upload_checks": """WITH s AS (SELECT conv_id, turn, text, CASE WHEN turn % 5 = 4 THEN '' ELSE to_base64(encode(text)) END || CASE WHEN conv_id % 9 = 0 THEN '!' ELSE '' END AS sent FROM conversations),
c AS (SELECT *, CASE WHEN length(sent) = 0 THEN 400 WHEN floor(length(sent) * 3 / 4) > 300 THEN 413 WHEN NOT regexp_matches(sent, '^[A-Za-z0-9+/]*={0,2}$') OR length(sent) % 4 <> 0 THEN 400 ELSE 200 END::INT AS status FROM s)
SELECT conv_id, turn, status, length(sent)::INT AS sent_length, CASE WHEN status = 200 THEN octet_length(encode(text)) END::INT AS image_bytes FROM c""",
    "summary_text": METRICS_SQL + " SELECT run, 'success_rate ' || printf('%.4f', success_rate) || ' drift ' || CASE WHEN brightness_drift > 0 THEN printf('%.4f', brightness_drift) ELSE 'n/a' END AS summary FROM metrics",
    "weighted_median": """WITH a AS (SELECT user_id, value - 20 AS dx, (event_id % 41) - 20.0::DOUBLE AS dy FROM events), d AS (SELECT user_id, dx, dy, degrees(atan2(dy, dx)) AS g FROM a),
r AS (SELECT user_id, round(CASE WHEN g < -45 THEN g + 90 WHEN g > 45 THEN g - 90 ELSE g END, 6) AS v, round(sqrt(dx * dx + dy * dy)) AS w FROM d),
c AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY user_id) / 2 AS half FROM r WHERE abs(v) <= 35)
SELECT user_id, min(v) AS angle FROM c WHERE run >= half GROUP BY 1""",
    "islands": """WITH d AS (SELECT DISTINCT user_id, floor(epoch_us(ts) / 86400000000)::BIGINT AS day FROM events), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM d)
SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS days FROM i GROUP BY user_id, island""",
    "simulator_stats": """WITH r AS (SELECT floor(epoch_us(ts) / 86400000000)::BIGINT * 86400 AS day, count_if(event_type <> 'error')::BIGINT AS ok, count_if(event_type = 'error')::BIGINT AS failed,
  count_if((props->>'$.k')::INT < 50)::BIGINT AS matches, list_sort(list(value)) AS v FROM events GROUP BY 1)
SELECT day, ok, failed, matches, v[floor(0.5 * len(v))::INT + 1] AS p50, v[floor(0.95 * len(v))::INT + 1] AS p95, len(v)::BIGINT AS n FROM r""",
    "range_increases": """WITH s AS (SELECT event_type AS type, epoch_us(ts) // 3600000000 * 3600 AS step, count(*) AS n FROM events WHERE event_type <> 'error' AND user_id % 4 IN (0, 2) GROUP BY 1, 2)
SELECT type, step, sum(n) OVER (PARTITION BY type ORDER BY step RANGE BETWEEN 0 PRECEDING AND CURRENT ROW)::BIGINT AS increase_1h, sum(n) OVER d::BIGINT AS increase_24h,
  sum(n) OVER (PARTITION BY type ORDER BY step RANGE BETWEEN 601200 PRECEDING AND CURRENT ROW)::BIGINT AS increase_7d, round(sum(n) OVER d / 86400, 9) AS rate_24h
FROM s WINDOW d AS (PARTITION BY type ORDER BY step RANGE BETWEEN 82800 PRECEDING AND CURRENT ROW)""",
    "window_drift": """WITH s AS (SELECT (user_id % 4)::VARCHAR AS part, epoch_us(ts) // 3600000000 * 3600 AS step, sum(round(value * 100)::BIGINT) AS c, count(*) AS n FROM events WHERE NOT starts_with(event_type, 'err') AND user_id % 4 <> 3 GROUP BY 1, 2)
SELECT part, step, round(abs(1 - (c / n) / (sum(c) OVER d / sum(n) OVER d)), 9) AS drift FROM s WINDOW d AS (PARTITION BY part ORDER BY step RANGE BETWEEN 82800 PRECEDING AND CURRENT ROW)""",
    "availability": """WITH r AS (SELECT DISTINCT epoch_us(ts) // 21600000000 AS run FROM events)
SELECT run, 'api_up' AS metric, '0' AS value, '1' AS threshold, 'availability' AS kind FROM r WHERE run % 7 = 0
UNION ALL SELECT run, 'model_loaded', 'false', 'true', 'availability' FROM r WHERE run % 4 <> 0 AND run % 6 = 1
UNION ALL SELECT run, 'canary_prediction', 'code ' || run % 10, 'HTTP 200', 'availability' FROM r WHERE run % 3 = 0""",
}
