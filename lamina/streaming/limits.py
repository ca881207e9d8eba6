"""Stateful streams: rate limits, alert states, windowed counts and the alert log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamina.functions.sliding import SlidingLog


#: Seconds by which event times are moved: a watermark starts at zero, and what is not later than it counts as late.
ORIGIN = 1_000_000


def rate_limited(requests: DataFrame, client: str, at: str, event: str, window: float, most: int, late: str = "10 minutes") -> DataFrame:
    """client, event, allowed, retry_after of a stream of requests; the log of allowed times is the client's state.

    ``at`` are seconds. ``most`` times are kept a client. Within a micro-batch requests are taken in order of time and event.
    A client is forgotten when the watermark, ``late`` behind the newest request of all, has passed its last request by a window,
    so a stream that stalls forgets nobody. Requests behind the watermark are not answered.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = SlidingLog(window, most, state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values(["at", "event"], kind="stable")
        waits = rows["at"].map(log.wait)
        newest = max([float(rows["at"].max()), *log.admitted])
        state.update((list(log.admitted),))
        state.setTimeoutTimestamp(max(int((newest + window + ORIGIN) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"client": key[0], "event": rows["event"], "allowed": waits == 0, "retry_after": waits})

    rows = requests.select(F.col(client).alias("client"), F.col(at).alias("at"), F.col(event).alias("event"), F.timestamp_micros(((F.col(at) + ORIGIN) * 1_000_000).cast("long")).alias("__ts"))
    kinds = dict(rows.dtypes)
    return rows.withWatermark("__ts", late).groupBy("client").applyInPandasWithState(judge, f"client {kinds['client']}, event {kinds['event']}, allowed boolean, retry_after int", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def alert_states(evaluations: DataFrame, hold: int) -> DataFrame:
    """alertname, at, state of a stream of evaluations(alertname, at, active); the state is since when it is active, and the last evaluation.

    An evaluation that is older than one of an earlier micro-batch comes too late to be judged and is left out. One
    small state is kept for each alert name.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("at")[["at", "active"]]
        out = []
        for now, active in rows[rows["at"] >= last if last is not None else slice(None)].itertuples(index=False):
            since = (now if since is None else since) if active else None
            last = now
            out.append((key[0], now, "inactive" if since is None else "firing" if now - since >= hold else "pending"))
        state.update((since, last))
        yield pd.DataFrame(out, columns=["alertname", "at", "state"])

    return evaluations.select("alertname", "at", "active").groupBy("alertname").applyInPandasWithState(judge, "alertname string, at long, state string", "since long, last long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, late: str, window: str, *keys: str) -> DataFrame:
    """Events of each window and key; a window is final once the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), *keys, "n", "mean")


def log_alerts(alerts: DataFrame, folder: str, checkpoint: str):
    """Appends a stream of alerts as JSON lines, one sub-folder a batch, so a repeated batch overwrites itself."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/batch={number}")

    return alerts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True)
