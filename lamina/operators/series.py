"""Metric samples as a table: selectors, increases over ranges, and drift of a recent against a longer range.

A sample is (ts in epoch seconds, name, labels map<string, string>, value). Samples are first added up in steps, which
combines before the shuffle; every range is then a window over the steps of one label set, so one shuffle serves all ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def selected(samples: DataFrame, name: str, matchers: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Samples of a name whose labels match; a matcher is (label, '=', '!=', '=~' or '!~', value). A missing label is an empty text, patterns match whole values."""
    out = samples.filter(F.col("name") == name)
    for label, how, value in matchers:
        held = F.coalesce(F.try_element_at("labels", F.lit(label)), F.lit(""))
        same = held == value if how in ("=", "!=") else held.rlike(f"^(?:{value})$")
        out = out.filter(~same if how[0] == "!" else same)
    return out


def in_steps(samples: DataFrame, seconds: int, *labels: str) -> DataFrame:
    """Labels as columns, step, total and n of the samples in each step of so many seconds."""
    keys = [F.try_element_at("labels", F.lit(label)).alias(label) for label in labels]
    step = (F.floor(F.col("ts") / seconds) * seconds).cast("long").alias("step")
    return samples.groupBy(*keys, step).agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def over_ranges(steps: DataFrame, seconds: int, ranges: dict[str, int], *labels: str) -> DataFrame:
    """Steps with total_r and n_r for each range r: the sums of the steps that end with this one and span the range."""
    ordered = W.partitionBy(*labels).orderBy("step")
    sums = []
    for name, length in ranges.items():
        frame = ordered.rangeBetween(seconds - length, 0)
        sums += [F.sum("total").over(frame).alias(f"total_{name}"), F.sum("n").over(frame).alias(f"n_{name}")]
    return steps.select(*labels, "step", *sums)


def drift(ranged: DataFrame, recent: str, baseline: str, *labels: str) -> DataFrame:
    """How far the mean over a recent range is from that over a longer one: abs(1 - recent / baseline), null without a baseline."""
    mean = lambda r: F.try_divide(f"total_{r}", f"n_{r}")
    return ranged.select(*labels, "step", F.abs(1 - F.try_divide(mean(recent), mean(baseline))).alias("drift"))
