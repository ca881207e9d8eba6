"""Running sums and ranks within keys of any size, in two levels.

Rows are dealt to tasks by ranges of (keys, order), so a key that holds a third of the rows is spread over a third of the
tasks. A task adds up within its range; what lies before a range is a sum over one row for each key and range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lamina.session import cut_lineage


def running(rows: DataFrame, keys: list[str], order: list[Column], weight: str | None = None) -> DataFrame:
    """``rows`` with __end, the sum of ``weight`` (else the number of rows) up to and with a row in its key's order, and __total, the key's sum.

    The order should tell the rows of a key apart, as equal ones meet in one task. A null key is a key. Ranges come from
    a sample that a second run need not repeat, so rows are written once, with their range, before both levels read them.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(rows.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()))
    amount = F.sum(weight) if weight else F.count("*")
    names = [f"__key{i}" for i in range(len(keys))]
    sums = dealt.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("__range").alias("__at")).agg(amount.alias("__sum"))
    key = W.partitionBy(*names)
    earlier = key.orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*names, "__at", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"), F.sum("__sum").over(key).alias("__total"))
    within = W.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = dealt.withColumn("__inside", amount.over(within))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], F.col("__range") == F.col("__at"))
    return inside.join(starts, same).select(*rows.columns, (F.col("__start") + F.col("__inside")).alias("__end"), "__total")
