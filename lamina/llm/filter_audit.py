"""Audit of how document filters overlap, by a subset-zeta transform of failure masks.

Every document has a mask: one bit for each filter that it fails. What the audit needs of a part of the corpus are the
counts of its masks, 2**k numbers whatever its size. The subset-zeta transform (for each bit, add to every mask that has
it the value of the mask without it) turns them into the number of documents whose mask lies within a set of bits, so the
survivors of any set F of filters are the value at the complement of F. A step of an order is then a difference between two
neighbouring sets: what it removes are the survivors before it less those after it. Labels go through the same transform.

The duplicate filter (a text that a smaller doc_id has too) needs one fact of all rows: for each text its smallest doc_id.
Rows of one text are combined in their map tasks before they meet, so a text that very many rows share is no hot key.

Defined results: a null text is empty, a null part is the empty string. A null doc_id is smaller and larger than none: its
row never fails as a duplicate and makes no other row fail. Rows of equal doc_id and text don't make each other fail.
Several labels of one doc_id count as positive where one of them is. Documents without a label are not positive. An empty
table gives no rows. Columns beyond those named are not read, so names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

#: Orders are listed, so there are at most 8 filters (40,320 orders).
MOST_FILTERS = 8
#: Keys over which rows without a doc_id are spread.
SPREAD = 997
#: The characters that part words, as one space.
SPACES = "\t\n\u000b\f\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on one text: short, repetitive, many capitals, odd signs."""
    w = words(text)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(w) < 100,
        "B": 100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bits(flags: list[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0)).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], measures: Mapping[str, Column], part: str = "lang", text: str = "text") -> DataFrame:
    """part, mask and the number of documents ``n`` and of those with each measure; the highest bit says duplicate.

    ``filters`` are conditions on the columns of docs, ``measures`` conditions on the columns of labels (by doc_id).
    Texts stay in their map tasks: a digest, an id and a mask cross the shuffles.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("__id"),
        F.when(F.col("doc_id").isNull(), F.pmod(F.spark_partition_id(), F.lit(SPREAD))).otherwise(-1).alias("__spread"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(content, 256)).alias("__digest"),
        _bits(list(filters.values())).alias("__mask"),
    )
    positive = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), F.lit(-1).alias("__spread")).agg(*[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(m) for m, c in measures.items()])
    counted = rows.join(positive, ["__id", "__spread"], "left").groupBy("__id", "__spread", "__digest", "part", "__mask")
    counted = counted.agg(F.count("*").alias("n"), *[F.sum(F.coalesce(m, F.lit(0))).alias(m) for m in measures])
    sums = ["n", *measures]
    # Every row, as if it were a duplicate where it can be; then those of the smallest doc_id are moved to the masks without that bit.
    bit = 1 << len(filters)
    every = counted.groupBy("part", "__mask", F.col("__id").isNotNull().alias("can")).agg(*[F.sum(s).alias(s) for s in sums])
    every = every.select("part", (F.col("__mask") + F.when(F.col("can"), bit).otherwise(0)).alias("mask"), *sums)
    # The rows of one text and doc_id: one struct a part, as their mask is the text's.
    firsts = counted.groupBy("__digest", "__id", "__spread").agg(F.collect_list(F.struct("part", "__mask", *sums)).alias("of"))
    firsts = firsts.groupBy("__digest").agg(F.min_by("of", "__id").alias("of")).select(F.explode("of").alias("o"))
    firsts = firsts.groupBy("o.part", F.col("o.__mask").alias("__mask")).agg(*[F.sum(f"o.{s}").alias(s) for s in sums])
    moved = firsts.select("part", F.explode(F.array(*[F.struct((F.col("__mask") + add).alias("mask"), *[(F.col(s) * sign).alias(s) for s in sums]) for add, sign in ((0, 1), (bit, -1))])).alias("m")).select("part", "m.*")
    return every.unionByName(moved).groupBy("part", "mask").agg(*[F.sum(s).alias(s) for s in sums])


def subset_zeta(values: Column, bits: int) -> Column:
    """For every mask (the index), the sum of ``values`` over the masks that lie within it; one pass a bit."""

    steps = F.array(*[F.lit(1 << b) for b in range(bits)])
    merge = lambda z, bit: F.transform(z, lambda v, m: v + F.when(m.bitwiseAND(bit) != 0, F.get(z, m - bit)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(steps, values, merge)


def order_steps(names: str) -> Column:
    """All orders of the letters in ``names``, each as a struct of its letters and steps (number, filter bit, bits before it).

    Order j is read off the digits of j to the bases k, k-1, ..., each of which takes a letter out of those that are left.
    """
    k = len(names)
    orders = F.sequence(F.lit(0), F.lit(math.factorial(k) - 1))

    def letters(j: Column) -> Column:
        state = F.struct(F.lit(names).alias("left"), F.lit("").alias("taken"))

        def take(s: Column, i: Column) -> Column:
            below = F.element_at(F.array(*[F.lit(math.factorial(k - 1 - n)) for n in range(k)]), i + 1)
            at = F.floor(j / below).cast("int") % (F.lit(k) - i)
            rest = F.concat(F.substring(s["left"], F.lit(1), at), F.substring(s["left"], at + 2, F.lit(k)))
            return F.struct(rest.alias("left"), F.concat(s["taken"], F.substring(s["left"], at + 1, F.lit(1))).alias("taken"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), state, take, lambda s: s["taken"])

    return F.transform(orders, letters)


def audit(counts: DataFrame, names: str, measures: list[str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, a ``<measure>_lost`` for each and shapley, from mask_counts."""
    k = len(names)
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} filters can be audited, not {k}")
    whole, sums = (1 << k) - 1, ["n", *measures]
    cells = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*sums)))).alias("by"))
    dense = lambda s: F.transform(F.sequence(F.lit(0), F.lit(whole)), lambda m: F.coalesce(F.col("by")[m][s], F.lit(0).cast("long")))
    within = cells.select("part", *[subset_zeta(dense(s), k).alias(s) for s in sums])
    survivors = lambda s, mask: F.get(F.col(s), F.lit(whole) - mask)
    # Removed by filter f over all orders: a set P before it comes first in |P|! (k - 1 - |P|)! of them.
    weights = F.array(*[F.lit(math.factorial(p) * math.factorial(k - 1 - p)).cast("long") for p in range(k)])

    def shapley(f: int) -> Column:
        before = F.filter(F.sequence(F.lit(0), F.lit(whole)), lambda m: m.bitwiseAND(F.lit(1 << f)) == 0)
        return F.aggregate(before, F.lit(0).cast("long"), lambda total, m: total + F.element_at(weights, F.bit_count(m) + 1) * (survivors("n", m) - survivors("n", m + (1 << f))))

    within = within.withColumn("shapley", F.array(*[shapley(f) for f in range(k)]))
    listed = within.withColumn("filter_order", F.explode(order_steps(names)))
    steps = listed.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    number = lambda letter: F.instr(F.lit(names), letter) - 1
    bit = lambda i: F.element_at(F.array(*[F.lit(1 << f) for f in range(k)]), F.instr(F.lit(names), F.substring("filter_order", i, F.lit(1))))
    steps = steps.withColumn("own", bit(F.col("step"))).withColumn("before", F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda m, i: m + F.when(i > 0, bit(i)).otherwise(0)))
    after = F.col("before") + F.col("own")
    gone = lambda s: survivors(s, F.col("before")) - survivors(s, after)
    fails = survivors("n", F.lit(0)) - survivors("n", F.col("own"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        survivors("n", after).alias("kept"),
        gone("n").alias("removed"),
        (fails - gone("n")).alias("redundant"),
        (survivors("n", F.lit(whole) - F.col("own")) - survivors("n", F.lit(whole))).alias("unique_fails"),
        *[gone(m).alias(f"{m}_lost") for m in measures],
        F.element_at("shapley", number(F.substring("filter_order", F.col("step"), F.lit(1))) + 1).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of text_filters A to D and the duplicate filter E by language, with good and toxic documents lost."""
    measures = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    filters = text_filters(F.coalesce(F.col("text"), F.lit("")))
    return audit(mask_counts(docs, labels, filters, measures), "".join(filters) + "E", list(measures))
