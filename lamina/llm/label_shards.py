"""Sharding by balanced label propagation, in DataFrame operations only.

Nodes start in a shard by hash. In each round a linked node asks to move to the open
shard that holds most of its neighbours; every shard takes as many as its quota allows:
free places plus those that its leavers give up. Neighbours are met through hubs (a hub
is anything that links its members, here an equal text), so a hub of any size costs one
counter for each shard and never a pair of members. After the rounds a final exchange
brings every shard to its exact number of rows: unlinked rows move first.

What the driver sees in a round is one row for each pair of shards. Ranks are taken in
two levels (a count for each bucket, then row numbers within it), so no task has to hold
a shard.

Defined results: a null text has no bytes (size 8) and, like an empty one, links to its
equals; repeated rows are rows of their own; with fewer rows than shards some shards stay
empty; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lamina.llm.components import join_crowded
from lamina.session import cut_lineage

#: Rows that a bucket of a two-level rank is meant to hold.
BUCKET_ROWS = 1_000
#: During the rounds a shard may be above its quota by one in so many; the last exchange takes that back.
SLACK = 10


def ranked(rows: DataFrame, keys: list[str], order: list, buckets: int, name: str = "rank") -> DataFrame:
    """``rows`` with a gapless rank from 0 within ``keys``, by bucket of a hash and then by ``order``."""
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    starts = starts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = W.partitionBy(*keys, "__bucket").orderBy(*order)
    out = dealt.join(starts, [*keys, "__bucket"]).withColumn(name, F.col("__start") + F.row_number().over(within) - 1)
    return out.drop("__bucket", "__start")


def accepted(demand: dict[tuple[int, int], int], free: list[int]) -> list[float]:
    """Share of its applicants that each shard can take, counting on the places that its own leavers free."""
    share = [1.0] * len(free)
    for _ in range(50):
        for t in range(len(free)):
            asked = sum(n for (_, to), n in demand.items() if to == t)
            left = sum(n * share[to] for (frm, to), n in demand.items() if frm == t)
            share[t] = min(1.0, max(0.0, free[t] + left) / asked) if asked else 1.0
    return share


def propagate(links: DataFrame, quotas: list[int], rounds: int = 8) -> DataFrame:
    """node, hub, shard after label propagation of links(node, hub); no shard keeps taking beyond its quota."""
    shards = len(quotas)
    labels = cut_lineage(links.select("node", "hub", F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(shards)).cast("int").alias("shard")))
    for turn in range(rounds):
        held = labels.groupBy("hub", "shard").agg(F.count("*").alias("n")).persist()  # recomputed where an executor is lost
        loads = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = [quotas[s] + quotas[s] // SLACK - loads.get(s, 0) for s in range(shards)]
        open_shards = [s for s in range(shards) if free[s] > 0]
        # The shard that attracts a hub: most members first; the tie is settled by a hash, the same for all members.
        pull = F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")
        best = held.groupBy("hub").agg(
            F.sum("n").alias("whole"),
            F.max(pull).alias("best"),
            F.max(F.when(F.col("shard").isin(open_shards), pull)).alias("open"),
        )
        # A small hub whose shard is closed gathers in its best open one, also from the closed one.
        shut = ~F.col("best.shard").isin(open_shards) & F.col("open").isNotNull() & (F.col("whole") <= max(1, min(quotas) // 4))
        wish = (
            held.join(best, "hub")
            .withColumn("to", F.when(shut, F.col("open")).when(F.col("best.shard") != F.col("shard"), F.coalesce("open", "best")))
            .withColumn("shut", shut)
            .filter("to is not null and to.shard <> shard and (shut or to.n > n or (to.n = n and to.tie > xxhash64(hub, shard)))")
            .select("hub", "shard", "n", "whole", F.col("to.shard").alias("to"))
        )
        wish = wish.persist()
        demand = {(r["shard"], r["to"]): r["n"] for r in wish.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        share = accepted(demand, free)
        if sum(n * share[to] for (_, to), n in demand.items()) < 1:
            held.unpersist(), wish.unpersist()
            break
        # Whole hubs are taken while they fit; a part of a hub that is larger than what is left, node by node.
        take = F.element_at(F.array(*[F.lit(x) for x in share]), F.col("to") + 1)
        rooms = F.element_at(F.array(*[F.lit(max(1, q // 4)) for q in quotas]), F.col("to") + 1)
        draw = lambda *c: F.pmod(F.xxhash64(F.lit(turn), *c), F.lit(1_000_003)) / 1_000_003.0
        moved = join_crowded(labels, wish, ["hub", "shard"], "n", sum(loads.values()), "left")
        goes = F.col("to").isNotNull() & (F.when(F.col("whole") <= rooms, draw("hub")).otherwise(draw("node")) < take)
        labels = cut_lineage(moved.select("node", "hub", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard")))
        held.unpersist(), wish.unpersist()
    return labels


def balanced(labels: DataFrame, quotas: list[int], buckets: int) -> DataFrame:
    """labels(node, hub, linked, shard) with exactly quotas[s] rows in shard s.

    Shards above their quota give up rows, those without a link first and then those of
    the hubs that have fewest rows there; shards below it are filled in order.
    """
    shards = len(quotas)
    found = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    surplus = [max(0, found.get(s, 0) - quotas[s]) for s in range(shards)]
    deficit = [max(0, quotas[s] - found.get(s, 0)) for s in range(shards)]
    if not sum(surplus):
        return labels
    pick = lambda values, column: F.element_at(F.array(*[F.lit(v) for v in values]), column + 1)
    # How many leave by kind: unlinked rows before linked ones, from counts that the driver may see.
    loose = {r["shard"]: r["n"] for r in labels.filter("not linked").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    from_loose = [min(surplus[s], loose.get(s, 0)) for s in range(shards)]
    from_linked = [surplus[s] - from_loose[s] for s in range(shards)]
    order = [F.xxhash64("node")]
    groups = ranked(labels, ["shard", "linked"], order, buckets, "place")
    if sum(from_linked):
        sizes = labels.filter("linked").groupBy("shard", "hub").agg(F.count("*").alias("rows"))
        # Smallest parts of hubs leave first: rank hubs, then add up their rows.
        by_size = ranked(sizes.select(F.xxhash64("hub").alias("node"), "shard", "hub", "rows", F.least("rows", F.lit(64)).alias("class")), ["shard", "class"], order, buckets, "nth")
        classes = sizes.groupBy("shard", F.least("rows", F.lit(64)).alias("class")).agg(F.sum("rows").alias("total"), F.count("*").alias("hubs"))
        ahead = W.partitionBy("shard").orderBy("class").rowsBetween(W.unboundedPreceding, -1)
        classes = classes.select("shard", "class", "total", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("start"))
        lead = by_size.join(F.broadcast(classes), ["shard", "class"])  # at most 64 rows a shard
        small = F.col("start") + F.col("nth") * F.col("class")
        lead = cut_lineage(lead.select("shard", "hub", "rows", "start", "class", F.when(F.col("class") < 64, small).alias("hub_start")))
        led = join_crowded(labels.filter("linked"), lead, ["shard", "hub"], "rows", sum(found.values()))
        linked = ranked(led.drop("rows"), ["shard", "hub"], order, max(64, buckets), "nth_row")
        big = ranked(linked.filter("class = 64"), ["shard"], order, buckets, "nth_big")
        place = linked.filter("class < 64").select("node", "hub", "linked", "shard", (F.col("hub_start") + F.col("nth_row")).alias("place"))
        place = place.unionByName(big.select("node", "hub", "linked", "shard", (F.col("start") + F.col("nth_big")).alias("place")))
        groups = groups.filter("not linked").select("node", "hub", "linked", "shard", "place").unionByName(place)
    leaves = F.col("place") < F.when(F.col("linked"), pick(from_linked, F.col("shard"))).otherwise(pick(from_loose, F.col("shard")))
    groups = cut_lineage(groups.withColumn("leaves", leaves))
    stays = groups.filter("not leaves").select("node", "hub", "linked", "shard")
    gone = groups.filter("leaves")
    # Leavers in a row: those of shard 0, then of shard 1, ...; the free places likewise.
    offsets = [sum(surplus[:s]) for s in range(shards)]
    nth = F.col("place") + F.when(F.col("linked"), pick(from_loose, F.col("shard"))).otherwise(F.lit(0)) + pick(offsets, F.col("shard"))
    ends = [sum(deficit[: s + 1]) for s in range(shards)]
    to = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= nth))
    return stays.unionByName(gone.select("node", "hub", "linked", to.cast("int").alias("shard")))


def shard_by_links(nodes: DataFrame, shards: int, rounds: int = 8) -> DataFrame:
    """nodes(node, hub, ...) -> node, shard, slot; counts at most one apart, equal hubs together where they fit.

    ``node`` must be unique. A hub of one member is no link.
    """
    members = nodes.select("node", "hub")
    total = members.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    buckets = max(1, total // (shards * BUCKET_ROWS))
    shared = members.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1").persist()
    linked = F.col("n").isNotNull().alias("linked")
    members = join_crowded(members, shared, ["hub"], "n", total, "left").select("node", "hub", linked).persist()
    linked = propagate(members.filter("linked").select("node", "hub"), quotas, rounds)
    # Rows without a link fill what is left, in proportion.
    loads = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    free = [max(0, quotas[s] - loads.get(s, 0)) for s in range(shards)]
    ends = [sum(free[: s + 1]) for s in range(shards)]
    draw = F.pmod(F.xxhash64(F.lit(11), "node"), F.lit(max(1, ends[-1])))
    into = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= draw))
    loose = members.filter("not linked").withColumn("shard", F.least(into, F.lit(shards - 1)).cast("int"))
    labels = loose.select("node", "hub", "linked", "shard").unionByName(linked.select("node", "hub", F.lit(True).alias("linked"), "shard"))
    even = balanced(cut_lineage(labels), quotas, buckets)
    members.unpersist(), shared.unpersist()
    return ranked(cut_lineage(even), ["shard"], [F.xxhash64("node")], buckets, "slot").select("node", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 8, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document; equal texts are linked."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.substring(F.sha2(content, 256), 1, 32).alias("hub"),
    )
    # Rows of the same doc_id and text are told apart by their number.
    same = W.partitionBy("doc_id", "hub").orderBy("size")
    rows = rows.withColumn("nth", F.row_number().over(same))
    rows = cut_lineage(rows.withColumn("node", F.struct("doc_id", "hub", "nth")))
    placed = shard_by_links(rows.select("node", "hub"), shards, rounds)
    return rows.join(placed, "node").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
