"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamina.session import cut_lineage

#: Rows of one key from which its facts are sent to all tasks instead of its rows to one, and the most facts that are sent.
ROWS_OF_A_KEY, SENT_KEYS = 256, 200_000


def join_crowded(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with facts(*keys, n, ...), one fact a key, without moving the rows of frequent keys.

    ``n`` says how many rows a fact's key has, ``total`` how many rows there are, so at most total / ROWS_OF_A_KEY and
    never more than SENT_KEYS facts are broadcast. Both frames are read twice: they should be cached or cut.
    The result has no more partitions than a shuffle: a union adds up those of its sides, and rounds would pile them up.
    """
    most = max(ROWS_OF_A_KEY, -(-total // SENT_KEYS))
    many = F.broadcast(facts.filter(F.col(n) > most))
    few = rows.join(many.select(*keys), keys, "left_anti").join(facts.filter(F.col(n) <= most), keys, how)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(many, keys).unionByName(few).coalesce(partitions)


#: Short rows (ids, links) of one task, about; fewer of them are not dealt to more tasks.
ROWS_A_TASK = 200_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """The frame in as many partitions as its number of short rows asks for: small tables leave few files behind."""
    return df.coalesce(rows // ROWS_A_TASK + 1)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) for every node of edges(u, v).

    Each round is two aggregations that combine before their shuffle and two joins whose
    other side has one row a node, so Spark can split a node with very many links. The
    edges in between are cut from their lineage by a checkpoint. Few edges stay in few tasks
    before each shuffle, as every task leaves files. No edge: no row.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = cut_lineage(edges)
    before = _signature(edges)
    edges = gathered(edges, before[0])
    while before[0]:
        # Large star: a node's larger neighbours move to the smallest node around it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = gathered(gathered(large, before[0]).distinct(), before[0])
        # Small star: a node and its smaller neighbours move to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut_lineage(gathered(gathered(small, before[0]).distinct(), before[0]))
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
