"""Data gates, splits, scaling, neighbours, pseudo-labels and model selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lamina.functions import statistics
from lamina.operators import ranks

#: Query vectors that are broadcast, and that a block holds beyond that.
QUERIES_AT_ONCE = 20_000
#: Rows that a chunk holds where queries come in blocks.
ROWS_AT_ONCE = 50_000


def data_gate(rows: DataFrame, vector: str, label: str, low: float, high: float, classes: int) -> DataFrame:
    """One row: rows, classes, least and most rows of a class, their ratio, and the checks for NaN, range and classes."""
    per = rows.groupBy(label).agg(
        F.count("*").alias("n"), F.bool_or(F.exists(vector, lambda x: F.isnan(x))).alias("nan"),
        F.min(F.array_min(vector)).alias("least"), F.max(F.array_max(vector)).alias("most"),
    )
    out = per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_classes"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.bool_or("nan").alias("has_nan"), F.min("least").alias("least"), F.max("most").alias("most"))
    in_range = (F.col("least") >= low) & (F.col("most") <= high)
    return out.select("n_rows", "n_classes", "min_rows", "max_rows", (F.col("max_rows") / F.col("min_rows")).alias("imbalance"), "has_nan", in_range.alias("in_range"), (~F.col("has_nan") & in_range & (F.col("n_classes") >= classes)).alias("passed"))


def require(checked: DataFrame, column: str, message: str) -> DataFrame:
    """Fails the job where the check is not true."""
    return checked.filter(F.when(F.col(column), True).otherwise(F.raise_error(message).cast("boolean")))


def stratified_folds(rows: DataFrame, label: str, order: list[Column], folds: int) -> DataFrame:
    """``rows`` with fold: within each class dealt round robin in the given order."""
    placed = ranks.running(rows, [label], order)
    return placed.select(*rows.columns, ((F.col("__end") - 1) % folds).cast("int").alias("fold"))


def stratified_split(rows: DataFrame, label: str, order: list[Column], test: float = 0.2) -> DataFrame:
    """``rows`` with is_test: the last part of each class in the given order; the only row of a class is none."""
    placed = ranks.running(rows, [label], order)
    share = (F.col("__end") - 1) / F.greatest(F.col("__total") - 1, F.lit(1))
    return placed.select(*rows.columns, (share > 1 - test).alias("is_test"))


def standard_scale(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim, z: every component less its mean, by its population deviation; a constant one gives 0."""
    long = rows.select(key, F.posexplode(vector).alias("dim", "x"))
    fit = long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    z = F.when(F.col("deviation") > 0, (F.col("x") - F.col("mean")) / F.col("deviation")).otherwise(0.0)
    return long.join(F.broadcast(fit), "dim").select(key, "dim", z.alias("z"))  # as many rows as components


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """query, key, distance, label of the k rows nearest to each query but itself; ties fall to the smaller key.

    Up to QUERIES_AT_ONCE queries are broadcast. More are dealt into blocks, the rows into chunks, and a task compares one
    block with one chunk; nothing of either table passes the driver. Every task keeps k rows a query, and these are merged.
    """
    asked, held = queries.select(F.col(key).alias("query"), F.col(vector).alias("point")), rows.select(key, vector, label)

    def closest(names: np.ndarray, points: np.ndarray, pdf: pd.DataFrame):
        if not len(pdf) or not len(names):
            return
        data, ids = np.stack(pdf[vector].to_numpy()).astype(np.float64), pdf[key].to_numpy()
        for i in range(0, len(names), 256):
            # Differences, not the expanded square: equal vectors are at distance 0 exactly.
            distance = np.stack([((data - p) ** 2).sum(1) for p in points[i : i + 256]])
            distance[names[i : i + 256, None] == ids[None, :]] = np.inf
            order = np.lexsort((np.broadcast_to(ids, distance.shape), distance), axis=1)[:, :k]
            near = np.take_along_axis(distance, order, 1)
            found = pd.DataFrame({"query": np.repeat(names[i : i + 256], order.shape[1]), key: ids[order].ravel(), "distance": near.ravel(), label: pdf[label].to_numpy()[order].ravel()})
            yield found[np.isfinite(found["distance"])]

    schema, total = f"query long, {key} long, distance double, {label} int", asked.count()
    if total <= QUERIES_AT_ONCE:
        taken = asked.collect()
        shared = rows.sparkSession.sparkContext.broadcast((np.array([r["query"] for r in taken]), np.array([r["point"] for r in taken], np.float64)))

        def run(batches):
            best = None
            for pdf in batches:
                parts = [p for p in (best, *closest(*shared.value, pdf)) if p is not None and len(p)]
                if parts:
                    best = pd.concat(parts).sort_values(["query", "distance", key], kind="stable").groupby("query").head(k)
            if best is not None:
                yield best

        out = held.mapInPandas(run, schema)
    else:
        blocks, chunks = -(-total // QUERIES_AT_ONCE), max(1, -(-held.count() // ROWS_AT_ONCE))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = asked.withColumn("__block", F.pmod(F.xxhash64("query"), F.lit(blocks))).withColumn("__chunk", every(chunks))
        right = held.withColumn("__chunk", F.pmod(F.xxhash64(key), F.lit(chunks))).withColumn("__block", every(blocks))

        def meet(some: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            parts = list(closest(some["query"].to_numpy(), np.array(some["point"].tolist(), np.float64), pdf))
            return pd.concat(parts) if parts else pd.DataFrame({"query": [], key: [], "distance": [], label: []})

        out = left.groupBy("__block", "__chunk").cogroup(right.groupBy("__block", "__chunk")).applyInPandas(meet, schema)
    nth = F.row_number().over(W.partitionBy("query").orderBy("distance", key))
    return out.withColumn("nth", nth).filter(F.col("nth") <= k)


def majority(neighbours: DataFrame, label: str) -> DataFrame:
    """query, vote: the label most neighbours have; the smaller one in a tie."""
    votes = neighbours.groupBy("query", label).agg(F.count("*").alias("n"))
    return votes.groupBy("query").agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("vote"))


def first_of_class(rows: DataFrame, label: str, order: list[Column], most: int) -> DataFrame:
    """``rows`` with nth within the class; those up to ``most`` are what a capped scan in this order keeps."""
    placed = ranks.running(rows, [label], order)
    return placed.select(*rows.columns, F.col("__end").alias("nth"), (F.col("__end") <= most).alias("kept"))


def top_of_class(rows: DataFrame, label: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each class with nth; the filter follows the rank, so tasks cut their rows before the shuffle."""
    nth = F.row_number().over(W.partitionBy(label).orderBy(*order))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most)


def zipped(rows: DataFrame, crops: str, text: str, *keep: str) -> DataFrame:
    """keep, place, crop, label of the crops (an array in reading order) beside the characters of their text.

    Rows whose text has another number of characters give nothing, as nobody knows which crop is which; nor do null texts.
    """
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    both = F.zip_with(crops, letters, lambda crop, label: F.struct(crop.alias("crop"), label.alias("label")))
    return rows.filter(F.size(crops) == F.length(text)).select(*keep, F.posexplode(both).alias("place", "pair")).select(*keep, "place", "pair.*")


def promotions(versions: DataFrame, gate: float) -> DataFrame:
    """versions(name, version, accuracy) with promoted: passes the gate and is no worse than the champion before it."""
    passing = F.when(F.col("accuracy") >= gate, F.col("accuracy"))
    before = W.partitionBy("name").orderBy("version").rowsBetween(W.unboundedPreceding, -1)
    champion = F.max(passing).over(before)  # whoever is promoted is no worse, so the champion is the best so far
    return versions.withColumn("champion", champion).withColumn("promoted", (F.col("accuracy") >= gate) & (F.col("champion").isNull() | (F.col("accuracy") >= F.col("champion"))))


def production_alias(promoted: DataFrame) -> DataFrame:
    """The version that each name's production alias points to, beside its latest version."""
    return promoted.groupBy("name").agg(F.max("version").alias("latest"), F.max(F.when(F.col("promoted"), F.col("version"))).alias("production"), F.max_by("accuracy", F.when(F.col("promoted"), F.col("version"))).alias("accuracy"))


def fold_interval(scores: DataFrame, *keys: str) -> DataFrame:
    """Mean, sample deviation and half width of the 95 % interval over scores(fold, score)."""
    out = scores.groupBy(*keys).agg(F.count("*").alias("folds"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("deviation"))
    return out.withColumn("half_width", statistics.t_interval(F.col("folds"), F.col("deviation")))


def served_models(services: DataFrame, aliases: DataFrame) -> DataFrame:
    """services(service, name, alias, has_local) with source and version: the registry's version of the alias, else the local model, else none."""
    known = aliases.select("name", "alias", F.col("version").cast("string").alias("version"))
    found = services.join(known, ["name", "alias"], "left")
    source = F.when(F.col("version").isNotNull(), "registry").when(F.col("has_local"), "local").otherwise("none")
    return found.select("service", source.alias("source"), "version")
