"""Offline evaluation: exact and character accuracy, confusion, class reports, fairness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lamina.functions import plates, statistics


def score_readings(readings: DataFrame) -> DataFrame:
    """readings(label, prediction, ...) with correct, edit_distance, longest and char_accuracy; a missing reading is empty."""
    read = F.coalesce("prediction", F.lit(""))
    distance, longest = plates.edit_similarity_parts(F.col("label"), read)
    return readings.withColumns({
        "correct": F.col("label") == read, "edit_distance": distance, "longest": longest,
    }).withColumn("char_accuracy", F.when(F.col("longest") > 0, 1 - F.col("edit_distance") / F.col("longest")).otherwise(0.0))


def accuracy(scored: DataFrame, *keys: str) -> DataFrame:
    """n, exact, exact_rate and the micro character accuracy of each group."""
    n, exact = F.count("*"), F.count_if("correct")
    return scored.groupBy(*keys).agg(
        n.alias("n"), exact.alias("exact"), (exact / n).alias("exact_rate"),
        F.when(F.sum("longest") > 0, 1 - F.sum("edit_distance") / F.sum("longest")).otherwise(0.0).alias("char_accuracy"),
    )


def paired_characters(readings: DataFrame) -> DataFrame:
    """truth, guess of every position of readings whose lengths agree."""
    same = readings.filter(F.length("label") == F.length("prediction"))
    letters = lambda c: F.split(F.col(c), "")
    pairs = same.select(*[c for c in readings.columns if c not in ("label", "prediction")], F.explode(F.arrays_zip(letters("label").alias("truth"), letters("prediction").alias("guess"))).alias("p"))
    return pairs.select(*[c for c in pairs.columns if c != "p"], "p.truth", "p.guess").filter("truth <> ''")


def confusion(pairs: DataFrame) -> DataFrame:
    """truth, guess, n: sparse confusion counts."""
    return pairs.groupBy("truth", "guess").agg(F.count("*").alias("n"))


def confusion_table(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """One row a true class, one column a predicted class, zeros where nothing fell."""
    wide = pairs.groupBy("truth").pivot("guess", classes).agg(F.count(F.lit(1)))
    return wide.select("truth", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(f"p_{c}") for c in classes])


def class_report(counts: DataFrame) -> DataFrame:
    """class, support, precision, recall, f1 for every class seen as truth or guess; an empty denominator gives 0."""
    truth = counts.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("hits"))
    guess = counts.groupBy(F.col("guess").alias("class")).agg(F.sum("n").alias("predicted"))
    both = truth.join(guess, "class", "full").na.fill(0, ["support", "hits", "predicted"])
    precision, recall = statistics.safe_ratio(F.col("hits"), F.col("predicted")), statistics.safe_ratio(F.col("hits"), F.col("support"))
    return both.select("class", F.col("support").cast("long").alias("support"), precision.alias("precision"), recall.alias("recall"), statistics.safe_ratio(2 * precision * recall, precision + recall).alias("f1"))


def averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted means of a class report, and the accuracy."""
    weigh = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
    means = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    return report.agg(*means, weigh("precision"), weigh("f1"), weigh("recall").alias("accuracy"), F.sum("support").cast("long").alias("support"))


def group_fairness(pairs: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Accuracy of digits and of letters, their disparity (null if one is missing) and whether it is within the tolerance."""
    digit, hit = F.col("truth").rlike("[0-9]"), (F.col("truth") == F.col("guess")).cast("double")
    out = pairs.agg(F.avg(F.when(digit, hit)).alias("digits"), F.count_if(digit).alias("n_digits"), F.avg(F.when(~digit, hit)).alias("letters"), F.count_if(~digit).alias("n_letters"))
    out = out.withColumn("disparity", F.abs(F.col("digits") - F.col("letters")))
    return out.withColumn("fair", F.col("disparity") < tolerance)


def pair_confusion(counts: DataFrame, similar: DataFrame) -> DataFrame:
    """Rates of the look-alike pairs similar(truth, guess) among each true class's readings; classes without readings are left out."""
    rows = counts.groupBy("truth").agg(F.sum("n").alias("total"))
    found = similar.join(rows, "truth").join(counts, ["truth", "guess"], "left")
    n = F.coalesce("n", F.lit(0))
    return found.select("truth", "guess", F.bround(n / F.col("total"), 4).alias("rate"), n.cast("long").alias("n"), F.col("total").cast("long").alias("total"))


def class_equity(pairs: DataFrame) -> DataFrame:
    """truth, accuracy, n, and against all classes: mean, population deviation, gap, and whether it lags by two deviations."""
    own = pairs.groupBy("truth").agg(F.avg((F.col("truth") == F.col("guess")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    overall = own.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"), (F.max("accuracy") - F.min("accuracy")).alias("equity_gap"))
    return own.crossJoin(F.broadcast(overall)).withColumn("lags", F.col("accuracy") < F.col("mean_accuracy") - 2 * F.col("std_accuracy"))  # one row


def with_interval(groups: DataFrame) -> DataFrame:
    """exact out of n with the ends of its score interval."""
    ends = statistics.wilson(F.col("exact"), F.col("n"))
    return groups.withColumns({"low": ends["low"], "high": ends["high"]})


def best_of(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by a lexicographic order that ends in an ordinal, so first-come wins ties."""
    return rows.withColumn("__nth", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__nth = 1").drop("__nth")


def nested_confusion(rates: DataFrame, groups: dict[str, str]) -> DataFrame:
    """report: one JSON text, for each group of similar characters its pairs "a->b" with confusion_rate, count and total.

    ``rates`` are rows of pair_confusion. Pairs of characters that never occur are left out; a group of which nothing
    occurs is empty. Groups are given by their characters.
    """
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(characters).alias("characters")) for name, characters in groups.items()])
    rows = rates.filter("total > 0").withColumn("group", F.explode(listed))
    rows = rows.filter(F.col("group.characters").contains(F.col("truth")) & F.col("group.characters").contains(F.col("guess")) & (F.col("truth") != F.col("guess")))
    entry = F.struct(F.concat("truth", F.lit("->"), "guess").alias("pair"), F.struct(F.col("rate").alias("confusion_rate"), F.col("n").alias("count"), "total").alias("v"))
    nested = rows.groupBy(F.col("group.name").alias("name")).agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("pairs"))
    found = nested.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.to_json("pairs").alias("text"))), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))).alias("by"))
    parts = [F.concat(F.to_json(F.array(F.lit(name))).substr(2, len(name) + 2), F.lit(":"), F.coalesce(F.col("by")[name], F.lit("{}"))) for name in groups]
    return found.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("report"))
