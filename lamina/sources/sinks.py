"""Reports and artefacts as files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.operators import ranks


def write_details(scored: DataFrame, path: str) -> None:
    """Evaluation rows as CSV with a header."""
    scored.write.mode("overwrite").option("header", True).csv(path)


def write_fold_scores(scores: DataFrame, path: str) -> None:
    """config, scores (per fold, joined by semicolons), mean as CSV."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fold", "score"))), lambda s: s.score.cast("string")), ";")
    scores.groupBy("config").agg(joined.alias("scores"), F.avg("score").alias("mean")).write.mode("overwrite").option("header", True).csv(path)


def write_by_class(glyphs: DataFrame, path: str) -> None:
    """Glyph bytes under a folder of their label, each with a number within the label that makes names unique.

    Numbers are taken in two levels by range, so a label of very many glyphs is no task of its own.
    """
    numbered = ranks.running(glyphs, ["label"], [F.col("glyph_id")])
    numbered.withColumn("name", F.format_string("%s_%06d", F.col("label"), F.col("__end"))).drop("__end", "__total").write.mode("overwrite").partitionBy("label").parquet(path)


def write_report(report: DataFrame, folder: str, run: str) -> None:
    """One JSON report of a run, in the run's folder."""
    report.coalesce(1).write.mode("overwrite").json(f"{folder}/run={run}")


def box_lines(boxes: DataFrame) -> DataFrame:
    """Training lines: class, centre and size, six decimals."""
    return boxes.select(F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "xc", "yc", "w", "h").alias("value"))


def save_machine(spark: SparkSession, model, path: str) -> None:
    """A kernel machine as Parquet: its pairs, and its scale and gamma as one row."""
    rows = [(a, b, bytearray(x.astype(np.float32).tobytes()), bytearray(w.tobytes()), bias) for a, b, x, w, bias in model.machines]
    spark.createDataFrame(rows, "a int, b int, x binary, w binary, bias double").write.mode("overwrite").parquet(f"{path}/pairs")
    scale = [(bytearray(model.scale[0].tobytes()), bytearray(model.scale[1].tobytes()), model.gamma)]
    spark.createDataFrame(scale, "mean binary, deviation binary, gamma double").write.mode("overwrite").parquet(f"{path}/scale")


def load_machine(spark: SparkSession, path: str):
    """The kernel machine that save_machine wrote."""
    from lamina.operators.classifiers import KernelMachine

    head = spark.read.parquet(f"{path}/scale").first()
    mean, deviation = np.frombuffer(head["mean"]), np.frombuffer(head["deviation"])
    pairs = spark.read.parquet(f"{path}/pairs").collect()
    return KernelMachine((mean, deviation), head["gamma"], [(r["a"], r["b"], np.frombuffer(r["x"], np.float32).reshape(-1, len(mean)), np.frombuffer(r["w"]), r["bias"]) for r in pairs])
