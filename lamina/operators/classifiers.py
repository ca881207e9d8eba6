"""Character classifiers over feature vectors: kernel machines one against one, and pyspark.ml estimators by name."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from lamina.functions.plates import CLASSES
from lamina.operators import evaluation, learning


#: Rows that are compared with a machine's vectors at a time.
ROWS = 512


def fitted_scale(rows: DataFrame, vector: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of every component; one row a component reaches the driver."""
    long = rows.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    fit = sorted(long.collect(), key=lambda r: r["dim"])
    deviation = np.array([r["s"] for r in fit])
    return np.array([r["m"] for r in fit]), np.where(deviation > 0, deviation, 1.0)


def pair_machine(x: np.ndarray, y: np.ndarray, gamma: float, c: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Signed weights and bias of a two-class kernel machine, by coordinate steps on its dual; y is -1 or 1."""
    size = (x**2).sum(1)
    kernel = np.exp(-gamma * np.maximum(size[:, None] + size[None] - 2 * x @ x.T, 0)) + 1.0  # the bias is a constant feature
    alpha, margin = np.zeros(len(x)), np.zeros(len(x))
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(x)):
            new = min(c, max(0.0, alpha[i] + (1 - y[i] * margin[i]) / kernel[i, i]))
            if step := new - alpha[i]:
                margin += step * y[i] * kernel[:, i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return alpha * y, float((alpha * y).sum())


class KernelMachine:
    """One machine for each pair of classes; a class's score is its wins, settled by the sum of its margins."""

    def __init__(self, scale, gamma, machines):
        self.scale, self.gamma, self.machines = scale, gamma, machines  # (class, class, vectors, weights, bias)
        self.shared = self._shared()

    def _shared(self) -> tuple:
        """Vectors of all machines, each once, with the weight that every machine gives them; biases; what a machine's win and margin add to each class.

        Machines share the vectors of their classes, so that a glyph is compared with each of them once.
        """
        places: dict[bytes, int] = {}
        at = [[places.setdefault(v.tobytes(), len(places)) for v in np.ascontiguousarray(vectors)] for _, _, vectors, _, _ in self.machines]
        width = self.machines[0][2].shape[1] if self.machines else 0
        vectors = np.frombuffer(b"".join(places), np.float32).reshape(-1, width) if places else np.zeros((0, len(self.scale[0])), np.float32)
        weights, first, second = np.zeros((len(places), len(self.machines))), np.zeros((len(self.machines), len(CLASSES))), np.zeros((len(self.machines), len(CLASSES)))
        for n, (a, b, _, own, _) in enumerate(self.machines):
            np.add.at(weights[:, n], at[n], own)
            first[n, a] = second[n, b] = 1
        return vectors, weights, np.array([m[4] for m in self.machines]), first, second

    @classmethod
    def fit(cls, glyphs: DataFrame, c: float = 10.0, gamma: float | None = None, per_class: int = 60) -> KernelMachine:
        """From glyphs(label, vec); takes ``per_class`` rows of each class, in hash order, and fits every pair in a task of its own."""
        mean, deviation = fitted_scale(glyphs)
        nth = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("vec")))
        sample = glyphs.select("label", "vec", nth.alias("nth")).filter(F.col("nth") <= per_class)
        index = F.position(F.col("label"), F.lit(CLASSES)) - 1
        rows = sample.select(index.alias("class"), "vec")
        gamma = gamma or 1.0 / len(mean)
        spark, every = glyphs.sparkSession, list(combinations(range(len(CLASSES)), 2))
        pairs = spark.createDataFrame(every, "a int, b int")
        both = rows.join(F.broadcast(pairs), (F.col("class") == F.col("a")) | (F.col("class") == F.col("b")))  # classes * per_class rows at most

        def fit_pair(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
            x = (np.stack(pdf["vec"].to_numpy()) - mean) / deviation
            y = np.where(pdf["class"].to_numpy() == a, 1.0, -1.0)
            if len(set(y)) < 2:
                return pd.DataFrame(columns=["a", "b", "x", "w", "bias"])
            weights, bias = pair_machine(x, y, gamma, c)
            kept = weights != 0
            return pd.DataFrame({"a": [a], "b": [b], "x": [x[kept].astype(np.float32).tobytes()], "w": [weights[kept].tobytes()], "bias": [bias]})

        # A fixed number of partitions: few bytes make much work, so small shuffle files must not be put into one task.
        both = both.repartition(min(len(every), 4 * spark.sparkContext.defaultParallelism), "a", "b")
        found = both.groupBy("a", "b").applyInPandas(fit_pair, "a int, b int, x binary, w binary, bias double").collect()
        width = len(mean)
        machines = [(r["a"], r["b"], np.frombuffer(r["x"], np.float32).reshape(-1, width), np.frombuffer(r["w"]), r["bias"]) for r in found]
        return cls((mean, deviation), gamma, machines)

    def decide(self, x: np.ndarray) -> np.ndarray:
        """Scores by class of rows of features."""
        return self._decided(x, self.scale, self.gamma, self.shared)

    @staticmethod
    def _decided(x: np.ndarray, scale, gamma: float, shared: tuple) -> np.ndarray:
        x = (x - scale[0]) / scale[1]
        vectors, weights, bias, first, second = shared
        size, turned, out = (vectors**2).sum(1)[None], vectors.T.astype(np.float64), []
        for part in np.array_split(x, -(-len(x) // ROWS) or 1):
            distance = (part**2).sum(1)[:, None] + size - 2 * part @ turned
            margin = np.exp(-gamma * np.maximum(distance, 0)) @ weights + bias
            won = (margin > 0).astype(np.float64)
            wins, sums = won @ first + (1 - won) @ second, margin @ (first - second)
            out.append(wins + sums / (3 * (np.abs(sums) + 1)))
        return np.concatenate(out)

    def scored(self, glyphs: DataFrame) -> DataFrame:
        """glyphs with scores over the class set and the predicted character."""
        known = glyphs.sparkSession.sparkContext.broadcast((self.scale, self.gamma, self.shared))
        decided = self._decided
        schema = T.StructType([*glyphs.schema, T.StructField("scores", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = decided(np.stack(pdf["vec"].to_numpy()), *known.value) if len(pdf) else np.zeros((0, len(CLASSES)))
                yield pdf.assign(scores=list(found))

        best = F.array_position("scores", F.array_max("scores"))
        return glyphs.mapInPandas(run, schema).withColumn("guess", F.substring(F.lit(CLASSES), best.cast("int"), F.lit(1)))


class MlModel:
    """A pyspark.ml classifier behind the same interface."""

    def __init__(self, fitted, scale):
        self.fitted, self.scale = fitted, scale

    def scored(self, glyphs: DataFrame) -> DataFrame:
        rows = scaled(glyphs, self.scale)
        out = self.fitted.transform(rows).withColumn("scores", vector_to_array("probability"))
        best = F.array_position("scores", F.array_max("scores"))
        return out.select(*glyphs.columns, "scores").withColumn("guess", F.substring(F.lit(CLASSES), best.cast("int"), F.lit(1)))


def scaled(glyphs: DataFrame, scale: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """glyphs with features, the scaled vector that pyspark.ml reads, and label_index."""
    mean, deviation = (F.array(*[F.lit(float(v)) for v in part]) for part in scale)
    values = F.zip_with(F.zip_with(F.col("vec"), mean, lambda x, m: x - m), deviation, lambda x, s: x / s)
    out = glyphs.withColumn("features", array_to_vector(values))
    return out.withColumn("label_index", (F.position(F.col("label"), F.lit(CLASSES)) - 1).cast("double")) if "label" in glyphs.columns else out


def build(name: str, glyphs: DataFrame, **options):
    """A fitted classifier by name: svm, logistic or random_forest."""
    if name == "svm":
        return KernelMachine.fit(glyphs, **options)
    makers = {"logistic": lambda: LogisticRegression(maxIter=50, regParam=1e-3), "random_forest": lambda: RandomForestClassifier(numTrees=60, maxDepth=10, seed=7)}
    if name not in makers:
        raise ValueError(f"unknown classifier: {name}")
    scale = fitted_scale(glyphs)
    estimator = makers[name]().setFeaturesCol("features").setLabelCol("label_index")
    return MlModel(estimator.fit(scaled(glyphs, scale)), scale)


def cross_validated(name: str, glyphs: DataFrame, folds: int = 3, **options) -> list[float]:
    """Macro F1 of each stratified fold; the scale is fitted inside the fold."""
    dealt = learning.stratified_folds(glyphs, "label", [F.xxhash64("vec"), F.col("glyph_id")], folds).persist()
    scores = []
    for fold in range(folds):
        model = build(name, dealt.filter(F.col("fold") != fold).drop("fold"), **options)
        guesses = model.scored(dealt.filter(F.col("fold") == fold).drop("fold")).select(F.col("label").alias("truth"), "guess")
        scores.append(evaluation.averages(evaluation.class_report(evaluation.confusion(guesses))).first()["macro_f1"])
    dealt.unpersist()
    return scores


def grid_search(glyphs: DataFrame, grid: list[dict], folds: int = 3) -> tuple[dict, float]:
    """The kernel machine's options with the best mean macro F1; the first of equals."""
    scored = [(sum(cross_validated("svm", glyphs, folds, **options)) / folds, -i, options) for i, options in enumerate(grid)]
    best = max(scored, key=lambda s: s[:2])
    return best[2], best[0]


def accuracy(rows: DataFrame) -> float:
    """Share of rows whose guess is their label, by pyspark.ml's evaluator."""
    index = lambda c: (F.position(F.col(c), F.lit(CLASSES)) - 1).cast("double")
    return MulticlassClassificationEvaluator(labelCol="l", predictionCol="p", metricName="accuracy").evaluate(rows.select(index("label").alias("l"), index("guess").alias("p")))
