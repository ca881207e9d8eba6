"""Quality by nearest-neighbour voting in a latent-semantic space.

Documents become counts of hashed byte pairs and triples, damped by a logarithm and
weighted by inverse document frequency over the whole corpus; the share of words that
repeat the one before them is an axis of its own. A truncated singular value
decomposition of a bounded sample of labelled rows gives the latent axes. The labelled
vectors (SAMPLE rows at most, a fixed number of axes) go to every task; each batch of
documents is multiplied with all of them, and the NEIGHBOURS most similar vote with
their similarity.

Defined results: a null text counts as empty; a text without a byte pair has no
similarity to anything and gets the prior share of label 1; without learnable labels the
score is 0.5 for all. Labels that are null or of a null or unknown doc_id teach nothing;
a doc_id that carries several labels teaches each, and one that several rows carry is
learned from one of them. Other columns are dropped, whatever their names; ``keep`` may
not hold score or predicted (an error). Ties between neighbours fall to the
one earlier in the sample's hash order. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamina.llm.batches import lean, small_batches
from lamina.llm.features import ngram_counts

#: Hashed n-grams, latent axes, neighbours that vote.
WIDTH, AXES, NEIGHBOURS = 2048, 48, 15
#: Tasks that add up the other tasks' document frequencies.
ADDERS = 16
#: Length of the axis that holds the share of repeated words, beside latent coordinates of length 1.
REPEATS = 1.5
#: Labelled rows that the model learns from at most, half of them of either label where there are enough.
SAMPLE = 4000


def unclashing(keep: tuple[str, ...], *added: str) -> None:
    """Columns that are kept must not be named like those that are added."""
    if clash := sorted(set(keep) & {*added, "__text"}):
        raise ValueError(f"columns to keep have names of the result: {clash}")


def crc_remainder(column: str, divisor: int):
    """crc32 of a column's text modulo ``divisor``; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled rows in hash order, up to half of them of label 0 and of label 1.

    A doc_id counts once for each label it has. Where several rows carry it, the one whose text has the least hash is taken.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = known.join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id", "label")
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(order, "doc_id").limit(most // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    # ``most`` rows at most are broadcast, whatever the size of the corpus; copies of a doc_id meet in a combined aggregation.
    met = own.join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each hashed n-gram occurs, and the number of documents; one row a task reaches the sum."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += ngram_counts(text.as_py(), WIDTH) > 0
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([seen], pa.list_(pa.int64()))], ["rows", "seen"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            seen += batch.column(1).flatten().to_numpy().reshape(-1, WIDTH).sum(0)
            rows += sum(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([seen], pa.list_(pa.int64()))], ["rows", "seen"])

    # Each task gives one vector; a few tasks add these up, so the driver sees few rows whatever the number of tasks.
    parts = small_batches(texts).mapInArrow(lean(run), "rows long, seen array<long>")
    sums = parts.repartition(ADDERS).mapInArrow(lean(add), "rows long, seen array<long>").collect()
    return np.sum([r["seen"] for r in sums], axis=0).astype(np.float64), sum(r["rows"] for r in sums)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts times idf, rows of unit length (zeros stay zeros)."""
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def latent_axes(x: np.ndarray, axes: int) -> np.ndarray:
    """The leading right singular vectors of x as columns, by subspace iteration from fixed start vectors."""
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(axes + 16, x.shape[1]))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :axes].astype(np.float32)


def repeats(text: str) -> float:
    """Share of words that repeat the word before them; 0 for fewer than two words."""
    words = text.split()
    return sum(map(eq, words, words[1:])) / (len(words) - 1) if len(words) > 1 else 0.0


def latent(counts: np.ndarray, repeated: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors: the latent coordinates, and the repeated words' share as one axis more."""
    return unit(np.concatenate((unit(weighted(counts, idf) @ axes), REPEATS * repeated[:, None].astype(np.float32)), 1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, prior: float, weights: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the k most similar labelled vectors, weighted by similarity and by ``weights`` of the labels."""
    if not len(known):
        return np.full(len(vectors), 0.5)
    similarity = vectors @ known.T
    k = min(k, similarity.shape[1])
    nearest = np.argpartition(-similarity, k - 1, axis=1)[:, :k]
    power = np.clip(np.take_along_axis(similarity, nearest, 1), 0, None).astype(np.float64) ** 8
    power = power * weights[labels[nearest]]
    mass = power.sum(1)
    score = (power * labels[nearest]).sum(1) / np.maximum(mass, 1e-300)
    return np.where(mass > 0, score, prior)


def score_quality(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",), label: str = "quality") -> DataFrame:
    """Columns ``keep``, score, predicted of every document; learns from all rows of ``labels`` it is given.

    ``corpus`` (docs unless given) holds the labelled texts and the document frequencies.
    """
    unclashing(keep, "score", "predicted")
    corpus = docs if corpus is None else corpus
    seen, rows = document_frequencies(corpus)
    idf = np.log((1 + rows) / (1 + seen)).astype(np.float32) + np.float32(1)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_counts(t.as_py(), WIDTH).astype(np.float32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary()), pa.array([repeats(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "label", "counts", "repeated"])

    sample = small_batches(labelled_sample(corpus, labels, label, SAMPLE)).mapInArrow(lean(count), f"doc_id {corpus.schema['doc_id'].dataType.simpleString()}, label int, counts binary, repeated double")
    taught = sample.orderBy(F.xxhash64("doc_id", "label"), "doc_id").collect()
    x = weighted(np.array([np.frombuffer(r["counts"], np.float32) for r in taught]).reshape(-1, WIDTH), idf)
    axes = latent_axes(x, AXES) if len(x) else np.zeros((WIDTH, AXES), np.float32)
    marks = np.array([r["label"] for r in taught], np.int64)
    known = unit(np.concatenate((unit(x @ axes), REPEATS * np.array([r["repeated"] for r in taught], np.float32)[:, None]), 1))
    share = labels.filter(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    prior = 0.5 if share is None else float(share)
    taken = np.bincount(marks, minlength=2) / max(1, len(marks))
    # The sample is balanced; weights halfway between the sample's and the corpus' shares keep rare labels audible.
    weights = np.sqrt(np.array([1 - prior, prior]) / np.maximum(taken, 1e-9)) if taken.all() else np.ones(2)
    model = docs.sparkSession.sparkContext.broadcast((idf, axes, known, marks, prior, weights))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, axes, known, marks, prior, weights = model.value
        for batch in batches:
            counts = np.array([ngram_counts(t.as_py(), WIDTH) for t in batch.column(len(keep))]).reshape(-1, WIDTH)
            repeated = np.array([repeats(t.as_py()) for t in batch.column(len(keep))])
            found = vote(latent(counts, repeated, idf, axes), known, marks, prior, weights)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    source = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    kinds = "".join(f"`{name}` {source.schema[name].dataType.simpleString()}, " for name in keep)
    return small_batches(source).mapInArrow(lean(score), kinds + "score double, predicted int")
