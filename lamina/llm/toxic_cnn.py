"""Toxicity by a convolutional text classifier, trained in numpy, with thresholds by language.

A word's vector is the mean of hashed embeddings: of the word and of its first bytes, so
that compounds of a known beginning are recognised. Filters of several widths run over
all words of a text, the largest response of each is kept, and a logistic unit turns
these into a probability. All labelled rows are learned from, in tasks: they are dealt by hash into shards of SAMPLE rows
or SAMPLE_BYTES of text, about. The first embedding axis starts from each bucket's log odds over all of them, all else from
fixed random numbers. In each round every shard trains a copy of the model on its rows, and the copies' mean starts the next
round; a bucket's embedding is the mean over the copies that changed it. One row in HELD_BACK is kept
from training: on these a threshold is set for each language, told from the text's own
function words, and the score is the probability bent so that the threshold falls on 0.5. The driver sees the model, and
counts by language, label and probability in steps of 1 / STEPS.

Defined results: null and empty texts score as a text without words; without both labels
to learn from the score is 0 for all. Labels that are null or of a null doc_id teach
nothing; a doc_id that several rows carry is learned from one of them. Other columns are
dropped; ``keep`` may not hold score or predicted (an error). Scores read
whole texts of any length. Repeated rows are scored alike; empty tables give empty tables.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from lamina.llm.batches import lean, small_batches
from lamina.llm.features import plain_words
from lamina.llm.knn_quality import labelled_sample, unclashing
from lamina.session import cut_lineage, swept_shuffles

#: Embedding buckets (0 is the empty one), axes, filters of each width.
BUCKETS, AXES, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
#: First bytes of a word that have embeddings of their own.
PREFIXES = (4, 5, 6, 7, 8)
#: Labelled rows of a shard and bytes of all their texts together, about; passes over a bounded sample.
SAMPLE, SAMPLE_BYTES, EPOCHS = 4000, 1 << 26, 6
#: Rounds over all rows, passes of a shard's copy in each (if there is one shard), rows of which one is kept for thresholds, steps of their probabilities.
ROUNDS, PASSES, HELD_BACK, STEPS = 3, 2, 5, 4096
#: Numbers in a row of a copy's parameters.
BLOCK = 1 << 14
#: Words in a row of the written shards, about.
PIECE = 1 << 19
#: Words whose responses a task keeps at most.
REMEMBERED = 100_000
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as by are this from",
    "fr": "le la les et des que un une en dans pour qui pas sur avec est",
    "de": "der die und den das ist ein eine nicht mit sich auf für dem von zu",
    "es": "el la los las que y en un una con por para del se como su",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]

_crc, _OWN = zlib.crc32, BUCKETS - 1
_function = {lang: {w.encode() for w in words.split()} for lang, words in FUNCTION_WORDS.items()}
_functions = frozenset().union(*_function.values())


def buckets_of(word: bytes) -> list[int]:
    """Embedding buckets of a word and its beginnings; 0 where it is no longer than the beginning."""
    size, own = len(word), 1 + _crc(b"=" + word) % _OWN
    return [own, *[1 + _crc(word[:n]) % _OWN if size > n else own if size == n else 0 for n in PREFIXES]]


def numbering() -> dict[bytes, int]:
    """A dict that gives each word asked for the next number."""
    index: defaultdict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    return index


def languages_of(word: bytes) -> list[bool]:
    return [word in _function[lang] for lang in FUNCTION_WORDS]


def languages_of_all(found: list[bytes]) -> np.ndarray:
    """languages_of each word, as rows; few words are function words."""
    said = np.zeros((len(found), len(FUNCTION_WORDS)), bool)
    for i, word in enumerate(found):
        if word in _functions:
            said[i] = languages_of(word)
    return said


class Texts:
    """Distinct words' buckets and each text's word numbers."""

    def __init__(self, texts: list[str]):
        index = numbering()
        self.rows = [self.numbered(t, index) for t in texts]
        self.buckets = np.array([buckets_of(w) for w in index], np.int64).reshape(-1, 1 + len(PREFIXES))
        said = languages_of_all(list(index))
        hits = np.array([said[r].sum(0) if len(r) else np.zeros(len(FUNCTION_WORDS)) for r in self.rows]).reshape(-1, len(FUNCTION_WORDS))
        self.language = language_numbers(hits)

    @staticmethod
    def numbered(text: str, index: dict[bytes, int]) -> np.ndarray:
        return np.array(list(map(index.__getitem__, plain_words(text))), np.int32)

    @classmethod
    def of(cls, rows: list[np.ndarray], buckets: np.ndarray) -> Texts:
        """Texts whose words are numbered already, without their languages."""
        found = cls.__new__(cls)
        found.rows, found.buckets = rows, buckets
        return found


def language_numbers(hits: np.ndarray) -> np.ndarray:
    """The language with most function words; the last number where there is none."""
    return np.where(hits.max(1, initial=0) > 0, hits.argmax(1) if hits.size else 0, len(FUNCTION_WORDS))


def word_vectors(embedding: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return vectors_of(embedding, np.ascontiguousarray(buckets.T), np.maximum((buckets > 0).sum(1), 1).astype(embedding.dtype))


def vectors_of(embedding: np.ndarray, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean embeddings of words whose buckets are columns, of which ``sizes`` are not empty; numpy adds whole tables faster than parts of rows."""
    found = embedding.take(buckets[0], 0)
    for own in buckets[1:]:
        found += embedding.take(own, 0)
    found /= sizes[:, None]
    return found


def first_embedding(texts: Texts, labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Random, but for the first axis: damped log odds of each bucket's occurrence in texts of label 1."""
    seen = np.zeros((2, BUCKETS))
    count_buckets(texts, labels, seen)
    return log_odds(seen, np.bincount(labels, minlength=2), rng)


def count_buckets(texts: Texts, labels: np.ndarray, seen: np.ndarray) -> None:
    """Adds the number of texts of each label that hold a bucket."""
    for row, label in zip(texts.rows, labels, strict=True):
        seen[label, np.unique(texts.buckets[np.unique(row)])] += 1


def log_odds(seen: np.ndarray, texts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    share = (seen + 2) / (texts[:, None] + 4)
    out = (rng.standard_normal((BUCKETS, AXES)) * 0.05).astype(np.float32)
    out[:, 0] = np.log(share[1] / share[0])
    out[0] = 0
    return out


def start_model(embedding: np.ndarray, rng: np.random.Generator) -> tuple:
    """(embedding, filters by width, filter biases, output weights, output bias) before training."""
    filters = [(rng.standard_normal((w, AXES, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS]
    filters[0][0, 0, 0] = 1.0
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out, bias = np.abs(rng.standard_normal(FILTERS * len(WIDTHS)) * 0.1).astype(np.float32), np.zeros(1, np.float32)
    out[0], bias[0] = 2.0, -3.0
    return embedding, filters, biases, out, bias


def train(texts: Texts, labels: np.ndarray, chosen: np.ndarray, weights: np.ndarray) -> tuple:
    """The model after EPOCHS over ``chosen``."""
    rng = np.random.default_rng(8)
    part = Texts.__new__(Texts)
    part.rows, part.buckets = [texts.rows[i] for i in chosen], texts.buckets
    model = start_model(first_embedding(part, labels[chosen], rng), rng)
    return descend(model, texts, labels, chosen, weights, EPOCHS)


def descend(model: tuple, texts: Texts, labels: np.ndarray, chosen: np.ndarray, weights: np.ndarray, epochs: int) -> tuple:
    """The model, whose arrays are changed, after some passes over ``chosen``."""
    embedding, filters, biases, out, bias = model
    dense = [*filters, *biases, out, bias]
    squares, heat = [np.full_like(p, 1e-2) for p in dense], np.full(BUCKETS, 1e-2, np.float32)
    widest, columns = max(WIDTHS), FILTERS * len(WIDTHS)
    # One block of rows for each place and width that reaches it, as in Scorer: the width of each row, its place, its filter among all.
    blocks = [(k, j) for j in range(widest) for k, w in enumerate(WIDTHS) if j < w]
    of, shift = np.repeat(np.array(blocks), FILTERS, 0).T
    of = of * FILTERS + np.tile(np.arange(FILTERS), len(blocks))
    buckets, every = np.ascontiguousarray(texts.buckets.T), np.arange(columns)
    sizes = np.maximum((buckets > 0).sum(0), 1).astype(np.float32)
    distinct = {i: np.unique(texts.rows[i], return_inverse=True) for i in chosen.tolist()}
    for _ in range(epochs):
        for start in range(0, len(chosen), 16):
            grads, touched, moves = [np.zeros_like(p) for p in dense], [], []
            matrix, bases = np.concatenate([filters[k][j].T for k, j in blocks]), np.concatenate(biases)
            by_place, by_filter = np.zeros(matrix.shape), np.zeros(columns)
            for i in chosen[start : start + 16].tolist():
                names, at = distinct[i]
                own = buckets.take(names, 1)
                vectors = np.concatenate((vectors_of(embedding, own, sizes.take(names)), np.zeros((1, AXES), np.float32)))
                places_of = np.concatenate((at, np.full(widest, len(names))))  # the last vector is of no word
                n = max(1, len(at))
                response, row = (matrix @ vectors.T).take(places_of, 1), columns
                total = response[:columns, :n]
                for j in range(1, widest):
                    wide = FILTERS * sum(w > j for w in WIDTHS)
                    total[-wide:] += response[row : row + wide, j : n + j]
                    row += wide
                places = total.argmax(1)
                peak = total[every, places] + bases
                kept = np.maximum(peak, 0)
                error = (1 / (1 + np.exp(-np.clip(kept @ out + bias[0], -30, 30))) - labels[i]) * weights[labels[i]]
                grads[-2] += error * kept
                grads[-1] += error
                back = error * out * (peak > 0)
                by_filter += back
                each, place = back[of][:, None], places[of] + shift
                by_place += each * vectors.take(places_of.take(place), 0)
                real = (place < len(at)) & (each[:, 0] != 0)
                touched.append(own.take(at.take(place[real]), 1).T)
                moves.append((each * matrix)[real])
            for row, (k, j) in enumerate(blocks):
                grads[k][j] = by_place[row * FILTERS : (row + 1) * FILTERS].T
            for k in range(len(WIDTHS)):
                grads[len(WIDTHS) + k][:] = by_filter[k * FILTERS : (k + 1) * FILTERS]
            for p, g, s in zip(dense, grads, squares, strict=True):
                s += g * g
                p -= 0.05 * g / np.sqrt(s)
            np.maximum(out, 0, out=out)  # filters speak for toxicity or not at all: no harmless words outweigh a toxic one
            rows = np.concatenate(touched) if touched else np.zeros((0, 1 + len(PREFIXES)), np.int64)
            if len(rows):
                move = np.concatenate(moves) / np.maximum((rows > 0).sum(1, keepdims=True), 1)
                changed, where = np.unique(rows, return_inverse=True)
                step = np.zeros((len(changed), AXES), np.float32)
                np.add.at(step, where.reshape(rows.shape), move[:, None, :].astype(np.float32))
                step[changed == 0] = 0
                heat[changed] += (step * step).mean(1)
                embedding[changed] -= 0.05 * step / np.sqrt(heat[changed])[:, None]
    return embedding, filters, biases, out, bias


def packed(model: tuple) -> np.ndarray:
    embedding, filters, biases, out, bias = model
    return np.concatenate([p.ravel() for p in (embedding, *filters, *biases, out, bias)]).astype(np.float32)


def unpacked(flat: np.ndarray) -> tuple:
    """The model of packed numbers, in arrays of its own."""
    shapes, parts, at = [(BUCKETS, AXES), *[(w, AXES, FILTERS) for w in WIDTHS], *[(FILTERS,)] * len(WIDTHS), (FILTERS * len(WIDTHS),), (1,)], [], 0
    for shape in shapes:
        parts.append(flat[at : at + math.prod(shape)].reshape(shape).astype(np.float32))
        at += math.prod(shape)
    n = len(WIDTHS)
    return parts[0], parts[1 : 1 + n], parts[1 + n : 1 + 2 * n], parts[-2], parts[-1]


class Scorer:
    """Probabilities and languages of texts; remembers the filters' responses to words."""

    def __init__(self, model: tuple):
        self.embedding, filters, biases, self.out, self.bias = model
        # One block of columns for each place and width that reaches it: those of a place end with the widest.
        self.matrix = np.concatenate([f[j] for j in range(max(WIDTHS)) for f in filters if j < len(f)], 1)
        self.start = np.concatenate(biases)
        self.responses = None
        self.forget()

    def forget(self) -> None:
        """Room for the words to remember is taken once, as tables that grow by copies leave holes in a worker's memory."""
        self.index, self.known = numbering(), 0
        if self.responses is None or len(self.responses) > 1 + REMEMBERED:
            self.responses = np.zeros((1 + REMEMBERED, self.matrix.shape[1]), np.float32)  # row 0: no word
            self.said = np.zeros((1 + REMEMBERED, len(FUNCTION_WORDS)), bool)

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > REMEMBERED:
            self.forget()
        index, known, rows = self.index, len(self.index), []
        for text in texts:
            rows.append(np.array(list(map(index.__getitem__, plain_words(text))), np.int64))
        fresh = list(index)[known:] if len(index) > known else []
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            self.learn(np.array([buckets_of(w) for w in some]), languages_of_all(some))
        return self.scored(rows)

    def learn(self, buckets: np.ndarray, said: np.ndarray) -> None:
        """Further words, which get the next numbers."""
        at, self.known = self.known + 1, self.known + len(buckets)
        if self.known >= len(self.responses):
            more = max(self.known + 1, 2 * len(self.responses)) - len(self.responses)
            self.responses, self.said = (np.concatenate((x, np.zeros((more, x.shape[1]), x.dtype))) for x in (self.responses, self.said))
        self.responses[at : self.known + 1] = word_vectors(self.embedding, buckets) @ self.matrix
        self.said[at : self.known + 1] = said

    def scored(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        """As probabilities, of texts whose words are numbered."""
        peaks = np.zeros((len(rows), len(self.out)), np.float32)
        hits = np.zeros((len(rows), len(FUNCTION_WORDS)), np.int64)
        for i, row in enumerate(rows):
            best = np.full(len(self.out), -np.inf, np.float32)
            for at in range(0, max(1, len(row)), 1 << 16):
                ids = row[at : at + (1 << 16) + max(WIDTHS) - 1].astype(np.int64) + 1
                n = max(1, min(len(row) - at, 1 << 16))
                ids = np.concatenate((ids, np.zeros(n + max(WIDTHS) - 1 - len(ids), np.int64)))
                response, column = self.responses[ids], len(self.out)
                total = response[:n, :column]
                for j in range(1, max(WIDTHS)):
                    wide = FILTERS * sum(w > j for w in WIDTHS)
                    total[:, -wide:] += response[j : n + j, column : column + wide]
                    column += wide
                best = np.maximum(best, total.max(0))
                hits[i] += self.said[ids[:n]].sum(0)
            peaks[i] = best + self.start
        z = np.maximum(peaks, 0) @ self.out + self.bias[0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))), language_numbers(hits)


def threshold(p: np.ndarray, labels: np.ndarray, weights: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The cut with the least weighted errors, in the middle of its gap; the widest gap of equal ones. ``counts``: rows that each value stands for."""
    order = np.argsort(p, kind="stable")
    w = weights[labels[order]] * np.where(labels[order] == 1, 1.0, -1.0) * (1 if counts is None else counts[order])
    p = p[order]
    cost = np.concatenate(([0.0], np.cumsum(w)))  # marking all from place i on as 1, against marking all
    edges = np.concatenate(([0.0], p, [1.0]))
    gaps = np.where(np.diff(edges) > 0, np.diff(edges), -1)
    good = np.flatnonzero((cost <= cost[gaps > 0].min() + 1e-12) & (gaps > 0))
    i = good[gaps[good].argmax()]
    return float(np.clip((edges[i] + edges[i + 1]) / 2, 0.02, 0.98))


def fit(texts: list[str], labels: np.ndarray, prior: float) -> tuple:
    """(model, threshold of each language) from some texts at hand; ``prior`` is the share of label 1 outside them."""
    found, number = Texts(texts), np.arange(len(texts))
    shuffled = np.random.default_rng(3).permutation(number)
    taken = np.bincount(labels, minlength=2) / len(labels)
    true_share = np.array([1 - prior, prior]) / taken
    balance = 0.5 / taken
    kept = shuffled[: len(shuffled) // 5]
    model = train(found, labels, shuffled[len(shuffled) // 5 :], balance)
    p, language = Scorer(model).probabilities([texts[i] for i in kept])
    overall = threshold(p, labels[kept], true_share) if len(set(labels[kept])) == 2 else 0.5
    cuts = []
    for number in range(len(LANGUAGES)):
        own = language == number
        enough = own.any() and np.bincount(labels[kept][own], minlength=2).min() >= 20
        cuts.append(threshold(p[own], labels[kept][own], true_share) if enough else overall)
    return model, np.array(cuts)


def bent(p: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Probabilities with the cut moved to 0.5, linear below and above it."""
    return np.where(p < cut, 0.5 * p / cut, 0.5 + 0.5 * (p - cut) / (1 - cut))


def fitting_sample(corpus: DataFrame, labels: DataFrame, label: str) -> list:
    """doc_id, label, text of the sample's rows in hash order, as many whole texts as SAMPLE_BYTES hold; one that doesn't fit is passed over."""
    sample = cut_lineage(labelled_sample(corpus, labels, label, SAMPLE).withColumn("bytes", F.octet_length("text").cast("long")))
    order = [F.xxhash64("doc_id", "label"), F.col("doc_id")]
    room, chosen = SAMPLE_BYTES, []
    for r in sample.select("doc_id", "label", "bytes").orderBy(*order).collect():  # SAMPLE short rows
        if r["bytes"] <= room:
            room -= r["bytes"]
            chosen.append((r["doc_id"], r["label"]))
    if len(chosen) < SAMPLE and sample.count() > len(chosen):
        sample = sample.join(F.broadcast(sample.sparkSession.createDataFrame(chosen, sample.select("doc_id", "label").schema)), ["doc_id", "label"])
    return sample.orderBy(*order).collect()


def _summed(rows: DataFrame, tasks: int) -> DataFrame:
    """rows(block, sums) of float32 blocks, those of a block added up; in two levels, so no task meets the rows of all others."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(sums.as_buffer(), np.float32)
                total[block] = total[block] + values if block in total else values.astype(np.float64)
        yield from _blocks(total)

    schema = "block int, sums binary"
    return rows.repartition(max(1, math.isqrt(tasks))).mapInArrow(lean(add), schema).repartition(1).mapInArrow(lean(add), schema)


def _blocks(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], ["block", "sums"])


def _cut_up(flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    return _blocks({at // BLOCK: flat[at : at + BLOCK] for at in range(0, len(flat), BLOCK)})


def _gathered(rows: DataFrame, tasks: int) -> np.ndarray:
    found = {r["block"]: np.frombuffer(r["sums"], np.float32) for r in _summed(rows, tasks).collect()}  # as many rows as blocks
    return np.concatenate([found[b] for b in sorted(found)])


def labelled_rows(corpus: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, label of all labelled rows. A doc_id counts once for each label it has; of the rows that carry it the text with the least hash is taken."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    own = corpus.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Copies of a doc_id meet in a combined aggregation, after those without a label have gone.
    own = own.join(known.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return own.join(known, "doc_id").select("doc_id", "text", "label")


def _dealt(corpus: DataFrame, labels: DataFrame, label: str, shards: int) -> DataFrame:
    """shard, held, words, lengths, marks, buckets, said: the labelled rows as word numbers, in pieces of PIECE words, written.

    Labels and texts meet in the shuffle that deals them, so each text crosses once, as a zstd frame. A shard is of doc_ids; its words are
    numbered from 0 (in each piece, where kept from training), and a piece holds buckets and languages of the words that are new in it. Rows
    are those of labelled_rows.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    texts = corpus.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def pressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict = {}
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] not in best or row[:0:-1] < best[row[0]][:0:-1]:
                    best[row[0]] = row
            ids, found, hashes = zip(*best.values(), strict=True) if best else ((), (), ())
            frames = [zstandard.compress(t.encode("utf-8", "surrogatepass"), 3) for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema[0].type), pa.array(hashes, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "hash", "frame"])

    frames = small_batches(texts).mapInArrow(lean(pressed), f"doc_id {kind}, hash long, frame binary")
    held = F.pmod(F.xxhash64(F.lit("held"), F.xxhash64("doc_id", "label")), F.lit(HELD_BACK)) == 0
    marks = known.withColumn("doc_id", F.col("doc_id").cast(kind)).select("doc_id", F.lit(None).cast("long").alias("hash"), F.lit(None).cast("binary").alias("frame"), "label", held.alias("held"))
    both = frames.select("*", F.lit(None).cast("int").alias("label"), F.lit(None).cast("boolean").alias("held")).unionByName(marks)
    at = F.xxhash64("doc_id")
    both = both.select(F.pmod(at, F.lit(shards)).cast("int").alias("shard"), at.alias("at"), "doc_id", "label", "held", "hash", "frame")
    # Of a doc_id the labels come first, then the text with the least hash.
    both = both.repartition(shards, "shard").sortWithinPartitions("shard", "at", "doc_id", F.col("label").isNull(), "label", "hash", "frame").drop("at", "hash")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name, own, open_ = None, None, [], {}
        for batch in batches:
            for at, doc, value, kept, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    for piece in open_.values():
                        yield from piece.out()
                    shard, open_ = at, {k: _Piece(at, k) for k in (False, True)}
                    name = None
                if name != (doc,):
                    name, own = (doc,), []
                if value is not None:
                    own.append((value, kept))
                elif own:
                    text = zstandard.decompress(frame).decode("utf-8", "surrogatepass")
                    for value, kept in own:
                        yield from open_[kept].add(text, value)
                    own = []
        for piece in open_.values():
            yield from piece.out()

    schema = "shard int, held boolean, words binary, lengths binary, marks binary, buckets binary, said binary"
    return cut_lineage(both.mapInArrow(lean(pack), schema))


class _Piece:
    """Gathers the texts of a shard (those kept from training, or the others) and gives them out in rows of about PIECE words."""

    def __init__(self, shard: int, held: bool):
        self.shard, self.held, self.index, self.known = shard, held, numbering(), 0
        self.rows, self.marks, self.n = [], [], 0

    def add(self, text: str, mark: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(Texts.numbered(text, self.index))
        self.marks.append(mark)
        self.n += len(self.rows[-1])
        if self.n >= PIECE:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.marks:
            return
        fresh = list(islice(self.index, self.known, None))
        buckets = np.array([buckets_of(w) for w in fresh], np.uint16).reshape(-1, 1 + len(PREFIXES))
        said = languages_of_all(fresh)
        parts = [np.concatenate(self.rows), np.array([len(r) for r in self.rows], np.int64), np.array(self.marks, np.int8), buckets.T, said]
        columns = [pa.array([self.shard], pa.int32()), pa.array([self.held])] + [pa.array([zstandard.compress(np.ascontiguousarray(p).tobytes(), 3)], pa.binary()) for p in parts]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "held", "words", "lengths", "marks", "buckets", "said"])
        if self.held:  # each piece stands for itself, as a scorer's memory grows with its words
            self.index.clear()
        self.known, self.rows, self.marks, self.n = len(self.index), [], [], 0


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, word numbers of each text, labels, buckets and languages of the new words) of each row of _dealt."""
    kinds = (np.int32, np.int64, np.int8, np.uint16, bool)
    for batch in batches:
        for shard, _, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words, lengths, marks, buckets, said = (np.frombuffer(zstandard.decompress(p), k) for p, k in zip(parts, kinds, strict=True))
            yield shard, np.split(words, np.cumsum(lengths)[:-1]), marks.astype(np.int64), buckets.reshape(1 + len(PREFIXES), -1).T, said.reshape(-1, len(FUNCTION_WORDS))


def _by_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Texts, np.ndarray]]:
    """Each shard's texts as word numbers, and their labels."""

    def whole() -> tuple[Texts, np.ndarray]:
        return Texts.of(rows, np.concatenate(buckets).astype(np.int64)), np.concatenate(marks)

    at, rows, marks, buckets = None, [], [], []
    for shard, words, own, fresh, _ in _pieces(batches):
        if shard != at:
            if marks:
                yield whole()
            at, rows, marks, buckets = shard, [], [], []
        rows += words
        marks.append(own)
        buckets.append(fresh)
    if marks:
        yield whole()


def learned(corpus: DataFrame, labels: DataFrame, label: str) -> tuple | None:
    """(model, threshold of each language) from all labelled rows; None without both labels."""
    spark = corpus.sparkSession
    digest = F.xxhash64("doc_id", "label")
    # For the sizes a text stands as its number of bytes, so texts don't move; of a doc_id that several rows carry it is that of any.
    rows = labelled_rows(corpus.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("string").alias("text")), labels, label)
    rows = rows.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), digest), F.lit(HELD_BACK)) == 0)
    with swept_shuffles(spark):
        seen = {(r["label"], r["held"]): (r["n"], r["bytes"]) for r in rows.groupBy("label", "held").agg(F.count("*").alias("n"), F.sum(F.col("text").cast("long")).alias("bytes")).collect()}
    sizes = np.array([sum(n for (value, _), (n, _) in seen.items() if value == y) for y in (0, 1)], np.float64)
    taught = [sum(seen.get((y, False), (0, 0))[k] for y in (0, 1)) for k in (0, 1)]
    if not sizes.all() or not all(seen.get((y, False), (0, 0))[0] for y in (0, 1)):
        return None
    taken = sizes / sizes.sum()
    prior = float(labels.filter(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0])
    shards = max(1, -(-taught[0] // SAMPLE), -(-taught[1] // SAMPLE_BYTES))
    every = _dealt(corpus, labels, label, shards)
    dealt = every.filter("not held")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, BUCKETS), np.float64)
        for texts, marks in _by_shard(batches):
            count_buckets(texts, marks, found)
        yield from _cut_up(found.ravel())

    counts = _gathered(dealt.mapInArrow(lean(count), "block int, sums binary"), shards).astype(np.float64).reshape(2, BUCKETS)
    rng = np.random.default_rng(8)
    model = start_model(log_odds(counts, np.array([seen[y, False][0] for y in (0, 1)], np.float64), rng), rng)
    weights, passes, size = 0.5 / taken, PASSES if shards == 1 else 1, BUCKETS * AXES
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(packed(model))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for texts, marks in _by_shard(batches):
                order = np.random.default_rng(3).permutation(len(marks))
                moved = packed(descend(unpacked(shared.value), texts, marks, order, weights, passes)) - shared.value
                changed = (moved[:size].reshape(BUCKETS, AXES) != 0).any(1)
                yield from _cut_up(np.concatenate((moved, changed, [1.0])))

        sums = _gathered(dealt.mapInArrow(lean(run), "block int, sums binary"), shards)
        copies = np.maximum(sums[-1 - BUCKETS : -1], 1)
        moved = np.concatenate(((sums[:size].reshape(BUCKETS, AXES) / copies[:, None]).ravel(), sums[size : -1 - BUCKETS] / sums[-1]))
        model = unpacked(shared.value + moved)
        shared.unpersist()
    return model, _cuts(every.filter("held"), model, np.array([1 - prior, prior]) / taken)


def _cuts(held: DataFrame, model: tuple, weights: np.ndarray) -> np.ndarray:
    """The threshold of each language on rows kept from training; that of all where a language has under 20 of either label, 0.5 without both labels."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for _, words, marks, buckets, said in _pieces(batches):
            scorer.forget()
            scorer.learn(buckets.astype(np.int64), said)
            p, language = scorer.scored(words)
            yield pa.RecordBatch.from_arrays([pa.array(marks.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(np.minimum(p * STEPS, STEPS - 1).astype(np.int32))], ["label", "language", "step"])

    found = held.mapInArrow(lean(run), "label int, language int, step int").groupBy("label", "language", "step").count().collect()  # at most one row a label, language and step
    label, language, step, n = np.array([tuple(r) for r in found], np.int64).reshape(-1, 4).T
    p = (step + 0.5) / STEPS
    overall = threshold(p, label, weights, n) if len(set(label.tolist())) == 2 else 0.5
    cuts = []
    for number in range(len(LANGUAGES)):
        own = language == number
        enough = np.bincount(label[own], n[own], 2).min() >= 20
        cuts.append(threshold(p[own], label[own], weights, n[own]) if enough else overall)
    return np.array(cuts)


def score_toxicity(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",), label: str = "toxic") -> DataFrame:
    """Columns ``keep``, score, predicted of every document; learns from all rows of ``labels`` it is given.

    ``corpus`` (docs unless given) holds the labelled texts.
    """
    unclashing(keep, "score", "predicted")
    fitted = learned(docs if corpus is None else corpus, labels, label)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value and Scorer(shared.value[0])
        for batch in batches:
            found = np.zeros(batch.num_rows)
            if scorer:
                p, language = scorer.probabilities(batch.column(len(keep)).to_pylist())
                found = bent(p, shared.value[1][language])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    source = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    kinds = "".join(f"`{name}` {source.schema[name].dataType.simpleString()}, " for name in keep)
    return small_batches(source).mapInArrow(lean(score), kinds + "score double, predicted int")
