"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Every document's word n-grams are looked up among the benchmark's. Around its hits a
   document gives passages, as long as the longest item on either side.
2. A passage and an item with any n-gram in common are a pair, however frequent the n-gram
   is: an edited copy may hold only n-grams that other copies hold, too. Pairs with too few
   words in common to reach the similarity aren't aligned.
3. Each pair is aligned word by word (local alignment with gaps). The score, divided by that
   of a perfect copy, is the similarity; edited and paraphrased copies lose in proportion.

Words: lower case, ASCII punctuation dropped. Defined results: null and
empty texts have no words and match nothing; an item of fewer than N words is found where
a document has all of its words in a row (an edit would leave too little to tell); a passage
in several places of a document counts once, with its best alignment; items with the same
item_id are aligned each and the best counts; repeated documents come out once for each
doc_id and item. Empty tables give empty tables; other columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamina.llm.batches import lean, small_batches
from lamina.llm.features import plain_words
from lamina.session import cut_lineage

#: Words of an n-gram.
N = 4
#: Similarity from which a document counts as contaminated.
SIMILARITY = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Benchmark n-grams that are sent to every task (8 bytes each); beyond that only a bit table of BITS bits is.
SENT, BITS, PIECES = 2_000_000, 1 << 26, 8


def grams(words: list[bytes], n: int = N) -> np.ndarray:
    """Signed 64-bit hashes of a text's word n-grams, in order; of other lengths than N they differ."""
    if len(words) < n:
        return np.zeros(0, np.int64)
    x = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    out = np.full(len(words) - n + 1, N - n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + x[k : len(words) - n + 1 + k]
    out ^= out >> np.uint64(31)
    return out.view(np.int64)


class Known:
    """Which n-grams the benchmark has: a bit table, then the sorted hashes where these are few enough."""

    def __init__(self, hashes: np.ndarray | None, bits: np.ndarray):
        self.hashes, self.bits = hashes, bits

    @staticmethod
    def places(hashes: np.ndarray) -> np.ndarray:
        return (hashes.view(np.uint64) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - (BITS.bit_length() - 1))

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of those hashes that the benchmark has (with only the bit table: may have)."""
        at = self.places(hashes)
        found = np.flatnonzero(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
        if self.hashes is not None and len(found):
            place = np.searchsorted(self.hashes, hashes[found])
            found = found[self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes[found]]
        return found


def benchmark_grams(items: DataFrame) -> DataFrame:
    """item, at, gram and the item's number of words; ``item`` numbers the rows of the benchmark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = plain_words(text.lower())
                found = grams(words, min(N, max(1, len(words))))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(found), pa.array([len(words)] * len(found), pa.int32())], ["item", "at", "gram", "words"])

    return small_batches(items.select("item", "text")).mapInArrow(lean(run), "item long, at int, gram long, words int")


def known_grams(found: DataFrame) -> tuple[Known, int, list[int]]:
    """The look-up table of the benchmark's n-grams, its longest item's words, and the lengths of n-grams in it."""
    distinct = found.select("gram").distinct()
    number, longest = distinct.count(), found.agg(F.max("words")).first()[0] or 0
    lengths = sorted(r["n"] for r in found.select(F.least("words", F.lit(N)).alias("n")).distinct().collect())
    table = np.zeros(BITS // 8, np.uint8)
    if number <= SENT:
        hashes = np.sort(distinct.toArrow().column(0).to_numpy())
        at = Known.places(hashes)
        np.bitwise_or.at(table, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
        return Known(hashes, table), longest, lengths

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = Known.places(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(3)).astype(np.int64)), pa.array(1 << (at & np.uint64(7)).astype(np.int32))], ["byte", "bit"])

    bits = distinct.mapInArrow(lean(run), "byte long, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    for part in range(PIECES):  # BITS / 8 / PIECES rows at most at a time
        piece = bits.filter(F.col("byte") % PIECES == part).toArrow()
        table[piece.column("byte").to_numpy()] = piece.column("bits").to_numpy().astype(np.uint8)
    return Known(None, table), longest, lengths


def passages(docs: DataFrame, known: Known, longest: int, lengths: list[int]) -> DataFrame:
    """doc_id, start, text (words), hits (n-grams) of every stretch around hits; overlapping stretches are one."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, starts, texts, hits = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = plain_words(text.as_py().lower())
                met = [(at, found[at]) for n in lengths for found in [grams(words, n)] for at in [known.hits(found)] if len(at)]
                if not met:
                    continue
                at, found = np.concatenate([a for a, _ in met]), np.concatenate([g for _, g in met])
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[order]
                cuts = np.flatnonzero(np.diff(at) > 2 * longest) + 1
                for part, own in zip(np.split(at, cuts), np.split(found, cuts), strict=True):
                    start = max(0, int(part[0]) - longest)
                    ids.append(doc_id)
                    starts.append(start)
                    texts.append(b" ".join(words[start : int(part[-1]) + N + longest]).decode("utf-8", "replace"))
                    hits.append(np.unique(own))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(starts, pa.int32()), pa.array(texts), pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "start", "text", "hits"])

    source = small_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lean(run), f"doc_id {kind}, start int, text string, hits array<long>")


def shared_pairs(found: DataFrame, hits: DataFrame) -> DataFrame:
    """passage, item: every pair that has an n-gram in common."""
    return hits.join(found.select("gram", "item").distinct(), "gram").select("passage", "item").distinct()


def can_reach(item: list[bytes], passage: set[bytes], similarity: float) -> bool:
    """Whether an alignment can have this similarity: no word scores more than MATCH, and only those in both texts score."""
    return sum(w in passage for w in item) >= similarity * max(1, len(item))


def align(item: list[bytes], passage: list[bytes]) -> tuple[int, int]:
    """Best local alignment's score and the place in the passage where it ends."""
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    b = np.array([number.get(w, -1) for w in passage], np.int64)
    slope = np.arange(len(b) + 1) * -GAP
    row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for word in item:
        now = np.zeros_like(row)
        now[1:] = np.maximum(row[:-1] + np.where(b == number[word], MATCH, MISMATCH), row[1:] + GAP)
        now = np.maximum(np.maximum.accumulate(now + slope) - slope, 0)  # gaps in the item
        row = now
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, end_word of each item that a document holds a copy of."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("item", F.monotonically_increasing_id())
    items = cut_lineage(items)
    found = cut_lineage(benchmark_grams(items))
    known, longest, lengths = known_grams(found)
    stretch = cut_lineage(passages(docs, known, longest, lengths).withColumn("passage", F.monotonically_increasing_id()))
    hits = stretch.select("passage", F.explode("hits").alias("gram"))
    pairs = shared_pairs(found, hits)
    pairs = pairs.join(stretch.select("passage", "doc_id", "start", F.col("text").alias("own")), "passage").join(items, "item")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, ends = [], []
            for start, own, text in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                words, passage = plain_words(text.lower()), own.encode().split()
                needed = similarity if len(words) >= N else 1.0
                best, end = align(words, passage) if can_reach(words, set(passage), needed) else (0, 0)
                best = best if best >= needed * MATCH * len(words) else 0
                scores.append(best / (MATCH * max(1, len(words))))
                ends.append(start + end)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array(ends, pa.int64())], ["doc_id", "item_id", "similarity", "end_word"])

    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    scored = pairs.select("doc_id", "item_id", "start", "own", "text").mapInArrow(lean(run), f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, end_word long")
    best = scored.filter(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "end_word")).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", "best.end_word")
