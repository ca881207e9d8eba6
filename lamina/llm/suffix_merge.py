"""Repeated byte strings of a corpus, from the merged Burrows-Wheeler transforms of its shards.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. The texts are parsed into phrases at
anchors, places whose hash is the least around, so that equal strings have equal anchors except near their ends. Each
shard (a bounded run of distinct texts) keeps the transform of its phrase sequence: its suffixes in order, and for each the
symbol before it. The shards' transforms are merged by refining their interleave: the suffixes of all shards that share
their first k phrases form a block of the merged order; a shard reads its own transform in the order of its blocks and
asks for (symbol before, block), the blocks of the same pair join in the order of symbol and block, and these are the
blocks of suffixes that share k + 1 phrases. No suffix is ever compared or sorted again. A suffix leaves when nobody shares its
block, so a round costs what is still repeated; the round in which a block parts gives its common prefix in phrases.

What the merge yields for every anchor: the block of the phrases within SHORT bytes (the common prefix that any repeated
string led by the anchor must have), and the block of enough phrases to cover all strings that start before the next
anchor. Where the latter is shared all those strings are repeated, and only the first member of the block speaks for them.
The strings at the ends of repeated intervals are told apart by the bytes before the first and after the last phrase:
they are counted by block and hash of the string.

Texts move once, as zstd frames, one for each distinct text; what then crosses shuffles are pairs of numbers, at most one
row for each shard and pair, so a passage that a third of all texts hold is no hot key. Strings without a usable anchor (long
gaps, periodic text) are counted by two hashes.

Defined results: a null text is empty; texts shorter than ``length`` keep all bytes; of two or more equal texts that are not
shorter all bytes go. Rows count by their texts, so null or repeated doc_ids make no difference. Texts are read whole: one
that is longer than a shard is a shard of its own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from lamina.llm.batches import small_batches
from lamina.llm.components import join_crowded
from lamina.session import cut_lineage, remove_folder, shared_root, swept_shuffles

#: Bytes that an anchor's hash covers, and how far around it no hash is smaller.
GRAM, AROUND = 8, 24
#: Bytes after an anchor within which its short run of phrases ends, for strings of 400; shorter strings take a share.
SHORT = 160
#: Bytes of text of a shard, about.
SHARD_BYTES = 4 << 20
#: Two odd bases modulo 2**64; bytes stand for fixed 64-bit values drawn from a seed.
BASE, OTHER = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
VALUES = np.random.default_rng(400).integers(1, 1 << 63, 256).astype(np.uint64)
NONE = np.uint32(0xFFFFFFFF)

_powers: dict[int, np.ndarray] = {}


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in ``data`` whose gram hash is less than all AROUND before and no more than all AROUND after, within their text.

    Texts stand in data with at least AROUND + GRAM other bytes between them.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    grams = np.zeros(n, np.uint64)
    for i in range(GRAM):
        grams |= padded[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    grams *= np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    h = (grams >> np.uint64(32)).astype(np.uint32)
    del grams
    inside = np.zeros(n + 1, np.int8)
    long = ends - starts >= GRAM
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - GRAM + 1, -1)
    h[np.cumsum(inside[:n], dtype=np.int8) == 0] = NONE
    wide = np.concatenate((np.full(AROUND, NONE), h, np.full(AROUND + 1, NONE)))
    low, span = wide, 1
    while span * 2 <= AROUND:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    low = np.minimum(low[: len(low) - (AROUND - span)], low[AROUND - span :])
    before, after = low[:n], low[AROUND + 1 : AROUND + 1 + n]
    return np.flatnonzero((h < before) & (h <= after) & (h != NONE))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept by the worker and grown by doubling."""
    found = _powers.get(base, np.ones(1, np.uint64))
    while len(found) < n:
        found = np.concatenate((found, found * np.uint64(pow(base, len(found), 1 << 64))))
    _powers[base] = found
    return found[:n]


def string_hashes(data: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """64-bit polynomial hashes of all strings of ``length`` bytes; only strings of one block are ever compared by them."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(VALUES[data] * powers(base, n), out=sums[1:])
    return (sums[length:] - sums[:-length]) * powers(pow(base, -1, 1 << 64), n - length + 1)


def bounds(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the texts of a shard start and end in its bytes."""
    starts = np.concatenate(([0], np.cumsum(lengths + AROUND + GRAM)[:-1]))
    return starts, starts + lengths


class Shard:
    """The texts of a shard, or only where they lie, with their anchors, phrases and runs."""

    def __init__(self, row: dict, length: int):
        self.length = length
        self.short = SHORT * length // 400
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.copies = np.frombuffer(row["copies"], np.int8)
        self.starts, self.ends = bounds(self.lengths)
        self.size = int(self.ends[-1]) + AROUND + GRAM
        if "blob" in row:
            self.raw = zstandard.ZstdDecompressor().decompress(row["blob"])
            self.data = np.frombuffer(self.raw, np.uint8)
        self.at = np.frombuffer(row["anchors"], np.int32).astype(np.int64)
        #: Text of each anchor; the last anchor of a text has no phrase, as no anchor ends it.
        self.text = np.searchsorted(self.starts, self.at, "right") - 1
        n = len(self.at)
        self.phrase = np.zeros(n, bool)
        self.phrase[:-1] = self.text[1:] == self.text[:-1]
        self.after = np.where(self.phrase, np.append(self.at[1:], 0), self.at)

    def digests(self) -> np.ndarray:
        """16 bytes for each phrase, in the order of the anchors that have one."""
        view, digest = memoryview(self.raw), xxhash.xxh3_128_digest
        which = np.flatnonzero(self.phrase)
        return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(self.at[which].tolist(), self.after[which].tolist(), strict=True)]), "S16")

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of the short and of the long run of each anchor; 0 where there is none."""
        last = np.searchsorted(self.text, self.text, "right") - 1  # last anchor of the text
        index = np.arange(len(self.at))
        short = np.minimum(np.searchsorted(self.at, self.at + self.short, "right") - 1, last) - index
        stop = np.searchsorted(self.at, self.after + self.length - 1, "left")
        long = np.where(self.phrase & (stop <= last), stop - index, 0)
        return short.astype(np.int16), long.astype(np.int16)


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        seen: dict[bytes, list] = {}
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest in seen:
                seen[digest][1] = 2
            else:
                seen[digest] = [pack(text.encode()), 1]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array([x[0] for x in seen.values()], pa.binary()), pa.array([x[1] for x in seen.values()], pa.int64())], ["digest", "packed", "copies"])


SHARDS = "shard long, digests binary, lengths binary, copies binary, blob binary, anchors binary"


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
    number = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    size = 0

    def row() -> pa.RecordBatch:
        between = bytes(AROUND + GRAM)
        raw = b"".join(x for h in held for x in (h[1], between))
        lengths = np.array([len(h[1]) for h in held], np.int64)
        at = anchors(np.frombuffer(raw, np.uint8), *bounds(lengths)).astype(np.int32)
        cells = (number, b"".join(h[0] for h in held), lengths.tobytes(), np.array([min(2, h[2]) for h in held], np.int8).tobytes(), pack(raw), at.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], ["shard", "digests", "lengths", "copies", "blob", "anchors"])

    for batch in batches:
        for digest, packed, copies in zip(*(batch.column(c).to_pylist() for c in ("digest", "packed", "copies")), strict=True):
            text = unpack(packed)
            if held and size + len(text) > SHARD_BYTES:
                yield row()
                held, size, number = [], 0, number + 1
            held.append((digest, text, copies))
            size += len(text)
    if held:
        yield row()


STATE = "shard long, active long, idx binary, symbol binary, need binary, short binary, long binary, copies binary, block binary, short_block binary, long_block binary, speaks binary"
KINDS = {"idx": np.int32, "symbol": np.int64, "need": np.int16, "short": np.int16, "long": np.int16, "copies": np.int8, "block": np.int64, "short_block": np.int64, "long_block": np.int64, "speaks": np.int8}


class Suffixes:
    """A shard's part of the merged transform: the suffixes that begin with a repeated phrase, in the order of the text.

    ``block`` is a suffix's place in the interleave, 0 once nobody shares it; short_block and long_block are kept when
    the depth of a run is reached.
    """

    def __init__(self, **arrays: np.ndarray):
        for name, kind in KINDS.items():
            setattr(self, name, np.ascontiguousarray(arrays[name], kind))

    @classmethod
    def read(cls, row: dict) -> Suffixes:
        return cls(**{name: np.frombuffer(row[name], kind) for name, kind in KINDS.items()})

    def row(self, shard: int) -> pa.Table:
        cells = [shard, int((self.block > 0).sum()), *[getattr(self, name).tobytes() for name in KINDS]]
        return pa.table([pa.array([c]) for c in cells], ["shard", "active", *KINDS])

    def asked(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Reads the transform in the order of the interleave: the suffixes before it, each one's pair, and the distinct (symbol, block).

        The suffix before one of block b that begins with symbol c comes to the place of (c, b); within a symbol the order
        of the blocks stays, so a stable sort by symbol is all.
        """
        order = np.argsort(self.block, kind="stable")
        order = order[self.block[order] > 0]
        order = order[order > 0]
        before = order - 1
        linked = (self.idx[before] + 1 == self.idx[order]) & (self.need[before] >= depth)
        before, order = before[linked], order[linked]
        turn = np.argsort(self.symbol[before], kind="stable")
        before, symbols, blocks = before[turn], self.symbol[before[turn]], self.block[order[turn]]
        new = np.ones(len(before), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (blocks[1:] != blocks[:-1])
        return before, np.cumsum(new) - 1, symbols[new], blocks[new]

    def refined(self, depth: int, before: np.ndarray, at: np.ndarray, found: pa.Table, pairs: int) -> None:
        """Moves suffixes to their blocks of this depth; found tells of a pair its block and whether its first member is here."""
        which = found.column("at").to_numpy()
        told = {}
        for name, kind in (("block", np.int64), ("lead", bool)):
            by_pair = np.zeros(pairs, kind)
            by_pair[which] = found.column(name).to_numpy()
            told[name] = np.zeros(len(self.block), kind)
            told[name][before] = by_pair[at]
        self.block = told["block"]
        self.settle(depth, told["lead"])

    def settle(self, depth: int, lead: np.ndarray) -> None:
        self.short_block = np.where(self.short == depth, self.block, self.short_block)
        ends = (self.long == depth) & (self.block > 0)
        self.long_block = np.where(ends, self.block, self.long_block)
        here = np.flatnonzero(ends & lead)
        speaks = self.speaks.copy()
        speaks[here[np.unique(self.block[here], return_index=True)[1]]] = 1
        self.speaks = speaks


def _first_suffixes(shard: Shard, found: pa.Table) -> Suffixes:
    """Suffixes by their first phrase alone: the blocks are the symbols' buckets."""
    digests, at = np.unique(shard.digests(), return_inverse=True)
    told = np.frombuffer(b"".join(found.column("digest").to_pylist()), "S16")
    where = np.searchsorted(digests, told)
    n = len(shard.at)
    full = {}
    for name, kind in (("symbol", np.int64), ("lead", bool)):
        by_digest = np.zeros(len(digests), kind)
        by_digest[where] = found.column(name).to_numpy()
        full[name] = np.zeros(n, kind)
        full[name][shard.phrase] = by_digest[at]
    short, long = shard.runs()
    index = np.arange(n)
    # A suffix is followed as deep as its own runs go, and as the runs of the suffixes before it need.
    need = np.maximum.accumulate(np.maximum(short, long) + index) - index if n else index
    symbol = full["symbol"]
    kept = np.flatnonzero(symbol > 0)
    zero = np.zeros(len(kept), np.int64)
    out = Suffixes(idx=kept, symbol=symbol[kept], need=need[kept], short=short[kept], long=long[kept], copies=shard.copies[shard.text[kept]], block=symbol[kept], short_block=zero, long_block=zero, speaks=zero)
    out.settle(1, full["lead"][kept])
    return out


def _between(size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Marks of the places from low to high, both included; ranges may overlap, empty ones count for nothing."""
    some = low <= high
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, low[some], 1)
    np.add.at(steps, high[some] + 1, -1)
    return np.cumsum(steps[:size]) > 0


def _open_strings(shard: Shard, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(certain, open, blocks); strings stand for their starts in the shard's bytes.

    ``certain`` marks strings that lie within a shared long run. ``open`` are those that may be repeated and are not spoken
    for by another member of such a run, ``blocks`` those of the short runs that lead them, 0 where no anchor can.
    """
    length, n, size = shard.length, len(shard.at), shard.size
    short, _ = shard.runs()
    full = {name: np.zeros(n, kind) for name, kind in (("short_block", np.int64), ("long_block", np.int64), ("speaks", bool))}
    for name, values in full.items():
        values[suffixes.idx] = getattr(suffixes, name)
    reach = length - shard.short - AROUND - GRAM
    stop = shard.ends - length
    # Strings that are led by each anchor with a short run: from the one before it on, if the run lies within the string.
    runs = np.flatnonzero(short > 0)
    place, text = shard.at[runs], shard.text[runs]
    first = np.ones(len(runs), bool)
    first[1:] = text[1:] != text[:-1]
    low = np.where(first, shard.starts[text], np.append(0, place[:-1])[: len(runs)] - AROUND + 1)
    low = np.maximum(low, shard.starts[text])
    high = np.minimum(place - AROUND, stop[text])
    shared = full["short_block"][runs] > 0
    # All short runs within a string must be shared: it ends before the next one that isn't.
    lone = np.append(np.where(shared, size + length, place), size + length)
    lone_text = np.append(text, -1)
    following = np.minimum.accumulate(np.where(shared, len(runs), np.arange(len(runs)))[::-1])[::-1] if len(runs) else np.zeros(0, np.int64)
    limit = np.where(lone_text[following] == text, lone[following] - reach - 1, size)
    # And those without such an anchor.
    last = np.searchsorted(text, np.arange(len(shard.lengths)), "right") - 1
    some = (last >= 0) & (text[np.maximum(last, 0)] == np.arange(len(shard.lengths))) if len(runs) else np.zeros(len(shard.lengths), bool)
    tail = np.where(some, np.maximum(place[np.maximum(last, 0)] - AROUND + 1, shard.starts) if len(runs) else shard.starts, shard.starts)
    open_low, open_high = np.maximum(low, place - reach), np.minimum(high, limit)
    wanted = _between(size, np.concatenate((open_low[shared], low, tail)), np.concatenate((open_high[shared], np.minimum(high, place - reach - 1), stop)))
    sure = np.flatnonzero(full["long_block"] > 0)
    certain = _between(size, shard.at[sure], shard.after[sure] - 1)
    dumb = sure[~full["speaks"][sure]]
    silent = _between(size, shard.at[dumb], shard.after[dumb] - 1)
    open_at = np.flatnonzero(wanted & ~silent)
    blocks = np.zeros(len(open_at), np.int64)
    if len(runs):
        lead = np.searchsorted(place, open_at + AROUND)
        inside = lead < len(runs)
        lead = np.minimum(lead, len(runs) - 1)
        of = np.searchsorted(shard.starts, open_at, "right") - 1
        led = inside & (text[lead] == of) & (place[lead] - open_at <= reach)
        blocks = np.where(led, full["short_block"][runs][lead], 0)
    return certain, open_at, blocks


def _strings(shard: Shard, suffixes: Suffixes, needed: np.ndarray) -> tuple[np.ndarray, ...]:
    """(certain, counted, at, blocks, hashes, weights): the open strings whose occurrences must be told by block and hash.

    A certain string is counted only where its block is ``needed``, as an undecided string of that block may equal it.
    ``at`` says which of the distinct (block, hash) each counted string has. Strings without a leading anchor have a second
    hash in place of the block, as there may be very many of them.
    """
    length = shard.length
    certain, counted, blocks = _open_strings(shard, suffixes)
    stays = ~certain[counted] | (blocks == 0) | np.isin(blocks, needed)
    counted, blocks = counted[stays], blocks[stays]
    of = np.searchsorted(shard.starts, counted, "right") - 1
    hashes = np.zeros(len(counted), np.int64)
    # Strings more than a length apart are hashed apart.
    cuts = np.flatnonzero((np.diff(counted) > length) | (np.diff(of) > 0)) + 1
    for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(counted)).tolist(), strict=True):
        if a < b:
            begin = int(counted[a])
            data = shard.data[begin : int(counted[b - 1]) + length]
            hashes[a:b] = string_hashes(data, length)[counted[a:b] - begin].view(np.int64)
            free = np.flatnonzero(blocks[a:b] == 0)
            if len(free):
                blocks[a + free] = -1 - (string_hashes(data, length, OTHER)[counted[a + free] - begin] >> np.uint64(1)).astype(np.int64)
    weights = np.where(certain[counted] | (shard.copies[of] > 1), 2, 1)
    order = np.lexsort((hashes, blocks))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (blocks[order][1:] != blocks[order][:-1])
    at = np.zeros(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    total = np.bincount(at, weights, int(new.sum())).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    return certain, counted, at, blocks[order][new], hashes[order][new], np.minimum(total, 2)


FOUND = "digest binary, n_removed long, n_spans long, kept_sha256 string, copies long"


class Merge:
    """The merge of one corpus' shards, with its tables in a folder that all executors share."""

    def __init__(self, docs: DataFrame, length: int, text: str = "text"):
        if length < 8 * (AROUND + GRAM):
            raise ValueError(f"strings of at least {8 * (AROUND + GRAM)} bytes can be led by anchors, not of {length}")
        self.spark, self.length = docs.sparkSession, length
        self.folder = f"{shared_root(self.spark)}/suffix-merge-{uuid.uuid4().hex}"
        content = F.coalesce(F.col(text), F.lit(""))
        long = docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("text")).filter(F.octet_length("text") >= length)
        packed = small_batches(long).mapInArrow(_packed, "digest binary, packed binary, copies long")
        distinct = packed.groupBy("digest").agg(F.first("packed").alias("packed"), F.sum("copies").alias("copies"))
        self.shards = self._kept(small_batches(distinct).mapInArrow(_shards, SHARDS), "shards")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """The frame written to the shared folder and read again; its shuffle files go when it is written, as nothing reads them any more."""
        with swept_shuffles(self.spark):
            df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def symbols(self) -> DataFrame:
        """shard, digest, symbol, lead of each phrase that occurs twice; a symbol is where its bucket starts in the merged order."""
        length = self.length

        def phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Shard(row, length)
                    found, at = np.unique(shard.digests(), return_inverse=True)
                    counts = np.bincount(at, shard.copies[shard.text[shard.phrase]], len(found)).astype(np.int64)
                    raw = pa.Array.from_buffers(pa.binary(16), len(found), [None, pa.py_buffer(found.astype("S16").tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row["shard"], np.int64)), raw, pa.array(counts)], ["shard", "digest", "n"])

        pairs = small_batches(self.shards).mapInArrow(phrases, "shard long, digest binary, n long").repartition("digest")
        same = W.partitionBy("digest")
        twice = pairs.withColumn("total", F.sum("n").over(same)).withColumn("least", F.min("shard").over(same)).filter("total > 1")
        twice = self._kept(twice.withColumn("part", F.spark_partition_id()), "phrases")
        # Where a bucket starts: after the suffixes of the parts before it, then those of the smaller symbols in its part.
        parts = twice.groupBy("part").agg(F.sum("n").alias("n"))
        base = parts.select("part", (F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).alias("base"))
        below = F.sum("n").over(W.partitionBy("part").orderBy("digest").rangeBetween(W.unboundedPreceding, W.currentRow)) - F.col("total")
        placed = twice.withColumn("below", below).join(F.broadcast(base), "part")
        return placed.select("shard", "digest", (F.col("base") + F.col("below")).alias("symbol"), (F.col("least") == F.col("shard")).alias("lead"))

    def merged(self) -> DataFrame:
        """The suffixes of each shard (STATE) when no block is left to refine."""
        length = self.length

        def begin(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            shard = Shard(row, length)
            return _first_suffixes(shard, right).row(row["shard"])

        state = self._kept(self.shards.groupBy("shard").cogroup(self.symbols().groupBy("shard")).applyInArrow(begin, STATE), "depth-1")
        remove_folder(self.spark, f"{self.folder}/phrases")
        depth = 1
        while state.agg(F.sum("active")).first()[0]:
            depth += 1
            state = self._kept(self.refine(state, depth), f"depth-{depth}")
            remove_folder(self.spark, f"{self.folder}/depth-{depth - 1}")
        return state

    def refine(self, state: DataFrame, depth: int) -> DataFrame:
        """One round: every shard asks for its pairs, the blocks of all shards join in the order of (symbol, block)."""

        def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    suffixes = Suffixes.read(row)
                    before, at, symbols, blocks = suffixes.asked(depth)
                    counts = np.bincount(at, suffixes.copies[before], len(symbols)).astype(np.int64)
                    columns = [np.full(len(symbols), row["shard"], np.int64), np.arange(len(symbols)), symbols, blocks, counts]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "at", "symbol", "block", "n"])

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            suffixes = Suffixes.read(row)
            before, at, symbols, _ = suffixes.asked(depth)
            suffixes.refined(depth, before, at, right, len(symbols))
            return suffixes.row(row["shard"])

        pairs = small_batches(state).mapInArrow(ask, "shard long, at long, symbol long, block long, n long").repartition("symbol")
        same, bucket = W.partitionBy("symbol", "block"), W.partitionBy("symbol").orderBy("block").rangeBetween(W.unboundedPreceding, W.currentRow)
        joined = pairs.withColumn("total", F.sum("n").over(same)).withColumn("least", F.min("shard").over(same)).withColumn("upto", F.sum("n").over(bucket))
        blocks = joined.filter("total > 1").select("shard", "at", (F.col("symbol") + F.col("upto") - F.col("total")).alias("block"), (F.col("least") == F.col("shard")).alias("lead"))
        return state.groupBy("shard").cogroup(blocks.groupBy("shard")).applyInArrow(answer, STATE)

    def needed(self, state: DataFrame) -> DataFrame:
        """The state with the short blocks whose certain strings must be counted: some string of the block is undecided."""
        length = self.length

        def sort_out(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            certain, open_at, blocks = _open_strings(Shard(row, length), Suffixes.read(right.to_pylist()[0]))
            sure = certain[open_at]
            columns = [np.unique(blocks[(blocks > 0) & (sure == kind)]) for kind in (True, False)]
            both = np.concatenate(columns)
            return pa.table([pa.array(np.full(len(both), row["shard"], np.int64)), pa.array(both), pa.array(np.arange(len(both)) >= len(columns[0]))], ["shard", "block", "unsure"])

        places = self.shards.select("shard", "lengths", "copies", "anchors")
        rows = places.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(sort_out, "shard long, block long, unsure boolean").repartition("block")
        asked = rows.withColumn("asked", F.max("unsure").over(W.partitionBy("block"))).filter("asked and not unsure")
        return self._kept(state.join(asked.groupBy("shard").agg(F.collect_list("block").alias("needed")), "shard", "left"), "needed")

    def removed(self) -> DataFrame:
        """FOUND for each text that loses bytes."""
        length = self.length
        state = self.needed(self.merged().drop("active"))

        def count(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            *_, blocks, hashes, weights = _strings(Shard(row, length), *read(right))
            columns = [np.full(len(blocks), row["shard"], np.int64), np.arange(len(blocks), dtype=np.int32), blocks, hashes, weights.astype(np.int32)]
            return pa.table([pa.array(c) for c in columns], ["shard", "at", "block", "hash", "n"])

        def read(state: pa.Table) -> tuple[Suffixes, np.ndarray]:
            needed = state.column("needed").combine_chunks()[0]
            return Suffixes.read(state.select(list(KINDS)).to_pylist()[0]), np.asarray(needed.values) if needed.is_valid else np.zeros(0, np.int64)

        counted = self.shards.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(count, "shard long, at int, block long, hash long, n int")
        twice = counted.repartition("hash").withColumn("total", F.sum("n").over(W.partitionBy("hash", "block"))).filter("total > 1")
        told = twice.groupBy("shard").agg(F.collect_list("at").alias("told"))
        state = self._kept(state.join(told, "shard", "left"), "told")

        def cut(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            shard = Shard(row, length)
            certain, counted, at, blocks, _, _ = _strings(shard, *read(right))
            repeated = np.zeros(len(blocks), bool)
            told = right.column("told").combine_chunks()[0]
            if told.is_valid:
                repeated[np.asarray(told.values)] = True
            starts = certain
            starts[counted] |= repeated[at]
            twice = np.flatnonzero(shard.copies > 1)
            starts |= _between(len(starts), shard.starts[twice], shard.ends[twice] - length)
            begins = np.flatnonzero(starts)
            gone = _between(len(starts), begins, begins + length - 1)
            out: list[tuple] = []
            for text in np.unique(np.searchsorted(shard.starts, begins, "right") - 1).tolist():
                here = gone[shard.starts[text] : shard.ends[text]]
                data = shard.data[shard.starts[text] : shard.ends[text]]
                spans = int(here[0]) + int((here[1:] & ~here[:-1]).sum())
                out.append((row["digests"][32 * text : 32 * text + 32], int(here.sum()), spans, hashlib.sha256(data[~here].tobytes()).hexdigest(), int(shard.copies[text])))
            names = ["digest", "n_removed", "n_spans", "kept_sha256", "copies"]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*out, strict=True) if out else [()] * 5
            return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        return self.shards.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(cut, FOUND)


def without_repeats(docs: DataFrame, length: int = 400, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A text that loses nothing has its own digest, so only texts that do come back from the merge; those of very many
    documents are sent to the documents instead of gathering them.
    """
    merge = Merge(docs, length, text)
    found = merge._kept(merge.removed(), "found")
    for name in ("shards", "needed", "told"):
        remove_folder(docs.sparkSession, f"{merge.folder}/{name}")
    content = F.coalesce(F.col(text), F.lit(""))
    rows = cut_lineage(docs.select("doc_id", F.unhex(F.sha2(content, 256)).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes")))
    copies = rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    facts = found.drop("copies").join(copies, "digest", "left").na.fill(1, ["n"])
    facts = cut_lineage(facts)
    joined = join_crowded(rows, facts, ["digest"], "n", rows.count(), "left")
    gone = F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed")
    return joined.select("doc_id", "n_bytes", gone, F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"))
