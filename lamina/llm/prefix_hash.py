"""Document fingerprints from prefix polynomial hashes.

The code points c0, c1, ... of a text give prefix values S[i] = sum of (cj + 1) * b**j
for j < i, modulo a prime. Two such arrays (two bases) answer whether any two spans are
equal: their difference, moved to exponent zero by a power of the inverse base, is the
span's hash wherever it stands. Longest common extensions follow by binary search.

A fingerprint is the length, the hash of the whole text and the smallest distinct hashes
of the text's fixed-width spans (a bottom-k sketch), as a string. ``likeness`` estimates
from two fingerprints the share of spans that their texts have in common.

Defined results: a null text counts as empty; equal texts have equal fingerprints; the
likeness of two empty texts is 1, of an empty and another text 0; a text shorter than the
width is one span. Documents follow each other by descending doc_id (nulls last, equal
ids by text), and the last is followed by the first; a single document follows itself.
A doc_id that is no integer counts as null. Empty tables give empty tables; other columns
are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamina.llm.batches import small_batches

PRIME = (1 << 31) - 1
#: Two bases modulo PRIME: fixed values, any large numbers serve.
BASES = (1_073_807_359, 1_986_472_639)
INVERSES = tuple(pow(b, -1, PRIME) for b in BASES)
#: Characters of a span, hashes kept of a text, bytes kept of a hash.
WIDTH, KEPT, HASH_BYTES = 16, 64, 5

_powers: dict[int, np.ndarray] = {}


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME for x below 2**63."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME; kept by the worker process and grown by doubling."""
    found = _powers.get(base, np.ones(1, np.uint64))
    while len(found) < n:
        step = np.uint64(pow(base, len(found), PRIME))
        found = np.concatenate((found, _reduce(found * step)))
    _powers[base] = found
    return found[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads polynomial hashes evenly."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(_reduce(points * powers(b, self.n))))) for b in BASES]
        self.sums = [_reduce(s) for s in self.sums]

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """62-bit hashes of the spans of one length at the given starts."""
        out = np.zeros(len(starts), np.uint64)
        for b, s in zip(INVERSES, self.sums, strict=True):
            inverse = powers(b, self.n + 1)
            difference = s[starts + length] + np.uint64(PRIME) - s[starts]
            out = (out << np.uint64(31)) | _reduce(_reduce(difference) * inverse[starts])
        return out

    def span(self, start: int, length: int) -> int:
        """The hash of one span, as spans gives it."""
        out = 0
        for inverse, s in zip(INVERSES, self.sums, strict=True):
            out = out << 31 | (int(s[start + length]) - int(s[start])) * pow(inverse, start, PRIME) % PRIME
        return out

    def windows(self) -> np.ndarray:
        """Mixed hashes of all spans of WIDTH characters."""
        count = self.n - WIDTH + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(count, np.uint64)
        for b, s in zip(INVERSES, self.sums, strict=True):
            inverse = powers(b, count)
            out = (out << np.uint64(31)) | _reduce(_reduce(s[WIDTH:] + np.uint64(PRIME) - s[:-WIDTH]) * inverse)
        return _mixed(out)


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest common span of a from i and b from j, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, middle) == b.span(j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _smallest(hashes: np.ndarray) -> np.ndarray:
    """The KEPT smallest distinct values; a threshold first, so that few need sorting."""
    if len(hashes) > 8 * KEPT:
        few = np.unique(hashes[hashes < np.uint64((1 << 64) // len(hashes) * 4 * KEPT)])
        if len(few) >= KEPT:
            return few[:KEPT]
    return np.unique(hashes)[:KEPT]


def _written(n: int, whole: int, hashes: np.ndarray) -> str:
    kept = (_smallest(hashes) >> np.uint64(64 - 8 * HASH_BYTES)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :]
    return f"{n:x}.{whole:016x}.{base64.b64encode(kept.tobytes()).decode()}"


def fingerprint(text: PrefixHashes, windows: np.ndarray | None = None) -> str:
    """Length, hash of the whole text and bottom-k sketch as one string."""
    whole = text.span(0, text.n)
    if text.n and text.n < WIDTH:
        windows = _mixed(np.array([whole], np.uint64))
    return _written(text.n, whole, text.windows() if windows is None else windows)


def likeness(a: str, b: str) -> float:
    """Estimated share of spans that two fingerprints' texts have in common, 0 to 1."""
    if a == b:
        return 1.0
    size = HASH_BYTES
    x, y = (base64.b64decode(f.rsplit(".", 1)[1]) for f in (a, b))
    x, y = ({f[i : i + size] for i in range(0, len(f), size)} for f in (x, y))
    both = sorted(x | y)[:KEPT]
    return sum(h in x and h in y for h in both) / len(both) if both else 0.0


def edited(text: str, after: str) -> str:
    """The text with its last half (rounded down) replaced by as many first characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


class _Document:
    """A text with its arrays, windows and fingerprint."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.hashes = PrefixHashes(text)
        self.windows = self.hashes.windows()
        self.fingerprint = fingerprint(self.hashes, self.windows)

    def edited_fingerprint(self, after: _Document, text: str) -> str:
        """Of ``text``, the text edited by ``after``: both parts' spans are known, only those across the seam are new."""
        keep = self.hashes.n - self.hashes.n // 2
        taken = len(text) - keep
        if keep < 2 * WIDTH or taken < 2 * WIDTH:
            return fingerprint(PrefixHashes(text))
        seam = PrefixHashes(text[keep - WIDTH + 1 : keep + WIDTH - 1]).windows()
        whole = 0
        for b, s, t in zip(BASES, self.hashes.sums, after.hashes.sums, strict=True):
            whole = whole << 31 | (int(s[keep]) + int(t[taken]) * pow(b, keep, PRIME)) % PRIME
        return _written(len(text), whole, np.concatenate((self.windows[: keep - WIDTH + 1], seam, after.windows[: taken - WIDTH + 1])))


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_prefix long"


def _row(own: _Document, after: _Document) -> tuple:
    text = edited(own.text, after.text)
    other = own.edited_fingerprint(after, text)
    shared = common_extension(own.hashes, 0, after.hashes, 0)
    return (own.doc_id, own.hashes.n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), own.fingerprint, other, likeness(own.fingerprint, other), likeness(own.fingerprint, after.fingerprint), shared)


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered within their bucket; each needs only the one after it. A bucket's last rows are the head of the bucket that follows."""
    names = [part.split()[0] for part in FIELDS.split(", ")]
    last, bucket = None, None
    for batch in batches:
        out = []
        for b, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                last, bucket = None, b
            elif last is None:
                continue  # more copies of the head that follows
            now = _Document(doc_id, text)
            if last is not None:
                out.append(_row(last, now))
            last = None if ahead else now
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2 + [pa.int64()], strict=True)], names)


def cut_cells(cuts: list[int]) -> tuple[list[tuple[int, int, list[int]]], int]:
    """(cell, cuts above it, cuts within it) of each cell, and how many low bits of a rank a cell leaves out.

    A cell is a rank without its low bits; there are at most about four for each cut, and one more on either side. So the
    number of cuts above a rank takes one look-up and, mostly, no comparison.
    """
    low, high = min(cuts), max(cuts)
    shift = 0
    while (high >> shift) - (low >> shift) > 4 * len(cuts):
        shift += 1
    held: dict[int, list[int]] = {c: [] for c in range(max(-(1 << 63), (low >> shift) - 1), min(1 << 63, (high >> shift) + 2))}
    for cut in cuts:
        held[cut >> shift].append(cut)
    cells, above = [], 0
    for cell in sorted(held, reverse=True):
        cells.append((cell, above, held[cell]))
        above += len(held[cell])
    return cells, shift


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """FIELDS of every document: its fingerprint, its edited text's and the likenesses to that and to the next text.

    doc_id, an integer, is dealt into ranges at quantiles. Each range also gets the first document of the range that
    follows, so texts move once and a task holds two texts at a time besides its batch. What the
    driver sees is one row a range; the tables it sends (cells of ranks, first ranks) have a few rows for each range, and no
    expression grows with their number. Documents of one doc_id (which should be one) stay in one range.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rank = F.coalesce(F.expr("try_cast(doc_id as long)"), F.lit(-(1 << 63)))
    keyed = docs.select("doc_id", rank.alias("__rank"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    ranks = keyed.select("__rank")
    cuts = ranks.agg(F.percentile_approx("__rank", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else []
    cuts = sorted(set(cuts or []))
    cells, shift = cut_cells(cuts or [0])
    table = F.broadcast(spark.createDataFrame(cells, "__cell long, __above int, __cuts array<long>"))
    lowest, highest = cells[-1][0], cells[0][0]
    cell = F.greatest(F.lit(lowest), F.least(F.lit(highest), F.shiftright("__rank", shift)))
    above = F.col("__above") + F.when(F.size("__cuts") > 0, F.size(F.filter("__cuts", lambda c: c > F.col("__rank")))).otherwise(0)
    bucketed = lambda rows: rows.withColumn("__cell", cell).join(table, "__cell").withColumn("__bucket", above).drop("__cell", "__above", "__cuts")
    heads = {r["__bucket"]: r["head"] for r in bucketed(ranks).groupBy("__bucket").agg(F.max("__rank").alias("head")).collect()}
    order = sorted(heads)
    leads = spark.createDataFrame([(heads[b], order[i - 1]) for i, b in enumerate(order)], "__rank long, __lead int")
    dealt = bucketed(keyed).join(F.broadcast(leads), "__rank", "left")
    own = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("ahead"))
    also = F.struct(F.col("__lead").alias("b"), F.lit(True).alias("ahead"))
    dealt = dealt.select(F.explode(F.when(F.col("__lead").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("c"), "doc_id", "__rank", "__text")
    dealt = dealt.select("c.b", "c.ahead", "doc_id", "__rank", "__text").repartitionById(max(1, len(order)), F.col("b") % max(1, len(order)))
    dealt = small_batches(dealt).sortWithinPartitions("b", "ahead", F.desc("__rank"), "__text")
    return dealt.select("b", "ahead", F.expr("try_cast(doc_id as long)").alias("doc_id"), "__text").mapInArrow(_pairs, FIELDS)
