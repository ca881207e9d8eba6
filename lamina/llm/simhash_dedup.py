"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has bit b set if more than half of its shingles' XXH64 values
do. Fingerprints that differ in at most ``radius`` bits are linked. They are found
without comparing all pairs:

1. Every fingerprint is put under itself and under itself with one bit cleared. Those that
   meet under a key are at most two bits apart, so linking the smallest of them to the
   largest is right, and it joins dense groups without a pair for every two members.
2. The 64 bits are cut into segments. By the pigeonhole principle two fingerprints
   within the radius agree in some segment up to a small Hamming ball; the ball around
   each fingerprint's segment is looked up in the table of all segments and the full
   distance verified. In a table entry with many fingerprints, those of the component
   that most of them already belong to aren't compared with one another: the link would
   tell nothing new. Every link between different components is found, by whatever size.

Defined results: a null text counts as empty; no words: fingerprint zero, linked like
any other; repeated rows come out as often as they went in; documents without a doc_id
keep a null component_id unless another document of their component has one; empty
tables give empty tables; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations
from math import acos, comb, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lamina.llm.batches import lean, small_batches
from lamina.llm.components import connected_components, gathered, join_crowded
from lamina.session import cut_lineage

BITS = 64
#: Table entries with more fingerprints than this are compared only across components.
CROWDED = 64
#: Members of a crowded entry beside its main component that one task compares with others.
STRANGERS = 1_000
#: Keys of crowded entries (16 bytes each) that are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of shingle sets that are broadcast to count common shingles; more of them are joined by a shuffle.
HELD = 1 << 25


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; of the whole sequence where it is shorter."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)] if found else [], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from bit 63 down to bit 0."""
    n = len(hashes)
    rows = np.zeros((-(-n // 255) * 255,), ">u8")
    rows[:n] = hashes
    bits = np.unpackbits(rows.view(np.uint8)).reshape(-1, 255, BITS)
    return bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """Bit b is set if more than half of the hashes have it; 0 without hashes."""
    return int.from_bytes(np.packbits(bit_counts(hashes) * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str, words: int, seed: int) -> int:
    """The SimHash of a text's word shingles, 64 bits unsigned."""
    return majority(shingle_hashes(text, words, seed))


class Segments:
    """How similarity's lanes are cut: ``parts`` segments of ``bits`` bits a lane, ``flips`` weak bits of each that a look-up tries."""

    def __init__(self, lanes: int, parts: int, bits: int, flips: int):
        self.lanes, self.parts, self.bits, self.flips = lanes, parts, bits, flips

    def weak(self, margins: np.ndarray) -> np.ndarray:
        """Places of the ``flips`` bits with the smallest margins in each segment, 5 bits a place; margins run from bit 63 down."""
        cut = margins[:, ::-1][:, : self.parts * self.bits].reshape(-1, self.bits)
        places = np.argpartition(cut, self.flips - 1, axis=1)[:, : self.flips]
        return (places << (5 * np.arange(self.flips))).sum(1)


def segments_for(n: int) -> Segments:
    """Segments for n texts: keys as many as texts where that is possible, so that strangers seldom share one."""
    bits = max(20, min(32, int(n).bit_length()))
    return Segments(5, 3, bits, 3) if bits <= 21 else Segments(8, 2, bits, 6)


def lane(hashes: np.ndarray, number: int) -> np.ndarray:
    """Hashes of another lane: lane 0 are the hashes themselves."""
    if not number:
        return hashes
    x = (hashes ^ np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int, seed: int = 42, keep: tuple[str, ...] = ("doc_id",), text: str = "text", lanes: int = 1, segments: Segments | None = None) -> DataFrame:
    """Columns ``keep``, fp, the fingerprint as a signed long, and w1, w2, ... of further lanes; with ``segments`` their weak bits."""
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    names = [*keep, "fp", *[f"w{i}" for i in range(1, lanes)]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, weak = np.zeros((lanes, batch.num_rows), np.uint64), []
            for i, text in enumerate(batch.column(len(keep))):
                hashes = shingle_hashes(text.as_py(), words, seed)
                counts = np.array([bit_counts(lane(hashes, n)) for n in range(lanes)]) * 2
                values[:, i] = np.packbits(counts > len(hashes), axis=1).view(">u8")[:, 0]
                if segments:
                    weak.append(segments.weak(np.abs(counts - len(hashes))))
            columns = [*batch.columns[:-1], *[pa.array(v.view(np.int64)) for v in values]]
            if segments:
                columns.append(pa.array(weak, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, [*names, *["weak"] * bool(segments)])

    schema = "".join(f"`{name}` {source.schema[name].dataType.simpleString()}, " for name in keep)
    schema += ", ".join(f"{name} long" for name in names[len(keep) :]) + ", weak array<long>" * bool(segments)
    return small_batches(source).mapInArrow(lean(run), schema)


def segment_plan(n: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, width, ball radius) of each segment; the number of segments that costs least for n fingerprints."""
    plans = []
    for parts in range(2, radius + 2):
        base, rest = divmod(radius, parts)
        widths = [BITS // parts + (i < BITS % parts) for i in range(parts)]
        plan, at = [], 0
        for i, width in enumerate(widths):
            if (ball := base if i <= rest else base - 1) >= 0:
                plan.append((at, width, ball))
            at += width
        probes = sum(sum(comb(w, k) for k in range(ball + 1)) for _, w, ball in plan)
        pairs = sum(n * sum(comb(w, k) for k in range(ball + 1)) / 2.0**w for _, w, ball in plan)
        plans.append((n * probes + n * pairs, plan))
    return min(plans)[1]


def _keys(segments: list[tuple[str, int, int, int]], i: int) -> Column:
    """The table key of segment i; the segment's number stands above its bits."""
    column, at, width, _ = segments[i]
    return F.shiftrightunsigned(F.col(column), at).bitwiseAND(F.lit((1 << width) - 1).cast("long")) + F.lit(i << 40)


def _masks(width: int, ball: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(ball + 1) for bits in combinations(range(width), k)]


def dense_links(known: DataFrame, radius: int) -> DataFrame:
    """Edges u, v between fingerprints that share a key: a fingerprint itself, or one with one of its bits cleared.

    All that share a key are within two bits. Each key links the smallest and the largest
    of its fingerprints; what that leaves out far_links finds.
    """
    if radius < 2:
        return known.filter("false").select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    bits = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long") for b in range(BITS)])
    balls = known.select("fp", F.explode(bits).alias("bit")).filter("bit = 0 or (fp & bit) <> 0")
    met = balls.groupBy(F.col("fp").bitwiseXOR(F.col("bit")).alias("key")).agg(F.min("fp").alias("u"), F.max("fp").alias("v"))
    return met.filter("u <> v").select("u", "v")


def far_links(known: DataFrame, segments: list[tuple[str, int, int, int]], radius: int, columns: tuple[str, ...] = ("fp",), apart: bool = False) -> DataFrame:
    """Edges u, v between fingerprints of known(*columns, component) that meet in a segment and differ in at most ``radius`` bits of all columns.

    A segment is (column, first bit, width, ball radius). Left out are edges within a component that is the main
    one of a crowded table entry; with ``apart``, all edges within a component.
    """
    entry = known.select(*columns, "component", F.explode(F.array(*[_keys(segments, i) for i in range(len(segments))])).alias("key"))
    probe = None
    for i, (_, _, width, ball) in enumerate(segments):
        masks = F.array(*[F.lit(m).cast("long") for m in _masks(width, ball)])
        part = known.select(*columns, "component", _keys(segments, i).alias("own"), F.explode(masks).alias("mask"))
        # Of two different segments the smaller one asks for the larger: each pair is met once.
        part = part.withColumn("key", F.col("own").bitwiseXOR(F.col("mask"))).filter("key >= own").select(*columns, "component", "key")
        probe = part if probe is None else probe.unionByName(part)

    return meetings(entry, probe, columns, columns, radius, apart)


def meetings(entry: DataFrame, probe: DataFrame, columns: tuple[str, ...], bits: tuple[str, ...], radius: int, apart: bool = False) -> DataFrame:
    """Edges u, v between the first of ``columns`` of probe and entry(*columns, component, key) under one key, at most ``radius`` of ``bits`` apart.

    A null component is a node of its own.
    """
    own = F.coalesce("component", F.col(columns[0]))
    sizes = entry.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED)
    crowded = cut_lineage(
        entry.join(sizes.select("key"), "key", "left_semi")
        .groupBy("key", own.alias("component")).agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.ceil((F.sum("n") - F.max("n")) / STRANGERS).alias("parts"))
    )
    number = crowded.count()
    crowd = F.broadcast(crowded) if number <= BROADCAST_ROWS else crowded
    a = probe.select("key", F.col("component").alias("cu"), *[F.col(c).alias(f"u_{c}") for c in columns])
    b = entry.select("key", F.col("component").alias("cv"), *[F.col(c).alias(f"v_{c}") for c in columns])
    near = (F.col(f"u_{columns[0]}") != F.col(f"v_{columns[0]}")) & (distance(bits, "u_", "v_") <= radius)
    cu, cv = F.coalesce("cu", F.col(f"u_{columns[0]}")), F.coalesce("cv", F.col(f"v_{columns[0]}"))
    differ = cu != cv

    def links(left: DataFrame, right: DataFrame, also: Column) -> DataFrame:
        return left.join(right, (left["key"] == right["key"]) & near & also).select(F.col(f"u_{columns[0]}").alias("u"), F.col(f"v_{columns[0]}").alias("v"))

    plain = (lambda left, right: links(left, right, differ)) if apart else (lambda left, right: links(left.drop("cu"), right.drop("cv"), F.lit(True)))
    if not number:
        return plain(a, b)
    sparse = plain(a.join(crowd, "key", "left_anti"), b.join(crowd, "key", "left_anti"))
    a, b = a.join(crowd, "key"), b.join(crowd, "key")
    # Members beside the main component meet all others: those that ask are dealt to parts of STRANGERS members, each with those that answer.
    dealt = lambda rows: rows.withColumn("key", F.struct("key", F.pmod(F.xxhash64(next(c for c in rows.columns if c[:2] in ("u_", "v_"))), F.greatest("parts", F.lit(1))).alias("part")))
    spread = lambda rows: rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("parts", F.lit(1)) - 1))).withColumn("key", F.struct("key", "part")).drop("part")
    bare = lambda rows: rows.drop("main", "parts")
    others = links(bare(dealt(a)), bare(spread(b.filter(cv != F.col("main")))), differ)
    strays = links(bare(spread(a.filter(cu != F.col("main")))), bare(dealt(b.filter(cv == F.col("main")))), differ)
    return sparse.unionByName(others).unionByName(strays)


def distance(columns: tuple[str, ...], one: str, other: str) -> Column:
    """Bits in which the columns with one prefix and with the other differ."""
    return reduce(Column.__add__, [F.bit_count(F.col(one + c).bitwiseXOR(F.col(other + c))) for c in columns])


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, text: str = "text") -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that the document reaches by links, itself included."""
    marked = cut_lineage(fingerprints(docs, words, seed, text=text))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    dense = connected_components(dense_links(distinct, radius))
    known = distinct.select("fp").join(dense.withColumnRenamed("node", "fp"), "fp", "left")
    known = cut_lineage(known.select("fp", F.coalesce("component", "fp").alias("component")))
    segments = [("fp", *part) for part in segment_plan(known.count(), radius)]
    far = far_links(known, segments, radius)
    stars = known.filter("fp <> component").select(F.col("fp").alias("u"), F.col("component").alias("v"))
    return _grouped(marked, distinct, far.unionByName(stars))


def _grouped(marked: DataFrame, distinct: DataFrame, edges: DataFrame, node: str = "fp") -> DataFrame:
    """doc_id, fp, component_id of marked(doc_id, fp, node) by edges(u, v) between the nodes of distinct(node, first)."""
    whole = connected_components(edges).withColumnRenamed("node", node)
    linked = cut_lineage(distinct.join(whole, node).select(node, "first", "component"))
    least = cut_lineage(linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    named = join_crowded(linked.select(node, "component"), least, ["component"], "n", linked.count()).select(node, "component_id")
    alone = distinct.join(whole, node, "left_anti").select(node, F.col("first").alias("component_id"))
    # Texts of one fingerprint are rows of one key: those of frequent ones stay where they are.
    sizes = marked.groupBy(node).agg(F.count("*").alias("n"))
    facts = cut_lineage(named.unionByName(alone).join(sizes, node))
    return join_crowded(marked, facts, [node], "n", marked.count()).select("doc_id", "fp", "component_id")


def allowed_bits(similarity: float, bits: int, deviations: float) -> int:
    """Bits that texts with this share of common shingles differ in, and some deviations more."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * p + deviations * sqrt(bits * p * (1 - p)))


def within(pairs: DataFrame, prints: DataFrame, columns: tuple[str, ...], most: int) -> DataFrame:
    """Those of the pairs u, v, once each, whose prints(node, *columns) differ in at most ``most`` bits."""
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    for side in "uv":
        pairs = pairs.join(prints.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return cut_lineage(pairs.filter(distance(columns, "u_", "v_") <= most).select("u", "v"))


def shingle_sets(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """node, held: the sorted distinct shingle hashes of texts(node, text), 8 bytes each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(shingle_hashes(t.as_py(), words, seed)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["node", "held"])

    return small_batches(texts.select("node", "text")).mapInArrow(lean(run), "node long, held binary")


def share_reached(one: bytes, other: bytes, similarity: float) -> bool:
    """Whether two sets of shingle_sets have this Jaccard similarity."""
    if min(len(one), len(other)) < similarity * max(len(one), len(other)):
        return False
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float, seed: int) -> DataFrame:
    """Those of the pairs u, v whose texts(node, text) have this share of common shingles, counted.

    Sets of up to HELD bytes together are sent to every task, so that many pairs of few texts move no text; more are joined.
    """
    spark = pairs.sparkSession
    asked = cut_lineage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    few = asked.count() <= BROADCAST_ROWS
    texts = texts.join(F.broadcast(asked) if few else asked, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = cut_lineage(shingle_sets(texts, words, seed))
    if (sets.agg(F.sum(F.length("held") + 64)).first()[0] or 0) <= HELD:
        shared = spark.sparkContext.broadcast({r["node"]: bytes(r["held"]) for r in sets.toLocalIterator()})

        def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                keep = [share_reached(held[u], held[v], similarity) for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        spread = pairs.select("u", "v").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "u", "v")
        return cut_lineage(spread.mapInArrow(lean(look), "u long, v long"))
    for side in "uv":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("held").alias(f"{side}_held")), side)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [share_reached(a.as_py(), b.as_py(), similarity) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return cut_lineage(small_batches(pairs.select("u", "v", "u_held", "v_held")).mapInArrow(lean(run), "u long, v long"))


#: Bytes of shingle sets that one block of a cluster holds, about.
BLOCK = 1 << 22


def linked_within(one: list[np.ndarray], other: list[np.ndarray] | None, similarity: float) -> list[tuple[int, int]]:
    """(i, j): links between two blocks of shingle sets, or within one (other is None), as few as join what is alike.

    All pairs are compared, by lists of the sets that hold each shingle; of those that reach the similarity only such
    are told as join what earlier ones have not.
    """
    sets = one if other is None else [*one, *other]
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    owner, values = owner[order], flat[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    keys, ends = values[starts], np.append(starts[1:], len(values))
    sizes, parent, links = np.array([len(x) for x in sets]), list(range(len(sets))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, own in enumerate(one):
        at = np.searchsorted(keys, own)
        both = np.zeros(len(sets), np.int64)
        for k in at.tolist():
            both[owner[starts[k] : ends[k]]] += 1
        both[: i + 1 if other is None else len(one)] = 0
        for j in np.flatnonzero((both > 0) & (both >= similarity * (sizes[i] + sizes - both))).tolist():
            if (a := root(i)) != (b := root(j)):
                parent[b] = a
                links.append((i, j if other is None else j - len(one)))
    return links


def cluster_links(clusters: DataFrame, texts: DataFrame, words: int, similarity: float, seed: int) -> DataFrame:
    """Edges u, v that join the components of each cluster wherever texts of two components reach the similarity.

    clusters(node, cluster, component): a cluster is a set of texts that look alike by their fingerprints; its components
    are linked already. Clusters of several components are cut into blocks of about BLOCK bytes of shingle sets, by component
    where these are large, and blocks are compared in pairs, except those of one component. So a large cluster
    costs comparisons in blocks, but never a row for a pair of texts.
    """
    mixed = clusters.groupBy("cluster").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("cluster")
    members = cut_lineage(clusters.join(mixed, "cluster", "left_semi"))
    number = members.count()
    members = gathered(members, number)
    few = F.broadcast(members.select("node")) if number <= BROADCAST_ROWS else members.select("node")
    own = texts.join(few, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = cut_lineage(shingle_sets(own, words, seed).join(members, "node"))
    weight = (F.octet_length("held") + 64).cast("long")
    parts = sets.groupBy("cluster", "component").agg(F.sum(weight).alias("bytes"))
    parts = parts.withColumn("pure", F.when(F.col("bytes") >= BLOCK // 2, F.col("component")))
    # How many blocks: of each large component, and of all small ones together.
    blocks = cut_lineage(gathered(parts.groupBy("cluster", "pure").agg(F.ceil(F.sum("bytes") / BLOCK).alias("blocks")), number))
    listed = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("cluster", F.struct("pure", "block").alias("block"))
    pairs = listed.join(listed.withColumnRenamed("block", "with"), "cluster").filter((F.col("block") <= F.col("with")) & ~(F.coalesce(F.col("block.pure") == F.col("with.pure"), F.lit(False))))
    pairs = cut_lineage(gathered(pairs, number).select("cluster", F.struct("cluster", "block", "with").alias("pair"), "block", "with"))
    side = pairs.select("cluster", "pair", "block", F.lit(False).alias("right")).unionByName(pairs.filter("block <> with").select("cluster", "pair", F.col("with").alias("block"), F.lit(True).alias("right")))
    large = cut_lineage(gathered(parts.filter("pure is not null"), number).select("cluster", "component", "pure"))
    dealt = sets.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, ["cluster", "component"], "left")
    here = dealt["cluster"].eqNullSafe(blocks["cluster"]) & dealt["pure"].eqNullSafe(blocks["pure"])
    dealt = dealt.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks, here).select(
        dealt["cluster"], "node", "held", F.struct(dealt["pure"], F.pmod(F.xxhash64("node"), "blocks").alias("block")).alias("block"))
    rows = dealt.join(side, ["cluster", "block"]).select("pair", "right", "node", "held")

    def compare(table: pa.Table) -> pa.Table:
        right = np.array(table.column("right").to_pylist(), bool)
        nodes = np.array(table.column("node").to_pylist(), np.int64)
        held = [np.frombuffer(x, np.uint64) for x in table.column("held").to_pylist()]
        if right.any():
            one, two = np.flatnonzero(~right), np.flatnonzero(right)
            found = [(one[i], two[j]) for i, j in linked_within([held[i] for i in one], [held[i] for i in two], similarity)]
        else:
            found = linked_within(held, None, similarity)
        return pa.table({"u": pa.array([nodes[i] for i, _ in found], pa.int64()), "v": pa.array([nodes[j] for _, j in found], pa.int64())})

    return cut_lineage(rows.groupBy("pair").applyInArrow(compare, "u long, v long"))


#: Rows of one segment's value that are sorted together at most, before the look-up.
SORTED = 50_000


def beside(entry: DataFrame, most: int) -> DataFrame:
    """Pairs u, v of entry(node, key, lane) that follow each other in the order of their lanes under a key, at most ``most`` bits apart.

    They only make large groups few components before the look-up, so a key with more than SORTED rows may be cut anywhere.
    """
    high = F.shiftrightunsigned("lane", 52)
    rows = entry.select("node", "key", "lane", high.alias("high"))
    sizes = rows.groupBy("key", "high").agg(F.count("*").alias("n")).filter(F.col("n") > SORTED)  # one row of SORTED at most: broadcast
    sizes = cut_lineage(sizes.select("key", "high", F.ceil(F.col("n") / SORTED).alias("parts")))
    parts = F.lit(0)
    if sizes.count():
        rows = rows.join(F.broadcast(sizes), ["key", "high"], "left")
        parts = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    before = F.lag(F.struct("node", "lane")).over(W.partitionBy("key", "high", "part").orderBy("lane", "node"))
    rows = rows.withColumn("part", parts).withColumn("b", before)
    return rows.filter(F.bit_count(F.col("lane").bitwiseXOR(F.col("b.lane"))) <= most).select(F.col("node").alias("u"), F.col("b.node").alias("v"))


#: Members from which a cluster is met as a whole, and about how many of its lanes stand in one row for that.
LARGE, LANES = 64, 1_000


def guests_of(entry: DataFrame, probe: DataFrame, most: int) -> DataFrame:
    """node, cluster: nodes outside a large cluster that meet one of its members under a key, at most ``most`` bits from it in that lane.

    n is the size of a row's large cluster, else null. The lanes of such clusters under a key are gathered into rows of about LANES, so a node costs a row for each
    key and LANES members, not one for each member. Either side may ask, as in the look-up.
    """

    def met(asking: DataFrame, held: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / LANES))
        lanes = held.filter("n is not null").groupBy("key", F.col("component").alias("cluster"), part.alias("part")).agg(F.collect_set("lane").alias("lanes"))
        lanes = cut_lineage(lanes.drop("part"))
        number = lanes.count()
        lanes = gathered(lanes, number)
        found = asking.select("node", "component", "key", "lane").join(F.broadcast(lanes) if number <= BROADCAST_ROWS else lanes, "key")
        close = F.exists("lanes", lambda x: F.bit_count(x.bitwiseXOR(F.col("lane"))) <= most)
        return found.filter((F.coalesce("component", "node") != F.col("cluster")) & close).select("node", "cluster")

    return cut_lineage(met(probe, entry).unionByName(met(entry, probe)).distinct())


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42, text: str = "text", segments: Segments | None = None) -> DataFrame:
    """doc_id, fp and component_id, with links at a share of common word shingles instead of a few bits.

    A share of 0.8 stands for ten of 64 bits, too many for exact balls, and 64 bits tell it badly. So the fingerprint has
    several lanes of 64 bits, cut into segments. Bits that a few other shingles turn are those with the smallest
    majorities, so the ball around a segment flips its weakest bits only, in all combinations: of texts at the limit, 98 in 100
    meet in some segment, more similar ones nearly always. The look-up carries the lane
    of its segment only; the complete distance over all lanes follows for those near in that lane, and then the shingles of
    both texts are counted: only they decide. Before the look-up, fingerprints that share a segment are
    compared with their neighbours in order. Those near by all lanes form clusters; within a cluster texts are compared
    in blocks, all of them, so that a large group of copies costs no row for a pair, and the look-up passes over it.
    Texts of elsewhere that meet a large cluster are compared with it in the same way.
    """
    segments = segments or segments_for(docs.count())
    columns = ("fp", *[f"w{i}" for i in range(1, segments.lanes)])
    own = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select("doc_id", own.alias("text"), F.xxhash64(own).alias("node"))  # equal texts are one node
    marked = cut_lineage(fingerprints(texts, words, seed, keep=("doc_id", "node"), lanes=segments.lanes, segments=segments))
    distinct = marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.first(F.struct(*columns, "weak")).alias("w"))
    distinct = cut_lineage(distinct.select("node", "first", "w.*"))
    number, cases = distinct.count(), segments.lanes * segments.parts << segments.flips
    distinct = gathered(distinct, number * cases // 8)
    marked = marked.select("doc_id", "node", "fp")
    most, lane_most = allowed_bits(similarity, BITS * segments.lanes, 3), allowed_bits(similarity, BITS, 1.5)
    cuts = [(c, segments.bits * j, segments.bits, 1) for c in columns for j in range(segments.parts)]

    def near(pairs: DataFrame) -> DataFrame:
        return within(pairs, distinct, columns, most)

    def alike_of(pairs: DataFrame) -> DataFrame:
        return alike(pairs, texts.select("node", "text"), words, similarity, seed)

    def entries(known: DataFrame, *keep: str) -> DataFrame:
        own = [~(((1 << width) - 1) << at) for _, at, width, _ in cuts]  # the lane without its segment, which the key tells
        keys = [F.struct(_keys(cuts, i).alias("key"), F.col(cuts[i][0]).bitwiseAND(F.lit(own[i]).cast("long")).alias("lane"), F.element_at("weak", i + 1).alias("weak")) for i in range(len(cuts))]
        return known.select(*keep, F.explode(F.array(*keys)).alias("e")).select(*keep, "e.*")

    following = near(beside(entries(distinct, "node"), lane_most))
    fine = connected_components(alike_of(following))
    coarse = connected_components(following).withColumnRenamed("component", "cluster")
    clusters = coarse.join(fine, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("component"))
    clusters = cut_lineage(clusters)
    inner = cluster_links(clusters, texts.select("node", "text"), words, similarity, seed)
    # A component of the look-up is a cluster: all within one are compared already. Null: a text of its own.
    known = distinct.join(coarse, "node", "left").select("node", *columns, "weak", F.col("cluster").alias("component"))
    # What meets a large cluster joins its comparison in blocks; only the others are told pair by pair.
    crowds = clusters.groupBy(F.col("cluster").alias("component")).agg(F.count("*").alias("n"))
    crowds = cut_lineage(gathered(crowds.filter(F.col("n") >= LARGE), number))
    crowds = F.broadcast(crowds) if crowds.count() <= BROADCAST_ROWS else crowds
    known = known.join(crowds, "component", "left")
    known = cut_lineage(gathered(known, number * cases))  # as many tasks as its probes ask for
    entry = entries(known, "node", "component", "n")
    masks = [F.lit(0).cast("long")]
    for i in range(segments.flips):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("weak", 5 * i).bitwiseAND(F.lit(31)).cast("int"))
        masks += [m.bitwiseXOR(bit) for m in masks]
    probe = entry.select("node", "component", "n", "key", "lane", F.explode(F.array(*masks)).alias("mask"))
    probe = probe.select("node", "component", "n", F.col("key").bitwiseXOR(F.col("mask")).alias("key"), "lane")
    guests = guests_of(entry, probe, lane_most)
    hosts = clusters.join(crowds.select(F.col("component").alias("cluster")), "cluster", "left_semi").select("node", "cluster", F.col("cluster").alias("component"))
    taken = cluster_links(hosts.unionByName(guests.withColumn("component", F.col("node"))), texts.select("node", "text"), words, similarity, seed)
    entry, probe = (rows.filter("n is null") for rows in (entry, probe))
    far = alike_of(near(meetings(entry.drop("weak"), probe, ("node", "lane"), ("lane",), lane_most, apart=True))).unionByName(taken)
    stars = clusters.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    return _grouped(marked, distinct, far.unionByName(stars).unionByName(inner), "node")
