"""How the sources of a language differ in their words: exact integer divergences of all pairs, by two-dimensional tiling.

Each language keeps the terms that a number of its documents use. A group is a (language, source); its smoothed share of a
term is p = 1 + floor(10**9 * (count + 1) / (N + V)) with N its kept tokens and V the language's kept terms, and the
divergence of q from p adds up floor((p - q)**2 / q) over all kept terms. All arithmetic is in integers.

Counts are packed: one row for each group and chunk of the vocabulary, with positions and counts as arrays. The groups of
a language are dealt into blocks, and a vector goes to every tile (block by block) that its block takes part in: with b
blocks it is copied b times, not once for each other group. A task takes one tile and one chunk after the other, holds
two dense blocks of a chunk at a time and computes the submatrix of their pairs; the chunks' parts are added up afterwards.
The work of the tiles follows groups and vocabulary, not the number of documents, and no task needs a whole vocabulary.

Defined results: null text, language and source count as ''. Every (language, source) that occurs has its pairs, also
without terms: its shares are then those of zero counts. A language that keeps no term has pairs of value 0. Repeated rows
count as often as they occur. Texts are read whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lamina.llm.batches import small_batches
from lamina.session import cut_lineage

SCALE = 1_000_000_000
#: Entries (distinct terms of groups) that a task counts before it passes them on.
HELD = 400_000
#: Count rows that a chunk of a vocabulary is meant to hold, groups of a block, terms of a dense block at a time.
CHUNK_ROWS, BLOCK, COLUMNS = 400_000, 64, 8_192
#: Pieces in which a group's terms are ranked before the best of them meet.
PIECES = 32
#: Groups whose totals are broadcast; more of them are joined by a shuffle.
BROADCAST_GROUPS = 100_000

#: ASCII letters in lower case, bytes of longer characters as they are, all else a space.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COUNTED = "lang string, source string, term string, n long, documents long"


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of each (lang, source, term); one row of an empty term says that the group occurs."""
    names = [x.split()[0] for x in COUNTED.split(", ")]
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (tokens, documents) in held.items():
            terms = list(tokens)
            columns[0] += [lang] * (len(terms) + 1)
            columns[1] += [source] * (len(terms) + 1)
            columns[2] += [b"", *terms]
            columns[3] += [0, *tokens.values()]
            columns[4] += [0, *map(documents.__getitem__, terms)]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tokens, documents = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(tokens)
            found = Counter(text.encode().translate(FOLDED).split())
            tokens.update(found)
            documents.update(found.keys())
            size += len(tokens) - before
            if size >= HELD:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def term_counts(docs: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(kept, groups): kept(lang, source, term, n, whole) of terms in at least ``least`` documents of their language, whole
    being the language's count; groups(lang, source, n, terms) with the kept tokens of a group and terms of its language."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = small_batches(rows).mapInArrow(_counts, COUNTED)
    counted = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    word = W.partitionBy("lang", "term")
    counted = counted.repartition("lang", "term")
    counted = counted.withColumn("whole", F.sum("n").over(word)).withColumn("documents", F.sum("documents").over(word))
    kept = cut_lineage(counted.filter((F.col("term") == "") | (F.col("documents") >= least)).drop("documents"))
    group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.filter("term <> ''").groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.count("*").alias("cells"))
    groups = cut_lineage(group.join(terms, "lang", "left").na.fill(0, ["terms", "cells"]))
    return kept.filter("term <> ''"), groups


def top_terms(kept: DataFrame, groups: DataFrame, most: int = 200) -> DataFrame:
    """lang, source, item, value, rank of the terms that stand out most in a group against its language."""
    whole = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    facts = groups.select("lang", "source", F.col("n").alias("group_n"), "terms").join(whole, "lang")
    few = groups.count() <= BROADCAST_GROUPS
    rows = kept.filter("n > 0").join(F.broadcast(facts) if few else facts, ["lang", "source"])
    part = "cast(cast({0} as decimal(10,0)) * cast({1} + 1 as decimal(19,0)) div cast({2} + terms as decimal(19,0)) as long) + 1"
    rows = rows.select("lang", "source", F.col("term").alias("item"), F.expr(part.format(SCALE, "n", "group_n")).alias("p"), F.expr(part.format(SCALE, "whole", "lang_n")).alias("q"))
    rows = rows.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    best = [F.desc("value"), F.asc("item")]
    rows = rows.withColumn("__piece", F.pmod(F.xxhash64("item"), F.lit(PIECES)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "__piece").orderBy(*best))).filter(F.col("rank") <= most)
    rows = rows.drop("rank", "__piece")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*best))).filter(F.col("rank") <= most)


def packed_vectors(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, chunk, width (terms of the chunk), at (positions) and counts: one row for each group and chunk."""
    langs = groups.select("lang", F.ceil(F.greatest(F.col("cells"), F.lit(1)) / CHUNK_ROWS).alias("chunks")).distinct()
    rows = kept.join(F.broadcast(langs) if langs.count() <= BROADCAST_GROUPS else langs, "lang")
    rows = rows.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk")).repartition("lang", "chunk")
    chunk = W.partitionBy("lang", "chunk")
    rows = rows.withColumn("at", (F.dense_rank().over(chunk.orderBy("term")) - 1).cast("int"))
    rows = rows.withColumn("width", F.max("at").over(chunk) + 1)
    cells = rows.groupBy("lang", "chunk", "source").agg(F.first("width").alias("width"), F.collect_list(F.struct("at", "n")).alias("cells"))
    return cells.select("lang", "chunk", "source", "width", F.col("cells.at").alias("at"), F.col("cells.n").alias("counts"))


TILED = "lang string, own long, other long, value long"


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of their (lang, block, block, chunk): each such run is one submatrix over one chunk.

    A group without a kept term in the chunk has a row without cells, so that every run knows all groups of both blocks.
    """
    held: list[dict] = []
    key = None
    for batch in batches:
        arrays = [batch.column(i) for i in (batch.num_columns - 2, batch.num_columns - 1)]
        for i, row in enumerate(batch.drop_columns(["at", "counts"]).to_pylist()):
            row["cells"] = tuple(np.asarray(a[i].values, np.int64) if a[i].is_valid else np.zeros(0, np.int64) for a in arrays)
            now = (row["lang"], row["a"], row["b"], row["chunk"])
            if key is not None and now != key:
                yield _submatrix(key, held)
                held = []
            key = now
            held.append(row)
    if held:
        yield _submatrix(key, held)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / totals) by long division to the base 1000; exact below 9 * 10**15 tokens."""
    whole, rest = np.divmod(counts + 1, totals[:, None])
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals[:, None])
        whole = whole * 1000 + digit
    return whole + 1


def _submatrix(key: tuple, rows: list[dict]) -> pa.RecordBatch:
    lang, a, b, _ = key
    width = max(r["width"] for r in rows)
    sides = [sorted((r for r in rows if r["block"] == s), key=lambda r: r["number"]) for s in ([a] if a == b else [a, b])]
    cells = [[r["cells"] for r in side] for side in sides]
    totals = [np.array([r["n"] + r["terms"] for r in side], np.int64) for side in sides]
    sums = np.zeros((len(sides[0]), len(sides[-1])), np.int64)
    back = np.zeros_like(sums)
    for start in range(0, width, COLUMNS):
        stop = min(width, start + COLUMNS)
        dense = []
        for side, total in zip(cells, totals, strict=True):
            counts = np.zeros((len(side), stop - start), np.int64)
            for i, (at, n) in enumerate(side):
                inside = (at >= start) & (at < stop)
                counts[i, at[inside] - start] = n[inside]
            dense.append(shares(counts, total))
        left, right = dense[0], dense[-1]
        for i, p in enumerate(left):
            square = (right - p) ** 2
            sums[i] += (square // right).sum(axis=1)
            if a != b:
                back[i] += (square // p).sum(axis=1)
    own, other = ([r["number"] for r in side] for side in (sides[0], sides[-1]))
    out = [(x, y, int(sums[i, j])) for i, x in enumerate(own) for j, y in enumerate(other) if x != y]
    if a != b:
        out += [(y, x, int(back[i, j])) for i, x in enumerate(own) for j, y in enumerate(other)]
    x, y, v = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), *[pa.array(c, pa.int64()) for c in (x, y, v)]], ["lang", "own", "other", "value"])


def pair_divergences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value for all ordered pairs of groups of a language."""
    numbered = cut_lineage(groups.drop("cells").withColumn("number", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long")).withColumn("block", F.floor(F.col("number") / BLOCK)))
    vectors = cut_lineage(packed_vectors(kept, groups))
    chunks = vectors.groupBy("lang", "chunk").agg(F.max("width").alias("width"))
    # A row for every group and chunk, also where none of the chunk's terms occurs in the group.
    rows = numbered.join(chunks, "lang").join(vectors.drop("width"), ["lang", "source", "chunk"], "left")
    blocks = numbered.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    rows = rows.join(blocks, "lang").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("lang", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "chunk", "block", "number", "n", "terms", "width", "at", "counts")
    tiles = small_batches(rows).repartition("lang", "a", "b", "chunk").sortWithinPartitions("lang", "a", "b", "chunk")
    found = tiles.mapInArrow(_tiles, TILED).groupBy("lang", "own", "other").agg(F.sum("value").alias("value"))
    names = numbered.select("lang", "number", "source")
    # Pairs of languages that keep no term have no tile: they come from the list of groups.
    none = numbered.filter("terms = 0").select("lang", "source").alias("x").join(numbered.filter("terms = 0").select("lang", F.col("source").alias("item")).alias("y"), "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    own = names.select("lang", F.col("number").alias("own"), "source")
    other = names.select("lang", F.col("number").alias("other"), F.col("source").alias("item"))
    return found.join(own, ["lang", "own"]).join(other, ["lang", "other"]).select("lang", "source", "item", "value").unionByName(none)


def divergence_audit(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` ranks all other sources of a group, part ``term`` the terms to ``most``."""
    kept, groups = term_counts(docs, least)
    pairs = pair_divergences(kept, groups)
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(top_terms(kept, groups, most), "term"))
