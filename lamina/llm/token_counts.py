"""Token counts through a digest cache.

Content is keyed by the SHA-256 of its normalised text and by a digest of the
tokenizer's file and settings. Only distinct texts whose key the cache lacks are
encoded; their counts are appended to the cache (Parquet, one row per key, a folder for
each tokenizer version, so that no other version's rows are read), and every document
takes its count from there. A cache that grew by many small appends is made small again
by ``compact_cache``.

Where the tokenizer cuts texts before single spaces in any case, a task keeps the library's counts of pieces that it
met twice, and the library encodes of each text only what is left.

Defined results: a null text counts as empty (0 tokens); copies share one
count; an empty table gives an empty table; other columns are dropped. The
cache may hold a key twice after concurrent appends: reading it keeps one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import compress, repeat
from operator import not_

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lamina.llm.batches import small_batches, worker_cache

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
TEXTS_AT_ONCE = 64
#: Pieces whose counts a task keeps, about; characters of such a piece at most.
PIECES, PIECE_CHARS = 1 << 17, 32
#: Characters of a text that is cut into pieces at most; a longer one is encoded whole, as its pieces would fill the memory.
TEXT_CHARS = 1 << 20

_tokenizers: dict[str, object] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the settings counts depend on."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + b"|no special tokens|no truncation|no padding").hexdigest()


def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """The library's count for a list of texts; loaded once per worker process."""
    if path not in _tokenizers:
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _tokenizers[path] = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _tokenizers[path] = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return _tokenizers[path]


def _added_tokens(path: str) -> list[str] | None:
    """Tokens that the library finds before it cuts a text, if it cuts all else before each single space that a visible character follows; else None.

    So does the byte-level pattern: a match holds a space only as its first character or within a run of white space, whose last
    character is left to what follows.
    """
    if path.endswith(".model"):
        return None
    with open(path, "rb") as file:
        made = json.load(file)
    cut, model = made.get("pre_tokenizer") or {}, made["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    if not plain or made.get("normalizer") or model.get("type") != "BPE" or model.get("dropout"):
        return None
    return [token["content"] for token in made.get("added_tokens") or []]


class _Pieces:
    """The library's counts of texts, as sums over pieces that are encoded once."""

    _cut = staticmethod(re.compile(r" (?=\S)").split)

    def __init__(self, count: Callable[[list[str]], list[int]], added: list[str]):
        self.count, self.added = count, added
        self.known: dict[str, int] = {}  # of a piece without the space before it, the count with it
        self.met: set[str] = set()

    def learn(self, texts: list[list[str]]) -> None:
        """Counts pieces that were met in an earlier list of texts too."""
        fresh = set().union(*texts).difference(self.known)
        again = [piece for piece in fresh & self.met if len(piece) <= PIECE_CHARS]
        for at in range(0, len(again), 1024):
            some = again[at : at + 1024]
            self.known.update(zip(some, self.count([" " + piece for piece in some]), strict=True))
        self.met = self.met | fresh if len(self.met) < 4 * PIECES else fresh
        if len(self.known) >= PIECES:
            self.met = set()

    def __call__(self, texts: list[str]) -> list[int]:
        # A text that holds an added token is encoded whole.
        cut = [[text] if len(text) > TEXT_CHARS or any(token in text for token in self.added) else self._cut(text) for text in texts]
        first = [pieces.pop(0) for pieces in cut]
        if len(self.known) < PIECES:
            self.learn(cut)
        sums, rest = [], []
        for start, pieces in zip(first, cut, strict=True):
            counts = list(map(self.known.get, pieces, repeat(0)))
            sums.append(sum(counts))
            rest.append(" ".join([start, *compress(pieces, map(not_, counts))]))
        return [a + b for a, b in zip(sums, self.count(rest), strict=True)]


def _fast_counter(path: str) -> Callable[[list[str]], list[int]]:
    """The library's counts; by pieces where the tokenizer allows it."""
    cache = worker_cache("token_counts")
    if path not in cache:
        added = _added_tokens(path)
        cache[path] = _counter(path) if added is None else _Pieces(_counter(path), added)
    return cache[path]


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        seen: dict[bytes, bytes] = {}
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest not in seen:
                seen[digest] = pack(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.binary())], ["digest", "packed"])


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """digest, n_tokens of one tokenizer version; None where no cache has been written."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return cache.filter(F.col("version") == version).select("digest", "n_tokens").dropDuplicates(["digest"])


def count_tokens(
    docs: DataFrame,
    cache_path: str,
    tokenizer_path: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    normalise: Callable[[Column], Column] = lambda c: F.coalesce(c, F.lit("")),
) -> DataFrame:
    """Columns ``keep`` with n_bytes and n_tokens; appends to the cache what it lacked.

    ``normalise`` must not change counts; the default only turns null into empty.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_path)
    content = normalise(F.col(text))
    digest = F.unhex(F.sha2(content, 256)).alias("digest")

    # Texts cross the shuffle as zstd frames, two thirds of the bytes of Spark's own compression. One row of each text leaves its map task, so a
    # text that a third of all rows repeat moves once a task.
    packed = small_batches(docs.select(digest, content.alias("__text"))).mapInArrow(_pack, "digest binary, packed binary")
    misses = packed.dropDuplicates(["digest"])
    if (known := read_cache(spark, cache_path, version)) is not None:
        misses = misses.join(known, "digest", "left_anti")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, unpack = _fast_counter(tokenizer_path), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                counts = count([unpack(x).decode() for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    small_batches(misses).mapInArrow(run, CACHE_SCHEMA).write.mode("append").partitionBy("version").parquet(cache_path)
    stored = read_cache(spark, cache_path, version)
    lengths = docs.select(*keep, digest, F.octet_length(content).cast("long").alias("n_bytes"))
    return lengths.join(stored, "digest").select(*keep, "n_bytes", "n_tokens")


def compact_cache(spark: SparkSession, cache_path: str, compacted_path: str, rows_a_file: int = 5_000_000) -> None:
    """Writes the cache anew at another place: one row a key, few files a version."""
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).dropDuplicates(["version", "digest"])
    cache.write.partitionBy("version").option("maxRecordsPerFile", rows_a_file).parquet(compacted_path)
