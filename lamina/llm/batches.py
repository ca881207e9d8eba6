"""Arrow batches small enough for whole texts, and tasks that leave little memory in their Python worker."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts in an Arrow batch at most.
ROWS = 256

_caches: dict[str, dict] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; its session's Arrow batches hold at most ROWS rows from now on.

    Spark's default of 10,000 rows would put tens of MB of text twice into each task's memory.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, ROWS)
    return df


def worker_cache(name: str) -> dict:
    """A dict of what one operator's tasks leave in their worker for each other; lean tasks of other operators empty it."""
    return _caches.setdefault(name, {})


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, which empties the worker caches but that named ``keeps`` first and gives freed memory back when it ends.

    Workers live on between tasks and stages, and what they hold back counts as the executor's memory.
    """

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def drop_caches(but: str = "") -> None:
    for name, cache in _caches.items():
        if name != but:
            cache.clear()


def give_back() -> None:
    """Returns the memory that Arrow and the C library hold back, but don't use, to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
