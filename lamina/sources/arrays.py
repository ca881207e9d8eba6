"""Cached features in numpy's formats as a data source: ``spark.read.format("features").load(path)``.

``path`` is an .npz file, a folder with one .npy file for features and one for labels, or an .npy file beside its labels.
Arrays go by several names, of which the first that is there counts. Only headers are read to plan; rows are dealt into
partitions, each of which seeks to its rows (or reads past those before them where an archive is compressed) and
passes on a bounded number at a time. Object arrays would need pickle and are refused, as are arrays of columns first.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The names of arrays and files, in the order in which they count.
FEATURES = ("X", "features", "hog", "x")
LABELS = ("y", "labels", "targets", "label")
#: Rows of a partition where the option ``rows`` isn't given, and rows passed on at once.
PARTITION_ROWS, ROWS_AT_ONCE = 100_000, 1_024


@dataclass
class Stored:
    """Where an array lies: a file, or a member of an archive, its header, and the bytes before its first row."""

    path: str
    member: str | None
    shape: tuple[int, ...]
    dtype: np.dtype
    offset: int

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))


@dataclass
class Rows(InputPartition):
    features: Stored
    labels: Stored | None
    start: int
    stop: int


def _header(stream, path: str, member: str | None) -> Stored:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, columns_first, dtype = read(stream)
    if dtype.hasobject:
        raise ValueError(f"{path} {member or ''} holds objects, which only pickle could read")
    if columns_first and len(shape) > 1:
        raise ValueError(f"{path} {member or ''} is stored by columns; rows cannot be read apart")
    return Stored(path, member, shape, dtype, stream.tell())


def _opened(path: str):
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def find_arrays(path: str) -> tuple[Stored, Stored | None]:
    """Features and labels below a path; a missing array is an error, missing labels only where ``path`` is one .npy file."""
    store, name = fs.FileSystem.from_uri(path)
    kind = store.get_file_info(name).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if path.endswith(".npz"):
        with _opened(path) as file, zipfile.ZipFile(file) as archive:
            members = set(archive.namelist())
            pick = [next((f"{n}.npy" for n in names if f"{n}.npy" in members), None) for names in (FEATURES, LABELS)]
            if None in pick:
                raise KeyError(f"{path} needs features and labels, it has {sorted(members)}")
            found = []
            for member in pick:
                with archive.open(member) as stream:
                    found.append(_header(stream, path, member))
            return found[0], found[1]
    here = lambda folder, names: next((p for n in names if store.get_file_info(fs.FileSystem.from_uri(p := f"{folder}/{n}.npy")[1]).type == fs.FileType.File), None)
    if kind == fs.FileType.Directory:
        paths = [here(path.rstrip("/"), FEATURES[:3]), here(path.rstrip("/"), LABELS[:3])]
        if None in paths:
            raise FileNotFoundError(f"no features and labels as .npy files in {path}")
    elif path.endswith(".npy"):
        paths = [path, here(path.rpartition("/")[0], LABELS[:1])]
    else:
        raise ValueError(f"neither .npz, .npy nor a folder: {path}")
    found = []
    for p in paths:
        if p is None:
            found.append(None)
            continue
        with _opened(p) as stream:
            found.append(_header(stream, p, None))
    return found[0], found[1]


def read_rows(array: Stored, start: int, stop: int) -> Iterator[np.ndarray]:
    """Rows start to stop - 1, ROWS_AT_ONCE at a time."""

    def parts(stream) -> Iterator[np.ndarray]:
        stream.seek(array.offset + start * array.row_bytes)
        for at in range(start, stop, ROWS_AT_ONCE):
            n = min(ROWS_AT_ONCE, stop - at)
            data = stream.read(n * array.row_bytes)
            if len(data) < n * array.row_bytes:
                raise EOFError(f"{array.path} ends before row {at + n}")
            yield np.frombuffer(data, array.dtype).reshape(n, *array.shape[1:])

    with _opened(array.path) as file:
        if array.member is None:
            yield from parts(file)
        else:
            with zipfile.ZipFile(file) as archive, archive.open(array.member) as stream:
                yield from parts(stream)


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Rows]:
        features, labels = find_arrays(self.path)
        n = features.shape[0] if features.shape else 0
        if labels is not None and (len(labels.shape) != 1 or labels.shape[0] != n):
            raise ValueError(f"{self.path}: {n} rows of features, labels of shape {labels.shape}")
        return [Rows(features, labels, a, min(n, a + self.rows)) for a in range(0, n, self.rows)]

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # without rows there is no partition
            return
        vectors = read_rows(partition.features, partition.start, partition.stop)
        labels = read_rows(partition.labels, partition.start, partition.stop) if partition.labels else None
        at = partition.start
        for part in vectors:
            flat = part.reshape(len(part), -1).astype(np.float32)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.reshape(-1)))
            names = pa.nulls(len(part), pa.string())
            if labels is not None:
                names = pa.array([x.decode() if isinstance(x, bytes) else str(x) for x in next(labels).tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), names, values], ["row", "label", "vec"])
            at += len(part)


class CachedFeatures(DataSource):
    """row, label (text; null without labels) and vec of cached features. Option ``rows``: rows of a partition."""

    @classmethod
    def name(cls) -> str:
        return "features"

    def schema(self) -> str:
        return "row long, label string, vec array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rows", PARTITION_ROWS)))
