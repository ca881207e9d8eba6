"""Crops as PNG files with a manifest: ``crops.write.format("crops").mode("append").save(folder)``.

Every attempt of a task writes its files and its part of the manifest below a staging folder of the job. Only the commit
moves the folders of the attempts that count to their place, one rename for each task, and then writes the mark that the
job is done; staging is removed with all that failed, killed or doubled attempts left in it. A job that fails removes its
staging folder. Names carry a digest of the source's whole path, so crops of equal file names don't collide and no
task has to number a class.
"""

from __future__ import annotations

import csv
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Columns that are written: where a crop comes from, its text, and the image value (lamina.operators.images.IMAGE).
COLUMNS = ("path", "label", "image")
STAGING, DONE = "_staging", "_committed"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    rows: int
    unreadable: int


def crop_name(path: str) -> str:
    """The source's stem and a digest of its path."""
    stem = path.rpartition("/")[2].rpartition(".")[0] or path.rpartition("/")[2]
    return f"{stem}-{hashlib.sha256(path.encode()).hexdigest()[:12]}.png"


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> Attempt:
        from lamina.functions import pixels
        from lamina.operators.images import unpacked

        store, root = self._store()
        folder = uuid.uuid4().hex
        own = f"{root}/{STAGING}/{self.job}/{folder}"
        store.create_dir(own)
        out = io.StringIO()
        manifest = csv.writer(out)
        rows = unreadable = 0
        for row in iterator:
            image = unpacked(row["image"])
            if image is None or row["path"] is None:
                unreadable += 1
                continue
            name = crop_name(row["path"])
            with store.open_output_stream(f"{own}/{name}") as file:
                file.write(pixels.encode_png(image))
            manifest.writerow([f"{folder}/{name}", row["label"], "true"])
            rows += 1
        with store.open_output_stream(f"{own}/manifest.csv") as file:
            file.write(out.getvalue().encode())
        return Attempt(folder, rows, unreadable)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, root = self._store()
        for message in messages:
            if message is not None and message.rows:
                store.move(f"{root}/{STAGING}/{self.job}/{message.folder}", f"{root}/{message.folder}")
        done = [m for m in messages if m is not None]
        store.create_dir(f"{root}/{DONE}")
        with store.open_output_stream(f"{root}/{DONE}/{self.job}") as file:
            file.write("".join(f"{m.folder},{m.rows},{m.unreadable}\n" for m in done).encode())
        self._sweep(store, root)

    def abort(self, messages: list[Attempt | None]) -> None:
        self._sweep(*self._store())

    def _sweep(self, store: fs.FileSystem, root: str) -> None:
        staging = f"{root}/{STAGING}/{self.job}"
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class CropFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crops"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = [c for c in COLUMNS if c not in schema.fieldNames()]
        if missing:
            raise ValueError(f"crops need the columns {', '.join(missing)}")
        if overwrite:
            raise ValueError("crops are only appended: a job's files never replace another's")
        return _Writer(self.options["path"])


def write_crops(crops: DataFrame, path: str) -> None:
    """crops(path, label, image) as files below ``path``; rows without a readable image or path are counted in the mark and left out."""
    crops.sparkSession.dataSource.register(CropFiles)
    crops.select(*COLUMNS).write.format("crops").mode("append").save(path)


def read_crop_manifest(spark: SparkSession, path: str) -> DataFrame:
    """image, label, plate_crop of all crops of committed jobs; what a job that is still running moved is not listed yet."""
    done = spark.read.schema("folder string, rows long, unreadable long").csv(f"{path}/{DONE}/*")
    listed = spark.read.schema("image string, label string, plate_crop string").csv(f"{path}/*/manifest.csv")
    return listed.join(done.select("folder"), F.substring_index("image", "/", 1) == F.col("folder"), "left_semi")
