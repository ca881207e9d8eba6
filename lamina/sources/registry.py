"""A model registry of small files in a store that all writers share.

``<root>/<name>/versions/<n>`` describes version n, ``<root>/<name>/aliases/<alias>/<k>`` is the alias' k-th value; the
largest k counts. Either is made by creating a file that must not exist, which distributed file systems decide for one writer
alone (on a local disk, where Hadoop's client would look first and create then, a filled file is linked to its name), so
numbers are claimed without locks: whoever loses reads again and takes the next one. An alias moves only from the
value that its writer has judged (compare and set). A run that registers again gets the version that it has.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PRODUCTION = "production"
#: Features of models that were named by the method alone before its cells had two sizes: a fixed value.
LEGACY_HOG = 324
#: Times to read a file that another writer has created and not yet filled, and seconds in between.
TRIES, PAUSE = 50, 0.1


def local(store) -> bool:
    return store.getScheme() == "file"


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm

    def _at(self, *parts: object):
        path = self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, *parts: str) -> list[int]:
        path, store = self._at(*parts)
        if not store.exists(path):
            return []
        names = (status.getPath().getName() for status in store.listStatus(path))
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, *parts: object) -> dict:
        path, store = self._at(*parts)
        for _ in range(TRIES):
            if local(store):
                with open(path.toUri().getPath(), encoding="utf-8") as file:
                    return json.load(file)
            stream = store.open(path)
            try:
                text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                return json.loads(text)
            time.sleep(PAUSE)
        raise OSError(f"{path} was created but never filled")

    def _create(self, value: dict, *parts: object) -> bool:
        """Whether this writer created the file; False where it is there already."""
        path, store = self._at(*parts)
        store.mkdirs(path.getParent())
        text = json.dumps(value, sort_keys=True) + "\n"
        if local(store):
            target = path.toUri().getPath()
            filled = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
            with open(filled, "w", encoding="utf-8") as file:
                file.write(text)
            try:
                os.link(filled, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(filled)
        try:
            stream = store.create(path, False)
        except Exception as error:
            if store.exists(path):
                return False
            raise error
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def versions(self, name: str) -> list[dict]:
        return [self._read(name, "versions", n) for n in self._numbers(name, "versions")]

    def append(self, name: str, run: str, metadata: dict) -> dict:
        """The version of a run: what it has, else the next number."""
        while True:
            known = self._numbers(name, "versions")
            for n in reversed(known):
                if (found := self._read(name, "versions", n))["run"] == run:
                    return found
            value = {**metadata, "name": name, "version": (known[-1] if known else 0) + 1, "run": run}
            if self._create(value, name, "versions", value["version"]):
                return value

    def alias(self, name: str, alias: str = PRODUCTION) -> tuple[int, dict | None]:
        """(number of the alias' value, version): 0 and None where it was never set."""
        moves = self._numbers(name, "aliases", alias)
        if not moves:
            return 0, None
        return moves[-1], self._read(name, "versions", self._read(name, "aliases", alias, moves[-1])["version"])

    def move(self, name: str, alias: str, version: int, after: int) -> bool:
        """Points the alias to a version if its value is still the one numbered ``after``."""
        return self._create({"version": version}, name, "aliases", alias, after + 1)

    def register(self, name: str, run: str, metadata: dict, gate: float, alias: str = PRODUCTION) -> dict:
        """Registers a run and promotes it if its accuracy passes the gate and is no worse than the champion's at that moment."""
        value = self.append(name, run, metadata)
        while True:
            number, champion = self.alias(name, alias)
            if champion is not None and champion["version"] == value["version"]:
                return {**value, "promoted": True}
            if not should_promote(value["accuracy"], gate, champion and champion["accuracy"]):
                return {**value, "promoted": False}
            if self.move(name, alias, value["version"], number):
                return {**value, "promoted": True}

    def register_all(self, versions: DataFrame, gate: float) -> list[dict]:
        """Registers rows (name, version, accuracy) in the order of their versions, run by run: a list of models, not of data."""
        rows = versions.select("name", "version", "accuracy").orderBy("name", "version").collect()
        return [self.register(r["name"], f"{r['name']}-{r['version']}", {"accuracy": r["accuracy"]}, gate) for r in rows]


def should_promote(accuracy: float, gate: float, champion: float | None) -> bool:
    return accuracy >= gate and (champion is None or accuracy >= champion)


def installed(metadata: dict, features: int) -> dict:
    """Metadata of a model that is to serve, checked against the number of features that its scaler takes."""
    declared = metadata.get("feature_dim")
    if declared and int(declared) != features:
        raise ValueError(f"the metadata declares {declared} features, the scaler takes {features}")
    method = metadata.get("feature_method", "hog")
    return {**metadata, "feature_method": "hog_legacy" if method == "hog" and features == LEGACY_HOG else method}


def serving(registry: Registry, name: str, load: Callable[[dict], object], apply: Callable[[object, DataFrame, int], None], alias: str = PRODUCTION) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that reads the alias before every micro-batch and swaps the model where it has moved.

    A batch is served by one version from start to end. A version that cannot be loaded leaves the one that serves in place.
    """
    held: dict = {"version": None, "model": None}

    def batch(rows: DataFrame, number: int) -> None:
        _, version = registry.alias(name, alias)
        if version is not None and version["version"] != held["version"]:
            try:
                held.update(model=load(version), version=version["version"])
            except Exception:
                if held["version"] is None:
                    raise
        if held["version"] is None:
            raise LookupError(f"{name} has no version behind {alias}")
        apply(held["model"], rows, number)

    return batch
