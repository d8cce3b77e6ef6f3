"""Stage tables that a run started again finds finished.

A stage is a folder of output and a manifest beside it, which is written after the output and
names what it was made of: a stamp of the inputs and parameters, and the files with their
lengths. A run started again reads a stage whose stamp and files still agree; any other
stage loses its manifest first and is then written anew. So what a killed run left
half-written is never read. One run at a time may use a folder.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFESTS = "_manifests"


def _place(spark: SparkSession, path: str):
    """Path of the shared file system and that file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def files_of(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, int, int]]:
    """Path, length and time of every data file of ``paths``: files, folders or patterns, in order."""
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        place, system = _place(spark, path)
        for status in system.globStatus(place) or []:
            files = system.listFiles(status.getPath(), True)
            while files.hasNext():
                file = files.next()
                if not file.getPath().getName().startswith(("_", ".")):
                    found.append((str(file.getPath()), file.getLen(), file.getModificationTime()))
    return sorted(found)


def stamp(*facts) -> str:
    """Digest of anything that can be written as text."""
    return hashlib.sha256(json.dumps(facts, sort_keys=True, default=repr).encode()).hexdigest()


class Stages:
    """The stages of one folder; ``reused`` names those that were found finished."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.reused: list[str] = []

    def _manifest(self, name: str) -> str:
        return f"{self.folder}/{MANIFESTS}/{name}.json"

    def _lengths(self, name: str) -> list[list]:
        return [[path.rsplit("/", 1)[1], length] for path, length, _ in files_of(self.spark, f"{self.folder}/{name}")]

    def finished(self, name: str, mark: str) -> dict | None:
        """The manifest of a stage that is whole and was made of the same."""
        place, system = _place(self.spark, self._manifest(name))
        if not system.exists(place):
            return None
        stream = system.open(place)
        try:
            held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return held if held["stamp"] == mark and held["files"] == self._lengths(name) else None

    def _open(self, name: str) -> None:
        place, system = _place(self.spark, self._manifest(name))
        system.delete(place, False)

    def _close(self, name: str, mark: str, schema: str | None) -> None:
        text = json.dumps({"stamp": mark, "schema": schema, "files": self._lengths(name)})
        place, system = _place(self.spark, self._manifest(name))
        draft, _ = _place(self.spark, f"{self._manifest(name)}.draft")
        stream = system.create(draft, True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        if not system.rename(draft, place):
            raise OSError(f"the manifest of {name} could not be written")

    def table(self, name: str, mark: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage, made only if it is not there."""
        path, held = f"{self.folder}/{name}", self.finished(name, mark)
        if held:
            self.reused.append(name)
            return self.spark.read.schema(T.StructType.fromJson(json.loads(held["schema"]))).parquet(path)
        self._open(name)
        df = make()
        df.write.mode("overwrite").parquet(path)
        self._close(name, mark, df.schema.json())
        return self.spark.read.schema(df.schema).parquet(path)

    def export(self, name: str, mark: str, write: Callable[[str], None]) -> None:
        """Files written by ``write`` to the path it is given, if they are not there."""
        if self.finished(name, mark):
            self.reused.append(name)
            return
        self._open(name)
        write(f"{self.folder}/{name}")
        self._close(name, mark, None)
