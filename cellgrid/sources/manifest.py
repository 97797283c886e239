"""A log of small JSON manifests in a folder: a new one appears whole, under the next number, or not at all."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class ManifestLog:
    """Manifests ``00000001.json``, ``00000002.json`` .. below ``folder``.

    A commit writes a hidden file and gives it its name in one step that fails where the name is taken: a rename without
    overwriting, which such stores do at once, and on a local disk, where it would overwrite, a link. So of several writers that
    follow the same manifest exactly one wins, and readers see the old one or the new.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        if not self._files.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.folder))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict[str, Any]:
        stream = self._files.open(self._path(self._name(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict[str, Any]] | None:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def commit(self, number: int, manifest: dict[str, Any]) -> None:
        """FileExistsError where ``number`` is taken."""
        hidden, target = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(self._name(number))
        out = self._files.create(hidden, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        taken = FileExistsError(f"manifest {number} of {self.folder} exists")
        try:
            if self._files.getScheme() == "file":
                self._link(hidden, target)
            else:
                rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(rename, 1)
                options[0] = rename.NONE
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), self._conf)
                context.rename(hidden, target, options)
        except Py4JJavaError as err:
            if "AlreadyExists" in err.java_exception.getClass().getName():
                raise taken from None
            raise
        finally:
            self._files.delete(hidden, False)

    def _link(self, hidden, target) -> None:
        nio = self.spark._jvm.java.nio.file
        places = [self.spark._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, hidden)]
        nio.Files.createLink(*places)

    def _name(self, number: int) -> str:
        return f"{self.folder}/{number:08d}.json"
