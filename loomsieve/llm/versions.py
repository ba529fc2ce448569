"""Tables that live on in a named folder from one run to the next.

A version is a manifest, a small JSON file that names the folders of its data. Data is
written first; the manifest then appears by one rename, which fails if another writer
was there first. So a lost executor or driver leaves the last version as it was.
Folders that no manifest of the last two versions names are dropped after a commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    """The versions in ``folder``; state is what the last manifest holds, None at first."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))
        numbers = sorted(n for x in self._fs.listStatus(self._path(self.folder)) if (n := self._number(x.getPath().getName())) is not None)
        self.number = numbers[-1] if numbers else 0
        self.state = self._load(self.number) if numbers else None

    @staticmethod
    def _number(name: str) -> int | None:
        return int(name[9:-5]) if name.startswith("manifest-") and name.endswith(".json") else None

    def _manifest(self, n: int) -> str:
        return f"{self.folder}/manifest-{n:08}.json"

    def _load(self, n: int) -> dict:
        return json.loads(self.spark.read.text(self._manifest(n), wholetext=True).first()[0])

    def new_folder(self, name: str) -> str:
        """A path for data of the next version, relative to the folder."""
        return f"{name}-{uuid.uuid4().hex}"

    def at(self, relative: str) -> str:
        return f"{self.folder}/{relative}"

    def commit(self, state: dict, folders: set[str]) -> None:
        """Make ``state`` the next version; ``folders`` are those it names."""
        n = self.number + 1
        part = self._path(f"{self.folder}/_{uuid.uuid4().hex}.json")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(state | {"folders": sorted(folders)}).encode()))
        finally:
            out.close()
        if self._fs.exists(self._path(self._manifest(n))) or not self._fs.rename(part, self._path(self._manifest(n))):
            self._fs.delete(part, False)
            raise RuntimeError(f"version {n} of {self.folder} was written by another")
        last = set(self.state["folders"]) if self.state else set()
        keep = last | folders
        for x in self._fs.listStatus(self._path(self.folder)):
            name = x.getPath().getName()
            old = self._number(name)
            if (x.isDirectory() and name not in keep) or (old is not None and old < n - 1):
                self._fs.delete(x.getPath(), True)
        self.number, self.state = n, state | {"folders": sorted(folders)}
