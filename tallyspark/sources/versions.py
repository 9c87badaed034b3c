"""Tables whose slices are replaced whole, behind one manifest.

A slice is one value of the partition columns. A writer adds its slices as new folders beside the old ones and then
publishes a manifest that names the folder of every slice. Manifests are numbered; number n+1 can be made only once, so
of two writers one is first. The other looks again: if the slices it replaces are as it found them, it publishes on top,
else it raises ``Conflict``. A reader lists the folders of one manifest, so it sees one version, also while others are
published; folders stay until ``KEEP`` later versions exist.

The folder's file system must refuse to rename onto an existing file (HDFS does so atomically).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Versions that stay readable; attempts to publish among other writers.
KEEP, ATTEMPTS = 5, 50
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
Slice = tuple[str | None, ...]


class Conflict(RuntimeError):
    """Another writer replaced one of the same slices first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[str]):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), list(partition_by)
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        folder = self._path("_manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(folder) if f.getPath().getName()[0] != ".")

    def manifest(self, number: int | None = None) -> dict:
        """The latest version, or one by number: ``number``, ``schema``, ``slices``, ``marks``."""
        if number is None:
            number = max(self._numbers(), default=0)
        if not number:
            return {"number": 0, "schema": None, "slices": {}, "marks": []}
        stream = self._fs.open(self._path(f"_manifests/{number:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"number": number}

    @staticmethod
    def slice_of(folder: str) -> Slice:
        """The partition values in a folder's name."""
        values = [unquote(x.split("=", 1)[1]) for x in folder.split("/")]
        return tuple(None if v == NULL_FOLDER else v for v in values)

    def read(self, covers: Callable[[Slice], bool] | None = None, number: int | None = None) -> DataFrame:
        """One version's rows, of the slices that ``covers`` accepts only."""
        m = self.manifest(number)
        if m["schema"] is None:
            raise LookupError(f"nothing was published at {self.path}")
        schema = T.StructType.fromJson(m["schema"])
        folders = [f"{self.path}/{k}/version={v}" for k, v in sorted(m["slices"].items()) if covers is None or covers(self.slice_of(k))]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders).select(*schema.names)

    def replace(self, df: DataFrame, covers: Callable[[Slice], bool], marks: Sequence[str] = ()) -> int:
        """Publish ``df`` in place of all slices that ``covers`` accepts; ``df`` may read this table.

        Rows outside of these slices are an error. ``marks`` are names that the manifest keeps.
        """
        seen = self.manifest()
        version = uuid.uuid4().hex
        names = [c for c in df.columns if c not in self.partition_by] + self.partition_by
        df = df.select(*names)
        # rows of a slice together, so that it gets few files; a large slice is split again at run time
        df.hint("rebalance", *self.partition_by).withColumn("version", F.lit(version)).write.mode("append").partitionBy(*self.partition_by, "version").parquet(self.path)
        root = self._fs.makeQualified(self._hadoop.Path(self.path)).toString().rstrip("/") + "/"
        made = [f.getPath().getParent().toString().removeprefix(root) for f in self._fs.globStatus(self._path("*/" * len(self.partition_by) + f"version={version}")) or []]
        if strange := [k for k in made if not covers(self.slice_of(k))]:
            self._drop({k: version for k in made})
            raise ValueError(f"rows outside of what is replaced: {', '.join(sorted(strange)[:5])}")
        mine = lambda m: {k: v for k, v in m["slices"].items() if covers(self.slice_of(k))}
        for _ in range(ATTEMPTS):
            now = self.manifest()
            if mine(now) != mine(seen):
                self._drop({k: version for k in made})
                raise Conflict(f"slices of {self.path} were replaced by version {now['number']}")
            kept = {k: v for k, v in now["slices"].items() if not covers(self.slice_of(k))}
            if self._publish(now["number"] + 1, {"schema": df.schema.jsonValue(), "slices": kept | dict.fromkeys(made, version), "marks": sorted({*now["marks"], *marks})}):
                self.vacuum()
                return now["number"] + 1
        raise Conflict(f"no turn to publish at {self.path}")

    def _publish(self, number: int, content: dict) -> bool:
        """False if another writer made this number."""
        final, mine = self._path(f"_manifests/{number:012d}.json"), self._path(f"_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(mine, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        kind = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(mine), self._fs.makeQualified(final), options)
            return True
        except Exception as e:
            if not self._fs.exists(final):
                raise
            self._fs.delete(mine, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False

    def _drop(self, slices: dict[str, str]) -> None:
        for k, v in slices.items():
            self._fs.delete(self._path(f"{k}/version={v}"), True)

    def vacuum(self, keep: int = KEEP) -> None:
        """Remove all but the last ``keep`` versions, and the folders that only these held."""
        numbers = self._numbers()
        old, new = numbers[:-keep], numbers[-keep:]
        if not old:
            return
        held = {(k, v) for n in new for k, v in self.manifest(n)["slices"].items()}
        for n in old:
            self._drop({k: v for k, v in self.manifest(n)["slices"].items() if (k, v) not in held})
            self._fs.delete(self._path(f"_manifests/{n:012d}.json"), False)
