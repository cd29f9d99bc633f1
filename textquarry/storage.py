"""A stored index: folders of rows that are only ever added, and small files that say which of them are the index.

A version names its folders; the newest version is the current one. Adding rows writes one folder and one version, and
rewrites nothing. A version is written after its rows, so a lost executor or a failed job leaves the last good version in
place. Rows are partitioned by ``source_type``; vectors lie in the same files and are pruned where they aren't read. All
access goes through the file system of the path, so the index may lie on any that the cluster shares.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.runtime import Folder


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path, keep
        self.folder = Folder(spark, path)

    def versions(self) -> list[str]:
        """Names of the stored versions, oldest first."""
        return [n for n in self.folder.names() if n.startswith("v=")]

    def current(self) -> dict | None:
        """The newest version; None if there is none or the index was cleared."""
        names = self.versions()
        meta = json.loads(self.folder.read(names[-1])) if names else {"parts": None}
        return None if meta["parts"] is None else meta

    def load(self) -> DataFrame | None:
        """The rows of the current version, or None."""
        meta = self.current()
        if meta is None:
            return None
        # The schema is stored too, so that an empty version can be read.
        schema = T.StructType.fromJson(meta["schema"])
        return self._read(schema, meta["parts"])

    def _read(self, schema: T.StructType, parts: list[str]) -> DataFrame:
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{p}" for p in parts])
        return rows.select(schema.names)

    def _write(self, chunks: DataFrame) -> tuple[str, int]:
        """(folder of the rows, id after their largest)."""
        part = f"part={time.time_ns()}"
        chunks.write.partitionBy("source_type").parquet(f"{self.path}/{part}")
        last = self._read(chunks.schema, [part]).agg(F.max("vec_id")).first()[0]
        return part, -1 if last is None else last

    def save(self, chunks: DataFrame, **meta) -> dict:
        """Make these rows the index; older versions beyond ``keep`` are deleted (0 or less keeps all)."""
        part, last = self._write(chunks)
        return self._publish(meta | {"parts": [part], "schema": json.loads(chunks.schema.json()), "next_vec_id": last + 1})

    def append(self, chunks: DataFrame, **meta) -> dict:
        """Add rows to the current ones; only the new rows are written."""
        now = self.current()
        if now is None:
            return self.save(chunks, **meta)
        schema = T.StructType.fromJson(now["schema"])
        part, last = self._write(chunks.select(schema.names))
        return self._publish(now | meta | {"parts": [*now["parts"], part], "next_vec_id": max(now["next_vec_id"], last + 1)})

    def _publish(self, meta: dict) -> dict:
        meta = meta | {"version": f"v={time.time_ns():020d}"}
        self.folder.write(meta["version"], json.dumps(meta))
        if self.keep > 0:
            versions = self.versions()
            kept = versions[-1 - self.keep :]
            used = {p for v in kept for p in json.loads(self.folder.read(v))["parts"] or []}
            for name in self.folder.names():
                # A folder newer than this version belongs to a writer still at work.
                if name in versions and name not in kept or name.startswith("part=") and name not in used and int(name[5:]) < int(kept[0][2:]):
                    self.folder.delete(name)
                    if name in versions:
                        self.folder.delete(f"keywords/{name}")
        return meta

    def restore_previous(self) -> dict | None:
        """Make the newest version before the current one current again; None if there is none."""
        now = self.current()
        before = [v for v in self.versions() if now and v < now.get("restored", now["version"])]
        if not before:
            return None
        meta = json.loads(self.folder.read(before[-1]))
        return None if meta["parts"] is None else self._publish(meta | {"restored": before[-1]})

    def clear(self, files: bool = False) -> None:
        """Forget the current version, and delete the files if asked."""
        if files:
            self.folder.delete()
        elif self.current() is not None:
            self._publish({"parts": None})
