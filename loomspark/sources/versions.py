"""A stored table whose changes are atomic: immutable bucket files, and a manifest for each version.

    path/data/write=<id>/<by>=<value>/part-...    files of one commit, never changed
    path/versions/00000000000000000007.json       version 7: the folder that holds each bucket, and who committed

A commit writes the buckets that change into a folder of its own, then puts the manifest of the next version in place by
one rename, which fails if that version is there already. A reader takes the last manifest and reads the files that it
names, so it sees one whole version, whatever is being written. A job that dies before the rename leaves the old version and a
folder that no manifest names; collect_garbage removes those, and versions that are no longer wanted. Commits of a
streaming query carry its name and batch: a batch that runs again after its commit changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another job committed the version first."""


class VersionedTable:
    """The table at path. schema has all columns, `by` among them: an int or string column that deals rows to buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, by: str):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifests

    def _listed(self, folder: str) -> list:
        p = self._path(f"{self.path}/{folder}")
        return list(self._fs.listStatus(p)) if self._fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[:-5]) for s in self._listed("versions") if s.getPath().getName().endswith(".json"))

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "buckets": {}, "batches": {}}
        stream = self._fs.open(self._path(f"{self.path}/versions/{version:020d}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Puts a manifest in place; fails if its version is there."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        name = f"{self.path}/versions/{manifest['version']:020d}.json"
        draft = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, self._path(name), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(self._path(name)):
                raise Conflict(f"version {manifest['version']} of {self.path} is there already") from e
            raise

    # --- rows

    def read(self, version: int | None = None, buckets: list | None = None) -> DataFrame:
        """One whole version, the last if none is named; of the given buckets only, if any are. Before the first commit: no rows."""
        held = self.manifest(version)["buckets"]
        wanted = held if buckets is None else {str(b): held[str(b)] for b in buckets if str(b) in held}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.path}/data/{folder}/{self.by}={value}" for value, folder in sorted(wanted.items())]
        found = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*folders)
        return found.select(*self.schema.names)

    def commit(self, rows: DataFrame, replaced: list | None = None, parent: int | None = None, query: str | None = None, batch: int | None = None, dealt: bool = False) -> int:
        """A new version in which rows stand for the buckets that they fall in and for the replaced ones; returns its number.

        rows may be read from this table. parent: the version that rows were made from (the last one if none is
        named); Conflict is raised if another job has committed since. query and batch: who commits; a batch of a query
        that is not after its last commit is left out, and the current version is returned. No rows and no replaced
        buckets: a version like the parent. Null in the bucket column is refused. dealt: rows of a bucket lie in one
        partition already and aren't shuffled again.
        """
        before = self.manifest(parent)
        if query is not None and before["batches"].get(query, -1) >= batch:
            return before["version"]
        folder = f"write={uuid.uuid4().hex}"
        # a filter keeps the order of the rows, so those that are sorted by bucket aren't sorted again
        checked = rows.select(*self.schema.names).where(F.col(self.by).isNotNull() | F.raise_error(F.lit("a row without a bucket")).cast("boolean"))
        (checked if dealt else checked.repartition(self.by)).write.option("compression", "zstd").partitionBy(self.by).parquet(f"{self.path}/data/{folder}")
        written = [s.getPath().getName().partition("=")[2] for s in self._listed(f"data/{folder}") if s.isDirectory()]
        buckets = {k: v for k, v in before["buckets"].items() if k not in {str(b) for b in replaced or []}} | dict.fromkeys(written, folder)
        batches = before["batches"] | ({query: batch} if query is not None else {})
        self._publish({"version": before["version"] + 1, "buckets": buckets, "batches": batches, "at": time.time()})
        return before["version"] + 1

    def collect_garbage(self, keep: int = 2, seconds: float = 7 * 86400) -> int:
        """Removes all versions but the last `keep`, and folders of data that no kept version names and that are older than
        `seconds` (younger ones may belong to a commit under way). Returns how many folders went."""
        versions = self.versions()
        kept = versions[-max(1, keep) :]
        named = {f for v in kept for f in self.manifest(v)["buckets"].values()}
        for v in versions[: -max(1, keep)]:
            self._fs.delete(self._path(f"{self.path}/versions/{v:020d}.json"), False)
        gone = 0
        for s in self._listed("data"):
            if s.getPath().getName() not in named and s.getModificationTime() <= (time.time() - seconds) * 1000:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone
