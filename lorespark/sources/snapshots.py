"""Tables that change all at once: staged writes, one manifest for each version, readers that stay on theirs.

A catalogue is a folder with ``data`` (Parquet, a folder for each staged write) and ``manifests`` (one small JSON file for
each version, which names the folder of every bucket of every table).  A run stages the buckets that it touches, then its
manifest is renamed into place, which either happens as a whole or not at all.  A run that died before that left nothing
that a reader could see, and one that is started again with its run id after that finds its version and writes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET, PARTS = "bucket_of_key", 8


@dataclass(frozen=True)
class Change:
    """What becomes of one table: the rows of ``keys`` go, but for those that ``keep`` says stay, and ``rows`` come.

    ``keys`` has the table's key column; None stands for the keys of ``rows``, as an upsert has it.
    """

    rows: DataFrame | None = None
    keys: DataFrame | None = None
    keep: Column | None = None


class Conflict(Exception):
    """Another run published the next version first."""


class Catalogue:
    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, tuple[str, StructType | str]], buckets: int = 16):
        """``tables``: name -> (key column, schema).  ``buckets`` holds for a new catalogue; an old one keeps its own."""
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = {name: (key, spark.createDataFrame([], schema).schema) for name, (key, schema) in tables.items()}
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        folder = self._path(f"{self.root}/manifests")
        self._fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(folder)
        head = self.manifest()
        self.buckets = head["buckets"] if head else buckets

    def versions(self) -> list[int]:
        found = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(x[1:-5]) for x in found if x.startswith("v") and x.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of ``version``, or of the newest; None if there is none yet."""
        version = version or max(self.versions(), default=0)
        if not version:
            return None
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as ``version`` has it (None: the newest one now); what later runs publish does not reach this reader."""
        _, schema = self.tables[name]
        at = ((self.manifest(version) or {}).get("tables") or {}).get(name, {})
        paths = [p for b, p in sorted(at.items()) if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{p}" for p in paths])

    def published(self, run_id: str) -> int | None:
        """The version that the run published, if it did."""
        head = self.manifest()
        return (head or {"runs": {}})["runs"].get(run_id)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def stage(self, changes: Mapping[str, Change], base: int | None) -> dict[str, dict[str, str | None]]:
        """Write the touched buckets of each table; what is returned maps a bucket to its new folder, or to None if nothing is left in it.

        Only buckets that hold one of the keys are read and written.  Keys are met by a shuffle on themselves, so no list of
        them goes through the driver; the buckets do, and there are ``buckets`` of them at most.
        """
        staged: dict[str, dict[str, str | None]] = {}
        for name, change in changes.items():
            key, schema = self.tables[name]
            rows = change.rows if change.rows is not None else self.spark.createDataFrame([], schema)
            rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])
            keys = (change.keys if change.keys is not None else rows).select(F.col(key).cast(schema[key].dataType)).distinct()
            touched = [r[0] for r in keys.select(self._bucket(key)).union(rows.select(self._bucket(key))).distinct().collect()]
            old = self.read(name, base, touched) if base else self.spark.createDataFrame([], schema)
            gone = keys.withColumn("gone", F.lit(True))
            stays = F.col("gone").isNull() if change.keep is None else F.col("gone").isNull() | F.coalesce(change.keep, F.lit(False))
            left = old.join(gone, old[key].eqNullSafe(gone[key]), "left").where(stays).select(*[old[f.name] for f in schema])
            folder = f"{name}-{uuid.uuid4().hex}"
            whole = left.unionByName(rows).withColumn(BUCKET, self._bucket(key))
            part = F.pmod(F.xxhash64(F.to_json(F.struct(*schema.names))), F.lit(PARTS))  # so that a key of very many rows is no one task's
            whole.repartition(F.col(BUCKET), part).write.partitionBy(BUCKET).parquet(f"{self.root}/data/{folder}")
            there = {x.getPath().getName().partition("=")[2] for x in self._fs.listStatus(self._path(f"{self.root}/data/{folder}")) if x.isDirectory()}
            staged[name] = {str(b): f"{folder}/{BUCKET}={b}" if str(b) in there else None for b in touched}
        return staged

    def publish(self, run_id: str, staged: Mapping[str, Mapping[str, str | None]], base: int | None) -> int:
        """Make the staged buckets the next version; :class:`Conflict` if ``base`` is no longer the newest."""
        old = self.manifest(base) if base else None
        version = (base or 0) + 1
        tables = {name: dict(at) for name, at in (old["tables"] if old else {}).items()}
        for name, at in staged.items():
            mine = tables.setdefault(name, {})
            mine.update({b: p for b, p in at.items() if p})
            for b in (b for b, p in at.items() if not p):
                mine.pop(b, None)
        runs = (old["runs"] if old else {}) | {run_id: version}
        text = json.dumps({"version": version, "run_id": run_id, "buckets": self.buckets, "tables": tables, "runs": runs})
        draft = self._path(f"{self.root}/manifests/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(text.encode())
        out.close()
        jvm, final = self.spark._jvm, self._path(f"{self.root}/manifests/v{version:010d}.json")
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark._sc._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), none)
        except Exception as e:
            if not self._fs.exists(final):
                raise
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} is there already") from e
        return version

    def apply(self, run_id: str, changes: Mapping[str, Change]) -> int:
        """Stage and publish ``changes`` of any number of tables as one version, once for each ``run_id``.

        A run that was published before changes nothing and gives its version.  If another run comes first the changes are
        staged again on top of it.
        """
        while True:
            done = self.published(run_id)
            if done:
                return done
            base = max(self.versions(), default=0) or None
            try:
                return self.publish(run_id, self.stage(changes, base), base)
            except Conflict:
                continue

    def vacuum(self, keep: int = 2) -> int:
        """Remove what none of the ``keep`` newest versions names: older manifests and folders, staged ones of dead runs among
        them.  Not for use while a run is under way.  Returns the number of folders removed."""
        versions = self.versions()[-keep:]
        held = {p.split("/")[0] for v in versions for at in self.manifest(v)["tables"].values() for p in at.values()}
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        data, n = self._path(f"{self.root}/data"), 0
        for x in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if x.getPath().getName() not in held:
                n += self._fs.delete(x.getPath(), True)
        return n
