"""Tables that are refreshed in parts and change all at once.

A store is a folder of tables and a ``manifest`` folder. Every refresh writes new files under
its own version, beside those of earlier versions, and then one manifest that says, for each table
and each of its partitions, which version holds the rows. The manifest appears by one rename, so
a reader sees the tables as they were before a refresh or after it, never half. A refresh that
dies leaves files nobody reads, until ``vacuum`` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrain.session import hadoop_path

STAMP = "_version"


class Conflict(RuntimeError):
    """Another refresh was published since the one at hand began."""


@dataclass
class Manifest:
    """What one version of a store holds.

    ``tables`` has, per table, its schema, its partition columns and, by partition path, the
    stamp of the refresh that wrote the partition (an unpartitioned table has the one path "").
    """

    version: int = 0
    tables: dict[str, dict] = field(default_factory=dict)


class Store:
    """Versioned tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # manifests

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        path, files = hadoop_path(self.spark, f"{self.folder}/manifest")
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The named version, or the newest; version 0 is the empty store."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Manifest()
        if version not in known:
            raise LookupError(f"no version {version} in {self.folder}")
        text = self.spark.read.text(self._manifest_path(version), wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _manifest_path(self, version: int) -> str:
        return f"{self.folder}/manifest/{version:010d}.json"

    def _publish(self, manifest: Manifest) -> None:
        jvm = self.spark._jvm
        draft, files = hadoop_path(self.spark, f"{self.folder}/manifest/{uuid.uuid4().hex}.draft")
        final, _ = hadoop_path(self.spark, self._manifest_path(manifest.version))
        files.mkdirs(draft.getParent())
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(vars(manifest)).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # a plain rename refuses to replace a file
            context.rename(files.makeQualified(draft), files.makeQualified(final), plain)
        except Py4JJavaError as refused:
            files.delete(draft, False)
            if files.exists(final):
                raise Conflict(f"version {manifest.version} was published by another refresh") from refused
            raise

    # tables

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version; partition filters reach the list of files."""
        return self._read(self.manifest(version), name)

    def _read(self, manifest: Manifest, name: str) -> DataFrame:
        if name not in manifest.tables:
            raise LookupError(f"no table {name} in version {manifest.version} of {self.folder}")
        entry = manifest.tables[name]
        schema = T.StructType.fromJson(entry["schema"])
        paths = [self._part(name, part, stamp) for part, stamp in sorted(entry["parts"].items())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, T.StructField(STAMP, T.StringType())])
        return self.spark.read.schema(stored).option("basePath", f"{self.folder}/{name}").parquet(*paths).drop(STAMP)

    def _part(self, name: str, part: str, stamp: str) -> str:
        return "/".join(x for x in (self.folder, name, part, f"{STAMP}={stamp}") if x)

    def parts(self, name: str, version: int | None = None) -> dict[str, int]:
        """The version that wrote each partition of a table."""
        return {part: int(stamp.split("-")[0]) for part, stamp in self.manifest(version).tables[name]["parts"].items()}

    def refresh(self) -> Refresh:
        return Refresh(self)

    def vacuum(self, keep: int = 1) -> int:
        """Drop all but the newest ``keep`` versions and the files only those read.

        Returns how many folders went. Files of refreshes that died go too, so none may be under
        way meanwhile.
        """
        known = self.versions()
        old = {v: self.manifest(v) for v in known[:-keep]}
        read = {(name, part, stamp) for v in known[-keep:] for name, e in self.manifest(v).tables.items() for part, stamp in e["parts"].items()}
        depth = {name: len(e["by"]) for v in known for name, e in self.manifest(v).tables.items()}
        for version in old:
            path, files = hadoop_path(self.spark, self._manifest_path(version))
            files.delete(path, False)
        gone = 0
        for name, levels in depth.items():
            for part, stamp, path in self._folders(name, levels, "*"):
                if (name, part, stamp) not in read:
                    hadoop_path(self.spark, self.folder)[1].delete(path, True)
                    gone += 1
        return gone

    def _folders(self, name: str, levels: int, stamp: str) -> list:
        """(partition path, stamp, location) of stored folders."""
        pattern, files = hadoop_path(self.spark, "/".join([self.folder, name, *["*=*"] * levels, f"{STAMP}={stamp}"]))
        found = []
        for status in files.globStatus(pattern) or []:
            *_, part = status.getPath().toUri().getPath().rsplit(f"/{name}/", 1)
            *part, last = part.split("/")
            found.append(("/".join(part), last.removeprefix(f"{STAMP}="), status.getPath()))
        return found


class Refresh:
    """One change of a store: tables replaced whole or by partition, published together."""

    def __init__(self, store: Store):
        self.store = store
        base = store.manifest()
        self.next = Manifest(base.version + 1, {n: dict(e, parts=dict(e["parts"])) for n, e in base.tables.items()})
        # a name of its own, so that neither a dead refresh nor a concurrent one shares files
        self.stamp = f"{self.next.version:010d}-{uuid.uuid4().hex[:12]}"

    def replace(self, name: str, rows: DataFrame) -> None:
        """The whole table becomes ``rows``."""
        entry = self._write(name, rows, ())
        entry["parts"] = {"": self.stamp}

    def replace_partitions(self, name: str, rows: DataFrame, by: Sequence[str], touched: Sequence[Sequence]) -> None:
        """The ``touched`` partitions become ``rows``; others keep the version they have.

        ``touched`` lists values of the partition columns ``by``; rows outside of them are an
        error, and a touched partition without rows is empty from now on. Nothing else is read
        or written.
        """
        names = self.store.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        inside = F.lit(False)
        for values in touched:
            inside = inside | reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, values, strict=True)])
        outside = F.raise_error(F.concat(F.lit(f"{name}: a row lies outside the touched partitions: "), F.to_json(F.struct(*by))))
        checked = rows.withColumn(by[0], F.when(inside, F.col(by[0])).otherwise(outside).cast(rows.schema[by[0]].dataType))
        entry = self._write(name, checked, by)
        for values in touched:
            path = [names.getPartitionPathString(c, None if v is None else str(v)) for c, v in zip(by, values, strict=True)]
            entry["parts"].pop("/".join(path), None)
        entry["parts"] |= {part: stamp for part, stamp, _ in self.store._folders(name, len(by), self.stamp)}

    def _write(self, name: str, rows: DataFrame, by: Sequence[str]) -> dict:
        entry = self.next.tables.setdefault(name, {"by": list(by), "parts": {}})
        if entry["by"] != list(by):
            raise ValueError(f"{name} is partitioned by {entry['by']}")
        # partition columns come last, as a reader of the files finds them
        ordered = rows.select(*[c for c in rows.columns if c not in by], *by)
        entry["schema"] = json.loads(ordered.schema.json())
        if by:
            ordered = ordered.hint("rebalance", *by)
        writer = ordered.withColumn(STAMP, F.lit(self.stamp)).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by, STAMP).parquet(f"{self.store.folder}/{name}")
        return entry

    def publish(self) -> int:
        """Make the change visible; returns its version."""
        if self.store.manifest().version != self.next.version - 1:
            raise Conflict(f"version {self.next.version} was published by another refresh")
        self.store._publish(self.next)
        return self.next.version
