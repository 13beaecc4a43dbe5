"""A table of files whose versions are swapped in one atomic step.

Rows are dealt to buckets by a hash of their key. A version is a manifest: one small JSON file with the table's schema and
the files of each bucket. A merge reads and writes only the buckets that its rows fall into; their new files stand beside the
old ones, and the new manifest lists them with the files of all other buckets. It is written under another name and then
renamed to the next number, which fails where that number is taken, so of two writers one has to merge again. A reader takes
the manifest with the highest number and sees that version whole, whatever is written meanwhile; a writer that dies leaves
files that no manifest names. ``vacuum`` deletes those, and the files of old versions only.

The file system must rename files atomically, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinderlens.sources.stored import hadoop_path

BUCKET = "__bucket"


class Conflict(Exception):
    """Another writer has made this version."""


class VersionedTable:
    """The table in ``folder``; ``key``, ``buckets`` and ``form`` (parquet or json) must be the same each time it is opened."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 16, form: str = "parquet", **options):
        self.spark, self.folder, self.key, self.buckets, self.form, self.options = spark, folder.rstrip("/"), key, buckets, form, options

    # ---- versions

    def _list(self, path: str) -> list:
        hadoop, files = hadoop_path(self.spark, path)
        return list(files.listStatus(hadoop)) if files.exists(hadoop) else []

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._list(f"{self.folder}/versions")]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, the newest unless given; None where there is none."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else None)
        if version is None:
            return None
        hadoop, files = hadoop_path(self.spark, self._name(version))
        stream = files.open(hadoop)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": version}
        finally:
            stream.close()

    def _name(self, version: int) -> str:
        return f"{self.folder}/versions/{version:012d}.json"

    def commit(self, manifest: dict, version: int) -> None:
        """Make ``manifest`` this version, in one step."""
        jvm = self.spark.sparkContext._jvm
        staged, files = hadoop_path(self.spark, f"{self.folder}/versions/.{uuid.uuid4().hex}")
        out = files.create(staged, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        target, _ = hadoop_path(self.spark, self._name(version))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.makeQualified(files.getUri(), files.getWorkingDirectory()).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(staged, target, no_overwrite)
        except Exception as e:
            files.delete(staged, False)
            if version in self.versions():
                raise Conflict(f"version {version} of {self.folder} is there already") from e
            raise

    # ---- rows

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _files(self, manifest: dict | None, buckets: list[int] | None, schema: StructType) -> DataFrame:
        paths = [f"{self.folder}/{p}" for b, own in (manifest or {"files": {}})["files"].items() if buckets is None or int(b) in buckets for p in own]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.format(self.form).schema(schema).load(paths)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        manifest = self.manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"no version of {self.folder}")
        return self._files(manifest, None, StructType.fromJson(manifest["schema"]))

    def get(self, key) -> DataFrame:
        """The rows of one key; only its bucket is read."""
        manifest = self.manifest()
        if manifest is None:
            raise FileNotFoundError(f"no version of {self.folder}")
        schema = StructType.fromJson(manifest["schema"])
        kind = next(f.dataType for f in schema if f.name == self.key)
        bucket = self.spark.range(1).select(self._bucket(F.lit(key).cast(kind))).first()[0]
        return self._files(manifest, [bucket], schema).where(F.col(self.key).eqNullSafe(F.lit(key).cast(kind)))

    def stage(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write ``rows`` by buckets beside what is there; the new files of each bucket."""
        part = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, self._bucket(F.col(self.key))).repartition(BUCKET).sortWithinPartitions(BUCKET, self.key)
        dealt.write.format(self.form).options(**self.options).partitionBy(BUCKET).save(f"{self.folder}/{part}")
        out: dict[str, list[str]] = {}
        for folder in self._list(f"{self.folder}/{part}"):
            name = folder.getPath().getName()
            if name.startswith(f"{BUCKET}="):
                own = [f"{part}/{name}/{s.getPath().getName()}" for s in self._list(f"{self.folder}/{part}/{name}") if not s.getPath().getName().startswith(("_", "."))]
                out[name.partition("=")[2]] = sorted(own)
        return out

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        """A new version in which ``combine(old, rows)`` stands in place of the rows of the buckets that ``rows`` fall into;
        without it ``rows`` take the place of those of equal keys. Returns the version's number."""
        manifest = self.manifest()
        schema = StructType.fromJson(manifest["schema"]) if manifest else rows.schema
        # at most one row per bucket
        touched = [r[0] for r in rows.select(self._bucket(F.col(self.key))).distinct().collect()]
        old = self._files(manifest, touched, schema)
        combine = combine or (lambda before, new: before.join(new.select(self.key).distinct(), self.key, "left_anti").select(*schema.names).unionByName(new.select(*schema.names)))
        files = self.stage(combine(old, rows).select(*schema.names))
        kept = {b: own for b, own in (manifest or {"files": {}})["files"].items() if int(b) not in touched}
        version = manifest["version"] + 1 if manifest else 1
        self.commit({"schema": schema.jsonValue(), "files": kept | files}, version)
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Delete the manifests but the last ``keep`` and the files that none of these names; how many folders and manifests
        went. Not to be called while someone writes or reads an older version."""
        known = self.versions()
        named = {p.split("/")[1] for v in known[-keep:] for own in self.manifest(v)["files"].values() for p in own}
        gone = [s.getPath() for s in self._list(f"{self.folder}/data") if s.getPath().getName() not in named]
        gone += [hadoop_path(self.spark, self._name(v))[0] for v in known[:-keep]]
        gone += [s.getPath() for s in self._list(f"{self.folder}/versions") if s.getPath().getName().startswith(".") and not s.getPath().getName().endswith(".crc")]
        _, files = hadoop_path(self.spark, self.folder)
        for path in gone:
            files.delete(path, True)
        return len(gone)
