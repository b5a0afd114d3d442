"""Tables of immutable Parquet files whose versions are lists of files.

A change writes new files into a folder of its own, then publishes one log record that names the files
added and removed. Files are never changed in place: a reader that has resolved a version keeps it while
others merge, older versions stay readable until they expire, and a change that dies before its record
has changed nothing. The lists carry per file the row count and the least and greatest value of some
columns, so readers and merges can leave files out without opening them.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.merge import latest_per_id, remove_folder, table_exists

#: A full list of files is stored once in so many versions.
CHECKPOINT_EVERY = 20
HISTORY = "version bigint, committed_at timestamp, operation string, tag string, added_files bigint, added_rows bigint, removed_files bigint, high_water_mark timestamp"


class Conflict(Exception):
    """Another writer has published the version first; the change has to be made again on its result."""


@dataclass(frozen=True)
class SnapshotTable:
    """A table below ``path``. ``partition`` is a date or integer column; files are sorted by ``order`` and
    listed with the bounds of ``zones``. ``mark`` is a timestamp column whose maximum each version keeps. Files carry
    Bloom filters of the columns ``bloom``, by which equality filters skip row groups."""

    spark: SparkSession
    path: str
    schema: T.StructType
    partition: str
    zones: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    mark: str | None = None
    bloom: tuple[str, ...] = ()

    @staticmethod
    def open(spark: SparkSession, path: str) -> SnapshotTable:
        """The table as its last version describes it."""
        bare = SnapshotTable(spark, path, T.StructType(), "")
        found = bare._records(bare.versions()[-1:])
        if not found:
            raise ValueError(f"no table at {path}")
        t = found[0]["table"]
        return SnapshotTable(spark, path, T.StructType.fromJson(t["schema"]), t["partition"], tuple(t["zones"]), tuple(t["order"]), t["mark"], tuple(t["bloom"]))

    # The log

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Published versions that have not expired."""
        jvm, fs = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/*.json"))
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found or [])

    def exists(self) -> bool:
        return bool(self.versions())

    def current(self) -> int:
        return max(self.versions(), default=0)

    def _records(self, versions: Iterable[int]) -> list[dict]:
        """Log records; small files, which the driver reads itself."""
        jvm, fs = self._fs()
        found = []
        for v in versions:
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{v:012d}.json"))
            found.append(json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
        return found

    def _publish(self, record: dict) -> None:
        """One rename, which fails if the version is there already."""
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        draft, final = path(f"{self.path}/log/_{uuid.uuid4().hex}"), path(f"{self.path}/log/{record['version']:012d}.json")
        out = fs.create(draft, False)
        out.write(json.dumps(record).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {record['version']} of {self.path} exists") from error
            raise

    def history(self, limit: int | None = None) -> DataFrame:
        """The versions, newest first."""
        records = self._records(self.versions()[-limit:] if limit else self.versions())
        at = lambda r, k: datetime.datetime.fromisoformat(r[k]) if r[k] else None
        rows = [
            (r["version"], at(r, "at"), r["operation"], r["tag"], r["added_files"], r["added_rows"], r["removed_files"], at(r, "high_water_mark"))
            for r in records
        ]
        return self.spark.createDataFrame(rows, HISTORY).orderBy(F.desc("version"))

    def describe(self) -> DataFrame:
        """Location, partitioning, fields, and the current version's files and rows; one row."""
        total = self.files().agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
        return total.select(
            F.lit(self.path).alias("location"),
            F.array(F.lit(self.partition)).alias("partition_spec"),
            F.array(*[F.lit(n) for n in self.schema.fieldNames()]).alias("schema_fields"),
            F.lit(self.current()).alias("version"),
            F.lit(len(self.versions())).alias("snapshot_count"),
            "files",
            "rows",
        )

    def high_water_mark(self) -> datetime.datetime | None:
        last = self._records(self.versions()[-1:])
        return datetime.datetime.fromisoformat(last[0]["high_water_mark"]) if last and last[0]["high_water_mark"] else None

    def has_tag(self, tag: str) -> bool:
        return any(r["tag"] == tag for r in self._records(self.versions()))

    # Lists of files

    def _entry_schema(self) -> T.StructType:
        kinds = {f.name: f.dataType for f in self.schema.fields}
        fields = [("file", T.StringType()), ("removed", T.BooleanType()), (self.partition, kinds[self.partition]), ("rows", T.LongType())]
        fields += [(f"{z}_{end}", kinds[z]) for z in self.zones for end in ("min", "max")]
        return T.StructType([T.StructField(n, k) for n, k in fields])

    def files(self, version: int | None = None) -> DataFrame:
        """The files of a version: path, partition, rows, and ``<zone>_min`` and ``<zone>_max``."""
        known = self.versions()
        last = max((v for v in known if version is None or v <= version), default=0)
        schema = self._entry_schema()
        if version is not None and known and version < known[0]:
            raise ValueError(f"version {version} of {self.path} has expired; the oldest is {known[0]}")
        full = [v for v in self._checkpoints() if v <= last]
        base = max(full, default=0)
        folders = [f"{self.path}/checkpoints/version={base}"] if base else []
        folders += [f"{self.path}/entries/{r['entries']}" for r in self._records(v for v in known if base < v <= last)]
        if not folders:
            return self.spark.createDataFrame([], schema).drop("removed")
        entries = self.spark.read.schema(schema).parquet(*folders)
        values = [F.any_value(F.when(~F.col("removed"), F.col(n)), ignoreNulls=True).alias(n) for n in schema.fieldNames()[2:]]
        return entries.groupBy("file").agg(F.bool_or("removed").alias("removed"), *values).where("!removed").drop("removed")

    def _checkpoints(self) -> list[int]:
        jvm, fs = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/checkpoints/version=*/_SUCCESS"))
        return [int(f.getPath().getParent().getName().removeprefix("version=")) for f in found or []]

    def checkpoint(self, version: int) -> None:
        """Store the full list of a version, so that readers need no older lists."""
        entries = self.files(version).withColumn("removed", F.lit(False))
        entries.select(*self._entry_schema().fieldNames()).write.mode("overwrite").parquet(f"{self.path}/checkpoints/version={version}")

    # Reading

    def _layout(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("commit", T.StringType())])

    def _load(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self._layout()).withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
        reader = self.spark.read.schema(self._layout()).option("basePath", f"{self.path}/data")
        return reader.parquet(*[f"{self.path}/data/{f}" for f in files])

    def read(self, version: int | None = None, where: Column | None = None) -> DataFrame:
        """A version's rows, of those files whose list entry meets ``where`` (on partition and zone bounds)."""
        return self._load(self._names(version, where)).select(*self.schema.fieldNames())

    def _names(self, version: int | None = None, where: Column | None = None) -> list[str]:
        listed = self.files(version) if where is None else self.files(version).where(where)
        return sorted(r["file"] for r in listed.select("file").collect())

    @staticmethod
    def _file() -> Column:
        return F.regexp_extract("_metadata.file_path", r"/data/(commit=.*)$", 1)

    # Changes

    def _write(self, rows: DataFrame, seen: Observation) -> DataFrame:
        """New files, spread so that a large partition is split and a small one is one file; their list entries."""
        folder = f"{self.path}/data/commit={uuid.uuid4().hex}"
        spread = rows.select(*self.schema.fieldNames()).hint("rebalance", self.partition)
        newest = F.max(self.mark) if self.mark else F.lit(None).cast("timestamp")
        sorted_rows = spread.sortWithinPartitions(self.partition, *self.order).observe(seen, F.count(F.lit(1)).alias("rows"), newest.alias("mark"))
        writer = sorted_rows.write.partitionBy(self.partition)
        for column in self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(folder)
        made = self.spark.read.schema(self._layout()).option("basePath", f"{self.path}/data").parquet(folder)
        bounds = [f(z).alias(f"{z}_{end}") for z in self.zones for f, end in ((F.min, "min"), (F.max, "max"))]
        listed = made.groupBy(self._file().alias("file"), self.partition).agg(F.count(F.lit(1)).alias("rows"), *bounds)
        return listed.withColumn("removed", F.lit(False)).select(*self._entry_schema().fieldNames())

    def _commit(self, base: int, rows: DataFrame | None, removed: list[str], operation: str, tag: str | None) -> dict:
        schema = self._entry_schema()
        entries = self.spark.createDataFrame([(f, True) + (None,) * (len(schema) - 2) for f in removed], schema)
        name, mark, seen, listed = uuid.uuid4().hex, self.high_water_mark(), Observation(), Observation()
        if rows is not None:
            added = self._write(rows, seen)
            entries = entries.unionByName(added) if removed else added
            fresh = seen.get["mark"]
            mark = max((m for m in (mark, fresh.astimezone(datetime.timezone.utc) if fresh else None) if m), default=None)
        kept = ~F.col("removed")
        counted = entries.coalesce(1).observe(listed, F.count_if(kept).alias("files"), F.sum(F.when(kept, F.col("rows"))).alias("rows"))
        counted.write.parquet(f"{self.path}/entries/{name}")
        record = {
            "version": base + 1,
            "at": datetime.datetime.now(datetime.timezone.utc).isoformat(),
            "operation": operation,
            "tag": tag,
            "entries": name,
            "added_files": listed.get["files"],
            "added_rows": listed.get["rows"] or 0,
            "removed_files": len(removed),
            "high_water_mark": mark.isoformat() if mark else None,
            "table": {
                "schema": self.schema.jsonValue(), "partition": self.partition, "zones": self.zones, "order": self.order,
                "mark": self.mark, "bloom": self.bloom,
            },
        }
        self._publish(record)
        if record["version"] % CHECKPOINT_EVERY == 0:
            self.checkpoint(record["version"])
        return record

    def append(self, rows: DataFrame, operation: str = "append", tag: str | None = None) -> dict | None:
        """Add rows. With a tag, a second append of that tag does nothing."""
        if tag is not None and self.has_tag(tag):
            return None
        return self._commit(self.current(), rows, [], operation, tag)

    def overwrite(self, rows: DataFrame, operation: str = "overwrite") -> dict:
        """All rows anew, in one version."""
        base = self.current()
        return self._commit(base, rows, self._names(base), operation, None)

    def replace_partitions(self, rows: DataFrame, values: Iterable, operation: str = "replace", tag: str | None = None) -> dict:
        """All rows of the partitions ``values`` anew; other partitions stay."""
        base = self.current()
        gone = self._names(base, F.col(self.partition).isin(list(values)))
        return self._commit(base, rows, gone, operation, tag)

    def replace_keys(self, keys: DataFrame, key: Column, rows: DataFrame, where: Column | None = None, operation: str = "replace keys") -> dict:
        """Put ``rows`` in place of all rows whose ``key`` expression is in ``keys``, a stored table of one column.
        With ``where``, a bound on partitions and zones within which those rows lie, other files are not opened."""
        base, name = self.current(), keys.columns[0]
        placed = self._load(self._names(base, where)).select(key.alias(name), self._file().alias("file"))
        touched = [r["file"] for r in placed.join(keys, name, "left_semi").select("file").distinct().collect()]
        kept = self._load(touched).withColumn(name, key).join(keys, name, "left_anti").select(*self.schema.fieldNames())
        return self._commit(base, kept.unionByName(rows.select(*self.schema.fieldNames())), touched, operation, None)

    def difference(self, since: int) -> tuple[DataFrame, DataFrame]:
        """Rows of the files that are gone since a version, and of those that are new. Only these are read;
        rows that a rewritten file carried over are in both."""
        old, new = set(self._names(since)), set(self._names())
        return tuple(self._load(sorted(names)).select(*self.schema.fieldNames()) for names in (old - new, new - old))

    def _holding(self, version: int, keys: DataFrame, key: str) -> list[str]:
        """Files with rows of the keys; two narrow columns of the table are read."""
        placed = self._load(self._names(version)).select(key, self._file().alias("file"))
        return [r["file"] for r in placed.join(keys, key, "left_semi").select("file").distinct().collect()]

    def merge(self, incoming: DataFrame, key: str, operation: str = "merge") -> dict:
        """Replace the rows whose key occurs in ``incoming`` by all incoming rows. Only files that hold such
        rows are rewritten. ``incoming`` should be stored; it is read several times."""
        base = self.current()
        keys = incoming.select(key).distinct()
        touched = self._holding(base, keys, key)
        kept = self._load(touched).select(*self.schema.fieldNames()).join(keys, key, "left_anti")
        return self._commit(base, kept.unionByName(incoming.select(*self.schema.fieldNames())), touched, operation, None)

    def upsert(self, incoming: DataFrame, key: str, by: tuple[str, ...], operation: str = "upsert") -> dict:
        """Insert or replace by key; of several versions of a key the latest by ``by`` stays, also
        an older row of the table against a late replay."""
        base = self.current()
        keys = incoming.select(key).distinct()
        touched = self._holding(base, keys, key)
        old = self._load(touched).select(*self.schema.fieldNames())
        newest = latest_per_id(incoming.select(*old.columns).unionByName(old.join(keys, key, "left_semi")), key, by)
        return self._commit(base, old.join(keys, key, "left_anti").unionByName(newest), touched, operation, None)

    def delete(self, where: Column, operation: str = "delete") -> dict | None:
        """Drop the rows that meet ``where``; only files that hold some are rewritten."""
        base = self.current()
        placed = self._load(self._names(base)).where(where)
        touched = [r["file"] for r in placed.select(self._file().alias("file")).distinct().collect()]
        if not touched:
            return None
        kept = self._load(touched).where(~F.coalesce(where, F.lit(False)))
        return self._commit(base, kept, touched, operation, None)

    def compact(self, files_at_most: int = 4, rows_at_most: int = 1_000_000) -> dict | None:
        """Rewrite partitions that have more than so many small files. Rows stay the same."""
        base = self.current()
        small = self.files(base).where(F.col("rows") < rows_at_most)
        many = small.groupBy(self.partition).agg(F.count("*").alias("n")).where(F.col("n") > files_at_most)
        same = small[self.partition].eqNullSafe(many[self.partition])
        names = [r["file"] for r in small.join(many, same, "left_semi").select("file").collect()]
        return self._commit(base, self._load(names), names, "compact", None) if names else None

    def expire(self, keep: int = 10, unpublished_hours: float = 24) -> dict:
        """Forget all but the last versions and delete the files that only older ones list, and what
        changes that died left behind, unless it is so young that it may still be published."""
        known = self.versions()
        oldest = known[-keep] if len(known) > keep else known[0]
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        self.checkpoint(oldest)
        old = self._records(v for v in known if v <= oldest)
        schema = self._entry_schema()
        gone = []
        if old:
            lists = self.spark.read.schema(schema).parquet(*[f"{self.path}/entries/{r['entries']}" for r in old])
            gone = [r["file"] for r in lists.where("removed").select("file").distinct().collect()]
        for file in gone:
            fs.delete(path(f"{self.path}/data/{file}"), False)
        for r in old:
            if r["version"] < oldest:
                fs.delete(path(f"{self.path}/log/{r['version']:012d}.json"), False)
                fs.delete(path(f"{self.path}/entries/{r['entries']}"), True)
        for v in self._checkpoints():
            if v < oldest:
                remove_folder(self.spark, f"{self.path}/checkpoints/version={v}")
        return {"oldest": oldest, "deleted_files": len(gone), "dropped_folders": self._drop_unlisted(unpublished_hours)}

    def _drop_unlisted(self, hours: float) -> int:
        """Folders of which no list names a file: of changes that died, and emptied ones."""
        jvm, fs = self._fs()
        now = datetime.datetime.now().timestamp()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/commit=*")) or []
        young = {f.getPath().getName() for f in found if f.getModificationTime() / 1000 > now - 3600 * hours}
        known, schema = self.versions(), self._entry_schema()
        lists = [f"{self.path}/checkpoints/version={known[0]}", *[f"{self.path}/entries/{r['entries']}" for r in self._records(known[1:])]]
        folder = F.split_part("file", F.lit("/"), F.lit(1)).alias("folder")
        named = {r["folder"] for r in self.spark.read.schema(schema).parquet(*lists).select(folder).distinct().collect()}
        dead = [f.getPath() for f in found if f.getPath().getName() not in named | young]
        for folder in dead:
            fs.delete(folder, True)
        return len(dead)


def table_there(spark: SparkSession, path: str) -> bool:
    """Whether a table with a log lies at the path."""
    return table_exists(spark, f"{path}/log/*.json")
