"""A store of snapshots: immutable Parquet files and numbered manifests that name them.

A commit writes new files and then one new manifest, by a rename to a name that
did not exist, so readers see one snapshot whole and a crash leaves the last one.
Secondary indexes are written with the rows and published in the same manifest.
One writer at a time holds the lock file; a lock that outlives its lease is
taken over, and its former owner can publish no more.
"""

from __future__ import annotations

import json
import socket
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotlog.operators import fieldindex
from knotlog.schema import Registry, SchemaConflict

#: Seconds after which a writer's lock may be taken over, and manifests that are kept.
LEASE, KEPT = 3600, 20
#: Keys of rows to be replaced that are broadcast at most.
BROADCAST_KEYS = 500_000
#: Files that one step of a back-fill rewrites.
BATCH_FILES = 256


class Locked(RuntimeError):
    """Another writer holds the store."""


@dataclass(frozen=True)
class Seek:
    """What a lookup in a table's indexes came to: the fields that served it and the files to read."""

    fields: tuple[str, ...]
    files: tuple[str, ...]
    of: int


class Store:
    """Tables by name under a root that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str, lease: float = LEASE):
        self.spark, self.root, self.lease = spark, root.rstrip("/"), lease
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    # --- files

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _files(self, paths: list[str]) -> dict[str, str]:
        """The data files of a table's paths, by name."""
        out = {}
        for p in paths:
            if p.endswith(".parquet"):
                out[p.rsplit("/", 1)[1]] = p
                continue
            each = self._fs.listFiles(self._path(p), True)
            while each.hasNext():
                name = each.next().getPath().toString()
                if name.endswith(".parquet"):
                    out[name.rsplit("/", 1)[1]] = name
        return out

    # --- snapshots

    def _numbers(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.root}/manifest-*.json")) or []
        return sorted(int(s.getPath().getName()[9:-5]) for s in found)

    def manifest(self, snapshot: int | None = None) -> dict:
        """The current snapshot, or an older one that is kept: its number, tables, indexes and registry."""
        empty = {"snapshot": 0, "tables": {}, "schemas": {}, "indexes": {}, "backfills": {}, "partitioned": {}, "registry": Registry().to_json()}
        number = snapshot if snapshot is not None else max(self._numbers(), default=0)
        return json.loads(self._read(f"manifest-{number}.json")) if number else empty

    def registry(self) -> Registry:
        """Collections as of the current snapshot."""
        return Registry.from_json(self.manifest()["registry"])

    def tables(self) -> list[str]:
        """Names of the tables."""
        return sorted(self.manifest()["tables"])

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table of the current (or a given) snapshot: all its parts."""
        m = manifest or self.manifest()
        return self._open(m, name, m["tables"][name])

    def _open(self, m: dict, name: str, paths: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m["schemas"][name]))
        if not paths:
            return self.spark.createDataFrame([], schema)
        if name in m["partitioned"]:  # each part is a root of its own
            return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p).select(*schema.names) for p in paths])
        return self.spark.read.schema(schema).parquet(*paths)

    # --- writing

    def _lock(self) -> str:
        """Takes the lock; the text that says whose it is."""
        lock = self._path(f"{self.root}/writer.lock")
        mine = json.dumps({"owner": uuid.uuid4().hex, "host": socket.gethostname(), "at": time.time()})
        for attempt in range(2):
            try:
                self._write("writer.lock", mine, False)
                return mine
            except Exception as e:  # the file exists
                try:
                    age = time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000
                except Exception:  # noqa: BLE001  it was released meanwhile
                    continue
                aside = self._path(f"{self.root}/writer.lock.{uuid.uuid4().hex}")
                if attempt or age <= self.lease or not self._fs.rename(lock, aside):
                    raise Locked(f"{self.root}: held for {age:.0f} s by {self._read('writer.lock') or '?'}") from e
                self._fs.delete(aside, False)
        raise Locked(self.root)

    @contextmanager
    def _writing(self) -> Iterator[dict]:
        """The manifest to change under the lock; it is published at the end of the block."""
        mine = self._lock()
        try:
            m = self.manifest()
            yield m
            m["snapshot"] += 1
            temporary, target = self._path(f"{self.root}/.manifest-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest-{m['snapshot']}.json")
            self._write(temporary.getName(), json.dumps(m), True)
            if self._read("writer.lock") != mine or self._fs.exists(target) or not self._fs.rename(temporary, target):
                self._fs.delete(temporary, False)
                raise Locked(f"{self.root}: another writer took over")
            for n in self._numbers()[:-KEPT]:
                self._fs.delete(self._path(f"{self.root}/manifest-{n}.json"), False)
        finally:
            if self._read("writer.lock") == mine:
                self._fs.delete(self._path(f"{self.root}/writer.lock"), False)

    def _part(self, m: dict, name: str, df: DataFrame, replace: bool, by: list[str] | None = None) -> str:
        """Writes a part of a table with its index entries; the schema is widened by new columns."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        known = [] if replace or name not in m["schemas"] else T.StructType.fromJson(json.loads(m["schemas"][name])).fields
        kinds = {f.name: f.dataType for f in known}
        for f in df.schema.fields:
            if kinds.setdefault(f.name, f.dataType) != f.dataType:
                raise SchemaConflict(f"{name}.{f.name} is {kinds[f.name].simpleString()}, not {f.dataType.simpleString()}")
        by = by or (m["partitioned"].get(name) if not replace else None)
        if by and (name in m["indexes"] or name in m["backfills"]):
            raise ValueError(f"{name} has indexes or a back-fill, which know files, not folders: it cannot be partitioned")
        m["partitioned"].pop(name, None) if replace else None
        if by:
            m["partitioned"][name] = by
        df.write.partitionBy(*(by or [])).parquet(path)
        m["schemas"][name] = T.StructType([*known, *[f for f in df.schema.fields if f.name not in {k.name for k in known}]]).json()
        if replace:
            m["tables"][name] = []
            for x in m["indexes"].get(name, {}).values():
                x["parts"] = []
            for b in m["backfills"].get(name, {}).values():
                b["todo"] = []
        m["tables"].setdefault(name, []).append(path)
        for field in m["indexes"].get(name, {}):
            self._index_part(m, name, field, [path])
        for b in m["backfills"].get(name, {}).values():
            if b["todo"]:
                b["todo"] += self._files([path])
        return path

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, registry: Registry | None = None, partition: dict[str, list[str]] | None = None, put: dict[str, DataFrame] | None = None, delete: dict[str, DataFrame] | None = None) -> int:
        """Replaces, appends to, puts rows (by ``id``) into and deletes ids from tables in one step; returns the new snapshot's number."""
        with self._writing() as m:
            for mode, parts in (("replace", replace or {}), ("append", append or {})):
                for name, df in parts.items():
                    self._part(m, name, df, mode == "replace", (partition or {}).get(name))
            for name, df in (put or {}).items():
                self._swap(m, name, df.select("id"), "id", df)
            for name, df in (delete or {}).items():
                self._swap(m, name, df.select("id"), "id", None)
            if registry:
                m["registry"] = registry.to_json()
        return m["snapshot"]

    def put(self, name: str, rows: DataFrame, key: str = "id") -> int:
        """Rows in place of those with their keys; only files that hold such keys are rewritten (all of a partitioned table)."""
        with self._writing() as m:
            self._swap(m, name, rows.select(key), key, rows)
        return m["snapshot"]

    def delete(self, name: str, keys: DataFrame, key: str = "id") -> int:
        """Takes out the rows of some keys."""
        with self._writing() as m:
            self._swap(m, name, keys.select(key), key, None)
        return m["snapshot"]

    def _swap(self, m: dict, name: str, keys: DataFrame, key: str, rows: DataFrame | None) -> None:
        keys = keys.distinct()
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        if by := m["partitioned"].get(name):  # its rows are known by folder: the whole is written anew
            rest = self._open(m, name, m["tables"][name]).join(keys, key, "left_anti")
            self._part(m, name, rest if rows is None else rest.unionByName(rows, allowMissingColumns=True), True, by)
            return
        files = self._files(m["tables"][name])
        held = self._open(m, name, m["tables"][name]).select(F.col(key), F.col("_metadata.file_name").alias("file"))
        touched = {r["file"] for r in held.join(keys, key, "left_semi").select("file").distinct().collect()}  # names of files, which the driver lists anyway
        new = rows
        if touched:
            rest = self._open(m, name, [files[f] for f in touched]).join(keys, key, "left_anti")
            new = rest if rows is None else rest.unionByName(rows, allowMissingColumns=True)
            m["tables"][name] = [p for f, p in files.items() if f not in touched]
        if new is not None:
            self._part(m, name, new, False)

    def compact(self, files: int | None = None) -> int:
        """Every table as one part, all rows kept; entries of indexes that no file has any more go."""
        m = self.manifest()
        frames = {n: self.table(n, m) for n in m["tables"]}
        return self.commit(replace={n: df.coalesce(files) if files else df for n, df in frames.items()}, partition=m["partitioned"])

    # --- indexes

    def indexes(self, table: str) -> list[str]:
        """The table's indexed fields."""
        return sorted(self.manifest()["indexes"].get(table, {}))

    def add_index(self, table: str, *fields: str, key: str = "id") -> int:
        """Indexes of some fields over the rows there are, kept up by every later write."""
        with self._writing() as m:
            self._by_file(m, table)
            rows = self._open(m, table, m["tables"][table])
            for field in fields:
                items = F.size(f"`{field}`") if isinstance(rows.schema[field].dataType, T.ArrayType) else F.lit(1)
                count = rows.agg(F.coalesce(F.sum(items), F.lit(0)).alias("n")).first()["n"]
                m["indexes"].setdefault(table, {})[field] = {"key": key, "buckets": fieldindex.buckets_for(count), "parts": []}
                self._index_part(m, table, field, m["tables"][table])
        return m["snapshot"]

    @staticmethod
    def _by_file(m: dict, table: str) -> None:
        if table in m["partitioned"]:
            raise ValueError(f"{table} is partitioned: its rows are found by folder")

    def _index(self, m: dict, table: str, field: str) -> fieldindex.FieldIndex:
        x = m["indexes"][table][field]
        return fieldindex.FieldIndex(self.spark, x["parts"], x["buckets"])

    def _index_part(self, m: dict, table: str, field: str, paths: list[str]) -> None:
        path, x = f"{self.root}/index-{table}-{field}/{uuid.uuid4().hex}", m["indexes"][table][field]
        rows = self._open(m, table, paths)
        if field not in rows.columns or not paths:
            return
        each = fieldindex.entries(rows, field, x["key"], F.col("_metadata.file_name").alias("file"))
        self._index(m, table, field).write(each, path)
        if self._files([path]):
            x["parts"].append(path)

    def lookup(self, table: str, field: str, values: list[str]) -> DataFrame:
        """``value, key, file`` of the live rows that have one of the values."""
        m = self.manifest()
        live = self.spark.createDataFrame([(f,) for f in self._files(m["tables"][table])], "file string")
        found = self._index(m, table, field)
        return found.lookup(values).join(F.broadcast(live), "file", "left_semi") if found.parts else self.spark.createDataFrame([], "value string, key string, file string")

    def seek(self, table: str, wanted: list[dict[str, list[str]]]) -> tuple[DataFrame, Seek | None]:
        """The table, read only where its indexes say that rows can be.

        ``wanted`` are alternatives, each with the values that some fields must
        have.  Rows that do not have them may be among those read, so the
        condition has still to be applied.  If an alternative names no indexed
        field the whole is read.
        """
        m = self.manifest()
        known = m["indexes"].get(table, {})
        served = [sorted(set(w) & set(known)) for w in wanted]
        if not served or not all(served):
            return self.table(table, m), None
        files, hit = self._files(m["tables"][table]), set()
        for fields, values in zip(served, wanted, strict=True):
            hit |= reduce(set.__and__, [self._holding(m, table, f, values[f]) for f in fields])
        read = sorted(hit & set(files))  # entries of files that were replaced are passed over
        return self._open(m, table, [files[f] for f in read]), Seek(tuple(sorted({f for fs in served for f in fs})), tuple(read), len(files))

    def _holding(self, m: dict, table: str, field: str, values: list[str]) -> set[str]:
        """Names of the files that hold a value; the driver lists a table's files anyway."""
        index = self._index(m, table, field)
        return {r["file"] for r in index.lookup(values).select("file").distinct().collect()} if index.parts else set()

    # --- back-fills

    def start_backfill(self, table: str, field: str, default, kind: str, registry: Registry | None = None) -> int:
        """Adds a field; ``backfill`` then fills it, file by file.  Started again it changes nothing."""
        with self._writing() as m:
            self._by_file(m, table)
            own = m["backfills"].setdefault(table, {})
            if field not in own:
                known = T.StructType.fromJson(json.loads(m["schemas"][table]))
                if field not in known.names:
                    m["schemas"][table] = known.add(field, kind).json()
                own[field] = {"default": default, "kind": kind, "todo": sorted(self._files(m["tables"][table]))}
            if registry:
                m["registry"] = registry.to_json()
        return m["snapshot"]

    def progress(self, table: str, field: str) -> int:
        """Files of a back-fill that are still to do."""
        return len(self.manifest()["backfills"][table][field]["todo"])

    def backfill(self, table: str, field: str, batch: int = BATCH_FILES, batches: int | None = None) -> int:
        """Fills a started field in batches of files, each one snapshot; returns the files still to do.

        What is done is in the manifest, so a back-fill that stopped goes on
        where it was, and a batch that was not published is done again.
        """
        done = 0
        while (batches is None or done < batches) and self.progress(table, field):
            done += 1
            with self._writing() as m:
                b = m["backfills"][table][field]
                files = self._files(m["tables"][table])
                now, rest = b["todo"][:batch], b["todo"][batch:]
                live = [f for f in now if f in files]
                b["todo"] = []  # what this batch writes is not to be done again
                if live:
                    rows = self._open(m, table, [files[f] for f in live])
                    m["tables"][table] = [p for f, p in files.items() if f not in live]
                    self._part(m, table, rows.withColumn(field, F.coalesce(F.col(f"`{field}`"), F.lit(b["default"]).cast(b["kind"]))), False)
                b["todo"] = rest
        return self.progress(table, field)

    # --- upkeep

    def vacuum(self, keep: int = 1, now: Callable[[], float] = time.time) -> int:
        """Deletes data files that none of the last ``keep`` snapshots names and that are older than a writer's lease."""
        used: set[str] = set()
        for n in self._numbers()[-keep:]:
            m = self.manifest(n)
            used |= {f for paths in m["tables"].values() for f in self._files(paths)}
            used |= {f for fields in m["indexes"].values() for x in fields.values() for f in self._files(x["parts"])}
        gone = 0
        each = self._fs.listFiles(self._path(self.root), True)
        while each.hasNext():
            status = each.next()
            old = now() - status.getModificationTime() / 1000 > self.lease
            if status.getPath().getName().endswith(".parquet") and status.getPath().getName() not in used and old:
                gone += bool(self._fs.delete(status.getPath(), False))
        return gone

    def diagnostics(self) -> DataFrame:
        """``table, parts, files, bytes, rows`` of the current snapshot."""
        m, rows = self.manifest(), []
        for n, parts in sorted(m["tables"].items()):
            sums = [self._fs.getContentSummary(self._path(p)) for p in parts]
            rows.append((n, len(parts), sum(x.getFileCount() for x in sums), sum(x.getLength() for x in sums), self.table(n, m).count()))
        return self.spark.createDataFrame(rows, "table string, parts int, files long, bytes long, rows long")


def once(store: Store, done: str, migration: Callable[[], dict[str, DataFrame]]) -> bool:
    """Runs a migration if its marker table is absent; the marker goes with its result."""
    if f"done_{done}" in store.tables():
        return False
    marker = store.spark.createDataFrame([(done, int(time.time()))], "name string, at long")
    store.commit(replace={**migration(), f"done_{done}": marker})
    return True
