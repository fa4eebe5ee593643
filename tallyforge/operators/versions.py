"""The stored tables as Parquet folders with numbered versions.

A version is a small file that names the folders of each table and the layout they are read in.  A transaction writes new
folders first and then its version file; until that stands, and if it never does, readers see the version before.  Two
transactions on one version cannot both publish the next: the second fails with ``Conflict`` and may run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analytics import running
from .packages import LATEST, layout, migrated

#: Parts a table with a key is kept in; replacing rows rewrites only the parts their keys fall in.
BUCKETS = 64
#: The key of each stored table that has one, and the numbered column of the tables that rows are added to.
KEYS = {"SnapshotItems": "Id", "MappingPresets": "PresetName"}
NUMBERED = {"Snapshots": "RevisionId", "ItemAuditTrail": "AuditId"}


class Conflict(RuntimeError):
    """Another transaction has published the version this one was to be."""


class Store:
    """The tables under a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._log = self._path(f"{self.folder}/_versions")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._log.getFileSystem(conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._log.toUri(), conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def version(self) -> int:
        """Number of the latest version; 0 for an empty store."""
        if not self._fs.exists(self._log):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._log)]
        return max((int(n[:-5]) for n in names if n[:-5].isdigit()), default=0)

    def state(self, version: int | None = None) -> dict:
        """What a version holds: user_version (of the layout), tables (name -> parts), next (numbers to give)."""
        n = self.version() if version is None else version
        if n == 0:
            return {"version": 0, "user_version": 0, "tables": {}, "next": {}}
        stream = self._fs.open(self._path(f"{self.folder}/_versions/{n:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None, keys: list | None = None) -> DataFrame:
        """SC8: a table as of a version (the latest if None); with ``keys`` only the parts they fall in are read."""
        s = self.state(version)
        parts = s["tables"].get(name, [])
        if keys is not None and name in KEYS:
            kind = layout(name)[KEYS[name]]
            some = self.spark.createDataFrame([(k,) for k in keys], f"k {kind}").select(self._bucket(F.col("k"))).distinct().collect()
            parts = [p for p in parts if p["bucket"] in {r[0] for r in some}]
        cols = layout(name, max(s["user_version"], 1))
        if not parts:
            empty = self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in cols.items()))
            return empty
        df = migrated(self.spark.read.option("mergeSchema", "true").parquet(*[p["path"] for p in parts]), name, max(s["user_version"], 1)).select(*cols)
        return df.where(F.col(KEYS[name]).isin(keys)) if keys is not None and name in KEYS else df

    def _bucket(self, key) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def begin(self) -> Transaction:
        return Transaction(self)

    def migrate(self, to: int = LATEST) -> None:
        """DB1: raise the layout step by step, each step a version of its own; data are read in the new layout, not rewritten."""
        for v in range(self.state()["user_version"] + 1, to + 1):
            t = self.begin()
            t.state["user_version"] = v
            t.commit()

    def run(self, change: Callable[[Transaction], None], tries: int = 5) -> int:
        """change applied to the latest version, again from the new one if another transaction was first; the version made."""
        for k in range(tries):
            t = self.begin()
            change(t)
            try:
                return t.commit()
            except Conflict:
                if k == tries - 1:
                    raise
        raise AssertionError

    def sweep(self, keep: int = 1) -> None:
        """Delete version files but the last ``keep`` and the folders that none of these names.  Not beside open transactions."""
        last = self.version()
        used = {p["path"].split("/_bucket=")[0] for v in range(max(1, last - keep + 1), last + 1) for parts in self.state(v)["tables"].values() for p in parts}
        for v in range(1, last - keep + 1):
            self._fs.delete(self._path(f"{self.folder}/_versions/{v:012d}.json"), False)
        for name in self.state()["tables"]:
            for f in self._fs.listStatus(self._path(f"{self.folder}/{name}")):
                p = f"{self.folder}/{name}/{f.getPath().getName()}"
                if p not in used:
                    self._fs.delete(self._path(p), True)


class Transaction:
    """Changes to several tables that become visible together."""

    def __init__(self, store: Store) -> None:
        self.store, self.state = store, store.state()

    def _folder(self, name: str) -> str:
        return f"{self.store.folder}/{name}/{uuid.uuid4().hex}"

    def add(self, name: str, rows: DataFrame, order: str) -> int:
        """DB12, SK10: rows at the end of a numbered table, numbered on by ``order``; the first number given."""
        first = self.state["next"].get(name, 1)
        r = running(rows.withColumn("_one", F.lit(0)), "_one", order)
        out = self._folder(name)
        r.withColumn(NUMBERED[name], (F.col("rank") + (first - 1)).cast("bigint")).drop("rank", "running", "total", "_one").write.parquet(out)
        n = self.store.spark.read.parquet(out).count()
        self.state["tables"].setdefault(name, []).append({"path": out, "bucket": None})
        self.state["next"][name] = first + n
        return first

    def replace(self, name: str, rows: DataFrame, order: str | None = None) -> None:
        """DB5, DB11: rows take the place of those with their keys; of rows that share a key the last by ``order`` stays."""
        key = KEYS[name]
        if order is not None:
            rest = [c for c in rows.columns if c != key]
            rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*").drop(order)
        self._rewrite(name, rows.withColumn("_bucket", self.store._bucket(F.col(key))), rows)

    def delete(self, name: str, keys: DataFrame) -> None:
        """DB11: rows without those whose key is in ``keys`` (one column, named as the table's key)."""
        self._rewrite(name, None, keys)

    def _rewrite(self, name: str, new: DataFrame | None, keys: DataFrame) -> None:
        key, spark = KEYS[name], self.store.spark
        touched = {r[0] for r in keys.select(self.store._bucket(F.col(key))).distinct().collect()}  # numbers below BUCKETS
        parts = self.state["tables"].get(name, [])
        hit = [p["path"] for p in parts if p["bucket"] in touched]
        out = self._folder(name)
        if hit:
            old = spark.read.option("mergeSchema", "true").parquet(*hit).join(keys.select(key).distinct(), key, "left_anti").withColumn("_bucket", self.store._bucket(F.col(key)))
            new = old if new is None else new.unionByName(old, allowMissingColumns=True)
        if new is not None:
            new.repartition("_bucket").write.partitionBy("_bucket").parquet(out)
        fs, jvm_path = self.store._fs, self.store._path
        made = [b for b in touched if fs.exists(jvm_path(f"{out}/_bucket={b}"))]
        self.state["tables"][name] = [p for p in parts if p["bucket"] not in touched] + [{"path": f"{out}/_bucket={b}", "bucket": b} for b in sorted(made)]

    def commit(self) -> int:
        """Publish the next version; ``Conflict`` if it stands already."""
        s, n = self.store, self.state["version"] + 1
        text = json.dumps({**self.state, "version": n})
        s._fs.mkdirs(s._log)
        draft, final = s._path(f"{s.folder}/_versions/.{uuid.uuid4().hex}"), s._path(f"{s.folder}/_versions/{n:012d}.json")
        out = s._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = s.spark.sparkContext._gateway.new_array(s._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # a rename that does not overwrite: the file system lets one of two writers through
            s._files.rename(draft, final, options)
        except Exception as e:
            s._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {n} stands already") from e
            raise
        return n


def save_snapshot(store: Store, header: DataFrame, items: DataFrame) -> int:
    """SK10: one snapshot and its items in one version; the revision it got.

    header: one row of Snapshots without RevisionId; an empty InvoiceName becomes the project's code.  items: SnapshotItems
    without RevisionId; their ids are put behind the revision's.
    """
    rev = 0

    def change(t: Transaction) -> None:
        nonlocal rev
        invoice = F.coalesce(F.nullif(F.trim("InvoiceName"), F.lit("")), F.col("ProjectCode")) if "InvoiceName" in header.columns else F.col("ProjectCode")
        rev = t.add("Snapshots", header.withColumn("InvoiceName", invoice), "ProjectCode")
        t.replace("SnapshotItems", items.withColumns({"Id": F.concat(F.lit(f"{rev}_"), F.col("Id").cast("string")), "RevisionId": F.lit(rev).cast("bigint")}))

    store.run(change)
    return rev
