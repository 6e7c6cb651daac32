"""A stored table by key with copy-on-write: rows lie in hash buckets, a numbered manifest says which folder holds which bucket.

A write reads and rewrites only the buckets of its keys, into a new folder, and then commits a manifest that names it. Readers keep
the version that they have opened; a write that dies leaves the table as it was. Two writers can't commit the same version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeyedTable:
    """One row for each key (never null) below path. buckets is fixed when the table is made; take about as many as a change of usual size has keys, or more."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key", buckets: int = 256):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.key, self.buckets = key, buckets
        if found := self.manifest():
            self.key, self.buckets = found["key"], found["n"]

    def versions(self) -> list[int]:
        """The committed versions, in order."""
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """{key, n, schema, folders: bucket to folder} of a version, the last one if none is given; buckets lines at most."""
        if version is None:
            if not (all_ := self.versions()):
                return None
            version = all_[-1]
        stream = self._fs.open(self._path(f"{self.path}/manifest/{version}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": version}

    def _commit(self, version: int, folders: dict[str, str], schema: StructType) -> int:
        """Make the version visible in one step: its manifest is written aside and renamed; whoever comes second fails."""
        fs, target = self._fs, self._path(f"{self.path}/manifest/{version}.json")
        aside = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(json.dumps({"key": self.key, "n": self.buckets, "schema": schema.jsonValue(), "folders": folders}).encode())
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise RuntimeError(f"another writer has committed version {version}")
        return version

    def _bucket(self, column: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(column or self.key)), F.lit(self.buckets)).cast("int")

    def _load(self, folders: dict[str, str], schema: StructType, only: set[int] | None = None) -> DataFrame:
        wanted = [f"{self.path}/{f}/_bucket={b}" for b, f in folders.items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last one if none is given."""
        if not (m := self.manifest(version)):
            raise ValueError(f"no table at {self.path}")
        return self._load(m["folders"], StructType.fromJson(m["schema"]))

    def _rewrite(self, m: dict | None, schema: StructType, touched: set[int], change) -> int:
        """Commit what change(rows of the touched buckets) gives in place of those buckets."""
        old = m["folders"] if m else {}
        folder = f"data/{uuid.uuid4().hex}"
        if touched:
            rows = change(self._load(old, schema, touched))
            rows = rows.select(*schema.names).withColumn("_bucket", self._bucket())
            rows.repartition(max(1, min(len(touched), self.buckets)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        kept = {b: f for b, f in old.items() if int(b) not in touched}
        for b in touched:
            if self._fs.exists(self._path(f"{self.path}/{folder}/_bucket={b}")):
                kept[str(b)] = folder
        return self._commit((m["version"] if m else 0) + 1, kept, schema)

    def upsert(self, rows: DataFrame, order: tuple[str, ...] = ()) -> int:
        """Insert rows, or put them in place of those of the same key; of several rows of a key the last by order (then by all columns).

        Rows without a key are an error. The first upsert sets the table's columns; later ones must have them all, others are left out.
        """
        m = self.manifest()
        schema = StructType.fromJson(m["schema"]) if m else StructType([f for f in rows.schema if f.name != "_bucket"])
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        picked = F.struct(*order, *schema.names)
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*schema.names), picked).alias("_r")).select("_r.*")
        buckets = {r[0] for r in rows.select(F.when(F.col(self.key).isNotNull(), self._bucket())).distinct().collect()}  # buckets numbers at most
        if None in buckets:
            raise ValueError(f"a row has no {self.key}")
        return self._rewrite(m, schema, buckets, lambda old: old.join(last.select(self.key), self.key, "left_anti").select(*schema.names).unionByName(last))

    def delete(self, keys: DataFrame) -> int:
        """Take out the rows of the keys in the column named like the table's key."""
        if not (m := self.manifest()):
            raise ValueError(f"no table at {self.path}")
        schema, gone = StructType.fromJson(m["schema"]), keys.select(self.key).distinct()
        buckets = {r[0] for r in gone.where(F.col(self.key).isNotNull()).select(self._bucket()).distinct().collect()}
        return self._rewrite(m, schema, buckets & {int(b) for b in m["folders"]}, lambda old: old.join(gone, self.key, "left_anti"))

    def delete_where(self, condition: Column) -> int:
        """Take out the rows where condition is true; only buckets with such rows are rewritten."""
        if not (m := self.manifest()):
            raise ValueError(f"no table at {self.path}")
        schema = StructType.fromJson(m["schema"])
        hit = {r[0] for r in self._load(m["folders"], schema).where(condition).select(self._bucket()).distinct().collect()}
        return self._rewrite(m, schema, hit, lambda old: old.where(~F.coalesce(condition, F.lit(False))))

    def clear(self) -> int:
        """An empty version."""
        if not (m := self.manifest()):
            raise ValueError(f"no table at {self.path}")
        return self._commit(m["version"] + 1, {}, StructType.fromJson(m["schema"]))

    def vacuum(self, keep: int = 2) -> None:
        """Delete the manifests before the last keep ones, and folders that none of those names. Not beside a writer."""
        versions = self.versions()
        used = {f for v in versions[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifest/{v}.json"), False)
        data = self._path(f"{self.path}/data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f"data/{f.getPath().getName()}" not in used:
                self._fs.delete(f.getPath(), True)
