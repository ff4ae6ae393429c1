"""A keyed table on storage: merges rewrite only the partitions that they touch, and a log of versions switches at once.

A row's partition is a hash of its key. folder/data has the partitions of every merge in a folder of its own; folder/log has
a small file a version, which says where each partition is now. A merge writes its partitions aside and then creates
the next log file, which must not be there yet: readers see the version before or after, never a part; a writer that
fails leaves files that no version names; of two writers from one version the later one fails and may try again.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from costloom.sources.store import cut

PARTS = 32
#: A version's file that isn't whole after so many seconds belongs to a writer that failed.
STALE_S = 60


class Conflict(Exception):
    """Another writer made the next version first."""


class KeyedTable:
    """Rows by key under a folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], parts: int = PARTS):
        self.spark, self.folder, self.key, self.parts = spark, folder.rstrip("/"), key, parts
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _log(self) -> list[int]:
        at = self._path("log")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _entry(self, version: int) -> dict | None:
        stream = self._fs.open(self._path(f"log/{version:08d}.json"))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            return json.loads(text)
        except ValueError:  # its writer failed half way, so it never became a version
            return None

    def latest(self) -> tuple[int, dict | None]:
        """(number, entry) of the last whole version; (0, None) before the first."""
        for v in reversed(self._log()):
            if (entry := self._entry(v)) is not None:
                return v, entry
        return 0, None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the last one if none is named; None before the first."""
        entry = self.latest()[1] if version is None else self._entry(version)
        return None if entry is None else self._rows(entry, entry["parts"])

    def _rows(self, entry: dict, parts) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        paths = [f"{self.folder}/{entry['parts'][p]}/part_={p}" for p in parts if p in entry["parts"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _same(self, a: DataFrame, b: DataFrame):
        cond = None
        for k in self.key:
            c = a[k].eqNullSafe(b[f"other_{k}"])
            cond = c if cond is None else cond & c
        return cond

    def without(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        """The rows whose key isn't in others; null keys equal each other."""
        right = others.select(*[F.col(k).alias(f"other_{k}") for k in self.key]).distinct()
        return rows.join(right, self._same(rows, right), "left_anti")

    def merge(self, rows: DataFrame, keep: bool = False, at: int | None = None) -> int:
        """Rows in place of those of their key, or with keep only where the key is new; returns the new version.

        Of repeated keys in rows the last by all columns counts. rows has the table's columns. at is the version that rows
        were made for, the last one if not given; if there is a later one, the merge is a Conflict. No rows make no version.
        """
        number, entry = self.latest()
        if at is not None and at != number:
            raise Conflict(f"version {at} isn't the last any more")
        for broken in (v for v in self._log() if v > number):
            path = self._path(f"log/{broken:08d}.json")
            if time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000 < STALE_S:
                raise Conflict(f"version {broken} is being written")
            self._fs.delete(path, False)
        part = F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("string")
        w = Window.partitionBy(*self.key).orderBy(*[F.col(c).desc_nulls_last() for c in rows.columns if c not in self.key] or [F.lit(0)])
        new = cut(rows.withColumn("place_", F.row_number().over(w)).filter("place_ = 1").drop("place_").withColumn("part_", part))
        touched = sorted(r["part_"] for r in new.select("part_").distinct().collect())  # at most so many as there are partitions
        if not touched:
            return number
        if entry:
            old = self._rows(entry, touched).select(*rows.columns).withColumn("part_", part)
            new = old.unionByName(self.without(new, old)) if keep else self.without(old, new).unionByName(new)
        folder = f"data/{uuid.uuid4().hex}"
        new.repartition("part_").write.partitionBy("part_").parquet(f"{self.folder}/{folder}")
        places = (entry["parts"] if entry else {}) | {p: folder for p in touched}
        self._commit(number, {"parts": places, "schema": json.loads(rows.schema.json())})
        return number + 1

    def _commit(self, number: int, entry: dict) -> None:
        target = self._path(f"log/{number + 1:08d}.json")
        try:
            stream = self._fs.create(target, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {number + 1} is there already") from e
            raise
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()


def kept_task_ids(table: KeyedTable, requests: DataFrame, order: str, tries: int = 5) -> DataFrame:
    """product, root_cause, month, task_id of all keys in table after the keys of requests are in it.

    A key that has an id keeps it; new ones get the next numbers of their month, by first request. table is keyed by
    product, root_cause and month. If another writer comes first, the numbers are taken anew.
    """
    for left in reversed(range(tries)):
        version, _ = table.latest()
        known = table.read()
        keys = requests.groupBy("product", "root_cause", "month").agg(F.min(order).alias("first"))
        if known is not None:
            keys = table.without(keys, known)
            last = known.groupBy("month").agg(F.max(F.regexp_extract("task_id", r"(\d+)$", 1).cast("int")).alias("last"))
            keys = keys.join(last.withColumnRenamed("month", "of"), F.col("month").eqNullSafe(F.col("of")), "left")
        else:
            keys = keys.withColumn("last", F.lit(0))
        w = Window.partitionBy("month").orderBy("first", "product", "root_cause")
        number = F.coalesce("last", F.lit(0)) + F.row_number().over(w)
        fresh = keys.select("product", "root_cause", "month", F.format_string("TASK-%s-%04d", F.replace("month", F.lit("-"), F.lit("")), number).alias("task_id"))
        try:
            table.merge(fresh, keep=True, at=version)
            break
        except Conflict:
            if not left:
                raise
    return table.read()
