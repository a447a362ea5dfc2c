"""Stored tables that change in place: Parquet by buckets of the key, of which a change rewrites those that it touches.

A row lies in the folder of its bucket, a hash of its key modulo the number of buckets, so the rows that a change may meet
are in the buckets of the change's own keys. Only these are read (partition pruning), go through one of the functions of
state.py, and are written back by dynamic partition overwrite; the files of all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from siltstone.functions.lineage import cut, remove
from siltstone.operators.ranks import _place

BUCKET = "_bucket"
#: The number of buckets reaches the driver with each change; bounded here.
MOST_BUCKETS = 100_000


@dataclass
class Store:
    """A table at path, in buckets of the columns key.

    One change at a time: what reads the table during a change may see some buckets before and some after it. A change
    that fails while its files are put in place has to be made again; changes that are upserts can be.
    """

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    schema: StructType
    buckets: int = 64

    def __post_init__(self):
        if not 1 <= self.buckets <= MOST_BUCKETS or not self.key:
            raise ValueError(f"a store has a key and 1 to {MOST_BUCKETS} buckets")

    def bucket(self, rows: DataFrame) -> Column:
        """The bucket of each of rows, by the stored types of the key."""
        return F.pmod(F.xxhash64(*[F.col(k).cast(self.schema[k].dataType) for k in self.key]), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> None:
        """Rewrites the buckets that rows have; each is written by one task, sorted by key."""
        placed = rows.select(*self.schema.names, self.bucket(rows).alias(BUCKET)).repartition(BUCKET).sortWithinPartitions(BUCKET, *self.key)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, all or those of some buckets; none before the first change."""
        whole = StructType([*self.schema.fields]).add(BUCKET, IntegerType())
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(whole).parquet(self.path)
        if buckets is not None:
            found = found.where(F.col(BUCKET).isin(buckets) if buckets else F.lit(False))
        return found.select(*self.schema.names)

    def matching(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is one of keys: reads their buckets alone."""
        return self.read(self._touched(keys)).join(keys.select(*self.key).distinct(), list(self.key), "left_semi")

    def _touched(self, *changes: DataFrame) -> list[int]:
        parts = [c.select(self.bucket(c).alias(BUCKET)).distinct() for c in changes]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return sorted(r[0] for r in every.distinct().collect())  # at most as many as there are buckets

    def apply(self, function: Callable[..., DataFrame], *changes: DataFrame) -> list[int]:
        """Puts function(rows, *changes) in place of the rows that changes may meet; returns the buckets it has rewritten.

        The changes have the columns of the key. function gets the rows of the touched buckets and returns what is to be
        in them: rows of other keys as they were. A bucket of which nothing is left is removed.
        """
        changes = tuple(cut(c) for c in changes)
        touched = self._touched(*changes)
        if not touched:
            return []
        after = cut(function(self.read(touched), *changes))
        left = set(self._touched(after))
        if not left <= set(touched):
            raise ValueError("a change may only leave rows in the buckets of its own keys")
        if left:
            self._write(after)
        for bucket in set(touched) - left:
            remove(self.spark, f"{self.path}/{BUCKET}={bucket}")
        return touched


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def files(spark: SparkSession, path: str) -> dict[str, int]:
    """The data files below a path and when each was written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store, found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), {}
    listed = store.listFiles(at, True)
    while listed.hasNext():
        one = listed.next()
        if one.getPath().getName().endswith(".parquet"):
            found[one.getPath().toString()] = one.getModificationTime()
    return found


# --- what is kept in stores


def merge_latest(key: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """For Store.apply: latest captures (key, captured_at, position) with those of a batch of captures merged in.

    Of several at an instant the best position counts, as in ranks.latest_positions. Batches may come in any order and
    more than once: the latest of latest ones is the same.
    """
    return lambda held, batch: _latest(held.unionByName(batch.select(*held.columns)), key)


def _latest(captures: DataFrame, key: list[str]) -> DataFrame:
    last = F.max_by(F.struct("captured_at", "position"), F.struct("captured_at", -_place(F.col("position"))))
    return captures.groupBy(*key).agg(last.alias("l")).select(*key, "l.captured_at", "l.position")


def keep_latest(store: Store, captures: DataFrame) -> list[int]:
    """Merges a batch of captures into a store of latest ones; a batch is reduced to a row a key first."""
    key = list(store.key)
    return store.apply(merge_latest(key), _latest(captures, key))


def first_captures(held: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """For Store.apply: one capture a (key, snapshot_date), the first, of those held and a batch."""
    both = held.unionByName(batch.select(*held.columns))
    first = F.min_by(F.struct("captured_at", "position"), F.struct("captured_at", _place(F.col("position"))))
    return both.groupBy(*key, "snapshot_date").agg(first.alias("f")).select(*key, "snapshot_date", "f.captured_at", "f.position").select(*held.columns)
