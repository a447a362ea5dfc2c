"""Captures as a stream into a stored table: known pairs only, one row a pair and day, however often a capture comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from siltstone.functions.lineage import cut
from siltstone.operators.store import Store, first_captures, keep_latest


def new_captures(stream: DataFrame, pairs: DataFrame, key: list[str], delay: str = "1 day") -> DataFrame:
    """The captures of stream(key, captured_at, position) that are of a known pair and not repeated, with snapshot_date.

    pairs is a table: the join is static and reads it anew with each batch. Captures that come later than the delay are
    dropped, and a repeated one within it.
    """
    known = stream.join(pairs.select(*key).distinct(), key, "left_semi")
    dated = known.withColumn("snapshot_date", F.to_date("captured_at")).withWatermark("captured_at", delay)
    return dated.dropDuplicatesWithinWatermark([*key, "captured_at", "position"])


def into(snapshots: Store, latest: Store | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch into the stored snapshots and, if there is one, the store of latest positions.

    Both merges give the same however often a batch is tried again, so a batch that was cut short is made good by the next
    attempt.
    """
    key = [k for k in snapshots.key if k != "snapshot_date"]

    def merge(batch: DataFrame, _: int) -> None:
        rows = cut(batch)
        snapshots.apply(lambda held, new: first_captures(held, new, key), rows.select(*snapshots.schema.names))
        if latest is not None:
            keep_latest(latest, rows.select(*latest.schema.names))

    return merge


def ingest(stream: DataFrame, pairs: DataFrame, snapshots: Store, checkpoint: str, latest: Store | None = None, delay: str = "1 day") -> DataStreamWriter:
    """A stream of captures, ready to start, into stores whose key is that of the pairs (snapshots: with snapshot_date or not).

    A day's first capture counts, as the primary key (pair, day) lets no second one in.
    """
    key = [k for k in snapshots.key if k != "snapshot_date"]
    return new_captures(stream, pairs, key, delay).writeStream.foreachBatch(into(snapshots, latest)).option("checkpointLocation", checkpoint)
