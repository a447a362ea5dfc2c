"""Rank history: latest and best positions, local-day history, nested and wide series, gap filling and the generator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.constants import CAPTURE_TIME, DEFAULT_SERIES, NOT_RANKING, PRESET_RANGE_DAYS, UPDATE_DAY
from siltstone.functions.dates import checked_range, local_day, local_start
from siltstone.functions.text import draw, fnv1a

#: Beyond every position.
NO_POSITION = 1000


def _place(position: Column) -> Column:
    """What settles captures at the same instant: the better position counts, none comes last."""
    return F.coalesce(position, F.lit(NO_POSITION))


def latest_positions(pairs: DataFrame, snapshots: DataFrame, zone: str, key: list[str]) -> DataFrame:
    """Every pair with its latest (position, date in zone); both null where there is no snapshot.

    A latest snapshot without a position has a date and a null position; of several at that instant the best position
    counts. One partial aggregate, no sort of histories.
    """
    last = snapshots.groupBy(*key).agg(F.max_by(F.struct("position", "captured_at"), F.struct("captured_at", -_place(F.col("position")))).alias("latest"))
    found = pairs.join(last, key, "left")
    return found.select(*pairs.columns, F.col("latest.position").alias("position"), local_day(F.col("latest.captured_at"), zone).alias("date"))


def best_positions(latest: DataFrame, key: list[str]) -> DataFrame:
    """(key, best): the least position of each key that has any."""
    return latest.groupBy(*key).agg(F.min("position").alias("best"))


def page_history(pairs: DataFrame, snapshots: DataFrame, key: list[str], zone: str, start: str | None = None, end: str | None = None, today: date | None = None) -> DataFrame:
    """pairs with (captured_at, date, position) for snapshots of the local days start..end, both included.

    The days become a half-open range of instants on the raw column, so days of 23 and 25 hours are right and the filter
    reaches the scan. ValueError for a bad range.
    """
    first, last = checked_range(start, end, today or date.today())
    kept = snapshots.where((F.col("captured_at") >= local_start(first, zone)) & (F.col("captured_at") < local_start(last, zone, 1)))
    return pairs.join(kept, key).select(*pairs.columns, "captured_at", local_day(F.col("captured_at"), zone).alias("date"), "position")


def history_series(pairs: DataFrame, history: DataFrame, key: list[str]) -> DataFrame:
    """pairs with points array<struct<date, position>> in order of capture; empty where there is no history."""
    points = history.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("captured_at", "date", "position"))).alias("p"))
    found = pairs.join(points, key, "left")
    plain = F.transform("p", lambda x: F.struct(x["date"].alias("date"), x["position"].alias("position")))
    return found.select(*pairs.columns, F.coalesce(plain, F.array().cast("array<struct<date:string,position:int>>")).alias("points"))


def history_pivot(history: DataFrame, column: str, values: list, key: tuple[str, ...] = ()) -> DataFrame:
    """One row by date and, of a history of several keys, by those; one column by value; in order of date.

    Of several captures on a day the later counts.
    """
    last = F.max_by("position", F.struct("captured_at", -_place(F.col("position"))))
    return history.groupBy("date", *key).pivot(column, values).agg(last).orderBy("date", *key)


def _unheld(pairs: DataFrame, existing: DataFrame, key: list[str], rows: Column, day: Callable[[Column], Column]) -> DataFrame:
    """pairs with _rows: of the array rows those whose day has no snapshot yet. A pair's days meet as one row, not as a row each."""
    held = existing.groupBy(*key).agg(F.collect_set("snapshot_date").alias("_held"))
    kept = F.filter(rows, lambda r: ~F.array_contains(F.coalesce("_held", F.array().cast("array<date>")), day(r)))
    return pairs.join(held, key, "left").withColumn("_rows", kept).drop("_held")


def missing_days(pairs: DataFrame, existing: DataFrame, key: list[str], days: Column) -> DataFrame:
    """(key, snapshot_date) of pairs and days that have no snapshot yet."""
    return _unheld(pairs.select(*key), existing, key, days, lambda d: d).select(*key, F.explode("_rows").alias("snapshot_date"))


def first_of_day(snapshots: DataFrame, key: list[str]) -> DataFrame:
    """One snapshot a pair and UTC day: the first captured."""
    return snapshots.groupBy(*key, F.to_date("captured_at").alias("snapshot_date")).agg(F.min("captured_at").alias("captured_at"), F.min_by("position", F.struct("captured_at", _place(F.col("position")))).alias("position"))


def with_draws(days: Column) -> Column:
    """array<struct<date, update, before>>: each day, whether it moves all pairs, and how many such days came before."""
    flagged = F.transform(days, lambda d: F.struct(d.alias("date"), (draw(fnv1a(F.concat(F.lit("update:"), d.cast("string"))), F.lit(1)) < UPDATE_DAY).cast("int").alias("update")))
    none = F.array().cast("array<struct<date:date,update:int,before:int>>")
    start = F.struct(F.lit(0).alias("n"), none.alias("out"))
    step = lambda a, d: F.struct((a["n"] + d["update"]).alias("n"), F.array_append(a["out"], F.struct(d["date"].alias("date"), d["update"].alias("update"), a["n"].alias("before"))).alias("out"))
    return F.aggregate(flagged, start, step, lambda a: a["out"])


#: Numbers of a walk that are worked on at a time.
WALK_BLOCK = 4096


def _draws(seed: np.ndarray, k: int) -> np.ndarray:
    """functions.text.draw of unsigned 64-bit seeds: products of 32-bit numbers fit."""
    low = np.uint64(0xFFFFFFFF)
    s = (seed + np.uint64(k * 0x6D2B79F5 & 0xFFFFFFFF)) & low
    t = ((s ^ (s >> np.uint64(15))) * (s | np.uint64(1))) & low
    u = ((t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & low)) & low) ^ t
    return (u ^ (u >> np.uint64(14))) / 4294967296.0


def _walks(seed: np.ndarray, base: np.ndarray, days: list[tuple[int, int]]) -> np.ndarray:
    """The position of each seed (row) on each of days(update, before), -1 for none; all seeds go a day at a time."""
    out = np.empty((len(seed), len(days)), np.int32)
    way = np.where(_draws(seed, 2) < 0.5, -1.0, 1.0)
    at = base + (_draws(seed, 3) - 0.5) * 10
    for i, (update, before) in enumerate(days):
        k = 3 + i * 4 + before
        walk = _draws(seed, k + 1) + _draws(seed, k + 2) + _draws(seed, k + 3)
        jump = _draws(seed, k + 4)
        at = at + (0.15 * (base - at) + (walk - 1.5) * 2)
        at = np.minimum(100.0, np.maximum(1.0, at + (way * (5 + jump * 10) if update else 0.0)))
        shown = _draws(seed, k + 5) if update else jump
        out[:, i] = np.where(shown >= NOT_RANKING, np.floor(at + 0.5), -1)
    return out


def _positions(days: list[tuple[int, int]]):
    """(seed, base) to an array of positions, one a day; null where there is none, or no seed."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def positions(seed: pa.Array, base: pa.Array) -> pa.Array:
        parts = []
        for a in range(0, len(seed), WALK_BLOCK):
            own = seed.slice(a, WALK_BLOCK)
            found = _walks(own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64), base.slice(a, WALK_BLOCK).to_numpy(zero_copy_only=False), days)
            found[own.is_null().to_numpy(zero_copy_only=False)] = -1
            flat = found.ravel()
            parts.append(pa.array(flat, mask=flat < 0))
        size = np.arange(len(seed) + 1, dtype=np.int32) * np.int32(len(days))
        return pa.ListArray.from_arrays(pa.array(size), pa.concat_arrays(parts or [pa.array([], pa.int32())]))

    return positions


def _series(pairs: DataFrame, seed_key: Column, rank_order: Column, days: Column) -> DataFrame:
    """pairs with _points array<struct<snapshot_date, captured_at, position>> of all days."""
    captured = F.transform(days, lambda d: F.to_timestamp(F.concat(d.cast("string"), F.lit(f" {CAPTURE_TIME}"))))
    one = pairs.sparkSession.range(1)
    known = one.select(with_draws(days)).first()[0]  # the days alone
    # The numbers of the walk, here and in _walks.
    rows = pairs.withColumn("_seed", fnv1a(seed_key)).withColumn("_base", F.least(F.lit(90.0), F.lit(2) + rank_order * 6 + draw(F.col("_seed"), F.lit(1)) * 15))
    rows = rows.withColumn("_position", _positions([(d["update"], d["before"]) for d in known])(F.col("_seed"), F.col("_base")))
    rows = rows.join(F.broadcast(one.select(days.alias("_date"), captured.alias("_captured"))), F.lit(True))
    points = F.transform(F.arrays_zip("_date", "_captured", "_position"), lambda x: F.struct(x["_date"].alias("snapshot_date"), x["_captured"].alias("captured_at"), x["_position"].alias("position")))
    return rows.select(*pairs.columns, points.alias("_points"))


def generate_series(pairs: DataFrame, seed_key: Column, rank_order: Column, days: Column) -> DataFrame:
    """pairs with (snapshot_date, captured_at, position): an invented history that depends on the key and days alone.

    A walk that returns to a base, jumps on shared update days, is held to 1..100, and has no position on some days. The
    k-th draw of a seed is a closed form, so a batch of pairs goes a day at a time; only the clamped walk is a fold.
    """
    return _series(pairs, seed_key, rank_order, days).select(*pairs.columns, F.inline("_points"))


def fill_snapshots(existing: DataFrame, pairs: DataFrame, key: list[str], seed_key: Column, rank_order: Column, days: Column) -> DataFrame:
    """Only the generated rows whose (pair, day) is not there yet: appending them again and again changes nothing."""
    made = _unheld(_series(pairs, seed_key, rank_order, days), existing, key, F.col("_points"), lambda x: x["snapshot_date"])
    return made.select(*key, F.inline("_rows"))


def position_tone(position: Column, captured: Column) -> Column:
    """top, good, low, unranked (captured beyond the top 100) or none (not captured)."""
    return F.when(position <= 3, "top").when(position <= 10, "good").when(position.isNotNull(), "low").when(captured.isNotNull(), "unranked").otherwise("none")


def axis(history: DataFrame) -> DataFrame:
    """(worst, step, bottom, ticks) of a chart that shows all positions and 1."""
    one = history.agg(F.greatest(F.lit(1), F.coalesce(F.max("position"), F.lit(1))).alias("worst"))
    one = one.withColumn("step", F.when(F.col("worst") <= 20, 5).when(F.col("worst") <= 50, 10).otherwise(25))
    one = one.withColumn("bottom", F.least(F.lit(100), (F.ceil((F.col("worst") + 1) / F.col("step")) * F.col("step")).cast("int")))
    ticks = F.array_union(F.array(F.lit(1)), F.sequence(F.col("step"), F.col("bottom"), F.col("step")))
    return one.withColumn("ticks", ticks)


def default_series(keywords: DataFrame, key: str, order: list[str], count: int = DEFAULT_SERIES) -> DataFrame:
    """The keywords that a page's chart shows at first: the first few of each key."""
    return keywords.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= count).drop("_n")


def range_spans(today: Column) -> Column:
    """array<struct<days, first, last>> of the ranges that are offered on a day, each ending then."""
    return F.array(*[F.struct(F.lit(n).alias("days"), F.date_sub(today, n - 1).alias("first"), today.alias("last")) for n in PRESET_RANGE_DAYS])


def preset_ranges(today: date) -> list[tuple[date, date]]:
    """The ranges that are offered, each ending today."""
    return [(today - timedelta(n - 1), today) for n in PRESET_RANGE_DAYS]
