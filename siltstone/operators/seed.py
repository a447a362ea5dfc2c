"""Filling an empty store: users and clients, their crawls, and a rank history for every pair, with what has to hold after."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import dates
from siltstone.functions.lineage import cut
from siltstone.operators import ranks, reads, state

#: Fixed value: snapshots that a seeded store has, at least.
MIN_SNAPSHOTS = 50_000


def seed_accounts(users: DataFrame, clients: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users, clients that are new) for accounts(id, email, password_hash, timezone, name, website_url).

    Seeding again updates passwords; a client that its user has already isn't added twice.
    """
    after = cut(state.upsert_users(users, accounts.select("id", "email", "password_hash", "timezone")))
    owner = after.select(F.col("id").alias("user_id"), "email")
    wanted = accounts.withColumn("email", state.normalize_email(F.col("email"))).join(owner, "email")
    return after, state.insert_clients(clients, wanted.select("user_id", "name", "website_url"))


def seed_ranks(t: reads.Tables, today: date, min_rows: int = MIN_SNAPSHOTS) -> DataFrame:
    """The snapshots to append so that every pair has its history: days enough for min_rows rows, those there are kept.

    LookupError where there is no pair, or a client without keywords; ValueError if too few rows would exist.
    """
    n = t.page_keywords.count()
    if not n:
        raise LookupError("no keywords were extracted, so there is nothing to track")
    empty = t.clients.join(reads.client_keyword_counts(t), t.clients.id == F.col("client_id"), "left").where(F.coalesce("keywords", F.lit(0)) == 0)
    without = [r.name for r in empty.select("name").limit(5).collect()]
    if without:
        raise LookupError(f"no keywords of {', '.join(without)}")
    days = t.clients.sparkSession.range(1).select(dates.history_days(F.lit(n), min_rows)).first()[0]
    pairs = reads.all_pairs(t).select(F.col("id").alias("page_keyword_id"), F.concat_ws("|", "url", "term").alias("_key"), "rank_order")
    spine = dates.snapshot_days(F.lit(today), int(days))
    total = ranks.missing_days(pairs, t.rank_snapshots, ["page_keyword_id"], spine).count()
    if total < min_rows:
        total += t.rank_snapshots.count()
    if total < min_rows:
        raise ValueError(f"only {total} snapshots exist; expected at least {min_rows}")
    return ranks.fill_snapshots(t.rank_snapshots, pairs, ["page_keyword_id"], F.col("_key"), F.col("rank_order"), spine)
