"""Schemas of the relations, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "users": "id string, email string, password_hash string, timezone string, created_at timestamp",
    "sessions": "id string, user_id string, expires_at timestamp, created_at timestamp",
    "clients": "id string, user_id string, name string, website_url string, site_key string, crawl_status string, crawl_error_code string, crawl_error_message string, sitemap_url string, discovery_method string, pages_total int, pages_done int, crawl_started_at timestamp, crawl_finished_at timestamp, crawl_heartbeat_at timestamp, created_at timestamp",
    "pages": "id string, client_id string, url string, sitemap_position int, fetch_status string, http_status smallint, final_url string, title string, meta_description string, h1 string, word_count int, lang string, response_ms int, fetch_error string, fetched_at timestamp",
    "keywords": "id bigint, term string",
    "page_keywords": "id bigint, page_id string, keyword_id bigint, score float, rank_order smallint, sources array<string>",
    "seo_issues": "page_id string, code string, severity string, message string, details string",
    "rank_snapshots": "page_keyword_id bigint, snapshot_date date, captured_at timestamp, position smallint",
}


#: Columns that have to have a value, and those that tell rows apart.
KEYS = {"users": ["id"], "sessions": ["id"], "clients": ["id"], "pages": ["id"], "keywords": ["id"], "page_keywords": ["id"], "seo_issues": ["page_id", "code"], "rank_snapshots": ["page_keyword_id", "snapshot_date"]}


def empty(spark, name: str):
    return spark.createDataFrame([], SCHEMAS[name])


def conform(rows: DataFrame, name: str) -> DataFrame:
    """rows as a relation of the schema: its columns in their order and types, those that rows lack null.

    Rows without a key are left out, and of several with one key one stays, as constraints of a store would have it.
    """
    kind = StructType.fromDDL(SCHEMAS[name])
    whole = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
    return whole.dropna(subset=KEYS[name]).dropDuplicates(KEYS[name])


def migrate(relations: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Every relation of the schema stored below path, those that aren't given empty; read back with the schema's types."""
    spark = next(iter(relations.values())).sparkSession
    for name in SCHEMAS:
        (conform(relations[name], name) if name in relations else empty(spark, name)).write.mode("ignore").parquet(f"{path}/{name}")
    return {name: spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}") for name in SCHEMAS}
