"""Statistics of stored tables for the cost-based optimizer, and what the catalog says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NDV_ERROR = "spark.sql.statistics.ndv.maxError"
_FIELDS = {"num_nulls": "nulls", "distinct_count": "distinct_values", "min": "least", "max": "greatest"}


def refresh(spark: SparkSession, table: str, error: float | None = None) -> None:
    """Row count, size and column statistics of a stored table, after a load.

    error: the greatest relative error of distinct counts, else the session's. The session keeps its own setting.
    """
    before = spark.conf.get(NDV_ERROR)
    try:
        if error is not None:
            spark.conf.set(NDV_ERROR, str(error))
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
    finally:
        spark.conf.set(NDV_ERROR, before)


def table_rows(spark: SparkSession, table: str) -> int | None:
    """The row count in the catalog; None where the table was never analysed."""
    said = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}.get("Statistics", "")
    return int(said.split(",")[1].split()[0]) if " rows" in said else None


def column_statistics(spark: SparkSession, table: str) -> DataFrame:
    """(column, rows, nulls, distinct_values, least, greatest) of every column, as the catalog has them; a row a column."""
    rows = table_rows(spark, table)
    found = []
    for name in spark.table(table).columns:
        said = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {table} `{name}`").collect()}
        value = lambda k: None if said.get(k) in (None, "NULL") else said[k]  # noqa: B023, E731
        found.append((name, rows, *(None if value(k) is None else int(value(k)) for k in ("num_nulls", "distinct_count")), value("min"), value("max")))
    return spark.createDataFrame(found, "column string, rows long, nulls long, distinct_values long, least string, greatest string")
