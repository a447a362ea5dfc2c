"""Session defaults for local runs, tests and the benchmark; a cluster brings its own settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

from siltstone.config import load


def local_session(cpus: int | str = "*", partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """A local[cpus] session in UTC with adaptive execution, without the web page; the rest as the settings say.

    Checkpoints are removed when nothing refers to them any more, as a cluster's session should be told to do, too.
    """
    settings = load()
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siltstone")
        .config("spark.driver.memory", memory or settings.driver_memory)
        .config("spark.sql.shuffle.partitions", str(partitions or settings.shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
