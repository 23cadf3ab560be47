"""A session with the settings the plans expect."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own.

    ``shared`` is the folder of intermediate results (``spark.checkpoint.dir``); spent ones are deleted.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexiloom")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", shared or str(Path(tempfile.gettempdir()) / "lexiloom-shared"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
