"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, app: str = "campanula") -> SparkSession:
    """A local session for tests and benchmarks.

    On a cluster the session comes from outside; the library sets nothing
    there.  What it relies on are Spark's adaptive execution defaults.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
