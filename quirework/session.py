"""Sessions with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quirework", cores: int | str = "*", partitions: int | None = None, checkpoint: str | None = None) -> SparkSession:
    """A local session; on a cluster, set the same SQL settings and a shared spark.checkpoint.dir."""
    builder = SparkSession.builder.appName(name).master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    # Decoding by other than Java's own charset names, and base64 in one line
    builder = builder.config("spark.sql.legacy.javaCharsets", "true").config("spark.sql.chunkBase64String.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
