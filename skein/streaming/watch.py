"""Change events as streams: debounce by session windows, pending paths, banner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.files import IGNORED, LANGUAGES


def watched(events: DataFrame) -> DataFrame:
    """Events (path, ts) of files that a scan would read; extensions in any case."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    parts = F.split("path", r"[\\/]")
    return events.where(ext.isin(*LANGUAGES) & ~F.exists(parts, lambda p: p.startswith(".") | p.isin(*IGNORED)))


def debounced(events: DataFrame, key: str | None = None, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """A row for each burst of events without a pause of ``gap``; works on streams and tables.

    Each event extends its burst (a trailing debounce). On streams a burst comes out once the watermark
    has passed it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    window = F.session_window("ts", gap).alias("w")
    # Spark's streams need a key beside a session window; without one of the caller's, all rows share it.
    grouped = rows.groupBy(window, F.col(key) if key else F.when(F.col("ts").isNotNull(), 0).alias("_all"))
    return grouped.agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w", "_all")


def pending(events: DataFrame, most: int = 100) -> DataFrame:
    """path, last_ts: the first ``most`` distinct paths waiting for a refresh."""
    return events.groupBy("path").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).orderBy("first_ts", "path").limit(most)


def banner(paths: list[str], shown: int = 5) -> str:
    if not paths:
        return ""
    more = f" and {len(paths) - shown} more" if len(paths) > shown else ""
    return f"Pending changes: {', '.join(paths[:shown])}{more}\n"


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """New files under root as a stream of (path, ts)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    return raw.select("path", F.col("modificationTime").alias("ts"))


def refresh_on(stream: DataFrame, refresh, checkpoint: str, every: str = "2 seconds"):
    """Start a query that calls refresh(paths) for each micro-batch with changes."""

    def batch(df: DataFrame, _: int) -> None:
        rows = [r["path"] for r in pending(watched(df)).collect()]
        if rows:
            refresh(rows)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
