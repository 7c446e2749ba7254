"""Change detection over a stream of file versions: an extension, as the batch operators have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_changes(versions: DataFrame, base: DataFrame) -> DataFrame:
    """J1 on a stream ``versions`` (path, sha256, ts): those that ``base`` (path, sha256, a fixed table) doesn't have or has with
    another checksum, as (path, ts, change_type). A stream-static join: no state grows with the stream."""
    old = base.select("path", F.col("sha256").alias("_was"))
    kind = F.when(F.col("_was").isNull(), "added").otherwise("modified")
    return versions.join(old, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("_was"))).select("path", "ts", kind.alias("change_type"))


def change_rate(changes: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, change_type, n) of changes (ts, change_type) by tumbling window; the watermark bounds the state."""
    return (
        changes.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "change_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "change_type", "n")
    )
