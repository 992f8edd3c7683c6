"""Count-based slots and time windows over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slot_totals(events: DataFrame, slot: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Number and sum of values per type and tumbling window; rows later than ``late`` are not counted.

    Works on a streaming or a bounded frame with ts, event_type and value.
    """
    return events.withWatermark("ts", late).groupBy(F.window("ts", slot), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("slot"), "event_type", "n", "total")
