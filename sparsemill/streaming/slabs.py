"""Slab assignment as a stream: records that arrive are joined to the static slab table; late ones are dropped by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_stream(records: DataFrame, slabs: DataFrame, halo: float, arrived: str = "arrived", late: str = "10 minutes") -> DataFrame:
    """(cell, embryo, slab, arrived): the first slab (by number) of the record's embryo whose time range, widened by
    ``halo``, holds it; records without one drop out. A record delivered again within the watermark counts once.

    A stream-static join: the slab table is small and read again every batch, so new slabs are seen. Slab ranges of an
    embryo are few, so their list travels with the embryo, and a record finds its slab without an aggregation.
    """
    ranges = slabs.groupBy("embryo").agg(F.array_sort(F.collect_list(F.struct("slab", "begin", "end"))).alias("_s"))
    fits = lambda s: (F.col("time") >= s["begin"] - halo) & (F.col("time") <= s["end"] + halo)
    once = records.withWatermark(arrived, late).dropDuplicatesWithinWatermark(["cell"])
    return once.join(ranges, "embryo").withColumn("slab", F.try_element_at(F.filter("_s", fits), F.lit(1))["slab"]).where("slab is not null").select("cell", "embryo", "slab", arrived)


def arrival_counts(events: DataFrame, time: str, kind: str, window: str, late: str) -> DataFrame:
    """(begin, kind, n): events by tumbling window and kind, closed by the watermark."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), kind, "n")
