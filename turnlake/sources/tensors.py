"""Packed recordings: one row a window with its activity matrix, turned into the long tables of the operators, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpack_activity(windows: DataFrame) -> DataFrame:
    """rec, chunk, at, slot, activity of (rec, chunk, activity array<array<double>>, frames by slots); zeros are left out, NaN fails."""
    frames = windows.select("rec", "chunk", F.posexplode("activity").alias("at", "_slots"))
    cells = frames.select("rec", "chunk", "at", F.posexplode("_slots").alias("slot", "activity"))
    checked = F.when(F.isnan("activity") | (F.abs("activity") == float("inf")), F.raise_error(F.lit("NonFiniteActivity")).cast("double")).otherwise(F.col("activity").cast("double"))
    return cells.select("rec", "chunk", "at", "slot", checked.alias("activity")).filter("activity <> 0")


def pack_activity(seg: DataFrame, frames: int, slots: int = 3) -> DataFrame:
    """rec, chunk, activity (array of arrays) of the long table; missing cells are 0."""
    cells = seg.groupBy("rec", "chunk").agg(F.map_from_entries(F.collect_list(F.struct((F.col("at") * slots + F.col("slot")).cast("int"), F.col("activity").cast("double")))).alias("_m"))
    row = lambda f: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.coalesce(F.try_element_at("_m", (f * slots + s).cast("int")), F.lit(0.0)))
    return cells.select("rec", "chunk", F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), row).alias("activity"))
