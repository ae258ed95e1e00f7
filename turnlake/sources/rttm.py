"""RTTM text: reading and writing of speaker turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("type", "uri", "channel", "start", "duration", "ortho", "subtype", "speaker", "confidence", "lookahead")


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """uri, channel, start, duration, speaker of the SPEAKER lines of text files. Lines of other types are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(*(F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(FIELDS)))
    return lines.filter("type = 'SPEAKER'").select("uri", F.col("channel").cast("int"), F.col("start").cast("double"), F.col("duration").cast("double"), "speaker")


def write_rttm(lines: DataFrame, path: str) -> None:
    """Writes lines (rec, start, cluster, line) as text, each recording's in order of start and cluster."""
    lines.repartition("rec").sortWithinPartitions("rec", "start", "cluster").select("line").write.text(path)
