"""From window scores of the 7 speaker-set classes to speaker activities and voice spans, in samples.

The scores of all windows of a recording may come in any order; a window is known by its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frames as FR
from ..functions import vectors as V
from . import frames as O


def checked(windows: DataFrame, frames: int = FR.WINDOW_FRAMES) -> DataFrame:
    """windows (rec, start, logits array<array<double>>), or an error for a wrong shape or a value that isn't finite."""
    bad_shape = (F.size("logits") != frames) | F.exists("logits", lambda x: F.size(x) != 7)
    bad_value = F.exists("logits", lambda x: F.exists(x, lambda y: F.isnan(y) | (F.abs(y) == float("inf"))))
    error = F.when(bad_shape, F.raise_error(F.lit("LogitShape")).cast("array<array<double>>")).when(bad_value, F.raise_error(F.lit("NonFiniteLogits")).cast("array<array<double>>"))
    return windows.withColumn("logits", error.otherwise(F.col("logits")))


def frame_scores(windows: DataFrame) -> DataFrame:
    """rec, start, frame, slots (probabilities of the three speakers) and voice of each window's frames."""
    rows = windows.select("rec", "start", F.posexplode("logits").alias("frame", "_l")).withColumn("_p", V.softmax(F.col("_l")))
    return rows.select("rec", "start", F.col("frame").cast("long").alias("frame"), F.array(*FR.speaker_marginals(F.col("_p"))).alias("slots"), FR.voice_probability(F.col("_p")).alias("voice"))


def speaker_activities(scores: DataFrame, totals: DataFrame, onset: float = 0.5, offset: float = 0.357, least: int = 0) -> DataFrame:
    """rec, start, slot, first, stop: samples in which a window's speaker is on, cut at the recording's `total`."""
    each = scores.select("rec", "start", "frame", F.posexplode("slots").alias("slot", "p"))
    keys = ("rec", "start", "slot")
    spans = O.runs(O.hysteresis(each, onset, offset, keys), keys).join(totals, "rec")
    at = lambda f: F.least(F.col("start") + FR.frame_to_sample(f), F.col("total"))
    out = spans.select(*keys, at(F.col("first")).alias("first"), at(F.col("stop")).alias("stop"))
    return O.long_enough(out, least)


def voice_spans(scores: DataFrame, totals: DataFrame, onset: float = 0.5, offset: float = 0.357, gap: int = 0, least: int = 0) -> DataFrame:
    """rec, first, stop: samples with voice. Overlapping windows are averaged frame by frame; frames that none holds are off."""
    placed = scores.select("rec", (FR.sample_to_frame(F.col("start")) + F.col("frame")).alias("frame"), F.col("voice").alias("p"))
    mean = O.stitched_mean(placed).select("rec", "frame", F.col("mean").alias("p"))
    frames = totals.select("rec", F.explode(F.expr("IF(total > 0, sequence(0L, CAST(ceil(total * 589 / 160000) AS bigint) - 1), CAST(array() AS array<bigint>))")).alias("frame"))
    dense = frames.join(mean, ["rec", "frame"], "left").select("rec", "frame", F.coalesce("p", F.lit(0.0)).alias("p"))
    spans = O.runs(O.hysteresis(dense, onset, offset)).join(totals, "rec")
    at = lambda f: F.least(FR.frame_to_sample(f), F.col("total"))
    out = O.merge_gaps(spans.select("rec", at(F.col("first")).alias("first"), at(F.col("stop")).alias("stop")), gap)
    return O.long_enough(out, least)
