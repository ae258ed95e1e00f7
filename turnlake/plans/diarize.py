"""Who spoke when: from window activities and voice embeddings to text lines, as one plan over all recordings."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import frames as O
from ..operators import similarity as S
from ..operators.assignment import SLOTS, UNMATCHED, assign_slots
from ..operators.features import Projection, project
from ..operators.variational import posterior_centroids
from ..tables import Rounds

LEAST_ACTIVE = 0.2
#: Frames of a recording's output at most.
MOST_FRAMES = 1 << 26


@dataclass(frozen=True)
class DiarizeOptions:
    """What a diarization can be told, refused if out of range. `with_` gives a copy with some of it changed."""

    onset: float = 0.5
    threshold: float = 0.6
    fa: float = 0.07
    fb: float = 0.8
    rounds: int = 20
    min_duration_off: float = 0.0
    smoothing: float | None = None
    least_active: float = LEAST_ACTIVE

    def __post_init__(self) -> None:
        if not (math.isfinite(self.onset) and 0 < self.onset <= 1):
            raise ValueError("OnsetOutOfRange")
        if not (math.isfinite(self.threshold) and self.threshold > 0):
            raise ValueError("InvalidThreshold")
        if not all(math.isfinite(v) and v > 0 for v in (self.fa, self.fb)):
            raise ValueError("FactorOutOfRange")
        if not 1 <= self.rounds <= 1000:
            raise ValueError("MaxItersOutOfRange")
        if not 0 <= self.least_active <= 1:
            raise ValueError("LeastActiveOutOfRange")
        O.check_gap(self.min_duration_off)
        O.check_epsilon(self.smoothing)

    def with_(self, **changes) -> DiarizeOptions:
        return replace(self, **changes)


def active_pairs(seg: DataFrame, frames: int, least: float = LEAST_ACTIVE) -> DataFrame:
    """rec, chunk, slot, clean of slots that are alone in at least `least` of a chunk's frames; seg (rec, chunk, at, slot, activity) may leave out zeros.

    Activities are added in the order of their frames, as a sum at the limit itself hangs on its last bit.
    """
    on = seg.filter("activity > 0")
    alone = on.groupBy("rec", "chunk", "at").agg(F.count(F.lit(1)).alias("n"), F.first("slot").alias("slot"), F.first("activity").alias("activity")).filter("n = 1")
    each = F.sort_array(F.collect_list(F.struct("at", "activity")))
    return alone.groupBy("rec", "chunk", "slot").agg(F.aggregate(each, F.lit(0.0), lambda s, x: s + x["activity"]).alias("clean")).filter(F.col("clean") >= least * frames)


def mask_inactive(soft: DataFrame, seg: DataFrame) -> DataFrame:
    """soft (rec, chunk, slot, cluster, soft) with the least score of the recording less 1 for slots that are never on."""
    on = seg.groupBy("rec", "chunk", "slot").agg(F.sum("activity").alias("_on"))
    # A window, not a join with itself: what soft is made of runs once.
    low = F.min("soft").over(Window.partitionBy("rec")) - 1
    out = soft.withColumn("_low", low).join(on, ["rec", "chunk", "slot"], "left")
    return out.select("rec", "chunk", "slot", "cluster", F.when(F.coalesce("_on", F.lit(0.0)) == 0, F.col("_low")).otherwise(F.col("soft")).alias("soft"))


def assign_embeddings(vecs: DataFrame, seg: DataFrame, frames: int, weights: Projection, options: DiarizeOptions = DiarizeOptions()) -> DataFrame:
    """rec, chunk, slot, cluster of the vectors (rec, chunk, slot, embedding). A recording with fewer than two active vectors has cluster 0 alone."""
    vecs = vecs.withColumn("i", (F.col("chunk") * 3 + F.col("slot")).cast("int"))
    active = vecs.join(active_pairs(seg, frames, options.least_active).select("rec", "chunk", "slot"), ["rec", "chunk", "slot"], "left_semi")
    enough = active.groupBy("rec").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("rec")
    train = project(active.join(enough, "rec", "left_semi").select("rec", "i", "embedding"), weights)
    # Centroids leave the tasks that refine: a row for each vector, cluster and dimension would be many times the input.
    centroids = posterior_centroids(train, weights.phi.tolist(), options.threshold, options.fa, options.fb, options.rounds)
    soft = S.centroid_scores(vecs.select("rec", "chunk", "slot", "embedding"), centroids, ("chunk", "slot"))
    few = vecs.join(enough, "rec", "left_anti").select("rec", F.col("chunk").cast("int"), F.col("slot").cast("int"), F.lit(0).alias("cluster"))
    return assign_slots(mask_inactive(soft, seg)).unionByName(few)


def reconstruct(seg: DataFrame, hard: DataFrame, counts: DataFrame, chunk_step: float, frame_step: float, frame_duration: float, smoothing: float | None = None) -> DataFrame:
    """rec, t, cluster: the clusters that speak in each frame."""
    activation = O.overlap_sum(O.clustered(seg, hard), 0.0, chunk_step, 0.0, frame_duration, frame_step)
    return O.smoothed_top(activation, counts, smoothing) if smoothing is not None else O.top_clusters(activation, counts)


def validated(seg: DataFrame, hard: DataFrame, counts: DataFrame, sizes: DataFrame, frames: int, slots: int = SLOTS, most_frames: int = MOST_FRAMES) -> DataFrame:
    """sizes (rec, frames), with an error for the first recording whose tables don't fit each other.

    SlotOutOfRange and FrameOutOfRange for cells of seg outside a chunk, TrailingSlotNotUnmatched for a slot behind the last
    that has a cluster, CountLenMismatch if counts don't have each frame once, ZeroNumOutputFrames and OutputTooLarge for
    the number of frames. A recording without chunks is one without speakers.
    """
    cells = seg.groupBy("rec").agg(F.max("slot").alias("_slot"), F.min("slot").alias("_low"), F.max("at").alias("_at"), F.min("at").alias("_first"))
    trailing = hard.filter((F.col("slot") >= slots) & (F.col("cluster") != UNMATCHED)).groupBy("rec").agg(F.count(F.lit(1)).alias("_trailing"))
    lengths = counts.groupBy("rec").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("t").alias("_t"), F.max("t").alias("_last"))
    all_ = sizes.join(cells, "rec", "left").join(trailing, "rec", "left").join(lengths, "rec", "left")
    n, got = F.col("frames"), lambda c: F.coalesce(c, F.lit(0))
    faults = (
        (n < 1, "ZeroNumOutputFrames"), (n > most_frames, "OutputTooLarge"), ((F.col("_slot") >= slots) | (F.col("_low") < 0), "SlotOutOfRange"), ((F.col("_at") >= frames) | (F.col("_first") < 0), "FrameOutOfRange"),
        (got("_trailing") > 0, "TrailingSlotNotUnmatched"), ((got("_n") != n) | (got("_t") != n) | (got("_last") != n - 1), "CountLenMismatch"),
    )
    return all_.select("rec", O.checked(n, *((F.coalesce(bad, F.lit(False)), code) for bad, code in faults)).cast("long").alias("frames"))


def diarize(seg: DataFrame, vecs: DataFrame, sizes: DataFrame, frames: int, chunk_step: float, frame_step: float, frame_duration: float, weights: Projection, options: DiarizeOptions = DiarizeOptions()) -> DataFrame:
    """rec, cluster, start, end. seg is written once, as four steps read it."""
    seg = Rounds(seg.sparkSession, "diarize").write(seg.select("rec", "chunk", "at", "slot", "activity").repartition("rec"))
    hard = assign_embeddings(vecs, seg, frames, weights, options)
    counts = O.fill_grid(O.active_count(seg, options.onset, chunk_step, frame_step), sizes)
    grid = reconstruct(seg, hard, counts, chunk_step, frame_step, frame_duration, options.smoothing)
    return O.grid_to_spans(grid, sizes, 0.0, frame_duration, frame_step, options.min_duration_off)
