"""Conversions between samples, frames and seconds, and probabilities of speaker sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the frame grids.
SAMPLE_RATE = 16000
WINDOW_SAMPLES, WINDOW_FRAMES = 160000, 589
FRAME_STEP_S, FRAME_DURATION_S = 0.016875, 0.0619375
#: The speakers of each of the 7 classes: none, one of three, and each pair.
CLASS_SPEAKERS = ((), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2))


def frame_to_sample(frame: Column) -> Column:
    """The sample at a frame, rounded. As long: of an int, frame 13,422 would overflow."""
    return F.floor((frame.cast("long") * WINDOW_SAMPLES + WINDOW_FRAMES // 2) / WINDOW_FRAMES)


def sample_to_frame(sample: Column) -> Column:
    return F.floor(sample.cast("long") * WINDOW_FRAMES / WINDOW_SAMPLES)


def total_frames(samples: Column) -> Column:
    return F.ceil(samples.cast("long") * WINDOW_FRAMES / WINDOW_SAMPLES)


def output_frames(chunks: Column, chunk_duration: float, chunk_step: float, frame_step: float) -> Column:
    """Frames of a grid that covers so many chunks; halves round to even."""
    return (F.rint((F.lit(chunk_duration) + (chunks - 1) * chunk_step) / frame_step) + 1).cast("int")


def closest_frame(second: Column, start: float, duration: float, step: float) -> Column:
    return F.rint((second - start - duration / 2) / step).cast("int")


def speaker_marginals(p: Column) -> list[Column]:
    """The probability that each of three speakers is active, from those of the 7 classes."""
    return [sum((p[c] for c, who in enumerate(CLASS_SPEAKERS) if s in who), F.lit(0.0)) for s in range(3)]


def speaker_hard(p: Column) -> list[Column]:
    """1 for each speaker of the likeliest class, the first of equals."""
    best = F.array_position(p, F.array_max(p)) - 1
    return [F.when(best.isin(*[c for c, who in enumerate(CLASS_SPEAKERS) if s in who]), 1.0).otherwise(0.0) for s in range(3)]


def voice_probability(p: Column) -> Column:
    return 1 - p[0]
