"""Streams: voice spans and online speaker matching with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.clustering import Speakers

SPAN = T.StructType([T.StructField("rec", T.LongType()), T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())])
MATCH = T.StructType([T.StructField("rec", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("decision", T.StringType()), T.StructField("speaker", T.LongType())])


class VoiceSpans(StatefulProcessor):
    """Closed spans of each stream's frames (rec, frame, p, last): hysteresis, gap merging and the least length carry over batches.

    Frames of a stream must arrive in order over batches; within one they are sorted. A frame marked `last` closes what is
    open; frames at or before the last one seen are late and are passed over.
    """

    def __init__(self, onset: float, offset: float, gap: int = 0, least: int = 1):
        self.onset, self.offset, self.gap, self.least = onset, offset, gap, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("voice", "seen long, on boolean, first long, held_first long, held_stop long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, on, first, held_first, held_stop = self.state.get() if self.state.exists() else (-1, False, -1, -1, -1)
        out: list[tuple[int, int]] = []

        def close(start: int, stop: int) -> None:
            nonlocal held_first, held_stop
            if held_first >= 0 and start - held_stop <= self.gap:
                held_stop = stop
                return
            flush()
            held_first, held_stop = start, stop

        def flush() -> None:
            nonlocal held_first, held_stop
            if held_first >= 0 and held_stop - held_first >= self.least:
                out.append((held_first, held_stop))
            held_first = held_stop = -1

        ended = False
        for frame, p, last in pd.concat(list(rows)).sort_values("frame")[["frame", "p", "last"]].itertuples(index=False):
            if frame <= seen:
                continue
            if on and p < self.offset:
                close(first, frame)
                on = False
            elif not on and p >= self.onset:
                on, first = True, frame
            seen = frame
            if not on and held_first >= 0 and frame + 1 - held_stop > self.gap:
                flush()
            if last:
                if on:
                    close(first, frame + 1)
                flush()
                ended = True
        if ended:
            self.state.clear()
        else:
            self.state.update((int(seen), bool(on), int(first), int(held_first), int(held_stop)))
        yield pd.DataFrame({"rec": [key[0]] * len(out), "first": [int(x[0]) for x in out], "stop": [int(x[1]) for x in out]}).astype("int64")

    def close(self) -> None:
        pass


class OnlineSpeakers(StatefulProcessor):
    """Matches each session's vectors (rec, vec_id, embedding, duration) to its speakers so far, which are the state.

    A row whose column `reset` is true (the column may be missing) forgets the session's speakers before its vector is
    matched; without a vector it only resets.
    """

    def __init__(self, **options):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.speakers = handle.getMapState("speakers", "id long", "centroid array<double>, history array<array<double>>, duration double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np

        s = Speakers(**self.options)
        known = sorted((k[0], v) for k, v in self.speakers.iterator()) if self.speakers.exists() else []
        for _, (centroid, history, duration) in known:
            s.centroids.append(np.asarray(centroid))
            s.history.append([np.asarray(h) for h in history])
            s.durations.append(duration)
        pdf = pd.concat(list(rows)).sort_values("vec_id")
        anew = pdf["reset"].fillna(False).astype(bool) if "reset" in pdf else pd.Series(False, index=pdf.index)
        got, before = [], s.count
        for vec_id, v, d, forget in zip(pdf["vec_id"], pdf["embedding"], pdf["duration"], anew, strict=True):
            if forget:
                s.reset()
                before = 0
                self.speakers.clear()
            if v is not None:
                got.append((vec_id, *s.assign(v, d)))
        # After a reset all speakers are new ones.
        for k in {g[2] for g in got if g[2] and g[2] <= s.count} | set(range(before + 1, s.count + 1)):
            self.speakers.updateValue((k,), (s.centroids[k - 1].tolist(), [h.tolist() for h in s.history[k - 1]], float(s.durations[k - 1])))
        yield pd.DataFrame({"rec": [key[0]] * len(got), "vec_id": [g[0] for g in got], "decision": [g[1] for g in got], "speaker": pd.array([g[2] for g in got], "Int64")})

    def close(self) -> None:
        pass


def stream_spans(frames: DataFrame, onset: float, offset: float, gap: int = 0, least: int = 1) -> DataFrame:
    return frames.groupBy("rec").transformWithStateInPandas(VoiceSpans(onset, offset, gap, least), SPAN, "Append", "None")


def stream_speakers(vecs: DataFrame, **options) -> DataFrame:
    return vecs.groupBy("rec").transformWithStateInPandas(OnlineSpeakers(**options), MATCH, "Append", "None")


def stream_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """rec, speaker, centroid, duration and n_history of the speakers that a stream of stream_speakers knows, from its checkpoint.

    It reads the state of the last batch that ended; the stream may run or not. Sessions without a speaker have no row.
    """
    state = spark.read.format("statestore").option("stateVarName", "speakers").load(checkpoint)
    v = F.col("user_map_value")
    return state.select(F.col("key.rec").alias("rec"), F.col("user_map_key.id").alias("speaker"), v["centroid"].alias("centroid"), v["duration"].alias("duration"), F.size(v["history"]).alias("n_history"))


def speaker_counts(state: DataFrame) -> DataFrame:
    """rec, n_speakers, speakers (their numbers in order), duration of all, from stream_state."""
    return state.groupBy("rec").agg(F.count(F.lit(1)).alias("n_speakers"), F.sort_array(F.collect_list("speaker")).alias("speakers"), F.sum("duration").alias("duration"))
