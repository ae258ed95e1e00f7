"""A streaming segmenter: sound goes in, windows that need scores come out; scores come back in any order, spans come out.

A stream's rows tell what happens (`kind`): samples arrive, a window is answered, the stream ends, or it starts anew. The
state of a stream is the sound that a later window can still need, the windows that wait for an answer, sums and counts of
voice beyond the finalisation boundary, and the open span; none of it grows with the length of the stream, but with the
windows that wait. It is kept in Spark's state store, so a stream goes on where its checkpoint ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.frames import CLASS_SPEAKERS, SAMPLE_RATE, WINDOW_FRAMES, WINDOW_SAMPLES

#: What a stream's rows hold: seq orders them, start and generation name the window that logits answer.
EVENTS = "rec long, seq long, kind string, samples array<float>, generation long, start long, logits array<array<double>>"
#: window: samples to be scored. scores: speaker probabilities a frame. activity: a slot's span in a window. voice: a span
#: of the stream. error: what was refused, and why. counters: open windows and buffered samples after a batch.
ACTIONS = (
    "rec long, generation long, seq long, kind string, start long, slot int, first long, stop long, samples array<float>, scores array<array<double>>, "
    "code string, pending long, buffered long"
)


@dataclass(frozen=True)
class SegmentOptions:
    """Sizes in samples and frames, thresholds, and durations in seconds; refused if out of range."""

    step: int = 40_000
    onset: float = 0.5
    offset: float = 0.357
    least_activity: float = 0.0
    least_voice: float = 0.0
    merge_gap: float = 0.0
    window: int = WINDOW_SAMPLES
    frames: int = WINDOW_FRAMES
    rate: int = SAMPLE_RATE

    def __post_init__(self) -> None:
        if not 1 <= self.step <= self.window:
            raise ValueError("StepOutOfRange")
        if not (0 <= self.onset <= 1 and 0 <= self.offset <= 1):
            raise ValueError("ThresholdOutOfRange")
        if self.offset > self.onset:
            raise ValueError("OffsetAboveOnset")
        for name in ("least_activity", "least_voice", "merge_gap"):
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) >= 0):
                raise ValueError(f"DurationOutOfRange: {name}")

    def samples(self, seconds: float) -> int:
        return int(seconds * self.rate)

    def frame_of(self, sample: int) -> int:
        return sample * self.frames // self.window

    def sample_of(self, frame: int) -> int:
        return (frame * self.window + self.frames // 2) // self.frames

    def frames_of(self, samples: int) -> int:
        return -(-samples * self.frames // self.window)


class Segment:
    """What a stream is between two batches; plain values and arrays, so that it goes into state as one row."""

    def __init__(self, options: SegmentOptions, generation: int = 0):
        self.options, self.generation = options, generation
        self.buffer, self.buffered_from = np.empty(0, np.float32), 0
        self.pushed, self.next_window, self.finished = 0, 0, False
        self.open: set[int] = set()
        #: Sums and counts of voice from frame `base` on.
        self.base, self.sums, self.counts = 0, np.empty(0), np.empty(0, np.int64)
        self.run_from: int | None = None
        self.held: tuple[int, int] | None = None

    # Sound and windows.

    def push(self, samples: np.ndarray) -> Iterator[dict]:
        if self.finished:
            yield {"kind": "error", "code": "SamplesAfterFinish"}
            return
        self.buffer = np.concatenate([self.buffer, samples.astype(np.float32)])
        self.pushed += len(samples)
        while self.next_window * self.options.step + self.options.window <= self.pushed:
            yield self._window(self.next_window * self.options.step)
            self.next_window += 1
        # A later window starts at the next step; the one that ends the stream starts a whole window before its end.
        keep = min(self.next_window * self.options.step, max(0, self.pushed - self.options.window))
        if keep > self.buffered_from:
            self.buffer, self.buffered_from = self.buffer[keep - self.buffered_from :], keep

    def _window(self, start: int) -> dict:
        have = self.buffer[start - self.buffered_from :][: self.options.window]
        self.open.add(start)
        return {"kind": "window", "start": start, "samples": np.pad(have, (0, self.options.window - len(have)))}

    def finish(self) -> Iterator[dict]:
        """The window that ends with the stream, if no other does; then what nothing is awaited for. A second call does nothing."""
        if not self.finished:
            self.finished = True
            tail = max(0, self.pushed - self.options.window)
            last = (self.next_window - 1) * self.options.step if self.next_window else -1
            if self.pushed and tail != last:
                yield self._window(tail)
            yield from self._settle()

    # Answers.

    def answer(self, generation: int, start: int, logits) -> Iterator[dict]:
        """Scores of one window. A wrong shape, a window that isn't open (anew, twice, of another generation) and values that aren't finite are refused; the last leave the window open."""
        o, refused = self.options, {"kind": "error", "start": start}
        if logits is None or len(logits) != o.frames or any(x is None or len(x) != len(CLASS_SPEAKERS) for x in logits):
            yield refused | {"code": "LogitShape"}
            return
        if generation != self.generation or start not in self.open:
            yield refused | {"code": "UnknownWindow", "generation": generation}
            return
        x = np.array([[math.nan if v is None else v for v in row] for row in logits], np.float64)
        if not np.isfinite(x).all():
            yield refused | {"code": "NonFiniteLogits"}
            return
        self.open.remove(start)
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slots = np.stack([p[:, [c for c, who in enumerate(CLASS_SPEAKERS) if s in who]].sum(axis=1) for s in range(3)], axis=1)
        yield {"kind": "scores", "start": start, "scores": slots}
        end = self.pushed if self.finished else math.inf
        for s in range(3):
            for f, g in self._runs(slots[:, s]):
                first, stop = (int(min(start + o.sample_of(y), end)) for y in (f, g))
                if stop > first and stop - first >= o.samples(o.least_activity):
                    yield {"kind": "activity", "start": start, "slot": s, "first": first, "stop": stop}
        self._add(o.frame_of(start), 1 - p[:, 0])
        yield from self._settle()

    def _runs(self, p: np.ndarray) -> list[tuple[int, int]]:
        out, at = [], None
        for f, v in enumerate(p.tolist()):
            if at is None and v >= self.options.onset:
                at = f
            elif at is not None and v < self.options.offset:
                out.append((at, f))
                at = None
        return out + ([(at, len(p))] if at is not None else [])

    def _add(self, frame: int, voice: np.ndarray) -> None:
        more = frame + len(voice) - self.base - len(self.sums)
        if more > 0:
            self.sums, self.counts = np.pad(self.sums, (0, more)), np.pad(self.counts, (0, more))
        at = frame - self.base
        self.sums[at : at + len(voice)] += voice
        self.counts[at : at + len(voice)] += 1

    # Finalised frames.

    @property
    def boundary(self) -> int:
        """The first frame to which a window can still contribute: one that waits, the next one, or the one that ends the stream."""
        o = self.options
        if self.finished:
            return min((o.frame_of(s) for s in self.open), default=o.frames_of(self.pushed))
        return o.frame_of(min([*self.open, self.next_window * o.step, max(0, self.pushed - o.window)]))

    def _settle(self) -> Iterator[dict]:
        n = max(0, self.boundary - self.base)
        have = min(n, len(self.sums))
        mean = np.zeros(n)
        mean[:have] = np.where(self.counts[:have] > 0, self.sums[:have] / np.maximum(self.counts[:have], 1), 0.0)
        for frame, p in enumerate(mean.tolist(), self.base):
            if self.run_from is None and p >= self.options.onset:
                self.run_from = frame
            elif self.run_from is not None and p < self.options.offset:
                yield from self._span(self.options.sample_of(self.run_from), self.options.sample_of(frame))
                self.run_from = None
        self.base, self.sums, self.counts = self.base + n, self.sums[have:], self.counts[have:]
        if self.finished and not self.open:
            if self.run_from is not None:
                yield from self._span(min(self.options.sample_of(self.run_from), self.pushed), self.pushed)
                self.run_from = None
            yield from self._flush()

    def _span(self, first: int, stop: int) -> Iterator[dict]:
        if self.finished and not self.open:
            first, stop = min(first, self.pushed), min(stop, self.pushed)
        if self.held and first - self.held[1] <= self.options.samples(self.options.merge_gap):
            self.held = self.held[0], max(stop, self.held[1])
            return
        yield from self._flush()
        self.held = first, stop

    def _flush(self) -> Iterator[dict]:
        if self.held and self.held[1] > self.held[0] and self.held[1] - self.held[0] >= self.options.samples(self.options.least_voice):
            yield {"kind": "voice", "first": self.held[0], "stop": self.held[1]}
        self.held = None

    def events(self, kind: str, samples, generation, start, logits) -> Iterator[dict]:
        if kind == "samples":
            yield from self.push(np.asarray(samples if samples is not None else [], np.float32))
        elif kind == "scores":
            yield from self.answer(generation, start, logits)
        elif kind == "finish":
            yield from self.finish()
        elif kind == "clear":
            self.__init__(self.options, self.generation + 1)
        else:
            yield {"kind": "error", "code": "UnknownKind"}


#: How a Segment lies in the state store: the stream's numbers in a value, sound in a list of pieces, open windows in a map.
_NUMBERS = "generation long, buffered_from long, pushed long, next_window long, finished boolean, run_from long, held_first long, held_stop long, base long, sums array<double>, counts array<long>"
#: Samples in one piece of the sound.
PIECE = 16_000


class Segmenter(StatefulProcessor):
    """Runs a Segment for each stream; rows of a batch go by seq, of equals in the order in which they come."""

    def __init__(self, options: SegmentOptions):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getValueState("stream", _NUMBERS)
        self.sound = handle.getListState("sound", "samples array<float>")
        self.windows = handle.getMapState("windows", "start long", "generation long")

    def _read(self) -> Segment:
        s = Segment(self.options)
        if self.numbers.exists():
            s.generation, s.buffered_from, s.pushed, s.next_window, s.finished, run, first, stop, s.base, sums, counts = self.numbers.get()
            s.run_from, s.held = (None if run < 0 else run), (None if first < 0 else (first, stop))
            s.sums, s.counts = np.array(sums, np.float64), np.array(counts, np.int64)
            s.buffer = np.concatenate([np.empty(0, np.float32), *(np.array(piece[0], np.float32) for piece in self.sound.get())]) if self.sound.exists() else s.buffer
            s.open = {k[0] for k in self.windows.keys()} if self.windows.exists() else set()
        return s

    def _write(self, s: Segment, before: set[int], generation: int) -> None:
        first, stop = s.held or (-1, -1)
        self.numbers.update((s.generation, s.buffered_from, s.pushed, s.next_window, s.finished, -1 if s.run_from is None else s.run_from, first, stop, s.base, s.sums.tolist(), s.counts.tolist()))
        if len(s.buffer):
            self.sound.put([(s.buffer[at : at + PIECE].tolist(),) for at in range(0, len(s.buffer), PIECE)])
        else:
            self.sound.clear()
        if s.generation != generation:
            self.windows.clear()
            before = set()
        for start in before - s.open:
            self.windows.removeKey((start,))
        for start in s.open - before:
            self.windows.updateValue((start,), (s.generation,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, names = self._read(), [f.split(" ")[0] for f in ACTIONS.split(", ")]
        before, generation = set(s.open), s.generation
        seq = -1
        for seq, kind, samples, of, start, logits in pd.concat(list(rows)).sort_values("seq", kind="stable")[["seq", "kind", "samples", "generation", "start", "logits"]].itertuples(index=False):
            made = [{"rec": key[0], "generation": s.generation, "seq": seq} | x for x in s.events(kind, samples, None if pd.isna(of) else int(of), None if pd.isna(start) else int(start), logits)]
            if made:
                yield _frame(made, names)
        self._write(s, before, generation)
        yield _frame([{"rec": key[0], "generation": s.generation, "seq": seq, "kind": "counters", "pending": len(s.open), "buffered": len(s.buffer)}], names)

    def close(self) -> None:
        pass


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    whole = {"rec": "Int64", "generation": "Int64", "seq": "Int64", "start": "Int64", "slot": "Int32", "first": "Int64", "stop": "Int64", "pending": "Int64", "buffered": "Int64"}
    made = {n: [r.get(n) for r in rows] for n in names}
    made["samples"] = [None if x is None else x.tolist() for x in made["samples"]]
    made["scores"] = [None if x is None else x.tolist() for x in made["scores"]]
    return pd.DataFrame({n: pd.array(v, whole[n]) if n in whole else pd.Series(v, dtype=object) for n, v in made.items()})


def stream_segments(events: DataFrame, options: SegmentOptions | None = None) -> DataFrame:
    """ACTIONS of a stream of EVENTS. Rows of a null kind or one that is not known are errors; empty samples change nothing."""
    return events.groupBy("rec").transformWithStateInPandas(Segmenter(options or SegmentOptions()), ACTIONS, "Append", "None")
