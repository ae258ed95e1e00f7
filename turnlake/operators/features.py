"""Features: log-mel filter banks of sound, and projections of voice embeddings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .clustering import EngineError

#: Fixed values of the feature format.
MELS, WINDOW, SHIFT, PADDED, LOW_HZ, EMPHASIS, SCALE, FLOOR, RATE, CLIP_FRAMES = 80, 400, 160, 512, 20.0, 0.97, 32768.0, 2.0**-23, 16000, 200


@lru_cache(maxsize=1)
def mel_bank() -> np.ndarray:
    """Triangles over the FFT bins, evenly spread on the mel scale from LOW_HZ to half the rate; the last bin has none."""
    mel = lambda f: 1127.0 * np.log(1 + np.asarray(f) / 700.0)
    edges = np.linspace(mel(LOW_HZ), mel(RATE / 2), MELS + 2)
    at = mel(np.arange(PADDED // 2) * RATE / PADDED)
    up = (at[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - at[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.pad(np.maximum(0, np.minimum(up, down)), ((0, 0), (0, 1)))


def log_mel(samples: np.ndarray) -> np.ndarray:
    """(frames, 80): each whole window's log energies, not yet centred."""
    x = np.asarray(samples, np.float32)
    if len(x) < WINDOW:
        raise EngineError("ClipTooShort", f"{len(x)} samples")
    if not np.isfinite(x).all():
        raise EngineError("NonFinite")
    frames = np.lib.stride_tricks.sliding_window_view(x * np.float32(SCALE), WINDOW)[::SHIFT].astype(np.float64)
    frames = frames - frames.mean(axis=1, keepdims=True)
    frames = np.concatenate([frames[:, :1] * (1 - EMPHASIS), frames[:, 1:] - EMPHASIS * frames[:, :-1]], axis=1) * np.hamming(WINDOW)
    power = np.abs(np.fft.rfft(frames, PADDED)) ** 2
    return np.log(np.maximum(power @ mel_bank().T, FLOOR))


def full_bank(samples: np.ndarray) -> np.ndarray:
    out = log_mel(samples)
    return (out - out.mean(axis=0)).astype(np.float32)


def clip_bank(samples: np.ndarray) -> np.ndarray:
    """Exactly 200 frames: the middle of a longer clip; a shorter one is padded on both sides before the mean is taken off."""
    n = 1 + (len(samples) - WINDOW) // SHIFT
    if n > CLIP_FRAMES:
        first = (n - CLIP_FRAMES) // 2
        samples, n = samples[first * SHIFT : first * SHIFT + WINDOW + (CLIP_FRAMES - 1) * SHIFT], CLIP_FRAMES
    before = (CLIP_FRAMES - n) // 2
    out = np.pad(log_mel(samples), ((before, CLIP_FRAMES - n - before), (0, 0)))
    return (out - out.mean(axis=0)).astype(np.float32)


def filter_banks(clips: DataFrame, whole: bool = True) -> DataFrame:
    """clip_id, frame, mels (array<float>) of (clip_id, samples)."""
    make = full_bank if whole else clip_bank

    def run(batches):
        for batch in batches:
            for clip, samples in zip(batch.column("clip_id").to_pylist(), batch.column("samples"), strict=True):
                bank = make(np.asarray(samples.values, np.float32))
                mels = pa.ListArray.from_arrays(pa.array(np.arange(0, bank.size + 1, MELS, dtype=np.int32)), pa.array(bank.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([clip] * len(bank), pa.int64()), pa.array(np.arange(len(bank), dtype=np.int32)), mels], names=["clip_id", "frame", "mels"])

    return clips.select("clip_id", "samples").mapInArrow(run, "clip_id long, frame int, mels array<float>")


@dataclass(frozen=True)
class Projection:
    """Trained weights of the projection; they are an input. orthonormal() makes stand-ins of any size."""

    mean1: np.ndarray
    mean2: np.ndarray
    lda: np.ndarray
    mu: np.ndarray
    basis: np.ndarray
    phi: np.ndarray

    @staticmethod
    def orthonormal(dim: int, out: int, seed: int = 0) -> Projection:
        rng = np.random.default_rng(seed)
        lda = np.linalg.qr(rng.normal(size=(dim, out)))[0]
        return Projection(np.zeros(dim), np.zeros(out), lda, np.zeros(out), np.linalg.qr(rng.normal(size=(out, out)))[0], np.sort(rng.uniform(0.5, 5, out))[::-1].copy())

    @staticmethod
    def cosines(dim: int, out: int) -> Projection:
        """Stand-ins made by a rule: orthonormal cosine waves, small means, and variances that fall in equal steps."""
        wave = lambda n, k: np.sqrt(2 / n) * np.cos(np.pi * (np.arange(n)[:, None] + 0.5) * np.asarray(k)[None] / n)
        basis = wave(out, np.arange(out))
        basis[:, 0] /= np.sqrt(2)
        return Projection(np.cos(np.arange(dim)) / 100, np.sin(np.arange(out)) / 100, wave(dim, np.arange(1, out + 1)), np.cos(np.arange(out)) / 10, basis, 5 - 4.5 * np.arange(out) / out)

    @staticmethod
    def derive(tr: np.ndarray, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions and variances (descending) that make both covariances diagonal: within is whitened, then between is rotated."""
        within = np.linalg.inv(tr.T @ tr)
        between = np.linalg.inv((tr.T / psi) @ tr)
        low = np.linalg.inv(np.linalg.cholesky(within))
        values, vectors = np.linalg.eigh(low @ between @ low.T)
        return (low.T @ vectors)[:, ::-1], values[::-1]

    def faults(self, x: np.ndarray, least: float = 0.01, least_centred: float = 0.1) -> np.ndarray:
        """For each row why it can't be projected: NonFinite, DegenerateInput (too short, as it is or centred), or ''."""
        finite = np.isfinite(x).all(axis=1)
        known = np.where(finite[:, None], x, 0.0)
        short = (np.linalg.norm(known, axis=1) < least) | (np.linalg.norm(known - self.mean1, axis=1) < least_centred)
        return np.where(~finite, "NonFinite", np.where(short, "DegenerateInput", ""))

    def apply(self, x: np.ndarray) -> np.ndarray:
        bad = self.faults(x)
        if (bad != "").any():
            raise EngineError(str(bad[bad != ""][0]))
        centred = x - self.mean1
        y = np.sqrt(x.shape[1]) * (centred / np.linalg.norm(centred, axis=1, keepdims=True)) @ self.lda - self.mean2
        y = np.sqrt(y.shape[1]) * y / np.linalg.norm(y, axis=1, keepdims=True)
        return (y - self.mu) @ self.basis


def project(vecs: DataFrame, weights: Projection, quarantine: bool = False) -> DataFrame:
    """vecs plus x: the whitened projection of embedding. The weights go to the tasks with the function; they have a fixed size.

    A vector that can't be projected fails the job with its fault. With quarantine it stays, with a null x and its fault in
    a column `fault`, which is null for the others; a null vector and one of a wrong length have the fault WrongLength.
    """
    from pyspark.sql import types as T

    vecs = vecs.drop("x", *(["fault"] if quarantine else []))
    dim = len(weights.mean1)

    def run(batches):
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            fault = np.where(lengths == dim, "", "WrongLength").astype(object)
            if not quarantine and (fault != "").any():
                raise EngineError("WrongLength")
            right = np.flatnonzero(fault == "")
            e = batch.column("embedding").take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            if quarantine:
                fault[right] = weights.faults(e)
                e, right = e[fault[right] == ""], right[fault[right] == ""]
            x = weights.apply(e)
            at = np.full(batch.num_rows, -1)
            at[right] = np.arange(len(right))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            columns = [*batch.columns, lists.take(pa.array(at, mask=at < 0))]
            more = [pa.array([f or None for f in fault], pa.string())] if quarantine else []
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*batch.schema.names, "x", *(["fault"] if quarantine else [])])

    fields = [*vecs.schema.fields, T.StructField("x", T.ArrayType(T.DoubleType())), *([T.StructField("fault", T.StringType())] if quarantine else [])]
    return vecs.mapInArrow(run, T.StructType(fields))
