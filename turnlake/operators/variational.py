"""Variational Bayes refinement of a clustering (a Bayesian HMM without its chain), one recording a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .clustering import EngineError, ahc
from .similarity import ALIVE, UNSURE

SMOOTHING, MOST_ROUNDS = 7.0, 1000


def soft_labels(labels: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """One-hot labels through a softmax of so many units."""
    k = int(labels.max()) + 1
    hot = np.exp(smoothing)
    out = np.full((len(labels), k), 1 / (hot + k - 1))
    out[np.arange(len(labels)), labels] = hot / (hot + k - 1)
    return out


def refine(x: np.ndarray, phi: np.ndarray, gamma: np.ndarray, fa: float = 0.07, fb: float = 0.8, rounds: int = 20, least_gain: float = 1e-4) -> tuple[np.ndarray, np.ndarray, list[float], str]:
    """gamma, pi, the bound after each round, and why it ended (converged or max_iters). A falling bound is an error."""
    if not 0 < rounds <= MOST_ROUNDS:
        raise EngineError("MaxItersOutOfRange", str(rounds))
    if not (np.isfinite(x).all() and np.isfinite(phi).all() and (phi > 0).all()):
        raise EngineError("NonFinite")
    if np.abs(gamma.sum(axis=1) - 1).max() > 1e-9:
        raise EngineError("InitNotNormalised")
    d, pi, bounds = x.shape[1], np.full(gamma.shape[1], 1 / gamma.shape[1]), []
    own = -0.5 * ((x**2).sum(axis=1) + d * np.log(2 * np.pi))
    rho, ratio = x * np.sqrt(phi), fa / fb
    for _ in range(rounds):
        variance = 1 / (1 + ratio * gamma.sum(axis=0)[:, None] * phi)
        mean = ratio * variance * (gamma.T @ rho)
        log_p = fa * (rho @ mean.T - 0.5 * (variance + mean**2) @ phi + own[:, None]) + np.log(pi + 1e-8)
        top = log_p.max(axis=1, keepdims=True)
        total = (top + np.log(np.exp(log_p - top).sum(axis=1, keepdims=True))).ravel()
        gamma = np.exp(log_p - total[:, None])
        pi = gamma.sum(axis=0) / gamma.sum()
        bounds.append(float(total.sum() + fb * 0.5 * (np.log(variance) - variance - mean**2 + 1).sum()))
        if len(bounds) > 1:
            gain = bounds[-1] - bounds[-2]
            if gain < -(1e-9 + 1e-9 * max(abs(bounds[-1]), abs(bounds[-2]))):
                raise EngineError("BoundFell", str(gain))
            if gain < least_gain:
                return gamma, pi, bounds, "converged"
    return gamma, pi, bounds, "max_iters"


def posteriors(vecs: DataFrame, phi: list[float], threshold: float = 0.6, fa: float = 0.07, fb: float = 0.8, rounds: int = 20) -> DataFrame:
    """rec, i, cluster, gamma, pi, bound, stop of the vectors (rec, i, embedding, x): a tree cut of embedding, refined on x."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        _, gamma, pi, bound, stop = _refined(pdf, phi, threshold, fa, fb, rounds)
        t, s = gamma.shape
        return pd.DataFrame({"rec": pdf["rec"].iloc[0], "i": np.repeat(pdf["i"].to_numpy(), s), "cluster": np.tile(np.arange(s), t), "gamma": gamma.ravel(), "pi": np.tile(pi, t), "bound": bound, "stop": stop})

    return vecs.select("rec", "i", "embedding", "x").groupBy("rec").applyInPandas(one, "rec long, i int, cluster int, gamma double, pi double, bound double, stop string")


def posterior_centroids(vecs: DataFrame, phi: list[float], threshold: float = 0.6, fa: float = 0.07, fb: float = 0.8, rounds: int = 20) -> DataFrame:
    """rec, cluster, centroid: what similarity.weighted_centroids gives of the posteriors of vecs, without a row for each vector and cluster."""
    low, high = UNSURE

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        raw, gamma, pi, _, _ = _refined(pdf, phi, threshold, fa, fb, rounds)
        if ((pi > low) & (pi < high)).any():
            raise EngineError("AmbiguousAlive")
        live = np.flatnonzero(pi > ALIVE)
        centroids = (gamma[:, live].T @ raw) / gamma[:, live].sum(axis=0)[:, None]
        return pd.DataFrame({"rec": pdf["rec"].iloc[0], "cluster": live, "centroid": list(centroids)})

    return vecs.select("rec", "i", "embedding", "x").groupBy("rec").applyInPandas(one, "rec long, cluster int, centroid array<double>")


def _refined(pdf: pd.DataFrame, phi: list[float], threshold: float, fa: float, fb: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, str]:
    """The raw vectors of a recording, gamma, pi, the last bound and why it ended."""
    raw = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    if len(pdf) < 2:
        return raw, np.ones((1, 1)), np.ones(1), 0.0, "single"
    gamma, pi, bounds, stop = refine(np.stack(pdf["x"].to_numpy()).astype(np.float64), np.asarray(phi, np.float64), soft_labels(ahc(raw, threshold)), fa, fb, rounds)
    return raw, gamma, pi, bounds[-1], stop
