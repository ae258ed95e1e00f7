"""Clusterings of a recording's vectors.

Recordings are grouped and run side by side; one recording is bounded by MOST_VECTORS, beyond which a clustering refuses it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .seeding import Draws

MOST_VECTORS = {"offline": 1000, "ahc": 1_000_000, "spectral": 1_000_000}


class EngineError(ValueError):
    """A refused input; `code` names the reason."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def check_vectors(x: np.ndarray, most: int, target: int | None = None) -> None:
    if not len(x):
        raise EngineError("EmptyInput")
    if len(x) > most:
        raise EngineError("InputTooLarge", f"{len(x)} vectors; the limit is {most}")
    if not np.isfinite(x).all():
        raise EngineError("NonFiniteInput")
    if (np.linalg.norm(x, axis=1) < 1e-12).any():
        raise EngineError("ZeroNormInput")
    if target is not None and not 1 <= target <= len(x):
        raise EngineError("TargetOutOfRange", str(target))


def renumbered(labels) -> np.ndarray:
    """Labels from 0, in the order in which they first occur."""
    seen: dict = {}
    return np.array([seen.setdefault(x, len(seen)) for x in labels], int)


def agglomerate(x: np.ndarray, threshold: float = 0.5, linkage: str = "average", target: int | None = None) -> np.ndarray:
    """Merges the closest two clusters (of equals the lowest pair) until they are 1 - threshold apart, or `target` are left."""
    check_vectors(x, MOST_VECTORS["offline"], target)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - np.maximum(0, unit @ unit.T)
    n = len(x)
    np.fill_diagonal(d, np.inf)
    size, label, live = np.ones(n), np.arange(n), np.ones(n, bool)
    while live.sum() > (target or 1):
        a, b = divmod(int(np.argmin(d)), n)
        if target is None and d[a, b] >= 1 - threshold:
            break
        row = {"single": np.minimum(d[a], d[b]), "complete": np.maximum(d[a], d[b]), "average": (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])}[linkage]
        d[a] = d[:, a] = row
        d[a, a] = np.inf
        d[b] = d[:, b] = np.inf
        size[a] += size[b]
        live[b] = False
        label[label == b] = a
    return renumbered(label)


def centroid_merges(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Steps (a, b, height) of centroid linkage over Euclidean distances; step k makes cluster n + k.

    Clusters are kept as centroids, so the room grows with the vectors and not with their pairs. Each row remembers its
    nearest other row. Where that has gone, the old distance is a lower bound, and the row is looked at again only when no
    other row has less. Rows that have gone are left out when they are half of all.
    """
    n = len(x)
    c, norm = np.array(x, np.float64), (x * x).sum(axis=1).astype(np.float64)
    size, name, out = np.ones(n), np.arange(n), []

    def apart(v: np.ndarray, v_norm: np.ndarray) -> np.ndarray:
        """Squared distances of some centroids to all; where products would lose digits, from the differences."""
        both = v_norm[:, None] + norm[None]
        d2 = both - 2 * (v @ c.T)
        k, m = np.nonzero(d2 < 1e-6 * both)
        for s in range(0, len(k), 1 << 14):
            at = k[s : s + (1 << 14)], m[s : s + (1 << 14)]
            d2[at] = np.where(np.isinf(norm[at[1]]), np.inf, ((v[at[0]] - c[at[1]]) ** 2).sum(axis=1))
        return d2

    def row_of(a: int) -> np.ndarray:
        d2 = apart(c[a : a + 1], norm[a : a + 1])[0]
        d2[a] = np.inf
        return d2

    near, height, stale = np.zeros(n, int), np.full(n, np.inf), np.zeros(n, bool)
    for s in range(0, n, 256):
        d2 = apart(c[s : s + 256], norm[s : s + 256])
        rows = np.arange(len(d2))
        d2[rows, s + rows] = np.inf
        near[s : s + 256], height[s : s + 256] = d2.argmin(axis=1), d2.min(axis=1)
    for k in range(n - 1):
        while stale[a := int(height.argmin())]:
            row = row_of(a)
            near[a] = int(row.argmin())
            height[a], stale[a] = row[near[a]], False
        h2 = height[a]
        a, b = sorted((a, int(near[a])))
        na, nb = size[a], size[b]
        c[a] = (na * c[a] + nb * c[b]) / (na + nb)
        norm[a], norm[b], c[b] = c[a] @ c[a], np.inf, 0.0
        row = row_of(a)
        out.append((min(name[a], name[b]), max(name[a], name[b]), float(np.sqrt(max(0.0, h2)))))
        size[a], name[a] = na + nb, n + k
        height[b], stale[b] = np.inf, False
        closer = row < height
        stale |= ((near == a) | (near == b)) & ~closer & np.isfinite(height)
        near[closer], height[closer], stale[closer] = a, row[closer], False
        near[a] = int(row.argmin())
        height[a], stale[a] = row[near[a]], False
        if len(c) > 64 and 2 * (n - 1 - k) < len(c):
            live = np.flatnonzero(np.isfinite(norm))
            # What a stale row points at may have gone; it is looked at again before it is used.
            place = np.zeros(len(c), int)
            place[live] = np.arange(len(live))
            c, norm, size, name, near, height, stale = c[live], norm[live], size[live], name[live], place[near[live]], height[live], stale[live]
    return out


def ahc(x: np.ndarray, threshold: float = 0.6) -> np.ndarray:
    """Centroid linkage of unit vectors, cut where no merge inside a subtree is higher than threshold; labels in tree order."""
    check_vectors(x, MOST_VECTORS["ahc"])
    if not threshold > 0:
        raise EngineError("InvalidThreshold", str(threshold))
    n = len(x)
    steps = centroid_merges(x / np.linalg.norm(x, axis=1, keepdims=True))
    top = np.zeros(2 * n - 1)
    for k, (a, b, h) in enumerate(steps):
        top[n + k] = max(h, top[a], top[b])
    labels, nxt, stack = np.zeros(n, int), 0, [2 * n - 2]
    while stack:
        node = stack.pop()
        if node >= n and top[node] > threshold:
            stack += [steps[node - n][1], steps[node - n][0]]
            continue
        inside = [node]
        while inside:
            v = inside.pop()
            if v < n:
                labels[v] = nxt
            else:
                inside += steps[v - n][:2]
        nxt += 1
    return labels


def spectral(x: np.ndarray, target: int | None = None, seed: int = 0, most: int = 15, threshold: float = 0.5) -> np.ndarray:
    """Eigenvectors of the normalised Laplacian, K by the widest gap unless given, then k-means; all-dissimilar input is agglomerated."""
    check_vectors(x, MOST_VECTORS["offline"], target)
    return spectral_any(x, target, seed, most, threshold)


def spectral_any(x: np.ndarray, target: int | None = None, seed: int = 0, most: int = 15, threshold: float = 0.5) -> np.ndarray:
    """As spectral, for more vectors too: beyond MOST_VECTORS no matrix of all pairs is held, and a vector without any similar one is refused."""
    check_vectors(x, MOST_VECTORS["spectral"], target)
    n = len(x)
    if n > MOST_VECTORS["offline"]:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        degree = np.concatenate([np.maximum(0, unit[s : s + 512] @ unit.T).sum(axis=1) for s in range(0, n, 512)]) - (unit * unit).sum(axis=1)
        if (degree < 1e-12).any():
            raise EngineError("InputTooLarge", f"{n} vectors, some without a similar one")
        values, vectors = top_vectors(unit, degree, target or most + 1)
        return _spectral_labels(values, vectors, target, seed, most)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    if n == 1:
        return np.zeros(1, int)
    if n == 2:
        together = target == 1 if target else max(0.0, float(unit[0] @ unit[1])) >= threshold
        return np.array([0, 0 if together else 1])
    a = np.maximum(0, unit @ unit.T)
    np.fill_diagonal(a, 0)
    degree = a.sum(axis=1)
    if (degree < 1e-12).any():
        return agglomerate(x, threshold, "average", target)
    values, vectors = np.linalg.eigh(np.eye(n) - a / np.sqrt(degree[:, None] * degree[None]))
    return _spectral_labels(values, vectors, target, seed, most)


def _spectral_labels(values: np.ndarray, vectors: np.ndarray, target: int | None, seed: int, most: int) -> np.ndarray:
    gaps = np.diff(values[: min(len(vectors) - 1, most) + 1])
    k = target or int(len(gaps) - np.argmax(gaps[::-1]))
    u = vectors[:, :k].copy()
    length = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.where(length > 1e-12, u / np.where(length > 1e-12, length, 1), u)
    return kmeans(u, k, seed)


def top_vectors(unit: np.ndarray, degree: np.ndarray, k: int, tolerance: float = 1e-9, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """The k least eigenvalues of the normalised Laplacian and their vectors, by a block method that never holds its matrix.

    The affinities are made anew, strip by strip, for each block of vectors that is multiplied. Of a basis that has grown
    the best part is kept. Fails with NotConverged if the residuals are not below tolerance after so many steps.
    """
    n, width, root = len(unit), k + 4, np.sqrt(degree)

    def times(v: np.ndarray) -> np.ndarray:
        out, scaled = np.empty_like(v), v / root[:, None]
        for s in range(0, n, 512):
            w = np.maximum(0, unit[s : s + 512] @ unit.T)
            w[np.arange(len(w)), s + np.arange(len(w))] = 0
            out[s : s + 512] = w @ scaled
        return out / root[:, None]

    start = np.random.default_rng(0).standard_normal((n, width))
    start[:, 0] = root
    basis = np.linalg.qr(start)[0]
    image = times(basis)
    for _ in range(steps):
        h = basis.T @ image
        values, mix = np.linalg.eigh((h + h.T) / 2)
        values, mix = values[::-1], mix[:, ::-1]
        found, over = basis @ mix[:, :width], image @ mix[:, :width]
        rest = over - found * values[:width]
        if np.linalg.norm(rest[:, :k], axis=0).max() < tolerance:
            return 1 - values[:k], found[:, :k]
        if basis.shape[1] + width > max(40 * width, 240):
            keep = mix[:, : 4 * width]
            basis, image = basis @ keep, image @ keep
        for _ in range(2):
            rest = np.linalg.qr(rest - basis @ (basis.T @ rest))[0]
        basis, image = np.hstack([basis, rest]), np.hstack([image, times(rest)])
    raise EngineError("NotConverged", f"{steps} steps")


def kmeans(u: np.ndarray, k: int, seed: int = 0, rounds: int = 100) -> np.ndarray:
    """Lloyd's steps from k-means++ seeds of the specified key stream (see seeding); of equally near centroids the lowest."""
    draws = Draws(seed)
    chosen, far = [draws.below(len(u))], np.full(len(u), np.inf)
    while len(chosen) < k:
        far = np.minimum(far, ((u - u[chosen[-1]]) ** 2).sum(axis=1))
        total = np.cumsum(far)
        if total[-1] > 0:
            chosen.append(min(int(np.searchsorted(total, draws.unit() * total[-1], side="right")), len(u) - 1))
        else:
            free = [j for j in range(len(u)) if j not in chosen]
            chosen.append(free[draws.below(len(free))])
    centers, labels = u[chosen].copy(), None
    for _ in range(rounds):
        new = ((u[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        for c in range(k):
            if (labels == c).any():
                centers[c] = u[labels == c].mean(axis=0)
    return renumbered(labels)


METHODS = {"agglomerative": agglomerate, "spectral": spectral}


def offline(x: np.ndarray, method: str = "spectral", threshold: float = 0.5, target: int | None = None, **options) -> np.ndarray:
    """Labels of a recording's vectors. Two vectors are one cluster if their similarity is threshold or more, unless target says otherwise."""
    check_vectors(x, MOST_VECTORS["offline"], target)
    if not -1 <= threshold <= 1:
        raise EngineError("InvalidSimilarityThreshold", str(threshold))
    if len(x) == 2:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        together = target == 1 if target else max(0.0, float(unit[0] @ unit[1])) >= threshold
        return np.array([0, 0 if together else 1])
    return METHODS[method](x, threshold=threshold, target=target, **options)


def cluster(vecs: DataFrame, method: str = "spectral", **options) -> DataFrame:
    """rec, i, label of the vectors (rec, i, embedding) of each recording; method is agglomerative, spectral or ahc.

    A recording is one group, bounded by MOST_VECTORS; larger ones are refused. An empty table gives an empty result.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        large = method == "spectral" and len(x) > MOST_VECTORS["offline"]
        labels = ahc(x, **options) if method == "ahc" else spectral_any(x, **options) if large else offline(x, method, **options)
        return pd.DataFrame({"rec": pdf["rec"], "i": pdf["i"], "label": labels})

    return vecs.select("rec", "i", "embedding").groupBy("rec").applyInPandas(one, "rec long, i int, label int")


def laplacian_eigenvalues(entries: DataFrame) -> DataFrame:
    """rec, value from the entries off the diagonal (rec, i, j, l) of normalised Laplacians, whose diagonal is 1."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf[["i", "j"]].to_numpy())
        if len(ids) > MOST_VECTORS["offline"]:
            raise EngineError("InputTooLarge", f"{len(ids)} vectors")
        m = np.eye(len(ids))
        m[np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])] = pdf["l"]
        return pd.DataFrame({"rec": pdf["rec"].iloc[0], "value": np.linalg.eigvalsh(m)})

    return entries.select("rec", "i", "j", "l").groupBy("rec").applyInPandas(one, "rec long, value double")


class Speakers:
    """Greedy matching of vectors, in order, to running centroids."""

    def __init__(self, speaker_threshold: float = 0.65, embedding_threshold: float = 0.45, min_duration: float = 1.0, keep: float = 0.9, history: int = 50):
        for name, v in (("speaker_threshold", speaker_threshold), ("embedding_threshold", embedding_threshold)):
            if not 0 <= v <= 2:
                raise EngineError("ThresholdOutOfRange", name)
        if not (np.isfinite(min_duration) and min_duration >= 0):
            raise EngineError("DurationOutOfRange", str(min_duration))
        self.near, self.close, self.least, self.keep, self.most = speaker_threshold, embedding_threshold, min_duration, keep, history
        self.centroids: list[np.ndarray] = []
        self.history: list[list[np.ndarray]] = []
        self.durations: list[float] = []

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        return v * (1 / max(float(np.linalg.norm(v)), 1e-12))

    @classmethod
    def from_threshold(cls, base: float, **options) -> Speakers:
        """One threshold for both: 1.2 times it to join a speaker, 0.8 times it to move the speaker's centroid."""
        return cls(speaker_threshold=1.2 * base, embedding_threshold=0.8 * base, **options)

    def reset(self) -> None:
        """Forgets all speakers; the next one is number 1."""
        self.centroids, self.history, self.durations = [], [], []

    @property
    def count(self) -> int:
        return len(self.centroids)

    @property
    def ids(self) -> list[int]:
        return list(range(1, self.count + 1))

    def centroid(self, speaker: int) -> np.ndarray | None:
        return self.centroids[speaker - 1].copy() if 1 <= speaker <= self.count else None

    def duration(self, speaker: int) -> float | None:
        return self.durations[speaker - 1] if 1 <= speaker <= self.count else None

    def assign(self, v: np.ndarray, duration: float) -> tuple[str, int | None]:
        """existing, new or dropped, and the speaker's number from 1."""
        v = self.unit(np.asarray(v, np.float64))
        d = 1 - np.clip(np.stack(self.centroids) @ v, -1, 1) if self.centroids else np.array([np.inf])
        k = int(d.argmin())
        if d[k] < self.near:
            self.durations[k] += duration
            if d[k] < self.close and float(v @ v) > 0.01:
                self.history[k] = [*self.history[k], v][-self.most :]
                mean = self.unit(np.mean(self.history[k], axis=0))
                self.centroids[k] = self.unit(self.keep * mean + (1 - self.keep) * v)
            return "existing", k + 1
        if duration >= self.least:
            self.centroids.append(v)
            self.history.append([v])
            self.durations.append(duration)
            return "new", len(self.centroids)
        return "dropped", None


def online_assign(vecs: DataFrame, order: str = "vec_id", **options) -> DataFrame:
    """rec, vec_id, decision, speaker: each session's vectors, in order, matched to its speakers so far."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, s = pdf.sort_values(order), Speakers(**options)
        got = [s.assign(v, d) for v, d in zip(pdf["embedding"], pdf["duration"], strict=True)]
        return pd.DataFrame({"rec": pdf["rec"], "vec_id": pdf["vec_id"], "decision": [g[0] for g in got], "speaker": pd.array([g[1] for g in got], "Int64")})

    return vecs.groupBy("rec").applyInPandas(one, "rec long, vec_id long, decision string, speaker long")
