"""Pairs, affinities, linkages and centroids of vectors, within recordings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks as B

#: Weights at or below this are dead; weights between the other two are too close to tell.
ALIVE, UNSURE = 1e-7, (5e-8, 2e-7)
MOST_CLUSTERS = 15
#: Vectors of which a task of nearest gives the best of each query, and what no vector is named.
WIDE, _NO_ID = 262144, np.iinfo(np.int64).max
#: Norm from which products are made in double precision alone.
LARGE = 1e15


def numbered(vecs: DataFrame) -> DataFrame:
    """vecs (rec, vec_id, embedding) with i: the place of each vector in its recording."""
    return vecs.withColumn("i", (F.row_number().over(Window.partitionBy("rec").orderBy("vec_id")) - 1).cast("int"))


def pairs(vecs: DataFrame) -> DataFrame:
    """rec, i, j, a, b for i < j of each recording: what a condensed distance matrix has, so recordings are small."""
    one = vecs.select("rec", "i", F.col("embedding").alias("a"))
    other = vecs.select("rec", F.col("i").alias("j"), F.col("embedding").alias("b"))
    return one.join(other, "rec").filter("i < j")


def cosine_pairs(vecs: DataFrame, digits: int | None = None) -> DataFrame:
    """rec, i, j, cosine of each pair i < j of a recording's unit vectors."""
    return B.over_pairs(vecs.select("rec", "i", "embedding"), B.each_pair(B.dots, digits, "cosine"), "i int, j int, cosine double")


def condensed_distances(vecs: DataFrame, digits: int | None = None) -> DataFrame:
    """rec, i, j, k, distance: Euclidean, with k the place in the condensed order (0,1), (0,2), ..., (n-2,n-1)."""
    n = vecs.groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
    found = B.over_pairs(vecs.select("rec", "i", "embedding"), B.each_pair(B.distances, digits, "distance"), "i int, j int, distance double")
    i = F.col("i").cast("long")
    k = F.col("n") * i - F.shiftright(i * (i + 1), 1) + F.col("j") - i - 1
    return found.join(F.broadcast(n), "rec").select("rec", "i", "j", k.alias("k"), "distance")


def affinities(vecs: DataFrame) -> DataFrame:
    """rec, i, j, w for i <> j: the cosine, or 0 if it is negative."""
    half = pairs(vecs).select("rec", "i", "j", F.greatest(F.lit(0.0), V.dot(F.col("a"), F.col("b"))).alias("w"))
    return half.unionByName(half.select("rec", F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def degrees(aff: DataFrame) -> DataFrame:
    return aff.groupBy("rec", "i").agg(F.sum("w").alias("degree"))


def laplacian(aff: DataFrame) -> DataFrame:
    """rec, i, j, l: the entries off the diagonal of I - D^-1/2 A D^-1/2 (the diagonal is 1)."""
    d = degrees(aff)
    # The half with i < j meets the degrees, and is mirrored after.
    half = aff.filter("i < j AND w > 0").join(d.withColumnRenamed("degree", "di"), ["rec", "i"]).join(d.select("rec", F.col("i").alias("j"), F.col("degree").alias("dj")), ["rec", "j"])
    half = half.select("rec", "i", "j", (-F.col("w") / (F.sqrt("di") * F.sqrt("dj"))).alias("l"))
    return half.select("rec", F.explode(F.array(F.struct("i", "j", "l"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "l"))).alias("x")).select("rec", "x.*")


def _affinity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, x @ y.T)


def affinity_degrees(vecs: DataFrame) -> DataFrame:
    """rec, i, degree: as degrees(affinities(vecs)), by sums of blocks."""

    def work(rec, a, b, same):
        down = np.zeros(len(b.i))
        for at, w in B.strips(a, b, _affinity, B.STRIP):
            if same:
                w[a.i[at][:, None] == b.i[None]] = 0.0
            yield {"i": a.i[at], "degree": w.sum(axis=1)}
            down += w.sum(axis=0)
        if not same:
            yield {"i": b.i, "degree": down}

    sums = B.over_pairs(vecs.select("rec", "i", "embedding"), work, "i int, degree double").groupBy("rec", "i").agg(F.sum("degree").alias("degree"))
    # A recording of one vector has no pair, so no degree.
    return sums.join(vecs.groupBy("rec").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("rec"), "rec", "left_semi")


def laplacian_entries(vecs: DataFrame, digits: int | None = None) -> DataFrame:
    """rec, i, j, l: as laplacian(affinities(vecs)); the degrees go with the vectors of a block."""

    def work(rec, a, b, same):
        root = np.sqrt(b.more["degree"])
        for at, w in B.strips(a, b, _affinity, B.ROWS):
            i, j = a.i[at], b.i
            on = w > 0
            if same:
                on &= i[:, None] < j[None]
            k, m = np.nonzero(on)
            v = B.half_up(-w[k, m] / (np.sqrt(a.more["degree"][at])[k] * root[m]), digits)
            yield {"i": i[k], "j": j[m], "l": v}
            yield {"i": j[m], "j": i[k], "l": v}

    both = vecs.select("rec", "i", "embedding").join(affinity_degrees(vecs), ["rec", "i"])
    return B.over_pairs(both, work, "i int, j int, l double", ("degree",), vecs)


def eigengap(values: DataFrame, most: int = MOST_CLUSTERS) -> DataFrame:
    """rec, k from (rec, value): the place of the widest gap between neighbours of the sorted values, among the first min(n - 1, most); of equals the last."""
    w = Window.partitionBy("rec").orderBy("value")
    gaps = values.select("rec", F.row_number().over(w).alias("k"), (F.lead("value").over(w) - F.col("value")).alias("gap")).filter(f"gap IS NOT NULL AND k <= {most}")
    return gaps.groupBy("rec").agg(F.max(F.struct("gap", "k"))["k"].alias("k"))


def linkage(vecs: DataFrame, how: str) -> DataFrame:
    """rec, a, b, distance of each two clusters: the least (single), greatest (complete) or mean (average) distance of their members; vecs has rec, i, embedding and an integer label.

    Tasks send on one row for each two clusters of a strip, never the pairs of their members.
    """
    best = {"single": np.minimum, "complete": np.maximum, "average": np.add}[how]

    def work(rec, a, b, same):
        # A block with itself gives each pair twice, so sums of two blocks count twice as well.
        times = 1 if same or how != "average" else 2
        x, y = (np.argsort(m.more["label"], kind="stable") for m in (a, b))
        la, lb = a.more["label"][x], b.more["label"][y]
        cols, names = np.unique(lb, return_index=True)[::-1]
        of = np.diff(np.append(cols, len(lb)))
        for s in range(0, len(x), B.STRIP):
            mine, rows = np.unique(la[s : s + B.STRIP], return_index=True)
            many = np.diff(np.append(rows, len(la[s : s + B.STRIP])))
            d = best.reduceat(best.reduceat(B.distances(a.x[x[s : s + B.STRIP]], b.x[y]), rows, axis=0), cols, axis=1)
            k, m = np.nonzero(mine[:, None] != names[None])
            yield {"a": np.minimum(mine[k], names[m]), "b": np.maximum(mine[k], names[m]), "d": times * d[k, m], "n": times * many[k] * of[m]}

    sums = B.over_pairs(vecs.select("rec", "i", "embedding", F.col("label").cast("long").alias("label")), work, "a long, b long, d double, n long", ("label",))
    last = {"single": F.min("d"), "complete": F.max("d"), "average": F.sum("d") / F.sum("n")}[how]
    kind = dict(vecs.dtypes)["label"]
    return sums.groupBy("rec", F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).agg(last.alias("distance"))


def weighted_centroids(members: DataFrame, alive: float = ALIVE) -> DataFrame:
    """rec, cluster, centroid from (rec, cluster, pi, weight, embedding): weighted means of the raw vectors of clusters with pi > alive.

    Fails if a pi is too close to `alive` to tell.
    """
    low, high = UNSURE
    sure = F.when((F.col("pi") > low) & (F.col("pi") < high), F.raise_error(F.lit("AmbiguousAlive"))).otherwise(F.col("pi"))
    live = members.filter(sure > alive).select("rec", "cluster", "weight", F.posexplode("embedding").alias("d", "x"))
    each = live.groupBy("rec", "cluster", "d").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("x"))
    return each.groupBy("rec", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centroid"))


def centroid_scores(vecs: DataFrame, centroids: DataFrame, names: tuple[str, ...] = ("i",)) -> DataFrame:
    """rec, i, cluster, soft: 2 - cosine distance of each vector to each centroid of its recording (some tens at most); names tell vectors apart."""
    both = vecs.join(centroids, "rec")
    ab = V.dot(F.col("embedding"), F.col("centroid"))
    return both.select("rec", *names, "cluster", (2 - V.cosine_distance_with_norms(ab, V.sum_squares(F.col("embedding")), V.sum_squares(F.col("centroid")))).alias("soft"))


def _at_least(c: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few entries of c that are `least` of their row or more, in order."""
    mask = np.zeros((len(c), -(-c.shape[1] // 8) * 8), bool)
    np.greater_equal(c, least[:, None], out=mask[:, : c.shape[1]])
    # Eight entries at once, as most have none.
    eights = np.flatnonzero(mask.view(np.uint64))
    k, m = np.nonzero(mask.reshape(-1, 8)[eights])
    return np.divmod(eights[k] * 8 + m, mask.shape[1])


def nearest(queries: DataFrame, vecs: DataFrame, k: int) -> DataFrame:
    """query, vec_id, rank, cosine: the k nearest of all vectors to each query; cosines count to 9 digits, of equals the least vec_id is nearer.

    Queries and vectors are dealt into blocks, and tasks share the pairs of both. A task gives k rows a query, of WIDE
    vectors or more. Products in single precision tell which pairs can't be among the k of a query; all others are made in
    double precision.
    """
    n = [t.count() for t in (queries, vecs)]

    def side(t: DataFrame, n: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // B.BLOCK) or 1)).cast("int")
        dealt = t.select(block.alias("block"), F.struct(F.col("vec_id").alias("i"), "embedding").alias("row"))
        return dealt.groupBy("block").agg(F.collect_list("row").alias("rows")).select(F.lit(0).cast("long").alias("rec"), "block", "rows")

    def work(a, bs):
        best, ids = np.full((len(a.i), k), -np.inf), np.full((len(a.i), k), _NO_ID)
        norm = np.sqrt((a.x * a.x).sum(axis=1))
        for b in bs:
            most = np.sqrt((b.x * b.x).sum(axis=1).max())
            kind = np.float32 if max(norm.max(), most) < LARGE else np.float64
            # What a product is off by at most, with room for the 9 digits.
            off = norm * most * (a.x.shape[1] + 8) * 2 * np.finfo(kind).eps + 2e-9
            x, y = a.x.astype(kind), b.x.astype(kind)
            for s in range(0, len(a.i), 4 * B.STRIP):
                at = slice(s, s + 4 * B.STRIP)
                c, least = B.dots(x[at], y), best[at, -1] - off[at]
                if len(b.i) > k + 1 and not np.isfinite(least).all():
                    # One more than k, as a query can be among them.
                    some = -np.partition(-c, k, axis=1)[:, k]
                    least = np.where(np.isfinite(least), least, some - 2 * off[at])
                r, m = _at_least(c, np.nextafter(least.astype(kind), kind(-np.inf)))
                r, m = (v[a.i[at][r] != b.i[m]] for v in (r, m))
                if not len(r):
                    continue
                parts = range(0, len(r), 1 << 16)
                value = B.half_up(np.concatenate([(a.x[s + r[p : p + (1 << 16)]] * b.x[m[p : p + (1 << 16)]]).sum(axis=1) for p in parts]), 9)
                some = np.unique(r)
                rows, cs, vs = np.append(np.repeat(some, k), r), np.append(best[s + some], value), np.append(ids[s + some], b.i[m])
                order = np.lexsort((vs, -cs, rows))
                # With its former ones each query has k or more.
                first = np.searchsorted(rows[order], some)
                pick = order[first[:, None] + np.arange(k)]
                best[s + some], ids[s + some] = cs[pick], vs[pick]
        r, m = np.nonzero(best > -np.inf)
        yield {"query": a.i[r], "vec_id": ids[r, m], "cosine": best[r, m]}

    units = B.grid_units(side(queries, n[0]), side(vecs, n[1]), n[0], -(-n[1] // WIDE) or 1)
    some = B.over_grid(units, work, "query long, vec_id long, cosine double").drop("rec")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id"))
    return some.select("query", "vec_id", "cosine", rank.alias("rank")).filter(f"rank <= {k}")


def lloyd_step(vecs: DataFrame, centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assignments (rec, i, cluster) to the nearest centroid, of equals the lowest, and the new centroids; an empty cluster keeps its own."""
    both = vecs.join(centroids, "rec").select("rec", "i", "embedding", "cluster", F.round(V.euclidean(F.col("embedding"), F.col("centroid")), 12).alias("d"))
    assigned = both.groupBy("rec", "i").agg(F.min(F.struct("d", "cluster"))["cluster"].alias("cluster"))
    members = vecs.join(assigned, ["rec", "i"]).select("rec", "cluster", F.lit(1.0).alias("pi"), F.lit(1.0).alias("weight"), "embedding")
    moved = weighted_centroids(members)
    new = centroids.join(moved.withColumnRenamed("centroid", "_new"), ["rec", "cluster"], "left").select("rec", "cluster", F.coalesce("_new", "centroid").alias("centroid"))
    return assigned, new
