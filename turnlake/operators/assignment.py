"""Assignment of each chunk's three slots to clusters, at most one slot to a cluster, for the greatest total score."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Rounds

UNMATCHED, MOST_SCORE, SLOTS = -2, 1e15, 3


def _choices(present: list[Column], most: Column) -> Column:
    """The ways to give slots the first, second or third of their best clusters, or none (0): all slots that are there get one, unless there are fewer clusters."""
    places = lambda mask: [range(1, SLOTS + 1) if m else (0,) for m in mask]
    listed = lambda of: F.array(*(F.struct(*(F.lit(k).alias(f"s{s}") for s, k in enumerate(c))) for c in itertools.product(*of)))
    out = listed([range(SLOTS + 1)] * SLOTS)
    for mask in itertools.product((True, False), repeat=SLOTS):
        here = most == sum(mask)
        for p, m in zip(present, mask, strict=True):
            here = here & (p if m else ~p)
        out = F.when(here, listed(places(mask))).otherwise(out)
    return out


def assign_slots(soft: DataFrame) -> DataFrame:
    """rec, chunk, slot, cluster from (rec, chunk, slot, cluster, soft); slots that get none have -2.

    As many slots are matched as the chunk has slots or the recording clusters, whichever is less; the others, and slots
    that a chunk lacks, have -2. An optimal assignment needs no more than the three best clusters of each slot, so at most
    64 choices of a chunk are compared, as one expression. Of equal totals the one wins that shortest augmenting paths end
    at (see `by_paths`): only chunks with such ties are packed, and solved one by one. A NaN or null counts as the least
    score of its recording. Infinite scores fail with NonFinite, those beyond 1e15 with CostTooLarge, recordings of NaN
    alone with AllNaN. A slot of a chunk must have all clusters, each once, or none. An empty table gives an empty result;
    other columns are ignored. The winners are written, and soft is read again only where there are ties.
    """
    score = F.when(~F.isnan("soft"), F.col("soft").cast("double"))
    score = F.when(F.abs(score) == float("inf"), F.raise_error(F.lit("NonFinite")).cast("double")).when(F.abs(score) > MOST_SCORE, F.raise_error(F.lit("CostTooLarge")).cast("double")).otherwise(score)
    cells = soft.select("rec", "chunk", "slot", "cluster", score.alias("v"))
    least = F.min("v").over(Window.partitionBy("rec"))
    cells = cells.withColumn("v", F.coalesce("v", least, F.raise_error(F.lit("AllNaN")).cast("double")))
    # A slot keeps its three best clusters: of equal scores the lowest.
    rank = F.row_number().over(Window.partitionBy("rec", "chunk", "slot").orderBy(F.desc("v"), "cluster"))
    best = cells.withColumn("k", rank).filter(F.col("k") <= SLOTS)
    cell = F.struct("k", "cluster", "v")
    of = [F.sort_array(F.collect_list(F.when(F.col("slot") == s, cell))).alias(f"b{s}") for s in range(SLOTS)]
    rows = best.groupBy("rec", "chunk").agg(*of, F.max("k").cast("int").alias("clusters"))
    present = [F.size(f"b{s}") > 0 for s in range(SLOTS)]
    rows = rows.withColumn("most", F.least("clusters", sum((p.cast("int") for p in present), F.lit(0))))

    def judged(c: Column) -> Column:
        got = [F.get(f"b{s}", c[f"s{s}"] - 1) for s in range(SLOTS)]
        taken = [g["cluster"] for g in got]
        fits = F.lit(True)
        for s in range(SLOTS):
            # Place 0 is no cluster; a place beyond the slot's list is no choice.
            fits = fits & ((c[f"s{s}"] == 0) | got[s].isNotNull())
        for x, y in itertools.combinations(taken, 2):
            fits = fits & ~F.coalesce(x == y, F.lit(False))
        matched = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in taken), F.lit(0))
        total = sum((F.coalesce(g["v"], F.lit(0.0)) for g in got), F.lit(0.0))
        choice = F.struct(total.alias("total"), *(F.coalesce(t, F.lit(UNMATCHED)).cast("int").alias(f"c{s}") for s, t in enumerate(taken)))
        return F.when(fits & (matched == F.col("most")), choice)

    # One pass over the choices, and explode, so that no filter makes them anew.
    none = F.lit(None).cast("struct<total:double,c0:int,c1:int,c2:int>")
    step = lambda acc, x: F.when(acc["best"].isNull() | (x["total"] > acc["best"]["total"]), F.struct(x.alias("best"), F.lit(False).alias("tied"))).when(x["total"] == acc["best"]["total"], F.struct(acc["best"].alias("best"), F.lit(True).alias("tied"))).otherwise(acc)
    start = F.struct(none.alias("best"), F.lit(False).alias("tied"))
    best = F.aggregate(F.array_compact(F.transform(_choices(present, F.col("most")), judged)), start, step)
    won = rows.select("rec", F.col("chunk").cast("int").alias("chunk"), F.explode(F.array(best)).alias("w"))
    won = won.select("rec", "chunk", F.coalesce("w.best", F.raise_error(F.lit("NoAssignment"))).alias("won"), "w.tied")
    won = Rounds(soft.sparkSession, "assign").write(won)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), F.col(f"won.c{s}").alias("cluster")) for s in range(SLOTS))))
    clear = won.filter("NOT tied").select("rec", "chunk", each.alias("x")).select("rec", "chunk", "x.slot", "x.cluster")
    ties = won.filter("tied").select("rec", "chunk")
    if ties.isEmpty():
        return clear
    tied = cells.withColumn("chunk", F.col("chunk").cast("int")).join(ties, ["rec", "chunk"], "left_semi")
    packed = tied.groupBy("rec", "chunk").agg(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), F.col("cluster").cast("int").alias("cluster"), "v")).alias("cells"))
    return clear.unionByName(packed.mapInPandas(_solve, "rec long, chunk int, slot int, cluster int"))


def _solve(batches):
    """Rows (rec, chunk, cells of a slot, cluster and score) to each chunk's slots and their clusters."""
    for pdf in batches:
        out = []
        for rec, chunk, cells in pdf[["rec", "chunk", "cells"]].itertuples(index=False):
            slots, names = sorted({c["slot"] for c in cells}), sorted({c["cluster"] for c in cells})
            scores = np.empty((len(slots), len(names)))
            for c in cells:
                scores[slots.index(c["slot"]), names.index(c["cluster"])] = c["v"]
            found = dict(zip(slots, by_paths(scores), strict=True))
            out += [(rec, chunk, s, names[found[s]] if found.get(s, -1) >= 0 else UNMATCHED) for s in range(SLOTS)]
        yield pd.DataFrame(out, columns=["rec", "chunk", "slot", "cluster"]).astype({"rec": "int64", "chunk": "int32", "slot": "int32", "cluster": "int32"})


def by_paths(scores: np.ndarray) -> list[int]:
    """For each row of a small table of scores its column in an assignment of the greatest total, or -1.

    The lesser side of the table is matched one by one, each along the cheapest path of swaps that ends at a free place.
    Fixed conventions that decide between equal totals: places are looked at from the last to the first; of equally cheap
    ones the first wins, unless a later one is free; a place that a path has passed hands its turn to the last one in line.
    """
    turned = scores.shape[1] < scores.shape[0]
    cost = -(scores.T if turned else scores)
    own, other = np.zeros(cost.shape[0]), np.zeros(cost.shape[1])
    holder = np.full(cost.shape[1], -1)
    for new in range(cost.shape[0]):
        line, reach = list(range(cost.shape[1]))[::-1], np.full(cost.shape[1], np.inf)
        came, rows_on, at, far = np.full(cost.shape[1], -1), [], new, 0.0
        passed: list[int] = []
        while True:
            rows_on.append(at)
            through = far + cost[at] - own[at] - other
            best = -1
            for k, j in enumerate(line):
                if through[j] < reach[j]:
                    reach[j], came[j] = through[j], at
                if best < 0 or reach[j] < reach[line[best]] or (reach[j] == reach[line[best]] and holder[j] < 0):
                    best = k
            j = line[best]
            far = reach[j]
            line[best] = line[-1]
            line.pop()
            if holder[j] < 0:
                break
            passed.append(j)
            at = int(holder[j])
        own[new] += far
        for p in passed:
            own[holder[p]] += far - reach[p]
            other[p] -= far - reach[p]
        while True:
            row = int(came[j])
            before = int(np.flatnonzero(holder == row)[0]) if row != new else -1
            holder[j] = row
            if row == new:
                break
            holder[before], j = -1, before
    found = [-1] * cost.shape[0]
    for j, row in enumerate(holder.tolist()):
        if row >= 0:
            found[row] = j
    if not turned:
        return found
    back = [-1] * scores.shape[0]
    for cluster, slot in enumerate(found):
        back[slot] = cluster
    return back
