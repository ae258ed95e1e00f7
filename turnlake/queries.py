"""The queries of the engine's own operators, and their DuckDB SQL where SQL can express them.

The driver's tables stand in for recordings: a user's events are a recording's frames, a label's vectors are a recording's
voices, and a conversation's turns are speaker turns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import frames as FR
from .functions import vectors as V
from .operators import clustering as C
from .operators import frames as O
from .operators import rounds as R
from .operators import segmentation as G
from .operators import similarity as S
from .operators.assignment import assign_slots
from .operators.features import Projection, filter_banks, project
from .operators.variational import posteriors
from .plans import diarize as D

SIZE, STEP, FSTEP, FDUR, GAP, ONSET, OFFSET = 12, 6, 0.016875, 0.0619375, 0.05, 0.2, 0.1
CHUNK_STEP = STEP * FSTEP
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r"\bat\b", '"at"', sql)
        return f

    return add


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.numbered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("rec"), "vec_id", "embedding"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, frame, p, slot, cluster of each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    slot = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    cluster = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 3).otherwise(11)
    return e.select(F.col("user_id").alias("rec"), number.cast("long").alias("frame"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p"), slot.alias("slot"), cluster.alias("kind"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("rec")).agg(F.count(F.lit(1)).alias("frames"))


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, chunk, at, slot, activity: windows over the frames."""
    return O.in_windows(frames(spark, sf_dir), SIZE, STEP).select("rec", "frame", "chunk", "at", "slot", "kind", F.col("p").alias("activity"))


def hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed assignment: the slot's cluster turns with the chunk; every fifth is unmatched."""
    h = (F.col("chunk") + F.col("slot") + F.col("rec")) % 5
    return seg(spark, sf_dir).select("rec", "chunk", "slot").distinct().withColumn("cluster", F.when(h == 4, -2).when(h == 3, 11).otherwise(h).cast("int"))


FRAMES_SQL = """fr AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, least(value / 100, 1.0) AS p,
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS slot, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 11 END AS kind FROM events)"""
SEG_SQL = FRAMES_SQL + f""",
sz AS (SELECT user_id AS rec, count(*) AS frames FROM events GROUP BY 1),
ch AS (SELECT rec, unnest(range(0, (frames - 1) // {STEP} + 1)) AS chunk FROM sz),
sg AS (SELECT rec, frame, chunk, frame - chunk * {STEP} AS at, slot, kind, p AS activity FROM fr JOIN ch USING (rec) WHERE frame BETWEEN chunk * {STEP} AND chunk * {STEP} + {SIZE - 1})"""
VEC_SQL = "v AS (SELECT CAST(label AS BIGINT) AS rec, vec_id, embedding::DOUBLE[] AS e, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS i FROM embeddings)"
PAIR_SQL = VEC_SQL + ", pr AS (SELECT a.rec, a.i, b.i AS j, a.e AS a, b.e AS b FROM v a JOIN v b ON a.rec = b.rec AND a.i < b.i)"
RUNS_SQL = SEG_SQL + f""",
sw AS (SELECT *, CASE WHEN p >= {ONSET} THEN true WHEN p < {OFFSET} THEN false END AS s FROM fr),
hy AS (SELECT rec, frame, p, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY rec ORDER BY frame ROWS UNBOUNDED PRECEDING), false) AS on_ FROM sw),
il AS (SELECT rec, frame, frame - row_number() OVER (PARTITION BY rec ORDER BY frame) AS k FROM hy WHERE on_),
rn AS (SELECT rec, min(frame) AS first, max(frame) + 1 AS stop FROM il GROUP BY rec, k),
mk AS (SELECT *, CASE WHEN first - max(stop) OVER (PARTITION BY rec ORDER BY first, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1 THEN 0 ELSE 1 END AS nw FROM rn),
mg AS (SELECT rec, min(first) AS first, max(stop) AS stop FROM (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY first, stop) AS g FROM mk) GROUP BY rec, g)"""


@query(f"WITH {VEC_SQL} SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM v")
def vec_norms(spark, sf_dir):
    return vecs(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {VEC_SQL}, n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v) SELECT vec_id, round(e[1] / n, 6) AS first, round(e[64] / n, 6) AS last, round(list_sum(list_transform(e, lambda x: x / n)), 6) AS total FROM n")
def vec_normalize(spark, sf_dir):
    n = vecs(spark, sf_dir).withColumn("n", V.norm(F.col("embedding")))
    u = n.withColumn("u", V.normalized(F.transform("embedding", lambda x: x.cast("double")), F.col("n")))
    return u.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"), F.round(V.compensated_sum(F.col("u")), 6).alias("total"))


@query(f"WITH {VEC_SQL} SELECT vec_id, round(list_sum(e), 6) AS total, round(list_dot_product(e, e), 6) AS product FROM v")
def compensated_sums(spark, sf_dir):
    """Between two terms of 1e17 that cancel, a plain sum loses all of a vector; a compensated one gives it whole."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    big = F.array(F.lit(1e17))
    total = V.compensated_sum(F.concat(big, e, F.array(F.lit(-1e17))))
    product = V.compensated_dot(F.concat(big, e, F.array(F.lit(-1e17))), F.concat(F.array(F.lit(1.0)), e, F.array(F.lit(1.0))))
    return vecs(spark, sf_dir).select("vec_id", F.round(total, 6).alias("total"), F.round(product, 6).alias("product"))


@query(f"WITH {PAIR_SQL} SELECT rec, i, j, round(list_dot_product(a, b), 6) AS cosine FROM pr")
def cosine_pairs(spark, sf_dir):
    return S.cosine_pairs(vecs(spark, sf_dir), 6)


@query(f"WITH {PAIR_SQL}, n AS (SELECT rec, count(*) AS n FROM v GROUP BY rec) SELECT rec, i, j, n * i - (i * (i + 1)) // 2 + j - i - 1 AS k, round(list_distance(a, b), 6) AS distance FROM pr JOIN n USING (rec)")
def pdist_condensed(spark, sf_dir):
    return S.condensed_distances(vecs(spark, sf_dir), 6)


@query(f"""WITH {VEC_SQL}, s AS (SELECT q.vec_id AS query, v.vec_id, round(list_dot_product(q.e, v.e), 9) AS c FROM v JOIN v q ON q.vec_id <> v.vec_id),
r AS (SELECT query, vec_id, c, row_number() OVER (PARTITION BY query ORDER BY c DESC, vec_id) AS rank FROM s) SELECT query, vec_id, CAST(rank AS INTEGER) AS rank, round(c, 6) AS cosine FROM r WHERE rank <= 5""")
def cosine_topk_neighbors(spark, sf_dir):
    v = vecs(spark, sf_dir)
    return S.nearest(v, v, 5).select("query", "vec_id", "rank", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {VEC_SQL} SELECT a.vec_id, round(1 - greatest(-1, least(1, list_dot_product(a.e, b.e))), 6) AS distance, round(1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS by_norms FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def cosine_distance_clamped(spark, sf_dir):
    v = vecs(spark, sf_dir)
    both = v.select("vec_id", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return both.select("vec_id", F.round(V.cosine_distance(a, b), 6).alias("distance"), F.round(V.cosine_distance_with_norms(V.dot(a, b), V.sum_squares(a), V.sum_squares(b)), 6).alias("by_norms"))


@query(f"WITH {VEC_SQL}, n AS (SELECT vec_id, e, greatest(sqrt(list_dot_product(e, e)), 1e-12) AS n FROM v) SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * (1 / n))), 6) AS total FROM n")
def l2_clamp(spark, sf_dir):
    n = vecs(spark, sf_dir).withColumn("n", V.norm(F.col("embedding")))
    return n.select("vec_id", F.round(F.aggregate(V.clamped_unit(F.col("embedding"), F.col("n")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {VEC_SQL} SELECT vec_id, round(list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))), 6) AS lse FROM v")
def logsumexp_rows(spark, sf_dir):
    d = vecs(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return d.select("vec_id", F.round(V.logsumexp(F.col("e")), 6).alias("lse"))


@query(f"WITH {VEC_SQL} SELECT a.vec_id, round(list_sum(a.e) + 2.5 * list_sum(b.e), 5) AS total FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def axpy_sum(spark, sf_dir):
    v = vecs(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("x")), "vec_id")
    return both.select("vec_id", F.round(F.aggregate(V.axpy(F.col("e"), 2.5, F.col("x")), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"WITH {VEC_SQL}, p AS (SELECT a.vec_id, list_transform(list_zip(a.e, b.e), lambda z: CAST(z[1] AS FLOAT) + CAST(2.7 AS FLOAT) * CAST(z[2] AS FLOAT)) AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1) SELECT vec_id, CAST(y[1] AS DOUBLE) AS first, CAST(y[64] AS DOUBLE) AS last FROM p")
def axpy_single(spark, sf_dir):
    v = vecs(spark, sf_dir).select("vec_id", "embedding")
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("x")), "vec_id").select("vec_id", V.axpy_float(F.col("embedding"), 2.7, F.col("x")).alias("y"))
    return both.select("vec_id", F.col("y")[0].cast("double").alias("first"), F.col("y")[63].cast("double").alias("last"))


@query(f"WITH {VEC_SQL}, n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v) SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / n)), 6) + 0 AS total FROM n")
def vec_checked_unit(spark, sf_dir):
    n = vecs(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).withColumn("n", V.norm(F.col("e")))
    u = n.withColumn("u", V.checked_unit(F.col("e"), F.col("n"), 0.01))
    return u.select("vec_id", (F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6) + 0).alias("total"))


_SOFT = VEC_SQL + ", l AS (SELECT vec_id, list_transform(e[1:7], lambda x: x * 10) AS x FROM v), s AS (SELECT vec_id, x, list_transform(x, lambda y: exp(y) / list_sum(list_transform(x, lambda z: exp(z)))) AS p FROM l)"


def _classes(spark, sf_dir):
    logits = vecs(spark, sf_dir).select("vec_id", F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double") * 10).alias("x"))
    return logits.select("vec_id", V.softmax(F.col("x")).alias("p"))


@query(f"WITH {_SOFT} SELECT vec_id, round(p[2] + p[5] + p[6], 6) AS a, round(p[3] + p[5] + p[7], 6) AS b, round(p[4] + p[6] + p[7], 6) AS c, round(1 - p[1], 6) AS voice FROM s")
def softmax_powerset(spark, sf_dir):
    p = _classes(spark, sf_dir)
    return p.select("vec_id", *(F.round(c, 6).alias(n) for c, n in zip(FR.speaker_marginals(F.col("p")), "abc", strict=True)), F.round(FR.voice_probability(F.col("p")), 6).alias("voice"))


@query(f"WITH {_SOFT}, b AS (SELECT vec_id, list_position(x, list_max(x)) - 1 AS k FROM s) SELECT vec_id, CASE WHEN k IN (1, 4, 5) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS a, CASE WHEN k IN (2, 4, 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b, CASE WHEN k IN (3, 5, 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM b")
def powerset_hard(spark, sf_dir):
    p = _classes(spark, sf_dir)
    return p.select("vec_id", *(c.alias(n) for c, n in zip(FR.speaker_hard(F.col("p")), "abc", strict=True)))


_AFF = PAIR_SQL + ", h AS (SELECT rec, i, j, greatest(0, list_dot_product(a, b)) AS w FROM pr), af AS (SELECT rec, i, j, w FROM h UNION ALL SELECT rec, j, i, w FROM h), dg AS (SELECT rec, i, sum(w) AS degree FROM af GROUP BY rec, i)"


@query(f"WITH {_AFF} SELECT rec, i, round(degree, 6) AS degree FROM dg")
def affinity_degrees(spark, sf_dir):
    return S.affinity_degrees(vecs(spark, sf_dir)).withColumn("degree", F.round("degree", 6))


@query(f"WITH {_AFF} SELECT af.rec, af.i, af.j, round(-w / (sqrt(d.degree) * sqrt(e.degree)), 6) + 0 AS l FROM af JOIN dg d ON d.rec = af.rec AND d.i = af.i JOIN dg e ON e.rec = af.rec AND e.i = af.j WHERE w > 0")
def laplacian_entries(spark, sf_dir):
    return S.laplacian_entries(vecs(spark, sf_dir), 6)


#: Recordings of three vectors each: their Laplacian's eigenvalues are 1 less the roots of x^3 - p x - 2 q, with p the sum of
#: the squared entries and q their product (0 or less).
_TRIPLE_SQL = VEC_SQL + """, g AS (SELECT rec * 1000000 + i // 3 AS rec, i % 3 AS i, e FROM v), pr AS (SELECT a.rec, a.i, b.i AS j, greatest(0, list_dot_product(a.e, b.e)) AS w FROM g a JOIN g b ON a.rec = b.rec AND a.i < b.i),
m AS (SELECT rec, max(w) FILTER (i = 0 AND j = 1) AS x, max(w) FILTER (i = 0 AND j = 2) AS y, max(w) FILTER (i = 1 AND j = 2) AS z FROM pr GROUP BY rec HAVING count(*) = 3),
s AS (SELECT rec, x * x / ((x + y) * (x + z)) AS a, y * y / ((x + y) * (y + z)) AS b, z * z / ((x + z) * (y + z)) AS c FROM m WHERE x + y > 0 AND x + z > 0 AND y + z > 0),
t AS (SELECT rec, a + b + c AS p, sqrt(a * b * c) AS q FROM s), u AS (SELECT rec, 2 * sqrt(p / 3) AS r, acos(greatest(-1, least(1, 3 * q / p * sqrt(3 / p)))) / 3 AS f FROM t),
ev AS (SELECT rec, unnest(range(3)) AS n, 1 - r * cos(f - 2 * pi() * unnest(range(3)) / 3) AS value FROM u)"""


def _triples(spark, sf_dir):
    v = vecs(spark, sf_dir).select((F.col("rec") * 1000000 + F.expr("i div 3")).alias("rec"), (F.col("i") % 3).alias("i"), "embedding")
    aff = S.affinities(v)
    whole = S.degrees(aff).filter("degree > 0").groupBy("rec").agg(F.count(F.lit(1)).alias("n")).filter("n = 3").select("rec")
    values = C.laplacian_eigenvalues(S.laplacian(aff).join(whole, "rec", "left_semi"))
    return values.select("rec", F.round(F.round("value", 7) + 0, 7).alias("value"))


@query(f"WITH {_TRIPLE_SQL} SELECT rec, round(sum(value * value), 5) AS squares, round(max(value), 5) + 0 AS largest FROM ev GROUP BY rec")
def laplacian_spectrum(spark, sf_dir):
    return _triples(spark, sf_dir).groupBy("rec").agg(F.round(F.sum(F.col("value") * F.col("value")), 5).alias("squares"), (F.round(F.max("value"), 5) + 0).alias("largest"))


@query(f"WITH {_TRIPLE_SQL}, o AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY round(value, 7)) AS k, lead(round(value, 7)) OVER (PARTITION BY rec ORDER BY round(value, 7)) - round(value, 7) AS gap FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY round(gap, 6) DESC, k DESC) AS r FROM o WHERE gap IS NOT NULL) SELECT rec, CAST(k AS INTEGER) AS k FROM r WHERE r = 1")
def eigengap_k(spark, sf_dir):
    return S.eigengap(_triples(spark, sf_dir))


def _linked(how: str, sql: str):
    def run(spark, sf_dir):
        v = vecs(spark, sf_dir)
        return S.linkage(v.withColumn("label", F.col("i") % 4), how).withColumn("distance", F.round("distance", 6))

    run.__name__ = f"linkage_{how}"
    return query(f"WITH {PAIR_SQL} SELECT rec, least(i % 4, j % 4) AS a, greatest(i % 4, j % 4) AS b, round({sql}(list_distance(a, b)), 6) AS distance FROM pr WHERE i % 4 <> j % 4 GROUP BY ALL")(run)


linkage_single, linkage_complete, linkage_average = (_linked(*x) for x in (("single", "min"), ("complete", "max"), ("average", "avg")))


@query(f"WITH {VEC_SQL}, x AS (SELECT rec, i % 3 AS cluster, (i % 7 + 1)::DOUBLE AS w, unnest(e) AS x, unnest(range(64)) AS d FROM v WHERE i % 3 < 2), c AS (SELECT rec, cluster, d, sum(w * x) / sum(w) AS x FROM x GROUP BY ALL) SELECT rec, CAST(cluster AS INTEGER) AS cluster, round(sum(x), 5) AS total, round(max(CASE WHEN d = 0 THEN x END), 6) AS first FROM c GROUP BY rec, cluster")
def weighted_centroids(spark, sf_dir):
    m = vecs(spark, sf_dir).select("rec", (F.col("i") % 3).alias("cluster"), F.when(F.col("i") % 3 < 2, 0.5).otherwise(1e-9).alias("pi"), (F.col("i") % 7 + 1).cast("double").alias("weight"), "embedding")
    return S.weighted_centroids(m).select("rec", "cluster", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.col("centroid")[0], 6).alias("first"))


@query(f"WITH {VEC_SQL}, c AS (SELECT rec, i AS cluster, e AS c FROM v WHERE i < 3) SELECT v.rec, i, cluster, round(1 + list_cosine_similarity(e, c), 6) AS soft FROM v JOIN c USING (rec)")
def centroid_scores(spark, sf_dir):
    v = vecs(spark, sf_dir)
    return S.centroid_scores(v, v.filter("i < 3").select("rec", F.col("i").alias("cluster"), F.col("embedding").alias("centroid"))).withColumn("soft", F.round("soft", 6))


@query(f"WITH {VEC_SQL}, c AS (SELECT rec, i AS cluster, e AS c FROM v WHERE i < 4), s AS (SELECT v.rec, v.i, cluster, row_number() OVER (PARTITION BY v.rec, v.i ORDER BY round(list_distance(e, c), 12), cluster) AS r FROM v JOIN c USING (rec)) SELECT rec, i, cluster FROM s WHERE r = 1")
def kmeans_lloyd_step(spark, sf_dir):
    v = vecs(spark, sf_dir)
    return S.lloyd_step(v, v.filter("i < 4").select("rec", F.col("i").alias("cluster"), F.col("embedding").cast("array<double>").alias("centroid")))[0]


@query(f"WITH {RUNS_SQL} SELECT rec, frame, on_ AS voiced FROM hy")
def hysteresis_mask(spark, sf_dir):
    return O.hysteresis(frames(spark, sf_dir), ONSET, OFFSET).select("rec", "frame", F.col("on").alias("voiced"))


def _runs(spark, sf_dir):
    return O.runs(O.hysteresis(frames(spark, sf_dir), ONSET, OFFSET))


@query(f"WITH {RUNS_SQL} SELECT rec, first, stop FROM rn")
def voice_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(f"WITH {RUNS_SQL} SELECT rec, first, stop FROM mg")
def merged_spans(spark, sf_dir):
    return O.merge_gaps(_runs(spark, sf_dir), 1)


@query(f"WITH {RUNS_SQL} SELECT rec, CAST(floor((first * 160000 + 294) / 589) AS BIGINT) AS first, CAST(floor((stop * 160000 + 294) / 589) AS BIGINT) AS stop FROM mg WHERE stop > first AND stop - first >= 3")
def min_duration_spans(spark, sf_dir):
    out = O.long_enough(O.merge_gaps(_runs(spark, sf_dir), 1), 3)
    return out.select("rec", FR.frame_to_sample(F.col("first")).alias("first"), FR.frame_to_sample(F.col("stop")).alias("stop"))


@query("""WITH r AS (SELECT conv_id, turn, role, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM (SELECT DISTINCT conv_id, turn, role FROM conversations))
SELECT conv_id, role, min(turn) AS first, max(turn) + 1 AS stop FROM r GROUP BY conv_id, role, k""")
def role_runs(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role").distinct()
    return O.runs(turns.withColumn("on", F.lit(True)), ("conv_id", "role"), "turn")


@query(f"WITH {SEG_SQL}, t AS (SELECT rec, frames * 1000 AS total FROM sz), s AS (SELECT rec, unnest(list_distinct(list_concat(CASE WHEN total >= 16000 THEN range(0, total - 16000 + 1, 4000) ELSE [0] END, [greatest(0, total - 16000)]))) AS start FROM t) SELECT rec, start FROM s")
def plan_windows(spark, sf_dir):
    return O.plan_starts(sizes(spark, sf_dir).select("rec", (F.col("frames") * 1000).alias("total")), 16000, 4000)


@query(f"WITH {SEG_SQL} SELECT rec, CAST(chunk AS INTEGER) AS chunk, CAST(at AS INTEGER) AS at, frame FROM sg")
def window_frames(spark, sf_dir):
    return seg(spark, sf_dir).select("rec", "chunk", "at", "frame")


@query(f"WITH {SEG_SQL} SELECT rec, frame, round(avg(activity), 6) AS mean, count(*) AS overlaps FROM sg GROUP BY rec, frame")
def stitched_mean(spark, sf_dir):
    return O.stitched_mean(seg(spark, sf_dir), "activity").withColumn("mean", F.round("mean", 6))


_CNT = f"""pc AS (SELECT rec, chunk, at, sum(CASE WHEN activity >= {ONSET} THEN 1 ELSE 0 END) AS active FROM sg GROUP BY rec, chunk, at),
c0 AS (SELECT rec, chunk * {STEP} + at AS t, least(255, round_even(avg(active), 0)) AS cnt FROM pc GROUP BY 1, 2),
gr AS (SELECT rec, unnest(range(0, frames)) AS t FROM sz), cn AS (SELECT rec, t, CAST(coalesce(cnt, 0) AS INTEGER) AS cnt FROM gr LEFT JOIN c0 USING (rec, t))"""


def _counts(spark, sf_dir):
    return O.fill_grid(O.active_count(seg(spark, sf_dir), ONSET, CHUNK_STEP, FSTEP), sizes(spark, sf_dir))


@query(f"WITH {SEG_SQL}, {_CNT} SELECT rec, CAST(t AS INTEGER) AS t, cnt FROM cn")
def count_frames(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"WITH {SEG_SQL} SELECT rec, CAST(round_even(({SIZE * FSTEP}::DOUBLE + ((frames - 1) // {STEP}) * {CHUNK_STEP}::DOUBLE) / {FSTEP}::DOUBLE, 0) + 1 AS INTEGER) AS n FROM sz")
def output_frame_counts(spark, sf_dir):
    chunks = F.floor((F.col("frames") - 1) / STEP) + 1
    return sizes(spark, sf_dir).select("rec", FR.output_frames(chunks, SIZE * FSTEP, CHUNK_STEP, FSTEP).alias("n"))


@query(f"WITH {SEG_SQL} SELECT rec, frame, round(sum(activity * (0.54 - 0.46 * cos(2 * pi() * at / {SIZE - 1}))), 6) AS total FROM sg GROUP BY rec, frame")
def hamming_overlap_add(spark, sf_dir):
    return O.hamming_add(seg(spark, sf_dir), SIZE, "activity").withColumn("total", F.round("total", 6))


@query(f"WITH {SEG_SQL}, al AS (SELECT rec, chunk, at, count(*) AS n, min(slot) AS slot, min(activity) AS activity FROM sg WHERE activity > 0 GROUP BY rec, chunk, at) SELECT rec, CAST(chunk AS INTEGER) AS chunk, slot, round(sum(activity), 6) AS clean FROM al WHERE n = 1 GROUP BY rec, chunk, slot HAVING sum(activity) >= {0.2 * SIZE}")
def active_pairs(spark, sf_dir):
    return D.active_pairs(seg(spark, sf_dir), SIZE).withColumn("clean", F.round("clean", 6))


_SOFT_SLOT = "((rec * 31 + chunk * 17 + slot * 7 + cluster * 13) % 101) / 100.0"
_SOFT_GRID = "sl AS (SELECT DISTINCT rec, chunk FROM sg), so AS (SELECT rec, chunk, slot, cluster, ((rec * 31 + chunk * 17 + slot * 7 + cluster * 13) % 101) / 100.0::DOUBLE AS soft FROM sl, (SELECT unnest(range(3)) AS slot), (SELECT unnest(range(4)) AS cluster))"


def _soft(spark, sf_dir):
    cells = F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(c).alias("cluster")) for s in range(3) for c in range(4))))
    grid = seg(spark, sf_dir).select("rec", "chunk").distinct().select("rec", "chunk", cells.alias("x")).select("rec", "chunk", "x.*")
    return grid.withColumn("soft", F.expr(_SOFT_SLOT).cast("double"))


@query(f"WITH {SEG_SQL}, {_SOFT_GRID}, ac AS (SELECT rec, chunk, slot, sum(activity) AS a FROM sg GROUP BY ALL), lo AS (SELECT rec, min(soft) - 1 AS low FROM so GROUP BY rec) SELECT rec, CAST(chunk AS INTEGER) AS chunk, CAST(slot AS INTEGER) AS slot, CAST(cluster AS INTEGER) AS cluster, round(CASE WHEN coalesce(a, 0) = 0 THEN low ELSE soft END, 6) AS soft FROM so LEFT JOIN ac USING (rec, chunk, slot) JOIN lo USING (rec)")
def inactive_mask(spark, sf_dir):
    return D.mask_inactive(_soft(spark, sf_dir), seg(spark, sf_dir)).withColumn("soft", F.round("soft", 6))


_GRID = SEG_SQL + f""", {_CNT},
ha AS (SELECT DISTINCT rec, chunk, slot, (chunk + slot + rec) % 5 AS h FROM sg),
hd AS (SELECT rec, chunk, slot, CASE h WHEN 4 THEN -2 WHEN 3 THEN 11 ELSE h END AS cluster FROM ha),
cl AS (SELECT rec, chunk, at, cluster, max(activity) AS activity FROM sg JOIN hd USING (rec, chunk, slot) WHERE cluster >= 0 GROUP BY rec, chunk, at, cluster),
ov AS (SELECT rec, chunk * {STEP} + at AS t, cluster, sum(activity) AS activation FROM cl GROUP BY ALL),
mx AS (SELECT rec, greatest(max(cluster) + 1, any_value(c)) AS k FROM ov JOIN (SELECT rec, greatest(max(cnt), 1) AS c FROM cn GROUP BY rec) USING (rec) GROUP BY rec),
de AS (SELECT rec, t, cnt, unnest(range(0, CAST(k AS BIGINT))) AS cluster FROM cn JOIN mx USING (rec) WHERE cnt > 0),
tk AS (SELECT rec, t, cluster FROM (SELECT *, row_number() OVER (PARTITION BY rec, t ORDER BY coalesce(round(activation, 9), 0) DESC, cluster) AS r FROM de LEFT JOIN ov USING (rec, t, cluster)) WHERE r <= cnt),
ii AS (SELECT *, t - row_number() OVER (PARTITION BY rec, cluster ORDER BY t) AS g FROM tk),
ru AS (SELECT rec, cluster, min(t) AS f, max(t) + 1 AS s, any_value(frames) - 1 AS l FROM ii JOIN sz USING (rec) GROUP BY rec, cluster, g),
sp AS (SELECT rec, cluster, 0.0::DOUBLE + f * {FSTEP}::DOUBLE + {FDUR / 2}::DOUBLE AS st, 0.0::DOUBLE + least(s, l) * {FSTEP}::DOUBLE + {FDUR / 2}::DOUBLE AS en FROM ru WHERE least(s, l) > f),
s1 AS (SELECT *, CASE WHEN st - max(en) OVER (PARTITION BY rec, cluster ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {GAP} THEN 0 ELSE 1 END AS nw FROM sp),
s2 AS (SELECT rec, cluster, min(st) AS st, max(en) AS en FROM (SELECT *, sum(nw) OVER (PARTITION BY rec, cluster ORDER BY st, en) AS g FROM s1) GROUP BY rec, cluster, g)"""


@query(f"WITH {_GRID} SELECT rec, CAST(chunk AS INTEGER) AS chunk, CAST(at AS INTEGER) AS at, CAST(cluster AS INTEGER) AS cluster, activity FROM cl")
def clustered_max(spark, sf_dir):
    return O.clustered(seg(spark, sf_dir), hard(spark, sf_dir))


def _activation(spark, sf_dir):
    out = O.overlap_sum(O.clustered(seg(spark, sf_dir), hard(spark, sf_dir)), 0.0, CHUNK_STEP, 0.0, FDUR, FSTEP)
    return out.withColumn("activation", F.round("activation", 9))


@query(f"WITH {_GRID} SELECT rec, CAST(t AS INTEGER) AS t, CAST(cluster AS INTEGER) AS cluster, round(activation, 6) AS activation FROM ov")
def overlap_sum(spark, sf_dir):
    return _activation(spark, sf_dir).withColumn("activation", F.round("activation", 6))


def _grid(spark, sf_dir):
    return O.top_clusters(_activation(spark, sf_dir), _counts(spark, sf_dir))


@query(f"WITH {_GRID} SELECT rec, CAST(t AS INTEGER) AS t, CAST(cluster AS INTEGER) AS cluster FROM tk")
def topk_binarize(spark, sf_dir):
    return _grid(spark, sf_dir)


def _spans(spark, sf_dir):
    return O.grid_to_spans(_grid(spark, sf_dir), sizes(spark, sf_dir), 0.0, FDUR, FSTEP, GAP)


@query(f"WITH {_GRID} SELECT rec, CAST(cluster AS INTEGER) AS cluster, round(st, 6) AS start, round(en, 6) AS stop FROM s2")
def spans(spark, sf_dir):
    return _spans(spark, sf_dir).select("rec", "cluster", F.round("start", 6).alias("start"), F.round("end", 6).alias("stop"))


@query(f"WITH {_GRID} SELECT rec, 'SPEAKER ' || rec || ' 1 ' || printf('%.3f', st) || ' ' || printf('%.3f', en - st) || ' <NA> <NA> SPEAKER_' || printf('%02d', dense_rank() OVER (PARTITION BY rec ORDER BY CAST(cluster AS VARCHAR)) - 1) || ' <NA> <NA>' AS line FROM s2")
def rttm_lines(spark, sf_dir):
    return O.rttm_lines(_spans(spark, sf_dir)).select("rec", "line")


@query(f"""WITH RECURSIVE {_GRID},
pk AS (SELECT rec, t, map_from_entries(list((cluster, round(activation, 9)))) AS a FROM ov GROUP BY rec, t),
fa AS (SELECT rec, t, cnt, CAST(k AS BIGINT) AS k, a FROM cn JOIN mx USING (rec) LEFT JOIN pk USING (rec, t)),
go AS (SELECT rec, -1::BIGINT AS t, []::BIGINT[] AS chosen FROM mx
  UNION ALL SELECT f.rec, f.t, list_transform(list_sort(list_transform(range(f.k), lambda c: {{'e': -(coalesce(f.a[c], 0.0) + CASE WHEN list_contains(go.chosen, c) THEN 0.1 ELSE 0.0 END), 'r': -coalesce(f.a[c], 0.0), 'c': c}}))[1:f.cnt], lambda x: x.c)
  FROM go JOIN fa f ON f.rec = go.rec AND f.t = go.t + 1)
SELECT rec, CAST(t AS INTEGER) AS t, CAST(unnest(chosen) AS INTEGER) AS cluster FROM go""")
def topk_smoothed(spark, sf_dir):
    return O.smoothed_top(_activation(spark, sf_dir), _counts(spark, sf_dir), 0.1)


_SLOT_SQL = SEG_SQL + """,
em AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), nv AS (SELECT max(vec_id) + 1 AS n FROM em),
sl AS (SELECT DISTINCT rec, chunk, slot FROM sg), ve AS (SELECT rec, chunk, slot, e FROM sl, nv JOIN em ON vec_id = (rec * 37 + chunk * 3 + slot) % n),
ce AS (SELECT vec_id AS cluster, e AS c FROM em WHERE vec_id < 4),
so AS (SELECT rec, chunk, slot, cluster, round(list_cosine_similarity(e, c), 9) AS soft FROM ve, ce)"""


def _slot_vectors(spark, sf_dir):
    """rec, chunk, slot, embedding: a vector for each slot that a chunk has; some chunks have one or two."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    n = v.agg(F.max("vec_id") + 1).first()[0] or 1
    slots = seg(spark, sf_dir).select("rec", "chunk", "slot").distinct()
    return slots.withColumn("vec_id", F.pmod(F.col("rec") * 37 + F.col("chunk") * 3 + F.col("slot"), F.lit(n)).cast("long")).join(v, "vec_id").select("rec", "chunk", "slot", "embedding")


@query(f"""WITH {_SLOT_SQL}, op AS (SELECT rec, chunk, slot, cluster, soft FROM so UNION ALL (SELECT DISTINCT c.rec, c.chunk, s.slot, -2, 0.0::DOUBLE FROM sl c, (SELECT unnest(range(3)) AS slot) s WHERE (c.rec, c.chunk, s.slot) NOT IN (SELECT (rec, chunk, slot) FROM sl))),
al AS (SELECT x.rec, x.chunk, x.cluster AS a, y.cluster AS b, z.cluster AS c, 0.0 + x.soft + y.soft + z.soft AS total
  FROM op x JOIN op y USING (rec, chunk) JOIN op z USING (rec, chunk) WHERE x.slot = 0 AND y.slot = 1 AND z.slot = 2 AND (x.cluster <> y.cluster OR x.cluster = -2) AND (x.cluster <> z.cluster OR x.cluster = -2) AND (y.cluster <> z.cluster OR y.cluster = -2)),
bs AS (SELECT *, row_number() OVER (PARTITION BY rec, chunk ORDER BY total DESC) AS n FROM al)
SELECT rec, CAST(chunk AS INTEGER) AS chunk, CAST(unnest(range(3)) AS INTEGER) AS slot, CAST(unnest([a, b, c]) AS INTEGER) AS cluster FROM bs WHERE n = 1""")
def lsap_assign(spark, sf_dir):
    """Chunks of one to three slots, four clusters, and cosines as scores."""
    first = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id < 4").select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("centroid"))
    a, b = F.col("embedding"), F.col("centroid")
    cosine = V.dot(a, b) / (F.sqrt(V.sum_squares(a)) * F.sqrt(V.sum_squares(b)))
    # Four rows, by the filter.
    scored = _slot_vectors(spark, sf_dir).join(F.broadcast(first))
    return assign_slots(scored.select("rec", "chunk", "slot", "cluster", F.round(cosine, 9).alias("soft")))


#: The greedy merging of the closest pairs, one a step; a merged pair stays, far apart, so that its step is told.
_MERGE_SQL = VEC_SQL + """,
st AS (SELECT a.rec, 0 AS step, a.i AS a, b.i AS b, 1 - greatest(0, list_cosine_similarity(a.e, b.e)) AS d, 1.0::DOUBLE AS w, -1 AS x, -1 AS y FROM v a JOIN v b ON a.rec = b.rec AND a.i < b.i
  UNION ALL SELECT rec, step + 1, least(p, q), greatest(p, q), CASE WHEN p = q THEN 9.0::DOUBLE ELSE sum(d * w) / sum(w) END, sum(w), x, y FROM (
    SELECT rec, step, d, w, n.x AS x, n.y AS y, CASE WHEN a = n.y THEN n.x ELSE a END AS p, CASE WHEN b = n.y THEN n.x ELSE b END AS q
    FROM (SELECT *, min({'d': round(d, 9), 'x': a, 'y': b}) OVER (PARTITION BY rec) AS n FROM st) WHERE n.d < 0.85)
  GROUP BY rec, step, x, y, p = q, least(p, q), greatest(p, q)),
mg AS (SELECT DISTINCT rec, x, y FROM st WHERE x >= 0),
up AS (SELECT rec, i, i AS r, 0 AS k FROM v UNION ALL SELECT up.rec, up.i, mg.x, k + 1 FROM up JOIN mg ON mg.rec = up.rec AND mg.y = up.r),
rt AS (SELECT rec, i, arg_max(r, k) AS r FROM up GROUP BY rec, i)"""


@query(f"WITH RECURSIVE {_MERGE_SQL} SELECT rec, i, CAST(dense_rank() OVER (PARTITION BY rec ORDER BY r) - 1 AS INTEGER) AS label FROM rt")
def agglomerative_labels(spark, sf_dir):
    """All vectors of a label, by rounds of merges over all labels."""
    return R.agglomerate_vectors(vecs(spark, sf_dir), 0.85)


@query()
def ahc_labels(spark, sf_dir):
    return C.cluster(vecs(spark, sf_dir), "ahc", threshold=1.05)


@query()
def spectral_labels(spark, sf_dir):
    return C.cluster(vecs(spark, sf_dir), "spectral", target=4)


def _weights() -> Projection:
    return Projection.cosines(64, 32)


_PLDA_SQL = VEC_SQL + """, dm AS (SELECT d, cos(d) / 100 AS m1 FROM range(64) t(d)), om AS (SELECT o, sin(o) / 100 AS m2, cos(o) / 10 AS mu FROM range(32) t(o)),
x0 AS (SELECT rec, i, vec_id, unnest(e) AS x, unnest(range(64)) AS d FROM v), x1 AS (SELECT rec, i, vec_id, d, x - m1 AS x FROM x0 JOIN dm USING (d)), n1 AS (SELECT rec, i, sqrt(sum(x * x)) AS n FROM x1 GROUP BY rec, i),
la AS (SELECT d, o, sqrt(2 / 64.0::DOUBLE) * cos(pi() * (d + 0.5::DOUBLE) * (o + 1) / 64) AS w FROM range(64) t(d), range(32) s(o)),
y0 AS (SELECT rec, i, vec_id, o, sqrt(64.0::DOUBLE) * sum(x / n * w) AS y FROM x1 JOIN n1 USING (rec, i) JOIN la USING (d) GROUP BY ALL), y1 AS (SELECT rec, i, vec_id, o, y - m2 AS y, mu FROM y0 JOIN om USING (o)),
n2 AS (SELECT rec, i, sqrt(sum(y * y)) AS n FROM y1 GROUP BY rec, i), y2 AS (SELECT rec, i, vec_id, o, sqrt(32.0::DOUBLE) * y / n - mu AS y FROM y1 JOIN n2 USING (rec, i)),
ba AS (SELECT o, k, sqrt(2 / 32.0::DOUBLE) * cos(pi() * (o + 0.5::DOUBLE) * k / 32) / CASE WHEN k = 0 THEN sqrt(2.0::DOUBLE) ELSE 1 END AS w FROM range(32) t(o), range(32) s(k)),
pj AS (SELECT rec, i, vec_id, k, sum(y * w) AS x FROM y2 JOIN ba USING (o) GROUP BY rec, i, vec_id, k)"""


@query(f"WITH {_PLDA_SQL} SELECT rec, i, vec_id, CAST(k AS INTEGER) AS k, round(x, 6) + 0 AS x FROM pj")
def plda_project(spark, sf_dir):
    x = project(vecs(spark, sf_dir).select("rec", "i", "vec_id", "embedding"), _weights())
    return x.select("rec", "i", "vec_id", F.posexplode("x").alias("k", "x")).withColumn("x", F.round("x", 6) + 0)


@query()
def vbx_posterior(spark, sf_dir):
    w = _weights()
    return posteriors(project(vecs(spark, sf_dir).select("rec", "i", "embedding"), w), w.phi.tolist(), 1.05)


_PHI = [5.0 - 0.0625 * d for d in range(64)]
_EM = 4


def _em_sql(rounds: int) -> str:
    """Rounds of the refinement, unrolled, from labels i % 4."""
    fa, ratio, hot = 0.07, 0.07 / 0.8, f"(exp(7.0::DOUBLE) / (exp(7.0::DOUBLE) + {_EM - 1}))"
    parts = [VEC_SQL, f"ph AS (SELECT d, 5.0::DOUBLE - 0.0625::DOUBLE * d AS phi FROM range(64) t(d)), xs AS (SELECT rec, i, unnest(e) AS x, unnest(range(64)) AS d FROM v)",
        "rh AS (SELECT rec, i, d, x * sqrt(phi) AS r, phi FROM xs JOIN ph USING (d)), ow AS (SELECT rec, i, -0.5::DOUBLE * (sum(x * x) + 64 * ln(2 * pi())) AS own FROM xs GROUP BY rec, i)",
        f"g0 AS (SELECT rec, i, s, CASE WHEN i % {_EM} = s THEN {hot} ELSE 1 / (exp(7.0::DOUBLE) + {_EM - 1}) END AS g FROM v, range({_EM}) t(s)), w0 AS (SELECT DISTINCT rec, s, 1.0::DOUBLE / {_EM} AS w FROM g0)"]
    for k in range(1, rounds + 1):
        parts += [
            f"n{k} AS (SELECT rec, s, sum(g) AS n FROM g{k - 1} GROUP BY rec, s), f{k} AS (SELECT rec, s, d, any_value(phi) AS phi, sum(g * r) AS f FROM g{k - 1} JOIN rh USING (rec, i) GROUP BY rec, s, d)",
            f"m{k} AS (SELECT rec, s, d, phi, 1 / (1 + {ratio!r}::DOUBLE * n * phi) AS va, {ratio!r}::DOUBLE / (1 + {ratio!r}::DOUBLE * n * phi) * f AS me FROM f{k} JOIN n{k} USING (rec, s))",
            f"c{k} AS (SELECT rec, s, 0.5::DOUBLE * sum((va + me * me) * phi) AS half, sum(ln(va) - va - me * me + 1) AS gain FROM m{k} GROUP BY rec, s), d{k} AS (SELECT rec, i, s, sum(r * me) AS dot FROM rh JOIN m{k} USING (rec, d) GROUP BY rec, i, s)",
            f"p{k} AS (SELECT rec, i, s, {fa}::DOUBLE * (dot - half + own) + ln(w + 1e-8::DOUBLE) AS p FROM d{k} JOIN c{k} USING (rec, s) JOIN ow USING (rec, i) JOIN w{k - 1} USING (rec, s))",
            f"t{k} AS (SELECT rec, i, max(p) + ln(sum(exp(p - m))) AS t FROM (SELECT *, max(p) OVER (PARTITION BY rec, i) AS m FROM p{k}) GROUP BY rec, i)",
            f"g{k} AS (SELECT rec, i, s, exp(p - t) AS g FROM p{k} JOIN t{k} USING (rec, i)), w{k} AS (SELECT rec, s, sum(g) / count(*) AS w FROM g{k} GROUP BY rec, s)",
        ]
    return f"""WITH {", ".join(parts)}, bd AS (SELECT rec, sum(t) AS t FROM t{rounds} GROUP BY rec), gn AS (SELECT rec, 0.8::DOUBLE * 0.5 * sum(gain) AS gain FROM c{rounds} GROUP BY rec)
SELECT rec, i, CAST(s AS INTEGER) AS cluster, round(g, 6) AS gamma, round(w, 6) AS pi, round(t + gain, 4) AS bound FROM g{rounds} JOIN w{rounds} USING (rec, s) JOIN bd USING (rec) JOIN gn USING (rec)"""


@query(_em_sql(3))
def vbx_rounds(spark, sf_dir):
    """Three rounds from given labels, over all vectors of a label."""
    v = vecs(spark, sf_dir).select("rec", "i", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    first = R.soften(v.select("rec", "i", (F.col("i") % _EM).alias("label")))
    out = R.refine_rounds(v.join(first, ["rec", "i"]), _PHI, rounds=3, least_gain=-float("inf"))
    each = out.select("rec", "i", "bound", F.posexplode(F.arrays_zip(F.col("gamma").alias("g"), F.transform("gamma", lambda g, k: F.get("pi", k)).alias("w"))).alias("cluster", "x"))
    return each.select("rec", "i", "cluster", F.round("x.g", 6).alias("gamma"), F.round("x.w", 6).alias("pi"), F.round("bound", 4).alias("bound"))


_UNIT = "list_transform({0}, lambda y: y * (1 / greatest(sqrt(list_dot_product({0}, {0})), 1e-12::DOUBLE)))"


@query(f"""WITH RECURSIVE {VEC_SQL}, vu AS (SELECT rec, i, vec_id, {_UNIT.format("e")} AS u, (vec_id % 5) / 2.0::DOUBLE AS dur FROM v),
o AS (SELECT DISTINCT rec, CAST(-1 AS INTEGER) AS i, NULL::BIGINT AS vec_id, []::DOUBLE[][] AS c, []::DOUBLE[][][] AS h, NULL::VARCHAR AS decision, NULL::BIGINT AS speaker FROM v
  UNION ALL SELECT rec, i, vec_id, CASE WHEN close_ THEN list_transform(c, lambda x, j: CASE WHEN j = k THEN {_UNIT.format("mixed_")} ELSE x END) WHEN decision = 'new' THEN list_append(c, u) ELSE c END,
    CASE WHEN close_ THEN list_transform(h, lambda x, j: CASE WHEN j = k THEN hk ELSE x END) WHEN decision = 'new' THEN list_append(h, [u]) ELSE h END, decision, CASE decision WHEN 'existing' THEN k WHEN 'new' THEN len(c) + 1 END
  FROM (SELECT *, list_transform(range(1, 65), lambda d: 0.9::DOUBLE * um[d] + 0.1::DOUBLE * u[d]) AS mixed_ FROM (SELECT *, {_UNIT.format("mean_")} AS um FROM (
    SELECT *, CASE WHEN close_ THEN list_transform(range(1, 65), lambda d: list_sum(list_transform(hk, lambda w: w[d])) / len(hk)) ELSE u END AS mean_ FROM (
      SELECT *, CASE WHEN len(h[k]) >= 50 THEN list_append(h[k][2:], u) ELSE list_append(h[k], u) END AS hk, dm < 0.56 AND list_dot_product(u, u) > 0.01 AS close_, CASE WHEN dm < 0.84 THEN 'existing' WHEN dur >= 1 THEN 'new' ELSE 'dropped' END AS decision FROM (
        SELECT *, coalesce(list_min(ds), 9) AS dm, coalesce(list_position(ds, list_min(ds)), 0) AS k FROM (
          SELECT o.rec, n.i, n.vec_id, n.u, n.dur, o.c, o.h, list_transform(o.c, lambda x: 1 - greatest(-1, least(1, list_dot_product(x, n.u)))) AS ds FROM o JOIN vu n ON n.rec = o.rec AND n.i = o.i + 1)))))))
SELECT rec, vec_id, decision, coalesce(speaker, 0) AS speaker FROM o WHERE i >= 0""")
def online_assign(spark, sf_dir):
    """Speakers count from 1; a vector that is dropped has 0."""
    out = C.online_assign(vecs(spark, sf_dir).withColumn("duration", (F.col("vec_id") % 5).cast("double") / 2), speaker_threshold=0.84, embedding_threshold=0.56)
    return out.withColumn("speaker", F.coalesce("speaker", F.lit(0)).cast("long"))


@query(f"""WITH {VEC_SQL}, fr AS (SELECT vec_id, f, k, e[(f * 160 + k) % 64 + 1] * 32768 AS x FROM v, range(2) a(f), range(400) b(k)), mn AS (SELECT vec_id, f, avg(x) AS m FROM fr GROUP BY vec_id, f),
ce AS (SELECT vec_id, f, k, x - m AS x FROM fr JOIN mn USING (vec_id, f)), pe AS (SELECT vec_id, f, k, (x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY vec_id, f ORDER BY k), x)) * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * k / 399)) AS x FROM ce),
tw AS (SELECT b, k, cos(2 * pi() * (b * k % 512) / 512) AS c, sin(2 * pi() * (b * k % 512) / 512) AS s FROM range(256) t(b), range(400) u(k)),
pw AS (SELECT vec_id, f, b, pow(sum(x * c), 2) + pow(sum(x * s), 2) AS p FROM pe JOIN tw USING (k) GROUP BY vec_id, f, b),
ed AS (SELECT j, 1127.0::DOUBLE * ln(1 + 20 / 700.0::DOUBLE) + j * (1127.0::DOUBLE * ln(1 + 8000 / 700.0::DOUBLE) - 1127.0::DOUBLE * ln(1 + 20 / 700.0::DOUBLE)) / 81 AS m FROM range(82) t(j)),
bk AS (SELECT lo.j AS mel, b, greatest(0, least((at_ - lo.m) / (mi.m - lo.m), (hi.m - at_) / (hi.m - mi.m))) AS w FROM (SELECT b, 1127.0::DOUBLE * ln(1 + b * 31.25::DOUBLE / 700) AS at_ FROM range(256) t(b)), ed lo JOIN ed mi ON mi.j = lo.j + 1 JOIN ed hi ON hi.j = lo.j + 2),
en AS (SELECT vec_id, f, mel, ln(greatest(sum(p * w), pow(2.0::DOUBLE, -23))) AS l FROM pw JOIN bk USING (b) WHERE w > 0 GROUP BY vec_id, f, mel)
SELECT vec_id AS clip_id, CAST(f AS INTEGER) AS frame, CAST(mel AS INTEGER) AS mel, round(CAST(CAST(l - avg(l) OVER (PARTITION BY vec_id, mel) AS FLOAT) AS DOUBLE), 4) + 0 AS energy FROM en""")
def fbank_frames(spark, sf_dir):
    """Vectors as sound: each one ten times over is a clip of 640 samples."""
    clips = vecs(spark, sf_dir).select(F.col("vec_id").alias("clip_id"), F.flatten(F.array_repeat("embedding", 10)).alias("samples"))
    each = filter_banks(clips).select("clip_id", "frame", F.posexplode("mels").alias("mel", "energy"))
    return each.withColumn("energy", F.round(F.col("energy").cast("double"), 4) + 0)


@query()
def diarize_e2e(spark, sf_dir):
    s, emb = seg(spark, sf_dir), _slot_vectors(spark, sf_dir)
    return D.diarize(s, emb, sizes(spark, sf_dir), SIZE, CHUNK_STEP, FSTEP, FDUR, _weights(), D.DiarizeOptions(onset=ONSET, min_duration_off=GAP, threshold=1.05, rounds=3))


#: Scores of windows: a label's vectors, seven values a frame and nine frames a window, every four frames.
_SCORES = VEC_SQL + """, wn AS (SELECT rec, i AS w, CAST(floor((i * 4 * 160000 + 294) / 589) AS BIGINT) AS start, e FROM v),
fr AS (SELECT rec, w, start, unnest(range(9)) AS frame, e FROM wn), lg AS (SELECT rec, w, start, frame, list_transform(e[frame * 7 + 1:frame * 7 + 7], lambda x: x * 12) AS l FROM fr),
pb AS (SELECT rec, w, start, frame, list_transform(l, lambda y: exp(y) / list_sum(list_transform(l, lambda z: exp(z)))) AS p FROM lg),
tt AS (SELECT rec, CAST(floor(((max(w) * 4 + 9) * 160000 + 294) / 589) AS BIGINT) AS total FROM wn GROUP BY rec)"""


def _windows(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double") * 12)
    logits = F.array(*(F.slice(e, 7 * k + 1, 7) for k in range(9)))
    return vecs(spark, sf_dir).select("rec", FR.frame_to_sample(F.col("i") * 4).cast("long").alias("start"), logits.alias("logits"))


def _totals(spark, sf_dir):
    return vecs(spark, sf_dir).groupBy("rec").agg(FR.frame_to_sample(F.max("i") * 4 + 9).cast("long").alias("total"))


@query(f"""WITH {_SCORES}, sl AS (SELECT rec, start, frame, s AS slot, round(CASE s WHEN 0 THEN p[2] + p[5] + p[6] WHEN 1 THEN p[3] + p[5] + p[7] ELSE p[4] + p[6] + p[7] END, 9) AS q FROM pb, (SELECT unnest(range(3)) AS s)),
hy AS (SELECT rec, start, slot, frame, coalesce(last_value(CASE WHEN q >= 0.5 THEN true WHEN q < 0.357 THEN false END IGNORE NULLS) OVER (PARTITION BY rec, start, slot ORDER BY frame ROWS UNBOUNDED PRECEDING), false) AS o FROM sl),
il AS (SELECT *, frame - row_number() OVER (PARTITION BY rec, start, slot ORDER BY frame) AS k FROM hy WHERE o),
rn AS (SELECT rec, start, slot, min(frame) AS f, max(frame) + 1 AS s FROM il GROUP BY rec, start, slot, k)
SELECT rec, start, CAST(slot AS INTEGER) AS slot, least(start + CAST(floor((f * 160000 + 294) / 589) AS BIGINT), total) AS first, least(start + CAST(floor((s * 160000 + 294) / 589) AS BIGINT), total) AS stop FROM rn JOIN tt USING (rec)
WHERE least(start + floor((s * 160000 + 294) / 589), total) - least(start + floor((f * 160000 + 294) / 589), total) > 0""")
def speaker_activities(spark, sf_dir):
    scores = G.frame_scores(G.checked(_windows(spark, sf_dir), 9)).withColumn("slots", F.transform("slots", lambda x: F.round(x, 9)))
    return G.speaker_activities(scores, _totals(spark, sf_dir))


@query(f"""WITH {_SCORES}, pl AS (SELECT rec, CAST(floor(start * 589 / 160000) AS BIGINT) + frame AS frame, round(1 - p[1], 9) AS q FROM pb), mn AS (SELECT rec, frame, round(avg(q), 9) AS q FROM pl GROUP BY rec, frame),
gr AS (SELECT rec, unnest(range(0, CAST(ceil(total * 589 / 160000) AS BIGINT))) AS frame FROM tt), de AS (SELECT rec, frame, coalesce(q, 0) AS q FROM gr LEFT JOIN mn USING (rec, frame)),
hy AS (SELECT rec, frame, coalesce(last_value(CASE WHEN q >= 0.8 THEN true WHEN q < 0.7 THEN false END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY frame ROWS UNBOUNDED PRECEDING), false) AS o FROM de),
il AS (SELECT *, frame - row_number() OVER (PARTITION BY rec ORDER BY frame) AS k FROM hy WHERE o),
rn AS (SELECT rec, least(CAST(floor((min(frame) * 160000 + 294) / 589) AS BIGINT), any_value(total)) AS first, least(CAST(floor(((max(frame) + 1) * 160000 + 294) / 589) AS BIGINT), any_value(total)) AS stop FROM il JOIN tt USING (rec) GROUP BY rec, k),
mk AS (SELECT *, CASE WHEN first - max(stop) OVER (PARTITION BY rec ORDER BY first, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 300 THEN 0 ELSE 1 END AS nw FROM rn),
mg AS (SELECT rec, min(first) AS first, max(stop) AS stop FROM (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY first, stop) AS g FROM mk) GROUP BY rec, g)
SELECT rec, first, stop FROM mg WHERE stop > first AND stop - first >= 500""")
def voice_spans(spark, sf_dir):
    scores = G.frame_scores(G.checked(_windows(spark, sf_dir), 9)).withColumn("voice", F.round("voice", 9))
    return G.voice_spans(scores, _totals(spark, sf_dir), 0.8, 0.7, 300, 500)
