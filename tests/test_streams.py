import pandas as pd
from pyspark.sql import functions as F

from turnlake.operators import frames as O
from turnlake.operators.clustering import online_assign
from turnlake.sources.rttm import read_rttm, write_rttm
from turnlake.sources.tensors import pack_activity, unpack_activity
from turnlake.streaming.segment import stream_speakers, stream_spans


def run(stream, name, spark, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).toPandas()


def parts(df, spark, tmp_path, n=2):
    """df as a stream of n files, one a batch, in order."""
    for k in range(n):
        df.filter(f"part = {k}").drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_spans_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(r, k, float(p)) for r in (1, 2, 3) for k, p in enumerate(rng.random(200))]
    df = spark.createDataFrame(rows, "rec long, frame long, p double")
    want = O.long_enough(O.merge_gaps(O.runs(O.hysteresis(df, 0.7, 0.3)), 1), 2).toPandas()
    stream = parts(df.withColumn("last", F.col("frame") == 199).withColumn("part", (F.col("frame") >= 90).cast("int")), spark, tmp_path)
    got = run(stream_spans(stream, 0.7, 0.3, 1, 2), "spans_out", spark, tmp_path)
    key = ["rec", "first", "stop"]
    assert got[key].sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()


def test_speakers_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(r, k, [float(x) for x in rng.normal(size=4)], 2.0) for r in (1, 2) for k in range(30)]
    df = spark.createDataFrame(rows, "rec long, vec_id long, embedding array<double>, duration double")
    want = online_assign(df).toPandas()
    stream = parts(df.withColumn("part", (F.col("vec_id") >= 13).cast("int")), spark, tmp_path)
    got = run(stream_speakers(stream), "speakers_out", spark, tmp_path)
    key = ["rec", "vec_id"]
    assert got.sort_values(key)["speaker"].tolist() == want.sort_values(key)["speaker"].tolist()


def test_rttm_round_trip(spark, tmp_path):
    spans = spark.createDataFrame([(1, 0, 0.5, 1.25), (1, 1, 1.0, 2.0)], "rec long, cluster int, start double, end double")
    write_rttm(O.rttm_lines(spans), str(tmp_path / "out"))
    got = read_rttm(spark, str(tmp_path / "out")).orderBy("start").collect()
    assert [(r["uri"], r["start"], r["duration"], r["speaker"]) for r in got] == [("1", 0.5, 0.75, "SPEAKER_00"), ("1", 1.0, 1.0, "SPEAKER_01")]


def test_packed_activity(spark):
    packed = spark.createDataFrame([(1, 0, [[0.0, 0.5, 0.0], [1.0, 0.0, 0.25]])], "rec long, chunk int, activity array<array<double>>")
    seg = unpack_activity(packed)
    assert seg.count() == 3
    assert pack_activity(seg, 2).first()["activity"] == [[0.0, 0.5, 0.0], [1.0, 0.0, 0.25]]
    assert isinstance(seg.toPandas(), pd.DataFrame)
