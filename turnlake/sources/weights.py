"""Weights of the projection as a source: one blob of little-endian doubles a table, checked by size, with their identity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clustering import EngineError
from ..operators.features import Projection


def shapes(dim: int = 256, out: int = 128) -> dict[str, tuple[int, ...]]:
    """The tables and their shapes, row by row; `tr` and `psi` are what eigenvectors_desc and phi_desc derive from."""
    return {"mean1": (dim,), "mean2": (out,), "lda": (dim, out), "mu": (out,), "tr": (out, out), "psi": (out,), "eigenvectors_desc": (out, out), "phi_desc": (out,)}


def read_weights(spark: SparkSession, folder: str, dim: int = 256, out: int = 128) -> DataFrame:
    """name, shape, values, bytes and sha256 of the blobs `<name>.bin` in a folder; files of other names are ignored.

    A blob of a wrong size fails with WrongSize, one that holds NaN or an infinity with NonFinite. The files are read by
    Spark, so the folder may be in any store that it reaches. An empty folder gives an empty table.
    """
    want = shapes(dim, out)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.bin$", 1)
    sizes = F.coalesce(*(F.when(F.col("name") == n, F.lit(8 * int(np.prod(s)))) for n, s in want.items()))
    blobs = files.select(name.alias("name"), F.col("length").alias("bytes"), "content").filter(F.col("name").isin(*want))
    wrong = F.raise_error(F.concat(F.lit("WrongSize: "), "name", F.lit(" has "), F.col("bytes").cast("string"), F.lit(" bytes, not "), sizes.cast("string")))
    blobs = blobs.withColumn("content", F.when(F.col("bytes") != sizes, wrong.cast("binary")).otherwise(F.col("content")))

    def doubles(batches):
        for batch in batches:
            values = [np.frombuffer(c, "<f8") for c in batch.column("content").to_pylist()]
            for n, v in zip(batch.column("name").to_pylist(), values, strict=True):
                if not np.isfinite(v).all():
                    raise EngineError("NonFinite", n)
            shape = pa.array([list(want[n]) for n in batch.column("name").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("name"), shape, pa.array(values, pa.list_(pa.float64())), batch.column("bytes"), batch.column("sha256")], names=["name", "shape", "values", "bytes", "sha256"])

    return blobs.select("name", "bytes", "content", F.sha2("content", 256).alias("sha256")).mapInArrow(doubles, "name string, shape array<int>, values array<double>, bytes long, sha256 string")


def identity(weights: DataFrame) -> DataFrame:
    """One row of the identity of a set of weights: how many tables, their bytes, and one SHA-256 over their names and sums in order of name."""
    each = F.sort_array(F.collect_list(F.concat_ws(":", "name", "sha256")))
    return weights.agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sha2(F.concat_ws("\n", each), 256).alias("sha256"))


def projection(weights: DataFrame) -> Projection:
    """The projection of a table of weights (name, shape, values): eight rows of a fixed size. A missing one fails with MissingWeights."""
    found = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in weights.select("name", "shape", "values").collect()}
    used = ("mean1", "mean2", "lda", "mu", "eigenvectors_desc", "phi_desc")
    if missing := [n for n in used if n not in found]:
        raise EngineError("MissingWeights", ", ".join(missing))
    return Projection(*(found[n] for n in used))
