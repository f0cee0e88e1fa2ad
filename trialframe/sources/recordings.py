"""Recordings as cubes, one row per cell: array files, masks, the Parquet store."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import ArrayCubes


def _array_cubes(spark: SparkSession, path: str, kind: str, task_bytes: int | None) -> DataFrame:
    spark.dataSource.register(ArrayCubes)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the source needs it, and so says Spark otherwise
    reader = spark.read.format("arraycubes").option("kind", kind)
    return (reader.option("taskBytes", task_bytes) if task_bytes else reader).load(path)


def read_mat_cubes(spark: SparkSession, path: str, task_bytes: int | None = None) -> DataFrame:
    """Cells of all variables cond<N> in the MAT level 5 files conds_<session>.mat below path.

    Tasks take the variables that begin in their bytes of a file; a compressed one is inflated as a stream.
    """
    return _array_cubes(spark, path, "mat", task_bytes)


def read_npy_cubes(spark: SparkSession, path: str, task_bytes: int | None = None) -> DataFrame:
    """Cells of the files conds<cond>_<session>.npy below path, in tasks of task_bytes each; see arrays.py."""
    return _array_cubes(spark, path, "npy", task_bytes)


def read_npy_mask(spark: SparkSession, path: str) -> DataFrame:
    """roi(pixel): the true pixels of a mask file."""

    def rows(frames):
        for f in frames:
            for content in f["content"]:
                mask = np.load(io.BytesIO(content), allow_pickle=False).astype(bool).reshape(-1)
                yield pd.DataFrame({"pixel": np.flatnonzero(mask).astype(np.int32)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "pixel int")


def write_cube(cube: DataFrame, path: str, overwrite: bool = False, skip_existing: bool = False) -> None:
    """Cubes as Parquet by session and condition.

    An existing path is an error; overwrite replaces it, skip_existing leaves it and writes nothing.
    """
    if overwrite and skip_existing:
        raise ValueError("give either overwrite or skip_existing")
    mode = "overwrite" if overwrite else "ignore" if skip_existing else "errorifexists"
    cube.withColumn("value", F.col("value").cast("float")).repartition("session", "cond", "trial").write.mode(mode).partitionBy("session", "cond").parquet(path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """Cubes of write_cube; filters on session and cond prune folders."""
    return spark.read.parquet(path).withColumn("value", F.col("value").cast("double"))
