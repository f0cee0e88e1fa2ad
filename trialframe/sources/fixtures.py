"""Cubes, predictions and weights derived from the benchmark tables, as DataFrames and as SQL.

dense: embeddings as trials (label mod 2 as class) of 16 frames by 4 pixels. sparse: lineitem as
sessions, conditions (3 is the blank), trials, frames and pixels. predictions: scores of 8 frames a
trial. wide: embeddings as one frame of 64 pixels. The SQL names are those of the CTEs in SQL below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DENSE_FRAMES, DENSE_PIXELS, BLANK = 16, 4, 3
ROI = (0, 1, 3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("trial"), (F.col("label") % 2).cast("int").alias("y"), F.posexplode("embedding").alias("i", "v"))
    return e.select("trial", "y", F.expr("cast(i div 4 as int)").alias("frame"), (F.col("i") % 4).alias("pixel"), F.col("v").cast("double").alias("value"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made once: a cube is stored before it is worked on, and its few cells cost a scan of all of lineitem."""
    from ..operators.held import made_once

    item = table(spark, sf_dir, "lineitem")
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    keys = [
        F.col("l_returnflag").alias("session"), (1 + F.col("l_suppkey") % 5).cast("int").alias("cond"), F.col("l_linenumber").cast("int").alias("trial"),
        (month % 16).cast("int").alias("frame"), (F.col("l_partkey") % 4).cast("int").alias("pixel"),
    ]
    return made_once(item.groupBy(*keys).agg(F.avg("l_extendedprice").cast("double").alias("value")))


def sparse_without_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sparse with session A as if its blank had never been recorded."""
    return sparse(spark, sf_dir).where(f"session <> 'A' or cond <> {BLANK}")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("trial"), (F.col("label") % 2).cast("int").alias("y_true"), "embedding")
    from ..operators.folds import modulo_folds

    fold = modulo_folds(e, 10)
    score = F.expr("aggregate(slice(embedding, frame * 8 + 1, 8), 0D, (a, x) -> a + cast(x as double)) / 8D")
    s = e.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("trial", "frame", "y_true", score.alias("score"))
    return s.join(fold, "trial").select("trial", "frame", "fold", "y_true", (F.col("score") > 0).cast("int").alias("y_pred"), "score")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("trial"), (F.col("label") % 2).cast("int").alias("y"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight embeddings in turn are the frames, 64 pixels each, of a trial; the parity of their labels' sum is its class."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("cast(vec_id div 8 as int)").alias("trial"), (F.col("vec_id") % 8).cast("int").alias("frame"), "label", "embedding")
    y = e.groupBy("trial").agg((F.sum("label") % 2).cast("int").alias("y"))
    return e.join(y, "trial").select("trial", "y", "frame", F.posexplode("embedding").alias("pixel", "v")).select("trial", "y", "frame", "pixel", F.col("v").cast("double").alias("value"))


def roi(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in ROI], "pixel int")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weights(fold, window, pixel, w): class differences of 64 components, trials modulo 5 as fold, modulo 6 as window."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), (F.col("label") % 2).alias("y"), F.posexplode("embedding").alias("pixel", "v"))
    mean = lambda y: F.avg(F.when(F.col("y") == y, F.col("v").cast("double")))
    return e.groupBy((F.col("vec_id") % 5).cast("int").alias("fold"), (F.col("vec_id") % 6).cast("int").alias("window"), "pixel").agg((mean(1) - mean(0)).alias("w"))


def c_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid(c, fold, metric): accuracy per fold of the predictions at seven score thresholds, as if each were a C."""
    p = predictions(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(6))))
    hit = ((F.col("score") > (F.col("j") - 3) * F.lit(0.01)).cast("int") == F.col("y_true")).cast("double")
    return p.groupBy("j", "fold").agg(F.avg(hit).alias("metric")).select((F.pow(F.lit(10.0), F.col("j") - 4)).alias("c"), "fold", "metric")


def window_scores(spark: SparkSession, sf_dir: str):
    """(null, real): per permutation and window, and per window, the share of frames whose sign is the label."""
    from ..operators.significance import permuted_labels

    p = predictions(spark, sf_dir).select("trial", F.col("frame").alias("window"), "y_pred", "y_true")
    perms = permuted_labels(trials(spark, sf_dir), 20)
    null = p.join(perms, "trial").groupBy("perm", "window").agg(F.avg((F.col("y_pred") == F.col("y_perm")).cast("double")).alias("score"))
    real = p.groupBy("window").agg(F.avg((F.col("y_pred") == F.col("y_true")).cast("double")).alias("score"))
    return null, real


#: The same tables as common table expressions of DuckDB.
SQL = {
    "dense": """SELECT CAST(vec_id AS INTEGER) AS trial, CAST(label % 2 AS INTEGER) AS y, CAST(i // 4 AS INTEGER) AS frame, CAST(i % 4 AS INTEGER) AS pixel,
        CAST(embedding[i + 1] AS DOUBLE) AS value FROM (SELECT vec_id, label, unnest(range(0, 64)) AS i, embedding FROM embeddings)""",
    "sparse": """SELECT l_returnflag AS session, CAST(1 + l_suppkey % 5 AS INTEGER) AS cond, CAST(l_linenumber AS INTEGER) AS trial,
        CAST(((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) % 16 AS INTEGER) AS frame, CAST(l_partkey % 4 AS INTEGER) AS pixel,
        CAST(avg(l_extendedprice) AS DOUBLE) AS value FROM lineitem GROUP BY ALL""",
    "predictions": """SELECT trial, frame, CAST((dense_rank() OVER (ORDER BY trial) - 1) % 10 AS INTEGER) AS fold, y_true, CAST(score > 0 AS INTEGER) AS y_pred, score
        FROM (SELECT CAST(vec_id AS INTEGER) AS trial, CAST(f AS INTEGER) AS frame, CAST(label % 2 AS INTEGER) AS y_true,
        list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding[f * 8 + 1 : f * 8 + 8], lambda x: CAST(x AS DOUBLE))), lambda a, b: a + b) / 8.0::DOUBLE AS score
        FROM (SELECT vec_id, label, unnest(range(0, 8)) AS f, embedding FROM embeddings))""",
    "trials": "SELECT CAST(vec_id AS INTEGER) AS trial, CAST(label % 2 AS INTEGER) AS y FROM embeddings",
    "roi": "SELECT CAST(unnest([0, 1, 3]) AS INTEGER) AS pixel",
    "weights": """SELECT CAST(vec_id % 5 AS INTEGER) AS fold, CAST(vec_id % 6 AS INTEGER) AS "window", CAST(i AS INTEGER) AS pixel,
        avg(CAST(embedding[i + 1] AS DOUBLE)) FILTER (label % 2 = 1) - avg(CAST(embedding[i + 1] AS DOUBLE)) FILTER (label % 2 = 0) AS w
        FROM (SELECT vec_id, label, unnest(range(0, 64)) AS i, embedding FROM embeddings) GROUP BY ALL""",
    "c_grid": """SELECT pow(10.0, j - 4) AS c, fold, avg(CAST(CAST(score > (j - 3) * 0.01::DOUBLE AS INTEGER) = y_true AS DOUBLE)) AS metric
        FROM predictions, (SELECT unnest(range(0, 7)) AS j) GROUP BY j, fold""",
    "perms": """SELECT CAST(p.perm AS INTEGER) AS perm, p.trial, t.y AS y_perm
        FROM (SELECT perm, trial, row_number() OVER (PARTITION BY perm ORDER BY md5(concat(CAST(perm AS VARCHAR), ':', CAST(trial AS VARCHAR)))) AS rk FROM trials, range(0, 20) r(perm)) p
        JOIN (SELECT trial, y, row_number() OVER (ORDER BY trial) AS rk FROM trials) t USING (rk)""",
    "null_scores": """SELECT perm, frame AS "window", avg(CAST(y_pred = y_perm AS DOUBLE)) AS score FROM predictions JOIN perms USING (trial) GROUP BY ALL""",
    "real_scores": """SELECT frame AS "window", avg(CAST(y_pred = y_true AS DOUBLE)) AS score FROM predictions GROUP BY ALL""",
}


def with_tables(*names: str) -> str:
    """A WITH clause of the named tables, to which more can be added after a comma."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
