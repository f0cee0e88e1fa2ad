"""Helpers that several training-data operators need: shared folders, row numbers, files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

_LOCAL_FALLBACK: dict[str, str] = {}
_LOW_33_BITS = (1 << 33) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    A private temporary folder is used only where that setting is absent and the session is local
    (tests on one machine); without the setting, a cluster session raises an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "path" not in _LOCAL_FALLBACK:
            _LOCAL_FALLBACK["path"] = "file://" + tempfile.mkdtemp(prefix="spark-")
        folder = _LOCAL_FALLBACK["path"]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that no column of df has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: short lineage, fixed rows."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = shared_folder(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath() + "/"):
            where.getFileSystem(conf).delete(where, True)


def ordered_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df range-sorted by `order` and materialized, with _pid and _idx (row in the partition, from 0).

    (_pid, _idx) follows the global order. The table is written before anything reads it, so the
    range boundaries, which Spark samples, are fixed for every later use.
    """
    tie = F.monotonically_increasing_id()  # rows that are equal in all columns part by their place in the input
    placed = df.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = placed.withColumn("_m", F.monotonically_increasing_id())
    return (
        materialize(placed, name)
        .withColumn("_pid", F.shiftright("_m", 33).cast("int"))
        .withColumn("_idx", F.col("_m").bitwiseAND(F.lit(_LOW_33_BITS)))
        .drop("_m")
    )


def running_base(per_partition: DataFrame, size: str, base: str) -> DataFrame:
    """Exclusive prefix sum of `size` over _pid. One row per partition, so small enough to broadcast."""
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    return per_partition.withColumn(base, F.coalesce(F.sum(size).over(before), F.lit(0)))


def with_row_numbers(df: DataFrame, order: list[Column], name: str, out: str = "row_no") -> DataFrame:
    """Global row numbers from 0 in the given order, without moving all rows through one task."""
    rows = ordered_rows(df, order, name)
    base = running_base(rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")), "_n", "_base").select("_pid", "_base")
    return rows.join(F.broadcast(base), "_pid").withColumn(out, F.col("_base") + F.col("_idx")).drop("_base")


def in_slices(batches, rows: int = 1000, most_bytes: int = 16 << 20):
    """Arrow batches cut to fewer rows and bytes, so that Python objects of a few rows exist at a time.

    A row that is larger by itself comes alone.
    """
    for batch in batches:
        parts = [batch.slice(i, rows) for i in range(0, batch.num_rows, rows)][::-1]
        while parts:
            part = parts.pop()
            if part.num_rows > 1 and part.nbytes > most_bytes:
                half = part.num_rows // 2
                parts += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def distinct_sample(rows: DataFrame, content: list[str], size: int, by: str | None = None, keep: list[Column] | None = None) -> DataFrame:
    """About `size` rows of distinct content, of each value of `by`, with their hash `_draw`: a rate that follows their number.

    Rows whose content repeats count once, so a hot row neither fills the sample nor empties it, and where
    there is a row there is one in the sample: the smallest hash is always drawn. Two scans; the driver
    gets a count per value of `by`. keep: what is kept of the drawn rows (else all columns) before they meet.
    """
    tagged = rows.withColumn("_draw", F.pmod(F.xxhash64(*content), F.lit(1 << 40)))
    of = F.lit(0) if by is None else F.col(by)
    counts = tagged.groupBy(of.alias("of")).agg(F.approx_count_distinct("_draw").alias("n"), F.min("_draw").alias("least")).collect()
    chosen = F.lit(False)
    for r in sorted(counts, key=lambda r: str(r["of"])):
        bar = max(int((1 << 40) * min(1.0, 1.2 * size / max(1, r.n))), r.least + 1)
        chosen = chosen | (of.eqNullSafe(F.lit(r["of"])) & (F.col("_draw") < F.lit(bar)))
    drawn = tagged.where(chosen)
    drawn = drawn if keep is None else drawn.select("_draw", *([by] if by else []), *keep)
    return drawn.dropDuplicates(["_draw", *([by] if by else [])])


FILE_END = b"\n"


def write_files(rows: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Write the binary column `bytes` as raw files through Spark's own writer: one per partition, or
    more if a partition has over rows_per_file rows (0: no bound).

    The text sink copies the bytes of each row unchanged and then adds one line feed, so every row
    of the formats written here ends in a place where a line feed belongs. Spark's commit protocol
    makes the files whole even when tasks are repeated.
    """
    rows.select(F.col("bytes").cast("string").alias("value")).write.option("maxRecordsPerFile", rows_per_file).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The files below path as rows (path, content). Writers bound a file's rows, and so its size."""
    schema = T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("modificationTime", T.TimestampType()),
            T.StructField("length", T.LongType()),
            T.StructField("content", T.BinaryType()),
        ]
    )
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "part-*").load(path)
    return files.where(F.col("length") > 0).select("path", "content")
