"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one sorted chunk of a numbered group should hold.
CHUNK_ROWS = 5_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named in spark.checkpoint.dir."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and spark.sparkContext.master.startswith("local["):  # one machine: tests and trials
        import tempfile

        named = tempfile.mkdtemp(prefix="spark-")
    if not named:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; what is left there is deleted when the driver ends."""
    made = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of an Arrow batch while a table is stored: texts and their words are long.
BATCH_ROWS = 1_000


def stored(df: DataFrame, label: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write a table to the shared folder and read it again: later plans start from files that outlive executors. batch_rows: rows of an Arrow batch meanwhile."""
    path, conf, name = scratch_path(df.sparkSession, label), df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        conf.set(name, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by stored() once nothing reads them any more."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)


#: Plan nodes that hand on a stored row at most once.
ROW_BY_ROW = ("Project", "Filter", "SubqueryAlias")
#: File names that are broadcast at most to number rows.
BROADCAST_FILES = 100_000


def with_row_id(df: DataFrame, out: str = "_rid") -> DataFrame:
    """Adds a long that numbers rows by file and place in the file: the same at every scan, however the files are split or the cluster changes.

    A table that is not one scan of files, column selections and filters is stored first. out is replaced; other names that start with _ are reserved.
    """
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ROW_BY_ROW:
        node = node.children().head()
    df = df.drop(out)
    if not node.nodeName().startswith("LogicalRelation"):
        return stored(df.withColumn(out, F.monotonically_increasing_id()), "numbered")
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    names = placed.select("_file").distinct()
    files = names.select("_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("long").alias("_no"))
    small = F.broadcast(files) if names.count() <= BROADCAST_FILES else files
    return placed.join(small, "_file").select(*df.columns, (F.shiftleft("_no", 40) + F.col("_row")).alias(out))


#: Ids that are broadcast at most (eight bytes each), and bitmaps of 32,768 numbers (4 kB each).
BROADCAST_IDS, BROADCAST_BITMAPS = 300_000, 8_192


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose `key`, a long, is in ids (key). Few ids are broadcast; more are as bitmaps, a bit for each number of a stored row, so rows stay where they are. Only ids too many or too scattered for that are joined in a shuffle."""
    if ids.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), key, "left_semi")
    maps = stored(ids.groupBy(F.bitmap_bucket_number(key).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("_bits")), "bitmaps")
    if maps.count() > BROADCAST_BITMAPS:
        drop_stored(maps)
        return rows.join(ids, key, "left_semi")
    at = F.bitmap_bit_position(rows[key])
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return rows.join(F.broadcast(maps), (F.bitmap_bucket_number(rows[key]) == F.col("_bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1), "left_semi")


def unit(*parts) -> Column:
    """A reproducible number in [0, 1) from the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def chunk_bits(rows: int, chunk_rows: int = CHUNK_ROWS) -> int:
    """Bits of a uniform hash that cut this many rows into chunks of about chunk_rows."""
    return max(0, (max(rows, 1) // chunk_rows).bit_length())


def with_chunk(df: DataFrame, key: str, bits: int, out: str = "_chunk") -> DataFrame:
    """The leading bits of a uniform 64-bit hash: ranges of key, so chunk order is key order."""
    return df.withColumn(out, F.shiftrightunsigned(F.col(key), 64 - bits).cast("int") if bits else F.lit(0))


def running(df: DataFrame, group: list[str], chunk: str, order: list, total: str | None, out: str) -> DataFrame:
    """Running sum of a long column (or a 1-based row number) per group, in two levels.

    Only chunk totals are put in one order per group; rows are sorted inside one chunk of one group, so
    a group with a third of all rows spreads over all tasks. df must be stored: it is read twice.
    group columns must not be null. Rows that tie in order are interchangeable.
    """
    keys = [*group, chunk]
    what = F.lit(1) if total is None else F.col(total)
    sums = df.groupBy(*keys).agg(F.sum(what).cast("long").alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    here = F.row_number().over(inside) if total is None else F.sum(what).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return df.join(sums, keys).withColumn(out, (F.col("_before") + here).cast("long")).drop("_before")
