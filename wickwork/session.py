"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "wickwork", **more: str) -> SparkSession:
    """A session with SETTINGS and whatever else is given."""
    return SparkSession.builder.appName(name).config(map={**SETTINGS, **more}).getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir)."""
    import uuid

    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and spark.sparkContext.master.startswith("local["):  # one machine: tests and trials
            import tempfile

            named = tempfile.mkdtemp(prefix="spark-")
        if not named:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named)
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{known.get()}/{label}-{uuid.uuid4().hex}"


def stored(df, label: str, compression: str = "snappy"):
    """Write a table to the shared folder and read it again, so that later plans ask it as often as they like and survive lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
