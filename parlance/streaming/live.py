"""Plans over streams: filters and windowed counts with a watermark, by Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compile import Scope, condition
from ..plans.ir import PlanError, Query


def filtered(stream: DataFrame, q: Query) -> DataFrame:
    """The plan's filters and projection on a stream; joins, order and paging have no place there."""
    scope = Scope(stream, q.entity)
    out = scope.df
    for item in (*q.filters, *q.groups):
        out = out.where(condition(item, scope))
    return out.select(*[scope.col(f).alias(f) for f in q.fields]) if q.fields else out


def windowed(stream: DataFrame, time: str, every: str, late: str, *keys: str) -> DataFrame:
    """Counts by time window and keys; rows later than the watermark are dropped, and state with them."""
    ts = F.col(time).cast("timestamp")
    counted = stream.withColumn("__ts", ts).withWatermark("__ts", late).groupBy(F.window("__ts", every), *keys).count()
    return counted.select(F.col("window.start").alias("start"), *keys, F.col("count").alias("n"))


def windows_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of `events` by type, taken as a stream of its files until all are read."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counted = windowed(stream, "ts", "1 hour", LATE, "event_type")
    return finished(counted, f"windows_{uuid.uuid4().hex}").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


#: How late a row may come behind the latest one seen.
LATE = "7 days"


def finished(df: DataFrame, name: str) -> DataFrame:
    """Run a windowed stream over what is there now, in update mode, into Parquet files of the shared folder, and read them.

    Each batch writes the windows that it changed into a folder of its own, which a repeated batch overwrites; the last
    batch's count of a window holds. State behind the watermark is dropped, and nothing is kept in the driver.
    """
    spark = df.sparkSession
    place = f"{shared_dir(spark).rstrip('/')}/streams/{name}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/rows/batch={batch}")

    df.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    keys = [c for c in df.columns if c != "n"]
    changes = spark.read.schema(df.schema.add("batch", "long")).parquet(f"{place}/rows")
    return changes.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session is local."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise PlanError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="parlance-stream-")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())
