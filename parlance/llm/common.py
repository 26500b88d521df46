"""Shared plumbing: lineage cuts in the cluster's shared folder, bounded broadcasts, Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a
    temporary folder of its own; any other session is refused, since its executors would each write to their own disk.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="parlance-checkpoint-"))
    return sc.getCheckpointDir()


_CUTS: list[str] = []


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there, executors may be lost.

    The table is deleted when the driver ends, or by `sweep`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/parlance/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    _CUTS.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Delete the tables that `cut` made so far, once no result that reads them is wanted; returns their number."""
    done = 0
    while _CUTS:
        place = spark._jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        done += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    return done


def join_sized(df: DataFrame, side: DataFrame, on: list[str], how: str = "left", max_rows: int = 50_000) -> DataFrame:
    """Join with a broadcast of `side` if it is counted to hold at most `max_rows`, else by shuffle (AQE splits skew)."""
    if len(side.take(max_rows + 1)) <= max_rows if max_rows <= 1000 else side.limit(max_rows + 1).count() <= max_rows:
        side = F.broadcast(side)
    return df.join(side, on, how)


def join_hot(df: DataFrame, side: DataFrame, on: list[str], weight: str, total: int, least: int = 200, max_rows: int = 20_000) -> DataFrame:
    """Inner join with `side`, one row for each key, whose column `weight` says how many rows of `df` have the key.

    Keys of over max(least, total / max_rows) rows are met by broadcast: as the weights add up to `total`, there are at most
    `max_rows` of them, however large the tables. No other key has so many rows that one task could not take them.
    `side` is cut, as it is read up to three times: else each reading would be a part of the plan, and the driver's memory grows
    with plans. `df` is read twice where there are such keys.
    """
    bound = max(least, total // max_rows)
    side = cut(side, "side")
    if side.where(F.col(weight) > bound).isEmpty():
        return df.join(side.drop(weight), on)
    hot, rest = side.where(F.col(weight) > bound).drop(weight), side.where(F.col(weight) <= bound).drop(weight)
    return df.join(F.broadcast(hot), on).unionByName(df.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on))


#: The C library's call that gives freed memory back, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column's values as bytes, without decoding; nulls stay None."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most `most_bytes` of `text`, or one row; no text is ever cut."""
    batch = None
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
    # The worker process stays for other tasks: what this one no longer needs goes back to the system.
    del batch
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names based on `names` that no column of `df` has, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
