"""Micro-batch ingestion with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pipeline import upsert


def trickle(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, a few files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, timeout: int | None = None) -> None:
    """Run a stream until what is there has been read; a sink sees each batch at least once."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(timeout)


#: Parts of a merged table by a hash of its key: a batch rewrites those that it has keys of, so a large table wants more of them.
PARTS = 64


def merge_sink(target: str, key: str, order: str, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A sink that upserts each batch into a Parquet table of `parts` folders; see read_merged.

    A batch rewrites the parts that its keys fall into, under its epoch; the others stay as they are. Rows go by part to
    tasks of the advisory size, so a part of any size is written by as many as it takes. A batch seen
    again writes the same rows. Once a part's newest version is complete, older ones may go (vacuum).
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).checkpoint()
        touched = [r["__part"] for r in fresh.select("__part").distinct().collect()]  # `parts` at most
        if not touched:
            return
        old = _versions(spark, target, fresh.schema, epoch - 1)
        old = fresh.limit(0) if old is None else old.where(F.col("__part").isin(touched))
        merged = upsert(old, fresh, key, order).withColumn("__epoch", F.lit(epoch))
        merged.hint("rebalance", "__part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__part", "__epoch").parquet(target)

    return run


def _versions(spark: SparkSession, target: str, schema, upto: int | None = None) -> DataFrame | None:
    """Each part's newest version up to an epoch, null if nothing is there."""
    try:
        every = spark.read.parquet(target)
    except Exception as error:  # the first batch has nothing before it
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    kept = every if upto is None else every.where(F.col("__epoch") <= upto)
    newest = kept.groupBy(F.col("__part").alias("__p")).agg(F.max("__epoch").alias("__e"))
    both = kept.join(F.broadcast(newest), (F.col("__part") == F.col("__p")) & (F.col("__epoch") == F.col("__e")))  # a row a part
    names = schema.names if schema is not None else [c for c in every.columns if c != "__epoch"]
    return both.select(*names)


def read_merged(spark: SparkSession, target: str) -> DataFrame:
    """The table that merge_sink has written."""
    return _versions(spark, target, None).drop("__part")


def vacuum(spark: SparkSession, target: str) -> None:
    """Delete versions of parts that a newer one has replaced. Not while a batch is being merged."""
    every = spark.read.parquet(target).select("__part", "__epoch").distinct().collect()
    newest: dict[int, int] = {}
    for r in every:
        newest[r["__part"]] = max(r["__epoch"], newest.get(r["__part"], -1))
    for r in every:
        if r["__epoch"] < newest[r["__part"]]:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/__part={r['__part']}/__epoch={r['__epoch']}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cycles(stream: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, interval: float, deadline: float, check: Callable[[int], bool] | None = None) -> list[int]:
    """Trickle in cycles until nothing comes or the deadline (seconds from now) is over; gives the rows of each cycle.

    Each cycle drains what is there, then `check` (after the rows of the cycle) may stop the run; the next begins `interval` seconds later.
    """
    ends, done = time.monotonic() + deadline, []
    while True:
        seen = [0]

        def counted(batch: DataFrame, epoch: int) -> None:
            seen[0] += batch.count()
            sink(batch, epoch)

        drain(stream(), counted, checkpoint)
        done.append(seen[0])
        if not seen[0] or (check is not None and not check(seen[0])) or time.monotonic() + interval >= ends:
            return done
        time.sleep(interval)


def windowed(events: DataFrame, stamp: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n): counts by tumbling window; a watermark bounds the state in a stream."""
    marked = events.withWatermark(stamp, late) if events.isStreaming else events
    out = marked.groupBy(F.window(stamp, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), key, "n")
