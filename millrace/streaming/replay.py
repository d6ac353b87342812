"""Incremental runs: what has come into a folder since the last run is worked through, then the run ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.streaming.views import accept_views


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Works through all that a stream's source has now, and writes each batch to a folder of its own below ``out``.

    The folder is named after the batch's number and overwritten, so a batch that is run again after a loss leaves
    what it would have left the first time. State and progress are in ``checkpoint``; the next run goes on from there.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_batches(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What runs have written so far."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", out).parquet(out).drop("batch")


def count_views(spark: SparkSession, source: str, schema: str, keys: list[str], at: str, out: str, checkpoint: str, window_seconds: int = 1800, files_per_batch: int = 1, late: str = "10 minutes") -> DataFrame:
    """The views of a folder of Parquet files that count (accept_views()), of this run and those before it.

    Files must come in the order of their times, but for what ``late`` allows; those of one batch in any order.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    accepted = accept_views(stream, keys, at, window_seconds, late)
    run_available(accepted, out, checkpoint)
    types = {f.name: f.dataType.simpleString() for f in accepted.schema}
    return read_batches(spark, out, ", ".join(f"`{c}` {t}" for c, t in types.items()))


def write_in_order(df: DataFrame, at: str, path: str, files: int, most_rows: int = 1_000_000) -> int:
    """df as so many slices, cut by time and written one after the other, as a log of events comes in.

    A slice is one file, or of several, without an order, if files would have more than most_rows. Returns how
    many files a slice has at most.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    cuts = df.select(micros.cast("double").alias("t")).approxQuantile("t", [k / files for k in range(1, files)], 0.001) if files > 1 else []
    each = max(1, -(-df.count() // (files * most_rows)))
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = df if low is None else df.filter(micros >= low)
        (part if high is None else part.filter(micros < high)).coalesce(each).write.mode("append").parquet(path)
    return each
