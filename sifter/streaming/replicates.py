"""Replicate statistics maintained as experiment files arrive (A2/A4/A5, streamed).

New result files land in a folder; Structured Streaming reads them as they
come, keeps per-condition partial aggregates (count, sum, sum of squares,
first row) in its fault-tolerant state store, and after every micro-batch a
``foreachBatch`` sink rewrites the current per-condition table (mean,
sample std, replicate count).  Restarting from the checkpoint resumes
exactly where it stopped.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.session import scratch_path


def _stateful_aggs(targets: Sequence[str]):
    aggs = [F.count(F.lit(1)).alias("n_replicates")]
    for t in targets:
        y = F.col(t).cast("double")
        aggs += [F.count(y).alias(f"_n_{t}"), F.sum(y).alias(f"_s_{t}"), F.sum(y * y).alias(f"_q_{t}"),
                 F.avg(y).alias(f"{t}_mean"), F.stddev_samp(y).alias(f"{t}_std")]
    return aggs


def replicate_stream(spark: SparkSession, source_dir: str, schema: T.StructType | str,
                     feature_cols: Sequence[str], target_cols: Sequence[str], sink_path: str,
                     checkpoint_location: str | None = None, file_format: str = "parquet",
                     path_glob: str | None = None, available_now: bool = True):
    """Start the streaming aggregation; returns the ``StreamingQuery``.

    With ``available_now`` the query processes everything present and stops
    (batch-style incremental runs); otherwise it keeps running.
    """
    reader = spark.readStream.schema(schema).format(file_format)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if file_format == "csv":
        reader = reader.option("header", True)
    rows = reader.load(source_dir)
    keyed = rows
    for f in feature_cols:
        keyed = keyed.where(F.col(f).isNotNull())
    stats = keyed.groupBy(*feature_cols).agg(*_stateful_aggs(target_cols))
    out_cols = list(feature_cols) + ["n_replicates"] + \
        [c for t in target_cols for c in (f"{t}_mean", f"{t}_std")]

    def publish(batch: DataFrame, epoch_id: int) -> None:
        batch.select(*out_cols).write.mode("overwrite").parquet(sink_path)

    ckpt = checkpoint_location or scratch_path(spark, "replicate-stream")
    writer = (stats.writeStream.outputMode("complete").foreachBatch(publish)
              .option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def run_to_completion(spark: SparkSession, source_dir: str, schema, feature_cols, target_cols,
                      path_glob: str | None = None) -> DataFrame:
    """Process all files present, wait, and return the published table."""
    sink = scratch_path(spark, "replicate-stream-out")
    q = replicate_stream(spark, source_dir, schema, feature_cols, target_cols, sink,
                         path_glob=path_glob, available_now=True)
    q.awaitTermination()
    return spark.read.parquet(sink)
