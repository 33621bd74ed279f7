"""Running streams: file sources, table sinks and the feed delta."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pagewatch.operators.publish import feed_delta
from pagewatch.session import scratch_root
from pagewatch.streaming.stateful import ROCKSDB


def table_stream(spark: SparkSession, folder: str, file_name: str, max_files: int | None = None) -> DataFrame:
    """Stream of the parquet files in ``folder`` that match ``file_name``."""
    schema = spark.read.option("pathGlobFilter", file_name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def run_available(df: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available, append it to a parquet table, read the table back.

    Batches without data are off: state with a time to live would ask for them for ever.
    """
    spark = df.sparkSession
    root = f"{scratch_root(spark)}/pagewatch-stream-{uuid.uuid4().hex}"
    out, checkpoint = out or f"{root}/out", checkpoint or f"{root}/state"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def stream_feed_delta(
    items: DataFrame, posted_path: str, actions_path: str, checkpoint: str, flood_limit: int = 15, max_posts: int = 5
):
    """Start the feed-delta job: per micro-batch decide what to post and record it.

    Both tables are partitioned by batch and rewritten per batch id, so a
    replayed batch leaves the same content.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        posted = _read_or_empty(spark, posted_path, "id string, batch bigint").filter(F.col("batch") < batch_id)
        actions = feed_delta(batch, posted, flood_limit, max_posts)
        target = f"{actions_path}/batch={batch_id}"
        actions.write.mode("overwrite").parquet(target)
        done = spark.read.parquet(target).filter("action <> 'wait'").select("id")
        done.write.mode("overwrite").parquet(f"{posted_path}/batch={batch_id}")

    return (
        items.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
