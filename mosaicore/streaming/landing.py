"""Encoding of images as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mosaicore.operators.batch import encode
from mosaicore.params import EncodeParams


def encode_arrivals(spark: SparkSession, planes_path: str, out_path: str, checkpoint: str, p: EncodeParams, schema: str, trigger_once: bool = True) -> StreamingQuery:
    """Encodes planes (Parquet files of PLANES) that land in a folder; each micro-batch adds a folder of codes.

    Images are independent of each other, so there is no state and no watermark; a batch that is
    run again replaces its own folder.
    """
    arrivals = spark.readStream.schema(schema).parquet(planes_path)

    def write(batch: DataFrame, epoch: int) -> None:
        encode(batch, p).write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")

    writer = arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()
