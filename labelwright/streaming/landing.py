"""Extension: the stateless verification pipeline over a landing folder, as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def verify_stream(spark: SparkSession, folder: str, schema: str, checked: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Runs `checked` on each micro-batch of JSON files and appends its rows to `out`; the checkpoint makes it restartable.

    A batch that is run again after a failure replaces its own rows, so the output has each once.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked(batch).write.mode("overwrite").json(f"{out}/batch={number}")

    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)
    return read.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
