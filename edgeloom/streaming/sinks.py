"""A sink for samples and other rows of a stream that writes every batch once, however often it is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from edgeloom.cluster import exists


def batch_path(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def write_once(path: str) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: writes a batch as a folder of its own, named by its id, unless that is there and whole.
    A batch that is replayed after it was written, since the stream ended before it could note that down, changes
    nothing; one that was cut off is written anew."""

    def write(rows: DataFrame, batch: int) -> None:
        to = batch_path(path, batch)
        if not exists(rows.sparkSession, f"{to}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(to)

    return write


def follow(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Starts a query that writes the stream's batches below path, each once. trigger: as DataStreamWriter.trigger
    takes it; by default what is there is read, in batches, and the query ends."""
    return stream.writeStream.outputMode(mode).foreachBatch(write_once(path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def written_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all whole batches, with their batch id."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)
