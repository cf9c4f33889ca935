"""Operators over streams: row-wise ones as they are, the others on each micro-batch; windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.operators.rows import Flows


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], Flows], sinks: dict[str, str], checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """operator on every micro-batch, each flow appended to its sink (flow: folder of parquet files).

    A batch that is repeated after a failure replaces its own rows: they stand in a
    folder named by the batch.
    """

    def work(batch: DataFrame, number: int) -> None:
        for flow, df in operator(batch).items():
            if flow in sinks:
                df.write.mode("overwrite").parquet(f"{sinks[flow]}/batch={number}")

    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows for each window and key; rows later than `late` are dropped and their state with them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("rows"))
