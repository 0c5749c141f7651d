"""Index maintenance over a stream of new tables: each micro-batch is linked, hashed and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def maintain(cells: DataFrame, entries: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that appends entries(batch) to the index at path, partitioned by grp. cells is a streaming DataFrame.

    A batch that is run again writes its own folder over, so entries are stored once.
    """

    def write(batch: DataFrame, number: int) -> None:
        entries(batch).write.mode("overwrite").partitionBy("grp").parquet(f"{path}/batch={number}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
