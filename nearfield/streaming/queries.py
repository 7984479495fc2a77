"""Queries that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfield.plans.indexes import FlatIndexL2, IVFIndex


def search_stream(queries: DataFrame, index: FlatIndexL2 | IVFIndex, k: int, out: str, checkpoint: str, **search) -> StreamingQuery:
    """Search each micro-batch and write its hits to a folder of its own under ``out``.

    Ranking within a query isn't allowed on an unbounded stream, and needn't
    be: a query's hits depend on the index alone. A batch that runs again
    overwrites its folder, so each query has its hits once.
    """

    def each(batch: DataFrame, number: int) -> None:
        index.search(batch, k, **search).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
