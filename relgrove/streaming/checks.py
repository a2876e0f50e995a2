"""Checks over streams: requests come as a stream, or tuples do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from relgrove.operators.verbs import Engine
from relgrove.sources.tuples import COLUMNS


def answer(requests: DataFrame, engine: Engine, sink: Callable[[DataFrame, int], None], checkpoint: str, contextual=None) -> StreamingQuery:
    """Answers a stream of requests, each micro-batch in one job; ``sink`` gets (idx, allowed) and the batch's number.

    A batch may come again after a failure, with the same number.
    """

    def run(batch: DataFrame, number: int) -> None:
        sink(engine.check_bulk(batch, contextual), number)

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def store_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of new tuples to the table at ``path``; a row with a null is no tuple."""
    rows = changes.select(*COLUMNS).dropna()
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
