"""Unbounded reads against a fixed index: a stateless stream-static join, run batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.align import intersection_align, threshold_align
from ..plans.index import Index


def align_stream(reads: DataFrame, sink: Callable[[DataFrame, int], None], index: Index, checkpoint: str, threshold: float | None = None, available_now: bool = False, **options) -> StreamingQuery:
    """Start a query over streaming reads (qid, name, seq); each batch's results go to sink(results, batch id).

    With a threshold reads are aligned by voting, else by intersection; options go to the operator.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = intersection_align(index, batch, **options) if threshold is None else threshold_align(index, batch, threshold, **options)
        sink(found, number)

    writer = reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
