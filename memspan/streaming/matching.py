"""Matching a stream of queries against fixed references.

A match never leaves its query's row, so each micro-batch is matched by itself: a stateless
join of a stream with static k-mers, run by ``foreachBatch`` with the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from memspan.operators.matches import find_matches


def match_stream(refs: DataFrame, queries: DataFrame, target: str, checkpoint: str, min_len: int = 20, kind: str = "mem", both_strands: bool = False, available_now: bool = False) -> StreamingQuery:
    """Starts a query that writes the matches of every micro-batch of ``queries`` (id, chars) as
    Parquet below ``target``, one folder a batch: a batch that is run again replaces its own."""

    def handle(batch: DataFrame, number: int) -> None:
        find_matches(refs, batch, min_len, kind, both_strands).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = queries.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
