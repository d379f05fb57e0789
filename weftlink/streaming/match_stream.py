"""New records matched against standing targets as they arrive.

The reference side is static, so each micro-batch is a stream-static join with the posting table and needs no
state. Exclusive assignment looks at all records of a target at once; it stays a batch step over
what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftlink.operators.blocking import BlockingParams, candidate_pairs


def match_stream(records: DataFrame, targets: DataFrame, path: str, checkpoint: str, params: BlockingParams = BlockingParams()) -> StreamingQuery:
    """Candidates of each micro-batch of ``records`` (a stream), appended to ``path`` as Parquet.

    A batch that is run again after a failure overwrites its own folder, so each record's candidates are there once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        found = candidate_pairs(rows, targets, params).select("s1_id", "t_id", "source", "rank", "score")
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
