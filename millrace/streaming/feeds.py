"""Change feeds as streams: each micro-batch becomes one run of a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.changes import ChangeLog


def follow(feed: DataFrame, log: ChangeLog, checkpoint: str, **trigger) -> StreamingQuery:
    """Append every micro-batch of a streaming feed to a change log.

    A batch that is repeated after a failure appends the same changes again, which leaves the state as it is, so the result
    is that of processing each change exactly once. Late and out-of-order changes need no watermark: their place
    is in their order columns. ``trigger`` is that of ``writeStream`` and by default takes what is there and stops.
    """
    return feed.writeStream.foreachBatch(lambda rows, _: log.append(rows)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
