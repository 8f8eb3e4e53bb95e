"""Change streams into a table: one commit for each micro-batch, taken in once however often it is delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidelog.store import Database


def ingest(db: Database, changes: DataFrame, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a stream of ``ord, op, key, value`` rows into ``db``.

    ``ord`` orders the rows of a micro-batch. The commit records the stream's ``name`` and batch number, so a batch repeated
    after a failure is recognised and left out; late rows simply get later sequences.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            db.write_frame(batch, stream=(name, number))
        finally:
            batch.unpersist()

    writer = changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
