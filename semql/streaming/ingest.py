"""A stream of rows into a vector table: each micro-batch is embedded and appended as one segment; ``Database.compact`` joins them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from semql.sources.store import Database


def ingest(stream: DataFrame, db: Database, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a query that inserts every micro-batch of ``stream`` into ``table``.

    ``once`` takes what is there and stops. A batch that is run again after a failure may insert its rows again; rows that
    bring their ``_rowid`` are replaced instead, and so count once.
    """

    def append(batch: DataFrame, _: int) -> None:
        db.insert(table, batch)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
