"""The commit log as a stream: each micro-batch of commits by others is one round of invalidation."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

if TYPE_CHECKING:
    from tidequery.database import Database


def follow(db: Database) -> StreamingQuery:
    """Reads new files of the log; a batch's order isn't that of the commits, so it counts as a set of changed tables and the latest state is read."""
    store = db.store

    def seen(batch: DataFrame, _: int) -> None:
        newest, dirty = batch.agg(F.max("seq"), F.array_distinct(F.flatten(F.collect_list("dirty")))).first()
        if newest is None or newest <= store.head.seq:
            return
        with db._write:
            if newest > store.head.seq:
                store.refresh()
        db.streams.changed(set(dirty))

    log = db.spark.readStream.schema("seq bigint, dirty array<string>").option("pathGlobFilter", "*.json").json(f"{store.root}/_log")
    return log.writeStream.foreachBatch(seen).trigger(processingTime="200 milliseconds").start()
