"""Validation of a stream: the row-wise checks need no state, so a stream splits like a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import validate


def split_stream(stream: DataFrame, checks: list[Column], accepted: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's accepted and quarantined rows as Parquet. A batch's number names its folder, so
    a batch that runs again replaces what it wrote."""

    def both(batch: DataFrame, number: int) -> None:
        checked = validate.with_issues(batch, checks).persist()  # both writes read the same verdicts
        try:
            validate.accepted(checked).write.mode("overwrite").parquet(f"{accepted}/batch={number}")
            validate.quarantined(checked).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        finally:
            checked.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
