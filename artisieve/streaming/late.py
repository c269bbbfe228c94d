"""Rows that come too late: a stream with two outputs, the rows in time and a side table of those behind the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from artisieve.sources.commits import CommitLog, stream_name


def split_late(rows: DataFrame, out: str, checkpoint: str, delay_us: int, time_col: str = "received_us") -> DataStreamWriter:
    """Records a stream in the commit log ``out``: each row either in ``rows``, or in ``late`` with the ``watermark_us`` that it missed.

    The watermark of a batch is the greatest time of the batches before it, less the delay; it is kept in the log with the
    rows, so that a restart goes on from it and a batch that is run again falls apart alike. A row at the watermark is in time;
    a row without a time is late.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        log, name = CommitLog(batch.sparkSession, out), stream_name(batch, batch_id)
        if log.has(name):
            return
        seen = log.fact("seen_us")
        mark = F.lit(None if seen is None else seen - delay_us).cast("long")
        late = F.col(time_col).isNull() | F.coalesce(F.col(time_col) < mark, F.lit(False))
        batch.persist()
        try:
            newest = batch.agg(F.max(time_col)).first()[0]
            facts = {"seen_us": max((x for x in (seen, newest) if x is not None), default=None)}
            log.commit(name, {"rows": batch.where(~late), "late": batch.where(late).withColumn("watermark_us", mark)}, facts)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def corrected(log: CommitLog) -> DataFrame:
    """The rows in time and the late ones, for reports that are made again."""
    rows = log.read("rows")
    return rows.unionByName(log.read("late", rows.schema).select(*rows.columns))
