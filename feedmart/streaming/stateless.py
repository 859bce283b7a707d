"""The stateless operators over a stream, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import rows as R


def refine(df: DataFrame, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid uncancelled rows, rejects); works on a batch or inside ``foreachBatch``."""
    valid, rejects = R.validate(R.to_canonical(df), sources)
    return R.drop_cancelled(valid), rejects


def refine_stream(stream: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], sources: list[str] | None = None) -> DataStreamWriter:
    """A writer that hands each batch's valid and rejected rows to ``sink``; start it with a checkpoint location for exactly-once batches."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: sink(*refine(batch, sources), epoch))
