"""Streaming forms: index tables that grow with each batch, metrics over event time, and idle conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import IndexConfig
from quern.operators.index import build_index


def index_batches(c: IndexConfig, path: str, id: str = "doc_id", text: str = "text") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: appends a batch's postings and lengths, each batch in a folder of its own.

    A batch that is run again replaces its folder, so that a retry adds nothing twice. Statistics are sums over the
    tables and are taken when they are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        ix = build_index(batch, c, id, text)
        ix.postings.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        ix.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats/batch={number}")

    return write


def windowed_metrics(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes", ts: str = "ts", name: str = "event_type", value: str = "value") -> DataFrame:
    """Histograms of each window and name; rows later than the watermark are dropped."""
    kinds = {"count": F.count(value), "sum": F.sum(value), "min": F.min(value), "max": F.max(value)}
    return events.withWatermark(ts, late).groupBy(F.window(ts, every), name).agg(*[f.alias(k) for k, f in kinds.items()])


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions that end after a gap without an event."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def drop_repeated(events: DataFrame, id: str = "event_id", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id])
