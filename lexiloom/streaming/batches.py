"""Streaming variants: packing of token streams that resumes from a checkpoint, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Packing(StatefulProcessor):
    """Tokens of a buffer so far; a row for each document's part in each batch, and whether it completes the batch."""

    def __init__(self, n_target: int):
        self.n_target = n_target

    def init(self, handle: StatefulProcessorHandle) -> None:
        """The running sum of tokens."""
        self.total = handle.getValueState("total", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        """Parts of the documents of one micro-batch, in order of pos."""
        stop = self.total.get()[0] if self.total.exists() else 0
        out = []
        for r in pd.concat(list(rows)).sort_values("pos").itertuples():
            start, stop = stop, stop + int(r.n_tokens)
            for b in range(start // self.n_target, (stop - 1) // self.n_target + 1 if stop > start else 0):
                low, high = max(start, b * self.n_target), min(stop, (b + 1) * self.n_target)
                if high > low:
                    out.append((key[0], key[1], b, int(r.pos), int(r.doc_id), low - start, high - low, high == (b + 1) * self.n_target))
        self.total.update((stop,))
        yield pd.DataFrame(out, columns=["lang", "subtok", "b", "pos", "doc_id", "first", "grab", "completes"])

    def close(self) -> None:
        """Nothing is held."""


def pack_stream(stream: DataFrame, n_target: int) -> DataFrame:
    """A stream (lang, subtok, pos, doc_id, n_tokens) -> parts of batches; with a checkpoint it goes on where it stopped.

    The session needs a state store with values (``STORE``). Documents of a buffer have to arrive in order of pos.
    """
    schema = "lang string, subtok string, b long, pos long, doc_id long, first long, grab long, completes boolean"
    return stream.groupBy("lang", "subtok").transformWithStateInPandas(Packing(n_target), schema, "Append", "None")


def tumbling_counts(events: DataFrame, minutes: int, lateness: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total): events by windows of event time; a stream needs ``lateness``, its watermark."""
    timed = events if lateness is None else events.withWatermark("ts", lateness)
    grouped = timed.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def late_log(spark: SparkSession, folder: str) -> DataFrame:
    """The loader's log as a stream of files, each read_id once within three days of lateness."""
    schema = spark.read.parquet(folder).schema
    log = spark.readStream.schema(schema).parquet(folder)
    return log.withWatermark("received_at", "3 days").dropDuplicatesWithinWatermark(["read_id"])
