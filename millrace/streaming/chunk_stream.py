"""The checkpointed chunk loop on Structured Streaming (section 2.11, T12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.plans.repository import JobRepository


@dataclass
class ChunkStream:
    """Micro-batches as chunks: each is processed, written under its number and then committed to the repository.

    A repeat of a batch that was committed before a failure writes nothing; one
    that wasn't replaces its own output. The source's position is the query's
    checkpoint.
    """

    source: DataFrame
    writer: Callable[[DataFrame, int], None]
    repository: JobRepository
    execution: int
    step: str
    checkpoint: str
    processor: Callable[[DataFrame], DataFrame] = lambda df: df
    should_stop: Callable[[], bool] = lambda: False

    def start(self, available_now: bool = True, interval: str = "10 seconds") -> StreamingQuery:
        def chunk(df: DataFrame, number: int) -> None:
            if self.should_stop():
                raise InterruptedError("stopped between chunks")
            if number in self.repository.committed_chunks(self.execution, self.step):
                return
            held = df.persist()
            try:
                read, kept = held.count(), self.processor(held).persist()
                written = kept.count()
                self.writer(kept, number)
                kept.unpersist()
            finally:
                held.unpersist()
            self.repository.commit_chunk(self.execution, self.step, number, {"read_count": read, "write_count": written, "filter_count": read - written})

        stream = self.source.writeStream.foreachBatch(chunk).option("checkpointLocation", self.checkpoint)
        return (stream.trigger(availableNow=True) if available_now else stream.trigger(processingTime=interval)).start()


class RetryState(StatefulProcessor):
    """Attempts per key over redeliveries: rows (key, value, failed) give (key, value, attempts, exhausted)."""

    def __init__(self, most: int = 3):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.attempts = handle.getValueState("attempts", "count int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        count = self.attempts.get()[0] if self.attempts.exists() else 0
        out = []
        for part in rows:
            for value, failed in zip(part["value"], part["failed"], strict=True):
                count = count + 1 if failed else 0
                out.append((key[0], value, count, count >= self.most))
        self.attempts.update((count,))
        yield pd.DataFrame(out, columns=["key", "value", "attempts", "exhausted"])

    def close(self) -> None: ...


def retry_budget(rows: DataFrame, most: int = 3) -> DataFrame:
    """Keyed retry state as a stream. Needs the RocksDB state store provider."""
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=RetryState(most), outputStructType="key string, value string, attempts int, exhausted boolean", outputMode="Append", timeMode="None")


class ProgressEvents(StreamingQueryListener):
    """Chunk events from a query's progress: hook(name, number, rows)."""

    def __init__(self, hook: Callable[[str, int, int], None]):
        self.hook = hook

    def onQueryStarted(self, event: Any) -> None:
        self.hook("before_job", -1, 0)

    def onQueryProgress(self, event: Any) -> None:
        self.hook("after_chunk", event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event: Any) -> None: ...

    def onQueryTerminated(self, event: Any) -> None:
        self.hook("job_failed" if event.exception else "after_job", -1, 0)


def file_stream(spark: SparkSession, path: str, schema: str, file_format: str = "parquet", files: int = 1) -> DataFrame:
    """New files of a folder, so many per chunk."""
    return spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files).load(path)
