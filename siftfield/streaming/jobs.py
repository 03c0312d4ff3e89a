"""Incremental forms of the batch operators as Structured Streaming jobs."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siftfield.operators.convo import frames
from siftfield.sources.store import append

#: The state store that keeps keyed lists on disk and writes only their changes.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(files: DataFrame, chunker: Callable[[DataFrame], DataFrame], store: str, checkpoint: str) -> StreamingQuery:
    """New rows become chunks, and chunks that the store lacks are appended.

    A batch that is run again after a failure finds its chunks stored, so each is there once.
    """

    def one(batch: DataFrame, _: int) -> None:
        append(chunker(batch), store)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memory(messages: DataFrame, key: str = "conv_id", last: int = 12, silent_ms: int | None = None) -> DataFrame:
    """key, memory: each sender's last messages (turn, role, text) after every batch that has news of it.

    A sender's list of at most ``last`` lines is state in RocksDB; only senders with news are read and written.
    ``silent_ms`` gives the lists a time to live: a sender without news for so long begins anew. (With it, a stream that is to end
    when all that's there is read needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off.) A batch's lines are cut to each
    sender's last before the shuffle, so a sender of very many lines costs its task few. Of equal turns the line that is
    greater comes later; null turns are the oldest, lines without role or text count but aren't shown, and null keys are one sender.

    The session's state store is set to RocksDB, which has to hold when the stream is started.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = dict(messages.dtypes)[key]
    lines = messages.select(key, F.col("turn").cast("bigint").alias("turn"), F.concat("role", F.lit(": "), "text").alias("line"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(["turn", "line"], na_position="first").groupby(key, dropna=False).tail(last)

    few = lines.mapInPandas(cut, lines.schema)
    mode = "processingTime" if silent_ms else "none"
    return few.groupBy(key).transformWithState(LastLines(key, last, silent_ms), f"{key} {kind}, memory string", "update", mode)


class LastLines(StatefulProcessor):
    """Keeps the last lines of a key as list state."""

    def __init__(self, key: str, last: int, silent_ms: int | None):
        self.key, self.last, self.silent_ms = key, last, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "turn bigint, line string", self.silent_ms)

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timer_values: object) -> Iterator[Row]:
        place = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
        news = ((r["turn"], r["line"]) for r in rows)
        held = heapq.nlargest(self.last, chain(((t, x) for t, x in self.lines.get()), news), key=place)[::-1]
        self.lines.put(held)
        yield Row(**{self.key: key[0], "memory": "\n".join(x for _, x in held if x is not None)})

    def close(self) -> None:
        pass


def routed(messages: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Intents and routes of messages as they arrive; stateless, so the batch columns serve as they are."""
    return messages.withColumns(columns)


def framed(messages: DataFrame, keys: Sequence[str], text_col: str, size: int = 3) -> DataFrame:
    return frames(messages, keys, text_col, size)
