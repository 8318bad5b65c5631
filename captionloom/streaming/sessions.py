"""Utterances by pause as a stateful stream: open utterances are state, the watermark closes them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event times are that much later than starts: a stream begins with a watermark of 0, and what does not exceed it is late.
SHIFT = 1
_OPEN = "spans array<struct<start_ms:bigint,end_ms:bigint,n_words:bigint>>"


def merge_spans(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """``(start, end, n)`` spans joined where the pause between them is at most ``gap``."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(spans):
        if out and start - out[-1][1] <= gap:
            first, last, m = out[-1]
            out[-1] = (first, max(last, end), m + n)
        else:
            out.append((start, end, n))
    return out


class OpenUtterances(StatefulProcessor):
    """Per key, the spans of words that later words can still join.

    A span is closed once the watermark has reached its end plus the pause: a word that is not late starts after
    the watermark, so the pause before it is longer. Then the span is a row and its state is gone. What is kept
    of a key is so many numbers as it has open spans, no words.
    """

    def __init__(self, keys: Sequence[str], gap: int):
        self.keys, self.gap = list(keys), gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", _OPEN)

    def _spans(self) -> list[tuple[int, int, int]]:
        got = self.state.get() if self.state.exists() else None
        return [tuple(s) for s in got[0]] if got else []

    def _settle(self, key, spans: list[tuple[int, int, int]], watermark: int) -> Iterator[pd.DataFrame]:
        done = [s for s in spans if s[1] + self.gap + SHIFT <= watermark]
        left = [s for s in spans if s[1] + self.gap + SHIFT > watermark]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            self.state.update((left,))
            self.handle.registerTimer(min(s[1] for s in left) + self.gap + SHIFT)
        else:
            self.state.clear()
        if done:
            yield pd.DataFrame([(*key, *s) for s in done], columns=[*self.keys, "start_ms", "end_ms", "n_words"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans = self._spans()
        for part in rows:
            new = zip(part["start_ms"].tolist(), part["end_ms"].tolist(), [1] * len(part), strict=True)
            spans = merge_spans([*spans, *new], self.gap)
        yield from self._settle(key, spans, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._settle(key, self._spans(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def utterances(words: DataFrame, max_gap_ms: int = 3000, lateness_ms: int = 60_000, keys: Sequence[str] = ("rec_id",)) -> DataFrame:
    """Closed utterances ``(keys, start_ms, end_ms, n_words)`` of a stream of words ``(keys, start_ms, end_ms)``, from 0 ms on.

    A word's event time is its start. Words may come in any order and any split into batches; those that start
    no more than ``lateness_ms`` before the latest start of the earlier batches count, later ones are dropped, and
    the progress of the query numbers them (``numRowsDroppedByWatermark``). An utterance comes out once, when no
    word can join it any more, and the rows are those of ``segment.split_by_gap`` over the words that count. Words
    without a key, start or end are left out.
    """
    fit = words.na.drop(subset=[*keys, "start_ms", "end_ms"]).withColumn("ts", F.expr(f"timestamp_millis(start_ms + {SHIFT})"))
    fit = fit.withWatermark("ts", f"{lateness_ms} milliseconds")
    kinds = ", ".join(f"`{k}` {fit.schema[k].dataType.simpleString()}" for k in keys)
    return fit.select(*keys, "start_ms", "end_ms", "ts").groupBy(*keys).transformWithStateInPandas(
        OpenUtterances(keys, max_gap_ms), f"{kinds}, start_ms bigint, end_ms bigint, n_words bigint", "Append", "EventTime")


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, as state with timers needs; the
    caller's session stays as it is."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return session


def run_utterances(spark: SparkSession, source: str, out: str, checkpoint: str, max_files: int = 1000, **params) -> dict[str, int]:
    """Takes the word files that are new in the folder ``source`` (Parquet: ``rec_id, start_ms, end_ms``), writes closed
    utterances to ``out`` and stops. A later call goes on from ``checkpoint``: open utterances and the watermark survive
    the process, files are taken once, and a batch repeated after a failure writes its rows once.

    Returns ``{"rows", "late"}``: words read, and words dropped as too late.
    """
    session = state_session(spark)
    columns = "rec_id bigint, start_ms bigint, end_ms bigint"
    words = session.readStream.schema(columns).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(source)
    rows = utterances(words, **params)
    query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    progress = query.recentProgress
    late = sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
    return {"rows": sum(p["numInputRows"] for p in progress), "late": late}
