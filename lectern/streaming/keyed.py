"""Keyed state with timers: one reservation a key with takeover, and frames put together from cut bytes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STALE_MS = 600_000
DECISION = "key long, request long, at_ms long, outcome string"
FRAME = "key string, frame_no long, frame string"
EVENT = np.dtype([("at_ms", "<i8"), ("request", "<i8"), ("finishes", "?")])
EVENTS_AT_ONCE = 50_000


@contextmanager
def rocks_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which state with timers asks for."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def decide(held: tuple[int, int] | None, at_ms: int, request: int, finishes: bool, stale_ms: int = STALE_MS) -> tuple[tuple[int, int] | None, str]:
    """The reservation (request, since) after an event, and the event's outcome.

    A key has one reservation at most.  Who asks while it is held is refused, unless it is stale: then it is taken over.
    Finishing frees the key; without a reservation there is nothing to finish.
    """
    if finishes:
        return None, "finished" if held else "ignored"
    if held is None:
        return (request, at_ms), "granted"
    if at_ms - held[1] > stale_ms:
        return (request, at_ms), "taken over"
    return held, "refused"


def _decided(key: int, held, events: list[tuple[int, int, bool]]) -> tuple[tuple[int, int] | None, pd.DataFrame]:
    out = []
    for at_ms, request, finishes in sorted(events):
        held, outcome = decide(held, at_ms, request, finishes)
        out.append((key, request, at_ms, outcome))
    return held, pd.DataFrame(out, columns=["key", "request", "at_ms", "outcome"])


def _packed(events: np.ndarray) -> list[tuple[int, bytes]]:
    """Entries of the waiting list: the time of the first of some events, and the events as bytes."""
    parts = (events[at : at + EVENTS_AT_ONCE] for at in range(0, len(events), EVENTS_AT_ONCE))
    return [(int(part["at_ms"].min()), part.tobytes()) for part in parts]


class Reservations(StatefulProcessor):
    """Events wait for the watermark, so that late ones still take their place, and are then decided in the order of time.

    They wait packed, many to an entry of the state, as each entry is a call to the state's server.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "request long, since long")
        self.waiting = handle.getListState("waiting", "first_ms long, events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                events = np.empty(len(part), EVENT)
                for name in EVENT.names:
                    events[name] = part[name].to_numpy()
                self.waiting.appendList(_packed(events))
                first = int(events["at_ms"].min()) if first is None else min(first, int(events["at_ms"].min()))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        entries = [tuple(e) for e in self.waiting.get()]
        later = [e for e in entries if e[0] > now]
        if len(later) == len(entries):  # another timer has seen to them
            return
        events = np.concatenate([np.frombuffer(bytes(e[1]), EVENT) for e in entries if e[0] <= now])
        due, left = events[events["at_ms"] <= now], events[events["at_ms"] > now]
        due = due[np.lexsort((due["finishes"], due["request"], due["at_ms"]))]
        held = self.held.get() if self.held.exists() else None
        for at in range(0, len(due), EVENTS_AT_ONCE):
            held, out = _decided(key[0], held, due[at : at + EVENTS_AT_ONCE].tolist())
            yield out
        if held:
            self.held.update(held)
        else:
            self.held.clear()
        self.waiting.clear()
        if later := [*later, *_packed(left)]:
            self.waiting.put(later)
            self.handle.registerTimer(min(e[0] for e in later))

    def close(self) -> None:
        pass


def reservations(events: DataFrame, key: str, request: str, ts: str, finishes, late: str = "10 minutes") -> DataFrame:
    """A stream of (key, request, at_ms, outcome) of every event that the watermark has passed; later ones are dropped."""
    named = events.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(request).alias("request"), F.col(ts).alias("ts"), F.unix_millis(ts).alias("at_ms"), finishes.alias("finishes"))
    return named.groupBy("key").transformWithStateInPandas(Reservations(), outputStructType=DECISION, outputMode="Append", timeMode="EventTime")


def reservations_batch(events: DataFrame, key: str, request: str, ts: str, finishes) -> DataFrame:
    """The same decisions over a table: a key's events pass through one task in order, of which only the reservation is kept."""
    rows = events.select(F.col(key).alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms"), F.col(request).alias("request"), finishes.alias("finishes"))

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for part in parts:
            for key_value, own in part.groupby("key", sort=False):
                held = held if key_value == now else None
                now = key_value
                held, out = _decided(key_value, held, list(own[["at_ms", "request", "finishes"]].itertuples(index=False, name=None)))
                yield out

    return rows.repartition("key").sortWithinPartitions("key", "at_ms", "request", "finishes").mapInPandas(fold, DECISION)


class Frames(StatefulProcessor):
    """Bytes of each connection in the order of their numbers; what comes too early, and half a frame, wait in the state.

    A connection's state is one value, as each piece for itself would be a call to the state's server.
    """

    def __init__(self, mark: bytes = b"\n\n"):
        self.mark = mark

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, frame_no long, rest binary, early array<struct<seq:long,body:binary>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, frame_no, rest, early = self.at.get() or (0, 0, b"", [])
        rest = bytes(rest)
        came = {int(k): bytes(body) for k, body in early}
        for part in rows:
            came.update(zip(part["seq"].tolist(), map(bytes, part["body"]), strict=True))
        out = []
        while seq in came:
            *whole, rest = (rest + came.pop(seq)).split(self.mark)
            for frame in whole:
                out.append((key[0], frame_no, frame.decode("utf-8", "replace")))
                frame_no += 1
            seq += 1
        # smaller numbers were already read and came again
        self.at.update((seq, frame_no, rest, [(k, body) for k, body in came.items() if k > seq]))
        yield pd.DataFrame(out, columns=["key", "frame_no", "frame"])

    def close(self) -> None:
        pass


def framed(chunks: DataFrame, key: str, seq: str, body: str, mark: bytes = b"\n\n") -> DataFrame:
    """Whole frames of a stream of numbered byte chunks, however the bytes are cut and whichever batch has them."""
    named = chunks.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(body).alias("body"))
    return named.groupBy("key").transformWithStateInPandas(Frames(mark), outputStructType=FRAME, outputMode="Append", timeMode="None")
