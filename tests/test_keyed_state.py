"""Reservations and frames as streams: rules, late rows, batches cut anywhere, restarts; state that shrinks."""

import random

import pandas as pd
import pytest
from lectern.plans import registry
from lectern.sources.scratch import new_folder
from lectern.streaming import keyed, streams
from pyspark.sql import functions as F

MINUTE = 60_000


def test_rules_of_one_reservation():
    held, outcome = keyed.decide(None, 0, 1, False)
    assert (held, outcome) == ((1, 0), "granted")
    assert keyed.decide(held, 10 * MINUTE, 2, False) == ((1, 0), "refused")
    assert keyed.decide(held, 10 * MINUTE + 1, 2, False) == ((2, 10 * MINUTE + 1), "taken over")
    assert keyed.decide(held, 5, 3, True) == (None, "finished") and keyed.decide(None, 5, 3, True) == (None, "ignored")


def files(spark, frame, parts, folder=None):
    folder = folder or new_folder(spark, "arrivals")
    for k in parts:
        frame.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for i in range(300):
        at += rng.randrange(8 * MINUTE)
        rows.append((i, rng.randrange(3), at, rng.random() < 0.3))
    return rows


@pytest.mark.parametrize("cuts", [(), (100, 200), (40, 41, 250)])
def test_stream_and_batch_decide_alike(spark, events, cuts):
    """Whatever the batches, up to the watermark; rows of a batch come in no order."""
    shuffled = random.Random(1).sample(events, len(events))
    df = spark.createDataFrame([(i, k, sum(i >= c for c in cuts), done, at) for i, k, at, done in shuffled], "request long, key long, slice int, done boolean, at long")
    df = df.withColumn("ts", F.timestamp_millis("at")).drop("at")
    folder = files(spark, df, range(len(cuts) + 1))
    state = new_folder(spark, "state")
    out = streams.run_to_table(keyed.reservations(streams.event_stream(spark, folder, "*.parquet"), "key", "request", "ts", F.col("done")), state)
    last = max(at for *_, at, _ in events) - 10 * MINUTE
    want = [tuple(r) for r in keyed.reservations_batch(df, "key", "request", "ts", F.col("done")).collect() if r["at_ms"] <= last]
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted(want) and {x[3] for x in got} == {"granted", "refused", "taken over", "finished", "ignored"}


def test_late_rows_are_dropped_and_state_is_let_go(spark):
    rows = [(i, f"2024-01-01 {i:02}:30:00", 0 if i < 8 else 1 if i < 16 else 2) for i in range(24)] + [(99, "2024-01-01 01:31:00", 2)]
    df = spark.createDataFrame(rows, "id long, t string, slice int").select("id", F.to_timestamp("t").alias("ts"), "slice")
    folder, state = files(spark, df, range(3)), new_folder(spark, "state")
    stream = streams.rate_windows(streams.event_stream(spark, folder, "*.parquet").withColumn("client", F.lit(1)), "client", "ts", "1 hour", late="1 hour")
    got = {r["started"].hour: r["n"] for r in streams.run_to_table(stream, state).collect()}
    assert got == {h: 1 for h in range(22)}  # neither the late row nor windows that are still open
    figures = streams.figures(spark, state).collect()
    assert sum(r["late_rows"] for r in figures) == 1 and max(r["state_rows"] for r in figures) <= 10


@pytest.mark.parametrize("width", [1, 2, 7, 1000])
def test_frames_however_the_bytes_are_cut(spark, width):
    texts = {"a": "one\n\ntwo é\n\n\n\nfour\n\nrest", "b": "\n\n日本\n\n", "c": "no end"}
    rows = [(k, i, t.encode()[i * width : (i + 1) * width]) for k, t in texts.items() for i in range(-(-len(t.encode()) // width))]
    rows += [rows[0]]  # a piece that came twice
    order = random.Random(width)
    df = spark.createDataFrame([(*r, order.randrange(3)) for r in rows], "key string, seq long, body binary, slice int")
    folder, state = files(spark, df, range(2)), new_folder(spark, "state")

    def run():
        stream = spark.readStream.schema("key string, seq long, body binary").option("maxFilesPerTrigger", 1).parquet(folder)
        return streams.run_to_table(keyed.framed(stream, "key", "seq", "body"), state)

    run()
    files(spark, df, range(2, 3), folder)
    got = sorted((r["key"], r["frame_no"], r["frame"]) for r in run().collect())
    assert got == sorted((k, i, f) for k, t in texts.items() for i, f in enumerate(t.split("\n\n")[:-1]))


def test_each_batch_reaches_its_writer_once(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, slice int")
    folder, out = files(spark, df, range(2)), str(tmp_path / "out")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)
    for _ in range(2):  # the second run finds nothing new
        streams.run_each_batch(stream, str(tmp_path / "check"), lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch_{number}"))
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}/*").collect()) == list(range(10))


class Calls:
    """A state of one key in memory that counts the calls to it."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("put", "appendList", "update", "appendValue"):
                new = args[0] if name in ("put", "appendList") else [args[0]]
                self.rows = list(new) if name in ("put", "update") else self.rows + list(new)
            elif name == "clear":
                self.rows = []
            elif name == "exists":
                return bool(self.rows)
            elif name == "get":
                return iter(self.rows) if self.listed else self.rows[0] if self.rows else None

        return call


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def _state(self, name, listed):
        state = self.states[name] = Calls()
        state.listed = listed
        return state

    def getValueState(self, name, schema):
        return self._state(name, False)

    def getListState(self, name, schema):
        return self._state(name, True)

    def registerTimer(self, at):
        self.timers.append(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_waiting_events_take_few_calls_to_the_state():
    rng = random.Random(9)
    events = [(rng.randrange(5000 * MINUTE), i, rng.random() < 0.3) for i in range(4000)]
    handle, one = Handle(), keyed.Reservations()
    one.init(handle)
    for at in range(0, 4000, 1000):
        part = pd.DataFrame(events[at : at + 1000], columns=["at_ms", "request", "finishes"])
        assert list(one.handleInputRows((7,), iter([part]), None)) == []
    got = []
    for now in (2000 * MINUTE, 1900 * MINUTE, 5000 * MINUTE):
        got += [r for out in one.handleExpiredTimer((7,), Watermark(now), None) for r in out.itertuples(index=False, name=None)]
    held, want = None, []
    for at, request, done in sorted(events):
        held, outcome = keyed.decide(held, at, request, done)
        want.append((7, request, at, outcome))
    assert got == want and sum(s.calls for s in handle.states.values()) <= 30


def test_early_pieces_take_few_calls_to_the_state():
    text = "".join(f"frame {i}\n\n" for i in range(400)).encode()
    pieces = [(k, text[k * 5 : k * 5 + 5]) for k in range(-(-len(text) // 5))]
    handle, one = Handle(), keyed.Frames()
    one.init(handle)
    got = []
    for rest in (1, 2, 0):
        part = pd.DataFrame([p for p in pieces if p[0] % 3 == rest], columns=["seq", "body"])
        got += [r for out in one.handleInputRows(("a",), iter([part]), None) for r in out.itertuples(index=False, name=None)]
    assert got == [("a", i, f"frame {i}") for i in range(400)] and sum(s.calls for s in handle.states.values()) <= 10


ALL_WINDOWS = [("stream_daily_usage", "requests"), ("stream_sessions", "n"), ("stream_rates", "n")]


@pytest.mark.parametrize(("query", "count"), ALL_WINDOWS)
def test_streams_return_open_windows_too(spark, query, count):
    """Every event is in a window of the result, whether or not the watermark has passed its end."""
    sf = "/root/testdata/sf0.001"
    rows = registry.queries()[query](spark, sf)
    assert rows.agg(F.sum(count)).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
