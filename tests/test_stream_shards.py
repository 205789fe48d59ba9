"""Stateful processors by shard: work a batch, not a row; staged events spread over files."""

from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from framelens.plans import registered, telemetry_queries
from framelens.streaming import jobs, processors
from tests.test_streaming import staged

SF_DIR = "/root/testdata/sf0.001"


class Handle:
    """Stands for Spark's handle and counts what is asked of it."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, None, set()

    def _called(self, do=None):
        self.calls += 1
        return do() if do else None

    def getValueState(self, name, schema):
        return SimpleNamespace(
            get=lambda: self._called(lambda: self.held), update=lambda v: self._called(lambda: setattr(self, "held", v)),
            clear=lambda: self._called(lambda: setattr(self, "held", None)), exists=lambda: self._called(lambda: self.held is not None),
        )

    getMapState = getValueState

    def registerTimer(self, at):
        self._called(lambda: self.timers.add(at))

    def deleteTimer(self, at):
        self._called(lambda: self.timers.discard(at))


def expired(processor, handle, now):
    out = []
    while handle.timers and min(handle.timers) <= now:
        at = min(handle.timers)
        handle.timers.discard(at)
        out += list(processor.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    return [tuple(r) for frame in out for r in frame.itertuples(index=False)]


def test_stalls_of_a_shard_take_a_few_state_calls_a_batch():
    processor, handle = processors.StalledRuns(50), Handle()
    processor.init(handle)
    rows = pd.DataFrame([(f"k{k}", 10 * i + k + 100 * (i >= 500)) for k in range(4) for i in range(1000)], columns=["key_json", "at_ms"])
    list(processor.handleInputRows((0,), iter([rows.iloc[::-1]]), None))
    assert sorted(expired(processor, handle, 6000)) == [(f"k{k}", 4990 + k, 5100 + k) for k in range(4)]
    assert handle.calls < 10  # once three for every heartbeat
    assert expired(processor, handle, 10**6) == [] and not handle.timers


def test_keys_of_a_shard_are_emitted_once_with_a_few_state_calls():
    processor, handle = processors.FirstOnce(1000), Handle()
    processor.init(handle)

    def come(*rows):
        list(processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["key_json", "at_us", "row"])]), None))

    come(*((f"k{i}", 1000 * (i + d), f"{i}-{d}") for d in (1, 0, 2) for i in range(200)))
    assert sorted(expired(processor, handle, 500)) == sorted((f"{i}-0",) for i in range(200))
    assert handle.calls < 10
    come(("k3", 900_000, "again too early"), ("k3", 1_003_000, "again"), ("k5", 600_000, "too early"))
    assert expired(processor, handle, 1_500) == [("again",)]
    expired(processor, handle, 10_000)
    assert handle.held is None and not handle.timers  # all keys are forgotten in the end


def test_streams_with_null_and_text_keys_and_a_row_at_the_watermark(spark, tmp_path):
    start = datetime(2024, 1, 1)
    hours = [(k, h) for k in ("a", None, "b\"c") for h in (0, 30, 31)] + [("z", 30 + 1 / 6), ("z", 29)]
    df = spark.createDataFrame([(k, start + timedelta(hours=h)) for k, h in hours], "who string, ts timestamp")
    path = staged(df, tmp_path / "in", [F.col("ts") < start + timedelta(hours=1), (F.col("ts") >= start + timedelta(hours=1)) & (F.col("ts") < start + timedelta(hours=30.5))])
    gaps = jobs.run_available(processors.stream_stalled_runs(jobs.stream_files(spark, path, max_files=1), 43200, key="who"), "t").collect()
    zero = int((start - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert {tuple(r) for r in gaps} == {(k, zero, zero + 30 * 3_600_000) for k in ("a", None, "b\"c")}
    once = jobs.run_available(jobs.stream_dedupe(jobs.stream_files(spark, path, max_files=1), ["who"]), "t").collect()
    assert {(r.who, r.ts) for r in once} == {(k, start) for k in ("a", None, "b\"c")} | {("z", start + timedelta(hours=29))}


def test_batches_of_many_files(spark, monkeypatch):
    def shown(name):
        return sorted(map(repr, registered()[name](spark, SF_DIR).collect()))

    names = ("str3_stream_sessions", "str9_stream_dedupe", "str6_stream_stalled_runs")
    whole = [shown(name) for name in names]
    monkeypatch.setattr(telemetry_queries, "FILE_ROWS", 20)
    path, files = telemetry_queries._staged_events(spark, SF_DIR)
    read = spark.read.parquet(path)
    assert files > 4 and len(read.inputFiles()) == 5 * files
    assert read.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 60
    monkeypatch.setattr(telemetry_queries, "FILE_ROWS", 50)
    assert [shown(name) for name in names] == whole and all(whole)
