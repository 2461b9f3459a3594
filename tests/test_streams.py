"""Streams: a growing journal, throttled progress, windows with deadlines, commits and slices that run again."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from panelspark.functions.storage import new_path
from panelspark.operators import report
from panelspark.streaming import journal, online, progress, runs


def _line(k, **more):
    return json.dumps({"run_id": "r", "step": f"s{k % 2}", "ts": f"2024-01-01T00:00:{k:02d}", "percentage": float(k), "state": "running"} | more) + "\n"


def test_journal_grows_waits_and_starts_anew(spark, tmp_path):
    folder = tmp_path / "journal"
    folder.mkdir()
    file = folder / "events.jsonl"
    out, progress_path = new_path(spark, "lines"), new_path(spark, "progress")

    def look():
        """What one more run over the journal reads; the checkpoint remembers the offsets."""
        before = {(r.file, r.offset, r.raw) for r in spark.read.schema("file string, offset long, raw string, malformed boolean").parquet(out).collect()} if seen else set()
        s = journal.follow(spark, str(folder), span=50).select("file", "offset", "raw", "malformed")
        s.writeStream.option("checkpointLocation", progress_path).trigger(availableNow=True).start(out, format="parquet", outputMode="append").awaitTermination()
        rows = spark.read.schema("file string, offset long, raw string, malformed boolean").parquet(out).collect()
        seen.append(len(rows))
        return sorted((r.offset, r.raw, r.malformed) for r in rows if (r.file, r.offset, r.raw) not in before)

    seen = []
    a, b = _line(1), _line(2)
    file.write_text(a + "{bad\n" + b[:20])
    assert [(o, m) for o, _, m in look()] == [(0, False), (len(a), True)]  # half a last line waits
    with file.open("a") as f:
        f.write(b[20:] + _line(3) + "\n")
    assert [r for _, r, _ in look()] == [b.strip(), _line(3).strip()] and look() == []
    (folder / "more.jsonl").write_text(_line(5))
    assert [r for _, r, _ in look()] == [_line(5).strip()]
    file.write_text(_line(7))  # shorter than what was read of it
    assert [(o, r) for o, r, _ in look()] == [(0, _line(7).strip())]


def test_journal_spans_share_every_line_once(tmp_path):
    rng = random.Random(3)
    lines = ["é" * rng.randint(0, 40) for _ in range(200)]
    (tmp_path / "a").write_text("\n".join(lines) + "\nhalf")
    size = len("\n".join(lines).encode()) + 1
    for span in (1, 7, 64, 10**6):
        reader = journal.JournalReader(str(tmp_path), span)
        end = reader.latestOffset()
        assert end == {"a": size}
        got = [line for p in reader.partitions({}, end) for line in reader.read(p)]
        assert [v for _, _, v in got] == lines and [o for _, o, _ in got] == sorted({o for _, o, _ in got})
        half = reader.partitions({"a": got[50][1]}, end)
        assert [v for p in half for _, _, v in reader.read(p)] == lines[50:]
    assert journal.JournalReader(str(tmp_path / "none"), 5).latestOffset() == {}


def test_throttle_equals_the_fold(spark):
    rng = random.Random(5)
    start, rows = datetime(2024, 1, 1), []
    for run in range(6):
        at = start
        for k in range(40):
            at += timedelta(milliseconds=rng.choice([100, 300, 900, 1000, 5000]))
            rows.append((run, "s", at, run * 100 + k, float(k), rng.choice(["running"] * 8 + ["waiting", "done"])))
    want = []
    for run in range(6):
        last, state = None, None
        for r in [r for r in rows if r[0] == run]:
            if last is None or r[5] != state or r[5] == "done" or (r[2] - last).total_seconds() >= 1:
                want.append((run, r[2], r[4], r[5]))
                last = r[2]
            state = r[5]
    path = new_path(spark, "arrivals")
    rows.sort(key=lambda r: r[2])
    schema = "run_id int, step string, ts timestamp, event_id int, percentage double, state string"
    for k in range(0, len(rows), 60):
        spark.createDataFrame(rows[k : k + 60], schema).coalesce(1).write.mode("append").parquet(path)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = runs.drain(progress.throttled(stream, 1.0), "append").collect()
    finally:
        spark.conf.set(name, before)
    assert sorted((r.run_id, r.ts, r.percentage, r.state) for r in got) == sorted(want)


def test_windows_that_are_missed_and_commits_outside(spark):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    windows = [("a", t(1), t(2)), ("b", t(3), t(4)), ("c", t(5), t(6)), ("d", t(7), t(8)), ("e", t(9), t(10)), ("end", datetime(2024, 3, 1), datetime(2024, 3, 1))]
    attempts = [
        ("a", t(1, 5), t(1, 9), "failed", None), ("a", t(1, 10), t(1, 20), "done", t(1, 20)), ("b", t(2, 59), t(3, 10), "done", None), ("c", t(5, 30), t(6, 30), "done", t(5, 40)),
        ("d", t(7), t(7, 1), "done", t(8, 1)), ("x", t(7), t(7, 1), "done", None), ("end", datetime(2024, 3, 1), None, "done", None),
    ]
    streams = []
    for rows, schema in ((windows, "window_id string, start timestamp, stop timestamp"), (attempts, "window_id string, started_at timestamp, ended_at timestamp, state string, committed_at timestamp")):
        path = new_path(spark, "arrivals")
        for part in (rows[:-1], rows[-1:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    got = {r.window_id: (r.outcome, r.fault) for r in runs.drain(online.stream_outcomes(*streams), "append").collect() if r.window_id != "end"}
    assert got == {"a": ("done", None), "b": ("skipped", None), "c": ("incomplete", "invalid commit"), "d": ("done", "invalid commit"), "e": ("skipped", None)}


def test_commits_run_again_and_are_refused(spark):
    path = new_path(spark, "commits")
    sink = online.commit_sink(path)
    make = lambda *rows: spark.createDataFrame(rows, "trade_date string, trade_time string, commit_id string, strategy string")
    first = make(("20240101", "0900", "a", "s"), ("20240101", "1000", "b", "s"), ("20240101", "1000", "b", "s"))
    for epoch in (0, 0, 1):
        sink(first, epoch)
    sink(make(("20240102", "0900", "c", "s")), 2)
    read = lambda: sorted(tuple(r) for r in spark.read.schema(first.schema).parquet(path).select(*first.columns).collect())
    assert read() == [("20240101", "0900", "a", "s"), ("20240101", "1000", "b", "s"), ("20240102", "0900", "c", "s")]
    before = read()
    for row, fault in ((("20240101", "0900", "d", "s"), "duplicate daily signal"), (("20240103", "0900", "a", "s"), "duplicate commit"), (("20240103", "0900", "e", "other"), "strategy")):
        with pytest.raises(ValueError, match=fault):
            sink(make(row), 3)
    with pytest.raises(ValueError, match="duplicate daily signal"):
        sink(make(("20240103", "0900", "e", "s"), ("20240103", "0900", "f", "s")), 3)
    assert read() == before
    sink(make().limit(0), 4)
    assert read() == before


def test_slices_equal_the_frame_of_each_portfolio(spark):
    daily = spark.createDataFrame([("20240101", 1.0, 2.0, 9.0, [1]), ("20240102", 3.0, None, 8.0, None)], "trade_date string, top3_r double, top5_r double, index double, parts array<int>")
    path = new_path(spark, "slices")
    sink = online.slice_sink(path, {"k3": 3, "k5": 5})
    for d in ("20240101", "20240102", "20240102"):
        sink(daily.where(F.col("trade_date") == d), 0)
    read = lambda: spark.read.schema("r double, index double, trade_date string, portfolio_key string").parquet(path).select("r", "index", "trade_date", "portfolio_key")
    for key, n in (("k3", 3), ("k5", 5)):
        for d in ("20240101", "20240102"):
            want = report.online_slice(daily, d, n, key).select("r", "index", "trade_date", "portfolio_key").collect()
            assert read().where((F.col("portfolio_key") == key) & (F.col("trade_date") == d)).collect() == want
    sink(daily.where("trade_date = '20240101'").withColumn("top3_r", F.lit(7.0)), 1)
    assert sorted(r.r for r in read().where("portfolio_key = 'k3'").collect()) == [3.0, 7.0]


def test_a_stream_that_fails_says_why(spark):
    path = new_path(spark, "arrivals")
    schema = "trade_date string, trade_time string, commit_id string, strategy string"
    spark.createDataFrame([("d", "t", "a", "s"), ("d", "t", "b", "s")], schema).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    with pytest.raises(PySparkException, match="duplicate daily signal"):
        stream.writeStream.option("checkpointLocation", new_path(spark, "progress")).trigger(availableNow=True).foreachBatch(online.commit_sink(new_path(spark, "commits"))).start().awaitTermination()


def test_a_step_costs_few_calls():
    """A known step asks for its state once and writes it once; its timer stands, is set again if it was updated, and else forgets."""
    calls, kept = [], {}

    class State:
        get = lambda self: calls.append("get") or kept.get("v")
        update = lambda self, v: calls.append("update") or kept.update(v=v)
        clear = lambda self: calls.append("clear") or kept.clear()

    class Handle:
        getValueState = lambda self, name, schema: State()  # noqa: E731, N815
        registerTimer = lambda self, at: calls.append(("timer", at))  # noqa: E731, N815

    class Now:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    p = progress.Throttle(1.0, 1)
    p.init(Handle())
    day, row = 86_400_000, lambda ms, state: Row(ts=None, event_id=ms, percentage=1.0, state=state, at=ms * 1000)
    assert len(list(p.handleInputRows((1, "s"), iter([row(1500, "a"), row(1000, "a"), row(2100, "a")]), Now(0)))) == 2
    assert calls == ["get", ("timer", 2100 + day), "update"]
    calls.clear()
    assert len(list(p.handleInputRows((1, "s"), iter([row(5000, "b")]), Now(0)))) == 1
    assert calls == ["get", "update"]
    calls.clear()
    assert not list(p.handleExpiredTimer((1, "s"), Now(2100 + day), None)) and calls == ["get", ("timer", 5000 + day)]
    assert not list(p.handleExpiredTimer((1, "s"), Now(5000 + day), None)) and calls[-1] == "clear"
