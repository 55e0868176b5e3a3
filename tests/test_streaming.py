import datetime
import time

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.operators import baselines as bl
from fleetpulse.operators import rolling
from fleetpulse.schemas import METRIC_FEED_SCHEMA
from fleetpulse.sources import store
from fleetpulse.streaming import cycle, history, online, ticks, windows


def in_files(df, path, n):
    """The rows in ``n`` files, in time order, one micro-batch each."""
    rows = df.orderBy("timestamp", "event_id").withColumn("_r", F.monotonically_increasing_id())
    pdf = rows.drop("_r").toPandas()
    size = -(-len(pdf) // n)
    for i in range(n):
        part = df.sparkSession.createDataFrame(pdf.iloc[i * size : (i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def test_rolling_state_over_batches_equals_batch(spark, sf, tmp_path):
    df = fx.readings(spark, sf).where("event_id < 600")
    path = in_files(df, str(tmp_path / "in"), 4)
    source = windows.with_event_time(windows.stream_parquet(spark, path, df.schema, 1))
    with history.rocksdb_state(spark):
        query = windows.run_available(history.rolling_stream(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert len(query.recentProgress) >= 4
    names = rolling.rolling_names()
    got = {r["event_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = rolling.add_rolling(df).collect()
    assert len(got) == len(want) == 600
    for r in want:
        assert all(abs(r[n] - got[r["event_id"]][n]) < 1e-7 for n in names)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "event_id long, ts string, machine string, cpu double").withColumn("timestamp", F.to_timestamp_ntz("ts")).drop("ts")
    first = make([(1, "2026-01-01 00:00:05", "m", 1.0), (2, "2026-01-01 01:00:00", "m", 2.0)])
    # The filter uses the watermark of the batch before, so the late row comes in the third.
    second = make([(5, "2026-01-01 01:30:00", "m", 4.0)])
    late = make([(3, "2026-01-01 00:00:06", "m", 50.0), (4, "2026-01-01 02:00:00", "m", 3.0)])
    path = str(tmp_path / "in")
    for part in (first, second, late):
        part.coalesce(1).write.mode("append").parquet(path)
    source = windows.with_event_time(windows.stream_parquet(spark, path, first.schema, 1))
    query = windows.run_available(windows.tumbling(source, ("cpu",)), str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["n"], r["avg_cpu"]) for r in rows} == {(1, 1.0), (1, 2.0), (1, 4.0)}
    assert windows.dropped_late(query) == 1


def test_repeats_in_later_batches_are_dropped(spark, sf, tmp_path):
    df = fx.readings(spark, sf).where("event_id < 100")
    path = str(tmp_path / "in")
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(path)
    source = windows.with_event_time(windows.stream_parquet(spark, path, df.schema, 1))
    once = windows.dedupe(source, delay="40 days").select("event_id")
    windows.run_available(once, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def parts_of(df, n):
    return [df.where(F.col("event_id") % n == i) for i in range(n)]


def rows_by_key(df):
    return {(r["machine"], r["window"]): r for r in df.collect()}


def test_online_baselines_merge_by_levels_and_equal_one_shot(spark, sf, tmp_path):
    root, metrics = str(tmp_path / "moments"), ["cpu", "ram"]
    df = fx.readings(spark, sf)
    body = online.update_body(root, metrics, name="q", fan=3)
    for i, part in enumerate(parts_of(df, 14)):
        body(part, i)
        body(part, i)  # a retry adds nothing
    (version, entries), = online.snapshots(spark, root).values()
    assert version == 14 and [(e.level, e.first, e.last) for e in entries] == [(2, 0, 8), (1, 9, 11), (0, 12, 12), (0, 13, 13)]
    got = rows_by_key(online.current_baselines(spark, root, metrics))
    want = bl.build_baselines(fx.windowed(spark, sf), metrics, levels=("machine+window",)).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[(r["machine"], r["window"])]
        assert g["n"] == r["n"] and all(abs(g[f"{m}_{s}"] - r[f"{m}_{s}"]) < 1e-9 for m in metrics for s in ("mean", "std"))
    # A second query adds its batches beside the first; a batch without rows changes nothing.
    other = online.update_body(root, metrics, name="other", fan=3)
    other(df, 0)
    other(df.limit(0), 1)
    doubled = rows_by_key(online.current_baselines(spark, root, metrics))
    assert all(doubled[k]["n"] == 2 * got[k]["n"] and abs(doubled[k]["cpu_std"] - got[k]["cpu_std"]) < 1e-9 for k in got)


def test_a_failed_update_leaves_the_last_snapshot(spark, sf, tmp_path, monkeypatch):
    root = str(tmp_path / "moments")
    df = fx.readings(spark, sf)
    body = online.update_body(root, ["cpu"], name="q", fan=2)
    body(df.where("event_id % 2 = 0"), 0)
    before = rows_by_key(online.current_baselines(spark, root, ["cpu"]))
    monkeypatch.setattr(online, "merged", lambda *a: 1 / 0)
    try:
        body(df.where("event_id % 2 = 1"), 1)
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    assert rows_by_key(online.current_baselines(spark, root, ["cpu"])) == before
    body(df.where("event_id % 2 = 1"), 1)
    assert sum(r["n"] for r in online.current_baselines(spark, root, ["cpu"]).collect()) == df.count()


def test_faded_baselines_equal_weighted_moments(spark, tmp_path):
    root = str(tmp_path / "moments")
    make = lambda day, values: spark.createDataFrame([(f"2026-01-{day:02d} 12:00:00", "m", "web", v) for v in values], "ts string, machine string, type string, cpu double").withColumn("timestamp", F.to_timestamp_ntz("ts"))
    days = {1: [1.0, 3.0], 2: [10.0], 4: [4.0, 6.0, 8.0]}
    body = online.update_body(root, ["cpu"], name="q", half_life=86400.0, fan=2)
    for i, (day, values) in enumerate(days.items()):
        body(make(day, values), i)
    got = online.current_baselines(spark, root, ["cpu"], half_life=86400.0).first()
    pairs = [(v, 0.5 ** (4 - day)) for day, values in days.items() for v in values]
    total = sum(w for _, w in pairs)
    mean = sum(v * w for v, w in pairs) / total
    std = (sum(w * (v - mean) ** 2 for v, w in pairs) / total) ** 0.5
    assert abs(got["n"] - total) < 1e-9 and abs(got["cpu_mean"] - mean) < 1e-9 and abs(got["cpu_std"] - std) < 1e-9


def test_seeded_history_gives_the_first_reading_a_full_window(spark, sf, tmp_path):
    df = windows.with_event_time(fx.readings(spark, sf).where("event_id < 600"))
    cut = sorted(r[0] for r in df.select("event_time").collect())[300]
    stored, later = df.where(F.col("event_time") < F.lit(cut)), df.where(F.col("event_time") >= F.lit(cut))
    path = in_files(later, str(tmp_path / "in"), 3)
    source = windows.stream_parquet(spark, path, later.schema, 1)
    with history.rocksdb_state(spark):
        windows.run_available(history.rolling_stream(source, stored=stored), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["event_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["event_id"]: r for r in rolling.add_rolling(fx.readings(spark, sf).where("event_id < 600")).collect() if r["event_id"] in got}
    assert len(got) == later.count()
    assert all(abs(want[i][n] - got[i][n]) < 1e-7 for i in got for n in rolling.rolling_names())


def test_state_of_silent_machines_expires(spark, tmp_path):
    row = lambda i: spark.createDataFrame([("m", f"2026-01-01 00:00:{i:02d}", i, 10.0 + i, 1.0, 1.0)], "machine string, ts string, event_id long, cpu double, ram double, load_avg double").withColumn("event_time", F.to_timestamp("ts")).drop("ts")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    row(0).coalesce(1).write.mode("append").parquet(path)
    source = windows.stream_parquet(spark, path, row(0).schema, 1)
    found = lambda: {r["event_id"]: r["cpu_rolling_mean"] for r in spark.read.schema(history.output_schema()).parquet(out).collect()}
    with history.rocksdb_state(spark):
        query = history.rolling_stream(source, ttl_ms=4000).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        try:
            for i in (0, 1):
                if i:
                    time.sleep(6)
                    row(1).coalesce(1).write.mode("append").parquet(path)
                until = time.time() + 90
                while not ((tmp_path / "out" / "_spark_metadata").exists() and i in found()) and time.time() < until:
                    time.sleep(0.5)
        finally:
            query.stop()
    assert found() == {0: 10.0, 1: 11.0}  # the first reading was forgotten


FLEET = ("web-01", "web-02", "router-01")


def fleet_base(spark):
    rows = [(m, "web" if m.startswith("web") else "router", "night", v, v) for m in FLEET for v in (9.0, 10.0, 11.0)]
    return bl.build_baselines(spark.createDataFrame(rows, "machine string, type string, window string, cpu double, ram double"), ["cpu", "ram"])


def feed_files(spark, path, files):
    """One file and micro-batch per list of (metric, machine, seconds, value)."""
    for values in files:
        rows = [(metric, m, "router" if m.startswith("router") else "web", f"2026-01-01 03:{s // 60:02d}:{s % 60:02d}", v) for metric, m, s, v in values]
        df = spark.createDataFrame(rows, "metric string, machine string, type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
    return cycle.metric_feed(spark, path)


# Two ticks: a cascade and a lone anomaly; web-02 lacks a value in the second, a value comes a tick too late, another far too late.
TICK_ONE = [("cpu", "web-01", 1, 90.0), ("cpu", "web-02", 2, 10.0), ("cpu", "router-01", 3, 95.0), ("ram", "web-01", 4, 10.0), ("ram", "web-02", 5, 10.0), ("ram", "router-01", 6, 10.0)]
TICK_TWO = [("cpu", "web-01", 31, 10.0), ("cpu", "web-02", 32, 80.0), ("cpu", "router-01", 33, 85.0), ("ram", "web-01", 34, 10.0), ("ram", "router-01", 35, 10.0), ("cpu", "web-01", 36, 11.0)]
AFTER = [("cpu", "web-01", 200, 10.0)]
EXPECTED = {(0, "router-01"): "likely_root_cause", (0, "web-01"): "downstream_effect", (30, "router-01"): "isolated"}


def roles(spark, files, tmp_path, tag):
    edges = spark.createDataFrame([("web-01", "router-01"), ("web-02", "router-01")], "machine string, router string")
    feed = feed_files(spark, str(tmp_path / f"feed-{tag}"), files)
    assert feed.schema == METRIC_FEED_SCHEMA
    out, log = str(tmp_path / f"out-{tag}"), str(tmp_path / f"log-{tag}")
    body = cycle.detection_cycle(fleet_base(spark), edges, out, log, metrics=["cpu", "ram"])
    query = cycle.run_cycle(feed, body, str(tmp_path / f"cp-{tag}"), metrics=["cpu", "ram"])
    query.awaitTermination()
    got = {(r["tick"].second, r["machine"]): r["role"] for r in cycle.read_published(spark, out).collect()}
    assert store.read_predictions(spark, log).count() == 5  # three whole machines, then two
    return got, query, (feed, body, out, log)


def test_ticks_split_over_micro_batches_equal_one_batch(spark, tmp_path):
    whole, _, _ = roles(spark, [TICK_ONE + TICK_TWO, AFTER], tmp_path, "one")
    # Four micro-batches cut both ticks; the last ram value of the first tick comes after the second tick began.
    files = [TICK_ONE[:2], TICK_ONE[2:5] + TICK_TWO[:3], TICK_ONE[5:] + TICK_TWO[3:], AFTER]
    split, _, _ = roles(spark, files, tmp_path, "four")
    assert whole == split == EXPECTED


def test_values_behind_the_watermark_are_counted_not_scored(spark, tmp_path):
    late = [("ram", "web-02", 36, 10.0)]
    got, query, _ = roles(spark, [TICK_ONE + TICK_TWO, AFTER, [("cpu", "web-01", 400, 10.0)], late], tmp_path, "late")
    assert got == EXPECTED and windows.dropped_late(query) == 1


def test_rerun_batches_and_second_cycles_count_once_each(spark, tmp_path):
    _, _, (feed, body, out, log) = roles(spark, [TICK_ONE + TICK_TWO, AFTER], tmp_path, "again")
    # A restart from the same checkpoint adds nothing, a cycle with a checkpoint of its own adds its rows.
    cycle.run_cycle(feed, body, str(tmp_path / "cp-again"), metrics=["cpu", "ram"]).awaitTermination()
    assert cycle.read_published(spark, out).count() == 3 and store.read_predictions(spark, log).count() == 5
    cycle.run_cycle(feed, body, str(tmp_path / "cp-other"), metrics=["cpu", "ram"]).awaitTermination()
    assert cycle.read_published(spark, out).count() == 6 and store.read_predictions(spark, log).count() == 10
    days = store.read_predictions(spark, log).select(F.to_date("timestamp").cast("string")).distinct().collect()
    assert [d[0] for d in days] == ["2026-01-01"]


def test_odd_values_and_types_in_ticks(spark, tmp_path):
    values = [("cpu", "m", 1, 1.0), ("cpu", "m", 3, float("nan")), ("cpu", "m", 2, 2.005), ("cpu", "m", 2, 1.0), ("ram", "m", 9, None), ("disk", "m", 9, 1.0), ("ram", "n", 9, 3.0)]
    feed = feed_files(spark, str(tmp_path / "feed"), [values, AFTER])
    query = windows.run_available(ticks.assemble_ticks(feed, ["cpu", "ram"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = {r["machine"]: (r["cpu"], r["ram"], r["found"], r["whole"]) for r in spark.read.parquet(str(tmp_path / "out")).where("second(tick) = 0").collect()}
    assert found == {"m": (2.01, None, 1, False), "n": (None, 3.0, 1, False)} and query.exception() is None


def test_feed_slices_of_several_files_make_one_batch_on_disk(spark, sf, monkeypatch):
    """More files a slice change neither batches nor rows, and waiting ticks are kept by the RocksDB state store."""
    from fleetpulse.catalog import streams

    seen = []
    inner = streams.ticks.assemble_ticks
    monkeypatch.setattr(streams.ticks, "assemble_ticks", lambda *a, **k: seen.append(spark.conf.get(history.PROVIDER_KEY)) or inner(*a, **k))
    one = sorted(map(tuple, streams.stream_ticks(spark, sf).collect()))
    monkeypatch.setattr(streams, "FILE_ROWS", 500)
    monkeypatch.setattr(streams, "SURE_ROWS", 100)
    files = []
    feed = streams.cycle.metric_feed
    monkeypatch.setattr(streams.cycle, "metric_feed", lambda spark, path, n=1: files.append((n, len(spark.read.parquet(path).inputFiles()))) or feed(spark, path, n))
    many = sorted(map(tuple, streams.stream_ticks(spark, sf).collect()))
    assert files[0][0] > 1 and files[0][1] == streams.SLICES * files[0][0]
    assert len(one) > 0 and many == one
    assert seen == [history.ROCKSDB] * 2


class KeptList:
    """List state of one machine, as a processor sees it."""

    def __init__(self, rows=()):
        self.rows = list(rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)


def test_history_takes_rows_and_equals_pandas_windows():
    rng = np.random.default_rng(3)
    values = rng.normal(size=(40, 2)).round(3)
    values[5, 0], values[9:21, 1], values[30, 0], values[33:, 1] = np.nan, np.nan, np.inf, 0.1
    held = history.RollingHistory(["a", "b"], 4)
    held.earlier = KeptList()
    at = datetime.datetime(2026, 1, 1)
    reading = lambda i: Row(machine="m", event_time=at + datetime.timedelta(seconds=i), event_id=i, a=None if np.isnan(values[i, 0]) else float(values[i, 0]), b=None if np.isnan(values[i, 1]) else float(values[i, 1]))
    held.handleInitialState(("m",), Row(machine="m", stored=[reading(i) for i in (2, 0, 1)]), None)
    out = []
    for part in (range(3, 17), range(17, 18), range(18, 40)):  # each out of order
        out += list(held.handleInputRows(("m",), iter([reading(i) for i in reversed(part)]), None))
    assert [r["event_id"] for r in out] == list(range(3, 40)) and len(held.earlier.rows) == 3
    for j, m in enumerate("ab"):
        series = pd.Series(values[:, j])
        want = {
            "rolling_mean": series.rolling(4, min_periods=1).mean(),
            "rolling_std": series.rolling(4, min_periods=2).std().fillna(0.0),
            "delta": series.diff(3).fillna(0.0),
        }
        for name, column in want.items():
            got = np.array([np.nan if r[f"{m}_{name}"] is None else r[f"{m}_{name}"] for r in out])
            assert np.allclose(got, column.to_numpy()[3:], equal_nan=True, atol=1e-7), (m, name)
