import json

import pytest
from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.operators import baselines as bl
from fleetpulse.operators import feedback as fb
from fleetpulse.operators.zscore import z_threshold, zscore
from fleetpulse.plans.tables import broadcast_if_small, few_rows, materialize, shared_dir
from fleetpulse.schemas import METRICS, PREDICTION_SCHEMA, READING_SCHEMA
from fleetpulse.sources import commits, documents, metrictext
from fleetpulse.sources import readings as src
from fleetpulse.sources import store
from fleetpulse.streaming import windows


def test_csv_scan_is_typed_and_nan_is_null(spark, tmp_path):
    (tmp_path / "fleet.csv").write_text(
        "timestamp,machine,type,cpu,ram,network,disk_io,disk_usage,load_avg,label,anomaly_type\n"
        "2026-01-01 00:00:30,web-01,web,NaN,2,3,4,5,6,0,\n2026-01-01 00:01:00,web-01,web,1.5,2,3,4,5,6,1,cpu_spike\n"
    )
    df = src.read_readings(spark, str(tmp_path / "fleet.csv"))
    assert df.schema.fieldNames() == READING_SCHEMA.fieldNames()
    rows = df.orderBy("timestamp").collect()
    assert rows[0]["cpu"] is None and rows[1]["cpu"] == 1.5 and rows[1]["label"] == 1
    assert src.read_readings(spark, str(tmp_path / "fleet.csv"), ["machine", "cpu"]).columns == ["machine", "cpu"]


def test_adaptive_scan(spark, tmp_path):
    (tmp_path / "any.csv").write_text("a,b,note,label\n1,2.5,x,0\n3,4.5,y,1\n")
    df, features = src.adaptive_scan(spark, str(tmp_path / "any.csv"))
    assert features == ["a", "b"]
    row = df.first()
    assert row["machine"] == "__all__" and row["window"] == "all"


@pytest.mark.parametrize("block", ["128m", "512"])
def test_matrix_lines_meet_their_labels(spark, tmp_path, block):
    """Line numbers are right also when a file is read in many pieces."""
    data, labels = tmp_path / "test", tmp_path / "test_label"
    data.mkdir(), labels.mkdir()
    for name, n in (("1-1", 300), ("2-4", 170)):
        (data / f"machine-{name}.txt").write_text("".join(f"{i}.0,{i % 7}.5,3.0,{-i}.25\n" for i in range(n)))
        (labels / f"machine-{name}.txt").write_text("".join(f"{int(i % 10 == 3)}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        df = src.read_matrix(spark, str(data), str(labels), 4, mode="all")
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert df.columns[-3:] == ["cpu", "ram", "network"] and len(rows) == 470
    for r in rows:
        i = r["line_no"]
        assert r["cpu"] == i and r["network"] == -i - 0.25 if i else True
        assert r["label"] == int(i % 10 == 3)
        assert (r["timestamp"].hour * 60 + r["timestamp"].minute) == i % 1440
    assert {r["machine"] for r in rows} == {"1-1", "2-4"}


def matrix_folder(tmp_path, files):
    for name, rows in files.items():
        for kind, pick in (("data", slice(0, -1)), ("labels", slice(-1, None))):
            target = tmp_path / kind / f"{name}.txt"
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text("\n".join(",".join(map(str, r[pick])) for r in rows if r[pick] != ("",)) + "\n")
    return str(tmp_path / "data"), str(tmp_path / "labels")


def test_matrix_metrics_per_machine(spark, tmp_path):
    files = {
        "machine-a": [(5, i, 10 * i, 0.1 * i, i % 2) for i in range(6)],
        "machine-b": [(i, 7, 0.1 * i, 3 * i, 0) for i in range(4)],
    }
    data, labels = matrix_folder(tmp_path, files)
    top = src.read_matrix(spark, data, labels, 4, "top3", per_machine=True)
    found = {(r["machine"], r["line_no"]): (r["cpu"], r["ram"], r["network"]) for r in top.collect()}
    assert found["a", 2] == (20.0, 2.0, 0.2) and found["b", 2] == (6.0, 2.0, 0.2)
    every = src.read_matrix(spark, data, labels, 4, "all", per_machine=True)
    rows = {(r["machine"], r["line_no"]): r for r in every.collect()}
    assert tuple(rows["a", 2][c] for c in ("cpu", "ram", "network")) == (2.0, 20.0, 0.2)
    assert tuple(rows["b", 2][c] for c in ("cpu", "ram", "network")) == (2.0, 0.2, 6.0)
    assert all(rows["a", 2][f"col_{i}"] is None for i in range(4)) and len(rows) == 10


def test_matrix_lines_without_label_and_equal_names(spark, tmp_path):
    files = {"x/machine-1": [(i, i * i, 3 - i, "") if i == 3 else (i, i * i, 3 - i, 1) for i in range(4)], "y/machine-1": [(9 + i, i, -i, 0) for i in range(2)]}
    data, labels = matrix_folder(tmp_path, files)
    df = src.read_matrix(spark, f"{data}/*", f"{labels}/*", 3, "first3", folders=1)
    got = {(r["machine"], r["line_no"]): (r["cpu"], r["label"]) for r in df.collect()}
    assert got == {("x/1", 0): (0.0, 1), ("x/1", 1): (1.0, 1), ("x/1", 2): (2.0, 1), ("x/1", 3): (3.0, None), ("y/1", 0): (9.0, 0), ("y/1", 1): (10.0, 0)}


def test_metric_text(spark, tmp_path):
    lines = [
        "# HELP sim_cpu_percent load", 'sim_cpu_percent{machine="web-01",type="web"} 12.5 1772000000123', 'sim_ram_percent{ type="db", machine="d,b}1" } 4e1',
        'sim_load_avg{machine="x"} NaN 5', 'sim_load_avg{machine="x"} +Inf', "sim_load_avg 3", 'other{machine="x"} 1', 'sim_load_avg{machine="x"} 0.5 1000', "", "broken{",
    ]
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "a.txt").write_text("\n".join(lines))
    text = spark.read.text(str(tmp_path / "snap")).select("value", F.col("_metadata.file_modification_time").alias("_modified"))
    got = {(r["metric"], r["machine"], r["type"], r["value"]) for r in metrictext.parse_lines(text).collect()}
    assert got == {("cpu", "web-01", "web", 12.5), ("ram", "d,b}1", "db", 40.0), ("load_avg", "x", "unknown", 0.5)}
    times = {r["metric"]: r["ts"] for r in metrictext.parse_lines(text).selectExpr("metric", "unix_millis(ts) AS ts").collect()}
    assert times["cpu"] == 1772000000123 and times["load_avg"] == 1000 and times["ram"] > 1_700_000_000_000
    feed = metrictext.parse_lines(text)
    assert sorted(map(tuple, metrictext.parse_lines(metrictext.as_lines(feed).withColumn("_modified", F.current_timestamp())).where("metric <> 'ram'").collect())) == sorted(
        map(tuple, feed.where("metric <> 'ram'").collect())
    )


def test_restarted_text_feed_takes_every_snapshot_once(spark, tmp_path):
    path, out, cp = tmp_path / "snap", str(tmp_path / "out"), str(tmp_path / "cp")
    path.mkdir()
    for i in range(7):
        (path / f"{i}.txt").write_text(f'sim_cpu_percent{{machine="m{i}",type="web"}} {i} {1000 * i}\n')
        if i in (2, 6):
            query = windows.run_available(metrictext.metric_text_feed(spark, str(path), 2), out, cp)
            assert max(p["numInputRows"] for p in query.recentProgress) <= 2
    assert sorted(r["machine"] for r in spark.read.parquet(out).collect()) == [f"m{i}" for i in range(7)]


def test_baseline_document(spark, tmp_path):
    doc = {
        'we"b|1|night': {"cpu": [1.5, 0.5], "ram": [2, 1e-8]}, 'we"b|1': {"cpu": [1.0, 2.0], "ram": [3.0, 4.0], "__type__": "web"}, "db": {"cpu": [7.0, 1.0]},
        "__type__web": {"cpu": [1, 1], "ram": [1, 1]}, "__global__": {"cpu": [5, 1.0], "ram": [6, 1.0]},
        "__feature_order__": ["cpu", "ram"], "__windows__": ["night"], "__has_windows__": True,
    }
    (tmp_path / "b.json").write_text(json.dumps(doc, indent=2))
    rows, machines, order = documents.read_baseline_document(spark, str(tmp_path / "b.json"))
    assert order == ["cpu", "ram"] and {tuple(r) for r in machines.collect()} == {('we"b|1', "web"), ("db", None)}
    got = {(r["level"], r["machine"], r["type"], r["window"]): (r["cpu_mean"], r["cpu_std"], r["ram_mean"], r["ram_std"]) for r in rows.collect()}
    assert got == {
        ("machine+window", 'we"b|1', None, "night"): (1.5, 0.5, 2.0, 1e-8), ("machine", 'we"b|1', None, None): (1.0, 2.0, 3.0, 4.0),
        ("machine", "db", None, None): (7.0, 1.0, None, None), ("type", None, "web", None): (1.0, 1.0, 1.0, 1.0), ("global", None, None, None): (5.0, 1.0, 6.0, 1.0),
    }
    text = documents.baseline_document(rows, machines, order).first()["value"]
    assert json.loads(text) == {**doc, "__windows__": ["night", "morning", "afternoon", "evening"]}
    readings = spark.createDataFrame([("db", "db", "night", 9.0, 8.0)], "machine string, type string, window string, cpu double, ram double")
    z = zscore(readings, materialize(rows), order).first()
    assert (z["z_cpu"], z["z_ram"], z["baseline_used"]) == (2.0, 2.0, "machine")


def test_graph_document(spark, tmp_path):
    doc = {"depends_on": {"web-01": "router-01", "db-01": "router-02"}, "routers": ["router-01", "router-02"], "downstream_of": {"router-01": ["web-01"]}}
    (tmp_path / "graph.json").write_text(json.dumps(doc, indent=2))
    edges, routers = src.read_graph(spark, str(tmp_path / "graph.json"))
    assert {tuple(r) for r in edges.collect()} == {("web-01", "router-01"), ("db-01", "router-02")}
    assert routers.count() == 2
    src.write_graph(edges, str(tmp_path / "edges"))
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 2


def test_prediction_log(spark, sf, tmp_path):
    df = fx.windowed(spark, sf)
    scored = z_threshold(zscore(df, bl.build_baselines(df, METRICS), METRICS), METRICS).withColumn("is_anomaly", F.col("pred"))
    path = str(tmp_path / "log")
    assert store.log_predictions(store.to_predictions(scored, METRICS, "v1", 3.0), path)
    assert store.log_predictions(store.to_predictions(scored.limit(5), METRICS, "v1", 3.0), path)
    log = store.read_predictions(spark, path)
    assert log.columns == PREDICTION_SCHEMA.fieldNames()
    n = df.count() + 5
    assert log.count() == n and log.select("id").distinct().count() == n
    assert set(json.loads(log.first()["features_json"])) == set(METRICS)
    assert fb.verdict_stats(log).first()["verdict"] == "_pending"


def test_failing_log_does_not_stop_scoring(spark, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("not a folder")
    df = spark.sql("SELECT current_timestamp() AS timestamp, 'x' AS id")
    assert store.log_predictions(df, f"{blocked}/log") is False
    with pytest.raises(Exception):
        store.log_predictions(df, f"{blocked}/log", best_effort=False)


def test_runs_and_promotions(spark, tmp_path):
    path = str(tmp_path / "runs")
    store.save_run(spark, path, "r1", "isolation_forest", "events", {"trees": 100}, METRICS, {"f1": 0.6, "roc_auc": None})
    store.save_run(spark, path, "r2", "isolation_forest", "events", {"trees": 200}, METRICS, {"f1": 0.7})
    runs = store.read_runs(spark, path)
    assert {r["run_id"]: r["metrics"]["f1"] for r in runs.collect()} == {"r1": 0.6, "r2": 0.7}
    verdict = lambda ok: spark.createDataFrame([(ok, "why")], "passed boolean, reason string")
    out = str(tmp_path / "promotions")
    for version, ok in (("v1", True), ("v2", True), ("v3", False)):
        store.record_attempt(verdict(ok), out, version, f"/models/{version}", {"f1": 0.7}, 10)
    history = spark.read.parquet(out)
    assert history.count() == 3 and fb.current_model(history).first()["model_version"] == "v2"


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_broadcast_only_within_the_bound(spark):
    table = materialize(spark.range(50))
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(table, 50)) and not hinted(broadcast_if_small(table, 49))
    assert few_rows(spark.range(10), 5).count() == 10 and few_rows(spark.range(3), 5).count() == 3


def log_rows(spark, n=5, at="2025-03-07 23:59:50"):
    values = [F.lit(at if f.name == "timestamp" else None).cast(f.dataType).alias(f.name) for f in PREDICTION_SCHEMA.fields]
    return spark.range(n).select(*values)


def test_every_batch_counts_once_per_query(spark, tmp_path):
    rows, path = log_rows(spark), str(tmp_path / "log")
    assert store.read_predictions(spark, path).count() == 0
    for query, batch in (("a", 0), ("a", 1), ("a", 1), ("b", 0), ("a", 0), ("b", 0)):
        assert store.log_predictions(rows, path, best_effort=False, query=query, batch=batch)
    assert store.read_predictions(spark, path).count() == 15
    assert store.log_predictions(rows, path, best_effort=False) and store.log_predictions(rows, path, best_effort=False)
    assert store.read_predictions(spark, path).count() == 25
    # A retry after midnight is the same batch, whatever day its rows now carry.
    store.log_predictions(log_rows(spark, at="2025-03-08 00:00:10"), path, best_effort=False, query="b", batch=0)
    days = store.read_predictions(spark, path).select(F.to_date("timestamp").cast("string")).distinct().collect()
    assert [d[0] for d in days] == ["2025-03-07"]


def test_attempts_that_were_not_committed_are_invisible(spark, tmp_path, monkeypatch):
    rows, path = log_rows(spark), str(tmp_path / "log")
    store.log_predictions(rows, path, query="a", batch=0)
    torn = rows.withColumns({"query": F.lit("a"), "batch": F.lit(1).cast("bigint"), "attempt": F.lit("torn"), "day": F.to_date("timestamp")})
    torn.write.mode("append").partitionBy("query", "batch", "attempt", "day").parquet(f"{path}/rows")
    assert store.read_predictions(spark, path).count() == 5
    assert commits.append_once(rows.withColumn("day", F.to_date("timestamp")), path, "a", 1, ("day",))
    assert store.read_predictions(spark, path).count() == 10
    # Two writers that both got through: the earlier entry is the batch.
    monkeypatch.setattr(commits, "manifest", lambda *a: spark.createDataFrame([], commits.MANIFEST))
    assert commits.append_once(log_rows(spark, 50).withColumn("day", F.to_date("timestamp")), path, "a", 1, ("day",))
    monkeypatch.undo()
    assert store.read_predictions(spark, path).count() == 10
