from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetpulse.functions import decisions as dec
from fleetpulse.functions.timefeat import add_cyclic_time, every_nth_hour, first_days, resolve_window
from fleetpulse.operators import feedback as fb
from fleetpulse.operators import rootcause as rc
from fleetpulse.operators import selection
from fleetpulse.schemas import METRICS, SAFETY_NET_CAUSE


def probs(spark, **p):
    pairs = ", ".join(f"named_struct('cause', '{c}', 'p', {v}D)" for c, v in p.items())
    return spark.sql(f"SELECT array({pairs}) AS probs")


@pytest.mark.parametrize(
    "p, per_class, flag, cause",
    [
        (dict(normal=0.9, cpu_spike=0.1), None, 0, "normal"),
        (dict(normal=0.85, cpu_spike=0.15), None, 0, "normal"),
        (dict(normal=0.5, cpu_spike=0.2, memory_leak=0.3), None, 1, "memory_leak"),
        (dict(normal=0.4, memory_leak=0.3, cpu_spike=0.3), None, 1, "cpu_spike"),
        (dict(normal=0.4, cpu_spike=0.6), {"cpu_spike": 0.6}, 1, "cpu_spike"),
        (dict(normal=0.4, cpu_spike=0.6), {"memory_leak": 0.1}, 0, "normal"),
        (dict(normal=0.2, cpu_spike=0.5, memory_leak=0.3), {"cpu_spike": 0.45, "memory_leak": 0.1}, 1, "memory_leak"),
    ],
)
def test_decisions(spark, p, per_class, flag, cause):
    row = dec.decide(probs(spark, **p), per_class=per_class).first()
    assert (row["clf_is_anomaly"], row["clf_cause"]) == (flag, cause)


@pytest.mark.parametrize(
    "clf, iso, flag, cause", [(1, 0, 1, "cpu_spike"), (1, 1, 1, "cpu_spike"), (0, 1, 1, SAFETY_NET_CAUSE), (0, 0, 0, None)]
)
def test_or_gate(spark, clf, iso, flag, cause):
    df = spark.createDataFrame([(clf, iso, "cpu_spike")], "clf_is_anomaly int, iso_is_anomaly int, clf_cause string")
    row = dec.or_gate(df).first()
    assert (row["is_anomaly"], row["likely_cause"]) == (flag, cause)


@pytest.mark.parametrize(
    "hour, ts, window, bad",
    [
        (14, "2026-06-29T03:00:00", "afternoon", False),
        (None, "2026-06-29T03:00:00", "night", False),
        (None, None, None, False),
        (24, None, None, True),
        (-1, None, None, True),
        (None, "yesterday", None, True),
    ],
)
def test_resolve_window(spark, hour, ts, window, bad):
    row = resolve_window(spark.createDataFrame([(hour, ts)], "hour int, timestamp string")).first()
    assert row["window"] == window and (row["error"] is not None) == bad


def test_history_features(spark):
    df = spark.createDataFrame(
        [
            (1, {"cpu": [float(i) for i in range(12)], "ram": [5.0]}),
            (2, {"cpu": [1.0, 3.0], "ram": []}),
            (3, {"cpu": [1.0]}),
            (4, None),
        ],
        "id int, history map<string,array<double>>",
    )
    got = {r["id"]: r for r in dec.rolling_from_history(df, ("cpu", "ram")).collect()}
    assert got[1]["history_ok"] and got[1]["cpu_rolling_mean"] == 6.5 and got[1]["cpu_delta"] == 9.0
    assert got[1]["cpu_rolling_std"] == pytest.approx(3.0276503540974917)
    assert got[1]["ram_rolling_std"] == 0.0 and got[1]["ram_delta"] == 0.0
    assert not any(got[i]["history_ok"] for i in (2, 3, 4)) and got[2]["cpu_rolling_mean"] is None


def test_cyclic_time_monday_is_zero(spark):
    df = spark.sql("SELECT timestamp_ntz '2026-06-29 06:00:00' AS timestamp")
    row = add_cyclic_time(df).first()
    assert row["dow_sin"] == 0 and row["dow_cos"] == 1 and row["hour_sin"] == pytest.approx(1)


def test_first_days_and_systematic_sample(spark):
    df = spark.sql("SELECT explode(sequence(timestamp_ntz '2026-01-01 00:00:00', timestamp_ntz '2026-01-03 23:30:00', interval 30 minutes)) AS timestamp")
    assert first_days(df, 2).count() == 96 and every_nth_hour(df).count() == 18


def batch(spark, rows):
    df = spark.createDataFrame(rows, "machine string, score double")
    return df.withColumn("tick", F.lit(1))


def test_router_with_anomalous_dependents_comes_first(spark):
    edges = spark.createDataFrame([(f"web-0{i}", "router-01") for i in range(1, 5)], "machine string, router string")
    rows = [("router-01", 0.55), ("web-01", 0.62), ("web-02", 0.58), ("web-03", 0.60), ("web-04", 0.59), ("other-01", 0.71)]
    ranked = rc.rank_root_causes(rc.score_root_causes(batch(spark, rows), edges, with_list=True)).orderBy("rank").collect()
    assert ranked[0]["machine"] == "router-01" and ranked[0]["root_cause_score"] == pytest.approx(1.15)
    assert ranked[0]["downstream_anomalous"] == ["web-01", "web-02", "web-03", "web-04"]
    roles = {r["machine"]: r["role"] for r in ranked}
    assert roles["router-01"] == "likely_root_cause" and roles["web-02"] == "downstream_effect" and roles["other-01"] == "isolated"


def test_lone_router_and_lone_anomaly(spark):
    edges = spark.createDataFrame([("web-01", "router-01"), ("web-02", "router-02")], "machine string, router string")
    rows = batch(spark, [("router-01", 0.5), ("web-02", 0.6)])
    assert {r["role"] for r in rc.score_root_causes(rows, edges).collect()} == {"isolated"}
    alone = rc.tick_roles(batch(spark, [("router-01", 0.5)]), edges).first()
    assert (alone["role"], alone["root_cause_score"]) == ("isolated", 0.5)


def test_assigned_routers_cycle_through_the_fleet(spark):
    names = [("db-01", "db"), ("dns-01", "dns"), ("router-01", "router"), ("router-02", "router"), ("web-01", "web"), ("web-02", "web")]
    got = {r["machine"]: r["router"] for r in rc.assign_routers(spark.createDataFrame(names, "machine string, type string")).collect()}
    assert got == {"db-01": "router-01", "web-01": "router-01", "web-02": "router-02"}


def test_missing_metric_is_named(spark):
    full = {m: 1.0 for m in METRICS}
    part = {m: 1.0 for m in METRICS if m != "load_avg"}
    df = spark.createDataFrame([(1, full), (2, part)], "id int, metrics map<string,double>")
    assert {r["id"]: r["missing"] for r in selection.require_metrics(df, METRICS).collect()} == {1: None, 2: "load_avg"}


def test_metric_selection(spark):
    df = spark.createDataFrame([(1, 1.0, 7.0, 10.0, 0.1), (2, 2.0, 7.0, 90.0, 0.2)], "id int, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    assert selection.select_metrics(df, names, "first3").columns == ["id", "cpu", "ram", "network"]
    assert selection.select_metrics(df, names, "top3").orderBy("id").first()["cpu"] == 10.0
    assert selection.drop_constant(df, names)[1] == ["a", "c", "d"]
    assert selection.infer_features(df.withColumn("label", F.lit(1))) == ["id", "a", "b", "c", "d"]
    with pytest.raises(ValueError):
        selection.select_metrics(df, names, "best")


def log(spark, rows):
    return spark.createDataFrame(rows, "id string, machine string, raw_metrics_json string, final_cause string, operator_verdict string")


def test_feedback_labels_and_rejects(spark):
    raw = '{"cpu": 1, "ram": 2, "network": 3, "disk_io": 4, "disk_usage": 5, "load_avg": 6}'
    rows = [
        ("1", "a", raw, "cpu_spike", "true_positive"),
        ("2", "a", raw, None, "true_positive"),
        ("3", "a", raw, "cpu_spike", "false_positive"),
        ("4", "a", raw, None, "true_negative"),
        ("5", "a", raw, None, "false_negative"),
        ("6", "a", raw, None, None),
        ("7", "b", '{"cpu": 1}', None, "true_negative"),
        ("8", "b", raw, None, "perhaps"),
        ("9", "b", "not json", None, "true_negative"),
    ]
    ok, bad = fb.feedback_to_training(log(spark, rows))
    assert {r["id"]: r["cause"] for r in ok.collect()} == {
        "1": "cpu_spike", "2": "unknown_feedback", "3": "normal", "4": "normal", "5": "unknown_feedback"
    }
    assert ok.first()["weight"] == 5.0 and ok.first()["load_avg"] == 6.0
    assert {r["id"] for r in bad.collect()} == {"7", "8", "9"}


def test_last_verdict_wins(spark):
    t = lambda h: datetime(2026, 1, 1, h)
    verdicts = spark.createDataFrame(
        [("1", "true_positive", t(1), "a", 1), ("1", "false_positive", t(2), "b", 2), ("2", "wrong", t(3), "c", 3), ("9", "true_negative", t(4), "d", 4)],
        "id string, verdict string, verdict_timestamp timestamp, notes string, seq int",
    )
    base = log(spark, [("1", "a", "{}", None, None), ("2", "a", "{}", None, None)])
    updated, unknown = fb.apply_verdicts(base, verdicts)
    assert {r["id"]: r["operator_verdict"] for r in updated.collect()} == {"1": "false_positive", "2": None}
    assert [r["id"] for r in unknown.collect()] == ["9"]


@pytest.mark.parametrize(
    "new_f1, new_recall, passed, reason",
    [
        (0.72, {"cpu_spike": 0.90, "cascade": 0.04}, True, "no measure fell"),
        (0.709, {"cpu_spike": 0.95, "cascade": 0.04}, False, "lower F1: 0.709 after 0.718"),
        (0.72, {"cpu_spike": 0.80, "cascade": 0.04}, False, "lower recall of cpu_spike: 0.800 after 0.894"),
        (0.72, {"cascade": 0.04}, False, "lower recall of cpu_spike: 0.000 after 0.894"),
        (0.718, {"cpu_spike": 0.85, "cascade": 0.0}, True, "no measure fell"),
    ],
)
def test_guardrail(spark, new_f1, new_recall, passed, reason):
    f1 = lambda v: spark.createDataFrame([(v,)], "f1 double")
    rec = lambda d: spark.createDataFrame(list(d.items()), "cause string, recall double")
    row = fb.guardrail(f1(0.718), f1(new_f1), rec({"cpu_spike": 0.894, "cascade": 0.042}), rec(new_recall)).first()
    assert (row["passed"], row["reason"]) == (passed, reason)


def test_recent_is_clamped(spark):
    df = spark.range(1500).selectExpr("CAST(id AS STRING) AS id", "timestamp_seconds(id) AS timestamp")
    assert fb.recent(df, 5000).count() == 1000 and fb.recent(df, 0).count() == 1
    assert fb.recent(df, 1).first()["id"] == "1499"
