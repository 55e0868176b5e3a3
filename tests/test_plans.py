"""Helpers that keep hot keys parallel, against brute force; and the plans themselves."""

import datetime as dt
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.operators import baselines as bl
from fleetpulse.functions import timefeat
from fleetpulse.operators import dashboard, evaluate, replay, rolling, sampling
from fleetpulse.operators.zscore import zscore
from fleetpulse.plans import chunks, prefix
from fleetpulse.plans.scalars import value_of
from fleetpulse.plans.tables import materialize
from fleetpulse.schemas import METRICS


@pytest.fixture(scope="module")
def skewed(spark):
    """One machine holds most rows, bursts and repeated timestamps included."""
    rnd = random.Random(7)
    rows = []
    for i in range(900):
        machine = "hot" if rnd.random() < 0.7 else f"m{rnd.randrange(6)}"
        second = rnd.choice([rnd.randrange(4000), rnd.randrange(60)])
        rows.append((i, machine, second, rnd.random() * 100, int(rnd.random() < 0.4), int(rnd.random() < 0.15)))
    pdf = pd.DataFrame(rows, columns=["event_id", "machine", "second", "cpu", "label", "pred"])
    pdf["score"] = pdf["cpu"] / 100
    df = spark.createDataFrame(pdf).withColumn(
        "timestamp", F.expr("timestamp_ntz '2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, second)")
    )
    return materialize(df, "skewed"), pdf.sort_values(["machine", "second", "event_id"])


@pytest.mark.parametrize("chunk_rows", [None, 40, 3, 10**6])
def test_rolling_matches_pandas(skewed, chunk_rows):
    df, pdf = skewed
    got = rolling.add_rolling(df, ("cpu",), chunk_rows=chunk_rows).toPandas().sort_values(["machine", "second", "event_id"])
    g = pdf.groupby("machine")["cpu"]
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got["cpu_rolling_mean"], g.rolling(10, min_periods=1).mean().to_numpy(), atol=1e-9)
    np.testing.assert_allclose(got["cpu_rolling_std"], g.rolling(10, min_periods=2).std().fillna(0).to_numpy(), atol=1e-7)
    np.testing.assert_allclose(got["cpu_delta"], g.diff(9).fillna(0).to_numpy(), atol=1e-9)


def adjusted(pdf, source):
    out = []
    for _, g in pdf.groupby("machine"):
        values, label = g[source].tolist(), g["label"].tolist()
        i = 0
        while i < len(label):
            j = i
            while j < len(label) and label[j] == 1:
                j += 1
            if j > i:
                values[i:j] = [max(values[i:j])] * (j - i)
            i = max(j, i + 1)
        out += values
    return out


@pytest.mark.parametrize("chunk_rows", [None, 40, 2])
def test_point_adjust_matches_brute_force(skewed, chunk_rows):
    df, pdf = skewed
    got = evaluate.point_adjust(df, chunk_rows=chunk_rows).toPandas().sort_values(["machine", "second", "event_id"])
    assert got["pred_adj"].tolist() == adjusted(pdf, "pred")
    np.testing.assert_allclose(got["score_adj"], adjusted(pdf, "score"))
    assert got["pred_adj"].sum() >= pdf["pred"].sum()


@pytest.mark.parametrize("chunk_rows", [None, 25])
def test_row_index(skewed, chunk_rows):
    df, pdf = skewed
    got = chunks.row_index(df, ["machine"], ["timestamp", "event_id"], "i", chunk_rows).toPandas()
    want = pdf.assign(i=pdf.groupby("machine").cumcount() + 1)
    assert dict(zip(got["event_id"], got["i"])) == dict(zip(want["event_id"], want["i"]))


@pytest.mark.parametrize("chunk_rows", [None, 25])
def test_incidents(skewed, chunk_rows):
    df, pdf = skewed
    got = replay.incidents(df, 20.0, chunk_rows=chunk_rows).toPandas()
    new = pdf.groupby("machine")["second"].diff().fillna(10**9) > 20
    assert len(got) == new.sum() and got["n"].sum() == len(pdf)


def test_hot_keys_are_cut(skewed):
    df, _ = skewed
    sliced, split = chunks.assign_chunks(df, ["machine"], "timestamp", 100)
    assert split
    counts = {r["machine"]: r["n"] for r in sliced.groupBy("machine").agg(F.count_distinct("_chunk").alias("n")).collect()}
    assert counts["hot"] > 3 and all(n == 1 for m, n in counts.items() if m != "hot")


def test_cumulative_counts(skewed):
    df, pdf = skewed
    rounded = df.withColumn("v", F.round(F.col("cpu") - 50, 0))
    got = prefix.cumulative_counts(rounded, ["machine"], "v", {"cnt": F.count(F.lit(1))}).toPandas()
    pdf = pdf.assign(v=np.round(pdf["cpu"] - 50))
    for r in got.sample(60, random_state=1).itertuples():
        own = pdf[pdf.machine == r.machine]
        assert r.cnt == (own.v == r.v).sum() and r.cnt_below == (own.v < r.v).sum()


def test_value_buckets_are_monotone(spark):
    values = sorted([0.0, -1e-15, 1e-15, -5.0, -0.3, 1e9, -1e9, 3.0, 3.0000001] + list(np.random.default_rng(0).normal(0, 100, 300)))
    got = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", prefix.value_bucket(F.col("v")).alias("b")).toPandas()
    assert got.sort_values("v")["b"].is_monotonic_increasing


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.932, 1.0])
def test_exact_percentiles(skewed, q):
    df, pdf = skewed
    got = {r["machine"]: r["p"] for r in prefix.exact_percentiles(df, ["machine"], "cpu", {"p": q}).collect()}
    for m, g in pdf.groupby("machine"):
        assert got[m] == pytest.approx(np.quantile(g["cpu"], q), abs=1e-9)


@pytest.mark.parametrize("quota", [0, 1, 5, 10**6])
def test_mark_smallest_is_exact(skewed, quota):
    df, pdf = skewed
    got = prefix.mark_smallest(df, ["machine"], F.lit(quota), ["event_id"], 3).where("in_sample").toPandas()
    digest = lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest()
    want = set()
    for _, g in pdf.groupby("machine"):
        want |= set(sorted(g["event_id"], key=digest)[:quota])
    assert set(got["event_id"]) == want


def test_global_index(skewed):
    df, pdf = skewed
    got = prefix.global_index(df, ["timestamp", "event_id"], "i").toPandas()
    want = pdf.sort_values(["second", "event_id"])["event_id"].tolist()
    assert got.sort_values("i")["event_id"].tolist() == want and sorted(got["i"]) == list(range(1, len(want) + 1))


def test_auc_and_average_precision(skewed):
    df, pdf = skewed
    coarse = df.withColumn("s", F.round("score", 1))
    s, y = pdf["score"].round(1).to_numpy(), pdf["label"].to_numpy()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert evaluate.roc_auc(coarse, score="s").first()["roc_auc"] == pytest.approx(auc)
    # A monotone change of the score leaves it alone.
    assert evaluate.roc_auc(coarse.withColumn("s", F.exp("s") * 3 - 9), score="s").first()["roc_auc"] == pytest.approx(auc)
    area, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        recall, precision = (y[s >= t] == 1).sum() / y.sum(), (y[s >= t] == 1).mean()
        area, last = area + (recall - last) * precision, recall
    assert evaluate.average_precision(coarse, score="s").first()["pr_auc"] == pytest.approx(area)


def test_one_class_has_no_auc(skewed):
    df, _ = skewed
    row = evaluate.rank_quality(df.where("label = 0")).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None


def test_sampling_keeps_sizes(skewed):
    df, pdf = skewed
    split = sampling.stratified_split(df).groupBy("label").agg(F.count_if("is_train").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["k"] == round(0.7 * r["n"]) for r in split)
    assert sampling.hash_sample(df, 37).count() == 37


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_fallback_join_never_shuffles_readings(spark, sf):
    df = materialize(fx.windowed(spark, sf), "facts")
    plan = plan_of(zscore(df, bl.build_baselines(df, METRICS), METRICS).select("event_id", "z_cpu"))
    final = plan.split("AdaptiveSparkPlan")[0] + plan
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    # The only shuffle builds the small machine lookup.
    assert final.count("hashpartitioning(machine") <= 2 and "hashpartitioning(machine#" in plan


def test_scan_is_pruned_and_filtered(spark, sf):
    plan = plan_of(fx.readings(spark, sf).where("cpu > 100").select("event_id", "machine"))
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,100.0)]" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan


def test_rolling_features_share_one_shuffle(spark, sf):
    df = materialize(fx.readings(spark, sf), "facts")
    plan = plan_of(rolling.add_rolling(df))
    assert plan.count("Exchange hashpartitioning") + plan.count(") Exchange") >= 1
    assert len([l for l in plan.splitlines() if "hashpartitioning(" in l]) == 1


def test_point_adjust_of_ordinary_keys_shuffles_once(spark, sf):
    df = materialize(fx.readings(spark, sf).withColumn("pred", F.col("label")).withColumn("score", F.col("cpu")), "facts")
    plan = plan_of(evaluate.point_adjust(df))
    assert len([l for l in plan.splitlines() if "hashpartitioning(" in l]) == 1 and "Join" not in plan


def pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan)


def test_bounds_of_a_first_pass_reach_the_scan(spark, sf, tmp_path):
    df = materialize(fx.readings(spark, sf).withColumn("pred", F.lit(1)), "readings")
    early = timefeat.first_days(df, 5)
    low = df.agg(F.min("timestamp")).first()[0]
    want = [r["event_id"] for r in df.collect() if r["timestamp"] < low + dt.timedelta(days=5)]
    assert sorted(r["event_id"] for r in early.collect()) == sorted(want) and 0 < len(want) < df.count()
    assert any("LessThan(timestamp" in f for f in pushed(early))
    newest = dashboard.latest_tick_metrics(df, "timestamp")
    assert any("EqualTo(timestamp" in f for f in pushed(newest)) and newest.first()["anomaly_count"] == 1
    none = dashboard.latest_tick_metrics(df.where("event_id < 0"), "timestamp").first()
    assert none["anomaly_count"] is None and timefeat.first_days(df.where("event_id < 0"), 5).count() == 0
    assert df.select(value_of(df, F.max("cpu")).alias("v")).first()["v"] == df.agg(F.max("cpu")).first()[0]
