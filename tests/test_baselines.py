import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.functions.timefeat import add_window, hour_to_window
from fleetpulse.operators import baselines as bl
from fleetpulse.operators.zscore import attach_baselines, z_threshold, zscore
from fleetpulse.schemas import METRICS


def test_window_boundaries(spark):
    got = spark.range(24).select(hour_to_window(F.col("id")).alias("w")).toPandas()["w"].tolist()
    assert got == ["night"] * 6 + ["morning"] * 6 + ["afternoon"] * 6 + ["evening"] * 6


def test_windows_of_sample(sample):
    rows = add_window(sample).orderBy("machine", "timestamp").collect()
    assert [r["window"] for r in rows] == ["morning"] * 2 + ["evening"] * 5


def test_levels_and_values(sample):
    base = bl.build_baselines(add_window(sample), ["cpu"])
    rows = {(r["level"], r["machine"], r["window"]): r for r in base.collect()}
    assert {k for k in rows if k[0] == "machine+window"} == {
        ("machine+window", "alpha", "evening"),
        ("machine+window", "alpha", "morning"),
        ("machine+window", "beta", "evening"),
    }
    evening = rows[("machine+window", "alpha", "evening")]
    assert (evening["cpu_mean"], evening["cpu_std"]) == (34.0, pytest.approx(math.sqrt(32 / 3)))
    assert rows[("global", None, None)]["n"] == 7
    assert bl.metric_order(base) == ["cpu"]


@pytest.mark.parametrize(
    "machine, kind, window, level",
    [
        ("alpha", "mail", "evening", "machine+window"),
        ("alpha", "mail", "night", "machine"),
        ("alpha", "mail", None, "machine"),
        ("gamma", "mail", "evening", "type"),
        ("gamma", "proxy", "evening", "global"),
        ("gamma", None, None, "global"),
        ("gamma", "", "evening", "global"),
    ],
)
def test_fallback(spark, sample, machine, kind, window, level):
    base = bl.build_baselines(add_window(sample), ["cpu"])
    df = spark.createDataFrame([(machine, kind, window, 10.0)], "machine string, type string, window string, cpu double")
    assert attach_baselines(df, base, ["cpu"]).first()["baseline_used"] == level


def test_known_z(sample):
    df = add_window(sample)
    scored = zscore(df, bl.build_baselines(df, ["cpu"]), ["cpu"])
    assert scored.where("cpu = 90").first()["z_cpu"] == pytest.approx(1.0)


def test_flat_metric_stays_finite(spark):
    df = spark.createDataFrame([("flat-01", "web", "night", 50.0)] * 3, "machine string, type string, window string, cpu double")
    rows = zscore(df, bl.build_baselines(df, ["cpu"]), ["cpu"]).collect()
    assert all(math.isfinite(r["z_cpu"]) for r in rows)


def test_extreme_reading_is_flagged_and_plain_one_is_not(spark, sample):
    df = add_window(sample)
    base = bl.build_baselines(df, ["cpu"])
    new = spark.createDataFrame([("alpha", "mail", "evening", c) for c in (36.0, 99.0)], "machine string, type string, window string, cpu double")
    got = {r["cpu"]: r["pred"] for r in z_threshold(zscore(new, base, ["cpu"]), ["cpu"]).collect()}
    assert got == {36.0: 0, 99.0: 1}


def test_missing_metric_takes_global(spark):
    rows = [("a", "x", "night", 1.0, None), ("b", "x", "night", 3.0, 8.0), ("b", "x", "night", 5.0, 12.0)]
    df = spark.createDataFrame(rows, "machine string, type string, window string, cpu double, ram double")
    got = attach_baselines(df, bl.build_baselines(df, ["cpu", "ram"]), ["cpu", "ram"]).where("machine = 'a'").first()
    assert got["baseline_used"] == "machine+window" and got["ram_mean"] == 10.0


def test_single_row_with_sample_deviation_uses_floor(spark):
    df = spark.createDataFrame([("a", "x", "night", 1.0)], "machine string, type string, window string, cpu double")
    row = bl.build_baselines(df, ["cpu"], ddof=1, levels=("machine+window",)).first()
    assert row["cpu_std"] == 1e-8


def test_merged_spread_is_stable_far_from_zero(spark):
    """Large offset, small spread: the pooled deviation keeps its digits."""
    rng = np.random.default_rng(1)
    values = 1e9 + rng.normal(0, 1.0, 400)
    rows = [("m", f"t{i % 3}", "night" if i % 2 else "evening", float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "machine string, type string, window string, cpu double")
    base = bl.build_baselines(df, ["cpu"], levels=("machine", "global"))
    got = {r["level"]: r["cpu_std"] for r in base.collect()}
    assert got["machine"] == pytest.approx(values.std(), rel=1e-6)
    assert got["global"] == pytest.approx(max(values.std(), 1.0), rel=1e-6)


def test_training_rows_are_standardised(spark, sf):
    df = fx.windowed(spark, sf)
    scored = zscore(df, bl.build_baselines(df, METRICS), METRICS)
    groups = scored.groupBy("machine", "window").agg(
        F.avg("z_cpu").alias("m"), F.stddev_pop("z_cpu").alias("s"), F.stddev_pop("cpu").alias("raw")
    ).where("raw > 0").collect()
    assert max(abs(r["m"]) for r in groups) < 1e-9
    assert max(abs(r["s"] - 1) for r in groups) < 1e-9


def test_robust_bounds_of_hot_groups_equal_direct_ones(spark, sf):
    df = fx.windowed(spark, sf)
    take = lambda hot: {(r["machine"], r["window"]): r for r in bl.trim_bounds(df, ["cpu", "ram"], (0.05, 0.95), hot).collect()}
    direct, hot = take(10**9), take(8)
    assert direct.keys() == hot.keys()
    for k in direct:
        for c in ("cpu_lo", "cpu_hi", "ram_lo", "ram_hi"):
            assert hot[k][c] == pytest.approx(direct[k][c], abs=1e-9)


def test_adaptive_input_without_keys(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "load double")
    row = bl.build_baselines(df, ["load"], levels=("machine+window",)).first()
    assert (row["machine"], row["window"], row["load_mean"]) == ("__all__", "all", 2.0)
