import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.catalog import serving as cases
from fleetpulse.operators import baselines as bl
from fleetpulse.operators import boosting, rolling, serving
from fleetpulse.operators.boosting import SoftmaxBoosting
from fleetpulse.operators.trees import FlatTrees, cleaned, with_features
from fleetpulse.plans.tables import materialize
from fleetpulse.schemas import METRICS, ROLLING_METRICS


def lopsided(rng, trees):
    """Random trees of uneven depth, and a function that walks them."""
    rows, built = [], {}
    for t in range(trees):
        nodes, todo = {}, [0]
        while todo:
            i = todo.pop()
            if len(nodes) + len(todo) > 30 or rng.random() < 0.25:
                nodes[i] = (-1, 0.0, i, i, float(rng.normal()))
            else:
                left, right = len(nodes) + len(todo) + 1, len(nodes) + len(todo) + 2
                nodes[i] = (int(rng.integers(3)), float(rng.normal()), left, right, 0.0)
                todo += [left, right]
        built[t] = nodes
        rows += [(t, i, *n) for i, n in nodes.items()]

    def total(x):
        out = 0.0
        for nodes in built.values():
            i = 0
            while nodes[i][0] >= 0:
                f, cut, left, right, _ = nodes[i]
                i = left if x[f] <= cut else right
            out += nodes[i][4]
        return out

    return rows, total


def test_expressions_walk_like_a_loop_and_need_no_python(spark):
    rng = np.random.default_rng(1)
    rows, total = lopsided(rng, 9)
    points = [[float(v) for v in p] for p in rng.normal(0, 1.5, (60, 3))] + [[float("inf"), float("-inf"), 0.0]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(99, None, float("nan"), 0.3)], "i int, a double, b double, c double")
    flat = FlatTrees.of(rows)
    out = df.withColumn("s", with_features(["a", "b", "c"], flat.total))
    got = {r["i"]: r["s"] for r in out.collect()}
    want = {i: total(p) for i, p in enumerate(points)} | {99: total([0.0, 0.0, 0.3])}
    assert got == pytest.approx(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert df.select(cleaned(["b"])[0].alias("b")).where("isnan(b) OR b IS NULL").count() == 0
    assert df.select(with_features(["a"], FlatTrees.of([(0, 0, -1, 0.0, 0, 0, 2.5)]).total).alias("s")).distinct().collect() == [(2.5,)]


def brute_boosting(x, y, w, classes, cuts, rounds, depth, step=0.1, ridge=1.0, least=1.0):
    """Plain exact-greedy softmax boosting over given cut points; returns the margins of the rows."""
    margins = np.zeros((len(x), classes))
    for _ in range(rounds):
        p = np.exp(margins - margins.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        added = np.zeros_like(margins)
        for k in range(classes):
            g = np.rint((p[:, k] - (y == k)) * w * boosting.SCALE) / boosting.SCALE
            h = np.rint(np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16) * w * boosting.SCALE) / boosting.SCALE

            def grow(rows, level):
                value = step * -g[rows].sum() / (h[rows].sum() + ridge)
                best, where = 1e-6, None
                for f, points in enumerate(cuts):
                    for c in points:
                        left = rows[x[rows, f] <= c]
                        right = rows[x[rows, f] > c]
                        if level == depth or h[left].sum() < least or h[right].sum() < least:
                            continue
                        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)
                        gain = part(left) + part(right) - part(rows)
                        if gain > best + 1e-9:
                            best, where = gain, (left, right)
                if where is None:
                    added[rows, k] = value
                else:
                    for side in where:
                        grow(side, level + 1)

            grow(np.arange(len(x)), 0)
        margins += added
    return margins


@pytest.fixture(scope="module")
def causes(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (240, 3)), 1)
    y = np.where(x[:, 0] > 0.6, 1, np.where(x[:, 1] * x[:, 2] > 0.5, 2, 0))
    w = rng.choice([1.0, 2.0, 5.0], 240)
    names = np.array(["normal", "spike", "leak"])
    order = {"leak": 0, "normal": 1, "spike": 2}
    rows = [(i, *map(float, p), str(names[k]), float(v)) for i, (p, k, v) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(rows, "event_id int, a double, b double, c double, cause string, weight double")
    return materialize(df), x, np.array([order[names[k]] for k in y]), w


@pytest.mark.parametrize("kept", [10, 2])
def test_boosting_equals_brute_force(spark, causes, monkeypatch, kept):
    monkeypatch.setattr(boosting, "ROUNDS_KEPT", kept)
    df, x, y, w = causes
    cuts = [sorted(set(np.round(np.quantile(x[:, f], np.linspace(0.1, 0.9, 9)), 2).tolist())) for f in range(3)]
    jobs = []
    inner = boosting.histograms
    monkeypatch.setattr(boosting, "histograms", lambda *a: jobs.append(1) or inner(*a))
    model = SoftmaxBoosting.fit(df.repartition(5), ["a", "b", "c"], weight="weight", rounds=5, depth=3, cuts=cuts)
    assert model.classes == ["leak", "normal", "spike"] and len(jobs) <= 15
    margins = brute_boosting(x, y, w, 3, cuts, 5, 3)
    want = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
    got = {r["event_id"]: [e["p"] for e in r["probs"]] for r in model.probabilities(df).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-9)
    again = SoftmaxBoosting.fit(df, ["a", "b", "c"], weight="weight", rounds=5, depth=3, cuts=cuts)
    assert again.nodes == model.nodes


def test_boosting_learns_saves_and_takes_odd_rows(spark, causes, tmp_path):
    df, _, _, _ = causes
    odd = spark.createDataFrame([(900, None, float("nan"), 0.0, "normal", None), (901, 1.0, 1.0, 1.0, None, 1.0)], df.schema)
    model = SoftmaxBoosting.fit(df.unionByName(odd), ["a", "b", "c"], weight="weight", rounds=12, depth=4, step=0.3)
    scored = model.probabilities(df).withColumn("best", F.expr("array_max(transform(probs, e -> struct(e.p, e.cause))).cause"))
    assert scored.where("best = cause").count() > 0.97 * df.count()
    model.save(str(tmp_path / "m"))
    loaded = SoftmaxBoosting.load(str(tmp_path / "m"))
    assert sorted(loaded.nodes) == sorted(model.nodes) and loaded.features == model.features
    one = SoftmaxBoosting.fit(df.where("cause = 'leak'"), ["a"], rounds=2)
    assert one.probabilities(df).select(F.inline("probs")).distinct().collect() == [("leak", 1.0)]
    with pytest.raises(ValueError):
        SoftmaxBoosting.fit(df.limit(0), ["a"], rounds=1)


def test_bundle_refuses_other_feature_orders(spark, sf):
    good = cases.saved_bundle(spark, sf)
    part = {f: getattr(good, f) for f in good.__dataclass_fields__}
    z = good.forest.features
    for broken in (
        {"metrics": list(reversed(METRICS))},
        {"plain": cases.ruled_boosting(z[::-1])},
        {"trends": cases.ruled_boosting(z)},
        {"forest": type(good.forest)(good.forest.nodes, z[1:] + z[:1], 1, 1)},
        {"baselines": good.baselines.drop("cpu_mean", "cpu_std")},
    ):
        with pytest.raises(ValueError):
            serving.Bundle(**{**part, **broken})


def test_saved_bundle_scores_like_the_original_in_batch_and_stream(spark, sf, tmp_path):
    bundle = cases.saved_bundle(spark, sf)
    rows = materialize(cases.asked(spark, sf).where("event_id < 300").select("event_id", "machine", "type", "window", "history", *METRICS))
    batch = serving.score(rows, bundle)
    assert batch.columns[:5] == ["event_id", "machine", "type", "window", "history"]
    kept = ["event_id", "is_anomaly", "likely_cause", "p_normal", "iso_score", "rolling_features_used"]
    want = sorted(map(tuple, batch.select(*kept).collect()))
    path = str(tmp_path / "in")
    for i in range(3):
        rows.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (
        serving.score(stream, bundle).select(*kept).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*kept).collect())) == want
    assert "Python" not in batch._jdf.queryExecution().executedPlan().toString()


def test_requests_are_windowed_or_refused(spark, sf):
    bundle = cases.saved_bundle(spark, sf)
    full = {m: 50.0 for m in METRICS}
    rows = [
        ("m-00001", full, None, 3, None, None),
        ("m-00001", full, None, None, "2026-05-05T13:00:00", None),
        ("new", full, "web", 24, None, None),
        ("new", full, "web", None, "yesterday", None),
        ("new", {k: v for k, v in full.items() if k != "ram"}, "web", 1, None, None),
        ("new", full, None, None, None, {m: [1.0, 2.0] for m in ROLLING_METRICS}),
    ]
    shape = "machine string, metrics map<string,double>, machine_type string, hour int, timestamp string, history map<string,array<double>>"
    asked = serving.requests_to_readings(spark.createDataFrame(rows, shape), METRICS)
    found = asked.collect()
    assert [r["window"] for r in found] == ["night", "afternoon", None, None, "night", None]
    assert [r["error"] is None for r in found] == [True, True, False, False, False, True]
    assert found[4]["error"] == "missing metric: ram"
    scored = serving.score(asked.where("error IS NULL"), bundle).collect()
    known = {(r["machine"], r["window"]): r for r in scored}
    assert known["m-00001", "night"]["machine_known"] and known["m-00001", "night"]["type"] == "router"
    assert known["new", None]["baseline_used"] == "global" and known["new", None]["rolling_features_used"]


def test_fitted_bundle_serves_with_its_own_models(spark, sf):
    train = rolling.add_rolling(fx.windowed(spark, sf), ROLLING_METRICS)
    bundle = serving.fit_bundle(
        train, METRICS, "v5", 0.05, bl.known_machines(train), bl.build_baselines(train, METRICS), rounds=2, depth=2, bins=8
    )
    out = serving.score(cases.asked(spark, sf), bundle)
    flagged = out.agg(F.avg("iso_is_anomaly"), F.count(F.lit(1)), F.avg((F.col("is_anomaly") >= F.col("clf_is_anomaly")).cast("int"))).first()
    assert 0.02 < flagged[0] < 0.08 and flagged[1] == train.count() and flagged[2] == 1.0
