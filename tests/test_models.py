import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.functions import decisions as dec
from fleetpulse.operators import evaluate, feedback, neighbours, retrain, sampling, sweep
from fleetpulse.operators.baselines import build_baselines
from fleetpulse.operators.classifier import CauseClassifier, p_of
from fleetpulse.operators.iforest import IsolationForest, expected_path, flag_over
from fleetpulse.operators.lof import LocalOutlierFactor
from fleetpulse.operators.reconstruction import Reconstruction
from fleetpulse.operators.rootcause import likely_root_causes, rank_root_causes, top_root_causes
from fleetpulse.plans.tables import materialize
from fleetpulse.schemas import METRICS


@pytest.fixture(scope="module")
def cloud(spark):
    """A cloud of points and a few far ones."""
    rng = np.random.default_rng(5)
    inner = rng.normal(0, 1, (760, 3))
    outer = rng.normal(0, 1, (40, 3)) + rng.choice([-7, 7], (40, 3))
    points = np.vstack([inner, outer])
    rows = [(i, *map(float, p), int(i >= 760)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, c double, label int")
    return materialize(df, "cloud"), points


ABC = ["a", "b", "c"]


def test_path_length_constants():
    assert expected_path(1) == 0 and expected_path(2) == 1
    assert expected_path(256) == pytest.approx(10.244770920116851)


def test_forest_finds_far_points_and_is_reproducible(spark, cloud, tmp_path):
    df, _ = cloud
    forest = IsolationForest.fit(df, ABC, trees=60)
    scored = materialize(forest.score(df), "scored")
    low, high = scored.agg(F.min("iso_score"), F.max("iso_score")).first()
    assert 0 < low < high < 1
    assert evaluate.roc_auc(scored, score="iso_score").first()["roc_auc"] > 0.99
    flagged = flag_over(scored, forest.threshold(scored, 0.05)).agg(F.avg("iso_is_anomaly")).first()[0]
    assert flagged == pytest.approx(0.05, abs=0.005)
    # Another partitioning grows the same trees.
    again = IsolationForest.fit(df.repartition(7), ABC, trees=60)
    key = lambda f: sorted(map(tuple, f.nodes.collect()))
    assert key(again) == key(forest)
    forest.save(str(tmp_path / "forest"))
    loaded = IsolationForest.load(spark, str(tmp_path / "forest"))
    a = {r["event_id"]: r["iso_score"] for r in scored.collect()}
    b = {r["event_id"]: r["iso_score"] for r in loaded.score(df).collect()}
    assert a == pytest.approx(b)


def test_forest_samples_are_bounded(spark):
    df = spark.range(60_000).selectExpr("id AS event_id", "rand(3) AS a", "rand(4) AS b")
    forest = IsolationForest.fit(materialize(df), ["a", "b"], trees=20, max_samples=64)
    per_tree = forest.nodes.groupBy("tree").count().collect()
    assert len(per_tree) == 20 and all(r["count"] <= 127 for r in per_tree)
    assert all(r["count"] > 30 for r in per_tree)


def test_lof_matches_brute_force(spark, cloud):
    df, points = cloud
    fit, rest = points[:500], points[500:]
    model = LocalOutlierFactor.fit(df.where("event_id < 500"), ABC, k=20)
    got = {r["event_id"]: r["lof"] for r in model.score(df.where("event_id >= 500")).collect()}
    dist = lambda x: np.sqrt(((x[:, None] - fit[None]) ** 2).sum(2))
    own = dist(fit)
    np.fill_diagonal(own, np.inf)
    near = np.argsort(own, 1)[:, :20]
    reach = np.take_along_axis(own, near, 1)[:, -1]
    density = 1 / (np.maximum(np.take_along_axis(own, near, 1), reach[near]).mean(1) + 1e-10)
    d = dist(rest)
    near = np.argsort(d, 1)[:, :20]
    mine = 1 / (np.maximum(np.take_along_axis(d, near, 1), reach[near]).mean(1) + 1e-10)
    want = density[near].mean(1) / mine
    assert [got[i] for i in range(500, 800)] == pytest.approx(want.tolist())


def brute_nearest(a, b, weights, k, alone):
    """Per row of a: sorted distances to the k nearest of b, points counted by weight."""
    out = []
    for i, x in enumerate(a):
        d = np.sqrt(((x - b) ** 2).sum(1))
        times = weights - (np.arange(len(b)) == i) if alone else weights
        out.append(np.sort(np.repeat(d, times))[:k])
    return out


@pytest.mark.parametrize("alone", [True, False])
@pytest.mark.parametrize("dims,block", [(2, 4096), (3, 16), (20, 64)])
def test_neighbour_join_equals_brute_force(spark, monkeypatch, alone, dims, block):
    monkeypatch.setattr(neighbours, "CELL_POINTS", 12)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(dims)
    b = np.unique(np.round(np.vstack([rng.normal(0, 1, (150, dims)), rng.normal(8, 0.1, (60, dims)), np.zeros((1, dims))]), 2), axis=0)
    weights = rng.choice([1, 1, 1, 4, 40], len(b))
    a = b if alone else np.vstack([rng.normal(3, 5, (70, dims)), b[:5]])
    frame = lambda x, *more: materialize(spark.createDataFrame([(i, [float(v) for v in p], *[int(m[i]) for m in more]) for i, p in enumerate(x)], "_id bigint, _x array<double>" + ", _n bigint" * len(more)))
    reference = frame(b, weights)
    found = neighbours.nearest(reference if alone else frame(a), reference, 7, alone).collect()
    got = {}
    for r in found:
        got.setdefault(r["_q"], []).extend([r["_d"]] * r["_n"])
    want = brute_nearest(a, b, weights, 7, alone)
    assert len(got) == len(a) and all(np.allclose(sorted(got[i]), want[i], atol=1e-12) for i in range(len(a)))


def test_neighbour_bounds_spare_far_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_POINTS", 10)
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 0.01, (40, 2)) for c in rng.uniform(-100, 100, (25, 2))])
    df = materialize(spark.createDataFrame([(i, [float(v) for v in p], 1) for i, p in enumerate(x)], "_id bigint, _x array<double>, _n bigint"))
    asked = []
    inner = neighbours.compare_blocks
    monkeypatch.setattr(neighbours, "compare_blocks", lambda visits, *a: asked.append(visits.count()) or inner(visits, *a))
    neighbours.nearest(df, df, 5, True)
    assert asked[0] == 1000 and asked[1] < 6000  # 100 cells: all pairs would be 99,000 visits


def test_lof_with_copies_nulls_and_tiny_training_sets(spark):
    rows = [(i, float(i % 5), 0.0) for i in range(40)] + [(100, None, float("nan")), (101, -0.0, 0.0), (102, 50.0, 50.0)]
    df = materialize(spark.createDataFrame(rows, "event_id long, a double, b double"))
    model = LocalOutlierFactor.fit(df.where("event_id < 100"), ["a", "b"], k=3)
    got = {r["event_id"]: r["lof"] for r in model.score(df.withColumn("lof", F.lit("old"))).collect()}
    assert len(got) == len(rows) and got[100] == got[101] == got[0] and got[102] > 1000
    assert model.threshold(0.1).first()[0] == pytest.approx(1.0)
    alone = LocalOutlierFactor.fit(df.limit(1), ["a", "b"])
    assert alone.score(df).count() == len(rows)
    none = LocalOutlierFactor.fit(df.limit(0), ["a", "b"])
    assert none.score(df).where("lof IS NOT NULL").count() == 0 and none.threshold(0.1).count() <= 1


def test_reconstruction_error_matches_projection(spark, cloud):
    df, points = cloud
    model = Reconstruction.fit(df, ABC, k=2)
    got = {r["event_id"]: r["rebuild_error"] for r in model.score(df).collect()}
    x = points - points.mean(0)
    axes = np.linalg.svd(x, full_matrices=False)[2][:2]
    want = ((x - x @ axes.T @ axes) ** 2).mean(1)
    assert [got[i] for i in range(800)] == pytest.approx(want.tolist(), abs=1e-9)


def test_contamination_sweep_equals_refitting_thresholds(spark, cloud):
    df, points = cloud
    scored = df.withColumn("iso_score", F.abs("a") / 20)
    s, y = np.abs(points[:, 0]) / 20, np.array([0] * 760 + [1] * 40)
    curve = sweep.contamination_sweep(scored, scored, [0.01, 0.05, 0.2]).collect()
    assert len(curve) == 3
    for r in curve:
        flag = s > np.quantile(s, 1 - r["contamination"])
        assert r["tp"] == (flag & (y == 1)).sum() and r["flagged"] == flag.sum()


def test_linspace_curve_counts(spark, cloud):
    df, points = cloud
    scored = df.withColumn("score", F.col("a"))
    s, y = points[:, 0], np.array([0] * 760 + [1] * 40)
    rows = sweep.linspace_curve(scored, 50).orderBy("threshold").collect()
    for r, t in zip(rows, np.linspace(s.min(), s.max(), 50), strict=True):
        assert r["threshold"] == pytest.approx(t) and r["flagged"] == (s >= r["threshold"]).sum()
        assert r["tp"] == ((s >= r["threshold"]) & (y == 1)).sum()
    best = sweep.best_point(sweep.linspace_curve(scored, 50)).first()
    top = max(r["f1"] for r in rows)
    assert best["f1"] == top and best["threshold"] == min(r["threshold"] for r in rows if r["f1"] == top)


def test_per_class_tuning_matches_plain_search(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.3).astype(int)
    p = {c: np.clip(rng.random(400) * 0.6 + y * rng.random(400) * 0.5, 0, 1) for c in ("x", "w")}
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(y, p["x"], p["w"])]
    got = sweep.tune_per_class(spark.createDataFrame(rows, "label int, p_x double, p_w double"), ["x", "w"])

    def f1(t):
        flag = (p["x"] >= t["x"]) | (p["w"] >= t["w"])
        tp = (flag & (y == 1)).sum()
        return 2 * tp / (flag.sum() + y.sum()) if tp else 0.0

    want = {"x": 0.5, "w": 0.5}
    for _ in range(2):
        for c in ("x", "w"):
            best, keep = -1, want[c]
            for t in sweep.GRID:
                v = f1({**want, c: t})
                if v > best:
                    best, keep = v, t
            want[c] = keep
    assert got == want


def test_cause_classifier(spark, cloud, tmp_path):
    df, _ = cloud
    named = df.withColumn("cause", F.when(F.col("label") == 0, "normal").when(F.col("a") > 0, "spike").otherwise("leak")).withColumn("weight", F.lit(2.0))
    model = CauseClassifier.fit(named, ABC, weight="weight", trees=8, depth=4)
    assert model.classes == ["leak", "normal", "spike"]
    out = model.probabilities(named)
    assert out.columns == [*named.columns, "probs"]
    sums = out.select(F.aggregate("probs", F.lit(0.0), lambda a, e: a + e["p"]).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)
    decided = dec.decide(out, 0.5)
    right = decided.where("label = 1").agg(F.avg((F.col("clf_cause") == F.col("cause")).cast("double"))).first()[0]
    assert right > 0.9
    assert out.select(p_of("probs", "none").alias("p")).first()["p"] is None
    model.save(str(tmp_path / "model"))
    again = CauseClassifier.load(str(tmp_path / "model")).probabilities(named).select("event_id", p_of("probs", "spike").alias("p"))
    first = {r["event_id"]: r["p"] for r in out.select("event_id", p_of("probs", "spike").alias("p")).collect()}
    assert {r["event_id"]: r["p"] for r in again.collect()} == pytest.approx(first)


def test_weights_move_the_decision(spark):
    rows = [(0.0, "normal", 1.0)] * 30 + [(0.0, "spike", 1.0)] * 10
    df = spark.createDataFrame(rows, "x double, cause string, weight double")
    p = lambda d: CauseClassifier.fit(d, ["x"], weight="weight", trees=5).probabilities(d.limit(1)).select(p_of("probs", "spike")).first()[0]
    heavy = df.withColumn("weight", F.when(F.col("cause") == "spike", 9.0).otherwise(1.0))
    assert p(df) < 0.5 < p(heavy)


def test_forest_is_callable_from_sql(spark, cloud):
    df, _ = cloud
    forest = IsolationForest.fit(df, ABC, trees=10)
    forest.register("far")
    df.createOrReplaceTempView("cloud")
    got = {r["event_id"]: r["s"] for r in spark.sql("SELECT event_id, far(struct(a, b, c)) AS s FROM cloud").collect()}
    assert got == pytest.approx({r["event_id"]: r["iso_score"] for r in forest.score(df).collect()})


def test_retraining_keeps_every_attempt_and_promotes_the_good_one(spark, sf, tmp_path):
    raw = sampling.stratified_split(fx.windowed(spark, sf))
    train, test = raw.where("is_train"), raw.where("NOT is_train")
    base = build_baselines(train, METRICS)
    bar = lambda v: spark.createDataFrame([(v,)], "f1 double")
    recall = spark.createDataFrame([("cpu_spike", 0.0)], "cause string, recall double")
    log = fx.predictions(spark, sf)
    good, bad = (
        retrain.retrain(train, test, log, base, METRICS, bar(v), recall, normals=400, trees=5) for v in (0.0, 1.01)
    )
    root = str(tmp_path)
    assert retrain.keep_attempt(good, root, "v1") and not retrain.keep_attempt(bad, root, "v2")
    history = spark.read.parquet(f"{root}/promotions")
    assert history.count() == 2 and feedback.current_model(history).first()["model_version"] == "v1"
    assert CauseClassifier.load(f"{root}/models/v2").classes == bad.model.classes
    assert "unknown_feedback" in good.model.classes or good.feedback_rows > 0
    answered = log.where("operator_verdict IS NOT NULL").count()
    assert good.feedback_rows + good.rejected.count() == answered


def test_likeliest_class(spark):
    df = spark.sql("SELECT array(named_struct('cause', 'b', 'p', 0.4D), named_struct('cause', 'a', 'p', 0.4D), named_struct('cause', 'c', 'p', 0.2D)) AS probs")
    assert df.select(retrain.likeliest("probs").alias("c")).first()["c"] == "a"


def test_ranks_of_hot_ticks_match_the_window(spark):
    df = spark.range(200).selectExpr("id % 2 AS tick", "CAST(id AS STRING) AS machine", "CAST(id % 13 AS DOUBLE) AS root_cause_score")
    take = lambda n: {(r["tick"], r["machine"]): r["rank"] for r in rank_root_causes(df, chunk_rows=n).collect()}
    assert take(10) == take(None)


def test_top_causes_are_the_first_ranks(spark):
    df = spark.range(300).selectExpr(
        "id % 3 AS tick", "CAST(id AS STRING) AS machine", "CAST(id % 13 AS DOUBLE) AS root_cause_score", "IF(id % 2 = 0, 'likely_root_cause', 'isolated') AS role"
    )
    want = {(r["tick"], r["machine"], r["rank"]) for r in rank_root_causes(df).where("rank <= 4").collect()}
    top = top_root_causes(df, 4)
    assert {(r["tick"], r["machine"], r["rank"]) for r in top.collect()} == want
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    whole = {r["tick"]: (r["input_count"], r["likely_root_causes"][:5]) for r in likely_root_causes(df).collect()}
    assert {r["tick"]: (r["input_count"], r["likely_root_causes"]) for r in likely_root_causes(df, k=5).collect()} == whole
    none = likely_root_causes(df.withColumn("role", F.lit("isolated")), k=5).first()
    assert none["likely_root_causes"] == [] and none["input_count"] == 100


def test_neighbours_of_spread_points_meet_in_blocks(spark, monkeypatch):
    """Bounds spare nothing among independent features: no visits per query, the same neighbours."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 24))
    monkeypatch.setattr(neighbours, "CELL_POINTS", 20)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "PAIRS", 9)
    calls = []
    inner = neighbours.compare_blocks
    monkeypatch.setattr(neighbours, "compare_blocks", lambda visits, *a: calls.append(1) or inner(visits, *a))
    df = materialize(spark.createDataFrame([(i, [float(v) for v in p], 1) for i, p in enumerate(x)], "_id bigint, _x array<double>, _n bigint"))
    got = {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # blocks must meet by their keys, not by chance
    try:
        for r in neighbours.nearest(df, df, 5, True).collect():
            got.setdefault(r["_q"], []).append(r["_d"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_nearest(x, x, np.ones(len(x), dtype=int), 5, True)
    assert len(calls) == 1 and all(np.allclose(sorted(got[i]), want[i], atol=1e-12) for i in range(len(x)))


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1e-25, 0.0), (1e-6, 1e6), (1e149, 0.0), (1.0, 1e12)])
def test_candidates_keep_all_ties_at_any_scale(scale, shift):
    rng = np.random.default_rng(4)
    b = np.round(rng.normal(0, 1, (900, 3)), 1) * scale + shift
    b[5] = 1e149
    a, ids, counts = b[:80], rng.permutation(len(b)), rng.choice([1, 2, 9], len(b))
    rows, at, d = neighbours.best_of(a, b, ids, counts, 12)
    full = neighbours.gaps(a, b)
    for i in range(len(a)):
        order, want, got = np.lexsort((ids, full[i])), [], 0
        for j in order:
            if got >= 12:
                break
            want.append((j, full[i, j]))
            got += counts[j]
        assert list(zip(at[rows == i], d[rows == i])) == want


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1e-25, 0.0), (1e-6, 1e6), (1e149, 0.0), (1.0, 1e12)])
@pytest.mark.parametrize("share", [0.02, 0.3, 1.0])
def test_candidates_within_reach_at_any_scale(scale, shift, share):
    """A reach leaves out what is farther and nothing else, however many points lie within it."""
    rng = np.random.default_rng(6)
    b = np.round(rng.normal(0, 1, (701, 3)), 1) * scale + shift
    a, ids, counts = b[:90] + 0.03 * scale, rng.permutation(len(b)), rng.choice([1, 2, 9], len(b))
    full = neighbours.gaps(a, b)
    reach = np.sort(full, axis=1)[:, int(share * (len(b) - 1))]  # the distance of a point: it counts as within
    rows, at, d = neighbours.best_of(a, b, ids, counts, 12, None, reach)
    for i in range(len(a)):
        want, got = [], 0
        for j in np.lexsort((ids, full[i])):
            if got >= 12 or full[i, j] > reach[i]:
                break
            want.append((j, full[i, j]))
            got += counts[j]
        assert list(zip(at[rows == i], d[rows == i])) == want


def test_visits_find_nothing_beyond_reach_and_cells_are_dealt_once(spark, monkeypatch):
    """Another cell adds only points within the reach of the own cell, not as many as are wanted from each; cells are made once per model."""
    monkeypatch.setattr(neighbours, "CELL_POINTS", 50)
    monkeypatch.setattr(neighbours, "VISIT", 0)
    rng = np.random.default_rng(12)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 1, (900, 2)))]
    df = materialize(spark.createDataFrame(rows, "event_id long, a double, b double"))
    found, dealt = [], []
    inner, deal = neighbours.compare_blocks, neighbours.in_cells
    monkeypatch.setattr(neighbours, "compare_blocks", lambda visits, *a: found.append((visits.count(), inner(visits, *a).count())) or inner(visits, *a))
    monkeypatch.setattr(neighbours, "in_cells", lambda points, pivots: dealt.append(points.count()) or deal(points, pivots))
    model = LocalOutlierFactor.fit(df.where("event_id < 600"), ["a", "b"], k=10)
    assert found[1][0] > 100 and found[1][1] < 5 * found[1][0]  # before: ten for every visit
    assert model.score(df.where("event_id >= 600")).where("lof > 0").count() == 300
    assert dealt == [600, 300]


def test_forest_scores_in_batches_equal_those_in_the_plan(spark, cloud):
    df, _ = cloud
    odd = df.select("event_id", "a", "b", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).when(F.col("event_id") % 13 > 0, F.col("c")).alias("c"))
    forest = IsolationForest.fit(df, ABC, trees=30)
    both = forest.score_in_plan(forest.score(odd), "walked").collect()
    assert len(both) == 800 and all(r["iso_score"] == r["walked"] for r in both)
    plan = forest.score(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" in plan and "aggregate(" not in plan  # not walked row by row
