"""Rolling features, histories, replay alignment and incidents."""

from pyspark.sql import functions as F

from fleetpulse import fixtures as fx
from fleetpulse.catalog.registry import query, r6
from fleetpulse.functions import decisions as dec
from fleetpulse.functions.numbers import r6 as R
from fleetpulse.operators import replay, rolling
from fleetpulse.schemas import ROLLING_METRICS

_W = "(PARTITION BY machine ORDER BY timestamp, event_id ROWS 9 PRECEDING)"
_O = "(PARTITION BY machine ORDER BY timestamp, event_id)"
_ROLL = ", ".join(
    f"{r6(f'avg({m}) OVER {_W}')} AS {m}_rolling_mean, {r6(f'coalesce(stddev_samp({m}) OVER {_W}, 0)')} AS {m}_rolling_std, "
    f"{r6(f'coalesce({m} - lag({m}, 9) OVER {_O}, 0)')} AS {m}_delta"
    for m in ROLLING_METRICS
)


@query("rolling_features", f"SELECT event_id, {_ROLL} FROM readings")
def rolling_features(spark, sf):
    out = rolling.add_rolling(fx.readings(spark, sf))
    return out.select("event_id", *[R(n).alias(n) for n in rolling.rolling_names()])


@query("rolling_features_sliced", f"SELECT event_id, {_ROLL} FROM readings")
def rolling_features_sliced(spark, sf):
    """The plan for hot machines: every machine here counts as hot and is cut into time slices."""
    out = rolling.add_rolling(fx.readings(spark, sf), chunk_rows=20)
    return out.select("event_id", *[R(n).alias(n) for n in rolling.rolling_names()])


_W30 = "(PARTITION BY machine ORDER BY timestamp, event_id ROWS 29 PRECEDING)"
_FULL = ", ".join(
    f"{r6(f'coalesce({m} - lag({m}) OVER {_O}, 0)')} AS {m}_delta, "
    f"{r6(f'(CASE WHEN count({m}) OVER {_W30} = 30 THEN avg({m}) OVER {_W30} ELSE {m} END)')} AS {m}_roll_mean_30, "
    f"{r6(f'(CASE WHEN count({m}) OVER {_W30} = 30 THEN stddev_samp({m}) OVER {_W30} ELSE 0 END)')} AS {m}_roll_std_30"
    for m in ("cpu", "ram", "network")
)


@query("rolling_full_window", f"SELECT event_id, {_FULL} FROM readings")
def rolling_full_window(spark, sf):
    metrics = ("cpu", "ram", "network")
    out = rolling.add_rolling_full(fx.readings(spark, sf), metrics)
    names = [f"{m}_{s}" for m in metrics for s in ("delta", "roll_mean_30", "roll_std_30")]
    return out.select("event_id", *[R(n).alias(n) for n in names])


_TEXT = "CAST(CAST(round({m} * 100) AS BIGINT) AS VARCHAR)"


def _list(m):
    return f"array_to_string(list({_TEXT.format(m=m)}) OVER {_W}, ',')"


def _joined(col):
    return F.array_join(F.transform(col, lambda x: F.round(x * 100).cast("bigint").cast("string")), ",")


@query(
    "history_arrays",
    "WITH h AS (SELECT event_id, "
    + ", ".join(f"{_list(m)} AS {m}_history" for m in ROLLING_METRICS)
    + f", count(*) OVER {_W} AS n FROM readings) SELECT event_id, "
    + ", ".join(f"{m}_history" for m in ROLLING_METRICS)
    + " FROM h WHERE n = 10",
)
def history_arrays(spark, sf):
    out = rolling.add_history(fx.readings(spark, sf), full_only=True).where("history IS NOT NULL")
    return out.select("event_id", *[_joined(F.col("history")[m]).alias(f"{m}_history") for m in ROLLING_METRICS])


@query(
    "history_lookup",
    f"""WITH h AS (SELECT event_id, timestamp, machine, {_list('cpu')} AS cpu_history, count(*) OVER {_W} AS n FROM readings)
SELECT event_id, machine, cpu_history
FROM h WHERE n = 10 AND hour(timestamp) % 4 = 0 AND minute(timestamp) = 0""",
)
def history_lookup(spark, sf):
    """Ten readings ending at each systematically sampled timestamp."""
    df = fx.readings(spark, sf)
    keys = df.where("hour(timestamp) % 4 = 0 AND minute(timestamp) = 0").select("machine", "timestamp")
    out = rolling.add_history(df, ("cpu",), full_only=True).where("history IS NOT NULL")
    return out.join(keys, ["machine", "timestamp"], "left_semi").select(
        "event_id", "machine", _joined(F.col("history")["cpu"]).alias("cpu_history")
    )


@query(
    "rolling_from_history",
    f"""WITH h AS (SELECT event_id, {', '.join(f'avg({m}) OVER {_W} AS {m}_a, coalesce(stddev_samp({m}) OVER {_W}, 0) AS {m}_s, '
    f'coalesce({m} - lag({m}, 9) OVER {_O}, 0) AS {m}_d' for m in ROLLING_METRICS)} FROM readings)
SELECT event_id, event_id % 8 <> 0 AS history_ok, """
    + ", ".join(
        f"CASE WHEN event_id % 8 <> 0 THEN {r6(f'{m}_{a}')} END AS {m}_{n}"
        for m in ROLLING_METRICS
        for a, n in (("a", "rolling_mean"), ("s", "rolling_std"), ("d", "delta"))
    )
    + " FROM h",
)
def rolling_from_history(spark, sf):
    """Features from supplied arrays equal the windowed ones; a missing list yields NULLs."""
    with_history = rolling.add_history(fx.readings(spark, sf))
    broken = with_history.withColumn(
        "history", F.when(F.col("event_id") % 8 == 0, F.map_filter("history", lambda k, v: k != "ram")).otherwise(F.col("history"))
    )
    out = dec.rolling_from_history(broken, ROLLING_METRICS)
    return out.select("event_id", "history_ok", *[R(n).alias(n) for n in rolling.rolling_names()])


_STEPS = """WITH c AS (SELECT machine, count(*) AS n FROM readings GROUP BY machine), s AS (SELECT min(n) AS steps FROM c),
i AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY timestamp, event_id) - 1 AS step FROM readings)"""


@query("replay_alignment", f"{_STEPS} SELECT step, machine, event_id FROM i, s WHERE step < steps")
def replay_alignment(spark, sf):
    return replay.align_steps(fx.readings(spark, sf)).select("step", "machine", "event_id")


@query("replay_step", f"{_STEPS} SELECT machine, type, cpu, label FROM i, s WHERE step = 1000003 % steps")
def replay_step(spark, sf):
    """One tick of the endless replay."""
    aligned = replay.align_steps(fx.readings(spark, sf))
    return replay.at_step(aligned, 1_000_003).select("machine", "type", "cpu", "label")


_INCIDENTS = """WITH a AS (SELECT machine, timestamp, event_id, timestamp AS s FROM readings WHERE cpu > 60),
g AS (SELECT *, CASE WHEN epoch(s) - epoch(lag(s) OVER (PARTITION BY machine ORDER BY timestamp, event_id)) <= 86400 THEN 0 ELSE 1 END AS new FROM a),
n AS (SELECT *, sum(new) OVER (PARTITION BY machine ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS incident FROM g)
SELECT machine, CAST(incident AS BIGINT) AS incident, min(timestamp) AS started, max(timestamp) AS ended, count(*) AS n FROM n GROUP BY 1, 2"""


@query("incidents", _INCIDENTS)
def incidents(spark, sf):
    return replay.incidents(fx.readings(spark, sf).where("cpu > 60"), 86400.0)


@query("incidents_sliced", _INCIDENTS)
def incidents_sliced(spark, sf):
    return replay.incidents(fx.readings(spark, sf).where("cpu > 60"), 86400.0, chunk_rows=4)
