"""Rolling trend features per machine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.plans.chunks import CHUNK_ROWS, with_lookback
from fleetpulse.schemas import ROLLING_METRICS, ROLLING_N

ORDER = ("timestamp", "event_id")


def rolling_names(metrics: Sequence[str] = ROLLING_METRICS) -> list[str]:
    return [f"{m}_{s}" for m in metrics for s in ("rolling_mean", "rolling_std", "delta")]


def add_rolling(
    df: DataFrame,
    metrics: Sequence[str] = ROLLING_METRICS,
    n: int = ROLLING_N,
    order: Sequence[str] = ORDER,
    by: Sequence[str] = ("machine",),
    chunk_rows: int | None = CHUNK_ROWS,
    count_as: str | None = None,
) -> DataFrame:
    """Mean and sample deviation of the last ``n`` rows and change since ``n - 1`` rows ago.

    The deviation of a single row and the change of a row without enough history are 0. All features
    share one window, hence one shuffle. ``count_as`` also keeps the number of rows in the window.
    """

    def compute(d, parts):
        ordered = Window.partitionBy(*parts).orderBy(*order)
        w = ordered.rowsBetween(-(n - 1), 0)
        cols = {count_as: F.count(F.lit(1)).over(w)} if count_as else {}
        for m in metrics:
            cols[f"{m}_rolling_mean"] = F.avg(m).over(w)
            cols[f"{m}_rolling_std"] = F.coalesce(F.stddev_samp(m).over(w), F.lit(0.0))
            cols[f"{m}_delta"] = F.coalesce(F.col(m) - F.lag(m, n - 1).over(ordered), F.lit(0.0))
        return d.withColumns(cols)

    return with_lookback(df, by, order, n - 1, compute, chunk_rows, metrics)


def add_rolling_full(
    df: DataFrame,
    metrics: Sequence[str],
    n: int = 30,
    order: Sequence[str] = ORDER,
    by: Sequence[str] = ("machine",),
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Variant that needs a full window of ``n`` rows: before that the mean is the value itself and the
    deviation 0. The change is against the previous row."""

    def compute(d, parts):
        ordered = Window.partitionBy(*parts).orderBy(*order)
        w = ordered.rowsBetween(-(n - 1), 0)
        cols = {}
        for m in metrics:
            full = F.count(m).over(w) == n
            cols[f"{m}_delta"] = F.coalesce(F.col(m) - F.lag(m, 1).over(ordered), F.lit(0.0))
            cols[f"{m}_roll_mean_{n}"] = F.when(full, F.avg(m).over(w)).otherwise(F.col(m))
            cols[f"{m}_roll_std_{n}"] = F.when(full, F.stddev_samp(m).over(w)).otherwise(F.lit(0.0))
        return d.withColumns(cols)

    return with_lookback(df, by, order, n - 1, compute, chunk_rows, metrics)


def add_history(
    df: DataFrame,
    metrics: Sequence[str] = ROLLING_METRICS,
    n: int = ROLLING_N,
    order: Sequence[str] = ORDER,
    by: Sequence[str] = ("machine",),
    full_only: bool = False,
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Add ``history``: a map from metric to its last ``n`` values, the current one last.

    With ``full_only`` rows with fewer than ``n`` readings get NULL.
    """

    def compute(d, parts):
        w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(-(n - 1), 0)
        entries = [x for m in metrics for x in (F.lit(m), F.collect_list(m).over(w))]
        history = F.create_map(*entries)
        if full_only:
            history = F.when(F.count(F.lit(1)).over(w) == n, history)
        return d.withColumn("history", history)

    return with_lookback(df, by, order, n - 1, compute, chunk_rows, metrics)
