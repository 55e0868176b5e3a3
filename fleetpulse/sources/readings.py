"""Typed scans of telemetry, metric matrices and the dependency graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.functions.numbers import nan_to_null
from fleetpulse.functions.timefeat import add_window
from fleetpulse.operators.baselines import with_keys
from fleetpulse.operators.selection import infer_features, select_all_per_machine, select_metrics, select_top_per_machine
from fleetpulse.plans.chunks import CHUNK_ROWS, row_index
from fleetpulse.schemas import READING_SCHEMA


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, so that aggregates skip it."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in doubles}) if doubles else df


def read_readings(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, fmt: str | None = None, schema: T.StructType = READING_SCHEMA
) -> DataFrame:
    """Fleet telemetry from CSV or Parquet with a fixed schema; ``columns`` prunes the scan."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith("parquet") else "csv")
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return clean(df.select(*columns) if columns else df)


def adaptive(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Any table with numeric columns: default machine and window, features derived from the schema."""
    features = infer_features(df)
    out = add_window(df) if "window" not in df.columns else df
    return clean(with_keys(out)), features


def adaptive_scan(spark: SparkSession, path: str, fmt: str = "csv") -> tuple[DataFrame, list[str]]:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    return adaptive(reader.load(path))


def numbered_lines(spark: SparkSession, path: str, chunk_rows: int | None = CHUNK_ROWS, folders: int = 0) -> DataFrame:
    """``machine, line_no, text`` of many text files; the machine comes from the file name.

    ``folders`` of the path come before the name (``site-a/1-1``), so that equal names of several folders stay apart; a file
    that a writer numbered (``part-...``) is named by its folder. Files stay splittable: a line's number is its rank by block
    start and read order within the block.
    """
    steps = F.split(F.regexp_replace("_metadata.file_path", r"/part-[^/]*$", ""), "/")
    name = F.regexp_extract(F.element_at(steps, -1), r"^(?:machine-)?(.*?)(?:\.[^.]*)?$", 1)
    named = F.array_join(F.concat(F.slice(steps, -1 - folders, folders), F.array(name)), "/") if folders else name
    lines = spark.read.text(path).select(
        named.alias("machine"),
        F.regexp_replace("value", "\r$", "").alias("text"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
    )
    placed = row_index(lines, ["machine"], ["_block", "_seen"], "_line", chunk_rows)
    return placed.select("machine", (F.col("_line") - 1).alias("line_no"), "text")


def read_matrix(
    spark: SparkSession,
    data: str,
    labels: str,
    width: int,
    mode: str = "all",
    start: str = "2026-01-01 00:00:00",
    per_machine: bool = False,
    folders: int = 0,
) -> DataFrame:
    """Headerless metric files joined to their label files by line number, with synthetic minutes.

    Lines without a label keep a null one. Metrics are selected over the whole pool or ``per_machine``, by its own variances.
    """
    names = [f"col_{i}" for i in range(width)]
    values = F.split("text", ",")
    matrix = numbered_lines(spark, data, folders=folders).select(
        "machine", "line_no", *[F.try_element_at(values, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)]
    )
    marks = numbered_lines(spark, labels, folders=folders).select("machine", "line_no", F.col("text").try_cast("int").alias("label"))
    joined = matrix.join(marks, ["machine", "line_no"], "left").withColumn(
        "timestamp", F.to_timestamp_ntz(F.lit(start)) + F.make_dt_interval(mins=F.col("line_no").cast("int"))
    )
    if not per_machine or mode == "first3":
        return select_metrics(joined, names, mode)
    if mode not in ("top3", "all"):
        raise ValueError(f"unknown mode {mode!r}")
    return (select_top_per_machine if mode == "top3" else select_all_per_machine)(joined, names)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges ``machine, router`` and the routers of a dependency-graph document."""
    shape = "depends_on map<string,string>, routers array<string>, downstream_of map<string,array<string>>"
    graph = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("g"))
    edges = graph.select(F.explode("g.depends_on").alias("machine", "router"))
    return edges, graph.select(F.explode("g.routers").alias("machine"))


def write_graph(edges: DataFrame, path: str) -> None:
    """The graph as Parquet edges; a fleet-sized graph is a table, not a document."""
    edges.select("machine", "router").write.parquet(path)
