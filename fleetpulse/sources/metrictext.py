"""Metric feed from text snapshots: one ``name{label="value",...} value [milliseconds]`` per line."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.schemas import METRIC_FEED_SCHEMA

# The gauges of the fleet and the metrics they carry.
GAUGES = {
    "sim_cpu_percent": "cpu",
    "sim_ram_percent": "ram",
    "sim_network_mbps": "network",
    "sim_disk_io_percent": "disk_io",
    "sim_disk_usage_percent": "disk_usage",
    "sim_load_avg": "load_avg",
}
LINE = r"^\s*([A-Za-z_:][A-Za-z0-9_:]*)\s*(?:\{(.*)\})?\s+(\S+)(?:\s+(-?[0-9]+))?\s*$"


def parse_lines(lines: DataFrame, gauges: Mapping[str, str] = GAUGES) -> DataFrame:
    """Long metric values of text lines (``value`` and ``_modified``, the time for lines that give none).

    Comments, gauges that are not asked for, lines that do not parse and values that are no finite number are left out; a machine must be
    named, its type may be missing (``unknown``).
    """
    part = lambda i: F.regexp_extract("value", LINE, i)
    label = lambda name: F.nullif(F.regexp_extract(part(2), rf'(?:^|,)\s*{name}="((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    metric = F.try_element_at(F.create_map(*[F.lit(x) for pair in gauges.items() for x in pair]), part(1))
    given = F.timestamp_millis(part(4).try_cast("bigint"))
    rows = lines.select(
        metric.alias("metric"),
        label("machine").alias("machine"),
        F.coalesce(label("type"), F.lit("unknown")).alias("type"),
        F.coalesce(given, F.col("_modified")).alias("ts"),
        part(3).try_cast("double").alias("value"),
    )
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf")))
    return rows.where(F.col("metric").isNotNull() & F.col("machine").isNotNull() & finite).select(*METRIC_FEED_SCHEMA.fieldNames())


def metric_text_feed(spark: SparkSession, path: str, files_per_batch: int | None = None, gauges: Mapping[str, str] = GAUGES) -> DataFrame:
    """Stream of the snapshots that appear in a folder.

    The file source keeps which snapshots a micro-batch took in the checkpoint, so a restart neither loses nor repeats one;
    ``files_per_batch`` limits what a trigger admits.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path)
    return parse_lines(lines.select("value", F.col("_metadata.file_modification_time").alias("_modified")), gauges)


def as_lines(feed: DataFrame, gauges: Mapping[str, str] = GAUGES) -> DataFrame:
    """Text lines of long metric values, the inverse of ``parse_lines``; times keep milliseconds."""
    name = F.try_element_at(F.create_map(*[F.lit(x) for g, m in gauges.items() for x in (m, g)]), F.col("metric"))
    labels = F.concat(F.lit('{machine="'), "machine", F.lit('",type="'), "type", F.lit('"} '))
    return feed.select(F.concat(name, labels, F.col("value").cast("string"), F.lit(" "), F.unix_millis("ts").cast("string")).alias("value"))
