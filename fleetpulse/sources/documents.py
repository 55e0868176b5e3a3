"""Baselines as one keyed JSON document, the exchange format of small fleets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.schemas import WINDOWS

# Keys of the document that name no machine, and the type entry of a machine.
GLOBAL, TYPE, ORDER, WINDOW_LIST, HAS_WINDOWS = "__global__", "__type__", "__feature_order__", "__windows__", "__has_windows__"


def read_baseline_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Baselines (as ``build_baselines`` returns them, ``n`` unknown), machines with their type, and the feature order.

    A metric that an entry lacks is null there, so scoring takes the fleet's; the deviation is the one written. A key that ends in ``|``
    and a window, one of the document's list or of the fixed ones, is a machine and that window; any other is a machine, ``|`` included.
    """
    document = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("d"))
    listed = lambda name: F.from_json(F.try_element_at("d", F.lit(name)), "array<string>")
    order, windows = document.select(listed(ORDER), listed(WINDOW_LIST)).first()  # the contract of one model
    entries = document.select(F.explode("d").alias("key", "text")).where(~F.col("key").isin(ORDER, WINDOW_LIST, HAS_WINDOWS))
    windowed = F.regexp_extract("key", r"^(?s).+\|([^|]*)$", 1).isin(*{*WINDOWS, *(windows or [])} - {""})
    level = (
        F.when(F.col("key") == GLOBAL, "global").when(F.col("key").startswith(TYPE), "type").when(windowed, "machine+window").otherwise("machine")
    )
    parsed = entries.select("key", level.alias("level"), F.from_json("text", "map<string,string>").alias("m"))
    pair = lambda m: F.from_json(F.try_element_at("m", F.lit(m)), "array<double>")
    stats = [pair(m)[i].alias(f"{m}_{s}") for m in order for i, s in enumerate(("mean", "std"))]
    machine = F.when(F.col("level") == "machine", F.col("key")).when(F.col("level") == "machine+window", F.regexp_extract("key", r"^(?s)(.*)\|([^|]*)$", 1))
    kind = F.when(F.col("level") == "type", F.substr("key", F.lit(len(TYPE) + 1)))
    window = F.when(F.col("level") == "machine+window", F.regexp_extract("key", r"\|([^|]*)$", 1))
    rows = parsed.select("level", machine.alias("machine"), kind.alias("type"), window.alias("window"), F.lit(None).cast("bigint").alias("n"), *stats)
    machines = parsed.where("level = 'machine'").select(F.col("key").alias("machine"), F.try_element_at("m", F.lit(TYPE)).alias("type"))
    return rows, machines, list(order)


def baseline_document(baselines: DataFrame, machines: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row ``value``: the document's text. A fleet that outgrows one row keeps its baselines as a table."""
    pairs = F.create_map(*[x for m in metrics for x in (F.lit(m), F.array(F.col(f"{m}_mean"), F.col(f"{m}_std")))])
    stats = F.to_json(F.map_filter(pairs, lambda _, v: v[0].isNotNull()))
    # The type joins the machine's own entry before its closing brace.
    known = machines.select("machine", F.col("type").alias("_type"))
    typed = F.concat(F.substr(stats, F.lit(1), F.length(stats) - 1), F.lit(f', "{TYPE}": "'), F.col("_type"), F.lit('"}'))
    key = (
        F.when(F.col("level") == "global", GLOBAL)
        .when(F.col("level") == "type", F.concat(F.lit(TYPE), "type"))
        .when(F.col("level") == "machine", F.col("machine"))
        .otherwise(F.concat("machine", F.lit("|"), "window"))
    )
    body = F.when((F.col("level") == "machine") & F.col("_type").isNotNull(), typed).otherwise(stats)
    entries = baselines.join(known, "machine", "left").select(F.concat(F.to_json(F.array(key)), F.lit(": "), body).alias("e"))
    # A key is quoted as the only element of an array, whose brackets go.
    quoted = F.regexp_replace("e", r'^\[("(?:[^"\\]|\\.)*")\]', "$1")
    lists = [f'"{ORDER}": ["' + '", "'.join(metrics) + '"]', f'"{WINDOW_LIST}": ["' + '", "'.join(WINDOWS) + '"]', f'"{HAS_WINDOWS}": true']
    text = F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("q")), ",\n"), F.lit(",\n" + ",\n".join(lists) + "}"))
    return entries.select(quoted.alias("q")).agg(text.alias("value"))
