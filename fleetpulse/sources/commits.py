"""Tables that take each batch exactly once.

A batch is named by the query that writes it and its number. Its rows go to a folder of their own attempt; one row in the
manifest then makes that attempt the batch. A retry of a batch that is in the manifest writes nothing, one that failed
before leaves rows that no reader sees, and should two writers of the same batch both get through, every reader
takes the earlier entry. Queries never share a name, so any number of them may write to one table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.plans.tables import broadcast_if_small

MANIFEST = "query string, batch bigint, attempt string, committed_at timestamp"
BATCH = ("query", "batch", "attempt")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(query, batch, attempt): the attempt that counts of every committed batch."""
    try:
        found = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], MANIFEST)
    first = F.min(F.struct("committed_at", "attempt"))["attempt"].alias("attempt")
    return found.groupBy("query", "batch").agg(first).select(*BATCH)


def append_once(rows: DataFrame, path: str, query: str | None = None, batch: int = 0, by: Sequence[str] = ()) -> bool:
    """Write one batch; false when it was committed before. Without ``query`` every call is a batch of its own.

    ``by`` names further partition columns.
    """
    spark = rows.sparkSession
    query = query or f"single-{uuid.uuid4().hex}"
    if not manifest(spark, path).where((F.col("query") == query) & (F.col("batch") == batch)).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    named = rows.withColumns({"query": F.lit(query), "batch": F.lit(batch).cast("bigint"), "attempt": F.lit(attempt)})
    named.write.mode("append").partitionBy(*BATCH, *by).parquet(f"{path}/rows")
    entry = spark.createDataFrame([(query, batch, attempt)], "query string, batch bigint, attempt string")
    entry.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return True


def read_committed(spark: SparkSession, path: str, schema: T.StructType, by: Sequence[str] = ()) -> DataFrame:
    """Rows of committed batches only, with the columns of ``schema`` and ``by``; folders of other attempts are pruned."""
    shape = T.StructType([*schema.fields, T.StructField("query", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType())])
    for name in by:
        if name not in schema.fieldNames():
            shape = shape.add(name, T.DateType() if name == "day" else T.StringType())
    names = [*schema.fieldNames(), *[b for b in by if b not in schema.fieldNames()]]
    try:
        rows = spark.read.schema(shape).parquet(f"{path}/rows")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], shape)
    return rows.join(broadcast_if_small(manifest(spark, path)), list(BATCH), "left_semi").select(*names)


def streaming_query(spark: SparkSession) -> str | None:
    """Name of the streaming query that runs the current ``foreachBatch`` body: its checkpoint's id, kept over restarts."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")
