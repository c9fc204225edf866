"""Given SQL statements as a batch (S10): rows of any schema, errors as rows.

Each statement runs as one Spark SQL query with named parameters over the registered
views. Its rows are written as VARIANT, so statements of different schemas share a table;
a statement that doesn't parse, names what isn't there or fails while it runs becomes a
status row with the error's condition, and the others still run.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.session import scratch_path

SCHEMA = "statement string, seq long, status string, row variant, error string"


def run_statements(spark: SparkSession, statements: Iterable[tuple[str, str, Mapping | None]]) -> DataFrame:
    """(statement, seq, status, row, error) for (name, SQL, named parameters): status ok with
    a row for each result row, numbered in the result's order; empty or error with one row
    that has none."""
    out = spark.createDataFrame([], SCHEMA)
    for name, sql, args in statements:
        path = scratch_path(spark, "statement")
        try:
            result = spark.sql(sql, args=dict(args or {}))
            row = F.to_variant_object(F.struct(*[result[c] for c in result.columns]))
            result.select(F.monotonically_increasing_id().alias("seq"), row.alias("row")).write.parquet(path)
            rows = spark.read.schema("seq long, row variant").parquet(path)
            status, error = ("empty" if rows.isEmpty() else "ok"), None
        except PySparkException as e:
            status, error = "error", e.getCondition() or type(e).__name__
        if status == "ok":
            out = out.unionByName(rows.select(F.lit(name).alias("statement"), "seq", F.lit("ok").alias("status"), "row",
                                              F.lit(None).cast("string").alias("error")))
        else:
            out = out.unionByName(spark.range(1).select(
                F.lit(name).alias("statement"), F.lit(None).cast("long").alias("seq"), F.lit(status).alias("status"),
                F.lit(None).cast("variant").alias("row"), F.lit(error).cast("string").alias("error")))
    return out
