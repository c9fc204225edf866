"""Whole-table replacement by versions (S11-S13): readers never see half a table.

A table is a folder of version folders ``v=<snapshot id>-<try>`` and a small pointer
table. ``publish`` writes a whole new version first and adds the pointer to it last,
so a crash in between leaves the old version in place; an empty snapshot and one older
than the published are refused here, whoever calls. ``drop`` clears a table before its
first load; ``vacuum`` removes versions that readers no longer start from.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_CURRENT"


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, None where nothing was written yet; any other
    error is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def published(spark: SparkSession, table: str) -> tuple[str, int] | None:
    """(snapshot id, try) of the version that readers see."""
    pointers = table_or_none(spark, f"{table}/{POINTER}")
    top = None if pointers is None else pointers.agg(F.max(F.struct("snap", "n")).alias("v")).first()["v"]
    return None if top is None else (top["snap"], top["n"])


def _version(snap: str, n: int) -> str:
    return f"v={snap}-{n:06d}"


def publish(spark: SparkSession, rows: DataFrame, table: str, snap: str) -> bool:
    """Write ``rows`` as a new version for the snapshot and point readers to it; False
    if there are none or a newer snapshot is published. Pointers are only added, and
    the greatest (snapshot, try) counts."""
    now = published(spark, table)
    if rows.isEmpty() or now is not None and now[0] > snap:
        return False
    n = now[1] + 1 if now is not None and now[0] == snap else 0
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{table}/{_version(snap, n)}")
    (spark.createDataFrame([(snap, n)], "snap string, n int").coalesce(1)
     .write.mode("append").parquet(f"{table}/{POINTER}"))
    return True


def read_current(spark: SparkSession, table: str) -> DataFrame | None:
    """The current version of a table (None before the first write)."""
    now = published(spark, table)
    return None if now is None else spark.read.parquet(f"{table}/{_version(*now)}")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(spark: SparkSession, table: str) -> bool:
    """Remove a table with all its versions; False where there was none."""
    p, fs = _folder(spark, table)
    return bool(fs.exists(p) and fs.delete(p, True))


def vacuum(spark: SparkSession, table: str, keep: int = 2) -> list[str]:
    """Remove all but the published version and the ``keep`` - 1 before it (jobs that
    started from them may still read); versions newer than the published one are being
    written and stay. Returns the names removed."""
    now = published(spark, table)
    p, fs = _folder(spark, table)
    if now is None:
        return []
    names = sorted(x.getPath().getName() for x in fs.listStatus(p))
    old = [n for n in names if n.startswith("v=") and n <= _version(*now)][:-max(1, keep)]
    for name in old:
        fs.delete(_folder(spark, f"{table}/{name}")[0], True)
    return old
