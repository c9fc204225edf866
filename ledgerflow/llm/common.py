"""Helpers the training-data operators share: stored tables, words, shingle hashes.

Words are the runs of bytes between ASCII white space (0x20, 0x09-0x0D) of the
UTF-8 text with A-Z lower-cased; a shingle is a run of k words, hashed to 64 bits.
"""

from __future__ import annotations

import os

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.session import scratch_path


BATCH_BYTES = 2 << 20
#: Workers live on from stage to stage; with these they give back what a task has freed.
GIVES_BACK = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_MMAP_THRESHOLD_": "131072",
              "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> None:
    """Let workers that start from now on import this package from where the driver
    has it (on a cluster it is installed, or shipped with --py-files), and hand rows to
    them in batches of so many bytes at most, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for name, value in GIVES_BACK.items():
        env.setdefault(name, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back: the lineage
    ends at files every executor can read, and the planner knows the size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits in the bitmap of ``parted``: 2**17 rows at most, some MB where it is broadcast.
BITMAP = 1 << 23


def parted(rows: DataFrame, found: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``keys`` may be among the ones of ``found``, and those
    whose surely are not, so that only the former need to move to a join. ``keys`` have
    one type in both. The hashes of the found keys set bits in a bitmap of bounded size;
    the fuller it is the more rows may match, at worst all of them."""
    h = f"xxhash64({', '.join(f'`{k}`' for k in keys)})"
    word, bit = F.expr(f"shiftright({h} & {BITMAP - 1}L, 6)"), F.expr(f"shiftleft(1L, cast({h} & 63 as int))")
    bits = stored(found.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")), "key-bits").alias("key-bits")
    marked = rows.join(F.broadcast(bits), word == F.col("key-bits.word"), "left")
    may = F.coalesce(F.col("key-bits.bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.where(may).select(*[rows[f"`{c}`"] for c in rows.columns]), marked.where(~may).select(
        *[rows[f"`{c}`"] for c in rows.columns])


def doc_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table that may hold other columns, of any name."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))


def word_list(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered for a bounded number of words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k word hashes, in order."""
    m = len(words) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(m, np.uint64(k), np.uint64)
    for j in range(k):
        acc ^= words[j:j + m]
        acc *= _MULT
        acc ^= acc >> _SHIFT
    return acc


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles, sorted; fewer words make one shingle of them all."""
    n = len(words)
    return np.unique(run_hashes(words, min(k, n))) if n else np.empty(0, np.uint64)
