"""Delta-maintained token counts (operator 9).

A store in the shared folder keeps, for every committed batch, the signed count
rows of its documents (``ledger``) and their sums by source, language and tokenizer
version (``deltas``). A batch inserts, deletes and revises documents: live counts of
the documents it names go in with sign -1, new counts with +1. Totals are the sum
of all deltas; nothing already counted is counted again. A batch is committed by
its deltas, written last and in one folder with Spark's success marker: applying a
committed batch again changes nothing, and what a failed try left is overwritten.

Cases: null texts count 0 tokens; null source or lang is a group of its own; rows
with a null doc_id can be inserted, not revised or deleted; of rows repeated with
one doc_id in a batch the one with the most tokens counts (ties: least source, then
lang); a delete beside an insert of one doc_id in a batch loses; inserting a live
document revises it, revising an unknown one inserts it, deleting one does nothing;
an empty batch commits nothing but itself; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored
from ledgerflow.llm.tokens import load

KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_tokens long, sign int"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class TokenRollup:
    """Totals at ``root``; ``versions`` maps a version name to (kind, path or None)."""

    def __init__(self, spark: SparkSession, root: str, versions: dict[str, tuple[str, str | None]]):
        self.spark, self.root, self.versions = spark, root.rstrip("/"), dict(versions)

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: int) -> bool:
        return self._exists(f"{self.root}/deltas/{batch:08d}/_SUCCESS")

    def batches(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/deltas")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [int(x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(b for b in found if self.committed(b))

    def _read(self, what: str, schema: str, before: int | None = None) -> DataFrame:
        paths = [f"{self.root}/{what}/{b:08d}" for b in self.batches() if before is None or b != before]
        return (self.spark.read.schema(schema).parquet(*paths) if paths
                else self.spark.createDataFrame([], schema))

    def counted(self, docs: DataFrame) -> DataFrame:
        """(doc_id, source, lang, tokenizer, n_tokens) of whole texts."""
        versions = self.versions

        def run(batches):
            toks = {name: load(kind, path) for name, (kind, path) in versions.items()}
            try:
                for pdf in batches:
                    for name, tok in toks.items():
                        yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"],
                                            "lang": pdf["lang"], "tokenizer": name,
                                            "n_tokens": [tok.count(t) for t in pdf["text"]]})
            finally:
                for tok in toks.values():
                    tok.forget()

        # ids go through the workers as text, exact beside a null
        rows = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
            run, "doc_id string, source string, lang string, tokenizer string, n_tokens long")
        return rows.withColumn("doc_id", F.col("doc_id").cast("long"))

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit ``changes`` (op, doc_id, source, lang, text; op is insert, revise or
        delete) as batch number ``batch``; False if it was committed before."""
        if self.committed(batch):
            return False
        c = changes.select("op", F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                           F.col("text").cast("string").alias("text"))
        counts = self.counted(c.where(F.col("op").isin("insert", "revise")).drop("op"))
        counts = stored(counts, "counts")
        least = F.struct((-F.col("n_tokens")).alias("n"), "source", "lang")
        new = (counts.where("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.min(least).alias("b"))
               .select("doc_id", "b.source", "b.lang", "tokenizer", (-F.col("b.n")).alias("n_tokens"))
               .unionByName(counts.where("doc_id is null")))
        ledger = new.withColumn("sign", F.lit(1))
        if self.batches():
            named = c.where("doc_id is not null").select("doc_id").distinct()
            live = (self._read("ledger", LEDGER).join(named, "doc_id", "left_semi")
                    .groupBy("doc_id", *KEYS, "n_tokens").agg(F.sum("sign").cast("int").alias("sign")).where("sign > 0"))
            ledger = ledger.unionByName(live.withColumn("sign", -F.col("sign")))
        at = f"{self.root}/ledger/{batch:08d}"
        ledger.write.mode("overwrite").parquet(at)
        deltas = (self.spark.read.schema(LEDGER).parquet(at).groupBy(*KEYS)
                  .agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")))
        deltas.write.mode("overwrite").parquet(f"{self.root}/deltas/{batch:08d}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of what is live now."""
        return (self._read("deltas", DELTAS).groupBy(*KEYS)
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0"))
