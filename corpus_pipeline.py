"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
parquet to the shared folder and read back as the next one's ``docs``. All but the
last return the columns of ``docs``.

Cases: rows with a null text or doc_id pass the filters; of rows repeated with one
doc_id and text the near-duplicate stage keeps one; empty tables pass through;
columns besides doc_id, text and n_chars are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import bbit_minhash, bfd_packing, chaining, containment, pairwise_quality
from ledgerflow.llm.common import importable, parted, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents scored under the cut go."""
    importable(spark)
    model = pairwise_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    return docs.where(F.col("text").isNull() | (pairwise_quality.score_udf(model)("text") >= pairwise_quality.CUT))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near duplicates the smallest doc_id stays, once."""
    importable(spark)
    found = stored(bbit_minhash.near_duplicates(docs), "near-duplicates")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumns({
        "id": F.col("row.doc_id").cast("long"), "th": F.xxhash64(F.col("row.text").cast("string"))})
    # an id may come with several texts, each with a fate of its own
    gone = stored(found.where("not kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th")).distinct(),
                  "not-kept")
    docs = _without(row, gone, ["id", "th"])
    kept = found.where("kept and doc_id is not null").groupBy("doc_id", "component_id")
    again = kept.agg(F.count("*").alias("n"), F.min("text_hash").alias("first")).where("n > 1")
    if again.isEmpty():
        return docs.select("row.*")
    again = stored(again.select(F.col("doc_id").alias("id"), "first"), "repeated-ids")
    ids = again.select("id").distinct()
    may, no = parted(docs, ids, ["id"])
    once = may.join(again, "id").where("th = first").dropDuplicates(["id", "th"]).select("row.*")
    rest = may.join(ids, "id", "left_anti").unionByName(no)
    return rest.select("row.*").unionByName(once)


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys are not in ``gone``; only those that may be there move."""
    may, no = parted(rows, gone, keys)
    return may.join(gone, keys, "left_anti").unionByName(no)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: passages that an earlier document has are cut out of the later one."""
    importable(spark)
    return chaining.without_passages(docs, chaining.repeated_passages(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark item go."""
    importable(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = stored(containment.contained_items(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: what is left, as pieces of packed sequences."""
    importable(spark)
    return bfd_packing.packed_sequences(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("decontamination", decontamination), ("packing", packing)]

#: No SQL: training, chaining and tokenizing can't be said in it; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
