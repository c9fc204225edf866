"""Benchmark decontamination by containment search (operator 3).

Test items are short, documents may be very long, so Jaccard similarity says
little; what counts is the share of an item's k-word shingles a document holds.
Items are partitioned by shingle count (powers of two). In a partition with at
most u shingles an item's sketch is its u - ceil(t * u) + 1 minima under one hash
order: a document that holds a share t or more of the item holds at least one of
them, whatever its length, so the search loses nothing. Documents probe the
sketches with all their shingles; candidates are confirmed on the full sets.

The sketch table is a stored table; Spark broadcasts it only where its measured
size is under the session's broadcast limit and shuffles both sides otherwise.

Cases: an item with fewer than k words is one shingle of all its words, and
documents are probed with runs of that length too; null or blank items and
documents match nothing; items or documents repeated with one id count once; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import WordHashes, doc_columns, run_hashes, shingle_set, stored, word_list


def sketch_size(n: int, threshold: float) -> int:
    """Minima needed for items of the size partition that n falls in."""
    u = 1 << max(0, (n - 1).bit_length())
    return u - math.ceil(threshold * u) + 1


def item_shingles(items: DataFrame, k: int, threshold: float) -> DataFrame:
    """(item_id, words, n, part, h, in_sketch): every distinct shingle of every item."""

    def run(batches):
        cache = WordHashes()
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                w = cache.of(word_list(text))
                s = shingle_set(w, k)
                least = sketch_size(len(s), threshold) if len(s) else 0
                part = (len(s) - 1).bit_length() if len(s) else 0
                out.extend((i, min(k, len(w)), len(s), part, h, r < least) for r, h in enumerate(s.view(np.int64)))
            yield pd.DataFrame(out, columns=["item_id", "words", "n", "part", "h", "in_sketch"])

    return items.mapInPandas(run, "item_id long, words int, n int, part int, h long, in_sketch boolean")


def doc_shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, h): distinct runs of each of these numbers of words."""

    def run(batches):
        cache = WordHashes()
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                w = cache.of(word_list(text))
                out.append(np.unique(np.concatenate([run_hashes(w, k) for k in lengths])).view(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "hs": out})

    return docs.mapInPandas(run, "doc_id long, hs array<long>").select("doc_id", F.explode("hs").alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8,
                    id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) with n_shared of the
    item's n_shingles shingles in the document, threshold * n_shingles or more."""
    d = doc_columns(docs, id_col, text_col).where("doc_id is not null")
    one = doc_columns(items, item_col, item_text_col).where("doc_id is not null").dropDuplicates(["doc_id"])
    grams = stored(item_shingles(one, k, threshold), "item-shingles")
    lengths = sorted(r["words"] for r in grams.select("words").distinct().collect())  # at most k rows
    if not lengths:
        lengths = [k]
    sketch = stored(grams.where("in_sketch").select("h", "item_id").distinct(), "item-sketches")
    found = stored(doc_shingles(d, lengths).join(sketch, "h").select("doc_id", "item_id").distinct(), "candidates")
    held = d.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    full = grams.select("item_id", "h", "n").distinct()
    shared = (doc_shingles(held, lengths).distinct().join(full, "h")
              .groupBy("doc_id", "item_id").agg(F.max("n").alias("n_shingles"), F.count("*").alias("n_shared")))
    return (shared.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9))
            .join(found, ["doc_id", "item_id"], "left_semi")
            .select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_shared",
                    (F.col("n_shared") / F.col("n_shingles")).alias("containment")))
