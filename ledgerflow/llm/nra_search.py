"""Ranked lexical search by NRA: no random access (operator 12).

One pass over the texts writes every document's terms that some item asks for, with
frequency and document length, plus one row for the document itself. From that table
come N, L and each term's df, then every posting's impact as 64-bit integers.
Documents are dealt to shards of about ``SHARD`` rows, items to blocks of at most
``ITEMS``; for each shard and block one task holds the posting lists, sorted by
descending impact, and answers each item by sequential reads alone:

* a document's lower bound is the sum of the impacts read for it, its upper bound adds
  the last impact read of every list in which it was not yet met;
* reading stops when no unread document can reach the k-th lower bound, no other seen
  document can beat or tie it unresolved, and the k best have met all lists that can
  still add to them, so membership, ties and scores are exact.

The k best of all shards are merged per item by partial limits. Memory in a task is
bounded by a shard's postings of one block's terms, whatever the number of documents;
frequent terms are dealt out over all shards.

Cases: each row of the documents is a document, so repeated rows (or ids) rank each by
itself; null and empty texts have no terms and count in no statistic; ties go to the
smaller doc_id, null ids last; terms of an item count once; items without an id, without
terms, or whose terms no document has, return nothing; repeated item rows are answered once per
distinct (item_id, text), a repeated item_id with two texts by the terms of both;
empty tables give an empty result; very long texts send one row per distinct term
asked for; only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored

SHARD = 8192   # documents a shard holds on average
ITEMS = 500    # items in a block
DEPTH = 64     # postings read of each list in the first round; later rounds double it

# term bytes: letters and digits of ASCII (A-Z lower-cased) and all bytes above it
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text, in order."""
    return text.translate(_FOLD).split() if text else []


def term_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, term, tf): a row per distinct term of each text, and one with the
    empty term and tf 1 for the text itself. ``row`` is unique to a row of the table
    within one run of this stage, so store it before use."""

    def run(batches):
        at = 0
        for batch in batches:
            part, ids, texts = (batch.column(i) for i in range(3))
            rows, n, flat, tfs, sizes = [], [], [], [], []
            for base, text in zip(part.to_pylist(), texts.to_pylist()):
                count = Counter(terms(text))
                rows.append((base << 40) + at)
                at += 1
                n.append(sum(count.values()))
                sizes.append(len(count) + 1)
                flat.append(b"")
                tfs.append(1)
                flat.extend(count.keys())
                tfs.extend(count.values())
            take = np.repeat(np.arange(len(rows)), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(rows, np.int64)[take]), ids.take(pa.array(take)),
                 pa.array(np.array(n, np.int64)[take]), pa.array(flat, pa.binary()),
                 pa.array(np.array(tfs, np.int64))], names=["row", "id", "n", "term", "tf"])

    source = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(id_col).cast("long").alias("id"),
                         F.col(text_col).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(run, "row long, id long, n long, term binary, tf long")


def nra(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int,
        depth: int = DEPTH) -> tuple[list[tuple[int, int]], int]:
    """The k documents with the greatest sums above 0, as (document, sum), ties to the
    smaller of ``ids``, and the number of postings read. A list holds documents
    (positions in ``ids``) and their impacts, descending and above 0."""
    size, width = len(ids), len(lists)
    lower = np.zeros(size, np.int64)
    met = np.zeros((size, width), bool)
    last = np.array([impacts[0] if len(impacts) else 0 for _, impacts in lists], np.int64)
    at = np.zeros(width, np.int64)
    while True:
        for j, (docs, impacts) in enumerate(lists):
            if at[j] < len(docs):
                end = min(at[j] + depth, len(docs))
                lower[docs[at[j]:end]] += impacts[at[j]:end]
                met[docs[at[j]:end], j] = True
                last[j] = impacts[end - 1] if end < len(docs) else 0
                at[j] = end
        depth *= 2
        done = not last.any()
        seen = np.flatnonzero(lower)
        kth = np.partition(lower[seen], -k)[-k] if len(seen) >= k else 0
        if not done and last.sum() >= max(kth, 1):
            continue  # a document not met yet may still get in, or tie
        rest = met[seen] @ last
        live = seen[lower[seen] + (last.sum() - rest) >= kth]
        open_ = (~met[live]) @ last > 0
        if done or not open_.any():
            order = live[np.lexsort((ids[live], -lower[live]))][:k]
            return [(int(d), int(lower[d])) for d in order], int(at.sum())


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, shard: int = SHARD, block: int = ITEMS,
           id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    asked = term_rows(items, item_col, item_text_col).where("id is not null and term <> cast('' as binary)")
    asked = stored(asked.select(F.col("id").alias("item_id"), "term").distinct(), "asked-terms")
    n_items = asked.agg(F.count_distinct("item_id")).first()[0]
    blocks = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-n_items // block)))).cast("int")

    vocabulary = stored(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "vocabulary")
    asked = stored(asked.join(vocabulary, "term").select("item_id", blocks.alias("block"), "t"), "asked")
    mark = asked.sparkSession.range(1).select(F.lit(b"").alias("term"), F.lit(-1).cast("long").alias("t"))
    postings = stored(term_rows(docs, id_col, text_col).join(vocabulary.unionByName(mark), "term").drop("term"),
                      "postings")

    whole = postings.where("t = -1 and n > 0")
    size = whole.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    n_docs, length = size["docs"], max(1, size["length"])
    df = postings.where("t >= 0").groupBy("t").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = stored(df.select("t", w.alias("w")).where("w > 0"), "term-weights")

    m = F.lit(10).cast("long") + F.expr(f"(90L * n * {n_docs}L) div {length}L")
    impact = F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    shards = max(1, -(-n_docs // shard))
    scored = (postings.withColumn("m", m).join(weights, "t")
              .select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "id", "t",
                      impact.alias("impact")).where("impact > 0"))
    lists = scored.join(asked.select("block", "t").distinct(), "t").select(
        "shard", "block", "row", "id", "t", "impact")
    # every block of items goes to every shard
    asks = asked.select(F.col("block").alias("block"), F.col("item_id").alias("item_id"), F.col("t").alias("t"),
                        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def answer(postings: pa.Table, asks: pa.Table) -> pa.Table:
        row, t, impact = (postings.column(c).to_numpy() for c in ("row", "t", "impact"))
        rows, first, place = np.unique(row, return_index=True, return_inverse=True)
        id_column = postings.column("id").combine_chunks().take(pa.array(first))
        ids = id_column.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        order = np.lexsort((-impact, t))
        place, t, impact = place[order], t[order], impact[order]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.empty(0, int)
        spans = {int(t[s]): slice(s, e) for s, e in zip(starts, [*starts[1:], len(t)])}
        found = []
        wants = pd.DataFrame({"item": asks.column("item_id").to_numpy(), "t": asks.column("t").to_numpy()})
        for item, group in wants.groupby("item"):
            cut = [spans[x] for x in group["t"].tolist() if x in spans]
            if cut:
                best, _ = nra([(place[s], impact[s]) for s in cut], ids, k)
                found += [(item, d, score) for d, score in best]
        items, at, scores = (np.array(x, np.int64) for x in (zip(*found) if found else ([], [], [])))
        return pa.table({"item_id": pa.array(items), "doc_id": id_column.take(pa.array(at)), "score": pa.array(scores)})

    best = lists.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(
        answer, "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
