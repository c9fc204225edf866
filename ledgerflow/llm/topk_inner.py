"""Exact top-k inner products over norm-sorted vectors (operator 4).

Components become floor(256 * x) integers. The Gram matrix of all vectors (summed
in Spark, d x d) gives the SVD rotation, in which the first dimensions carry most
of a vector's length. Vectors are range-partitioned by descending length and
packed into blocks; queries are packed into blocks with a lower bound of their
k-th best score, found on the longest vectors. Query blocks meet vector blocks by
an equi-join on block numbers, without those whose lengths can't reach the bound.
Inside a pair of blocks, slices go by descending length: a query stops when
|q||x| falls below its bound, and a vector is scored in full only when its partial
sum over the first rotated dimensions plus the Cauchy-Schwarz bound of the rest
reaches it. Full scores are integer sums, so results are exact.

Cases: null vectors and vectors with null or non-finite components take no part;
shorter vectors count as padded with zeros; ties go to the smaller vec_id; equal
rows are separate candidates only by vec_id (a row with the query's own vec_id is
never its candidate); an empty table gives an empty result. Large components are exact
as well: blocks whose scores may not fit 64 bits are scored in Python integers, scores are
ranked by all their digits, and one that doesn't fit a long is ranked but returned as null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored

BLOCK = 4096        # vectors in a block
QUERY_BLOCK = 512   # queries in a block
HEAD = 16           # rotated dimensions of the partial sum
SLICE = 512         # vectors looked at before the bound is renewed


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v, norm) of the vectors that take part."""
    # from 2**62 on a double is an integer already, and floor() would leave its range
    whole = lambda x: F.when(F.abs(x) < float(1 << 62), F.floor(x).cast("double")).otherwise(x)
    v = F.transform(F.col(vec_col), lambda x: whole(F.lit(scale) * x.cast("double")))
    ok = F.col(vec_col).isNotNull() & F.forall(
        vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return (table.where(ok & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(v, F.array().cast("array<double>")).alias("v"))
            .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the table, strongest first: eigenvectors of its Gram
    matrix, whose dim x dim entries are summed over all rows in Spark."""

    def run(batches):
        total = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["v"], dim)
                total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(dim * dim), "x": total.ravel()})

    cells = vectors.select("v").mapInPandas(run, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    gram = np.zeros(dim * dim)
    for row in cells.collect():  # dim * dim rows
        gram[row["cell"]] = row["x"]
    return np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1].copy()


def _matrix(column, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


class _Best:
    """The k best (score, vec_id) of each query of a block, ties to smaller ids."""

    def __init__(self, n: int, k: int, bounds: np.ndarray):
        self.k, self.bounds = k, bounds
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k and scores.dtype != object:
            top = np.lexsort((ids, -scores))[:self.k]
            scores, ids = scores[top], ids[top]
        best = sorted(self.found[q] + list(zip((-scores).tolist(), ids.tolist())))[:self.k]
        self.found[q] = best
        if len(best) == self.k:
            self.bounds[q] = max(self.bounds[q], float(-best[-1][0]))


def exact_integers(*parts: np.ndarray) -> list[np.ndarray]:
    """Integral doubles as 64-bit integers where no inner product of theirs can leave
    that range, else as Python integers."""
    size = 1.0
    for m in parts:
        size *= np.abs(m).max(initial=1.0)
    if size * max(1, parts[0].shape[1]) < 2.0 ** 62:
        return [m.astype(np.int64) for m in parts]
    return [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in parts]


def rank_text(score: int) -> str:
    """Text in whose order scores rise: sign, number of digits, digits; below zero all
    of it is complemented."""
    digits = f"{len(str(abs(score))):04d}{abs(score)}"
    return "1" + digits if score >= 0 else "0" + "".join(chr(ord("0") + ord("9") - ord(c)) for c in digits) + "~"


def search_block(q: np.ndarray, qids: np.ndarray, bounds: np.ndarray, x: np.ndarray, xids: np.ndarray,
                 rot: np.ndarray, k: int, head: int = HEAD, width: int = SLICE) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the best k of each query in one block of vectors
    that are sorted by descending length. ``bounds`` are scores known to be reached."""
    exact, qexact = exact_integers(x, q)
    qr, xr = q @ rot, x @ rot
    tail = lambda m: np.sqrt(np.maximum((m[:, head:] ** 2).sum(axis=1), 0))
    qt, xt = tail(qr), tail(xr)
    qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    best = _Best(len(q), k, bounds.astype(float).copy())
    slack = 1e-9 * (1 + qn)
    for at in range(0, len(x), width):
        end = min(at + width, len(x))
        live = np.flatnonzero(qn * xn[at] + slack * (1 + xn[at]) >= best.bounds)
        if not len(live):
            break
        part = qr[live, :head] @ xr[at:end, :head].T + np.outer(qt[live], xt[at:end])
        for row, i in enumerate(live):
            hit = np.flatnonzero(part[row] + slack[i] * (1 + xn[at]) >= best.bounds[i])
            hit = hit[xids[at + hit] != qids[i]]
            if len(hit):
                best.add(i, exact[at + hit] @ qexact[i], xids[at + hit])
    return [(int(qids[i]), v, -s) for i, found in enumerate(best.found) for s, v in found]


def _packed(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Blocks of ``size`` rows in partition order: ids and vectors as bytes, greatest
    length, least bound."""

    def run(batches):
        buf: list[pd.DataFrame] = []
        n = 0
        for pdf in batches:
            while len(pdf):
                take = pdf.iloc[:size - n]
                buf.append(take)
                n += len(take)
                pdf = pdf.iloc[len(take):]
                if n == size:
                    yield one(pd.concat(buf))
                    buf, n = [], 0
        if n:
            yield one(pd.concat(buf))

    def one(pdf):
        m = _matrix(pdf["v"], dim)
        bound = pdf["bound"].to_numpy(float)
        return pd.DataFrame([(pdf["vec_id"].to_numpy(np.int64).tobytes(), m.tobytes(),
                              bound.tobytes(), float(pdf["norm"].max()), float(bound.min()))],
                            columns=["ids", "m", "bounds", "norm", "bound"])

    cols = rows.select("vec_id", "v", "norm", "bound")
    return cols.mapInPandas(run, "ids binary, m binary, bounds binary, norm double, bound double")


def top_k_inner(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256,
                id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id ``every`` divides."""
    spark = table.sparkSession
    vectors = stored(integer_vectors(table, id_col, vec_col, scale), "vectors")
    size = vectors.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    dim = max(1, size["dim"] or 1)
    rot = rotation(vectors, dim)
    longest = vectors.orderBy(F.desc("norm"), "vec_id").limit(SLICE).collect()  # SLICE rows
    lx = _matrix([r["v"] for r in longest], dim)
    lids = np.array([r["vec_id"] for r in longest], np.int64)

    def bounded(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            s = _matrix(pdf["v"], dim) @ lx.T
            s[pdf["vec_id"].to_numpy()[:, None] == lids[None, :]] = -np.inf
            kth = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), -np.inf)
            yield pdf.assign(bound=kth)

    parts = max(1, -(-size["n"] // (every * QUERY_BLOCK)))
    queries = (vectors.where(F.col("vec_id") % every == 0)
               .mapInPandas(bounded, "vec_id long, v array<double>, norm double, bound double")
               .repartitionByRange(parts, F.desc("norm"), "vec_id"))
    qblocks = stored(_packed(queries, dim, QUERY_BLOCK).withColumn("qp", F.spark_partition_id()), "query-blocks")
    sorted_vectors = (vectors.withColumn("bound", F.lit(0.0))
                      .repartitionByRange(max(1, -(-size["n"] // BLOCK)), F.desc("norm"), "vec_id")
                      .sortWithinPartitions(F.desc("norm"), "vec_id"))
    vblocks = stored(_packed(sorted_vectors, dim, BLOCK), "vector-blocks")
    # every vector block goes to the partitions of the query blocks
    left = vblocks.select("ids", "m", F.col("norm").alias("xnorm"),
                          F.explode(F.sequence(F.lit(0), qblocks.agg(F.max("qp")).scalar())).alias("qp"))
    right = qblocks.select("qp", F.col("ids").alias("qids"), F.col("m").alias("qm"), "bounds",
                           F.col("norm").alias("qnorm"), "bound")
    pairs = left.join(right, "qp").where(
        F.col("qnorm") * F.col("xnorm") * (1 + 1e-9) + 1 >= F.col("bound"))

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                x, q = (np.frombuffer(b).reshape(-1, dim) for b in (row.m, row.qm))
                found = search_block(q, np.frombuffer(row.qids, np.int64), np.frombuffer(row.bounds), x,
                                     np.frombuffer(row.ids, np.int64), rot, k)
                yield pd.DataFrame([(a, b, str(c), rank_text(c)) for a, b, c in found],
                                   columns=["query_id", "vec_id", "score", "place"])

    best = pairs.select("ids", "m", "qids", "qm", "bounds").mapInPandas(
        run, "query_id long, vec_id long, score string, place string")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))
