"""Near duplicates by b-bit MinHash (operator 2).

One pass per document makes the minima of its shingle hashes under many linear
permutations; bands of minima give bucket keys, the low bits of the minima are
packed into a short signature. Equal shingle sets are first reduced to one
representative. Every bucket names a hub (the member that meets most others over
all bands), so that two members of any bucket lie in one hub's cluster. Clusters
are cut into blocks of bounded size; inside a block, packed signatures give the
collision-corrected similarity by bit counts, pairs that may reach the threshold
are confirmed on their full shingle sets, and only links that join two still
separate parts come out: their number grows with the members, not the pairs.

Cases: null or blank text has no shingles and is linked with nothing; a null
doc_id is in no component; rows repeated with one doc_id share their fate; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import WordHashes, doc_columns, parted, shingle_set, stored, word_list
from ledgerflow.llm.components import connected_components

ROWS = 6        # minima in a band
BITS = 4        # low bits kept of a minimum
MISS = 1e-7     # chance that a pair exactly at the threshold meets in no band
BLOCK = 1 << 20  # shingles of the texts that one task compares at once


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed for that chance; even, so that signatures fill whole words."""
    n = math.ceil(math.log(miss) / math.log(1 - threshold ** rows))
    return n + n % 2


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, n, dtype=np.uint32))


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of each permutation over the upper halves of the hashes."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(h), 2048):
        x = np.multiply.outer(a, h[at:at + 2048])
        x += b[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def pack_low_bits(mins: np.ndarray) -> bytes:
    """Four low bits of each minimum, two to a byte, padded to whole 64-bit words."""
    low = (mins & np.uint32(15)).astype(np.uint8)
    low = np.concatenate([low, np.zeros(-len(low) % 16, np.uint8)])
    return (low[0::2] | (low[1::2] << 4)).tobytes()


_FOURTHS = np.uint64(0x1111111111111111)


def estimate(one: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    """Similarity of a packed signature to each row of ``many``: the share of equal
    low bits, less what chance makes equal (one in 2**BITS)."""
    x = np.bitwise_xor(many, one)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    x &= _FOURTHS
    equal = (n - np.bitwise_count(x).sum(axis=1, dtype=np.int64)) / n
    chance = 2.0 ** -BITS
    return (equal - chance) / (1 - chance)


def floor_for(threshold: float, n: int) -> float:
    """Estimates below this can't belong to a linked pair but by six deviations."""
    chance = 2.0 ** -BITS
    p = threshold + (1 - threshold) * chance
    return threshold - 6 * math.sqrt(p * (1 - p) / n) / (1 - chance)


def band_keys(mins: np.ndarray, rows: int) -> np.ndarray:
    parts = mins.reshape(-1, rows).astype(np.uint64)
    acc = np.arange(len(parts), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(rows):
        acc ^= parts[:, j]
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(31)
    return acc.view(np.int64)


def signatures(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(doc_id, th) -> (doc_id, th, n_shingles, fp, sig, bands): fp names the shingle set.
    Ids go through the workers as text, exact beside a null."""
    n = bands_for(threshold) * ROWS

    def run(batches):
        a, b = permutations(n)
        cache = WordHashes()
        for pdf in batches:
            out = []
            for i, th, text in zip(pdf["doc_id"], pdf["th"], pdf["text"]):
                s = shingle_set(cache.of(word_list(text)), k)
                if len(s):
                    m = minima(s, a, b)
                    out.append((i, th, len(s), xxhash.xxh3_128_digest(s.tobytes()), pack_low_bits(m), band_keys(m, ROWS)))
                else:
                    out.append((i, th, 0, f"empty {i}".encode(), b"", np.empty(0, np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "th", "n_shingles", "fp", "sig", "bands"])

    found = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        run, "doc_id string, th long, n_shingles long, fp binary, sig binary, bands array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _links_in_block(texts, sigs, sides, ids, k, share: Fraction, n: int):
    """Links (pairs of ids) that join separate parts of one block. ``sides`` has 0
    and 1 for the two halves of a block pair, or 2 throughout for a block with itself."""
    cache = WordHashes()
    sets = [shingle_set(cache.of(word_list(t)), k) for t in texts]
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    names, flat = np.unique(flat, return_inverse=True)
    packed = np.frombuffer(b"".join(sigs), np.uint64).reshape(len(sigs), -1)
    part = np.arange(len(sets))
    flag = np.zeros(len(names), np.int8)
    num, den, floor = share.numerator, share.denominator, floor_for(float(share), n)
    # texts that most others resemble come first: their links join most parts
    for x in np.argsort(-sizes, kind="stable"):
        other = (part != part[x]) & (sides != sides[x]) if sides[x] != 2 else part != part[x]
        other &= (den * sizes >= num * sizes[x]) & (den * sizes[x] >= num * sizes)
        c = np.flatnonzero(other)
        if len(c):
            c = c[estimate(packed[x], packed[c], n) >= floor]
        if not len(c):
            continue
        own = flat[starts[x]:starts[x] + sizes[x]]
        flag[own] = 1
        if len(c) * 4 > len(sets):
            shared = np.add.reduceat(flag[flat], starts, dtype=np.int64)[c]
        else:
            shared = np.array([flag[flat[starts[y]:starts[y] + sizes[y]]].sum(dtype=np.int64) for y in c])
        flag[own] = 0
        for y in c[den * shared >= num * (sizes[x] + sizes[c] - shared)]:
            if part[y] != part[x]:
                part[part == part[y]] = part[x]
                yield min(ids[x], ids[y]), max(ids[x], ids[y])


def near_links(docs: DataFrame, sig: DataFrame, k: int, threshold: float, block: int) -> DataFrame:
    """(u, v): links between representatives, by rid, whose components are those of all
    pairs at the threshold."""
    n = bands_for(threshold) * ROWS
    share = Fraction(str(threshold))
    rows = sig.select("rid", "n_shingles", F.explode("bands").alias("key"))
    buckets = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = stored(rows.join(buckets, "key"), "members")
    weight = members.groupBy("rid").agg(F.sum("n").alias("w"))
    hubs = stored(members.select("key", "rid").join(weight, "rid").groupBy("key")
                  .agg(F.max(F.struct("w", (-F.col("rid")).alias("d"))).alias("h"))
                  .select("key", (-F.col("h.d")).alias("hub")), "hubs")
    clusters = stored(members.join(hubs, "key").select("hub", "rid", "n_shingles").distinct(), "clusters")
    sizes = stored(clusters.groupBy("hub").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("m"))
                   .where("m > 1").select("hub", F.ceil(F.col("total") / block).cast("long").alias("nb")), "clusters-n")
    parts = (clusters.join(sizes, "hub")
             .withColumn("i", F.expr("pmod(xxhash64(rid), nb)"))
             .withColumn("j", F.explode(F.expr("sequence(0L, nb - 1)")))
             .select("hub", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "rid",
                     F.expr("case when i = j then 2 when i < j then 0 else 1 end").alias("side")))
    # of the texts, only those in a cluster of several move
    rids = clusters.join(sizes, "hub").select("rid").distinct()
    packed = stored(sig.select("rid", "sig", "doc_id", "th").join(rids, "rid"), "packed")
    texts, _ = parted(docs.select("doc_id", "th", "text"), packed, ["doc_id", "th"])

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", kind="stable").drop_duplicates("rid")
        found = _links_in_block(pdf["text"].tolist(), pdf["sig"].tolist(), pdf["side"].to_numpy(),
                                pdf["rid"].tolist(), k, share, n) if len(pdf) > 1 else ()
        return pd.DataFrame(list(found), columns=["u", "v"]).astype("int64")

    return (parts.join(packed, "rid").join(texts, ["doc_id", "th"])
            .groupBy("hub", "p", "q").applyInPandas(verify, "u long, v long"))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, block: int = BLOCK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id
    reachable over links with Jaccard similarity >= threshold on distinct k-word
    shingles), kept (it is that document), text_hash (which of an id's texts it is)."""
    d = doc_columns(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    sig = stored(signatures(d, k, threshold), "signatures")
    classes = (sig.where("n_shingles > 0 and doc_id is not null").groupBy("fp")
               .agg(F.min(F.struct("doc_id", "th")).alias("r")).select("fp", "r.doc_id", "r.th"))
    # texts of one id are different nodes, so nodes have numbers of their own
    reps = sig.join(stored(classes, "classes"), ["fp", "doc_id", "th"]).dropDuplicates(["fp"])
    reps = stored(reps.withColumn("rid", F.monotonically_increasing_id()), "reps")
    parts = connected_components(near_links(d, reps, k, threshold, block))
    nodes = reps.select("rid", "fp", "doc_id").join(parts.withColumnRenamed("node", "rid"), "rid", "left")
    least = nodes.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = stored(nodes.join(least, "component", "left").select("fp", F.coalesce("least", "doc_id").alias("component")),
                   "named")
    return (sig.select("doc_id", "n_shingles", "fp", F.col("th").alias("text_hash")).join(named, "fp", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "text_hash")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
