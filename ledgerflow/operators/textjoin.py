"""Exact "text contains pattern" joins without a cross product.

``contains(lower(text), lower(pattern))`` is a theta predicate; as a join Spark
can only run it as a (broadcast) nested loop over all pairs. Here it becomes an
equi-join on q-grams followed by the exact test:

1. distinct patterns and distinct texts (pre-aggregated: names repeat a lot);
2. every text emits its distinct g-grams for the few gram lengths in use
   (g = q for patterns of length >= q, g = len(p) for shorter ones);
3. gram frequencies over the texts, counted in FREQ_BUCKETS hash buckets (a
   partial/final aggregate of bounded size, so it is broadcast);
4. every pattern picks the gram of its rarest bucket (an empty one -> no match);
5. candidates = pattern's gram = text gram (an equi-join; hot grams are
   split by AQE's skew handling), then ``contains`` verifies each candidate.

If ``text`` contains ``pattern`` it contains every gram of ``pattern``, so no
true pair is lost; the verification drops false candidates, so the result is
exact. Empty patterns are not matched (documented deviation: they would match
every text). Size estimates don't see the rows that explode adds, so the grams of all
texts may pass for a table that is small enough to broadcast: the candidate join asks
for a sort-merge join, which gathers neither side in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_Q = 8
# The rarest gram is looked for among a pattern's first POS_RANGE grams (any gram of it
# finds all its texts), and grams of FREQ_RANGE texts or more count as equally frequent.
POS_RANGE = 1 << 24
FREQ_RANGE = 1 << 38
FREQ_BUCKETS = 1 << 19


def _grams(col: F.Column, g: F.Column, distinct: bool = True) -> F.Column:
    """Substrings of length g of col, in position order (distinct ones only when
    ``distinct``); an empty array when col is shorter than g."""
    n = F.length(col) - g + 1
    subs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.substring(col, i, g))
    return F.when(n >= 1, F.array_distinct(subs) if distinct else subs) \
        .otherwise(F.array().cast("array<string>"))


def _bucket(gram: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(gram), F.lit(FREQ_BUCKETS)).cast("int")


def contains_pairs(patterns: DataFrame, pattern_col: str, texts: DataFrame, text_col: str,
                   q: int = DEFAULT_Q, case_insensitive: bool = True) -> DataFrame:
    """Distinct (pattern, text) pairs where text contains pattern.

    Returns columns ``pattern`` and ``text`` holding the original values.
    """
    low = F.lower if case_insensitive else (lambda c: c)
    pats = (patterns.select(F.col(pattern_col).alias("pattern"))
            .where(F.col("pattern").isNotNull() & (F.length("pattern") > 0))
            .distinct()
            .withColumn("p_l", low(F.col("pattern")))
            .withColumn("g", F.least(F.length("p_l"), F.lit(q))))
    txts = (texts.select(F.col(text_col).alias("text"))
            .where(F.col("text").isNotNull())
            .distinct()
            .withColumn("t_l", low(F.col("text"))))
    # the gram lengths in use (at most q values); texts only emit grams of those
    # lengths: (text, g) for g in 1..q, kept by an equi semi-join on g
    lengths = F.broadcast(pats.select("g").distinct())
    tg = (txts.select("text", "t_l", F.explode(F.sequence(F.lit(1), F.lit(q))).alias("g"))
          .join(lengths, "g", "left_semi")
          .select("text", F.explode(_grams(F.col("t_l"), F.col("g"))).alias("gram")))
    freq = tg.groupBy(_bucket(F.col("gram")).alias("bucket")).agg(F.count(F.lit(1)).alias("freq"))
    pg = pats.select("pattern", "p_l", "g", F.posexplode(_grams(F.col("p_l"), F.col("g"), False))
                     .alias("pos", "gram"))
    pg = (pg.where(F.col("pos") < POS_RANGE).withColumn("bucket", _bucket(F.col("gram")))
          .join(F.broadcast(freq), "bucket", "left")
          .withColumn("freq", F.least(F.coalesce("freq", F.lit(0)), F.lit(FREQ_RANGE))))
    # rarest gram (ties: first position) as one long key, so the aggregate stays
    # a hash aggregate; the gram is re-read from the pattern at that position
    key = F.col("freq").cast("long") * F.lit(POS_RANGE) + F.col("pos")
    rare = (pg.groupBy("pattern", "p_l", "g").agg(F.min(key).alias("k"))
            .where(F.col("k") >= F.lit(POS_RANGE))
            .select("pattern", "p_l",
                    F.substring(F.col("p_l"), (F.col("k") % F.lit(POS_RANGE) + 1).cast("int"),
                                F.col("g")).alias("gram")))
    cand = rare.join(tg.hint("merge"), "gram").where(F.contains(low(F.col("text")), F.col("p_l")))
    # one rare gram per pattern and one row per (text, gram): pairs are already unique
    return cand.select("pattern", "text")
