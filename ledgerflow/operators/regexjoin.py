"""Joins of many regex patterns with many texts (J3, J5 in regex mode).

The reference searches names with the user's text as a regular expression, any case. As
a join that would test every pattern against every text. Here each distinct pattern is
planned once: a pattern that doesn't compile becomes a status row, any other becomes the
literals that a match must hold - the runs of plain characters of each of its
alternatives. Texts that hold a literal come from the q-gram join; of each alternative's
literals the one that the fewest texts hold gives the candidates, and only these are
searched. Patterns without such a literal (``.*``, ``a?``) are searched in all texts, in
blocks of bounded size. The result is that of searching everything.

Patterns are Python's, as in the reference, so the search itself is a pandas UDF over
candidates; nothing else here leaves the JVM.

Patterns and literals are exploded and stored on the way, where size estimates fall far
short, so the joins ask for a sort-merge join: none of them gathers a side in the driver.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.textjoin import contains_pairs
from ledgerflow.session import cut_lineage

BLOCK = 500  # patterns without a literal that are searched in one pass over the texts


@lru_cache(maxsize=4096)
def compiled(pattern: str):
    """The compiled pattern, or the text of its error."""
    try:
        return re.compile(pattern)
    except (re.error, OverflowError, RecursionError) as e:
        return f"{type(e).__name__}: {e}"


def alternatives(pattern: str) -> list[str]:
    """The pattern's alternatives: split at each ``|`` outside groups and classes."""
    out, depth, start, i, n = [], 0, 0, 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = _class_end(pattern, i)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def _class_end(pattern: str, i: int) -> int:
    """Place of the ``]`` that ends the class opened at ``i``; one that comes first in
    the class is a member of it."""
    i += 1
    if pattern[i:i + 1] == "^":
        i += 1
    if pattern[i:i + 1] == "]":
        i += 1
    while i < len(pattern) and pattern[i] != "]":
        i += 2 if pattern[i] == "\\" else 1
    return i


def literal_runs(alternative: str) -> list[str]:
    """The runs of plain characters that every match of an alternative holds; groups and
    classes count as unknown, and so does a character that may be absent."""
    runs, run, i, n = [], "", 0, len(alternative)
    while i < n:
        c, literal = alternative[i], None
        if c == "\\" and i + 1 < n:
            i += 1
            literal = None if alternative[i].isalnum() else alternative[i]
        elif c == "[":
            i = _class_end(alternative, i)
        elif c == "(":
            depth = 1
            while depth and i + 1 < n:
                i += 1
                if alternative[i] == "\\":
                    i += 1
                elif alternative[i] == "[":
                    i = _class_end(alternative, i)
                elif alternative[i] in "()":
                    depth += 1 if alternative[i] == "(" else -1
        elif c not in ".^$*+?{":
            literal = c
        after = alternative[i + 1:i + 2]
        if literal is None or after in ("*", "?", "{"):
            runs, run = [*runs, run], ""
        else:
            run += literal
            if after == "+":
                runs, run = [*runs, run], ""
        i += 1
        if after == "{":  # the digits of a count are no characters of the text
            i = max(i, alternative.find("}", i) + 1)
        elif after and after in "*?+":
            i += 1
    return sorted({x for x in (*runs, run) if x})


def literals(pattern: str) -> list[str] | None:
    """One literal for each alternative, of which a match holds at least one; None where
    an alternative has none, or where flags change what characters mean."""
    found = needed(pattern)
    return found and sorted({max(runs, key=len) for runs in found})


def needed(pattern: str) -> list[list[str]] | None:
    """Every alternative's literals, all of which its matches hold; None as in ``literals``."""
    if "(?" in pattern:
        return None
    found = [literal_runs(a) for a in alternatives(pattern)]
    return found if all(found) else None


def _planned(patterns: pd.Series) -> pd.DataFrame:
    errors = [None if not isinstance(compiled(p), str) else compiled(p) for p in patterns]
    return pd.DataFrame({"error": errors, "literals": [None if e else needed(p) for p, e in zip(patterns, errors)]})


def _found(patterns: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([compiled(p).search(t) is not None for p, t in zip(patterns, texts)], dtype=bool)


def planned_patterns(patterns: DataFrame, col: str) -> DataFrame:
    """(pattern, lowered, error, literals) of every distinct pattern that isn't empty."""
    plan = F.pandas_udf(_planned, "error string, literals array<array<string>>")
    p = patterns.select(F.col(col).alias("pattern")).where(F.length("pattern") > 0).distinct()
    return cut_lineage(p.withColumn("lowered", F.lower("pattern")).withColumn("plan", plan("lowered"))
                       .select("pattern", "lowered", "plan.*"))


def regex_pairs(planned: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """Distinct (pattern, text) pairs where the lowered pattern is found in the lowered
    text, for the patterns of ``planned_patterns`` that compile."""
    good = planned.where("error is null").select("pattern", "lowered", "literals")
    names = texts.select(F.col(text_col).alias("text")).where("text is not null").distinct()
    by_literal = (good.where("literals is not null").select("pattern", "lowered", F.posexplode("literals").alias("alternative", "runs"))
                  .select("pattern", "lowered", "alternative", F.explode("runs").alias("literal")))
    # stored: counted to choose the literals, then joined to those chosen
    held = cut_lineage(contains_pairs(by_literal, "literal", names, "text").withColumnRenamed("pattern", "literal"))
    n = held.groupBy("literal").agg(F.count(F.lit(1)).alias("n")).hint("merge")
    rarest = by_literal.join(n, "literal", "left").groupBy("pattern", "lowered", "alternative").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "literal")).alias("rarest"))
    chosen = rarest.select("pattern", "lowered", F.col("rarest.literal").alias("literal")).distinct()
    candidates = chosen.join(held.hint("merge"), "literal").select("pattern", "lowered", "text").distinct()
    found = F.pandas_udf(_found, "boolean")
    out = candidates.where(found("lowered", F.lower("text"))).select("pattern", "text")
    bare = good.where("literals is null").select("pattern", "lowered")
    # a stated set of patterns against all texts, BLOCK of them at a time
    todo = cut_lineage(bare.withColumn("block", F.expr(f"monotonically_increasing_id() div {BLOCK}")))
    for row in todo.select("block").distinct().toLocalIterator():
        block = [(r["pattern"], r["lowered"]) for r in todo.where(F.col("block") == row["block"]).collect()]
        out = out.unionByName(_searched(names, block))
    return out


def _searched(names: DataFrame, block: list[tuple[str, str]]) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for pattern, lowered in block:
                hit = [t for t in pdf["text"] if compiled(lowered).search(t.lower())]
                if hit:
                    yield pd.DataFrame({"pattern": pattern, "text": hit})

    return names.mapInPandas(run, "pattern string, text string")
