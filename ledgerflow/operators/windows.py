"""Skew-safe running sums (W1) and ranking helpers.

A plain ``sum(...).over(partitionBy(party).orderBy(...))`` puts every row of a
party into one task. When one party holds a third of all rows that task is the
whole job. ``running_sums`` instead computes the same prefix sums in levels,
one per ordering column:

  level 0: totals per (keys, o1)            -> exclusive prefix over o1 within keys
  level 1: totals per (keys, o1, o2)        -> exclusive prefix over o2 within (keys, o1)
  ...
  rows:    inclusive prefix over o_k within (keys, o1..o_{k-1})

and adds the offsets. Each window partition is bounded by the number of
distinct values of one ordering column inside its parent block (days in a
year, vouchers in a day, entries in a voucher), never by the size of a party.
The level tables are pre-aggregated (partial aggregation before the shuffle),
so only the row level moves every row once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Add one column per ``values`` entry: the running sum of that expression over
    rows of the same ``keys`` ordered by ``order`` (ascending, nulls first).

    ``order`` must make rows unique within ``keys`` for the result to be
    deterministic (as any running total needs). Values should be exact types
    (DECIMAL / integral) so the result does not depend on evaluation order.
    """
    columns = list(df.columns)
    # in a struct a null equals a null, so the level joins lose no row
    boxed = {f"__k_{i}": F.struct(F.col(c)) for i, c in enumerate([*keys, *order])}
    keys, order = list(boxed)[:len(keys)], list(boxed)[len(keys):]
    names = list(values)
    tmp = {n: f"__v_{i}" for i, n in enumerate(names)}
    base = df.withColumns({tmp[n]: values[n] for n in names}).withColumns(boxed)
    if len(order) == 1:
        w = (Window.partitionBy(*keys).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = base.withColumns({n: F.sum(tmp[n]).over(w) for n in names})
        if not inclusive:
            out = out.withColumns({n: F.col(n) - F.col(tmp[n]) for n in names})
        return out.select(*columns, *names)

    # offsets[j]: per (keys, order[:j+1]) exclusive prefix of everything before the block
    offsets: DataFrame | None = None
    for j in range(len(order) - 1):
        block = keys + order[:j + 1]
        tot = base.groupBy(*block).agg(*[F.sum(tmp[n]).alias(tmp[n]) for n in names])
        w = (Window.partitionBy(*(keys + order[:j])).orderBy(order[j])
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        lvl = tot.select(*block, *[(F.sum(tmp[n]).over(w) - F.col(tmp[n])).alias(f"__o{j}_{i}")
                                   for i, n in enumerate(names)])
        if offsets is not None:
            prev = keys + order[:j]
            lvl = lvl.join(offsets, on=prev, how="inner")
            lvl = lvl.select(*block, *[(F.col(f"__o{j}_{i}") + F.col(f"__o{j - 1}_{i}"))
                                       .alias(f"__o{j}_{i}") for i, _ in enumerate(names)])
        offsets = lvl
    last = len(order) - 2
    block = keys + order[:-1]
    w = (Window.partitionBy(*block).orderBy(order[-1])
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = base.withColumns({f"__r_{i}": F.sum(tmp[n]).over(w) for i, n in enumerate(names)})
    out = rows.join(offsets, on=block, how="inner")
    cols = {}
    for i, n in enumerate(names):
        v = F.col(f"__r_{i}") + F.col(f"__o{last}_{i}")
        cols[n] = v if inclusive else v - F.col(tmp[n])
    out = out.withColumns(cols)
    return out.select(*columns, *names)
