"""Single-table reports over the ledger table.

Money aggregates are exact sums of unrounded balances (``exact_sum``) cast back to DOUBLE; means are that
sum divided by the count. Top-k is ``orderBy(...).limit(k)`` (TakeOrderedAndProject:
each task keeps k rows, no full sort); ranks are numbered after the limit, so
no window ever runs over the whole table. Every order ends in ``ledger_name``
so ties are deterministic.

Report-level numbers (counts, totals) are attached to detail rows as scalar
subqueries (``DataFrame.scalar()``), which Spark evaluates once. Reports of several
sections read the table once for all their first-k lists (each row is dealt to the
sections it belongs to, and a group limit keeps k rows of each per task) and once for
all their sums; which sections show is decided on the few rows that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.numbers import exact_sum, joined, limbs
from ledgerflow.operators import filters as FL
from ledgerflow.session import cut_lineage

PAGE_SIZE = 15
ALL_SETTLED = "All accounts are settled"


def money_sum(c: str) -> Column:
    return joined(*exact_sum(c))


def money_mean(c: str) -> Column:
    return F.when(F.count(F.col(c)) > 0, money_sum(c) / F.count(F.col(c)))


def ranked(df: DataFrame, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """First k rows by ``order`` (ending in a unique key), numbered 1..k."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))


def top_k(df: DataFrame, k: int, col: str = "closing_balance") -> DataFrame:
    """K largest."""
    return ranked(df, [F.col(col).desc(), F.col("ledger_name").asc()], k)


def bottom_k(df: DataFrame, k: int, col: str = "closing_balance") -> DataFrame:
    """K smallest."""
    return ranked(df, [F.col(col).asc(), F.col("ledger_name").asc()], k)


def recent_k(df: DataFrame, k: int = 5) -> DataFrame:
    """K latest altered_on (non-null)."""
    return ranked(df.where(FL.has_date()), [F.col("altered_on").desc(), F.col("ledger_name").asc()], k)


def pending(ledgers: DataFrame, mode: str = "normalized") -> DataFrame:
    """parties with a non-zero balance outside internal groups."""
    return ledgers.where(FL.nonzero_balance() & FL.business(mode))


def pending_metrics(ledgers: DataFrame, mode: str = "normalized") -> DataFrame:
    """A1: count, total and mean closing of pending parties."""
    return pending(ledgers, mode).agg(
        F.count(F.lit(1)).alias("total_pending"),
        money_sum("closing_balance").alias("total_amount"),
        money_mean("closing_balance").alias("avg_pending"))


def summary_stats(ledgers: DataFrame) -> DataFrame:
    """A2 over all ledgers."""
    return ledgers.agg(
        F.count(F.lit(1)).alias("total_parties"),
        money_sum("closing_balance").alias("total_balance"),
        money_mean("closing_balance").alias("avg_balance"),
        F.max("closing_balance").alias("max_balance"),
        F.min("closing_balance").alias("min_balance"))


def group_totals(ledgers: DataFrame, k: int = 5, mode: str = "normalized") -> DataFrame:
    """A3: closing summed by parent over business ledgers, k largest groups."""
    g = (ledgers.where(FL.business(mode))
         .groupBy("parent").agg(money_sum("closing_balance").alias("group_balance")))
    return ranked(g, [F.col("group_balance").desc(), F.col("parent").asc_nulls_first()], k)


def net_position(ledgers: DataFrame, mode: str = "normalized") -> DataFrame:
    """A4: one pass with conditional sums over F2 ledgers."""
    b = ledgers.where(FL.business_wide(mode))
    p, n = (exact_sum("closing_balance", x) for x in (F.col("closing_balance") > 0, F.col("closing_balance") < 0))
    sums = b.agg(F.struct(*p).alias("p"), F.struct(*n).alias("n"))
    whole, rest = (lambda x: F.col(f"{x}.col1")), (lambda x: F.col(f"{x}.col2"))
    return sums.select(
        joined(whole("p"), rest("p")).alias("assets"),
        F.abs(joined(whole("n"), rest("n"))).alias("liabilities"),
        joined(whole("p") + whole("n"), rest("p") + rest("n")).alias("net_position"))


def pnl_card(ledgers: DataFrame, pattern: str = FL.PNL_PATTERN, mode: str = "normalized") -> DataFrame:
    """F7 + A5: the first P&L account (by name): closing, opening, closing - opening."""
    first = FL.pnl_accounts(ledgers, pattern, mode).orderBy("ledger_name").limit(1)
    closing, opening = limbs("closing_balance"), limbs("opening_balance")
    return first.select(
        F.col("ledger_name").alias("account"),
        F.col("closing_balance").alias("pnl_closing"),
        F.col("opening_balance").alias("pnl_opening"),
        joined(closing[0] - opening[0], closing[1] - opening[1]).alias("net_profit"))


def available_years(ledgers: DataFrame) -> DataFrame:
    """Sorted distinct years of altered_on."""
    return (ledgers.where(FL.has_date()).select(F.year("altered_on").alias("year"))
            .distinct().orderBy("year"))


def trend_totals(ledgers: DataFrame) -> DataFrame:
    """A7 + A8: ledger count, net closing, and whether any date exists."""
    return ledgers.agg(
        F.count(F.lit(1)).alias("total_parties"),
        money_sum("closing_balance").alias("net_balance"),
        (F.count("altered_on") > 0).alias("has_dates"))


def page_counts(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Rows and ceil(rows / size)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.ceil(F.col("rows") / F.lit(size)).cast("long").alias("pages"))


def paginate(df: DataFrame, order: list[Column], page: int, size: int = PAGE_SIZE) -> DataFrame:
    """T5: page ``page`` (1-based) of ``size`` rows; rank continues over pages.

    offset/limit keeps at most page*size rows per task (no global sort, no
    global window); the rank is numbered on the <= size rows of the page.
    """
    start = (page - 1) * size
    rows = df.orderBy(*order).offset(start).limit(size)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + F.lit(start))


def global_rank(df: DataFrame, order: list[Column], rank_col: str = "rank") -> DataFrame:
    """Number all rows 1..n by ``order`` without bringing them together: rows are dealt to
    key ranges and stored, ranges are counted, and a row's rank is its place within its
    range plus the rows of the ranges before. The order should end in a unique key; rows
    equal in all of it are numbered in any order, over a range border as well as within.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    counts = dict(dealt.groupBy("__range").count().collect())  # a row for each range, shuffle partitions at most
    before, total = [], 0
    for i in sorted(counts):
        before.append((i, total))
        total += counts[i]
    offsets = df.sparkSession.createDataFrame(before, "__range int, __before long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return (dealt.withColumn("__place", place).join(F.broadcast(offsets), "__range")
            .withColumn(rank_col, F.col("__before") + F.col("__place")).select(*df.columns, rank_col))


def paginate_all(df: DataFrame, order: list[Column], size: int = PAGE_SIZE) -> DataFrame:
    """T5 for all pages at once: rank, page, and which rows of how many the page shows."""
    ranked_rows = global_rank(df, order)
    total = df.agg(F.count(F.lit(1))).scalar()
    page = F.ceil(F.col("rank") / F.lit(size)).cast("long")
    return ranked_rows.withColumn("page", page).withColumns({
        "first_row": (F.col("page") - 1) * size + 1, "last_row": F.least(F.col("page") * size, total), "rows": total})


def pending_order() -> list[Column]:
    return [F.col("closing_balance").desc(), F.col("ledger_name").asc()]


def pending_report(ledgers: DataFrame, page: int = 1, mode: str = "normalized") -> DataFrame:
    """Page of the pending list (T4/T5) with the A1 metrics and page count."""
    p = pending(ledgers, mode)
    m = pending_metrics(ledgers, mode)
    rows = paginate(p.select("ledger_name", "closing_balance", "parent"), pending_order(), page)
    # nothing pending: one row that says so, as the other reports have
    settled = m.where(F.col("total_pending") == 0).select(
        F.lit(0).cast(rows.schema["rank"].dataType).alias("rank"), F.lit(ALL_SETTLED).alias("ledger_name"),
        F.lit(0.0).alias("closing_balance"), F.lit("").alias("parent"))
    rows = rows.select("rank", "ledger_name", "closing_balance", "parent").unionByName(settled)
    return rows.select(
        "rank", "ledger_name", "closing_balance", "parent",
        F.lit(page).alias("page"),
        m.select("total_pending").scalar().alias("total_pending"),
        m.select("total_amount").scalar().alias("total_amount"),
        m.select("avg_pending").scalar().alias("avg_pending"),
        F.ceil(m.select("total_pending").scalar() / F.lit(PAGE_SIZE)).cast("long").alias("pages"))


ROW = "struct<section:string,rank:int,name:string,parent:string,amount:double>"


def _row(section: str, amount, name=None, rank=None, parent=None) -> Column:
    """One report row as a struct; columns, column names or None."""
    c = lambda x: F.lit(None) if x is None else F.col(x) if isinstance(x, str) else x
    return F.struct(F.lit(section).alias("section"), c(rank).alias("rank"), c(name).alias("name"),
                    c(parent).alias("parent"), c(amount).alias("amount")).cast(ROW)


def _rows(df: DataFrame, *rows: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Report rows out of each row of ``df``, in one pass; nulls among them are left out."""
    out = df.select(*carry, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r"))
    return out.select("r.*", *carry)


def _first_of(ledgers: DataFrame, sections: dict[str, tuple[Column, Column | None, int]]) -> DataFrame:
    """The first rows of several lists in one scan: section -> (which ledgers, sort key,
    smallest first and then by name, how many). Adds ``section`` and ``rank``."""
    keyed = [F.when(which, F.struct(F.lit(name).alias("section"),
                                    (F.lit(0.0) if key is None else key.cast("double")).alias("key")))
             for name, (which, key, _) in sections.items()]
    dealt = ledgers.withColumn("s", F.explode(F.filter(F.array(*keyed), lambda x: x.isNotNull())))
    most = max(k for _, _, k in sections.values())
    place = F.row_number().over(Window.partitionBy("s.section").orderBy("s.key", "ledger_name"))
    few = dealt.withColumn("rank", place).where(F.col("rank") <= most).withColumn("section", F.col("s.section")).drop("s")
    limit = F.lit(most)
    for name, (_, _, k) in sections.items():
        limit = F.when(F.col("section") == name, F.lit(k)).otherwise(limit)
    return few.where(F.col("rank") <= limit)


def _if_any(rows: DataFrame, section: str) -> Column:
    """Whether a section has a row, on each row of a report (a few dozen rows)."""
    return F.coalesce(F.max(F.col("section") == section).over(Window.partitionBy(F.lit(0))), F.lit(False))


def _card() -> tuple[Column, ...]:
    """A P&L account's three rows (F7, A5) from its ledger."""
    closing, opening = limbs("closing_balance"), limbs("opening_balance")
    profit = joined(closing[0] - opening[0], closing[1] - opening[1])
    of = lambda section, amount: F.when(F.col("section") == "pnl", _row(section, amount, "ledger_name"))
    return of("pnl_closing", "closing_balance"), of("pnl_opening", "opening_balance"), of("net_profit", profit)


def _listed(section: str, parent: str | None = "parent") -> Column:
    return F.when(F.col("section") == section, _row(section, "closing_balance", "ledger_name", "rank", parent))


def _report(df: DataFrame) -> DataFrame:
    return df.select("section", "rank", "name", "parent", "amount")


def financial_analysis(ledgers: DataFrame, mode: str = "normalized") -> DataFrame:
    """P&L account found -> its card and top 5 business parties; otherwise the
    financial position (F2) with the 3 largest and 3 smallest balances. Long format
    (section, rank, name, parent, amount)."""
    wide, closing = FL.business_wide(mode), F.col("closing_balance")
    lists = _first_of(ledgers, {
        "pnl": (FL.name_contains(FL.PNL_PATTERN, mode), None, 1), "top_party": (FL.business(mode), -closing, 5),
        "top_asset": (wide, -closing, 3), "top_liability": (wide, closing, 3)})
    rows = _rows(lists, *_card(), _listed("top_party"), _listed("top_asset", None), _listed("top_liability", None))
    sums = _rows(net_position(ledgers, mode), *[_row(c, c) for c in ("assets", "liabilities", "net_position")])
    rows = rows.unionByName(sums)
    with_pnl = F.col("section").isin("pnl_closing", "pnl_opening", "net_profit", "top_party")
    return _report(rows.withColumn("found", _if_any(rows, "pnl_closing")).where(F.col("found") == with_pnl))


def trend_snapshot(ledgers: DataFrame, mode: str = "normalized") -> DataFrame:
    """Count and net closing of all ledgers, top/bottom 5 business ledgers;
    a single 'no_dates' row when no ledger has a date."""
    closing = F.col("closing_balance")
    lists = _first_of(ledgers, {"top_positive": (FL.business(mode), -closing, 5), "top_negative": (FL.business(mode), closing, 5)})
    rows = _rows(lists, _listed("top_positive"), _listed("top_negative"))
    sums = _rows(trend_totals(ledgers), _row("total_parties", "total_parties"), _row("net_balance", "net_balance"),
                 F.when(~F.col("has_dates"), _row("no_dates", None)))
    rows = rows.unionByName(sums)
    none = _if_any(rows, "no_dates")
    return _report(rows.withColumn("none", none).where(F.col("none") == (F.col("section") == "no_dates")))


def business_summary(ledgers: DataFrame, mode: str = "normalized") -> DataFrame:
    """A2 stats, top 5 groups (A3), 5 most recently altered ledgers (T3). Group
    totals and those of all ledgers come from the same grouping sets."""
    whole, rest = exact_sum("closing_balance")
    sets = ledgers.groupingSets([["parent"], []], "parent").agg(
        F.grouping_id().alias("all"), F.count(F.lit(1)).alias("n"), whole.alias("whole"), rest.alias("rest"),
        F.max("closing_balance").alias("max_balance"), F.min("closing_balance").alias("min_balance"))
    sets = sets.select("parent", "all", "n", joined(F.col("whole"), F.col("rest")).alias("total"), "max_balance", "min_balance")
    # an empty table has no grouping set, but a report of zeros
    none = ledgers.sparkSession.range(1).select(F.struct(
        F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("max_balance"),
        F.lit(None).cast("double").alias("min_balance")).alias("t"))
    whole_row = sets.where(F.col("all") == 1).select(F.struct("n", "total", "max_balance", "min_balance").alias("t"))
    stats = whole_row.unionByName(none).agg(F.max_by("t", "t.n").alias("t")).select("t.*")
    stats = _rows(stats.withColumn("avg", F.when(F.col("n") > 0, F.col("total") / F.col("n"))),
                  _row("total_parties", "n"), _row("total_balance", "total"), _row("avg_balance", "avg"),
                  _row("max_balance", "max_balance"), _row("min_balance", "min_balance"))
    groups = ranked(sets.where((F.col("all") == 0) & FL.business(mode)).select("parent", F.col("total").alias("group_balance")),
                    [F.col("group_balance").desc(), F.col("parent").asc_nulls_first()], 5)
    recent = _first_of(ledgers, {"recent": (FL.has_date(), -F.unix_date("altered_on"), 5)})
    return _report(stats.unionByName(_rows(groups, _row("top_group", "group_balance", "parent", "rank"))).unionByName(
        _rows(recent, _row("recent", "closing_balance", "ledger_name", "rank", F.date_format("altered_on", "yyyy-MM-dd")))))


def party_ranking(ledgers: DataFrame, count: int | None = 10, order: str = "DESC",
                  year: int | None = None, mode: str = "normalized") -> DataFrame:
    """``count`` highest/lowest business parties by closing, optionally only
    ledgers altered in ``year``; if that year has no ledger, the available years
    (A6) are returned instead (section 'available_year')."""
    n = 10 if count is None else count
    base = ledgers if year is None else ledgers.where(FL.year_range(year))
    biz = base.where(FL.business(mode))
    r = top_k(biz, n) if order.upper() != "ASC" else bottom_k(biz, n)
    rows = r.select(F.lit("ranking").alias("section"), F.col("rank").cast("int").alias("rank"),
                    "ledger_name", "closing_balance", "parent", "altered_on")
    if year is None:
        return rows
    empty = base.select(F.count(F.lit(1))).scalar() == 0
    years = available_years(ledgers).select(
        F.lit("available_year").alias("section"), F.col("year").cast("int").alias("rank"),
        F.lit(None).cast("string").alias("ledger_name"),
        F.lit(None).cast("double").alias("closing_balance"),
        F.lit(None).cast("string").alias("parent"), F.lit(None).cast("date").alias("altered_on"))
    return rows.where(~empty).unionByName(years.where(empty))


def pnl_report(ledgers: DataFrame, mode: str = "normalized") -> DataFrame:
    """First ledger containing 'Profit' (card) and top 5 parties outside
    the narrow exclusion list (F3)."""
    lists = _first_of(ledgers, {"pnl": (FL.name_contains(FL.PNL_QUICK_PATTERN, mode), None, 1),
                                "top_party": (FL.business_narrow(mode), -F.col("closing_balance"), 5)})
    rows = _rows(lists, *_card(), _listed("top_party", None))
    missing = _rows(ledgers.sparkSession.range(1), _row("not_found", None))
    rows = rows.unionByName(missing)
    found = _if_any(rows, "pnl_closing")
    return _report(rows.withColumn("found", found).where(F.col("found") == (F.col("section") != "not_found")))
