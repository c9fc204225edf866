"""Answering a batch of questions.

Every question is routed (N3 -> N1/N2) and then answered by the set-based
reports: global reports are computed once and joined by route (a table of at
most one row per route), lookups are resolved for the *distinct* extracted
names with the q-gram contains join, statements/receivables are computed only
for the resolved ledgers (semi-join first). One row per question:
q_id, question, route, status, ledger, n_rows, answer (the report's text on the routes
of a global report; ``answer_rows`` has the rows of every route).

Status: answered | clarification | not_found | prompt | help | no_data.
Deviations: a ranking question without a number uses 10 (the reference raised
a TypeError); statement/BR questions use the FY given to the job (the
reference used the current FY of the wall clock).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators import filters as FL
from ledgerflow.operators import receivable as RV
from ledgerflow.operators import reports as RP
from ledgerflow.operators import resolve as RS
from ledgerflow.operators import statement as ST
from ledgerflow.plans.questions import routed
from ledgerflow.session import cut_lineage

LOOKUP_ROUTES = ["balance_query", "parent_query", "comparative_analysis"]
NAME_ROUTES = LOOKUP_ROUTES + ["search_query", "statement_query", "br_query"]
GLOBAL_ROUTES = ["financial_analysis", "pending_analysis", "trend_analysis", "summary_report", "pnl_report"]


def _report_lines(df: DataFrame, route: str) -> DataFrame:
    return df.select(F.lit(route).alias("route"), "section", F.col("rank").cast("int").alias("rank"), "name", "parent",
                     F.col("amount").cast("double").alias("amount"))


def global_answers(ledgers: DataFrame) -> DataFrame:
    """(route, n_rows, answer): each global report, built once. ``answer`` is its text, a
    line for each row (bounded: some twenty lines); ``n_rows`` counts its rows, for the
    pending list those of all its pages, which the text gives as the reference does: the
    totals over all pending parties and the first page."""
    pending = RP.pending_report(ledgers)
    line = F.struct(F.lit("pending").alias("section"), F.col("rank").cast("int").alias("rank"),
                    F.col("ledger_name").alias("name"), "parent", F.col("closing_balance").alias("amount"))
    total = lambda c: F.when(F.col("total_pending") > 0, F.struct(
        F.lit(c).alias("section"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("parent"), F.col(c).cast("double").alias("amount")))
    totals = pending.select("total_pending", "total_amount", "avg_pending").limit(1).select(F.explode(F.filter(
        F.array(*[total(c) for c in ("total_pending", "total_amount", "avg_pending")]), lambda x: x.isNotNull())).alias("r"))
    rows = (_report_lines(RP.financial_analysis(ledgers), "financial_analysis")
            .unionByName(_report_lines(pending.select(line.alias("r")).unionByName(totals).select("r.*"), "pending_analysis"))
            .unionByName(_report_lines(RP.trend_snapshot(ledgers), "trend_analysis"))
            .unionByName(_report_lines(RP.business_summary(ledgers), "summary_report"))
            .unionByName(_report_lines(RP.pnl_report(ledgers), "pnl_report")))
    amount = F.when(F.col("amount").isNotNull(), F.format_string("%.2f", F.bround("amount", 2)))
    text = F.concat_ws(" | ", "section", F.col("rank").cast("string"), "name", "parent", amount)
    lines = F.sort_array(F.collect_list(F.struct("section", "rank", "name", text.alias("text"))))
    reports = rows.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.array_join(lines["text"], "\n").alias("answer"))
    parties = F.greatest(RP.pending_metrics(ledgers).select("total_pending").scalar(), F.lit(1))
    return reports.select("route", F.when(F.col("route") == "pending_analysis", parties).otherwise(F.col("n")).alias("n_rows"),
                          "answer")


def ranking_counts(ledgers: DataFrame) -> DataFrame:
    """Per altered_on year (null = all years): ledgers, business ledgers; plus the
    number of distinct years (for the 'no data for year' answer)."""
    biz = FL.business()
    per_year = ledgers.groupBy(F.year("altered_on").alias("year")).agg(
        F.count(F.lit(1)).alias("n_all"), F.count(F.when(biz, F.lit(1))).alias("n_biz"))
    total = ledgers.agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(biz, F.lit(1))).alias("n_biz"))
    return per_year.where(F.col("year").isNotNull()), total


def route_table(questions: DataFrame) -> DataFrame:
    """The routed questions with the parameters the answers need."""
    return routed(questions).select(
        "q_id", "question", "route", "command",
        F.col("params.ledger_name").alias("name"), F.col("params.count").alias("count"),
        F.col("params.year").alias("year"), F.col("params.balance_type").alias("balance_type"),
        F.col("params.order").alias("order"))


def answer_questions(questions: DataFrame, ledgers: DataFrame, entries: DataFrame, fy: str,
                     routed_table: DataFrame | None = None) -> DataFrame:
    # routing/extraction is regex-heavy and feeds every branch below: it is
    # computed once into the shared checkpoint folder (or given, already stored)
    r = routed_table if routed_table is not None else cut_lineage(route_table(questions))
    led = ST.unique_ledgers(ledgers)
    has_name = F.col("name").isNotNull() & (F.length("name") > 0)

    # lookups: resolve each distinct extracted name once
    names = (r.where(F.col("route").isin(NAME_ROUTES) & has_name)
             .select(F.col("name").alias("request")).distinct()
             .withColumn("req_id", F.col("request")))
    # (name, ledger) pairs by name and by parent, computed once (they feed the
    # counts, the first match and the search counts)
    hits = cut_lineage(
        RS.contains_matches(names, led).select("req_id", "ledger_name", F.lit(0).alias("by_parent"))
        .unionByName(RS.contains_matches(names, led, "parent")
                     .select("req_id", "ledger_name", F.lit(1).alias("by_parent"))))
    m = hits.where(F.col("by_parent") == 0)
    per_name = m.groupBy("req_id").agg(F.count(F.lit(1)).alias("n_matches"),
                                       F.min("ledger_name").alias("first_name"))
    search = (hits.select("req_id", "ledger_name").distinct()
              .groupBy("req_id").agg(F.count(F.lit(1)).alias("n_search")))

    # statements / receivables only for the resolved ledgers of those routes
    resolved = (r.where(F.col("route").isin("statement_query", "br_query") & has_name)
                .join(per_name, F.col("name") == F.col("req_id"))
                .select(F.col("first_name").alias("ledger_name")).distinct())
    led_r = led.join(resolved, "ledger_name", "left_semi")
    tx = ST.party_fy_transactions(led_r, entries, fy)
    st_rows = tx.groupBy("ledger_name").agg((F.count(F.lit(1)) + 2).alias("st_rows"))
    br_rows = RV.bills_receivable(led_r, entries, fy, led).groupBy("ledger_name") \
        .agg(F.count(F.lit(1)).alias("br_rows"))

    g = global_answers(ledgers)
    per_year, total = ranking_counts(ledgers)
    n_years = per_year.select(F.count(F.lit(1))).scalar()

    a = (r.join(per_name, F.col("name") == F.col("req_id"), "left").drop("req_id")
         .join(search.withColumnRenamed("req_id", "s_req"), F.col("name") == F.col("s_req"), "left").drop("s_req")
         .join(st_rows.withColumnRenamed("ledger_name", "st_l"), F.col("first_name") == F.col("st_l"), "left")
         .join(br_rows.withColumnRenamed("ledger_name", "br_l"), F.col("first_name") == F.col("br_l"), "left")
         .join(F.broadcast(g.withColumnRenamed("route", "g_route")), F.col("route") == F.col("g_route"), "left")
         .join(F.broadcast(per_year.withColumnRenamed("year", "y")), F.col("year") == F.col("y"), "left"))
    n = F.coalesce(F.col("n_matches"), F.lit(0))
    cnt = F.coalesce(F.col("count"), F.lit(10))
    rk_all = F.coalesce(F.col("y_n_all"), F.lit(0))
    rk_biz = F.when(F.col("year").isNull(), total.select("n_biz").scalar()).otherwise(
        F.coalesce(F.col("y_n_biz"), F.lit(0)))
    a = a.withColumnRenamed("n_all", "y_n_all").withColumnRenamed("n_biz", "y_n_biz")
    route = F.col("route")
    status = (
        F.when(route.isin("balance_prompt", "parent_prompt"), F.lit("prompt"))
        .when(route == "general_query", F.lit("help"))
        .when(route.isin(GLOBAL_ROUTES), F.lit("answered"))
        .when(route == "ranking_query",
              F.when(F.col("year").isNotNull() & (rk_all == 0), F.lit("no_data")).otherwise(F.lit("answered")))
        .when(~has_name, F.lit("clarification"))
        .when(route == "search_query",
              F.when(F.coalesce(F.col("n_search"), F.lit(0)) == 0, F.lit("not_found")).otherwise(F.lit("answered")))
        .when(n == 0, F.lit("not_found"))
        .when(route.isin(LOOKUP_ROUTES),
              F.when(n == 1, F.lit("answered")).otherwise(F.lit("clarification")))
        .when(route == "br_query",
              F.when(F.coalesce(F.col("br_rows"), F.lit(0)) == 0, F.lit("no_data")).otherwise(F.lit("answered")))
        .otherwise(F.lit("answered")))
    n_rows = (
        F.when(route.isin("balance_prompt", "parent_prompt", "general_query"), F.lit(0))
        .when(route.isin(GLOBAL_ROUTES), F.col("n_rows"))
        .when(route == "ranking_query",
              F.when(F.col("year").isNotNull() & (rk_all == 0), n_years).otherwise(F.least(cnt, rk_biz)))
        .when(~has_name, F.lit(0))
        .when(route == "search_query", F.least(F.coalesce(F.col("n_search"), F.lit(0)), F.lit(RS.SEARCH_LIST)))
        .when(route.isin(LOOKUP_ROUTES), F.least(n, F.lit(RS.LOOKUP_LIST)))
        .when(n == 0, F.lit(0))
        .when(route == "statement_query", F.coalesce(F.col("st_rows"), F.lit(2)))
        .otherwise(F.coalesce(F.col("br_rows"), F.lit(0))))
    ledger = F.when(route.isin(NAME_ROUTES) & has_name & (n > 0) &
                    (route.isin("statement_query", "br_query") | (n == 1)), F.col("first_name"))
    return a.select("q_id", "question", "route", status.alias("status"), ledger.alias("ledger"),
                    n_rows.cast("long").alias("n_rows"), "answer")


RESOLVE_MODES = ("first", "unique")


def _requested(questions: DataFrame, route: str, routed_table: DataFrame | None) -> DataFrame:
    """(q_id, request) of one route's questions; request is null where no name was given."""
    rt = routed_table if routed_table is not None else route_table(questions)
    name = F.when(F.length("name") > 0, F.col("name"))
    return rt.where(F.col("route") == route).select("q_id", name.alias("request"))


def resolved_requests(requested: DataFrame, ledgers: DataFrame, mode: str = "first",
                      k: int = RS.STATEMENT_LIST) -> DataFrame:
    """(q_id, request, status, ledger_name, n_matches, options) for every question.

    ``first`` takes the first ledger by name that contains the request, as question
    batches do; ``unique`` takes the ledger named so, else the only one that contains
    the request, and asks back (status ``clarification``, first k names as ``options``)
    when several do. No name at all: ``clarification``; no ledger: ``not_found``.
    Each distinct request is resolved once; questions without a name join nothing.
    """
    if mode not in RESOLVE_MODES:
        raise ValueError(f"mode is one of {RESOLVE_MODES}")
    named = requested.where(F.col("request").isNotNull())
    names = named.select("request").distinct().withColumn("req_id", F.col("request"))
    if mode == "unique":
        per = RS.resolve_status(names, ledgers, k).select(
            "req_id", F.when(F.col("status") == "resolved", F.lit("answered")).otherwise(F.col("status")).alias("status"),
            F.col("resolved_name").alias("ledger_name"), "n_matches", "options")
    else:
        hits = RS.contains_matches(names, ledgers).groupBy("req_id").agg(
            F.min("ledger_name").alias("ledger_name"), F.count(F.lit(1)).alias("n_matches"))
        per = names.select("req_id").join(hits, "req_id", "left").select(
            "req_id", F.when(F.col("ledger_name").isNull(), F.lit("not_found")).otherwise(F.lit("answered")).alias("status"),
            "ledger_name", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.lit("").alias("options"))
    found = named.join(per, F.col("request") == F.col("req_id")).drop("req_id")
    unnamed = requested.where(F.col("request").isNull()).select(
        "q_id", "request", F.lit("clarification").alias("status"), F.lit(None).cast("string").alias("ledger_name"),
        F.lit(0).cast("long").alias("n_matches"), F.lit("").alias("options"))
    return found.unionByName(unnamed)


def _requested_report(resolved: DataFrame, report: DataFrame) -> DataFrame:
    """Report rows of the ledgers that questions resolved to, one per (question, row)."""
    return resolved.where(F.col("ledger_name").isNotNull()).select("q_id", "ledger_name").join(report, "ledger_name")


def statement_requests(questions: DataFrame, ledgers: DataFrame, entries: DataFrame, fy: str,
                       routed_table: DataFrame | None = None, mode: str = "first") -> DataFrame:
    """Statement questions -> R1 rows of the resolved ledger for ``fy``; one row per
    (question, statement row). ``request_status`` has the questions without one."""
    led = ST.unique_ledgers(ledgers)
    resolved = cut_lineage(resolved_requests(_requested(questions, "statement_query", routed_table), led, mode))
    wanted = resolved.select("ledger_name").distinct()
    return _requested_report(resolved, ST.fy_statement(led.join(wanted, "ledger_name", "left_semi"), entries, fy))


def br_requests(questions: DataFrame, ledgers: DataFrame, entries: DataFrame, fy: str,
                routed_table: DataFrame | None = None, mode: str = "first") -> DataFrame:
    """R13 (BR side): BR questions -> every R2 row of the resolved ledger: all its invoices of
    the year, or all debtors of the whole table whose name contains the ledger's."""
    led = ST.unique_ledgers(ledgers)
    resolved = cut_lineage(resolved_requests(_requested(questions, "br_query", routed_table), led, mode))
    wanted = resolved.select("ledger_name").distinct()
    return _requested_report(resolved, RV.bills_receivable(
        led.join(wanted, "ledger_name", "left_semi"), entries, fy, led, whole=True))


def request_status(questions: DataFrame, ledgers: DataFrame, routed_table: DataFrame | None = None,
                   mode: str = "unique") -> DataFrame:
    """What becomes of every statement and BR question: (q_id, route, request, status,
    ledger_name, n_matches, options)."""
    led = ST.unique_ledgers(ledgers)
    routes = ("statement_query", "br_query")
    rt = routed_table if routed_table is not None else cut_lineage(route_table(questions))
    each = [resolved_requests(_requested(questions, x, rt), led, mode).withColumn("route", F.lit(x)) for x in routes]
    return each[0].unionByName(each[1]).select("q_id", "route", "request", "status", "ledger_name", "n_matches", "options")


# ---------------------------------------------------------------------------
# answer rows

def _variant(*cols) -> F.Column:
    return F.to_variant_object(F.struct(*cols))


def _rows(df: DataFrame, route: str, status, seq, *cols) -> DataFrame:
    status = F.lit(status) if isinstance(status, str) else status
    return df.select("q_id", F.lit(route).alias("route"), status.alias("status"),
                     F.coalesce(seq, F.lit(0)).cast("long").alias("seq"), _variant(*cols).alias("row"))


def _status_rows(df: DataFrame, route: str, status: str, *cols) -> DataFrame:
    return _rows(df, route, status, F.lit(0), F.lit(status).alias("section"), *cols)


def global_rows(ledgers: DataFrame) -> DataFrame:
    """(route, seq, row): the rows of the reports that no question parameter changes.
    At most some twenty rows a report, numbered by section and rank."""
    tables = {"financial_analysis": RP.financial_analysis(ledgers), "trend_analysis": RP.trend_snapshot(ledgers),
              "summary_report": RP.business_summary(ledgers), "pnl_report": RP.pnl_report(ledgers),
              "pending_analysis": RP.pending_report(ledgers).select(
                  F.lit("pending").alias("section"), F.col("rank").cast("int").alias("rank"),
                  F.col("ledger_name").alias("name"), "parent", F.col("closing_balance").alias("amount"))}
    rows = None
    for route, df in tables.items():
        one = df.select(F.lit(route).alias("route"), "section", "rank", "name", "parent", "amount")
        rows = one if rows is None else rows.unionByName(one)
    seq = F.row_number().over(Window.partitionBy("route").orderBy("section", "rank", "name"))
    return rows.select("route", seq.alias("seq"), _variant("section", "rank", "name", "parent", "amount").alias("row"))


MAX_COUNT = 1000  # the largest number a question's count can be (see extract_params)
DEFAULT_COUNT = 10


def ranking_rows(asked: DataFrame, ledgers: DataFrame) -> DataFrame:
    """R7 for many (q_id, count, order, year): every year's first and last business ledgers
    are numbered once, as many as the largest count, and each question takes its head.
    A year without ledgers answers with the years there are."""
    year = F.coalesce(F.year("altered_on"), F.lit(0))
    biz = FL.business()
    each = ledgers.select("ledger_name", "closing_balance", "parent", "altered_on", year.alias("y"), biz.alias("biz"))
    scoped = each.where("y > 0").unionByName(each.withColumn("y", F.lit(0)))  # 0: all years
    by = {"DESC": [F.desc("closing_balance"), F.asc("ledger_name")], "ASC": [F.asc("closing_balance"), F.asc("ledger_name")]}
    heads = None
    for order, cols in by.items():
        place = F.row_number().over(Window.partitionBy("y").orderBy(*cols))
        one = scoped.where("biz").withColumn("place", place).where(F.col("place") <= MAX_COUNT).withColumn("o", F.lit(order))
        heads = one if heads is None else heads.unionByName(one)
    q = asked.select("q_id", F.coalesce("count", F.lit(DEFAULT_COUNT)).alias("n"), "order",
                     F.coalesce("year", F.lit(0)).alias("year"))
    hit = q.join(heads, (q.year == heads.y) & (q.order == heads.o) & (F.col("place") <= F.col("n")))
    ranked = _rows(hit, "ranking_query", "answered", F.col("place"), F.lit("ranking").alias("section"),
                   F.col("place").alias("rank"), "ledger_name", "closing_balance", "parent",
                   F.date_format("altered_on", "yyyy-MM-dd").alias("altered_on"))
    years = scoped.where("y > 0").select(F.col("y").alias("available")).distinct()
    none = q.where("year > 0").join(years, q.year == years.available, "left_anti")
    # a list of calendar years, the same for every question without a ledger in its year
    listed = years.withColumn("place", F.row_number().over(Window.orderBy("available"))).withColumn("years", F.lit(1))
    other = _rows(none.withColumn("years", F.lit(1)).join(F.broadcast(listed), "years"), "ranking_query", "no_data",
                  F.col("place"), F.lit("available_year").alias("section"), F.col("available").alias("year"))
    return ranked.unionByName(other)


def answer_rows(questions: DataFrame, ledgers: DataFrame, entries: DataFrame, fy: str,
                routed_table: DataFrame | None = None) -> DataFrame:
    """(q_id, route, status, seq, row) - the rows that answer every question, each as a
    VARIANT of its report's columns.

    The routed questions are stored by route, so each route is a branch that reads its
    own folder. Every distinct name is matched once for all lookups; reports are never
    built to be counted. Questions that can't be answered get one row that says why
    (``section`` = status, and names to choose from in ``options``).
    """
    r = routed_table if routed_table is not None else cut_lineage(route_table(questions))
    led = ST.unique_ledgers(ledgers)
    has_name = F.col("name").isNotNull() & (F.length("name") > 0)
    of = lambda route: r.where(F.col("route") == route)
    named = {x: of(x).where(has_name) for x in NAME_ROUTES}

    # lookups: distinct names of the three routes, matched once
    asked = None
    for x in LOOKUP_ROUTES:
        one = named[x].select(F.col("name").alias("request"))
        asked = one if asked is None else asked.unionByName(one)
    names = asked.distinct().withColumn("req_id", F.col("request"))
    matches = RS.stored_matches(names, led)
    answered = F.when(F.col("status") == "resolved", F.lit("answered")).otherwise(F.col("status"))
    out = []
    for x, table in (("balance_query", RS.balance_lookup(names, led, matches=matches).drop("balance", "balance_type")),
                     ("parent_query", RS.parent_lookup(names, led, matches=matches)),
                     ("comparative_analysis", RS.compare_lookup(names, led, matches=matches))):
        q = named[x].select("q_id", "name", "balance_type").join(table.drop("request"), F.col("name") == F.col("req_id"))
        cols = [c for c in table.columns if c not in ("req_id", "request", "status", "altered_on")]
        if x == "balance_query":
            amount = F.when(F.col("balance_type") == "opening", F.col("opening_balance")).otherwise(F.col("closing_balance"))
            cols += ["balance_type", amount.alias("balance")]
        out.append(_rows(q, x, answered, F.col("rank"), F.col("status").alias("section"), F.col("name").alias("request"), *cols))

    search = named["search_query"].select(F.col("name").alias("request")).distinct().withColumn("req_id", F.col("request"))
    hits = RS.ledger_search(search, led).drop("request", "altered_on")
    q = named["search_query"].select("q_id", "name").join(hits, F.col("name") == F.col("req_id"))
    found = F.when(F.col("status") == "found", F.lit("answered")).otherwise(F.col("status"))
    out.append(_rows(q, "search_query", found, F.col("rank"), F.col("status").alias("section"),
                     F.col("name").alias("request"), *[c for c in hits.columns if c not in ("req_id", "status")]))

    out.append(ranking_rows(of("ranking_query").select("q_id", "count", "order", "year"), ledgers))
    report = F.broadcast(global_rows(ledgers))  # some twenty rows for each of five routes
    routes = r.where(F.col("route").isin(GLOBAL_ROUTES)).select("q_id", F.col("route").alias("g_route"))
    out.append(routes.join(report, F.col("g_route") == F.col("route")).select(
        "q_id", "route", F.lit("answered").alias("status"), F.col("seq").cast("long").alias("seq"), "row"))

    # statements and bills: the ledgers that questions resolve to, each reported once
    for x in ("statement_query", "br_query"):
        resolved = cut_lineage(resolved_requests(_requested(questions, x, r), led))
        wanted = led.join(resolved.select("ledger_name").distinct(), "ledger_name", "left_semi")
        rows = cut_lineage(ST.fy_statement(wanted, entries, fy) if x == "statement_query"
                           else RV.bills_receivable(wanted, entries, fy, led))
        text = [F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in rows.dtypes]
        out.append(_rows(_requested_report(resolved, rows), x, "answered", F.col("seq"), *text))
        bare = resolved.where(F.col("ledger_name").isNotNull()).join(
            rows.select("ledger_name").distinct(), "ledger_name", "left_anti")
        out.append(_status_rows(bare, x, "no_data", "ledger_name"))
        for status in ("clarification", "not_found"):
            out.append(_status_rows(resolved.where(F.col("status") == status), x, status, "request", "options"))
    for x in (*LOOKUP_ROUTES, "search_query"):
        out.append(_status_rows(of(x).where(~F.coalesce(has_name, F.lit(False))), x, "clarification"))
    for x, status in (("balance_prompt", "prompt"), ("parent_prompt", "prompt"), ("general_query", "help")):
        out.append(_status_rows(of(x), x, status))
    rows = out[0]
    for one in out[1:]:
        rows = rows.unionByName(one)
    return rows
