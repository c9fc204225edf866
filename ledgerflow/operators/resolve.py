"""Name resolution for many requests at once.

A request is a (req_id, request) row. Matching is case-insensitive; ``contains``
is literal by default. ``regex_matches`` searches as the reference does, with the request
as a regular expression; one that doesn't compile gets a status row.

Per-request "first k" lists use ``row_number() <= k`` (Spark plans a partial
WindowGroupLimit before the shuffle, so a request matching millions of
ledgers ships k rows per task) and counts use a partial/final aggregate;
nothing collects all matches of a request into one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators.regexjoin import planned_patterns, regex_pairs
from ledgerflow.operators.textjoin import contains_pairs
from ledgerflow.session import cut_lineage

LOOKUP_LIST = 10
STATEMENT_LIST = 5
SEARCH_LIST = 15


def contains_matches(requests: DataFrame, ledgers: DataFrame, text_col: str = "ledger_name") -> DataFrame:
    """Every (request row, ledger row) with lower(text_col) containing lower(request)."""
    pairs = contains_pairs(requests, "request", ledgers, text_col)
    r = requests.join(pairs, requests.request == pairs.pattern).drop("pattern")
    return r.join(ledgers, r.text == ledgers[text_col]).drop("text")


def exact_matches(requests: DataFrame, ledgers: DataFrame) -> DataFrame:
    """lower(ledger_name) == lower(request)."""
    r = requests.withColumn("__k", F.lower("request"))
    led = ledgers.withColumn("__k", F.lower("ledger_name"))
    return r.join(led, "__k").drop("__k")


def resolve_exact(requests: DataFrame, ledgers: DataFrame) -> DataFrame:
    """The ledger whose whole name is the request, the first by name if several."""
    return first_k(exact_matches(requests, ledgers), 1).drop("rank")


def resolve_contains(requests: DataFrame, ledgers: DataFrame) -> DataFrame:
    """J3 by itself: matches inside names, for every request; a request that is some
    ledger's whole name has them too (``resolve_status`` puts the whole name first)."""
    return contains_matches(requests, ledgers)


def first_k(matches: DataFrame, k: int, order: list[str] | None = None) -> DataFrame:
    """First k matches per request, numbered."""
    w = Window.partitionBy("req_id").orderBy(*(order or ["ledger_name"]))
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("req_id").agg(F.count(F.lit(1)).alias("n_matches"))


def status_col(n: str = "n_matches"):
    """0 -> not_found, 1 -> resolved, >1 -> clarification."""
    c = F.coalesce(F.col(n), F.lit(0))
    return (F.when(c == 0, F.lit("not_found")).when(c == 1, F.lit("resolved"))
            .otherwise(F.lit("clarification")))


def resolve_status(requests: DataFrame, ledgers: DataFrame, k: int = STATEMENT_LIST) -> DataFrame:
    """J4 over J2 and J3: one row per request: status, n_matches, resolved name (when
    unique), and the first k names joined by '; ' (bounded by k). A request that is
    some ledger's whole name resolves to that ledger (the first by name); only the
    others are looked for inside names. Alike names count once."""
    names = ledgers.select("ledger_name").distinct()
    exact = (exact_matches(requests, names).groupBy("req_id").agg(F.min("ledger_name").alias("ledger_name")))
    rest = requests.join(exact, "req_id", "left_anti")
    m = exact.unionByName(contains_matches(rest, names).select("req_id", "ledger_name"))
    cnt = match_counts(m)
    head = (first_k(m, k).groupBy("req_id")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "ledger_name"))).alias("h"))
            .select("req_id", F.col("h.ledger_name").alias("options")))
    out = requests.join(cnt, "req_id", "left").join(head, "req_id", "left")
    return out.select(
        "req_id", "request", F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        status_col().alias("status"),
        F.when(F.col("n_matches") == 1, F.col("options").getItem(0)).alias("resolved_name"),
        F.coalesce(F.array_join("options", "; "), F.lit("")).alias("options"))


def regex_matches(requests: DataFrame, ledgers: DataFrame, text_col: str = "ledger_name") -> tuple[DataFrame, DataFrame]:
    """J3 in regex mode: every (request row, ledger row) where the request is found as a
    regular expression, any case; and (req_id, request, error) of the requests that are
    none."""
    planned, pairs = regex_plan(requests, ledgers, text_col)
    r = requests.join(pairs, requests.request == pairs.pattern).drop("pattern")
    return r.join(ledgers, r.text == ledgers[text_col]).drop("text"), bad_patterns(requests, planned)


def regex_plan(requests: DataFrame, ledgers: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The planned distinct requests, and their distinct (pattern, text) pairs."""
    planned = planned_patterns(requests, "request")
    return planned, regex_pairs(planned, ledgers, text_col)


def bad_patterns(requests: DataFrame, planned: DataFrame) -> DataFrame:
    """(req_id, request, error) of the requests that are no regular expression."""
    bad = planned.where("error is not null").select("pattern", "error").hint("merge")
    return requests.join(bad, requests.request == bad.pattern).select("req_id", "request", "error")


def regex_status(requests: DataFrame, ledgers: DataFrame) -> DataFrame:
    """J4 in regex mode: (req_id, request, status, n_matches, first_match, error); status is
    found, not_found or bad_pattern."""
    planned, pairs = regex_plan(requests, ledgers, "ledger_name")
    # hits are counted per distinct pattern, never listed per request; requests are made by
    # explode, whose rows no estimate sees: merge joins keep them out of the driver
    copies = ledgers.groupBy(F.col("ledger_name").alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    each = pairs.join(copies.hint("merge"), "text").groupBy("pattern").agg(F.sum("copies").alias("n"), F.min("text").alias("one"))
    per = (requests.join(each.hint("merge"), F.col("request") == F.col("pattern")).groupBy("req_id")
           .agg(F.sum("n").alias("n_matches"), F.min("one").alias("first_match")))
    bad = bad_patterns(requests, planned)
    out = requests.join(per, "req_id", "left").join(bad.select("req_id", "error"), "req_id", "left")
    status = (F.when(F.col("error").isNotNull(), F.lit("bad_pattern")).when(F.col("n_matches") > 0, F.lit("found"))
              .otherwise(F.lit("not_found")))
    return out.select("req_id", "request", status.alias("status"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
                      "first_match", "error")


def did_you_mean(requests: DataFrame, ledgers: DataFrame, k: int = STATEMENT_LIST, missed_only: bool = True) -> DataFrame:
    """Distinct ledger names that hold the request as it is written, first k per
    request: for every request, or (``missed_only``) where the regex search finds nothing.
    A request that is no regular expression is an error there, not a search without a hit.

    The first k are taken per distinct text, so a text that many requests share lists
    its names once."""
    names = ledgers.select("ledger_name").distinct()
    asked = requests.select("req_id", "request").distinct()
    if missed_only:
        hits, bad = regex_matches(requests, names)
        asked = asked.join(hits.select("req_id").unionByName(bad.select("req_id")).distinct(), "req_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("pattern").orderBy("text"))
    heads = (contains_pairs(asked, "request", names, "ledger_name").withColumn("place", place)
             .where(F.col("place") <= k).select("pattern", F.col("text").alias("ledger_name")))
    found = asked.join(heads, F.col("request") == F.col("pattern")).drop("pattern")
    return first_k(found, k, ["ledger_name", "request"]).select("req_id", "request", "rank", "ledger_name")


def stored_matches(requests: DataFrame, ledgers: DataFrame) -> DataFrame:
    """J3 once for all lookups of a batch: the (request row, ledger row) matches, in the
    shared checkpoint folder."""
    return cut_lineage(contains_matches(requests, ledgers))


def _lookup(requests: DataFrame, ledgers: DataFrame, k: int, matches: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """First k matches with their count, and the requests without one. Counts and heads
    read the matches, so they are stored unless given."""
    m = stored_matches(requests, ledgers) if matches is None else matches
    cnt = match_counts(m)
    top = first_k(m, k).join(cnt, "req_id")
    nf = requests.join(cnt, "req_id", "left_anti")
    return top, nf


def _ledger_cols(df: DataFrame) -> list:
    return ["ledger_name", "parent", "opening_balance", "closing_balance", "altered_on"]


def balance_lookup(requests: DataFrame, ledgers: DataFrame, balance_type: str | None = None,
                   k: int = LOOKUP_LIST, matches: DataFrame | None = None) -> DataFrame:
    """Per request the matching ledger's balance; several matches -> first k
    (clarification); none -> a not_found row. ``balance_type`` per request comes
    from a column of that name when present, else the argument (default closing)."""
    top, nf = _lookup(requests, ledgers, k, matches)
    bt = (F.col("balance_type") if "balance_type" in requests.columns
          else F.lit(balance_type or "closing"))
    bt = F.coalesce(bt, F.lit("closing"))
    found = top.select(
        "req_id", "request", "n_matches", status_col().alias("status"), "rank",
        *_ledger_cols(top), bt.alias("balance_type"),
        F.when(bt == "opening", F.col("opening_balance")).otherwise(F.col("closing_balance"))
        .alias("balance"))
    missing = nf.select(
        "req_id", "request", F.lit(0).cast("long").alias("n_matches"),
        F.lit("not_found").alias("status"), F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast("string").alias("ledger_name"), F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("double").alias("opening_balance"),
        F.lit(None).cast("double").alias("closing_balance"),
        F.lit(None).cast("date").alias("altered_on"), bt.alias("balance_type"),
        F.lit(None).cast("double").alias("balance"))
    return found.unionByName(missing)


def parent_lookup(requests: DataFrame, ledgers: DataFrame, k: int = LOOKUP_LIST,
                  matches: DataFrame | None = None) -> DataFrame:
    """Group, closing and opening per request (first k when several)."""
    top, nf = _lookup(requests, ledgers, k, matches)
    found = top.select("req_id", "request", "n_matches", status_col().alias("status"), "rank",
                       "ledger_name", "parent", "closing_balance", "opening_balance")
    missing = nf.select(
        "req_id", "request", F.lit(0).cast("long").alias("n_matches"),
        F.lit("not_found").alias("status"), F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast("string").alias("ledger_name"), F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("double").alias("closing_balance"),
        F.lit(None).cast("double").alias("opening_balance"))
    return found.unionByName(missing)


def compare_lookup(requests: DataFrame, ledgers: DataFrame, k: int = LOOKUP_LIST,
                   matches: DataFrame | None = None) -> DataFrame:
    """One match -> full card; several -> first k and how many more."""
    top, nf = _lookup(requests, ledgers, k, matches)
    found = top.select("req_id", "request", "n_matches", status_col().alias("status"), "rank",
                       *_ledger_cols(top),
                       F.greatest(F.col("n_matches") - F.lit(k), F.lit(0)).alias("more"))
    missing = nf.select(
        "req_id", "request", F.lit(0).cast("long").alias("n_matches"),
        F.lit("not_found").alias("status"), F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast("string").alias("ledger_name"), F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("double").alias("opening_balance"),
        F.lit(None).cast("double").alias("closing_balance"),
        F.lit(None).cast("date").alias("altered_on"), F.lit(0).cast("long").alias("more"))
    return found.unionByName(missing)


def search_hits(requests: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Every ledger whose name or parent contains the request, whole-row
    duplicates removed; a row hit by both counts once, as a name hit
    (hit_rank 0 = name, 1 = parent)."""
    cols = _ledger_cols(ledgers)
    by_name = contains_matches(requests, ledgers, "ledger_name").withColumn("hit_rank", F.lit(0))
    by_parent = contains_matches(requests, ledgers, "parent").withColumn("hit_rank", F.lit(1))
    return (by_name.unionByName(by_parent)
            .groupBy("req_id", "request", *cols).agg(F.min("hit_rank").alias("hit_rank")))


def search_groups(requests: DataFrame, ledgers: DataFrame) -> DataFrame:
    """(req_id, request, parent): the groups whose name contains the request. A hit on a
    group stands for all its ledgers, which are not listed."""
    pairs = contains_pairs(requests, "request", ledgers, "parent")
    return requests.join(pairs, requests.request == pairs.pattern).select("req_id", "request", F.col("text").alias("parent"))


def ledger_search(requests: DataFrame, ledgers: DataFrame, k: int = SEARCH_LIST) -> DataFrame:
    """Ledgers whose name or group contains the request (U1), name hits first, first
    k per request plus the total count; requests without a hit get a not_found row.

    Group hits are counted by group size and never listed: of a hit group only its first
    2k - 1 ledgers are candidates, enough for k places after at most k - 1 name hits.
    """
    cols = _ledger_cols(ledgers)
    order = ["ledger_name", "parent", "opening_balance", "closing_balance", "altered_on"]
    rows = ledgers.select(*cols).distinct()
    by_name = cut_lineage(contains_matches(requests.select("req_id", "request"), rows))
    groups = cut_lineage(search_groups(requests, rows))
    sizes = rows.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("size"))
    in_both = F.coalesce(F.contains(F.lower("parent"), F.lower("request")), F.lit(False))
    counts = (by_name.select("req_id", F.when(in_both, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n"))
              .unionByName(groups.join(sizes, "parent").select("req_id", F.col("size").alias("n")))
              .groupBy("req_id").agg(F.sum("n").alias("n_matches")))
    place = F.row_number().over(Window.partitionBy("parent").orderBy(*order))
    heads = rows.where(F.col("parent").isNotNull()).withColumn("place", place).where(F.col("place") < 2 * k).drop("place")
    by_group = (groups.join(heads, "parent")
                .where(~F.coalesce(F.contains(F.lower("ledger_name"), F.lower("request")), F.lit(False))))
    both = by_name.withColumn("hit_rank", F.lit(0)).unionByName(by_group.withColumn("hit_rank", F.lit(1)))
    top = first_k(both, k, ["hit_rank", *order]).join(counts, "req_id")
    found = top.select("req_id", "request", "n_matches", F.lit("found").alias("status"), "rank",
                       "hit_rank", *cols)
    nf = requests.join(counts, "req_id", "left_anti")
    missing = nf.select(
        "req_id", "request", F.lit(0).cast("long").alias("n_matches"),
        F.lit("not_found").alias("status"), F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast("int").alias("hit_rank"),
        F.lit(None).cast("string").alias("ledger_name"), F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("double").alias("opening_balance"),
        F.lit(None).cast("double").alias("closing_balance"),
        F.lit(None).cast("date").alias("altered_on"))
    return found.unionByName(missing)
