"""Financial-year statements for every ledger in one job.

Per ledger and FY: an opening row, every entry of the party in the FY in
(date, voucher, entry) order with a running balance, and a closing row
carrying the stored closing balance (not the computed one; ``reconcile`` compares
the two).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions import fy_bounds, round2
from ledgerflow.functions.numbers import CENTS, money2
from ledgerflow.operators.textjoin import contains_pairs
from ledgerflow.operators.windows import running_sums
from ledgerflow.session import cut_lineage

# --- fixed values: statement row labels ---------------------------------------
OPENING_LABEL, OPENING_NO = "Opening Balance", "OP-001"
CLOSING_LABEL, CLOSING_NO = "Closing Balance", "CL-001"
PARTICULARS_WIDTH = 50
# ---------------------------------------------------------------------------------

#: Voucher numbers repeat across voucher types and branches, so the type, the other leg
#: and the amounts decide too; entries equal in all of it are interchangeable.
ORDER = ["date", "voucher", "entry"]


def ordered(entries: DataFrame) -> DataFrame:
    """Entries with the ``voucher`` and ``entry`` columns of ORDER."""
    return (entries.withColumn("voucher", F.struct("voucher_no", "voucher_type"))
            .withColumn("entry", F.struct("entry_no", "particulars", "debit_amount", "credit_amount")))


def fy_entries(entries: DataFrame, fy: str) -> DataFrame:
    """entries with FY start <= date <= FY end (pushed down to the scan; on a
    stored table partitioned by ``fy`` whole folders are pruned first)."""
    start, end, sy, ey = fy_bounds(fy)
    e = entries
    if "fy" in entries.columns:
        labels = [f"{y}-{y + 1}" for y in range(min(sy, ey - 1), max(sy, ey - 1) + 1)]
        e = e.where(F.col("fy").isin(labels))
    return e.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def unique_ledgers(ledgers: DataFrame) -> DataFrame:
    """One row per normalised ledger name: the first by (raw name, parent, balances).

    The reference resolves a name to the first matching row; ``row_number() = 1``
    keeps at most one row per name and task before the shuffle (WindowGroupLimit),
    so a name that many rows share is no hot key.
    """
    order = [c for c in ("ledger_name_raw", "parent", "opening_balance", "closing_balance") if c in ledgers.columns]
    place = F.row_number().over(Window.partitionBy("ledger_name").orderBy(*(order or ["ledger_name"])))
    return ledgers.withColumn("__place", place).where(F.col("__place") == 1).drop("__place")


def party_fy_transactions(ledgers: DataFrame, entries: DataFrame, fy: str,
                          partial_fallback: bool = True, carry: list[str] | None = None) -> DataFrame:
    """J6 + J7: statement owner ``ledger_name`` x its FY entries, with ``source``.

    J6: entry.party_key == ledger.name_key (2-pass normalised, case-sensitive).
    J7: only for ledgers without a J6 row: party_key contains name_key, any case.
    ``carry``: extra ledger columns to keep on every row (saves a later join of
    the big side back to the ledgers).
    """
    e = fy_entries(entries, fy)
    keep = ["ledger_name", "name_key"] + list(carry or [])
    led = ledgers.select(*keep)
    exact = (led.join(e, e.party_key == led.name_key)
             .drop("name_key").withColumn("source", F.lit("exact")))
    if not partial_fallback:
        return exact
    parties = e.select("party_key").distinct()
    unmatched = led.join(parties, led.name_key == parties.party_key, "left_anti")
    pairs = contains_pairs(unmatched, "name_key", parties, "party_key")
    partial = (unmatched.join(pairs, unmatched.name_key == pairs.pattern)
               .select(*[c for c in keep if c != "name_key"], F.col("text").alias("party_key")))
    partial = (partial.join(e, "party_key")
               .withColumn("source", F.lit("partial")))
    return exact.unionByName(partial)


def fy_statement(ledgers: DataFrame, entries: DataFrame, fy: str,
                 partial_fallback: bool = True) -> DataFrame:
    """R1 for all ledgers: ledger_name, financial_year, seq, date, voucher_type,
    voucher_no, particulars, debit, credit, balance, source."""
    start, end, _, _ = fy_bounds(fy)
    led = unique_ledgers(ledgers).select(
        "ledger_name", "name_key",
        round2("opening_balance").alias("opening"), round2("closing_balance").alias("closing"))
    # the matched rows feed the running sums (three reads) and the row counts:
    # materialise them once in the shared checkpoint folder instead of running
    # the exact/partial matching four times
    tx = cut_lineage(party_fy_transactions(led, entries, fy, partial_fallback, carry=["opening"]))
    delta = money2("debit_amount") - money2("credit_amount")
    rs = running_sums(ordered(tx), ["ledger_name"], ORDER, {"run": delta, "seq": F.lit(1).cast("long")})
    body = (rs
            .select("ledger_name",
                    F.col("seq").cast("int").alias("seq"),
                    "date", "voucher_type", "voucher_no",
                    F.substring("particulars", 1, PARTICULARS_WIDTH).alias("particulars"),
                    round2("debit_amount").alias("debit"),
                    round2("credit_amount").alias("credit"),
                    (money2("opening") + F.col("run")).cast("double").alias("balance"),
                    "source"))
    # source is constant per ledger; an integer code keeps the aggregate hash-based
    counts = (tx.groupBy("ledger_name")
              .agg(F.count(F.lit(1)).alias("n"),
                   F.max(F.when(F.col("source") == "exact", F.lit(2)).otherwise(F.lit(1))).alias("src"))
              .select("ledger_name", "n", F.when(F.col("src") == 2, F.lit("exact"))
                      .otherwise(F.lit("partial")).alias("source")))
    heads = led.join(counts, "ledger_name", "left").select(
        "ledger_name", "opening", "closing",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("source", F.lit("none")).alias("source"))
    opening = heads.select(
        "ledger_name", F.lit(0).alias("seq"), F.lit(start).cast("date").alias("date"),
        F.lit(OPENING_LABEL).alias("voucher_type"), F.lit(OPENING_NO).alias("voucher_no"),
        F.lit(OPENING_LABEL).alias("particulars"), F.lit(0.0).alias("debit"),
        F.when(F.col("opening") > 0, F.col("opening")).otherwise(F.lit(0.0)).alias("credit"),
        F.col("opening").alias("balance"), "source")
    closing = heads.select(
        "ledger_name", (F.col("n") + 1).cast("int").alias("seq"),
        F.lit(end).cast("date").alias("date"),
        F.lit(CLOSING_LABEL).alias("voucher_type"), F.lit(CLOSING_NO).alias("voucher_no"),
        F.lit(CLOSING_LABEL).alias("particulars"), F.lit(0.0).alias("debit"),
        F.col("closing").alias("credit"), F.col("closing").alias("balance"), "source")
    out = opening.unionByName(body).unionByName(closing)
    return out.select("ledger_name", F.lit(fy).alias("financial_year"), "seq", "date",
                      "voucher_type", "voucher_no", "particulars", "debit", "credit",
                      "balance", "source")


def reconcile(ledgers: DataFrame, entries: DataFrame, fy: str | None = None) -> DataFrame:
    """Opening + sum(debit - credit) of the party's entries vs stored closing.

    ``fy=None`` reconciles over the full history (where the binding guarantees
    drift 0); with a FY it reconciles the FY slice as the reference's statement
    would. Exact join on the 2-pass key; one aggregate per party (partial
    aggregation before the shuffle, so a hot party costs one row per task). A
    ledger without entries has flow 0.
    """
    e = entries if fy is None else fy_entries(entries, fy)
    flow = e.groupBy("party_key").agg(
        F.sum(money2("debit_amount") - money2("credit_amount")).alias("flow"),
        F.count(F.lit(1)).alias("n_entries"))
    led = unique_ledgers(ledgers)
    j = led.join(flow, led.name_key == flow.party_key, "left").withColumns(
        {"flow": F.coalesce("flow", F.lit(0).cast(CENTS)), "n_entries": F.coalesce("n_entries", F.lit(0))})
    computed = money2(round2("opening_balance")) + F.col("flow")
    stored = money2(round2("closing_balance"))
    return j.select(
        "ledger_name",
        "n_entries",
        computed.cast("double").alias("computed_closing"),
        round2("closing_balance").alias("stored_closing"),
        (computed - stored).cast("double").alias("drift"),
        (computed == stored).alias("ok"))
