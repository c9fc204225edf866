"""Bills receivable for every ledger in one job.

Per ledger and FY (exact party match only, as the reference):
  invoices: the first 10 sales (in the statement's order); each is reduced
  by the party's *total* FY payments (no allocation), due = credit - min(credit,
  payments); rows with due > 0 are listed, 'Outstanding' if due > 0.5 else 'Paid'.
  fallback, only for ledgers without invoice rows: the first 5 debtor-group
  ledgers whose name contains the ledger's normalised name, numbered before the
  closing < 0 test (so numbers/dates have gaps), amount |closing|.

First-k per ledger is ``row_number() <= k`` (partial WindowGroupLimit before
the shuffle); payment totals are a partial/final aggregate. ``whole=True`` lists every
invoice and every debtor instead of the first ones, numbered without bringing a
ledger's rows into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions import fy_bounds
from ledgerflow.functions.numbers import CENTS, money2
from ledgerflow.operators import filters as FL
from ledgerflow.operators.reports import global_rank
from ledgerflow.operators.statement import ORDER, fy_entries, ordered, unique_ledgers
from ledgerflow.operators.textjoin import contains_pairs
from ledgerflow.operators.windows import running_sums
from ledgerflow.session import cut_lineage

# --- fixed values ------------------------------------------------------------------
INVOICES_PER_PARTY = 10
FALLBACK_PER_PARTY = 5
DUE_DAYS = 30
FALLBACK_STEP_DAYS = 15
PAID_TOLERANCE = 0.5
# ------------------------------------------------------------------------------------

def party_entries(ledgers: DataFrame, entries: DataFrame, fy: str) -> DataFrame:
    """J6 (exact key) for the BR report: ledger_name x its FY entries."""
    led = ledgers.select("ledger_name", "name_key")
    e = fy_entries(entries, fy)
    return led.join(e, e.party_key == led.name_key).drop("name_key")


def payments_total(tx: DataFrame) -> DataFrame:
    """FY payment total per ledger (payment vouchers with debit > 0)."""
    return (tx.where(FL.is_payment())
            .groupBy("ledger_name")
            .agg(F.sum(money2("debit_amount")).alias("paid"),
                 F.count(F.lit(1)).alias("n_payments")))


def first_invoices(tx: DataFrame) -> DataFrame:
    """The first 10 sales of every ledger, numbered in the statement's order, in
    which only equal entries tie."""
    w = Window.partitionBy("ledger_name").orderBy(*ORDER)
    return (ordered(tx.where(FL.is_sale()))
            .withColumn("inv_no", F.row_number().over(w))
            .where(F.col("inv_no") <= INVOICES_PER_PARTY).drop("voucher", "entry"))


def all_invoices(tx: DataFrame) -> DataFrame:
    """W3 without the limit: every sale of every ledger, numbered as ``first_invoices`` does."""
    sales = ordered(tx.where(FL.is_sale()))
    return running_sums(sales, ["ledger_name"], ORDER, {"inv_no": F.lit(1).cast("long")}).drop("voucher", "entry")


def invoice_rows(tx: DataFrame, whole: bool = False) -> DataFrame:
    """W3 + J8 + F11: first 10 sales per ledger (``whole``: all) against the party's payment total."""
    sales = all_invoices(tx) if whole else first_invoices(tx)
    pay = payments_total(tx)
    j = sales.join(pay, "ledger_name", "left")
    credit = money2("credit_amount")
    received = F.when(F.col("n_payments") > 0, F.least(credit, F.col("paid"))) \
        .otherwise(F.lit(0).cast(CENTS))
    j = j.withColumn("due", credit - received).where(F.col("due") > 0)
    return j.select(
        "ledger_name",
        F.lit("invoices").alias("source"),
        F.col("inv_no").cast("int").alias("seq"),
        F.col("date").alias("br_date"),
        F.col("voucher_no").alias("br_no"),
        F.col("ledger_name").alias("party"),
        F.bround(F.col("due").cast("double"), 2).alias("amount"),
        F.date_add("date", DUE_DAYS).alias("due_date"),
        F.when(F.col("due") > F.lit(PAID_TOLERANCE), F.lit("Outstanding"))
        .otherwise(F.lit("Paid")).alias("status"),
        F.col("due").alias("due_exact"))


def _first_debtors(without: DataFrame, debtors: DataFrame) -> DataFrame:
    """The first 5 debtors by name for each ledger. They are taken per distinct key: a key
    that many debtors' names contain, or many ledgers share, lists no more."""
    pairs = contains_pairs(without, "name_key", debtors, "debtor")
    place = F.row_number().over(Window.partitionBy("pattern").orderBy("text"))
    heads = pairs.withColumn("place", place).where(F.col("place") <= FALLBACK_PER_PARTY).drop("place")
    m = (without.join(heads, without.name_key == heads.pattern)
         .join(debtors, F.col("text") == F.col("debtor")))
    place = F.row_number().over(Window.partitionBy("ledger_name").orderBy("debtor"))
    return m.withColumn("place", place).where(F.col("place") <= FALLBACK_PER_PARTY)


def _all_debtors(without: DataFrame, debtors: DataFrame) -> DataFrame:
    """Every debtor for each ledger: a debtor's place is its rank among all (ledger, debtor)
    rows less the rows of the ledgers before."""
    pairs = contains_pairs(without, "name_key", debtors, "debtor")
    m = (without.join(pairs, without.name_key == pairs.pattern)
         .join(debtors, F.col("text") == F.col("debtor")))
    ranked = cut_lineage(global_rank(m, [F.col("ledger_name"), F.col("debtor")], "at"))
    start = ranked.groupBy("ledger_name").agg(F.min("at").alias("start"))
    return ranked.join(start, "ledger_name").withColumn("place", F.col("at") - F.col("start") + 1)


def debtor_fallback(ledgers: DataFrame, without: DataFrame, fy: str, whole: bool = False) -> DataFrame:
    """J9 + W5: for ledgers in ``without`` (ledger_name, name_key): debtor ledgers
    whose name contains the ledger's 2-pass normalised name, first 5 by name (``whole``:
    all), numbered, then only closing < 0 kept."""
    start, _, _, _ = fy_bounds(fy)
    debtors = ledgers.where(FL.is_debtor_group()).select(
        F.col("ledger_name").alias("debtor"), F.col("closing_balance").alias("d_closing"))
    m = (_all_debtors if whole else _first_debtors)(without, debtors)
    m = m.withColumn("i", (F.col("place") - 1).cast("int")).where(F.col("d_closing") < 0)
    br_date = F.date_add(F.lit(start).cast("date"), F.col("i") * FALLBACK_STEP_DAYS)
    no = (F.col("i") + 1).cast("string")
    return m.select(
        "ledger_name",
        F.lit("debtors").alias("source"),
        (F.col("i") + 1).cast("int").alias("seq"),
        br_date.alias("br_date"),
        F.concat(F.lit("BR-"), F.when(F.length(no) < 3, F.lpad(no, 3, "0")).otherwise(no)).alias("br_no"),
        F.col("debtor").alias("party"),
        F.bround(F.abs(F.col("d_closing")), 2).alias("amount"),
        F.date_add(br_date, DUE_DAYS).alias("due_date"),
        F.lit("Outstanding").alias("status"),
        money2(F.abs(F.col("d_closing"))).alias("due_exact"))


def bills_receivable(ledgers: DataFrame, entries: DataFrame, fy: str, debtors: DataFrame | None = None,
                     whole: bool = False) -> DataFrame:
    """R2 for all ledgers: ledger_name, financial_year, source, seq, br_date, br_no,
    party, amount, due_date, status, total_br (A10, per ledger).

    The fallback looks for debtors among ``debtors`` (default: the same ledgers), so a
    report on some ledgers finds those of the whole table. ``whole`` lists all invoices
    and all debtors."""
    # each of these feeds several branches, so each is computed once: the ledgers, the
    # sales and payments of the year, and the invoices (at most ten a ledger unless whole)
    led = cut_lineage(unique_ledgers(ledgers).select("ledger_name", "name_key", "parent", "closing_balance"))
    tx = cut_lineage(party_entries(led, entries, fy).where(FL.is_sale() | FL.is_payment()))
    inv = cut_lineage(invoice_rows(tx, whole))
    without = led.select("ledger_name", "name_key").join(
        inv.select("ledger_name").distinct(), "ledger_name", "left_anti")
    fb = debtor_fallback(led if debtors is None else unique_ledgers(debtors), without, fy, whole)
    rows = inv.unionByName(fb)
    if whole:
        rows = cut_lineage(rows)
        rows = rows.join(rows.groupBy("ledger_name").agg(F.sum("due_exact").alias("total_br")), "ledger_name")
    else:
        # a ledger has at most 10 invoice rows or 5 fallback rows, so this window
        # partition is bounded (and spares a second pass over the whole pipeline)
        rows = rows.withColumn("total_br", F.sum("due_exact").over(Window.partitionBy("ledger_name")))
    return rows.select(
        "ledger_name", F.lit(fy).alias("financial_year"), "source", "seq", "br_date", "br_no",
        "party", "amount", "due_date", "status",
        F.col("total_br").cast("double").alias("total_br"))
