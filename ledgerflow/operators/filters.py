"""Filters and predicates (F1-F12). Each returns a Column or a filtered DataFrame;
all are plain predicates Catalyst can push into the parquet scan.

Group-list matching has two modes (SURVEY Q2):
  ``normalized`` (default): the exclusion list goes through the same normaliser
      as the stored ``parent`` column, so 'Duties & Taxes' excludes
      'Duties  Taxes' (the stated intent: exclude internal accounts);
  ``as_written``: the literal list against the normalised column, as the
      reference behaves (lists with '&' or '/' never match).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import fy_bounds
from ledgerflow.functions.text import normalize

# --- fixed values: group lists and patterns ------------------------------------
INTERNAL_GROUPS = ["Primary", "Reserves & Surplus", "Duties & Taxes", "GST", "TDS/TCS"]
INTERNAL_GROUPS_WIDE = INTERNAL_GROUPS + ["Secured Loans", "Unsecured Loans",
                                          "Current Liablities", "Bank Accounts"]
INTERNAL_GROUPS_NARROW = ["Primary", "Reserves & Surplus", "Duties & Taxes"]
SALE_TYPES = "Invoice|Sales|Bill"
PAYMENT_TYPES = "Payment|Receipt|Cash"
DEBTOR_GROUPS = ["Sundry Debtors", "Accounts Receivable", "Trade Receivables", "Debtors"]
PNL_PATTERN = "Profit & Loss"
PNL_QUICK_PATTERN = "Profit"
# ---------------------------------------------------------------------------------


def group_list(groups: list[str], mode: str = "normalized") -> list[Column]:
    """The list as literals; Catalyst folds the normaliser over them."""
    if mode == "normalized":
        return [normalize(F.lit(g)) for g in groups]
    if mode == "as_written":
        return [F.lit(g) for g in groups]
    raise ValueError(f"unknown group_match mode {mode!r}")


def not_in_groups(groups: list[str], mode: str = "normalized", col: str = "parent") -> Column:
    """``~parent.isin(list)`` (null parent is kept, as pandas ~isin keeps NaN)."""
    c = F.col(col)
    return c.isNull() | ~c.isin(group_list(groups, mode))


def business(mode: str = "normalized") -> Column:
    """F1."""
    return not_in_groups(INTERNAL_GROUPS, mode)


def business_wide(mode: str = "normalized") -> Column:
    """F2."""
    return not_in_groups(INTERNAL_GROUPS_WIDE, mode)


def business_narrow(mode: str = "normalized") -> Column:
    """F3."""
    return not_in_groups(INTERNAL_GROUPS_NARROW, mode)


def nonzero_balance() -> Column:
    """F4."""
    return (F.col("closing_balance") != 0) | (F.col("opening_balance") != 0)


def year_range(year: int, col: str = "altered_on") -> Column:
    """F5 as a range predicate (pushes down to parquet, unlike year(col) = y)."""
    return (F.col(col) >= F.lit(f"{year:04d}-01-01").cast("date")) & \
           (F.col(col) < F.lit(f"{year + 1:04d}-01-01").cast("date"))


def in_fy(fy: str, col: str = "date") -> Column:
    """F6."""
    start, end, _, _ = fy_bounds(fy)
    return F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def name_contains(pattern: str, mode: str = "normalized", col: str = "ledger_name") -> Column:
    """F7 predicate: name contains the P&L pattern, any case (literal)."""
    p = normalize(F.lit(pattern)) if mode == "normalized" else F.lit(pattern)
    return F.contains(F.lower(F.col(col)), F.lower(p))


def is_sale() -> Column:
    """F8: credit > 0 and voucher type ~ Invoice|Sales|Bill (any case)."""
    return (F.col("credit_amount") > 0) & \
        F.coalesce(F.col("voucher_type").rlike(f"(?i)({SALE_TYPES})"), F.lit(False))


def is_payment() -> Column:
    """F8: debit > 0 and voucher type ~ Payment|Receipt|Cash (any case)."""
    return (F.col("debit_amount") > 0) & \
        F.coalesce(F.col("voucher_type").rlike(f"(?i)({PAYMENT_TYPES})"), F.lit(False))


def voucher_class() -> Column:
    """F8 as a column: 'sale' / 'payment' / null."""
    return F.when(is_sale(), F.lit("sale")).when(is_payment(), F.lit("payment"))


def is_debtor_group(col: str = "parent") -> Column:
    """parent ~ any debtor group name, any case."""
    pat = "|".join(g.lower() for g in DEBTOR_GROUPS)
    return F.coalesce(F.col(col).rlike(f"(?i)({pat})"), F.lit(False))


def positive_closing() -> Column:
    """F10 (+)."""
    return F.col("closing_balance") > 0


def negative_closing() -> Column:
    """F10 (-)."""
    return F.col("closing_balance") < 0


def has_date(col: str = "altered_on") -> Column:
    """F12."""
    return F.col(col).isNotNull()


def pnl_accounts(ledgers: DataFrame, pattern: str = PNL_PATTERN, mode: str = "normalized") -> DataFrame:
    """ledgers whose name contains the pattern; ``first`` = smallest name."""
    return ledgers.where(name_contains(pattern, mode))
