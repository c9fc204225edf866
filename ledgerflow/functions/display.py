"""Display expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: display headings of the voucher-entry table --------------
DISPLAY_HEADINGS = {
    "date": "Date",
    "voucher_type": "Voucher Type",
    "voucher_no": "Voucher No",
    "party_name": "Party Name",
    "particulars": "Particulars",
    "debit_amount": "Debit Amount",
    "credit_amount": "Credit Amount",
}
# Display cut widths: voucher type 15, voucher no 10, particulars 25, status 12.
CUT_TYPE, CUT_NO, CUT_PARTICULARS, CUT_STATUS = 15, 10, 25, 12
# -----------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut(c: Column | str, n: int) -> Column:
    """First n characters."""
    return F.substring(_c(c), 1, n)


def money_text(c: Column | str) -> Column:
    """P17: '{:,.2f}'."""
    return F.format_number(_c(c), 2)


def money_text_positive(c: Column | str) -> Column:
    """P17 for debit/credit cells: values <= 0 print as '0.00'."""
    col = _c(c)
    return F.when(col > 0, F.format_number(col, 2)).otherwise(F.lit("0.00"))
