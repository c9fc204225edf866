"""Column -> Column expressions; all built-in Spark functions, no UDFs."""

from ledgerflow.functions.text import (  # noqa: F401
    normalize, normalize_twice, sanitize_ledger_xml, sanitize_voucher_xml, literal_contains,
)
from ledgerflow.functions.numbers import (  # noqa: F401
    coerce_number, money, split_debit, split_credit, round2, finite_or_zero,
)
from ledgerflow.functions.dates import (  # noqa: F401
    parse_yyyymmdd, parse_altered_on, reparse_date, financial_year, fy_bounds,
    fy_start_col, fy_end_col, due_date, statement_day, br_day, fy_start_year,
)
from ledgerflow.functions.display import cut, money_text, money_text_positive  # noqa: F401
