"""Date expressions: financial year labels and bounds, accounting-export dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_yyyymmdd(c: Column | str) -> Column:
    """Strict 8-digit YYYYMMDD text -> date; anything else -> null."""
    s = F.trim(_c(c).cast("string"))
    return F.when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))


def parse_altered_on(c: Column | str) -> Column:
    """Text before the first '.', then strict YYYYMMDD ('20230119.0' -> 2023-01-19)."""
    return parse_yyyymmdd(F.substring_index(_c(c).cast("string"), ".", 1))


def reparse_date(c: Column | str) -> Column:
    """Generic coerce of a stored date/timestamp/text to DATE, bad -> null."""
    col = _c(c)
    return F.coalesce(col.try_cast("timestamp").cast("date"), col.cast("string").try_cast("date"))


def fy_start_year(d: Column | str) -> Column:
    """April-March financial year start year of a date."""
    return F.year(F.add_months(_c(d).cast("date"), -3))


def financial_year(d: Column | str) -> Column:
    """P13: 'YYYY-YYYY+1' label of the FY containing the date."""
    y = fy_start_year(d)
    return F.concat_ws("-", y.cast("string"), (y + 1).cast("string"))


def fy_bounds(label: str) -> tuple[str, str, int, int]:
    """P14 for a literal label: '2023-2024' or '2023' -> ('2023-04-01', '2024-03-31', 2023, 2024).

    For the two-year form the end year is taken as given.
    """
    if "-" in label:
        a, b = label.split("-")[:2]
        start, end = int(a), int(b)
    else:
        start = int(label)
        end = start + 1
    return f"{start:04d}-04-01", f"{end:04d}-03-31", start, end


def fy_start_col(label: Column | str) -> Column:
    """P14 as a Column over a label column: FY start date."""
    lab = _c(label)
    start = F.split(lab, "-").getItem(0).try_cast("int")
    return F.make_date(start, F.lit(4), F.lit(1))


def fy_end_col(label: Column | str) -> Column:
    """P14 as a Column over a label column: FY end date (end year as given)."""
    lab = _c(label)
    start = F.split(lab, "-").getItem(0).try_cast("int")
    end = F.when(lab.contains("-"), F.split(lab, "-").getItem(1).try_cast("int")).otherwise(start + 1)
    return F.make_date(end, F.lit(3), F.lit(31))


def due_date(d: Column | str, days: int = 30) -> Column:
    """Invoice date + 30 days."""
    return F.date_add(_c(d), days)


def statement_day(d: Column | str) -> Column:
    """Statement display 'MM-dd'."""
    return F.date_format(_c(d), "MM-dd")


def br_day(d: Column | str) -> Column:
    """Bills-receivable display 'dd-MM'."""
    return F.date_format(_c(d), "dd-MM")
