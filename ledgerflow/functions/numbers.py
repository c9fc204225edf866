"""Numeric coercion and money arithmetic.

Money is public as DOUBLE; sums are done on DECIMAL so results do not depend
on partition order, then cast back. Amounts in cents are DECIMAL(38,2) and fail
the job from 1e36 on; unrounded balances are summed in two limbs (``exact_sum``),
whole units and what is beyond the point, so any DOUBLE under 1e38 counts in full.
Such sums are hash aggregates in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
# Sums of amounts rounded to cents.
CENTS = "decimal(38,2)"
CENTS_LIMIT = 1e36
WHOLE_LIMIT = 1e38
# Plain decimal / scientific numbers with optional sign and surrounding blanks.
# Rejects '1,234', '-7.5 Dr', '1.5d' (Spark would accept the last one).
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_zero(x: Column) -> Column:
    """NaN, +inf, -inf and null -> 0.0.

    One comparison covers all four (NaN sorts above +inf in Spark, null fails the
    test), and ``x`` appears once in the condition and once in the value, which
    whole-stage codegen evaluates once (common subexpression).
    """
    return F.when(F.abs(x) < F.lit(float("inf")), x).otherwise(F.lit(0.0))


def coerce_number(c: Column | str) -> Column:
    """Text or number -> double; unparseable/null/NaN/inf -> 0.0."""
    col = _c(c).cast("string")
    stripped = F.regexp_replace(col, r"^\s+|\s+$", "")
    parsed = F.when(col.rlike(NUMERIC_TEXT), stripped.try_cast("double"))
    return finite_or_zero(parsed)


def money(c: Column | str) -> Column:
    """Double money value as exact DECIMAL(18,2)."""
    return finite_or_zero(_c(c).cast("double")).try_cast(MONEY)


def split_debit(amount: Column | str) -> Column:
    """Positive amount -> debit magnitude, else 0, rounded half-even to 2."""
    a = finite_or_zero(_c(amount).cast("double"))
    return F.bround(F.when(a > 0, F.abs(a)).otherwise(F.lit(0.0)), 2)


def split_credit(amount: Column | str) -> Column:
    """Negative amount -> credit magnitude, else 0, rounded half-even to 2."""
    a = finite_or_zero(_c(amount).cast("double"))
    return F.bround(F.when(a < 0, F.abs(a)).otherwise(F.lit(0.0)), 2)


def round2(c: Column | str) -> Column:
    """Round to 2 dp the way pandas/numpy do (half-even)."""
    return F.bround(_c(c), 2)


def money2(c: Column | str) -> Column:
    """An amount as exact DECIMAL(38,2); one of 1e36 or more fails the job instead of
    being left out of every later sum."""
    x = finite_or_zero(_c(c).cast("double"))
    return F.when(F.abs(x) < CENTS_LIMIT, x.cast(CENTS)).otherwise(
        F.raise_error(F.lit("an amount of 1e36 or more can't be summed exactly")).cast(CENTS))


def _integer(x: Column) -> Column:
    """An integral DOUBLE under 1e38 as the decimal it is, bit by bit: its printed form
    may be off in the last digit."""
    top = F.floor(x / float(2 ** 93))
    middle = F.floor(x / float(2 ** 53) - top.cast("double") * float(2 ** 40))
    low = x - top.cast("double") * float(2 ** 93) - middle.cast("double") * float(2 ** 53)
    wide = lambda c: c.cast("long").cast("decimal(38,0)")
    times = lambda c, n: (c * F.lit(2 ** n).cast("decimal(16,0)")).cast("decimal(38,0)")
    return times(times(wide(top), 40) + wide(middle), 53) + wide(low)


def limbs(c: Column | str) -> tuple[Column, Column]:
    """A balance as whole units, rounded down, and the rest (0 <= rest < 1): exact
    decimals, the rest to 18 places. A DOUBLE from 2**53 on has no rest."""
    x = finite_or_zero(_c(c).cast("double"))
    small = F.abs(x) < float(2 ** 53)
    whole = F.when(small, F.floor(x).cast("decimal(38,0)")).when(
        F.abs(x) < WHOLE_LIMIT, F.when(x < 0, -_integer(-x)).otherwise(_integer(x)).cast("decimal(38,0)")).otherwise(
        F.raise_error(F.lit("a balance of 1e38 or more can't be summed exactly")).cast("decimal(38,0)"))
    rest = F.when(small, x.cast("decimal(35,18)") - F.floor(x).cast("decimal(17,0)")).otherwise(F.lit(0).cast("decimal(36,18)"))
    return whole, rest.cast("decimal(36,18)")


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def joined(whole: Column, rest: Column) -> Column:
    """The DOUBLE nearest to whole + rest, through its decimal digits."""
    def carried(x):
        units = (x["whole"] + F.floor(x["rest"]).cast("decimal(38,0)")).cast("decimal(38,0)")
        return F.struct(units.alias("units"), (x["rest"] - F.floor(x["rest"])).cast("decimal(19,18)").alias("part"))

    def signed(x):  # -3 and 0.25 is -2.75
        down = (x["units"] < 0) & (x["part"] > 0)
        units = F.when(down, x["units"] + 1).otherwise(x["units"]).cast("decimal(38,0)")
        part = F.when(down, 1 - x["part"]).otherwise(x["part"]).cast("decimal(19,18)")
        digits = F.concat(F.abs(units).cast("string"), F.substring(part.cast("string"), 2, 19)).cast("double")
        return F.when(x["units"] < 0, -digits).otherwise(digits)

    limb = F.struct(whole.alias("whole"), rest.alias("rest"))
    return _once(_once(limb, carried), signed)


def exact_sum(c: Column | str, where: Column | None = None) -> tuple[Column, Column]:
    """The two limbs of a sum over the rows that meet ``where``; 0 over no rows."""
    keep = (lambda x: x) if where is None else (lambda x: F.when(where, x))
    whole, rest = limbs(c)
    zero = lambda t: F.lit(0).cast(t)
    return (F.coalesce(F.sum(keep(whole)), zero("decimal(38,0)")),
            F.coalesce(F.sum(keep(rest)), zero("decimal(38,18)")))
