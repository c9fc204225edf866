"""Text column expressions: name normalisation and XML sanitising.

All are built-in ``regexp_replace`` chains (JVM-side, codegen'd), no UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
# Whitespace as Python's str.isspace()/re ``\s`` sees it: ASCII \t \n \v \f \r,
# the separators \x1c-\x1f, NEL \x85 and every Unicode Z* character.
WS_CLASS = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"
# Characters kept by the name normaliser after whitespace is collapsed:
# Unicode letters and numbers (Python's ``\w``), underscore, space, ( ) . -
KEEP_CLASS = r"\p{L}\p{N}_ ().\-"
# Numeric character references, removed by the ledger sanitiser.
CHAR_REF = r"&#(?:[0-9]+|[xX][0-9a-fA-F]+);?"
# Control characters removed by the ledger sanitiser (all < 0x20 but \t \n \r).
LEDGER_CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
# Control characters removed by the voucher sanitiser.
VOUCHER_CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
# Element namespace prefix, e.g. <UDF:X> -> <X>.
NS_PREFIX = r"(</?)[a-zA-Z0-9_]+:"
# Bare ampersand: not the start of amp/lt/gt/apos/quot entity.
BARE_AMP = r"&(?!(amp|lt|gt|apos|quot);)"
# ----------------------------------------------------------------------------


def normalize(c: Column | str) -> Column:
    """One pass of the name normaliser.

    null -> '', strip, collapse whitespace runs to one space, then delete every
    character outside letters/numbers/_/space/( ) . -  (deleting after the
    collapse can leave double spaces: 'Duties & Taxes' -> 'Duties  Taxes').
    """
    col = F.col(c) if isinstance(c, str) else c
    s = F.coalesce(col.cast("string"), F.lit(""))
    s = F.regexp_replace(s, rf"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")
    s = F.regexp_replace(s, rf"[{WS_CLASS}]+", " ")
    return F.regexp_replace(s, rf"[^{KEEP_CLASS}]", "")


def normalize_twice(c: Column | str) -> Column:
    """The normaliser applied to its own output (used for party join keys)."""
    return normalize(normalize(c))


def sanitize_ledger_xml(c: Column | str) -> Column:
    """S3: delete numeric character references and control characters."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(col, CHAR_REF, ""), LEDGER_CTRL, "")


def sanitize_voucher_xml(c: Column | str) -> Column:
    """Strip namespace prefixes, delete control chars, escape bare '&'."""
    col = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(col, NS_PREFIX, "$1")
    s = F.regexp_replace(s, VOUCHER_CTRL, "")
    return F.regexp_replace(s, BARE_AMP, "&amp;")


def literal_contains(text: Column, pattern: Column) -> Column:
    """Case-insensitive literal substring test (the default matching mode)."""
    return F.contains(F.lower(text), F.lower(pattern))
