"""Splittable dirty-XML ingest.

The XML data source parses before we could clean, and ``wholetext`` is one task
per file. Instead the text source splits the files within the record end tag
(``lineSep='/VOUCHER>'``; Hadoop's line reader splits large files across
tasks). A chunk that ends in '<' had its end tag, which is put together again; the
rest of a file that was cut off has none, at whatever split it lies, so an unfinished
record never passes for a whole one. Records are sanitised with ``regexp_replace`` and
parsed with ``from_xml`` against an explicit all-string schema (never inferred). Parse
failures, unfinished records among them, are kept per record in ``_corrupt_record``
(PERMISSIVE) so a bad record goes to quarantine instead of failing the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.functions import (
    coerce_number, parse_altered_on, parse_yyyymmdd, sanitize_ledger_xml, sanitize_voucher_xml,
    split_credit, split_debit,
)

S = T.StringType()
CORRUPT = "_corrupt_record"

LEDGER_FIELDS = ["NAME", "PARENT", "OPENINGBALANCE", "CLOSINGBALANCE", "ALTEREDON"]
# each field as a child element or as an attribute (``_`` prefix), like read_xml
LEDGER_SCHEMA = T.StructType(
    [T.StructField(f, S) for f in LEDGER_FIELDS] + [T.StructField(f"_{f}", S) for f in LEDGER_FIELDS]
    + [T.StructField(CORRUPT, S)])
# Entry fields come in either spelling; the lower-case one is renamed before the parse,
# which matches names in any case and would keep the last of both.
LOWER_ENTRY_TAG = r"<(/?)(amount|ledgername)>"
ENTRY = T.StructType([T.StructField(f, S) for f in ("LEDGERNAME", "AMOUNT", "ledgername_lower", "amount_lower")])
VOUCHER_SCHEMA = T.StructType([
    T.StructField("DATE", S), T.StructField("VOUCHERTYPENAME", S),
    T.StructField("VOUCHERNUMBER", S), T.StructField("PARTYLEDGERNAME", S),
    T.StructField("ALLLEDGERENTRIES.LIST", T.ArrayType(ENTRY)), T.StructField(CORRUPT, S),
])
XML_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
               "ignoreSurroundingSpaces": "false"}

# --- fixed values: defaults and the source-side date window ---------------------
PARTY_DEFAULT = "Unknown"
SOURCE_FROM, SOURCE_TO = "2000-04-01", "2035-03-31"
ENTRY_COLUMNS = ["date", "voucher_type", "voucher_no", "party_name", "particulars",
                 "debit_amount", "credit_amount"]
# ----------------------------------------------------------------------------------


def separator(tag: str) -> str:
    """The part of a record's end tag that files are split at: all but its '<'."""
    return f"/{tag}>"


def read_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One row per ``<tag ...>...</tag>`` record (column ``xml``) from text files, and one
    for an unfinished record at the end of a file, as it is."""
    raw = spark.read.option("lineSep", separator(tag)).text(path)
    return cut_records(raw, tag)


def cut_records(raw: DataFrame, tag: str) -> DataFrame:
    """Chunks split at ``separator(tag)`` -> records.

    A chunk holds the text after the previous end tag: maybe some self-closing
    attribute-only records (``<LEDGER NAME="x"/>``, which have no end tag of
    their own) and then the start of one full record. Both are taken: the
    self-closing ones with ``regexp_extract_all``, the full one from its
    (non-self-closing) start tag to the end, where a '<' says that its end tag
    followed. The regexes run once per chunk (they feed a generator, so later
    filters are not pushed below them and re-evaluated)."""
    selfclosing = F.regexp_extract_all("value", F.lit(rf"<{tag}(?:\s[^>]*)?/>"), 0)
    full = F.regexp_extract("value", rf"(?s)(<{tag}(?:\s[^>]*)?(?<!/)>.*)$", 1)
    whole = F.when(F.endswith(full, F.lit("<")), F.concat(full, F.lit(separator(tag)))).otherwise(full)
    full_rec = F.when(F.length(full) > 0, F.array(whole)).otherwise(F.array().cast("array<string>"))
    return raw.select(F.explode(F.concat(selfclosing, full_rec)).alias("xml"))


def parse_ledgers(records: DataFrame, sanitize: bool = True) -> DataFrame:
    """S3 + parse: struct columns of each <LEDGER> record."""
    x = sanitize_ledger_xml("xml") if sanitize else F.col("xml")
    # inline(array(struct)): the parse runs once per record, not once per field
    return records.select(F.inline(F.array(F.from_xml(x, LEDGER_SCHEMA, XML_OPTIONS))))


def conform_ledgers(parsed: DataFrame) -> DataFrame:
    """Canonical 5 text columns; each comes from the child element or the
    attribute of the same name (``read_xml`` reads both)."""
    def field(f: str):
        return F.coalesce(F.col(f), F.col(f"_{f}"))

    return parsed.select(
        field("NAME").alias("ledger_name"),
        field("PARENT").alias("parent"),
        field("OPENINGBALANCE").alias("opening_balance"),
        field("CLOSINGBALANCE").alias("closing_balance"),
        field("ALTEREDON").alias("altered_on"))


def type_ledgers(conformed: DataFrame) -> DataFrame:
    """Ledger clean step (P2, P6): balances coerced (bad -> 0.0), altered_on a date."""
    return conformed.select(
        "ledger_name", "parent",
        coerce_number("opening_balance").alias("opening_balance"),
        coerce_number("closing_balance").alias("closing_balance"),
        parse_altered_on("altered_on").alias("altered_on"))


def scan_ledger_xml(spark: SparkSession, path: str) -> DataFrame:
    """Ledger XML folder -> typed ledger rows (good records only)."""
    p = parse_ledgers(read_records(spark, path, "LEDGER"))
    return type_ledgers(conform_ledgers(p.where(F.col(CORRUPT).isNull())))


def parse_vouchers(records: DataFrame, sanitize: bool = True) -> DataFrame:
    x = sanitize_voucher_xml("xml") if sanitize else F.col("xml")
    x = F.regexp_replace(x, LOWER_ENTRY_TAG, "<$1$2_lower>")
    return records.select(F.inline(F.array(F.from_xml(x, VOUCHER_SCHEMA, XML_OPTIONS))))


def default_text(c, default: str = ""):
    """Missing or empty element -> default."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def flatten_entries(vouchers: DataFrame) -> DataFrame:
    """One row per (voucher, entry); vouchers without entries vanish
    (posexplode, not outer). entry_no is the position in the list (1-based)."""
    v = vouchers.select(
        default_text("DATE").alias("date_text"),
        default_text("VOUCHERTYPENAME").alias("voucher_type"),
        default_text("VOUCHERNUMBER").alias("voucher_no"),
        default_text("PARTYLEDGERNAME", PARTY_DEFAULT).alias("party_name"),
        F.posexplode(F.col("`ALLLEDGERENTRIES.LIST`")).alias("pos", "e"))
    return v.select(
        "date_text", "voucher_type", "voucher_no", "party_name",
        (F.col("pos") + 1).cast("int").alias("entry_no"),
        default_text(F.coalesce(F.nullif(F.col("e.LEDGERNAME"), F.lit("")), F.col("e.ledgername_lower")))
        .alias("particulars"),
        # P5: the upper-case amount unless it is missing or "0", then the lower-case one, then "0"
        F.coalesce(F.nullif(F.nullif(F.col("e.AMOUNT"), F.lit("")), F.lit("0")),
                   F.nullif(F.col("e.amount_lower"), F.lit("")), F.lit("0")).alias("amount_text"))


def clean_entries(flat: DataFrame) -> DataFrame:
    """Voucher clean step: P7 (bad dates dropped), P3 amount, P9 split, P10, P11."""
    d = parse_yyyymmdd("date_text")
    amount = F.col("amount")
    return (flat.withColumns({"date": d, "amount": coerce_number("amount_text")})
            .where(F.col("date").isNotNull())
            .select("date", F.col("voucher_type").cast("string").alias("voucher_type"),
                    F.col("voucher_no").cast("string").alias("voucher_no"),
                    F.col("party_name").cast("string").alias("party_name"),
                    F.col("particulars").cast("string").alias("particulars"),
                    split_debit(amount).alias("debit_amount"),
                    split_credit(amount).alias("credit_amount"),
                    "entry_no"))


def scan_voucher_xml(spark: SparkSession, path: str) -> DataFrame:
    """S2 (+ S4, J1, clean): voucher XML folder -> voucher-entry rows."""
    p = parse_vouchers(read_records(spark, path, "VOUCHER"))
    return clean_entries(flatten_entries(p.where(F.col(CORRUPT).isNull())))


def quarantine(spark: SparkSession, path: str, tag: str, sanitize: bool = True) -> DataFrame:
    """Records that do not parse, with their text, instead of failing the batch."""
    recs = read_records(spark, path, tag)
    parse = parse_vouchers if tag == "VOUCHER" else parse_ledgers
    return parse(recs, sanitize).where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record"))


def source_pruned(entries: DataFrame) -> DataFrame:
    """The source-side column list and date window."""
    return (entries.select(*ENTRY_COLUMNS)
            .where(F.col("date").between(F.lit(SOURCE_FROM).cast("date"), F.lit(SOURCE_TO).cast("date"))))
