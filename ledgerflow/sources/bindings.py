"""Bindings of the driver's TPC-H-style tables onto the two canonical tables.

``voucher_entries_raw``: one entry per lineitem (voucher = order, party = customer,
particulars = part name, signed amount from the order status).
``ledgers_raw``: customers, suppliers, name-prefix "branches" and one P&L ledger.

``ledgers`` / ``voucher_entries`` then apply the load-time rules of the viewer
(normalised names, coerced balances, 2-pass party key, debit/credit split).

Everything is lazy DataFrame code; joins are left to Catalyst/AQE (which
broadcasts a side only when its measured size is under the threshold).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.functions import (
    coerce_number, finite_or_zero, normalize, normalize_twice, split_credit, split_debit,
)
from ledgerflow.functions.numbers import MONEY
from ledgerflow.session import cut_lineage

# --- fixed values of the test binding ----------------------------------------
SEGMENT_PARENT = {
    "BUILDING": "Sundry Debtors",
    "AUTOMOBILE": "Trade Receivables",
    "MACHINERY": "Duties & Taxes",
    "HOUSEHOLD": "Primary",
    "FURNITURE": "Bank Accounts",
}
STATUS_TYPE = {"F": "Sales Invoice", "O": "Receipt", "P": "Journal"}
SUPPLIER_PARENT = "Sundry Creditors"
BRANCH_PARENT = "Sundry Debtors"
BRANCH_PREFIX_LEN = 16
PNL_NAME = "Profit & Loss A/c"
PNL_PARENT = "Primary"
PNL_OPENING_CUTOFF = "1996-04-01"
DEFAULT_FY = "1996-1997"
# -------------------------------------------------------------------------------

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass
class Tables:
    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        raise AttributeError(name)


def _map(col: str, mapping: dict[str, str]):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col(col) == k, F.lit(v)) if expr is None
                else expr.when(F.col(col) == k, F.lit(v)))
    return expr


#: The order of a voucher's entries.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def line_amount(status: Column, returnflag: Column, price: Column) -> Column:
    """The signed amount of an order's line."""
    sign = (F.when(status == "F", F.lit(-1)).when(status == "O", F.lit(1))
            .when(returnflag == "R", F.lit(1)).otherwise(F.lit(-1)))
    return (price.cast(MONEY) * sign).cast(MONEY)


def voucher_entries_raw(t: Tables) -> DataFrame:
    """One row per lineitem: date, voucher_type, voucher_no, entry_no, party_name,
    particulars, amount (DECIMAL(18,2), signed)."""
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                           "l_extendedprice", "l_returnflag")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    cust = t.customer.select("c_custkey", "c_name")
    part = t.part.select("p_partkey", "p_name")
    # orders x customer first (smaller than lineitem), lineitem x part, then the
    # big equi-join on the order key; the entry_no window reuses that partitioning.
    oc = orders.join(cust, orders.o_custkey == cust.c_custkey)
    lp = li.join(part, li.l_partkey == part.p_partkey)
    j = lp.join(oc, lp.l_orderkey == oc.o_orderkey)
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return j.select(
        F.col("o_orderdate").cast("date").alias("date"),
        _map("o_orderstatus", STATUS_TYPE).alias("voucher_type"),
        F.col("o_orderkey").cast("string").alias("voucher_no"),
        F.row_number().over(w).cast("int").alias("entry_no"),
        F.col("c_name").alias("party_name"),
        F.col("p_name").alias("particulars"),
        line_amount(F.col("o_orderstatus"), F.col("l_returnflag"), F.col("l_extendedprice")).alias("amount"),
        F.col("c_custkey").alias("party_id"),
    )


def ledgers_raw(t: Tables, entries_raw: DataFrame | None = None) -> DataFrame:
    """ledger_name, parent, opening_balance, closing_balance (double), altered_on (date)."""
    e = entries_raw if entries_raw is not None else voucher_entries_raw(t)
    # one row a party, read by the customers and by the branches
    per_cust = cut_lineage(e.groupBy("party_id").agg(F.sum("amount").alias("flow"),
                                                     F.max("date").alias("last_date")))
    cust = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    c = cust.join(per_cust, cust.c_custkey == per_cust.party_id, "left")
    opening = F.col("c_acctbal").cast(MONEY)
    customers = c.select(
        F.col("c_name").alias("ledger_name"),
        _map("c_mktsegment", SEGMENT_PARENT).alias("parent"),
        opening.alias("opening"),
        (opening + F.coalesce(F.col("flow"), F.lit(0).cast(MONEY))).alias("closing"),
        F.col("last_date").alias("altered_on"),
    )
    suppliers = t.supplier.select(
        F.col("s_name").alias("ledger_name"),
        F.lit(SUPPLIER_PARENT).alias("parent"),
        F.col("s_acctbal").cast(MONEY).alias("opening"),
        (-F.col("s_acctbal")).cast(MONEY).alias("closing"),
        F.lit(None).cast("date").alias("altered_on"),
    )
    branches = (customers
                .groupBy(F.substring("ledger_name", 1, BRANCH_PREFIX_LEN).alias("ledger_name"))
                .agg(F.sum("closing").alias("closing"))
                .select("ledger_name", F.lit(BRANCH_PARENT).alias("parent"),
                        F.lit(0).cast(MONEY).alias("opening"), "closing",
                        F.lit(None).cast("date").alias("altered_on")))
    price = F.col("l_extendedprice").cast(MONEY)
    pnl = (t.lineitem
           .agg(F.sum(F.when(F.col("l_shipdate") < F.lit(PNL_OPENING_CUTOFF).cast("timestamp_ntz"),
                             price)).alias("opening"),
                F.sum(price).alias("closing"))
           .select(F.lit(PNL_NAME).alias("ledger_name"), F.lit(PNL_PARENT).alias("parent"),
                   F.coalesce("opening", F.lit(0).cast(MONEY)).alias("opening"),
                   F.coalesce("closing", F.lit(0).cast(MONEY)).alias("closing"),
                   F.lit(None).cast("date").alias("altered_on")))
    out = customers.unionByName(suppliers).unionByName(branches).unionByName(pnl)
    return out.select(
        "ledger_name", "parent",
        F.col("opening").cast("double").alias("opening_balance"),
        F.col("closing").cast("double").alias("closing_balance"),
        "altered_on",
    )


def conform_ledgers(raw: DataFrame) -> DataFrame:
    """Viewer load rules for the ledger table (P1, P2, P8):

    ledger_name/parent normalised once (raw kept), balances coerced (bad -> 0;
    text goes through the numeric parser, numbers only through the NaN/inf rule),
    altered_on as DATE, plus ``name_key`` = the 2-pass normalised name (join key).
    """
    def bal(c: str):
        numeric = dict(raw.dtypes)[c] in ("double", "float", "int", "bigint") or \
            dict(raw.dtypes)[c].startswith("decimal")
        return finite_or_zero(F.col(c).cast("double")) if numeric else coerce_number(c)

    return raw.select(
        normalize("ledger_name").alias("ledger_name"),
        normalize("parent").alias("parent"),
        bal("opening_balance").alias("opening_balance"),
        bal("closing_balance").alias("closing_balance"),
        F.col("altered_on").cast("date").alias("altered_on"),
        normalize_twice("ledger_name").alias("name_key"),
        F.col("ledger_name").alias("ledger_name_raw"),
        F.col("parent").alias("parent_raw"),
    )


def conform_entries(raw: DataFrame) -> DataFrame:
    """Voucher-entry table as stored + viewer load rules.

    party_name normalised once, ``party_key`` (the reference's normalized_party)
    twice; debit/credit split from the signed amount.
    """
    amount = F.col("amount").cast("double")
    return raw.select(
        F.col("date").cast("date").alias("date"),
        F.coalesce(F.col("voucher_type").cast("string"), F.lit("")).alias("voucher_type"),
        F.coalesce(F.col("voucher_no").cast("string"), F.lit("")).alias("voucher_no"),
        F.col("entry_no").cast("int").alias("entry_no"),
        normalize("party_name").alias("party_name"),
        F.coalesce(F.col("particulars").cast("string"), F.lit("")).alias("particulars"),
        split_debit(amount).alias("debit_amount"),
        split_credit(amount).alias("credit_amount"),
        normalize_twice("party_name").alias("party_key"),
    ).where(F.col("date").isNotNull())


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(ledgers, voucher_entries) canonical DataFrames for a test folder."""
    t = Tables(spark, sf_dir)
    er = voucher_entries_raw(t)
    return conform_ledgers(ledgers_raw(t, er)), conform_entries(er)


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return conform_ledgers(ledgers_raw(t))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform_entries(voucher_entries_raw(Tables(spark, sf_dir)))


def requests(t: Tables) -> DataFrame:
    """Name-lookup requests derived from every customer (no sampling):
    variant 0 = the normalised lower-cased full name (one match),
    variant 1 = its first 16 characters (several matches),
    variant 2 = the name with a suffix no ledger has (no match)."""
    n = F.lower(normalize(F.col("c_name")))
    c = t.customer.select("c_custkey", n.alias("n"))
    return c.select(F.explode(F.array(
        F.struct((F.col("c_custkey") * 3).alias("req_id"), F.col("n").alias("request")),
        F.struct((F.col("c_custkey") * 3 + 1).alias("req_id"),
                 F.substring("n", 1, BRANCH_PREFIX_LEN).alias("request")),
        F.struct((F.col("c_custkey") * 3 + 2).alias("req_id"),
                 F.concat(F.col("n"), F.lit(" zz")).alias("request")),
    )).alias("r")).select(F.col("r.req_id").cast("long").alias("req_id"), "r.request")
