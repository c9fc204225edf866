"""Dirty text and XML forms of the driver's tables (FIXTURES §2 "Nested and XML forms").

The accounting server exports text; the test data is typed parquet. These
builders turn *every* row of the driver tables into the text records the
ingest side must handle, adding dirt deterministically by key (no rows are
dropped or sampled):

ledger records (customers, suppliers, branches, the P&L account), rec_id = 2*custkey /
  2*suppkey+1 / 2*(BRANCH_BASE + least custkey of the branch) / 2*PNL_BASE+1
  opening text by rec_id % 8: plain, padded, ' Dr' suffix, '1,' prefix, 'nan',
  empty, 'e0' exponent, missing;  closing 'inf' when rec_id % 6 == 5;
  altered_on by rec_id % 5: yyyyMMdd, yyyyMMdd.0, 'nan', 7 digits, month 13;
  XML: name as attribute only when rec_id % 4 == 0, the whole record as one
  self-closing attribute-only element when rec_id % 4 == 3, a control char in
  the name when % 10 == 0, '&#4;' in the name when % 7 == 0.
voucher records (orders, entries = lineitems), key = orderkey
  date 'x'-prefixed when % 11 == 0; empty type when % 9 == 0; party empty when
  % 13 == 0, ' & Co' appended when % 5 == 0; entry amount 'n/a' when
  (orderkey + entry_no) % 13 == 0; XML: control char in the party when % 10 == 0,
  '&#4;' in the type when % 7 == 0, a namespaced <UDF:NARRATION> when % 3 == 0,
  no entries when % 17 == 0 or where the order has no lines; entry fields in lower case
  when (orderkey + entry_no) % 4 == 1, and an AMOUNT of 0 before a lower-case amount
  when it is 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.sources.bindings import (
    BRANCH_PARENT, BRANCH_PREFIX_LEN, LINE_ORDER, PNL_NAME, PNL_PARENT, SEGMENT_PARENT, STATUS_TYPE, SUPPLIER_PARENT,
    Tables, _map, line_amount, voucher_entries_raw,
)

BRANCH_BASE, PNL_BASE = 10 ** 9, 2 * 10 ** 9

CTRL = "\u0001"
CHARREF = "&#4;"
BASE_DATE = "1995-01-01"
DATE_SPAN = 2400


def _k(c: str, m: int, r: int) -> Column:
    return (F.col(c) % m) == r


def ledger_text(t: Tables) -> DataFrame:
    """rec_id, NAME, PARENT, OPENINGBALANCE, CLOSINGBALANCE, ALTEREDON (all text)."""
    cust = t.customer.select((F.col("c_custkey") * 2).alias("rec_id"), F.col("c_name").alias("NAME"),
                             _map("c_mktsegment", SEGMENT_PARENT).alias("PARENT"),
                             F.col("c_acctbal").alias("bal"))
    supp = t.supplier.select((F.col("s_suppkey") * 2 + 1).alias("rec_id"), F.col("s_name").alias("NAME"),
                             F.lit(SUPPLIER_PARENT).alias("PARENT"), F.col("s_acctbal").alias("bal"))
    branch = t.customer.groupBy(F.substring("c_name", 1, BRANCH_PREFIX_LEN).alias("NAME")).agg(
        F.min("c_custkey").alias("k"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("bal")).select(
        ((F.col("k") + BRANCH_BASE) * 2).alias("rec_id"), "NAME", F.lit(BRANCH_PARENT).alias("PARENT"),
        F.col("bal").cast("double").alias("bal"))
    pnl = t.lineitem.agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("bal")).select(
        F.lit(2 * PNL_BASE + 1).cast("long").alias("rec_id"), F.lit(PNL_NAME).alias("NAME"),
        F.lit(PNL_PARENT).alias("PARENT"), F.coalesce(F.col("bal").cast("double"), F.lit(0.0)).alias("bal"))
    b = cust.unionByName(supp).unionByName(branch).unionByName(pnl)
    s = F.col("bal").cast("decimal(18,2)").cast("string")
    m8 = F.col("rec_id") % 8
    opening = (F.when(m8 == 0, s).when(m8 == 1, F.concat(F.lit("  "), s, F.lit(" ")))
               .when(m8 == 2, F.concat(s, F.lit(" Dr"))).when(m8 == 3, F.concat(F.lit("1,"), s))
               .when(m8 == 4, F.lit("nan")).when(m8 == 5, F.lit(""))
               .when(m8 == 6, F.concat(s, F.lit("e0"))))
    closing = F.when(_k("rec_id", 6, 5), F.lit("inf")).otherwise(s)
    d = F.date_format(F.date_add(F.lit(BASE_DATE).cast("date"), (F.col("rec_id") % DATE_SPAN).cast("int")),
                      "yyyyMMdd")
    m5 = F.col("rec_id") % 5
    altered = (F.when(m5 == 0, d).when(m5 == 1, F.concat(d, F.lit(".0"))).when(m5 == 2, F.lit("nan"))
               .when(m5 == 3, F.substring(d, 1, 7)).otherwise(F.concat(F.substring(d, 1, 4), F.lit("1301"))))
    return b.select("rec_id", "NAME", "PARENT", opening.alias("OPENINGBALANCE"),
                    closing.alias("CLOSINGBALANCE"), altered.alias("ALTEREDON"))


def _headers(t: Tables) -> DataFrame:
    """One row per order: the text fields of its voucher, and its status."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    j = o.join(t.customer.select("c_custkey", F.col("c_name").alias("party_name")), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    d = F.date_format("o_orderdate", "yyyyMMdd")
    return j.select(
        key.alias("voucher_id"),
        F.when(key % 11 == 0, F.concat(F.lit("x"), d)).otherwise(d).alias("DATE"),
        F.when(key % 9 == 0, F.lit("")).otherwise(_map("o_orderstatus", STATUS_TYPE))
        .alias("VOUCHERTYPENAME"),
        key.cast("string").alias("VOUCHERNUMBER"),
        F.when(key % 13 == 0, F.lit(""))
        .when(key % 5 == 0, F.concat(F.col("party_name"), F.lit(" & Co")))
        .otherwise(F.col("party_name")).alias("PARTYLEDGERNAME"), "o_orderstatus")


def voucher_text(t: Tables) -> DataFrame:
    """Flat text view: one row per (voucher, entry) with header text fields."""
    e = voucher_entries_raw(t).select("voucher_no", "entry_no", "particulars", "amount")
    h = _headers(t).drop("o_orderstatus")
    key = F.col("voucher_id")
    return h.join(e, h.VOUCHERNUMBER == e.voucher_no).select(
        *h.columns, "entry_no",
        F.col("particulars").alias("LEDGERNAME"),
        F.when((key + F.col("entry_no")) % 13 == 0, F.lit("n/a"))
        .otherwise(F.col("amount").cast("string")).alias("AMOUNT"),
    )


def _esc(c: Column) -> Column:
    """XML-escape text content (the export escapes '&', '<', '>')."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def _el(tag: str, c: Column) -> Column:
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")))


def ledger_xml_records(t: Tables) -> DataFrame:
    """One dirty <LEDGER> record per ledger text row (column ``value``)."""
    lt = ledger_text(t)
    rid = F.col("rec_id")
    name = _esc(F.col("NAME"))
    name = F.when(rid % 10 == 0, F.concat(F.lit(CTRL), name)).otherwise(name)
    name = F.when(rid % 7 == 0, F.concat(name, F.lit(CHARREF))).otherwise(name)
    attr_only = rid % 4 == 0
    head = F.when(attr_only, F.concat(F.lit('<LEDGER NAME="'), F.regexp_replace(name, '"', "&quot;"),
                                      F.lit('" RESERVEDNAME="">'))).otherwise(F.lit("<LEDGER>"))
    body = F.concat(
        F.when(attr_only, F.lit("")).otherwise(_el("NAME", name)), F.lit("\n "),
        _el("PARENT", _esc(F.col("PARENT"))), F.lit("\n "),
        _el("OPENINGBALANCE", F.col("OPENINGBALANCE")), F.lit("\n "),
        _el("CLOSINGBALANCE", F.col("CLOSINGBALANCE")), F.lit("\n "),
        _el("ALTEREDON", F.col("ALTEREDON")))

    def attr(tag: str, c: Column) -> Column:
        v = F.regexp_replace(c, '"', "&quot;")
        return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit(f' {tag}="'), v, F.lit('"')))

    selfclosing = F.concat(F.lit("<LEDGER"), attr("NAME", name), attr("PARENT", _esc(F.col("PARENT"))),
                           attr("OPENINGBALANCE", F.col("OPENINGBALANCE")),
                           attr("CLOSINGBALANCE", F.col("CLOSINGBALANCE")),
                           attr("ALTEREDON", F.col("ALTEREDON")), F.lit("/>\n"))
    full = F.concat(head, F.lit("\n "), body, F.lit("\n</LEDGER>\n"))
    return lt.select("rec_id", F.when(rid % 4 == 3, selfclosing).otherwise(full).alias("value"))


def _entry_xml(key: Column, no: Column, particulars: Column, amount: Column) -> Column:
    spelling = (key + no) % 4
    name = _esc(particulars)
    amount = F.when((key + no) % 13 == 0, F.lit("n/a")).otherwise(amount.cast("string"))
    return F.concat(F.lit("<ALLLEDGERENTRIES.LIST>"), F.when(spelling == 1, F.concat(
        _el("ledgername", name), _el("amount", amount))).when(spelling == 2, F.concat(
            _el("LEDGERNAME", name), _el("AMOUNT", F.lit("0")), _el("amount", amount))).otherwise(F.concat(
                _el("LEDGERNAME", name), _el("AMOUNT", amount))), F.lit("</ALLLEDGERENTRIES.LIST>"))


def _order_lines(t: Tables) -> DataFrame:
    """One row per order key: its lines in order. Lines are moved to their order and
    sorted there once; the text is made when they have met the order's header."""
    li = t.lineitem.select("l_orderkey", *LINE_ORDER, "l_returnflag").where("l_orderkey is not null")
    part = t.part.select("p_partkey", "p_name")
    j = li.join(part, li.l_partkey == part.p_partkey)
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    lines = F.collect_list(F.struct("p_name", "l_extendedprice", "l_returnflag")).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return j.select("l_orderkey", lines.alias("lines"), F.row_number().over(w).alias("line")) \
        .where("line = 1").drop("line")


def voucher_xml_records(t: Tables) -> DataFrame:
    """One dirty <VOUCHER> record per order (column ``value``); entries nested."""
    key = F.col("voucher_id")
    # of rows with one order key each has the entries of all, as often as there are such rows
    h = _headers(t).withColumn("orders", F.sort_array(F.collect_list(F.struct("o_orderstatus")).over(
        Window.partitionBy("voucher_id"))))
    lines = _order_lines(t)
    g = h.join(lines, h.voucher_id == lines.l_orderkey, "left").drop("l_orderkey")
    each = F.flatten(F.transform("lines", lambda x: F.transform("orders", lambda o: F.struct(
        x["p_name"].alias("particulars"),
        line_amount(o["o_orderstatus"], x["l_returnflag"], x["l_extendedprice"]).alias("amount")))))
    texts = F.transform(each, lambda e, i: F.array_repeat(
        _entry_xml(key, i + 1, e["particulars"], e["amount"]), F.size("orders")))
    g = g.withColumn("entries", F.array_join(F.flatten(texts), "\n "))
    party = F.col("PARTYLEDGERNAME")  # bare '&' left in on purpose (dirty export)
    party = F.when(key % 10 == 0, F.concat(F.lit(CTRL), party)).otherwise(party)
    vtype = F.when(key % 7 == 0, F.concat(F.col("VOUCHERTYPENAME"), F.lit(CHARREF))) \
        .otherwise(F.col("VOUCHERTYPENAME"))
    narration = F.when(key % 3 == 0, F.lit("\n <UDF:NARRATION>note</UDF:NARRATION>")).otherwise(F.lit(""))
    entries = F.when((key % 17 == 0) | F.col("entries").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("\n "), F.col("entries")))
    value = F.concat(F.lit("<VOUCHER>\n "), _el("DATE", F.col("DATE")), F.lit("\n "),
                     _el("VOUCHERTYPENAME", vtype), F.lit("\n "),
                     _el("VOUCHERNUMBER", F.col("VOUCHERNUMBER")), F.lit("\n "),
                     _el("PARTYLEDGERNAME", party), narration, entries, F.lit("\n</VOUCHER>\n"))
    return g.select(F.col("voucher_id"), value.alias("value"))
