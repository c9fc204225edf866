"""Edge cases of the column functions (FIXTURES §3), one literal row each."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow import functions as FN
from ledgerflow.sources import xml as X


def _one(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_normalize_one_and_two_pass(spark):
    vals = ["Duties & Taxes", "TDS/TCS", "Profit & Loss A/c", "Customer#000000001", None, "Café & Co",
            "  a  b\tc  ", "x́y"]
    assert _one(spark, vals, FN.normalize) == [
        "Duties  Taxes", "TDSTCS", "Profit  Loss Ac", "Customer000000001", "", "Café  Co", "a b c", "xy"]
    assert _one(spark, vals[:3], FN.normalize_twice) == ["Duties Taxes", "TDSTCS", "Profit Loss Ac"]


def test_normalize_keeps_letters_digits_and_a_few_marks(spark):
    vals = ["Ärger & Co. (GmbH) - 2", "日本 商事/東京", "a_b  c d", "₹ 5,000.00", "x​y", "١٢٣ abc"]
    assert _one(spark, vals, FN.normalize) == [
        "Ärger  Co. (GmbH) - 2", "日本 商事東京", "a_b c d", " 5000.00", "xy", "١٢٣ abc"]


def test_coerce_number(spark):
    vals = ["1,234", "1e3", " 5 ", "", "x", "nan", "-7.5 Dr", "1.5d", "inf", None, "-.5", "+2."]
    assert _one(spark, vals, FN.coerce_number) == [0.0, 1000.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
                                                   -0.5, 2.0]


def test_parse_dates(spark):
    assert _one(spark, ["20230119.0", "nan", "20231301", "2023011"], FN.parse_altered_on) == [
        dt.date(2023, 1, 19), None, None, None]
    assert _one(spark, ["20230401", "x"], FN.parse_yyyymmdd) == [dt.date(2023, 4, 1), None]


def test_debit_credit_split(spark):
    vals = [12.5, -12.5, 0.0, float("nan"), 2.675]
    assert _one(spark, vals, FN.split_debit, "double") == [12.5, 0.0, 0.0, 0.0, 2.68]
    assert _one(spark, vals, FN.split_credit, "double") == [0.0, 12.5, 0.0, 0.0, 0.0]


def test_financial_year(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 31),), (dt.date(2024, 4, 1),)], "d date")
    assert [r[0] for r in df.select(FN.financial_year("d")).collect()] == ["2023-2024", "2024-2025"]
    assert FN.fy_bounds("2023-2024")[:2] == ("2023-04-01", "2024-03-31")
    assert FN.fy_bounds("2023")[:2] == ("2023-04-01", "2024-03-31")
    assert FN.fy_bounds("2023-2025")[:2] == ("2023-04-01", "2025-03-31")


def test_sanitizers(spark):
    assert _one(spark, ["a&#4;b&#x1F;c&amp;\u0001"], FN.sanitize_ledger_xml) == ["abc&amp;"]
    assert _one(spark, ["a & b &amp; c &#4;", '<UDF:V X="1">q</UDF:V>'], FN.sanitize_voucher_xml) == [
        "a &amp; b &amp; c &amp;#4;", '<V X="1">q</V>']


def test_voucher_without_entries_and_defaults(spark):
    recs = spark.createDataFrame([
        ("<VOUCHER><DATE>20230401</DATE><VOUCHERNUMBER>7</VOUCHERNUMBER></VOUCHER>",),
        ("<VOUCHER><DATE>20230401</DATE><PARTYLEDGERNAME></PARTYLEDGERNAME>"
         "<ALLLEDGERENTRIES.LIST><LEDGERNAME>L</LEDGERNAME><AMOUNT>-3.5</AMOUNT></ALLLEDGERENTRIES.LIST>"
         "</VOUCHER>",),
        ("<VOUCHER><DATE>x</DATE><ALLLEDGERENTRIES.LIST><LEDGERNAME>L</LEDGERNAME><AMOUNT>1</AMOUNT>"
         "</ALLLEDGERENTRIES.LIST></VOUCHER>",),
    ], "xml string")
    rows = X.clean_entries(X.flatten_entries(X.parse_vouchers(recs))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.party_name, r.voucher_type, r.voucher_no, r.debit_amount, r.credit_amount) == \
        ("Unknown", "", "", 0.0, 3.5)


def test_extreme_inputs_do_not_raise_under_ansi(spark):
    from ledgerflow.functions.numbers import money2
    from ledgerflow.plans import questions as QN

    assert spark.conf.get("spark.sql.ansi.enabled") in ("true", "True")
    assert _one(spark, ["1e400", "-1e400", "1e300", "123456789012345678901234567890"],
                FN.coerce_number) == [0.0, 0.0, 1e300, 1.2345678901234568e29]
    assert _one(spark, [12.34, float("inf"), 1e35], money2, "double") == [Decimal("12.34"), 0, Decimal(10) ** 35]
    qs = ["top 000000000000000000000000000000005 parties", "top 123456789012345678901234567890 parties",
          "statement of ((a. for 2023-2024", "br"]
    df = spark.createDataFrame([(str(i), q) for i, q in enumerate(qs)], "q_id string, question string")
    rows = QN.routed(df).orderBy("q_id").collect()
    assert [r.params["count"] for r in rows] == [5, None, None, None]
    assert rows[2].params["ledger_name"] == "((a. for 2023-2024"
    assert rows[3].route == "br_query" and rows[3].params["ledger_name"] is None


def test_records_split_on_end_tag_with_self_closing_neighbours(spark):
    text = ('<ENVELOPE><LEDGER NAME="A" PARENT="P"/>\n<LEDGER><NAME>B</NAME></LEDGER>'
            '<LEDGER NAME="C"/><LEDGER NAME="D" RESERVEDNAME=""><PARENT>Q</PARENT></LEDGER></ENVELOPE>')
    raw = spark.createDataFrame([(c,) for c in text.split(X.separator("LEDGER"))], "value string")
    led = X.conform_ledgers(X.parse_ledgers(X.cut_records(raw, "LEDGER")))
    got = sorted((r.ledger_name, r.parent) for r in led.collect())
    assert got == [("A", "P"), ("B", None), ("C", None), ("D", "Q")]


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_unfinished_records_go_to_quarantine_at_any_split_size(spark, tmp_path, split):
    whole = "".join(f'<LEDGER><NAME>n{i}</NAME><PARENT>P</PARENT></LEDGER>\n<LEDGER NAME="s{i}"/>\n' for i in range(3))
    tails = ["<LEDGER><NAME>half</NAME>", '<LEDGER><NAME>half</NAME><PARENT>P</PARENT></LEDG', "<LEDGER><NAME>ha", "</ENVELOPE>", ""]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for n, tail in enumerate(tails):
            folder = tmp_path / f"{split}-{n}"
            folder.mkdir()
            (folder / "export.xml").write_text("<ENVELOPE>" + whole + tail)
            got = sorted(r.ledger_name for r in X.scan_ledger_xml(spark, str(folder)).collect())
            assert got == ["n0", "n1", "n2", "s0", "s1", "s2"]
            bad = [r.record for r in X.quarantine(spark, str(folder), "LEDGER").collect()]
            assert len(bad) == (1 if n < 3 else 0) and all("ha" in b for b in bad)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
