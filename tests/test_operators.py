"""Operator semantics on literal tables (FIXTURES §3) and brute-force checks."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerflow.operators import receivable as RV
from ledgerflow.operators import resolve as RS
from ledgerflow.operators import statement as ST
from ledgerflow.operators.textjoin import contains_pairs
from ledgerflow.operators.windows import running_sums
from ledgerflow.plans import questions as QN

LEDGER_SCHEMA = ("ledger_name string, parent string, opening_balance double, closing_balance double, "
                 "altered_on date, name_key string, ledger_name_raw string, parent_raw string")
ENTRY_SCHEMA = ("date date, voucher_type string, voucher_no string, entry_no int, party_name string, "
                "particulars string, debit_amount double, credit_amount double, party_key string")


def _led(spark, rows):
    return spark.createDataFrame([(n, p, o, c, None, n, n, p) for n, p, o, c in rows], LEDGER_SCHEMA)


def _ent(spark, rows):
    return spark.createDataFrame([(d, t, v, e, p, "item", dr, cr, p) for d, t, v, e, p, dr, cr in rows],
                                 ENTRY_SCHEMA)


def test_contains_pairs_matches_brute_force(spark):
    rnd = random.Random(7)
    alpha = "abcab"
    texts = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 14))) for _ in range(300)]
    pats = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 11))) for _ in range(200)]
    pats += ["A", "Ab", texts[3][:9] if texts[3] else "a"]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    p = spark.createDataFrame([(x,) for x in pats], "p string")
    got = {(r.pattern, r.text) for r in contains_pairs(p, "p", t, "t", q=4).collect()}
    want = {(a, b) for a in set(pats) for b in set(texts) if a.lower() in b.lower()}
    assert got == want


def test_running_sums_equal_plain_window_under_skew(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        party = "hot" if i % 3 else f"p{i % 17}"
        rows.append((party, dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 40)),
                     str(rnd.randint(1, 60)), i, rnd.randint(-500, 500)))
    df = spark.createDataFrame(rows, "party string, d date, v string, e int, amt int")
    got = running_sums(df, ["party"], ["d", "v", "e"], {"run": F.col("amt").cast("decimal(18,2)"),
                                                       "n": F.lit(1)})
    w = Window.partitionBy("party").orderBy("d", "v", "e").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("e", F.sum(F.col("amt").cast("decimal(18,2)")).over(w).alias("run"),
                     F.count(F.lit(1)).over(w).alias("n"))
    a = {r.e: (r.run, r.n) for r in got.select("e", "run", "n").collect()}
    b = {r.e: (r.run, r.n) for r in want.collect()}
    assert a == b


def test_statement_example(spark):
    # opening -100; debit 30; credit 50 -> opening credit 0; balances -100, -70, -120
    led = _led(spark, [("A", "Sundry Debtors", -100.0, -120.0)])
    ent = _ent(spark, [(dt.date(2023, 5, 1), "Receipt", "1", 1, "A", 30.0, 0.0),
                       (dt.date(2023, 6, 1), "Sales Invoice", "2", 1, "A", 0.0, 50.0)])
    rows = ST.fy_statement(led, ent, "2023-2024").orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1, 2, 3]
    assert rows[0].credit == 0.0 and rows[0].balance == -100.0
    assert [r.balance for r in rows[1:3]] == [-70.0, -120.0]
    assert rows[3].voucher_no == "CL-001" and rows[3].credit == -120.0


def test_statement_partial_fallback_and_none(spark):
    led = _led(spark, [("Branch", "Sundry Debtors", 0.0, 0.0), ("Nobody", "Primary", 5.0, 5.0)])
    ent = _ent(spark, [(dt.date(2023, 5, 1), "Receipt", "1", 1, "Branch North", 10.0, 0.0)])
    rows = ST.fy_statement(led, ent, "2023-2024").collect()
    src = {r.ledger_name: r.source for r in rows}
    assert src == {"Branch": "partial", "Nobody": "none"}
    assert len([r for r in rows if r.ledger_name == "Nobody"]) == 2


def test_br_status_and_fallback_gap(spark):
    led = _led(spark, [("P", "Sundry Debtors", 0.0, 0.0),
                       ("Q", "Primary", 0.0, 0.0),
                       ("Q one", "Sundry Debtors", 0.0, -1.0),
                       ("Q two", "Sundry Debtors", 0.0, 1.0),
                       ("Q zed", "Sundry Debtors", 0.0, -1.0)])
    ent = _ent(spark, [(dt.date(2023, 5, 1), "Sales Invoice", "1", 1, "P", 0.0, 10.5),
                       (dt.date(2023, 5, 2), "Sales Invoice", "2", 1, "P", 0.0, 10.51),
                       (dt.date(2023, 5, 3), "Sales Invoice", "3", 1, "P", 0.0, 10.0),
                       (dt.date(2023, 5, 4), "Receipt", "4", 1, "P", 10.0, 0.0)])
    br = {(r.ledger_name, r.br_no): r for r in RV.bills_receivable(led, ent, "2023-2024").collect()}
    assert br[("P", "1")].status == "Paid" and br[("P", "1")].amount == 0.5
    assert br[("P", "2")].status == "Outstanding"
    assert ("P", "3") not in br
    q = sorted((k[1], v.br_date) for k, v in br.items() if k[0] == "Q")
    assert q == [("BR-001", dt.date(2023, 4, 1)), ("BR-003", dt.date(2023, 5, 1))]


def test_resolve_statuses(spark):
    led = _led(spark, [("Alpha Traders", "X", 0.0, 1.0), ("Alpha Mills", "X", 0.0, 2.0),
                       ("Beta", "Y", 0.0, 3.0)])
    req = spark.createDataFrame([(1, "beta"), (2, "alpha"), (3, "gamma")], "req_id long, request string")
    st = {r.req_id: (r.status, r.resolved_name, r.options) for r in RS.resolve_status(req, led).collect()}
    assert st == {1: ("resolved", "Beta", "Beta"), 2: ("clarification", None, "Alpha Mills; Alpha Traders"),
                  3: ("not_found", None, "")}


def test_routes_and_params(spark):
    qs = ["balance of Abraham", "find parent of X", "top 10 parties by balance", "top 10 parties",
          "top 5 parties in 2024", "statement of x for 2023-2024?"]
    df = spark.createDataFrame([(str(i), q) for i, q in enumerate(qs)], "q_id string, question string")
    rows = QN.routed(df).orderBy(F.col("q_id").cast("int")).collect()
    assert [r.route for r in rows] == ["br_query", "search_query", "balance_query", "ranking_query",
                                       "ranking_query", "statement_query"]
    assert (rows[4].params["count"], rows[4].params["year"]) == (5, 2024)
    assert rows[5].params["ledger_name"] == "x for 2023-2024"
    assert rows[5].params["financial_year"] == "2023-2024"


def test_followup_rewrite(spark):
    turns = ["balance_query_prompt", "X", "balance_query_prompt", "parent_query_prompt", "Y"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)], "conv_id long, turn long, text string")
    out = [r.final_text for r in QN.followup_rewrite(df).orderBy("turn").collect()]
    assert out == ["balance_query_prompt", "balance of X", "balance_query_prompt",
                   "balance of parent_query_prompt", "Y"]


def test_running_sums_keep_null_order_values(spark):
    from ledgerflow.operators.windows import running_sums

    df = spark.createDataFrame([("a", None, "1", 1), ("a", 1, None, 2), ("a", 1, "1", 4), (None, 1, "1", 8)],
                               "k string, d int, v string, x long")
    got = running_sums(df, ["k"], ["d", "v", "x"], {"s": F.col("x")})
    assert sorted((r.k or "", r.s) for r in got.collect()) == [("", 8), ("a", 1), ("a", 3), ("a", 7)]


def test_totals_keep_alike_names_small_and_huge_balances(spark):
    from ledgerflow.operators import reports as RP

    led = spark.createDataFrame([("A  B", 0.004), ("A  B", 0.004), ("C", 1e20), ("D", -1e20)],
                                "ledger_name string, closing_balance double")
    r = led.agg(RP.money_sum("closing_balance").alias("s"), F.count("*").alias("n")).first()
    assert (round(r.s, 6), r.n) == (0.008, 4)


def test_a_whole_name_resolves_before_names_that_contain_it(spark):
    led = spark.createDataFrame([("Customer0000000",), ("Customer00000001",), ("Customer00000001",)], "ledger_name string")
    req = spark.createDataFrame([(1, "customer0000000"), (2, "customer"), (3, "omer00000001"), (4, "zz")],
                                "req_id long, request string")
    got = {r.req_id: (r.status, r.resolved_name, r.n_matches) for r in RS.resolve_status(req, led).collect()}
    assert got == {1: ("resolved", "Customer0000000", 1), 2: ("clarification", None, 2),
                   3: ("resolved", "Customer00000001", 1), 4: ("not_found", None, 0)}


def test_entry_fields_in_both_spellings(spark):
    from ledgerflow.sources import xml as X

    entry = "<ALLLEDGERENTRIES.LIST>{}</ALLLEDGERENTRIES.LIST>"
    body = "".join(entry.format(x) for x in (
        "<AMOUNT>5</AMOUNT><amount>7</amount>", "<amount>9</amount><AMOUNT>0</AMOUNT>", "<amount>-3</amount>", ""))
    recs = spark.createDataFrame([(f"<VOUCHER><DATE>20230401</DATE>{body}</VOUCHER>",)], "xml string")
    got = X.flatten_entries(X.parse_vouchers(recs)).orderBy("entry_no").collect()
    assert [r.amount_text for r in got] == ["5", "9", "-3", "0"]


def test_settled_books_say_so(spark):
    from ledgerflow.operators import reports as RP

    led = spark.createDataFrame([("A", "Sundry Debtors", 0.0, 0.0)],
                                "ledger_name string, parent string, opening_balance double, closing_balance double")
    rows = RP.pending_report(led).collect()
    assert [(r.ledger_name, r.total_pending) for r in rows] == [(RP.ALL_SETTLED, 0)]


def test_reconcile_covers_ledgers_without_entries(spark):
    from ledgerflow.operators import statement as ST

    led = spark.createDataFrame([("A", "A", 5.0, 9.0, "A", "p")], "ledger_name string, name_key string, opening_balance "
                                "double, closing_balance double, ledger_name_raw string, parent string")
    ent = spark.createDataFrame([], "party_key string, debit_amount double, credit_amount double")
    r = ST.reconcile(led, ent).first()
    assert (r.n_entries, r.computed_closing, r.drift, r.ok) == (0, 5.0, -4.0, False)


def test_reports_on_ledgers_alone_store_no_entries(spark, tmp_path, monkeypatch):
    import os

    from ledgerflow.jobs import JOBS
    from ledgerflow.sources import store
    from tests.conftest import SMOKE

    for f in os.listdir(SMOKE):
        os.symlink(f"{SMOKE}/{f}", tmp_path / f)

    def refuse(*args):
        raise AssertionError("entries stored")

    monkeypatch.setattr(store, "write_entries", refuse)
    got = JOBS["debtor_groups"](spark, str(tmp_path)).collect()
    assert len(got) > 0
    monkeypatch.undo()
    assert sorted(map(str, got)) == sorted(map(str, JOBS["debtor_groups"](spark, SMOKE).collect()))
    assert JOBS["available_years"](spark, str(tmp_path)).count() > 0 and store.entries(spark, str(tmp_path)).count() > 0


def test_exports_of_both_snapshots_are_built_once(spark, tmp_path, monkeypatch):
    import os

    from ledgerflow.jobs import JOBS
    from ledgerflow.sources import fixtures as FX
    from tests.conftest import SMOKE

    for f in os.listdir(SMOKE):
        os.symlink(f"{SMOKE}/{f}", tmp_path / f)
    build, calls = FX.voucher_xml_records, []
    monkeypatch.setattr(FX, "voucher_xml_records", lambda t: calls.append(1) or build(t))
    got = JOBS["sink_voucher_snapshot"](spark, str(tmp_path))
    now = JOBS["scan_voucher_xml"](spark, str(tmp_path)).select(*got.columns)
    assert len(calls) == 1 and got.count() > 0
    assert got.exceptAll(now).isEmpty() and now.exceptAll(got).isEmpty()
