"""Answer rows, request resolution, search by groups, all pages, exact money, invoice order."""

import datetime as dt
import random
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions.numbers import exact_sum, joined, money2
from ledgerflow.operators import receivable as RV
from ledgerflow.operators import reports as RP
from ledgerflow.operators import resolve as RS
from ledgerflow.operators import statement as ST
from ledgerflow.plans import answer as AN

FY = "1996-1997"
LEDGERS = ("ledger_name string, parent string, opening_balance double, closing_balance double, altered_on date, "
           "name_key string, ledger_name_raw string, parent_raw string")
ENTRIES = ("date date, voucher_type string, voucher_no string, entry_no int, party_name string, particulars string, "
           "debit_amount double, credit_amount double, party_key string")


def ledger(name, parent="Sundry Debtors", opening=0.0, closing=0.0, altered=None):
    return (name, parent, opening, closing, altered, name, name, parent)


def entry(party, day, no, debit=0.0, credit=0.0, kind="Sales Invoice", entry_no=1, what="goods"):
    return (dt.date(1996, 5, day), kind, str(no), entry_no, party, what, debit, credit, party)


@pytest.fixture(scope="module")
def tables(spark):
    led = [ledger("Alpha Traders", opening=10.0, closing=120.0, altered=dt.date(2001, 2, 3)),
           ledger("Alpha Stores", "Sundry Creditors", 5.0, -40.0, dt.date(2002, 1, 1)),
           ledger("Beta Mills", closing=70.0, altered=dt.date(2001, 7, 7)), ledger("Gamma", "Beta Group", 1.0, 2.0),
           ledger("Profit  Loss Ac", "Primary", 3.0, 9.0), ledger(None, None, 1.0, 1.0)]
    ent = [entry("Beta Mills", d, d, credit=10.0 * d) for d in range(1, 14)]
    ent += [entry("Alpha Traders", 2, 50, debit=30.0, kind="Receipt")]
    return spark.createDataFrame(led, LEDGERS), spark.createDataFrame(ent, ENTRIES)


QUESTIONS = [
    ("q1", "balance of beta mills"), ("q2", "opening balance of alpha traders"), ("q3", "balance of alpha"),
    ("q4", "parent of gamma"), ("q5", "compare difference details of beta mills"), ("q6", "search for alpha"),
    ("q7", "find information about beta"), ("q8", "statement of beta mills"), ("q9", "statement"),
    ("q10", "statement of nobody"), ("q11", "BR of beta mills"), ("q12", "BR of gamma"), ("q13", "top 2 parties"),
    ("q14", "lowest 1 parties in 2001"), ("q15", "highest paying parties in 2030"), ("q16", "business summary"),
    ("q17", "hello"), ("q18", "balance_query_prompt"), ("q19", "balance"), ("q20", "profit in 2000"),
    ("q21", "statement of beta mills"), ("q22", None), ("q23", ""), ("q24", "who is nobody at all of balance of zzz"),
    ("q25", "pending_analysis"), ("q26", "trend_analysis"), ("q27", "profit_loss_report"), ("q28", "statement of alpha")]


def answers(spark, tables):
    q = spark.createDataFrame(QUESTIONS, "q_id string, question string")
    rows = AN.answer_rows(q, *tables, FY).withColumn("json", F.to_json("row")).drop("row").collect()
    out = {}
    for r in rows:
        out.setdefault(r["q_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["seq"]) for k, v in out.items()}


def test_every_question_is_answered_by_its_reports_rows(spark, tables):
    import json

    got = answers(spark, tables)
    row = lambda q, i=0: json.loads(got[q][i]["json"])
    status = {q: got[q][0]["status"] for q in got}
    assert set(got) == {q for q, _ in QUESTIONS}
    assert row("q1")["ledger_name"] == "Beta Mills" and row("q1")["balance"] == 70.0
    assert row("q2")["balance"] == 10.0 and row("q2")["balance_type"] == "opening"
    assert status["q3"] == "clarification" and [row("q3", i)["ledger_name"] for i in (0, 1)] == ["Alpha Stores", "Alpha Traders"]
    assert row("q4")["parent"] == "Beta Group" and status["q5"] == "answered"
    assert status["q6"] == "clarification"  # no pattern takes a name from it
    hits = [json.loads(r["json"]) for r in got["q7"]]
    assert [(h["ledger_name"], h["hit_rank"]) for h in hits] == [("Beta Mills", 0), ("Gamma", 1)]
    led, ent = tables
    st = {(r["seq"], r["voucher_no"], r["balance"]) for r in ST.fy_statement(led, ent, FY).where("ledger_name = 'Beta Mills'").collect()}
    for q in ("q8", "q21"):
        mine = [json.loads(r["json"]) for r in got[q]]
        assert {(m["seq"], m["voucher_no"], float(m["balance"])) for m in mine} == st
    br = {(r["seq"], r["br_no"], r["amount"]) for r in RV.bills_receivable(led, ent, FY).where("ledger_name = 'Beta Mills'").collect()}
    assert {(m["seq"], m["br_no"], float(m["amount"])) for m in (json.loads(r["json"]) for r in got["q11"])} == br
    assert status["q9"] == "clarification" and status["q10"] == "not_found" and status["q12"] == "no_data"
    assert [row("q13", i)["ledger_name"] for i in (0, 1)] == ["Alpha Traders", "Beta Mills"] and len(got["q13"]) == 2
    assert row("q14")["ledger_name"] == "Beta Mills" and len(got["q14"]) == 1
    assert status["q15"] == "no_data" and [row("q15", i)["year"] for i in (0, 1)] == [2001, 2002]
    assert len(got["q16"]) == RP.business_summary(led).count() and len(got["q20"]) == RP.financial_analysis(led).count()
    assert len(got["q25"]) == RP.pending_report(led).count() and len(got["q26"]) == RP.trend_snapshot(led).count()
    assert len(got["q27"]) == RP.pnl_report(led).count()
    assert [status[q] for q in ("q17", "q18", "q19", "q22", "q23")] == ["help", "prompt", "clarification", "help", "help"]
    assert status["q24"] == "not_found" and row("q28")["ledger_name"] == "Alpha Stores"


def test_requests_resolve_to_the_first_or_to_the_only_ledger(spark, tables):
    names = ["alpha", "ALPHA stores", "beta", "nobody", None, "a"]
    req = spark.createDataFrame(list(enumerate(names)), "q_id int, request string")
    for mode, want in (("first", [("answered", "Alpha Stores"), ("answered", "Alpha Stores"), ("answered", "Beta Mills"),
                                  ("not_found", None), ("clarification", None), ("answered", "Alpha Stores")]),
                       ("unique", [("clarification", None), ("answered", "Alpha Stores"), ("answered", "Beta Mills"),
                                   ("not_found", None), ("clarification", None), ("clarification", None)])):
        got = {r["q_id"]: r for r in AN.resolved_requests(req, tables[0], mode).collect()}
        assert [(got[i]["status"], got[i]["ledger_name"]) for i in range(len(names))] == want
        assert mode == "first" or got[0]["options"] == "Alpha Stores; Alpha Traders"
    with pytest.raises(ValueError):
        AN.resolved_requests(req, tables[0], "any")


def test_search_counts_group_hits_without_listing_them(spark):
    rng = random.Random(2)
    names = [f"{rng.choice('ab')}{rng.choice('xyz')} {i}" for i in range(400)]
    rows = [ledger(n, "Big xy Group" if i % 10 else rng.choice(["ax", "zz top", None])) for i, n in enumerate(names)]
    rows += rows[:5]  # whole-row duplicates count once
    led = spark.createDataFrame(rows, LEDGERS)
    asks = ["xy", "ax", "a", "group", "zz", "BX 1", "nothing", "top"]
    req = spark.createDataFrame(list(enumerate(asks)), "req_id int, request string")
    got = RS.ledger_search(req, led, k=15).collect()
    for i, ask in enumerate(asks):
        hit = sorted({(0 if ask.lower() in n.lower() else 1, n, p) for n, p, *_ in rows
                      if ask.lower() in n.lower() or (p and ask.lower() in p.lower())})
        mine = sorted((r for r in got if r["req_id"] == i), key=lambda r: r["rank"] or 0)
        assert mine[0]["n_matches"] == len(hit)
        if hit:
            assert [(r["hit_rank"], r["ledger_name"], r["parent"]) for r in mine] == hit[:15]
    plan = RS.ledger_search(req, led)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_all_pages_are_the_single_pages(spark):
    rng = random.Random(1)
    rows = [(f"n{i}", float(rng.choice([1, 2, 2, 2, 3])), "p") for i in range(407)] + [(None, 2.0, None), ("n7", 2.0, "p")]
    df = spark.createDataFrame(rows, "ledger_name string, closing_balance double, parent string")
    every = RP.paginate_all(df, RP.pending_order())
    got = sorted(every.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1))
    whole = df.orderBy(*RP.pending_order()).collect()
    assert [tuple(r)[:3] for r in got] == [tuple(r) for r in whole]
    last = RP.paginate(df, RP.pending_order(), 28).collect()
    assert sorted(r["rank"] for r in last) == [r["rank"] for r in got if r["page"] == 28]
    assert (got[-1]["first_row"], got[-1]["last_row"], got[-1]["rows"]) == (406, 409, 409)
    for node in every._jdf.queryExecution().executedPlan().toString().split("\n"):
        assert "Window [" not in node or "__range" in node.split("], [")[1]
    assert RP.paginate_all(df.limit(0), RP.pending_order()).count() == 0


def test_sums_are_exact_at_any_size(spark):
    rng = random.Random(4)
    any_size = lambda e: round(rng.choice([1, -1]) * rng.random() * 10.0 ** e, 12)
    groups = [[any_size(rng.randrange(-6, 37)) for _ in range(rng.randrange(1, 9))] for _ in range(300)]
    groups += [[1e33, 0.01, -1e33], [-0.25, -0.5], [2e17, 1.0, 0.1], [-3.0, 0.25], [0.1] * 10, [-1e-6], [9007199254740993.0, 0.5]]
    rows = [(g, x) for g, xs in enumerate(groups) for x in xs] + [(999, None), (999, float("nan"))]
    df = spark.createDataFrame(rows, "g int, x double").groupBy("g").agg(joined(*exact_sum("x")).alias("s"))
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["g"]: r["s"] for r in df.collect()}
    with localcontext() as c:
        c.prec = 80
        for g, xs in enumerate(groups):
            assert got[g] == float(sum(Decimal(x) if abs(x) >= 2 ** 53 else Decimal(repr(x)) for x in xs)), xs
    assert got[999] == 0.0


def test_large_amounts_stay_in_the_running_balance(spark):
    led = spark.createDataFrame([ledger("A", opening=0.5)], LEDGERS)
    ent = spark.createDataFrame([entry("A", 1, 1, debit=2e17), entry("A", 2, 2, debit=1.0), entry("A", 3, 3, credit=2e17),
                                 entry("A", 4, 4, debit=1e33)], ENTRIES)
    got = sorted(ST.fy_statement(led, ent, FY).collect(), key=lambda r: r["seq"])
    assert [r["balance"] for r in got[:-1]] == [0.5, 2e17, 2e17, 1.5, 1e33]
    assert ST.reconcile(led, ent).first()["computed_closing"] == 1e33
    huge = spark.createDataFrame([(1e36,)], "x double").select(money2("x"))
    with pytest.raises(Exception, match="1e36"):
        huge.collect()


@pytest.mark.parametrize("flip", [False, True])
def test_first_invoices_do_not_depend_on_row_order(spark, flip):
    led = spark.createDataFrame([ledger("A")], LEDGERS)
    rows = [entry("A", 1, 1, credit=10.0, kind="Sales"), entry("A", 1, 1, credit=20.0, kind="Invoice")]
    ent = spark.createDataFrame(rows[::-1] if flip else rows, ENTRIES).coalesce(1)
    br = RV.bills_receivable(led, ent, FY).collect()
    assert sorted((r["seq"], r["amount"]) for r in br) == [(1, 20.0), (2, 10.0)]


def test_reports_read_their_table_at_most_twice(spark, tables, tmp_path):
    tables[0].write.parquet(str(tmp_path / "ledgers"))
    led = spark.read.parquet(str(tmp_path / "ledgers"))
    for report, most in ((RP.financial_analysis, 2), (RP.trend_snapshot, 2), (RP.business_summary, 3), (RP.pnl_report, 1)):
        plan = report(led)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= most, report


def test_reports_of_empty_and_dateless_tables(spark, tables):
    led, _ = tables
    none = led.limit(0)
    rows = lambda df: sorted((r["section"], r["rank"], r["name"], r["amount"]) for r in df.collect())
    assert rows(RP.business_summary(none)) == [("avg_balance", None, None, None), ("max_balance", None, None, None),
                                               ("min_balance", None, None, None), ("total_balance", None, None, 0.0),
                                               ("total_parties", None, None, 0.0)]
    assert rows(RP.trend_snapshot(led.where("altered_on is null"))) == [("no_dates", None, None, None)]
    assert rows(RP.trend_snapshot(none)) == [("no_dates", None, None, None)]
    assert rows(RP.financial_analysis(none)) == [("assets", None, None, 0.0), ("liabilities", None, None, 0.0),
                                                 ("net_position", None, None, 0.0)]
    assert rows(RP.pnl_report(none)) == [("not_found", None, None, None)]
    other = led.where("ledger_name is null or not contains(ledger_name, 'Profit')")
    got = RP.financial_analysis(other).collect()
    assert {r["section"] for r in got} == {"assets", "liabilities", "net_position", "top_asset", "top_liability"}
    assert [r["name"] for r in sorted(got, key=lambda r: r["rank"] or 0) if r["section"] == "top_asset"] == [
        "Alpha Traders", "Beta Mills", "Gamma"]
    card = {r["section"]: r["amount"] for r in RP.financial_analysis(led).collect() if r["rank"] is None}
    assert card == {"pnl_closing": 9.0, "pnl_opening": 3.0, "net_profit": 6.0}
    assert [r["name"] for r in sorted(RP.pnl_report(led).collect(), key=lambda r: r["rank"] or 0) if r["section"] == "top_party"][:2] == [
        "Alpha Traders", "Beta Mills"]


PIECES = ["a", "b", "ab", "ba ", ".", ".*", "a?", "b+", "(ab)", "(a|b)", "[ab]", "[^a]", "a{2}", "b{1,2}", "^", "$", "\\.", "\\(", "\\w",
          "|", "x*", "(?:b)", "(", "[", "c", "C", "(?i)", "*", "]", "}", "é", "\\d"]


def test_regex_joins_match_searching_everything(spark):
    import re

    from ledgerflow.operators import regexjoin

    rng = random.Random(9)
    texts = ["".join(rng.choice("aabbc .(éA1") for _ in range(rng.randrange(0, 12))) for _ in range(150)] + ["a(b", "A.B (P) Ltd"]
    pats = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 6))) for _ in range(900)] + ["a(", "a.b (p)", "ltd$"]
    led = spark.createDataFrame([ledger(t) for t in texts] + [ledger(None)], LEDGERS)
    req = spark.createDataFrame(list(enumerate(pats)) + [(9999, None), (9998, "")], "req_id int, request string")
    hits, bad = RS.regex_matches(req, led.select("ledger_name").distinct())
    want, errors = set(), set()
    for i, p in enumerate(pats):
        try:
            c = re.compile(p.lower())
        except re.error:
            errors.add(i)
            continue
        want |= {(i, t) for t in texts if c.search(t.lower())}
        lits = regexjoin.literals(p.lower())
        assert lits is None or all(any(x in t.lower() for x in lits) for t in texts if c.search(t.lower())), p
    assert {(r["req_id"], r["ledger_name"]) for r in hits.collect()} == want
    assert {r["req_id"] for r in bad.collect()} == errors and len(errors) > 50
    assert sum(regexjoin.literals(p.lower()) is not None for p in pats) > 300
    status = {r["req_id"]: r["status"] for r in RS.regex_status(req, led).collect()}
    assert status[900] == "bad_pattern" and status[9999] == "not_found" and status[902] == "found"
    # what is written 'a.b (p)' is no match of itself, but it is in a name
    mean = {(r["req_id"], r["ledger_name"]) for r in RS.did_you_mean(req, led).collect()}
    assert (901, "A.B (P) Ltd") in mean and not {i for i, _ in mean} & ({i for i, _ in want} | errors)


def test_statements_fail_as_rows_and_keep_their_order(spark, tables):
    from ledgerflow.operators.passthrough import run_statements

    tables[0].createOrReplaceTempView("t_ledgers")
    rows = run_statements(spark, [
        ("a", "SELECT ledger_name AS n, closing_balance AS c FROM t_ledgers WHERE ledger_name > :x ORDER BY closing_balance DESC",
         {"x": "Al"}),
        ("b", "SELECT 1 AS n WHERE false", None), ("c", "SELEC 1", None), ("d", "SELECT * FROM no_such_view", None),
        ("e", "SELECT CAST('x' AS INT) AS n", None), ("f", "SELECT :y AS n", None), ("g", "SELECT named_struct('p', 1) AS n", None)])
    got = {}
    for r in rows.withColumn("n", F.try_variant_get("row", "$.n", "string")).orderBy("statement", "seq").collect():
        got.setdefault(r["statement"], []).append((r["status"], r["n"], r["error"]))
    assert [n for _, n, _ in got["a"]] == ["Alpha Traders", "Beta Mills", "Profit  Loss Ac", "Gamma", "Alpha Stores"]
    assert [got[x][0][0] for x in "bcdefg"] == ["empty", "error", "error", "error", "error", "ok"]
    assert got["c"][0][2] == "PARSE_SYNTAX_ERROR" and got["d"][0][2] == "TABLE_OR_VIEW_NOT_FOUND"
    assert "CAST_INVALID_INPUT" in got["e"][0][2]


def test_contained_names_are_listed_for_whole_names_too(spark):
    led = spark.createDataFrame([ledger("Acme"), ledger("Acme Stores"), ledger("Beta"), ledger(None)], LEDGERS)
    req = spark.createDataFrame([(1, "acme"), (2, "eta"), (3, "zz"), (4, None)], "req_id int, request string")
    got = RS.resolve_contains(req, led).select("req_id", "ledger_name").collect()
    assert sorted(map(tuple, got)) == [(1, "Acme"), (1, "Acme Stores"), (2, "Beta")]


def test_names_are_suggested_for_found_requests_too(spark):
    led = spark.createDataFrame([ledger(f"Acme {i}") for i in range(7)] + [ledger("Acme 1"), ledger(None)], LEDGERS)
    req = spark.createDataFrame([(1, "acme"), (1, "acme"), (2, "ACME 6"), (3, "zz"), (4, None), (5, "acme")],
                                "req_id int, request string")
    got = RS.did_you_mean(req, led, missed_only=False).collect()
    first = [(i + 1, f"Acme {i}") for i in range(5)]
    assert sorted((r["req_id"], r["rank"], r["ledger_name"]) for r in got) == sorted(
        [(1, *x) for x in first] + [(5, *x) for x in first] + [(2, 1, "Acme 6")])


def test_regex_candidates_come_from_the_rarest_literal(spark):
    from ledgerflow.operators import regexjoin

    assert regexjoin.needed("cust.*0+7$|a[bc]de") == [["0", "7", "cust"], ["a", "de"]] and regexjoin.needed("x|.*") is None
    names = [f"Customer {i:04d}" for i in range(400)] + ["Customer 0007"]
    led = spark.createDataFrame([ledger(n) for n in names] + [ledger(None)], LEDGERS)
    req = spark.createDataFrame([(i, "cust.*0007$" if i % 2 else "cust.*zz$") for i in range(40)] + [(1, "^c"), (99, "a(")],
                                "req_id int, request string")
    planned, pairs = RS.regex_plan(req, led, "ledger_name")
    assert sorted(map(tuple, pairs.where("pattern <> '^c'").collect())) == [("cust.*0007$", "Customer 0007")]
    status = RS.regex_status(req, led)
    got = {(r["req_id"], r["request"]): (r["status"], r["n_matches"], r["first_match"]) for r in status.collect()}
    assert got[3, "cust.*0007$"] == ("found", 2, "Customer 0007") and got[2, "cust.*zz$"] == ("not_found", 0, None)
    # rows with one req_id count together
    assert got[1, "^c"] == ("found", 403, "Customer 0000") and got[99, "a("][:2] == ("bad_pattern", 0)
    # a pattern's hits are counted before they meet the requests
    plan = status._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(copies" in plan


def test_fallback_lists_the_first_debtors_of_a_key_before_joining_them(spark):
    led = spark.createDataFrame([ledger(f"Acme {i}", closing=-1.0 - i if i != 2 else 5.0) for i in range(9)]
                                + [ledger("Acme", "Bank"), ledger(None)], LEDGERS)
    rows = RV.debtor_fallback(led, led.select("ledger_name", "name_key").where("ledger_name in ('Acme', 'Acme 7')"), FY)
    got = sorted((r["ledger_name"], r["seq"], r["party"], r["amount"]) for r in rows.collect())
    assert got == [("Acme", 1, "Acme 0", 1.0), ("Acme", 2, "Acme 1", 2.0), ("Acme", 4, "Acme 3", 4.0), ("Acme", 5, "Acme 4", 5.0),
                   ("Acme 7", 1, "Acme 7", 8.0)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit [pattern" in plan and "Partial" in plan


def test_br_requests_list_every_invoice_and_every_debtor(spark):
    names = [f"Delta House {i:04d}" for i in range(1203)]
    led = [ledger("Many Bills", "Bank Accounts"), ledger("Delta House", "Bank Accounts"), ledger("Lonely", "Primary")]
    led += [ledger(n, closing=float(i % 3 - 1)) for i, n in enumerate(names)]
    ent = [entry("Many Bills", 1 + i % 28, 100 + i, credit=1.0 + i) for i in range(25)]
    tables = spark.createDataFrame(led, LEDGERS), spark.createDataFrame(ent, ENTRIES)
    q = spark.createDataFrame([("a", "BR of many bills"), ("b", "BR of delta house"), ("c", "BR of lonely"),
                               ("d", "BR of many bills")], "q_id string, question string")
    got = {}
    for r in AN.br_requests(q, *tables, FY).collect():
        got.setdefault(r["q_id"], []).append(r)
    for x in "ad":
        rows = sorted(got[x], key=lambda r: r["seq"])
        want = sorted(ent, key=lambda e: (e[0], e[2]))
        assert [(r["seq"], r["br_no"], r["amount"], r["br_date"]) for r in rows] == [
            (i + 1, e[2], e[7], e[0]) for i, e in enumerate(want)]
        assert {r["total_br"] for r in rows} == {sum(1.0 + i for i in range(25))}
    # no debtor is asked for by itself
    rows = sorted(got["b"], key=lambda r: r["seq"])
    assert [(r["seq"], r["br_no"], r["party"]) for r in rows] == [
        (i + 1, f"BR-{i + 1:03d}", n) for i, n in enumerate(names) if i % 3 == 0]
    assert rows[3]["br_date"] == dt.date(1996, 4, 1) + dt.timedelta(days=15 * 9) and rows[0]["total_br"] == 401.0
    assert set(got) == {"a", "b", "d"}
    capped = RV.bills_receivable(*tables, FY).groupBy("ledger_name").count().collect()
    assert {r["ledger_name"]: r["count"] for r in capped}["Many Bills"] == 10
    some = RV.bills_receivable(tables[0].where("ledger_name = 'Delta House'"), tables[1], FY, tables[0])
    assert sorted(r["seq"] for r in some.collect()) == [1, 4]


def test_global_questions_are_answered_by_their_reports(spark, tables):
    extra = [ledger(f"Party {i:02d}", closing=float(i + 1)) for i in range(40)]
    led = tables[0].unionByName(spark.createDataFrame(extra, LEDGERS))
    q = spark.createDataFrame(QUESTIONS, "q_id string, question string")
    got = {r["q_id"]: r for r in AN.answer_questions(q, led, tables[1], FY).collect()}
    assert set(got) == {x for x, _ in QUESTIONS}
    metrics = RP.pending_metrics(led).first()
    text = got["q25"]["answer"].split("\n")
    assert got["q25"]["n_rows"] == RP.pending(led).count() == metrics["total_pending"] > RP.PAGE_SIZE
    assert text[:2] == ["avg_pending | %.2f" % metrics["avg_pending"], "pending | 1 | Alpha Traders | Sundry Debtors | 120.00"]
    assert text[-2:] == ["total_amount | %.2f" % metrics["total_amount"], "total_pending | %d.00" % metrics["total_pending"]]
    assert len(text) == 3 + RP.PAGE_SIZE
    for x, report in (("q16", RP.business_summary), ("q20", RP.financial_analysis), ("q26", RP.trend_snapshot), ("q27", RP.pnl_report)):
        rows = report(led).collect()
        lines = sorted(" | ".join(str(v) for v in (r["section"], r["rank"], r["name"], r["parent"]) if v is not None)
                       + ("" if r["amount"] is None else f" | {r['amount']:.2f}") for r in rows)
        assert sorted(got[x]["answer"].split("\n")) == lines and got[x]["n_rows"] == len(rows)
    assert got["q1"]["answer"] is None and got["q17"]["answer"] is None
    none = {r["q_id"]: r for r in AN.answer_questions(q, led.limit(0), tables[1], FY).collect()}
    assert none["q25"]["n_rows"] == 1 and RP.ALL_SETTLED in none["q25"]["answer"]


def test_grams_and_patterns_stay_out_of_the_driver(spark, monkeypatch):
    from ledgerflow.operators import textjoin

    texts = [f"Customer{i:05d}" for i in range(300)] + ["ab", "Ab c", ""]
    pats = ["customer001", "00", "B", "r0029", "zz", "customer00299x", "ab C", "mer"]
    t, p = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in pats], "p string")
    want = {(a, b) for a in pats for b in texts if a.lower() in b.lower()}
    for n in (1, 2, textjoin.FREQ_BUCKETS):  # whatever share a bucket, all pairs are found
        monkeypatch.setattr(textjoin, "FREQ_BUCKETS", n)
        pairs = textjoin.contains_pairs(p, "p", t, "t")
        assert {tuple(r) for r in pairs.collect()} == want
    led = spark.createDataFrame([ledger(x) for x in texts], LEDGERS)
    req = p.select(F.monotonically_increasing_id().alias("req_id"), F.explode(F.array("p", F.concat("p", F.lit("(")))).alias("request"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [gram" in plan(pairs) and "BroadcastHashJoin [gram" not in plan(pairs)
    assert all(f"BroadcastHashJoin [{c}" not in plan(RS.regex_status(req, led)) for c in ("text", "request", "pattern"))
    got = {r["request"]: (r["status"], r["n_matches"]) for r in RS.regex_status(req, led).collect()}
    assert got["00"] == ("found", sum("00" in x for x in texts)) and got["zz("] == ("bad_pattern", 0)
