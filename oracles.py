"""DuckDB oracle SQL, written from the semantics, not from the Spark plans.

Every query starts with the binding CTEs (``entries``, ``ledgers`` and friends)
over the driver's pre-registered views.
"""

from __future__ import annotations

# --- fixed values shared with the library (regex classes, see functions/text.py)
WS = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"
KEEP = r"\p{L}\p{N}_ ().\-"
FY = "1996-1997"
FY_START, FY_END = "1996-04-01", "1997-03-31"


def norm(x: str) -> str:
    """One pass of the name normaliser as DuckDB SQL."""
    s = f"coalesce(CAST({x} AS VARCHAR), '')"
    s = f"regexp_replace({s}, '^[{WS}]+|[{WS}]+$', '', 'g')"
    s = f"regexp_replace({s}, '[{WS}]+', ' ', 'g')"
    return f"regexp_replace({s}, '[^{KEEP}]', '', 'g')"


def norm2(x: str) -> str:
    return norm(norm(x))


BINDINGS = f"""
WITH ve_raw AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date,
         CASE o.o_orderstatus WHEN 'F' THEN 'Sales Invoice' WHEN 'O' THEN 'Receipt'
                              WHEN 'P' THEN 'Journal' END AS voucher_type,
         CAST(o.o_orderkey AS VARCHAR) AS voucher_no,
         CAST(row_number() OVER (PARTITION BY l.l_orderkey
              ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS INTEGER) AS entry_no,
         c.c_name AS party_name,
         p.p_name AS particulars,
         CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) *
              CASE WHEN o.o_orderstatus = 'F' THEN -1 WHEN o.o_orderstatus = 'O' THEN 1
                   WHEN l.l_returnflag = 'R' THEN 1 ELSE -1 END AS DECIMAL(18,2)) AS amount,
         c.c_custkey AS party_id
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
cust_flow AS (
  SELECT party_id, SUM(amount) AS flow, MAX(date) AS last_date FROM ve_raw GROUP BY party_id
),
cust_led AS (
  SELECT c.c_name AS ledger_name,
         CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Sundry Debtors'
                             WHEN 'AUTOMOBILE' THEN 'Trade Receivables'
                             WHEN 'MACHINERY' THEN 'Duties & Taxes'
                             WHEN 'HOUSEHOLD' THEN 'Primary'
                             WHEN 'FURNITURE' THEN 'Bank Accounts' END AS parent,
         CAST(c.c_acctbal AS DECIMAL(18,2)) AS opening,
         CAST(c.c_acctbal AS DECIMAL(18,2)) + COALESCE(f.flow, 0) AS closing,
         f.last_date AS altered_on
  FROM customer c LEFT JOIN cust_flow f ON c.c_custkey = f.party_id
),
ledgers_raw AS (
  SELECT ledger_name, parent, CAST(opening AS DOUBLE) AS opening_balance,
         CAST(closing AS DOUBLE) AS closing_balance, altered_on FROM cust_led
  UNION ALL
  SELECT s_name, 'Sundry Creditors', CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE),
         CAST(CAST(-s_acctbal AS DECIMAL(18,2)) AS DOUBLE), CAST(NULL AS DATE) FROM supplier
  UNION ALL
  SELECT substr(ledger_name, 1, 16), 'Sundry Debtors', 0.0, CAST(SUM(closing) AS DOUBLE),
         CAST(NULL AS DATE) FROM cust_led GROUP BY substr(ledger_name, 1, 16)
  UNION ALL
  SELECT 'Profit & Loss A/c', 'Primary',
         CAST(COALESCE(SUM(CASE WHEN l_shipdate < TIMESTAMP '1996-04-01'
                                THEN CAST(l_extendedprice AS DECIMAL(18,2)) END), 0) AS DOUBLE),
         CAST(COALESCE(SUM(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE),
         CAST(NULL AS DATE) FROM lineitem
),
ledgers AS (
  SELECT {norm('ledger_name')} AS ledger_name,
         {norm('parent')} AS parent,
         opening_balance, closing_balance, altered_on,
         {norm2('ledger_name')} AS name_key,
         ledger_name AS ledger_name_raw, parent AS parent_raw
  FROM ledgers_raw
),
entries AS (
  SELECT date, voucher_type, voucher_no, entry_no,
         {norm('party_name')} AS party_name,
         particulars,
         CASE WHEN amount > 0 THEN CAST(abs(amount) AS DOUBLE) ELSE 0.0 END AS debit_amount,
         CASE WHEN amount < 0 THEN CAST(abs(amount) AS DOUBLE) ELSE 0.0 END AS credit_amount,
         {norm2('party_name')} AS party_key,
         amount
  FROM ve_raw
),
fy_e AS (
  SELECT * FROM entries WHERE date BETWEEN DATE '{FY_START}' AND DATE '{FY_END}'
)
"""


def q(body: str) -> str:
    """Binding CTEs + the query body (which may continue the WITH list with ', x AS (...)')."""
    body = body.strip()
    if body.startswith(","):
        return BINDINGS.rstrip() + "\n" + body
    return BINDINGS + body


FY_STATEMENT = q(f"""
, led AS (
  SELECT ledger_name, name_key, round_even(opening_balance, 2) AS opening,
         round_even(closing_balance, 2) AS closing FROM ledgers
),
ex AS (
  SELECT l.ledger_name, e.*, 'exact' AS source FROM led l JOIN fy_e e ON e.party_key = l.name_key
),
pa AS (
  SELECT l.ledger_name, e.*, 'partial' AS source
  FROM led l JOIN fy_e e ON contains(lower(e.party_key), lower(l.name_key))
  WHERE length(l.name_key) > 0
    AND NOT EXISTS (SELECT 1 FROM fy_e x WHERE x.party_key = l.name_key)
),
tx AS (SELECT * FROM ex UNION ALL SELECT * FROM pa),
body AS (
  SELECT t.ledger_name,
         CAST(row_number() OVER w AS INTEGER) AS seq,
         t.date, t.voucher_type, t.voucher_no, substr(t.particulars, 1, 50) AS particulars,
         t.debit_amount AS debit, t.credit_amount AS credit,
         CAST(CAST(l.opening AS DECIMAL(18,2)) + SUM(CAST(t.debit_amount AS DECIMAL(18,2))
              - CAST(t.credit_amount AS DECIMAL(18,2))) OVER w AS DOUBLE) AS balance,
         t.source
  FROM tx t JOIN led l USING (ledger_name)
  WINDOW w AS (PARTITION BY t.ledger_name ORDER BY t.date, t.voucher_no, t.voucher_type, t.entry_no, t.particulars,
               t.debit_amount, t.credit_amount
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
heads AS (
  SELECT l.ledger_name, l.opening, l.closing, COALESCE(c.n, 0) AS n,
         COALESCE(c.source, 'none') AS source
  FROM led l LEFT JOIN (SELECT ledger_name, COUNT(*) AS n, MAX(source) AS source
                        FROM tx GROUP BY ledger_name) c USING (ledger_name)
)
SELECT ledger_name, '{FY}' AS financial_year, seq, date, voucher_type, voucher_no,
       particulars, debit, credit, balance, source FROM (
  SELECT ledger_name, 0 AS seq, DATE '{FY_START}' AS date, 'Opening Balance' AS voucher_type,
         'OP-001' AS voucher_no, 'Opening Balance' AS particulars, 0.0 AS debit,
         CASE WHEN opening > 0 THEN opening ELSE 0.0 END AS credit, opening AS balance, source
  FROM heads
  UNION ALL SELECT * FROM body
  UNION ALL
  SELECT ledger_name, CAST(n + 1 AS INTEGER), DATE '{FY_END}', 'Closing Balance', 'CL-001',
         'Closing Balance', 0.0, closing, closing, source
  FROM heads
)
""")

ORACLES: dict[str, str] = {
    "fy_statement": FY_STATEMENT,
}


# --- group lists (normalised once, as the stored parent column) -------------------
INTERNAL_N = "('Primary', 'Reserves  Surplus', 'Duties  Taxes', 'GST', 'TDSTCS')"
INTERNAL_W = "('Primary', 'Reserves & Surplus', 'Duties & Taxes', 'GST', 'TDS/TCS')"
WIDE_N = ("('Primary', 'Reserves  Surplus', 'Duties  Taxes', 'GST', 'TDSTCS', 'Secured Loans', "
          "'Unsecured Loans', 'Current Liablities', 'Bank Accounts')")
WIDE_W = ("('Primary', 'Reserves & Surplus', 'Duties & Taxes', 'GST', 'TDS/TCS', 'Secured Loans', "
          "'Unsecured Loans', 'Current Liablities', 'Bank Accounts')")
NARROW_N = "('Primary', 'Reserves  Surplus', 'Duties  Taxes')"
DEBTOR_RE = "sundry debtors|accounts receivable|trade receivables|debtors"
LC = "ledger_name, parent, opening_balance, closing_balance, altered_on"


def biz(lst: str = INTERNAL_N) -> str:
    return f"(parent IS NULL OR parent NOT IN {lst})"


def dsum(c: str) -> str:
    return f"SUM(CAST({c} AS DECIMAL(18,2)))"


def msum(c: str) -> str:
    return f"CAST(COALESCE({dsum(c)}, 0) AS DOUBLE)"


def mmean(c: str) -> str:
    return f"CAST({dsum(c)} AS DOUBLE) / COUNT({c})"


REQUESTS = f"""
, cn AS (SELECT c_custkey, lower({norm('c_name')}) AS n FROM customer),
requests AS (
  SELECT c_custkey * 3 AS req_id, n AS request FROM cn
  UNION ALL SELECT c_custkey * 3 + 1, substr(n, 1, 16) FROM cn
  UNION ALL SELECT c_custkey * 3 + 2, n || ' zz' FROM cn
),
cm AS (
  SELECT r.req_id, r.request, l.* FROM requests r JOIN ledgers l
    ON contains(lower(l.ledger_name), lower(r.request)) WHERE length(r.request) > 0
),
cc AS (SELECT req_id, COUNT(*) AS n_matches FROM cm GROUP BY req_id)
"""

ORACLES.update({
    "business_filter": q(f"SELECT {LC} FROM ledgers WHERE {biz()}"),
    "business_filter_as_written": q(f"SELECT {LC} FROM ledgers WHERE {biz(INTERNAL_W)}"),
    "business_filter_wide": q(f"SELECT {LC} FROM ledgers WHERE {biz(WIDE_N)}"),
    "business_filter_narrow": q(f"SELECT {LC} FROM ledgers WHERE {biz(NARROW_N)}"),
    "nonzero_balance": q(f"SELECT {LC} FROM ledgers WHERE closing_balance <> 0 OR opening_balance <> 0"),
    "year_filter": q(f"SELECT {LC} FROM ledgers WHERE year(altered_on) = 2000"),
    "pnl_account": q(f"SELECT {LC} FROM ledgers WHERE contains(lower(ledger_name), 'profit  loss')"),
    "debtor_groups": q(f"SELECT {LC} FROM ledgers WHERE regexp_matches(lower(parent), '{DEBTOR_RE}')"),
    "has_date": q(f"SELECT {LC} FROM ledgers WHERE altered_on IS NOT NULL"),
    "receivable_only": q(f"SELECT {LC} FROM ledgers WHERE regexp_matches(lower(parent), '{DEBTOR_RE}') "
                         "AND closing_balance < 0"),
    "fy_filter": q("SELECT date, voucher_type, voucher_no, entry_no, party_name, particulars, "
                   "debit_amount, credit_amount, party_key FROM fy_e"),
    "classify_vouchers": q("""
SELECT voucher_no, entry_no, voucher_type, debit_amount, credit_amount,
       CASE WHEN credit_amount > 0 AND regexp_matches(lower(voucher_type), 'invoice|sales|bill') THEN 'sale'
            WHEN debit_amount > 0 AND regexp_matches(lower(voucher_type), 'payment|receipt|cash') THEN 'payment'
       END AS voucher_class
FROM entries"""),
    "sign_split": q("""
SELECT ledger_name, closing_balance,
       CASE WHEN closing_balance > 0 THEN 'positive' WHEN closing_balance < 0 THEN 'negative'
            ELSE 'zero' END AS side FROM ledgers"""),
    "pending_metrics": q(f"""
SELECT COUNT(*) AS total_pending, {msum('closing_balance')} AS total_amount,
       {mmean('closing_balance')} AS avg_pending
FROM ledgers WHERE (closing_balance <> 0 OR opening_balance <> 0) AND {biz()}"""),
    "summary_stats": q(f"""
SELECT COUNT(*) AS total_parties, {msum('closing_balance')} AS total_balance,
       {mmean('closing_balance')} AS avg_balance, MAX(closing_balance) AS max_balance,
       MIN(closing_balance) AS min_balance FROM ledgers"""),
    "group_totals": q(f"""
, g AS (SELECT parent, {msum('closing_balance')} AS group_balance FROM ledgers WHERE {biz()} GROUP BY parent)
SELECT parent, group_balance, row_number() OVER (ORDER BY group_balance DESC, parent ASC NULLS FIRST) AS rank
FROM g ORDER BY group_balance DESC, parent ASC NULLS FIRST LIMIT 5"""),
    "net_position": q(f"""
, s AS (SELECT COALESCE(SUM(CASE WHEN closing_balance > 0 THEN CAST(closing_balance AS DECIMAL(18,2)) END), 0) AS p,
               COALESCE(SUM(CASE WHEN closing_balance < 0 THEN CAST(closing_balance AS DECIMAL(18,2)) END), 0) AS n
        FROM ledgers WHERE {biz(WIDE_N)})
SELECT CAST(p AS DOUBLE) AS assets, CAST(abs(n) AS DOUBLE) AS liabilities, CAST(p + n AS DOUBLE) AS net_position FROM s"""),
    "net_profit": q("""
SELECT ledger_name AS account, closing_balance AS pnl_closing, opening_balance AS pnl_opening,
       CAST(CAST(closing_balance AS DECIMAL(18,2)) - CAST(opening_balance AS DECIMAL(18,2)) AS DOUBLE) AS net_profit
FROM ledgers WHERE contains(lower(ledger_name), 'profit  loss') ORDER BY ledger_name LIMIT 1"""),
    "available_years": q("SELECT DISTINCT year(altered_on) AS year FROM ledgers WHERE altered_on IS NOT NULL"),
    "trend_totals": q(f"SELECT COUNT(*) AS total_parties, {msum('closing_balance')} AS net_balance FROM ledgers"),
    "has_any_date": q("SELECT COUNT(altered_on) > 0 AS has_dates FROM ledgers"),
    "row_and_page_counts": q(f"""
, p AS (SELECT COUNT(*) AS n FROM ledgers WHERE (closing_balance <> 0 OR opening_balance <> 0) AND {biz()}),
a AS (SELECT COUNT(*) AS n FROM ledgers), b AS (SELECT COUNT(*) AS n FROM entries)
SELECT 'pending' AS "table", n AS rows, CAST(ceil(n / 15) AS BIGINT) AS pages FROM p
UNION ALL SELECT 'ledgers', n, CAST(ceil(n / 15) AS BIGINT) FROM a
UNION ALL SELECT 'voucher_entries', n, CAST(ceil(n / 15) AS BIGINT) FROM b"""),
    "top_k_closing": q(f"""
SELECT row_number() OVER (ORDER BY closing_balance DESC, ledger_name) AS rank, ledger_name, closing_balance, parent
FROM ledgers WHERE {biz()} ORDER BY closing_balance DESC, ledger_name LIMIT 5"""),
    "rank_number": q(f"""
SELECT row_number() OVER (ORDER BY closing_balance DESC, ledger_name) AS rank, ledger_name
FROM ledgers WHERE {biz()} ORDER BY closing_balance DESC, ledger_name LIMIT 5"""),
    "bottom_k_closing": q(f"""
SELECT row_number() OVER (ORDER BY closing_balance ASC, ledger_name) AS rank, ledger_name, closing_balance, parent
FROM ledgers WHERE {biz()} ORDER BY closing_balance ASC, ledger_name LIMIT 5"""),
    "recent_k": q("""
SELECT row_number() OVER (ORDER BY altered_on DESC, ledger_name) AS rank, ledger_name, closing_balance, altered_on
FROM ledgers WHERE altered_on IS NOT NULL ORDER BY altered_on DESC, ledger_name LIMIT 5"""),
})

PENDING = f"""
, pend AS (
  SELECT ledger_name, closing_balance, parent,
         row_number() OVER (ORDER BY closing_balance DESC, ledger_name) AS rank
  FROM ledgers WHERE (closing_balance <> 0 OR opening_balance <> 0) AND {biz()}
)
"""

ORACLES.update({
    "sort_head": q(PENDING + "SELECT ledger_name, closing_balance, parent, rank FROM pend WHERE rank <= 15"),
    "paginate": q(PENDING + "SELECT ledger_name, closing_balance, parent, rank FROM pend "
                            "WHERE rank BETWEEN 16 AND 30"),
    "paginate_all": q(PENDING + """
, n AS (SELECT COUNT(*) AS n FROM pend)
SELECT ledger_name, closing_balance, parent, rank, CAST((rank + 14) // 15 AS BIGINT) AS page,
       CAST((rank - 1) // 15 * 15 + 1 AS BIGINT) AS first_row,
       CAST(least(((rank + 14) // 15) * 15, n) AS BIGINT) AS last_row, n AS rows
FROM pend, n"""),
    "pending_report": q(PENDING + f"""
, m AS (SELECT COUNT(*) AS total_pending, {msum('closing_balance')} AS total_amount,
               {mmean('closing_balance')} AS avg_pending FROM pend)
SELECT rank, ledger_name, closing_balance, parent, 1 AS page, total_pending, total_amount, avg_pending,
       CAST(ceil(total_pending / 15) AS BIGINT) AS pages
FROM pend, m WHERE rank <= 15"""),
})


def _fin(pattern: str, lst_biz: str, lst_wide: str) -> str:
    return q(f"""
, card AS (
  SELECT ledger_name AS account, closing_balance AS pnl_closing, opening_balance AS pnl_opening,
         CAST(CAST(closing_balance AS DECIMAL(18,2)) - CAST(opening_balance AS DECIMAL(18,2)) AS DOUBLE) AS net_profit
  FROM ledgers WHERE contains(lower(ledger_name), '{pattern}') ORDER BY ledger_name LIMIT 1
),
found AS (SELECT COUNT(*) > 0 AS f FROM card),
topp AS (
  SELECT row_number() OVER (ORDER BY closing_balance DESC, ledger_name) AS rank, ledger_name, parent, closing_balance
  FROM ledgers WHERE {biz(lst_biz)} ORDER BY closing_balance DESC, ledger_name LIMIT 5
),
wide AS (SELECT * FROM ledgers WHERE {biz(lst_wide)}),
pos AS (
  SELECT COALESCE(SUM(CASE WHEN closing_balance > 0 THEN CAST(closing_balance AS DECIMAL(18,2)) END), 0) AS p,
         COALESCE(SUM(CASE WHEN closing_balance < 0 THEN CAST(closing_balance AS DECIMAL(18,2)) END), 0) AS n
  FROM wide
),
ta AS (SELECT row_number() OVER (ORDER BY closing_balance DESC, ledger_name) AS rank, ledger_name, closing_balance
       FROM wide ORDER BY closing_balance DESC, ledger_name LIMIT 3),
tl AS (SELECT row_number() OVER (ORDER BY closing_balance ASC, ledger_name) AS rank, ledger_name, closing_balance
       FROM wide ORDER BY closing_balance ASC, ledger_name LIMIT 3),
with_pnl AS (
  SELECT 'pnl_closing' AS section, CAST(NULL AS INTEGER) AS rank, account AS name, CAST(NULL AS VARCHAR) AS parent,
         pnl_closing AS amount FROM card
  UNION ALL SELECT 'pnl_opening', NULL, account, NULL, pnl_opening FROM card
  UNION ALL SELECT 'net_profit', NULL, account, NULL, net_profit FROM card
  UNION ALL SELECT 'top_party', CAST(rank AS INTEGER), ledger_name, parent, closing_balance FROM topp
),
without AS (
  SELECT 'assets' AS section, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS name,
         CAST(NULL AS VARCHAR) AS parent, CAST(p AS DOUBLE) AS amount FROM pos
  UNION ALL SELECT 'liabilities', NULL, NULL, NULL, CAST(abs(n) AS DOUBLE) FROM pos
  UNION ALL SELECT 'net_position', NULL, NULL, NULL, CAST(p + n AS DOUBLE) FROM pos
  UNION ALL SELECT 'top_asset', CAST(rank AS INTEGER), ledger_name, NULL, closing_balance FROM ta
  UNION ALL SELECT 'top_liability', CAST(rank AS INTEGER), ledger_name, NULL, closing_balance FROM tl
)
SELECT * FROM with_pnl WHERE (SELECT f FROM found)
UNION ALL SELECT * FROM without WHERE NOT (SELECT f FROM found)""")


TOPB = f"""
topb AS (SELECT row_number() OVER (ORDER BY closing_balance DESC, ledger_name) AS rank, ledger_name, parent, closing_balance
         FROM ledgers WHERE {biz()} ORDER BY closing_balance DESC, ledger_name LIMIT 5),
botb AS (SELECT row_number() OVER (ORDER BY closing_balance ASC, ledger_name) AS rank, ledger_name, parent, closing_balance
         FROM ledgers WHERE {biz()} ORDER BY closing_balance ASC, ledger_name LIMIT 5)
"""

ORACLES.update({
    "financial_analysis": _fin("profit  loss", INTERNAL_N, WIDE_N),
    "financial_analysis_as_written": _fin("profit & loss", INTERNAL_W, WIDE_W),
    "trend_snapshot": q(f"""
, tot AS (SELECT COUNT(*) AS total_parties, {msum('closing_balance')} AS net_balance,
                 COUNT(altered_on) > 0 AS has_dates FROM ledgers),
{TOPB},
rows AS (
  SELECT 'total_parties' AS section, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS name,
         CAST(NULL AS VARCHAR) AS parent, CAST(total_parties AS DOUBLE) AS amount FROM tot
  UNION ALL SELECT 'net_balance', NULL, NULL, NULL, net_balance FROM tot
  UNION ALL SELECT 'top_positive', CAST(rank AS INTEGER), ledger_name, parent, closing_balance FROM topb
  UNION ALL SELECT 'top_negative', CAST(rank AS INTEGER), ledger_name, parent, closing_balance FROM botb
)
SELECT * FROM rows WHERE (SELECT has_dates FROM tot)
UNION ALL SELECT 'no_dates', NULL, NULL, NULL, NULL FROM tot WHERE NOT has_dates"""),
    "business_summary": q(f"""
, st AS (SELECT COUNT(*) AS total_parties, {msum('closing_balance')} AS total_balance,
                {mmean('closing_balance')} AS avg_balance, MAX(closing_balance) AS max_balance,
                MIN(closing_balance) AS min_balance FROM ledgers),
g AS (SELECT parent, {msum('closing_balance')} AS group_balance FROM ledgers WHERE {biz()} GROUP BY parent),
tg AS (SELECT row_number() OVER (ORDER BY group_balance DESC, parent ASC NULLS FIRST) AS rank, parent, group_balance
       FROM g ORDER BY group_balance DESC, parent ASC NULLS FIRST LIMIT 5),
rc AS (SELECT row_number() OVER (ORDER BY altered_on DESC, ledger_name) AS rank, ledger_name, altered_on, closing_balance
       FROM ledgers WHERE altered_on IS NOT NULL ORDER BY altered_on DESC, ledger_name LIMIT 5)
SELECT 'total_parties' AS section, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS name,
       CAST(NULL AS VARCHAR) AS parent, CAST(total_parties AS DOUBLE) AS amount FROM st
UNION ALL SELECT 'total_balance', NULL, NULL, NULL, total_balance FROM st
UNION ALL SELECT 'avg_balance', NULL, NULL, NULL, avg_balance FROM st
UNION ALL SELECT 'max_balance', NULL, NULL, NULL, max_balance FROM st
UNION ALL SELECT 'min_balance', NULL, NULL, NULL, min_balance FROM st
UNION ALL SELECT 'top_group', CAST(rank AS INTEGER), parent, NULL, group_balance FROM tg
UNION ALL SELECT 'recent', CAST(rank AS INTEGER), ledger_name, strftime(altered_on, '%Y-%m-%d'), closing_balance FROM rc"""),
    "party_ranking": q(f"""
SELECT 'ranking' AS section, CAST(row_number() OVER (ORDER BY closing_balance DESC, ledger_name) AS INTEGER) AS rank,
       ledger_name, closing_balance, parent, altered_on
FROM ledgers WHERE {biz()} ORDER BY closing_balance DESC, ledger_name LIMIT 10"""),
    "party_ranking_year": q(f"""
, base AS (SELECT * FROM ledgers WHERE year(altered_on) = 2001),
r AS (SELECT 'ranking' AS section, CAST(row_number() OVER (ORDER BY closing_balance ASC, ledger_name) AS INTEGER) AS rank,
             ledger_name, closing_balance, parent, altered_on
      FROM base WHERE {biz()} ORDER BY closing_balance ASC, ledger_name LIMIT 3),
y AS (SELECT DISTINCT 'available_year' AS section, CAST(year(altered_on) AS INTEGER) AS rank,
             CAST(NULL AS VARCHAR) AS ledger_name, CAST(NULL AS DOUBLE) AS closing_balance,
             CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS DATE) AS altered_on
      FROM ledgers WHERE altered_on IS NOT NULL)
SELECT * FROM r WHERE (SELECT COUNT(*) FROM base) > 0
UNION ALL SELECT * FROM y WHERE (SELECT COUNT(*) FROM base) = 0"""),
    "party_ranking_no_year": q(f"""
, base AS (SELECT * FROM ledgers WHERE year(altered_on) = 2030),
r AS (SELECT 'ranking' AS section, CAST(row_number() OVER (ORDER BY closing_balance DESC, ledger_name) AS INTEGER) AS rank,
             ledger_name, closing_balance, parent, altered_on
      FROM base WHERE {biz()} ORDER BY closing_balance DESC, ledger_name LIMIT 5),
y AS (SELECT DISTINCT 'available_year' AS section, CAST(year(altered_on) AS INTEGER) AS rank,
             CAST(NULL AS VARCHAR) AS ledger_name, CAST(NULL AS DOUBLE) AS closing_balance,
             CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS DATE) AS altered_on
      FROM ledgers WHERE altered_on IS NOT NULL)
SELECT * FROM r WHERE (SELECT COUNT(*) FROM base) > 0
UNION ALL SELECT * FROM y WHERE (SELECT COUNT(*) FROM base) = 0"""),
    "pnl_report": q(f"""
, card AS (
  SELECT ledger_name AS account, closing_balance AS pnl_closing, opening_balance AS pnl_opening,
         CAST(CAST(closing_balance AS DECIMAL(18,2)) - CAST(opening_balance AS DECIMAL(18,2)) AS DOUBLE) AS net_profit
  FROM ledgers WHERE contains(lower(ledger_name), 'profit') ORDER BY ledger_name LIMIT 1
),
t AS (SELECT row_number() OVER (ORDER BY closing_balance DESC, ledger_name) AS rank, ledger_name, closing_balance
      FROM ledgers WHERE {biz(NARROW_N)} ORDER BY closing_balance DESC, ledger_name LIMIT 5),
rows AS (
  SELECT 'pnl_closing' AS section, CAST(NULL AS INTEGER) AS rank, account AS name, CAST(NULL AS VARCHAR) AS parent,
         pnl_closing AS amount FROM card
  UNION ALL SELECT 'pnl_opening', NULL, account, NULL, pnl_opening FROM card
  UNION ALL SELECT 'net_profit', NULL, account, NULL, net_profit FROM card
  UNION ALL SELECT 'top_party', CAST(rank AS INTEGER), ledger_name, NULL, closing_balance FROM t
)
SELECT * FROM rows WHERE (SELECT COUNT(*) FROM card) > 0
UNION ALL SELECT 'not_found', NULL, NULL, NULL, NULL WHERE (SELECT COUNT(*) FROM card) = 0"""),
})

BR = f"""
, tx AS (SELECT l.ledger_name, e.* FROM ledgers l JOIN fy_e e ON e.party_key = l.name_key),
sales AS (
  SELECT *, row_number() OVER (PARTITION BY ledger_name ORDER BY date, voucher_no, voucher_type, entry_no, particulars,
              debit_amount, credit_amount) AS inv_no
  FROM tx WHERE credit_amount > 0 AND regexp_matches(lower(voucher_type), 'invoice|sales|bill')
),
pay AS (
  SELECT ledger_name, SUM(CAST(debit_amount AS DECIMAL(18,2))) AS paid, COUNT(*) AS n_payments
  FROM tx WHERE debit_amount > 0 AND regexp_matches(lower(voucher_type), 'payment|receipt|cash')
  GROUP BY ledger_name
),
inv AS (
  SELECT s.ledger_name, s.inv_no, s.date, s.voucher_no, s.credit_amount,
         CAST(s.credit_amount AS DECIMAL(18,2)) -
           CASE WHEN p.n_payments > 0 THEN least(CAST(s.credit_amount AS DECIMAL(18,2)), p.paid) ELSE 0 END AS due
  FROM sales s LEFT JOIN pay p USING (ledger_name) WHERE s.inv_no <= 10
),
inv_rows AS (
  SELECT ledger_name, 'invoices' AS source, CAST(inv_no AS INTEGER) AS seq, date AS br_date,
         voucher_no AS br_no, ledger_name AS party, round_even(CAST(due AS DOUBLE), 2) AS amount,
         date + 30 AS due_date, CASE WHEN due > 0.5 THEN 'Outstanding' ELSE 'Paid' END AS status,
         CAST(due AS DECIMAL(38,2)) AS due_exact
  FROM inv WHERE due > 0
),
without AS (
  SELECT ledger_name, name_key FROM ledgers
  WHERE ledger_name NOT IN (SELECT ledger_name FROM inv_rows)
),
debt AS (
  SELECT ledger_name AS debtor, closing_balance AS d_closing FROM ledgers
  WHERE regexp_matches(lower(parent), '{DEBTOR_RE}')
),
fbm AS (
  SELECT w.ledger_name, d.debtor, d.d_closing,
         row_number() OVER (PARTITION BY w.ledger_name ORDER BY d.debtor) - 1 AS i
  FROM without w JOIN debt d ON contains(lower(d.debtor), lower(w.name_key))
  WHERE length(w.name_key) > 0
),
fb_rows AS (
  SELECT ledger_name, 'debtors' AS source, CAST(i + 1 AS INTEGER) AS seq,
         DATE '{FY_START}' + CAST(i * 15 AS INTEGER) AS br_date,
         'BR-' || lpad(CAST(i + 1 AS VARCHAR), 3, '0') AS br_no, debtor AS party,
         round_even(abs(d_closing), 2) AS amount,
         DATE '{FY_START}' + CAST(i * 15 AS INTEGER) + 30 AS due_date, 'Outstanding' AS status,
         CAST(abs(d_closing) AS DECIMAL(38,2)) AS due_exact
  FROM fbm WHERE i < 5 AND d_closing < 0
),
br_rows AS (SELECT * FROM inv_rows UNION ALL SELECT * FROM fb_rows),
br AS (
  SELECT r.ledger_name, '{FY}' AS financial_year, r.source, r.seq, r.br_date, r.br_no, r.party,
         r.amount, r.due_date, r.status, CAST(t.total_br AS DOUBLE) AS total_br
  FROM br_rows r JOIN (SELECT ledger_name, SUM(due_exact) AS total_br FROM br_rows GROUP BY ledger_name) t
    USING (ledger_name)
)
"""

#: BR with every invoice and every debtor instead of the first ones.
BR_WHOLE = (BR.replace(" WHERE s.inv_no <= 10", "").replace("WHERE i < 5 AND d_closing < 0", "WHERE d_closing < 0")
            .replace("lpad(CAST(i + 1 AS VARCHAR), 3, '0')",
                     "lpad(CAST(i + 1 AS VARCHAR), greatest(3, length(CAST(i + 1 AS VARCHAR)))::INTEGER, '0')"))

STMT_BODY = FY_STATEMENT[len(BINDINGS):]

ORACLES.update({
    "party_fy_transactions": q("""
SELECT l.ledger_name, e.date, e.voucher_no, e.entry_no, e.debit_amount, e.credit_amount
FROM ledgers l JOIN fy_e e ON e.party_key = l.name_key"""),
    "party_partial_fallback": q("""
SELECT l.ledger_name, e.party_key, e.date, e.voucher_no, e.entry_no
FROM ledgers l JOIN fy_e e ON contains(lower(e.party_key), lower(l.name_key))
WHERE length(l.name_key) > 0 AND NOT EXISTS (SELECT 1 FROM fy_e x WHERE x.party_key = l.name_key)"""),
    "running_balance": q(f"""
, st AS ({FY_STATEMENT})
SELECT ledger_name, seq, date, voucher_no, debit, credit, balance FROM st
WHERE voucher_no NOT IN ('OP-001', 'CL-001')"""),
    "sort_by_date": q(f"""
, st AS ({FY_STATEMENT})
SELECT ledger_name, seq, date, voucher_type, voucher_no FROM st"""),
    "reconcile": q("""
, f AS (SELECT party_key, SUM(CAST(debit_amount AS DECIMAL(18,2)) - CAST(credit_amount AS DECIMAL(18,2))) AS flow,
               COUNT(*) AS n_entries FROM entries GROUP BY party_key)
SELECT l.ledger_name, COALESCE(f.n_entries, 0) AS n_entries,
       CAST(CAST(round_even(l.opening_balance, 2) AS DECIMAL(18,2)) + COALESCE(f.flow, 0) AS DOUBLE) AS computed_closing,
       round_even(l.closing_balance, 2) AS stored_closing,
       CAST(CAST(round_even(l.opening_balance, 2) AS DECIMAL(18,2)) + COALESCE(f.flow, 0)
            - CAST(round_even(l.closing_balance, 2) AS DECIMAL(18,2)) AS DOUBLE) AS drift,
       CAST(round_even(l.opening_balance, 2) AS DECIMAL(18,2)) + COALESCE(f.flow, 0)
            = CAST(round_even(l.closing_balance, 2) AS DECIMAL(18,2)) AS ok
FROM ledgers l LEFT JOIN f ON l.name_key = f.party_key"""),
    "bills_receivable": q(BR + " SELECT * FROM br"),
    "first_invoices": q(BR + """
SELECT ledger_name, inv_no, date, voucher_no, credit_amount FROM sales WHERE inv_no <= 10"""),
    "payments_total": q(BR + " SELECT ledger_name, CAST(paid AS DOUBLE) AS paid, n_payments FROM pay"),
    "invoice_vs_payments": q(BR + """
SELECT ledger_name, source, seq, br_date, br_no, party, amount, due_date, status FROM inv_rows"""),
    "debtor_fallback": q(BR + " SELECT * FROM br WHERE source = 'debtors'"),
    "fallback_schedule": q(BR + """
SELECT ledger_name, seq, br_date, due_date, br_no FROM br WHERE source = 'debtors'"""),
    "receivable_total": q(BR + " SELECT DISTINCT ledger_name, total_br FROM br"),
    "resolve_exact": q(REQUESTS + """
SELECT r.req_id, r.request, min(l.ledger_name) AS ledger_name
FROM requests r JOIN ledgers l ON lower(l.ledger_name) = lower(r.request) GROUP BY ALL"""),
    "resolve_contains": q(REQUESTS + " SELECT req_id, request, ledger_name FROM cm"),
    "resolve_status": q(REQUESTS + """
, ex AS (SELECT r.req_id, min(l.ledger_name) AS ledger_name FROM requests r
         JOIN ledgers l ON lower(l.ledger_name) = lower(r.request) GROUP BY r.req_id),
hits AS (
  SELECT req_id, ledger_name FROM ex UNION ALL
  SELECT DISTINCT req_id, ledger_name FROM cm WHERE req_id NOT IN (SELECT req_id FROM ex)
),
n AS (SELECT req_id, COUNT(*) AS n_matches FROM hits GROUP BY req_id),
h AS (
  SELECT req_id, string_agg(ledger_name, '; ' ORDER BY ledger_name) AS options
  FROM (SELECT req_id, ledger_name, row_number() OVER (PARTITION BY req_id ORDER BY ledger_name) AS rn FROM hits)
  WHERE rn <= 5 GROUP BY req_id
)
SELECT r.req_id, r.request, COALESCE(c.n_matches, 0) AS n_matches,
       CASE WHEN COALESCE(c.n_matches, 0) = 0 THEN 'not_found' WHEN c.n_matches = 1 THEN 'resolved'
            ELSE 'clarification' END AS status,
       CASE WHEN c.n_matches = 1 THEN h.options END AS resolved_name,
       COALESCE(h.options, '') AS options
FROM requests r LEFT JOIN n c USING (req_id) LEFT JOIN h USING (req_id)"""),
    "did_you_mean": q(REQUESTS + """
, d AS (SELECT DISTINCT r.req_id, r.request, l.ledger_name FROM requests r JOIN ledgers l
          ON contains(lower(l.ledger_name), lower(r.request)) WHERE length(r.request) > 0)
SELECT req_id, request, CAST(rank AS INTEGER) AS rank, ledger_name FROM (
  SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY ledger_name) AS rank FROM d) WHERE rank <= 5"""),
    "regex_status": q(REQUESTS + """
, p AS (
  SELECT req_id * 8 AS req_id, request, true AS good FROM requests
  UNION ALL SELECT req_id * 8 + 1, substr(request, 1, 4) || '.*' || right(request, 3) || '$', true FROM requests
  UNION ALL SELECT req_id * 8 + 2, request || '|^' || substr(request, 3, 40), true FROM requests
  UNION ALL SELECT req_id * 8 + 3, '^[a-m]' || substr(request, 2, 8) || '0{2,}', true FROM requests
  UNION ALL SELECT req_id * 8 + 4, request || '(', false FROM requests
),
n AS (SELECT p.req_id, COUNT(*) AS n, min(l.ledger_name) AS one FROM p JOIN ledgers l
        ON CASE WHEN good THEN regexp_matches(lower(l.ledger_name), lower(p.request)) ELSE false END GROUP BY 1)
SELECT req_id, request, CASE WHEN NOT good THEN 'bad_pattern' WHEN n > 0 THEN 'found' ELSE 'not_found' END AS status,
       COALESCE(n, 0) AS n_matches, one AS first_match
FROM p LEFT JOIN n USING (req_id)"""),
    "match_head": q(REQUESTS + """
SELECT req_id, CAST(rank AS INTEGER) AS rank, ledger_name, n_matches FROM (
  SELECT cm.*, cc.n_matches, row_number() OVER (PARTITION BY cm.req_id ORDER BY ledger_name) AS rank
  FROM cm JOIN cc USING (req_id)) WHERE rank <= 10"""),
})

LOOK = REQUESTS + """
, top AS (
  SELECT * FROM (
    SELECT cm.*, cc.n_matches, row_number() OVER (PARTITION BY cm.req_id ORDER BY cm.ledger_name) AS rank
    FROM cm JOIN cc USING (req_id)) WHERE rank <= 10
),
nf AS (SELECT * FROM requests WHERE req_id NOT IN (SELECT req_id FROM cc))
"""
STATUS = "CASE WHEN n_matches = 1 THEN 'resolved' ELSE 'clarification' END AS status"

ORACLES.update({
    "balance_lookup": q(LOOK + f"""
SELECT req_id, request, n_matches, {STATUS}, CAST(rank AS INTEGER) AS rank, ledger_name, parent,
       opening_balance, closing_balance, altered_on, 'closing' AS balance_type, closing_balance AS balance
FROM top
UNION ALL
SELECT req_id, request, 0, 'not_found', NULL, NULL, NULL, NULL, NULL, NULL, 'closing', NULL FROM nf"""),
    "parent_lookup": q(LOOK + f"""
SELECT req_id, request, n_matches, {STATUS}, CAST(rank AS INTEGER) AS rank, ledger_name, parent,
       closing_balance, opening_balance FROM top
UNION ALL
SELECT req_id, request, 0, 'not_found', NULL, NULL, NULL, NULL, NULL FROM nf"""),
    "compare_lookup": q(LOOK + f"""
SELECT req_id, request, n_matches, {STATUS}, CAST(rank AS INTEGER) AS rank, ledger_name, parent,
       opening_balance, closing_balance, altered_on, greatest(n_matches - 10, 0) AS more FROM top
UNION ALL
SELECT req_id, request, 0, 'not_found', NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM nf"""),
    "ledger_search": q(REQUESTS + f"""
, hits AS (
  SELECT r.req_id, r.request, l.ledger_name, l.parent, l.opening_balance, l.closing_balance, l.altered_on,
         CASE WHEN contains(lower(l.ledger_name), lower(r.request)) THEN 0 ELSE 1 END AS hit_rank
  FROM requests r JOIN ledgers l
    ON contains(lower(l.ledger_name), lower(r.request)) OR contains(lower(l.parent), lower(r.request))
  WHERE length(r.request) > 0
),
hc AS (SELECT req_id, COUNT(*) AS n_matches FROM hits GROUP BY req_id),
ranked AS (
  SELECT hits.*, hc.n_matches,
         row_number() OVER (PARTITION BY hits.req_id ORDER BY hit_rank, ledger_name, parent) AS rank
  FROM hits JOIN hc USING (req_id)
)
SELECT req_id, request, n_matches, 'found' AS status, CAST(rank AS INTEGER) AS rank, hit_rank,
       ledger_name, parent, opening_balance, closing_balance, altered_on
FROM ranked WHERE rank <= 15
UNION ALL
SELECT req_id, request, 0, 'not_found', NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM requests WHERE req_id NOT IN (SELECT req_id FROM hc)"""),
})

# --- text fixtures (dirty export fields), see ledgerflow/sources/fixtures.py ----------
TEXT = """
, lt_base AS (
  SELECT c_custkey * 2 AS rec_id, c_name AS NAME,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Sundry Debtors' WHEN 'AUTOMOBILE' THEN 'Trade Receivables'
              WHEN 'MACHINERY' THEN 'Duties & Taxes' WHEN 'HOUSEHOLD' THEN 'Primary'
              WHEN 'FURNITURE' THEN 'Bank Accounts' END AS PARENT, c_acctbal AS bal FROM customer
  UNION ALL SELECT s_suppkey * 2 + 1, s_name, 'Sundry Creditors', s_acctbal FROM supplier
  UNION ALL SELECT 2 * (1000000000 + min(c_custkey)), substr(c_name, 1, 16), 'Sundry Debtors',
    CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) FROM customer GROUP BY substr(c_name, 1, 16)
  UNION ALL SELECT 4000000001, 'Profit & Loss A/c', 'Primary',
    CAST(COALESCE(SUM(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) FROM lineitem
),
lt AS (
  SELECT rec_id, NAME, PARENT,
         CASE rec_id % 8 WHEN 0 THEN s WHEN 1 THEN '  ' || s || ' ' WHEN 2 THEN s || ' Dr'
              WHEN 3 THEN '1,' || s WHEN 4 THEN 'nan' WHEN 5 THEN '' WHEN 6 THEN s || 'e0' END AS OPENINGBALANCE,
         CASE WHEN rec_id % 6 = 5 THEN 'inf' ELSE s END AS CLOSINGBALANCE,
         CASE rec_id % 5 WHEN 0 THEN d WHEN 1 THEN d || '.0' WHEN 2 THEN 'nan' WHEN 3 THEN substr(d, 1, 7)
              ELSE substr(d, 1, 4) || '1301' END AS ALTEREDON
  FROM (SELECT *, CAST(CAST(bal AS DECIMAL(18,2)) AS VARCHAR) AS s,
               strftime(DATE '1995-01-01' + CAST(rec_id % 2400 AS INTEGER), '%Y%m%d') AS d FROM lt_base)
),
vt AS (
  SELECT CAST(e.voucher_no AS BIGINT) AS voucher_id,
         CASE WHEN CAST(e.voucher_no AS BIGINT) % 11 = 0 THEN 'x' || strftime(e.date, '%Y%m%d')
              ELSE strftime(e.date, '%Y%m%d') END AS DATE,
         CASE WHEN CAST(e.voucher_no AS BIGINT) % 9 = 0 THEN '' ELSE e.voucher_type END AS VOUCHERTYPENAME,
         e.voucher_no AS VOUCHERNUMBER,
         CASE WHEN CAST(e.voucher_no AS BIGINT) % 13 = 0 THEN ''
              WHEN CAST(e.voucher_no AS BIGINT) % 5 = 0 THEN e.party_name || ' & Co'
              ELSE e.party_name END AS PARTYLEDGERNAME,
         e.entry_no, e.particulars AS LEDGERNAME,
         CASE WHEN (CAST(e.voucher_no AS BIGINT) + e.entry_no) % 13 = 0 THEN 'n/a'
              ELSE CAST(e.amount AS VARCHAR) END AS AMOUNT
  FROM ve_raw e
)
"""


def coerce(x: str) -> str:
    v = f"TRY_CAST(trim({x}) AS DOUBLE)"
    ok = rf"regexp_full_match({x}, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')"
    return (f"COALESCE(CASE WHEN {ok} THEN CASE WHEN isinf({v}) OR isnan({v}) THEN 0.0 ELSE {v} END END, 0.0)")


def ymd(x: str) -> str:
    return rf"CASE WHEN regexp_full_match(trim({x}), '\d{{8}}') THEN CAST(try_strptime(trim({x}), '%Y%m%d') AS DATE) END"


def before_dot(x: str) -> str:
    return f"split_part(CAST({x} AS VARCHAR), '.', 1)"


SAN_LEDGER = r"regexp_replace(regexp_replace(text, '&#(?:[0-9]+|[xX][0-9a-fA-F]+);?', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"
SAN_VOUCHER = (r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(</?)[a-zA-Z0-9_]+:', '\1', 'g'), "
               r"'[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;', 'g'), '&amp;(amp|lt|gt|apos|quot);', '&\1;', 'g')")

VKEY = "CAST(voucher_no AS BIGINT)"

ORACLES.update({
    "scan_ledger_xml": q(TEXT + f"""
SELECT NAME AS ledger_name, PARENT AS parent, {coerce('OPENINGBALANCE')} AS opening_balance,
       {coerce('CLOSINGBALANCE')} AS closing_balance, {ymd(before_dot('ALTEREDON'))} AS altered_on FROM lt"""),
    "conform_ledgers": q(TEXT + """
SELECT NAME AS ledger_name, PARENT AS parent, OPENINGBALANCE AS opening_balance,
       CLOSINGBALANCE AS closing_balance, ALTEREDON AS altered_on FROM lt"""),
    "scan_voucher_xml": q(f"""
SELECT date,
       (CASE WHEN {VKEY} % 9 = 0 THEN '' ELSE voucher_type END) ||
       (CASE WHEN {VKEY} % 7 = 0 THEN '&#4;' ELSE '' END) AS voucher_type,
       voucher_no,
       CASE WHEN {VKEY} % 13 = 0 THEN 'Unknown' WHEN {VKEY} % 5 = 0 THEN party_name || ' & Co'
            ELSE party_name END AS party_name,
       particulars,
       CASE WHEN ({VKEY} + entry_no) % 13 = 0 THEN 0.0 WHEN amount > 0 THEN CAST(amount AS DOUBLE) ELSE 0.0 END
         AS debit_amount,
       CASE WHEN ({VKEY} + entry_no) % 13 = 0 THEN 0.0 WHEN amount < 0 THEN CAST(-amount AS DOUBLE) ELSE 0.0 END
         AS credit_amount,
       entry_no
FROM ve_raw WHERE {VKEY} % 17 <> 0 AND {VKEY} % 11 <> 0"""),
    "sanitize_ledger_xml": q(f"SELECT doc_id, {SAN_LEDGER} AS clean FROM documents"),
    "sanitize_voucher_xml": q(f"SELECT doc_id, {SAN_VOUCHER} AS clean FROM documents"),
    "source_pruned_scan": q("""
SELECT date, voucher_type, voucher_no, party_name, particulars, debit_amount, credit_amount FROM entries
WHERE date BETWEEN DATE '2000-04-01' AND DATE '2035-03-31'"""),
    "scan_tables": q(f"""
SELECT 'ledgers' AS "table", {LC}, NULL AS date, NULL AS voucher_type, NULL AS voucher_no, NULL AS entry_no, NULL AS party_name,
       NULL AS particulars, NULL AS debit_amount, NULL AS credit_amount, NULL AS party_key FROM ledgers
UNION ALL
SELECT 'voucher_entries', NULL, NULL, NULL, NULL, NULL, date, voucher_type, voucher_no, entry_no, party_name, particulars,
       debit_amount, credit_amount, party_key FROM entries"""),
    "trim_column_names": q(f"SELECT {LC} FROM ledgers"),
    "sql_passthrough": q("""
SELECT ledger_name, closing_balance FROM ledgers WHERE closing_balance > 0 AND parent = 'Sundry Debtors'"""),
    "sql_statements": q("""
SELECT 'good' AS statement, 'ok' AS status, ledger_name, closing_balance AS amount FROM ledgers WHERE closing_balance > 0
UNION ALL SELECT 'groups', 'ok', parent, CAST(COUNT(*) AS DOUBLE) FROM ledgers GROUP BY parent
UNION ALL SELECT 'empty', 'empty', NULL, NULL
UNION ALL SELECT unnest(['syntax', 'column', 'failing']), 'error', NULL, NULL"""),
    "flatten_entries": q("""
SELECT date, voucher_type, voucher_no, party_name, entry_no, particulars, CAST(amount AS DOUBLE) AS amount
FROM ve_raw"""),
    "normalize_names": q(f"""
SELECT ledger_name AS ledger_name_raw, parent AS parent_raw, {norm('ledger_name')} AS name_1pass,
       {norm2('ledger_name')} AS name_2pass, {norm('parent')} AS parent_1pass, {norm2('parent')} AS parent_2pass
FROM ledgers_raw"""),
    "normalize_documents": q(f"SELECT doc_id, {norm('text')} AS norm_1pass, {norm2('text')} AS norm_2pass FROM documents"),
    "coerce_balances": q(TEXT + f"""
SELECT rec_id, OPENINGBALANCE, CLOSINGBALANCE, {coerce('OPENINGBALANCE')} AS opening_balance,
       {coerce('CLOSINGBALANCE')} AS closing_balance FROM lt"""),
    "safe_amount": q(TEXT + f"SELECT voucher_id, entry_no, AMOUNT AS amount_text, {coerce('AMOUNT')} AS amount_value FROM vt"),
    "field_default": q(TEXT + """
SELECT voucher_id, entry_no, COALESCE(NULLIF(VOUCHERTYPENAME, ''), '') AS voucher_type,
       COALESCE(NULLIF(VOUCHERNUMBER, ''), '') AS voucher_no,
       COALESCE(NULLIF(PARTYLEDGERNAME, ''), 'Unknown') AS party_name FROM vt"""),
    "entry_field_fallback": q(f"""
SELECT voucher_no, entry_no, particulars,
       CASE WHEN ({VKEY} + entry_no) % 13 = 0 THEN 'n/a' ELSE CAST(amount AS VARCHAR) END AS amount_text
FROM ve_raw WHERE {VKEY} % 17 <> 0"""),
    "parse_altered_on": q(TEXT + f"SELECT rec_id, ALTEREDON, {ymd(before_dot('ALTEREDON'))} AS altered_on FROM lt"),
    "parse_voucher_date": q(TEXT + f"""
SELECT * FROM (SELECT voucher_id, entry_no, DATE AS date_text, {ymd('DATE')} AS voucher_date FROM vt)
WHERE voucher_date IS NOT NULL"""),
    "reparse_dates": q("SELECT ledger_name, altered_on FROM ledgers"),
    "split_debit_credit": q(TEXT + f"""
SELECT voucher_id, entry_no,
       CASE WHEN {coerce('AMOUNT')} > 0 THEN round_even(abs({coerce('AMOUNT')}), 2) ELSE 0.0 END AS debit_amount,
       CASE WHEN {coerce('AMOUNT')} < 0 THEN round_even(abs({coerce('AMOUNT')}), 2) ELSE 0.0 END AS credit_amount
FROM vt"""),
    "stringify_keys": q("""
SELECT CAST(o_orderstatus AS VARCHAR) AS voucher_type, CAST(o_orderkey AS VARCHAR) AS voucher_no,
       CAST(o_custkey AS VARCHAR) AS party_name, CAST(l_partkey AS VARCHAR) AS particulars
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"""),
    "display_columns": q("""
SELECT date AS "Date", voucher_type AS "Voucher Type", voucher_no AS "Voucher No", party_name AS "Party Name",
       particulars AS "Particulars", debit_amount AS "Debit Amount", credit_amount AS "Credit Amount" FROM entries"""),
    "financial_year": q("""
SELECT voucher_no, entry_no, date,
       CAST(year(date - INTERVAL 3 MONTH) AS VARCHAR) || '-' || CAST(year(date - INTERVAL 3 MONTH) + 1 AS VARCHAR)
         AS financial_year FROM entries"""),
    "fy_bounds": q("""
, labs AS (SELECT DISTINCT CAST(year(date - INTERVAL 3 MONTH) AS VARCHAR) || '-' ||
                  CAST(year(date - INTERVAL 3 MONTH) + 1 AS VARCHAR) AS label FROM entries),
alll AS (SELECT label FROM labs UNION ALL SELECT split_part(label, '-', 1) FROM labs)
SELECT label, make_date(CAST(split_part(label, '-', 1) AS INTEGER), 4, 1) AS fy_start,
       make_date(CASE WHEN contains(label, '-') THEN CAST(split_part(label, '-', 2) AS INTEGER)
                      ELSE CAST(label AS INTEGER) + 1 END, 3, 31) AS fy_end FROM alll"""),
    "due_date": q("""
SELECT voucher_no, entry_no, date, CAST(date + 30 AS DATE) AS due_date FROM entries
WHERE credit_amount > 0 AND regexp_matches(lower(voucher_type), 'invoice|sales|bill')"""),
    "display_truncate": q(f"""
, st AS ({FY_STATEMENT})
SELECT ledger_name, seq, substr(voucher_type, 1, 15) AS voucher_type, substr(voucher_no, 1, 10) AS voucher_no,
       substr(particulars, 1, 25) AS particulars FROM st"""),
    "money_format": q(f"""
, st AS ({FY_STATEMENT})
SELECT ledger_name, seq,
       CASE WHEN debit > 0 THEN format('{{:,.2f}}', debit) ELSE '0.00' END AS debit,
       CASE WHEN credit > 0 THEN format('{{:,.2f}}', credit) ELSE '0.00' END AS credit,
       format('{{:,.2f}}', balance) AS balance FROM st"""),
    "date_display": q(BR + f"""
, st AS ({FY_STATEMENT})
SELECT ledger_name, seq, strftime(date, '%m-%d') AS day, 'statement' AS report FROM st
UNION ALL SELECT ledger_name, seq, strftime(br_date, '%d-%m'), 'br' FROM br"""),
    "round_balances": q("""
SELECT ledger_name, round_even(opening_balance, 2) AS opening, round_even(closing_balance, 2) AS closing
FROM ledgers"""),
    "signed_abs": q("SELECT ledger_name, abs(closing_balance) AS magnitude FROM ledgers WHERE closing_balance < 0"),
})
ORACLES["project_entries"] = q(f"""
, sv AS ({ORACLES["scan_voucher_xml"]})
SELECT date, voucher_type, voucher_no, party_name, particulars, debit_amount, credit_amount FROM sv""")

# --- questions ------------------------------------------------------------------
from ledgerflow.plans.questions import NAME_FORMS, PLAIN_FORMS  # noqa: E402  (fixture text only)


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FORMS = ", ".join(f"({i}, {_sq(f.split('{n}')[0])}, {_sq(f.split('{n}')[1])})" for i, f in enumerate(NAME_FORMS))
_PLAIN = "[" + ", ".join(_sq(p) for p in PLAIN_FORMS) + "]"
STRIP_WS = f"regexp_replace(%s, '^[{WS}]+|[{WS}]+$', '', 'g')"

QUESTIONS = f"""
, qforms(i, a, b) AS (VALUES {_FORMS}),
qn AS (
  SELECT 'c' || CAST(c.c_custkey AS VARCHAR) || '-' || CAST(f.i AS VARCHAR) AS q_id, f.a || c.c_name || f.b AS question
  FROM customer c, qforms f
  UNION ALL
  SELECT 'p' || CAST(c_custkey AS VARCHAR), {_PLAIN}[CAST(c_custkey % {len(PLAIN_FORMS)} AS INTEGER) + 1] FROM customer
  UNION ALL
  SELECT 't' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations WHERE role = 'user'
),
ql AS (SELECT q_id, question, lower(question) AS l FROM qn),
qr AS (
  SELECT q_id, question, l,
    CASE WHEN regexp_matches(l, 'statement') THEN 'statement_query'
         WHEN regexp_matches(l, 'br|bill\\s+receivable') THEN 'br_query'
         WHEN contains(l, 'profit') OR contains(l, 'loss') OR contains(l, 'income') OR contains(l, 'expense')
              OR contains(l, 'revenue') THEN 'financial_analysis'
         WHEN contains(l, 'pending') OR contains(l, 'due') OR contains(l, 'outstanding') OR contains(l, 'unpaid')
              THEN 'pending_analysis'
         WHEN contains(l, 'compare') OR contains(l, 'versus') OR contains(l, 'vs') OR contains(l, 'difference')
              THEN 'comparative_analysis'
         WHEN contains(l, 'trend') OR contains(l, 'history') OR contains(l, 'over time') OR contains(l, 'growth')
              THEN 'trend_analysis'
         WHEN contains(l, 'summary') OR contains(l, 'overview') OR contains(l, 'report') OR contains(l, 'status')
              THEN 'summary_report'
         WHEN contains(l, 'search') OR contains(l, 'find') OR contains(l, 'look for')
              OR contains(l, 'information about') THEN 'search_query'
         WHEN contains(l, 'balance') OR contains(l, 'amount') OR contains(l, 'how much') THEN 'balance_query'
         WHEN contains(l, 'parent') OR contains(l, 'group') OR contains(l, 'category') THEN 'parent_query'
         WHEN contains(l, 'top') OR contains(l, 'best') OR contains(l, 'highest') OR contains(l, 'most')
              OR contains(l, 'worst') OR contains(l, 'lowest') THEN 'ranking_query'
         ELSE 'general_query' END AS nl_route,
    CASE {STRIP_WS % 'question'}
         WHEN 'balance_query_prompt' THEN 'balance_prompt' WHEN 'parent_query_prompt' THEN 'parent_prompt'
         WHEN 'top_parties_report' THEN 'ranking_query' WHEN 'profit_loss_report' THEN 'pnl_report'
         WHEN 'business_summary' THEN 'summary_report' WHEN 'pending_analysis' THEN 'pending_analysis'
         WHEN 'trend_analysis' THEN 'trend_analysis' END AS command,
    NULLIF(regexp_extract(l, '\\b(20\\d{{2}})\\b', 1), '') AS ys,
    COALESCE(NULLIF(regexp_extract(l, 'statement.*?(?:of|for)\\s*(.+)', 1), ''),
             NULLIF(regexp_extract(l, 'br.*?(?:of|for)\\s*(.+)', 1), ''),
             NULLIF(regexp_extract(l, 'bill\\s+receivable.*?(?:of|for)\\s*(.+)', 1), ''),
             NULLIF(regexp_extract(l, 'balance.*?(?:of|for)\\s*(.+)', 1), ''),
             NULLIF(regexp_extract(l, 'parent.*?(?:of|for)\\s*(.+)', 1), ''),
             NULLIF(regexp_extract(l, 'information about\\s*(.+)', 1), ''),
             NULLIF(regexp_extract(l, 'details of\\s*(.+)', 1), ''),
             NULLIF(regexp_extract(l, 'who is\\s*(.+)', 1), '')) AS raw_name
  FROM ql
),
qp AS (
  SELECT q_id, question, nl_route, command, COALESCE(command, nl_route) AS route,
    NULLIF(regexp_extract(l, '(\\d{{4}})-(\\d{{4}})', 0), '') AS financial_year,
    CASE WHEN regexp_matches(l, 'statement') THEN 'statement'
         WHEN regexp_matches(l, 'br|bill\\s+receivable') THEN 'br' END AS query_type,
    CAST(ys AS INTEGER) AS year,
    CAST(list_filter(regexp_extract_all(l, '\\b(\\d+)\\b', 1),
         lambda x: length(ltrim(x, '0')) BETWEEN 1 AND 4 AND TRY_CAST(ltrim(x, '0') AS INTEGER) <= 1000
                   AND (ys IS NULL OR x <> ys))[1] AS INTEGER) AS count,
    CASE WHEN raw_name IS NOT NULL THEN {norm("replace(raw_name, '?', '')")} END AS ledger_name,
    CASE WHEN contains(l, 'opening') THEN 'opening' ELSE 'closing' END AS balance_type,
    CASE WHEN contains(l, 'lowest') OR contains(l, 'minimum') OR contains(l, 'worst') OR contains(l, 'bottom')
              OR contains(l, 'least') THEN 'ASC' ELSE 'DESC' END AS "order"
  FROM qr
)
"""

ORACLES.update({
    "route_questions": q(QUESTIONS + " SELECT q_id, question, nl_route AS route FROM qp"),
    "extract_question_params": q(QUESTIONS + """
SELECT q_id, financial_year, query_type, year, count, ledger_name, balance_type, "order" FROM qp"""),
    "quick_commands": q(QUESTIONS + " SELECT q_id, question, command, route FROM qp"),
    "conversation_titles": f"""
WITH f AS (SELECT conv_id, arg_min(text, turn) AS first FROM conversations WHERE role = 'user' GROUP BY conv_id),
s AS (SELECT conv_id, {STRIP_WS % 'first'} AS t FROM f)
SELECT conv_id, CASE WHEN length(t) > 35 THEN substr(t, 1, 35) || '...' ELSE t END AS title FROM s""",
    "followup_rewrite": f"""
WITH RECURSIVE u AS (
  SELECT conv_id, turn, text, {STRIP_WS % 'txt'} AS s,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx
  FROM (SELECT conv_id, turn,
               CASE WHEN (conv_id * 7 + turn) % 6 <= 1 THEN 'balance_query_prompt'
                    WHEN (conv_id * 7 + turn) % 6 = 2 THEN 'parent_query_prompt' ELSE text END AS text,
               CASE WHEN (conv_id * 7 + turn) % 6 <= 1 THEN 'balance_query_prompt'
                    WHEN (conv_id * 7 + turn) % 6 = 2 THEN 'parent_query_prompt' ELSE text END AS txt
        FROM conversations WHERE role = 'user')
),
sm(conv_id, idx, flag, final_text, rewritten) AS (
  SELECT conv_id, idx,
         CASE s WHEN 'balance_query_prompt' THEN 'balance' WHEN 'parent_query_prompt' THEN 'parent' END,
         s, false
  FROM u WHERE idx = 1
  UNION ALL
  SELECT u.conv_id, u.idx,
         CASE WHEN sm.flag IS NOT NULL THEN NULL
              WHEN u.s = 'balance_query_prompt' THEN 'balance' WHEN u.s = 'parent_query_prompt' THEN 'parent' END,
         CASE WHEN sm.flag IS NOT NULL THEN sm.flag || ' of ' || u.s ELSE u.s END,
         sm.flag IS NOT NULL
  FROM sm JOIN u ON u.conv_id = sm.conv_id AND u.idx = sm.idx + 1
)
SELECT u.conv_id, u.turn, u.text, sm.final_text, sm.rewritten FROM u JOIN sm USING (conv_id, idx)""",
    "statement_request": q(QUESTIONS + f"""
, st AS ({FY_STATEMENT}),
sq AS (SELECT q_id, ledger_name AS name FROM qp WHERE route = 'statement_query' AND length(ledger_name) > 0),
fm AS (SELECT s.q_id, min(l.ledger_name) AS ledger_name FROM sq s JOIN ledgers l
         ON contains(lower(l.ledger_name), lower(s.name)) GROUP BY s.q_id)
SELECT fm.ledger_name, fm.q_id, st.financial_year, st.seq, st.date, st.voucher_type, st.voucher_no,
       st.particulars, st.debit, st.credit, st.balance, st.source
FROM fm JOIN st USING (ledger_name)"""),
    "search_union": q(REQUESTS + """
SELECT DISTINCT r.req_id, CASE WHEN contains(lower(l.ledger_name), lower(r.request)) THEN 0 ELSE 1 END AS hit_rank,
       l.ledger_name, l.parent
FROM requests r JOIN ledgers l
  ON contains(lower(l.ledger_name), lower(r.request)) OR contains(lower(l.parent), lower(r.request))
WHERE length(r.request) > 0"""),
    "statement_union": q(f"""
, st AS ({FY_STATEMENT})
SELECT ledger_name, seq, voucher_type, voucher_no, balance FROM st"""),
})

# --- sinks and refresh streams: the stored table equals the (newest) full export ---
ORACLES.update({
    "refresh_ledgers": ORACLES["scan_ledger_xml"],
    "refresh_isolation": ORACLES["scan_ledger_xml"],
    "sink_ledger_snapshot": ORACLES["scan_ledger_xml"],
    # the export writes a control character, a numeric reference or a bare '&' into these
    "xml_quarantine": q("""
, k AS (SELECT CAST(o_orderkey AS VARCHAR) AS voucher_no, o_orderkey AS n FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT voucher_no FROM k WHERE n % 10 = 0 OR n % 7 = 0 OR (n % 5 = 0 AND n % 13 <> 0)"""),
    "skip_empty_snapshot": ORACLES["scan_ledger_xml"],
    "refresh_vouchers": ORACLES["scan_voucher_xml"],
    "sink_voucher_snapshot": ORACLES["scan_voucher_xml"],
    "sink_reports": q(BR + f"""
, st AS ({FY_STATEMENT})
SELECT replace('Statement_' || ledger_name || '_' || financial_year, ' ', '_') AS file_key,
       ledger_name, seq, balance AS amount FROM st
UNION ALL
SELECT replace('BR_Report_' || ledger_name || '_' || financial_year, ' ', '_'), ledger_name, seq, amount FROM br"""),
})

# --- N4: one answer row per question ------------------------------------------------
_GLOBAL = {"financial_analysis": "financial_analysis", "pending_analysis": "pending_report",
           "trend_analysis": "trend_snapshot", "summary_report": "business_summary", "pnl_report": "pnl_report"}
# the pending answer has the totals and the first page, and counts the parties of all pages
_PENDING = ORACLES["pending_report"]
_PENDING_TOTALS = " UNION ALL ".join(
    f"SELECT '{c}' AS section, NULL AS rank, NULL AS name, NULL AS parent, CAST(max({c}) AS DOUBLE) AS amount FROM ({_PENDING}) HAVING COUNT(*) > 0"
    for c in ("total_pending", "total_amount", "avg_pending"))
_GLOBAL_LINES = " UNION ALL ".join(
    f"SELECT '{r}' AS g_route, section, rank, name, parent, CAST(amount AS DOUBLE) AS amount FROM ({ORACLES[k]})" if k != "pending_report" else
    f"SELECT '{r}', 'pending', rank, ledger_name, parent, closing_balance FROM ({_PENDING}) UNION ALL "
    f"SELECT '{r}', section, rank, name, parent, amount FROM ({_PENDING_TOTALS})"
    for r, k in _GLOBAL.items())
_GC = f"""SELECT g_route, CASE WHEN g_route = 'pending_analysis' THEN
         (SELECT max(total_pending) FROM ({_PENDING})) ELSE COUNT(*) END AS n_rows,
       string_agg(concat_ws(' | ', section, CAST(rank AS VARCHAR), name, parent, printf('%.2f', round_even(amount, 2))),
                  chr(10) ORDER BY section, rank NULLS FIRST, name NULLS FIRST) AS answer
FROM ({_GLOBAL_LINES}) GROUP BY g_route"""
_NAME_ROUTES = "('balance_query', 'parent_query', 'comparative_analysis', 'search_query', 'statement_query', 'br_query')"
_LOOKUP = "('balance_query', 'parent_query', 'comparative_analysis')"
_GLOBAL_IN = "('" + "', '".join(_GLOBAL) + "')"

ORACLES["answer_questions"] = q(QUESTIONS + BR + f"""
, st AS ({FY_STATEMENT}),
qa AS (SELECT q_id, question, route, ledger_name AS name, count, year,
              ledger_name IS NOT NULL AND length(ledger_name) > 0 AS has_name FROM qp),
nm AS (SELECT DISTINCT name FROM qa WHERE route IN {_NAME_ROUTES} AND has_name),
pn AS (SELECT n.name, COUNT(*) AS n_matches, MIN(l.ledger_name) AS first_name
       FROM nm n JOIN ledgers l ON contains(lower(l.ledger_name), lower(n.name)) GROUP BY n.name),
sr AS (SELECT n.name, COUNT(*) AS n_search FROM nm n JOIN ledgers l
         ON contains(lower(l.ledger_name), lower(n.name)) OR contains(lower(l.parent), lower(n.name))
       GROUP BY n.name),
stc AS (SELECT ledger_name, COUNT(*) AS st_rows FROM st GROUP BY ledger_name),
brc AS (SELECT ledger_name, COUNT(*) AS br_rows FROM br GROUP BY ledger_name),
gc AS ({_GC}),
ya AS (SELECT year(altered_on) AS y, COUNT(*) AS n_all, COUNT(*) FILTER (WHERE {biz()}) AS n_biz
       FROM ledgers WHERE altered_on IS NOT NULL GROUP BY 1),
tot AS (SELECT COUNT(*) FILTER (WHERE {biz()}) AS n_biz FROM ledgers),
ny AS (SELECT COUNT(*) AS n_years FROM ya),
j AS (
  SELECT qa.*, COALESCE(pn.n_matches, 0) AS n, pn.first_name, COALESCE(sr.n_search, 0) AS n_search,
         stc.st_rows, COALESCE(brc.br_rows, 0) AS br_rows, gc.n_rows AS g_rows, gc.answer,
         COALESCE(ya.n_all, 0) AS y_all,
         CASE WHEN qa.year IS NULL THEN (SELECT n_biz FROM tot) ELSE COALESCE(ya.n_biz, 0) END AS rk_biz
  FROM qa LEFT JOIN pn ON qa.name = pn.name LEFT JOIN sr ON qa.name = sr.name
  LEFT JOIN stc ON pn.first_name = stc.ledger_name LEFT JOIN brc ON pn.first_name = brc.ledger_name
  LEFT JOIN gc ON qa.route = gc.g_route LEFT JOIN ya ON qa.year = ya.y
)
SELECT q_id, question, route,
  CASE WHEN route IN ('balance_prompt', 'parent_prompt') THEN 'prompt'
       WHEN route = 'general_query' THEN 'help'
       WHEN route IN {_GLOBAL_IN} THEN 'answered'
       WHEN route = 'ranking_query' THEN CASE WHEN year IS NOT NULL AND y_all = 0 THEN 'no_data' ELSE 'answered' END
       WHEN NOT has_name THEN 'clarification'
       WHEN route = 'search_query' THEN CASE WHEN n_search = 0 THEN 'not_found' ELSE 'answered' END
       WHEN n = 0 THEN 'not_found'
       WHEN route IN {_LOOKUP} THEN CASE WHEN n = 1 THEN 'answered' ELSE 'clarification' END
       WHEN route = 'br_query' THEN CASE WHEN br_rows = 0 THEN 'no_data' ELSE 'answered' END
       ELSE 'answered' END AS status,
  CASE WHEN route IN {_NAME_ROUTES} AND has_name AND n > 0
            AND (route IN ('statement_query', 'br_query') OR n = 1) THEN first_name END AS ledger,
  CAST(CASE WHEN route IN ('balance_prompt', 'parent_prompt', 'general_query') THEN 0
       WHEN route IN {_GLOBAL_IN} THEN g_rows
       WHEN route = 'ranking_query' THEN
            CASE WHEN year IS NOT NULL AND y_all = 0 THEN (SELECT n_years FROM ny)
                 ELSE least(COALESCE(count, 10), rk_biz) END
       WHEN NOT has_name THEN 0
       WHEN route = 'search_query' THEN least(n_search, 15)
       WHEN route IN {_LOOKUP} THEN least(n, 10)
       WHEN n = 0 THEN 0
       WHEN route = 'statement_query' THEN COALESCE(st_rows, 2)
       ELSE br_rows END AS BIGINT) AS n_rows, answer
FROM j""")

ORACLES["br_request"] = q(QUESTIONS + BR_WHOLE + """
, bq AS (SELECT q_id, ledger_name AS name FROM qp WHERE route = 'br_query' AND length(ledger_name) > 0),
fm AS (SELECT b.q_id, min(l.ledger_name) AS ledger_name FROM bq b JOIN ledgers l
         ON contains(lower(l.ledger_name), lower(b.name)) GROUP BY b.q_id)
SELECT fm.ledger_name, fm.q_id, br.financial_year, br.source, br.seq, br.br_date, br.br_no, br.party, br.amount,
       br.due_date, br.status, br.total_br
FROM fm JOIN br USING (ledger_name)""")

# --- N4: the answers themselves, R13: how names resolve ------------------------------
_GLOBAL_ROWS = " UNION ALL ".join(
    f"SELECT '{r}' AS route, section, rank, name, parent, amount FROM ({ORACLES[k]})" if k != "pending_report" else
    f"SELECT '{r}', 'pending', rank, ledger_name, parent, closing_balance FROM ({ORACLES[k]})"
    for r, k in _GLOBAL.items())
_NO_ROW = "NULL AS name, NULL AS parent, NULL AS number, NULL AS amount"

ORACLES["answer_rows"] = q(QUESTIONS + BR + f"""
, st AS ({FY_STATEMENT}),
qa AS (SELECT q_id, route, count, year, balance_type, "order" AS ord,
              CASE WHEN length(ledger_name) > 0 THEN ledger_name END AS name FROM qp),
nm AS (SELECT DISTINCT name FROM qa WHERE route IN {_NAME_ROUTES} AND name IS NOT NULL),
hits AS (
  SELECT n.name AS ask, l.*, COUNT(*) OVER (PARTITION BY n.name) AS n,
         row_number() OVER (PARTITION BY n.name ORDER BY l.ledger_name) AS place
  FROM nm n JOIN ledgers l ON contains(lower(l.ledger_name), lower(n.name))
),
firsts AS (SELECT ask, ledger_name FROM hits WHERE place = 1),
found AS (
  SELECT n.name AS ask, l.*, row_number() OVER (PARTITION BY n.name ORDER BY
           CASE WHEN contains(lower(l.ledger_name), lower(n.name)) THEN 0 ELSE 1 END, l.ledger_name, l.parent) AS place
  FROM nm n JOIN ledgers l ON contains(lower(l.ledger_name), lower(n.name)) OR contains(lower(l.parent), lower(n.name))
),
scoped AS (
  SELECT CAST(year(altered_on) AS INTEGER) AS y, ledger_name, parent, closing_balance FROM ledgers WHERE altered_on IS NOT NULL
  UNION ALL SELECT 0, ledger_name, parent, closing_balance FROM ledgers
),
heads AS (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY closing_balance DESC, ledger_name) AS hi,
            row_number() OVER (PARTITION BY y ORDER BY closing_balance, ledger_name) AS lo
  FROM scoped WHERE {biz()}
),
years AS (SELECT y, row_number() OVER (ORDER BY y) AS place FROM (SELECT DISTINCT y FROM scoped WHERE y > 0)),
gl AS (SELECT route, row_number() OVER (PARTITION BY route ORDER BY section, rank NULLS FIRST, name NULLS FIRST) AS seq,
              section, name, parent, amount FROM ({_GLOBAL_ROWS})),
res AS (SELECT q_id, route, name AS request, ledger_name FROM qa LEFT JOIN firsts ON name = ask
        WHERE route IN ('statement_query', 'br_query')),
rep AS (
  SELECT 'statement_query' AS route, ledger_name, seq, voucher_no AS number, balance AS amount FROM st
  UNION ALL SELECT 'br_query', ledger_name, seq, br_no, amount FROM br
),
a AS (
  SELECT q_id, route, CASE WHEN n = 1 THEN 'answered' ELSE 'clarification' END AS status, place AS seq,
    CASE WHEN n = 1 THEN 'resolved' ELSE 'clarification' END AS section, ledger_name AS name, parent, NULL AS number,
    CASE WHEN route = 'balance_query' AND balance_type = 'opening' THEN opening_balance ELSE closing_balance END AS amount
  FROM qa JOIN hits ON qa.name = ask WHERE route IN {_LOOKUP} AND place <= 10
  UNION ALL SELECT q_id, route, 'not_found', 0, 'not_found', {_NO_ROW} FROM qa
  WHERE route IN {_LOOKUP} AND qa.name IS NOT NULL AND qa.name NOT IN (SELECT ask FROM hits)
  UNION ALL SELECT q_id, route, 'answered', place, 'found', ledger_name, parent, NULL, closing_balance
  FROM qa JOIN found ON qa.name = ask WHERE route = 'search_query' AND place <= 15
  UNION ALL SELECT q_id, route, 'not_found', 0, 'not_found', {_NO_ROW} FROM qa
  WHERE route = 'search_query' AND qa.name IS NOT NULL AND qa.name NOT IN (SELECT ask FROM found)
  UNION ALL SELECT q_id, route, 'clarification', 0, 'clarification', {_NO_ROW} FROM qa
  WHERE route IN {_NAME_ROUTES} AND qa.name IS NULL
  UNION ALL SELECT q_id, route, 'answered', CASE WHEN ord = 'ASC' THEN lo ELSE hi END, 'ranking', ledger_name, parent, NULL,
    closing_balance
  FROM qa JOIN heads ON COALESCE(year, 0) = y AND CASE WHEN ord = 'ASC' THEN lo ELSE hi END <= COALESCE(count, 10)
  WHERE route = 'ranking_query'
  UNION ALL SELECT q_id, route, 'no_data', place, 'available_year', NULL, NULL, NULL, y FROM qa, years
  WHERE route = 'ranking_query' AND year IS NOT NULL AND year NOT IN (SELECT y FROM scoped)
  UNION ALL SELECT q_id, qa.route, 'answered', seq, section, gl.name, parent, NULL, amount FROM qa JOIN gl USING (route)
  UNION ALL SELECT q_id, route, 'answered', seq, NULL, ledger_name, NULL, number, amount FROM res JOIN rep USING (route, ledger_name)
  UNION ALL SELECT q_id, route, 'no_data', 0, 'no_data', ledger_name, NULL, NULL, NULL FROM res
  WHERE ledger_name IS NOT NULL AND (route, ledger_name) NOT IN (SELECT (route, ledger_name) FROM rep)
  UNION ALL SELECT q_id, route, 'not_found', 0, 'not_found', {_NO_ROW} FROM res WHERE request IS NOT NULL AND ledger_name IS NULL
  UNION ALL SELECT q_id, route, CASE WHEN route = 'general_query' THEN 'help' ELSE 'prompt' END, 0,
    CASE WHEN route = 'general_query' THEN 'help' ELSE 'prompt' END, {_NO_ROW} FROM qa
  WHERE route IN ('general_query', 'balance_prompt', 'parent_prompt')
)
SELECT q_id, route, status, CAST(seq AS BIGINT) AS seq, section, name, parent, number, CAST(amount AS DOUBLE) AS amount FROM a""")

ORACLES["request_status"] = q(QUESTIONS + """
, rq AS (SELECT q_id, route, CASE WHEN length(ledger_name) > 0 THEN ledger_name END AS request
         FROM qp WHERE route IN ('statement_query', 'br_query')),
rn AS (SELECT DISTINCT request FROM rq WHERE request IS NOT NULL),
ex AS (SELECT request, min(ledger_name) AS ledger_name FROM rn JOIN ledgers ON lower(ledger_name) = lower(request) GROUP BY 1),
hit AS (SELECT * FROM ex UNION ALL
        SELECT DISTINCT request, ledger_name FROM rn JOIN ledgers ON contains(lower(ledger_name), lower(request))
        WHERE request NOT IN (SELECT request FROM ex)),
per AS (SELECT request, COUNT(*) AS n, min(ledger_name) AS one FROM hit GROUP BY 1),
opt AS (SELECT request, string_agg(ledger_name, '; ' ORDER BY ledger_name) AS options FROM (
          SELECT *, row_number() OVER (PARTITION BY request ORDER BY ledger_name) AS p FROM hit) WHERE p <= 5 GROUP BY 1)
SELECT q_id, route, request, CASE WHEN request IS NULL OR n > 1 THEN 'clarification' WHEN n = 1 THEN 'answered'
         ELSE 'not_found' END AS status,
       CASE WHEN n = 1 THEN one END AS ledger_name, COALESCE(n, 0) AS n_matches, COALESCE(options, '') AS options
FROM rq LEFT JOIN per USING (request) LEFT JOIN opt USING (request)""")
