"""Plain-English questions as a batch job over a questions table.

Each question is one row; routing and parameter extraction are column
expressions (``regexp_extract``, ``rlike``, ``contains``), so a million
questions are a scan, not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import normalize
from ledgerflow.functions.text import WS_CLASS
from ledgerflow.operators.windows import running_sums

# --- fixed values: routes (first hit wins), keyword lists and patterns -----------
ROUTES = [
    ("statement_query", "re", "statement"),
    ("br_query", "re", r"br|bill\s+receivable"),
    ("financial_analysis", "any", ["profit", "loss", "income", "expense", "revenue"]),
    ("pending_analysis", "any", ["pending", "due", "outstanding", "unpaid"]),
    ("comparative_analysis", "any", ["compare", "versus", "vs", "difference"]),
    ("trend_analysis", "any", ["trend", "history", "over time", "growth"]),
    ("summary_report", "any", ["summary", "overview", "report", "status"]),
    ("search_query", "any", ["search", "find", "look for", "information about"]),
    ("balance_query", "any", ["balance", "amount", "how much"]),
    ("parent_query", "any", ["parent", "group", "category"]),
    ("ranking_query", "any", ["top", "best", "highest", "most", "worst", "lowest"]),
]
GENERAL_ROUTE = "general_query"
FY_PATTERN = r"(\d{4})-(\d{4})"
YEAR_PATTERN = r"\b(20\d{2})\b"
NUMBER_PATTERN = r"\b(\d+)\b"
LEDGER_PATTERNS = [
    r"statement.*?(?:of|for)\s*(.+)",
    r"br.*?(?:of|for)\s*(.+)",
    r"bill\s+receivable.*?(?:of|for)\s*(.+)",
    r"balance.*?(?:of|for)\s*(.+)",
    r"parent.*?(?:of|for)\s*(.+)",
    r"information about\s*(.+)",
    r"details of\s*(.+)",
    r"who is\s*(.+)",
]
# literal each pattern needs (a cheap contains() test before running the regex)
PATTERN_GUARDS = ["statement", "br", "bill", "balance", "parent", "information about", "details of",
                  "who is"]
ASC_WORDS = ["lowest", "minimum", "worst", "bottom", "least"]
QUICK_COMMANDS = {
    "balance_query_prompt": "balance_prompt",
    "parent_query_prompt": "parent_prompt",
    "top_parties_report": "ranking_query",
    "profit_loss_report": "pnl_report",
    "business_summary": "summary_report",
    "pending_analysis": "pending_analysis",
    "trend_analysis": "trend_analysis",
}
BALANCE_PROMPT, PARENT_PROMPT = "balance_query_prompt", "parent_query_prompt"
TITLE_WIDTH = 35
# Question forms used to build the questions table from the customer table
# ({n} = a customer name); name-less forms rotate over the customers.
NAME_FORMS = [
    "balance of {n}", "opening balance of {n}", "parent of {n}", "statement of {n}",
    "statement of {n} for 1996-1997", "BR of {n}", "search for {n}", "who is {n}",
    "details of {n}", "information about {n}", "compare {n}", "what is the closing balance for {n}?",
]
PLAIN_FORMS = [
    "top 5 parties", "lowest 3 parties in 2001", "highest paying parties in 2000",
    "highest paying parties in 1998", "profit in 2000", "outstanding payments", "business summary",
    "trend analysis", "hello", "top 10 parties by balance", "find parent of X",
    "balance of Abraham", "top_parties_report", "pending_analysis", "profit_loss_report",
    "trend_analysis", "business_summary", "top 12 parties in 2024", "show pending vendors",
    "growth over time",
]
# -----------------------------------------------------------------------------------


def _lower(q: Column) -> Column:
    return F.lower(q)


def _any_contains(ql: Column, words: list[str]) -> Column:
    cond = None
    for w in words:
        c = F.contains(ql, F.lit(w))
        cond = c if cond is None else (cond | c)
    return cond


def _is_br(ql: Column) -> Column:
    """'br' or 'bill<ws>receivable' (the regex runs only when 'bill' is present)."""
    return F.contains(ql, F.lit("br")) | (F.contains(ql, F.lit("bill")) & ql.rlike(r"bill\s+receivable"))


def route(q: Column) -> Column:
    """Route of each question (unanchored substring, first hit wins)."""
    ql = _lower(q)
    expr = None
    for name, kind, pat in ROUTES:
        if kind == "re":
            cond = F.contains(ql, F.lit(pat)) if pat == "statement" else _is_br(ql)
        else:
            cond = _any_contains(ql, pat)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(GENERAL_ROUTE))


def _first_match(ql: Column, pattern: str, group: int, guard: str | None = None) -> Column:
    m = F.nullif(F.regexp_extract(ql, pattern, group), F.lit(""))
    return m if guard is None else F.when(F.contains(ql, F.lit(guard)), m)


def extract_params(q: Column) -> Column:
    """struct(financial_year, query_type, year, count, ledger_name, balance_type, order)."""
    ql = _lower(q)
    fy = _first_match(ql, FY_PATTERN, 0, "-")
    qtype = (F.when(F.contains(ql, F.lit("statement")), F.lit("statement"))
             .when(_is_br(ql), F.lit("br")))
    year_s = _first_match(ql, YEAR_PATTERN, 1, "20")
    year = year_s.cast("int")
    nums = F.regexp_extract_all(ql, F.lit(NUMBER_PATTERN), 1)
    # whole numbers 1..1000 other than the year's text; compare digits after
    # dropping leading zeros so huge numbers never overflow an int
    ok = F.filter(nums, lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 4)
                  & (F.regexp_replace(x, "^0+", "") != F.lit(""))
                  & (F.regexp_replace(x, "^0+", "").try_cast("int") <= 1000)
                  & (year_s.isNull() | (x != year_s)))
    count = F.when(ql.rlike(r"\d"), F.try_element_at(ok, F.lit(1)).cast("int"))
    raw_name = F.coalesce(*[_first_match(ql, p, 1, g) for p, g in zip(LEDGER_PATTERNS, PATTERN_GUARDS)])
    name = F.when(raw_name.isNotNull(), normalize(F.replace(raw_name, F.lit("?"), F.lit(""))))
    btype = (F.when(F.contains(ql, F.lit("opening")), F.lit("opening"))
             .otherwise(F.lit("closing")))
    order = F.when(_any_contains(ql, ASC_WORDS), F.lit("ASC")).otherwise(F.lit("DESC"))
    return F.struct(fy.alias("financial_year"), qtype.alias("query_type"), year.alias("year"),
                    count.alias("count"), name.alias("ledger_name"), btype.alias("balance_type"),
                    order.alias("order"))


def quick_command(q: Column) -> Column:
    """Exact trimmed command -> its route; null otherwise."""
    t = F.regexp_replace(q, rf"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")
    expr = None
    for cmd, r in QUICK_COMMANDS.items():
        expr = F.when(t == cmd, F.lit(r)) if expr is None else expr.when(t == cmd, F.lit(r))
    return expr


def routed(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """N3 then N1/N2: command, route, params for every question row."""
    q = F.col(text_col)
    cmd = quick_command(q)
    return questions.withColumns({
        "command": cmd,
        "route": F.coalesce(cmd, route(q)),
        "params": extract_params(q),
    })


def questions_table(customers: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Questions built from every customer (one per name form, plus one
    rotating name-less form each) and, when given, every user turn of the
    conversations table. Columns q_id (string), question."""
    n = F.col("c_name")
    k = F.col("c_custkey")
    named = [F.struct(F.lit(i).alias("form"), F.lit(f.split("{n}")[0]).alias("a"),
                      F.lit(f.split("{n}")[1]).alias("b")) for i, f in enumerate(NAME_FORMS)]
    c = customers.select(k, n, F.explode(F.array(*named)).alias("f"))
    named_q = c.select(F.concat(F.lit("c"), k.cast("string"), F.lit("-"), F.col("f.form").cast("string"))
                       .alias("q_id"), F.concat(F.col("f.a"), n, F.col("f.b")).alias("question"))
    plain = F.array(*[F.lit(p) for p in PLAIN_FORMS])
    plain_q = customers.select(
        F.concat(F.lit("p"), k.cast("string")).alias("q_id"),
        F.element_at(plain, (k % len(PLAIN_FORMS) + 1).cast("int")).alias("question"))
    out = named_q.unionByName(plain_q)
    if conversations is not None:
        conv = conversations.where(F.col("role") == "user").select(
            F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
            .alias("q_id"), F.col("text").alias("question"))
        out = out.unionByName(conv)
    return out


def conversation_titles(conversations: DataFrame) -> DataFrame:
    """First user message of each conversation, stripped, cut to 35 + '...'.
    An aggregate (min_by), so a long conversation is combined map-side."""
    u = conversations.where(F.col("role") == "user")
    first = u.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    t = F.regexp_replace(F.col("first"), rf"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")
    title = F.when(F.length(t) > TITLE_WIDTH, F.concat(F.substring(t, 1, TITLE_WIDTH), F.lit("..."))) \
        .otherwise(t)
    return first.select("conv_id", title.alias("title"))


TURN_BLOCK = 4096


def followup_rewrite(turns: DataFrame) -> DataFrame:
    """After a balance/parent prompt the next user message becomes
    'balance of <msg>' / 'parent of <msg>' (the flag is consumed once).

    A prompt that arrives while a flag is set is itself rewritten, so in a run
    of consecutive prompts only odd positions set a flag. Per conversation:
    idx = running count of user turns, run = running count of non-prompt turns
    (both from the skew-safe ``running_sums``); position in the run = idx minus
    the idx of the run's opening non-prompt turn; a turn is rewritten iff the
    previous user turn is an active (odd-position) prompt. Previous turns are
    found by equi-joins on (conv_id, idx - 1), never by collecting a conversation.
    Input: conv_id, turn, text (user turns). Output adds final_text, rewritten.
    """
    t = F.regexp_replace(F.col("text"), rf"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")
    base = turns.withColumns({
        "stripped": t,
        "is_prompt": t.isin(BALANCE_PROMPT, PARENT_PROMPT),
        "prompt_kind": F.when(t == BALANCE_PROMPT, F.lit("balance"))
                        .when(t == PARENT_PROMPT, F.lit("parent")),
        "tblock": F.floor(F.col("turn") / F.lit(TURN_BLOCK)),
    })
    rs = running_sums(base, ["conv_id"], ["tblock", "turn"],
                      {"idx": F.lit(1).cast("long"),
                       "run": F.when(F.col("is_prompt"), F.lit(0)).otherwise(F.lit(1)).cast("long")})
    opener = rs.where(~F.col("is_prompt")).select("conv_id", "run", F.col("idx").alias("open_idx"))
    pos = (rs.join(opener, ["conv_id", "run"], "left")
           .withColumn("k", F.col("idx") - F.coalesce(F.col("open_idx"), F.lit(0)))
           .withColumn("active", F.col("is_prompt") & (F.col("k") % 2 == 1)))
    prev = pos.select("conv_id", (F.col("idx") + 1).alias("idx"),
                      F.col("active").alias("prev_active"), F.col("prompt_kind").alias("prev_kind"))
    j = pos.join(prev, ["conv_id", "idx"], "left")
    rewritten = F.coalesce(F.col("prev_active"), F.lit(False))
    final = F.when(rewritten, F.concat(F.col("prev_kind"), F.lit(" of "), F.col("stripped"))) \
        .otherwise(F.col("stripped"))
    return j.select("conv_id", "turn", "text", final.alias("final_text"), rewritten.alias("rewritten"))


def prompt_turns(conversations: DataFrame) -> DataFrame:
    """User turns of the conversations table with prompt commands put in by key
    (h = (7*conv_id + turn) % 6: 0/1 -> balance prompt, 2 -> parent prompt), so
    runs of consecutive prompts occur; every user turn is kept."""
    u = conversations.where(F.col("role") == "user")
    h = (F.col("conv_id") * 7 + F.col("turn")) % 6
    text = (F.when(h <= 1, F.lit(BALANCE_PROMPT)).when(h == 2, F.lit(PARENT_PROMPT))
            .otherwise(F.col("text")))
    return u.select("conv_id", "turn", text.alias("text"))
