"""Centroid clustering, ranked search, divergence rules: brute force and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerflow.llm import divergence_rules, nra_search, simplex_clusters
from ledgerflow.llm.common import importable

BIG = (1 << 60) + 1


@pytest.fixture(scope="module")
def sp(spark):
    importable(spark)
    return spark


# --- centroid clustering ---------------------------------------------------------------

def brute_clusters(rows, k, rounds, scale, dim):
    kept = [(i, [math.floor(scale * float(x)) if abs(x) < 2 ** 53 else scale * int(x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cent = [v for _, v in start[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(cent)), key=lambda j: (dist(v, cent[j]), j))
    for _ in range(rounds):
        groups = [[] for _ in cent]
        for _, v in kept:
            groups[near(v)].append(v)
        cent = [[sum(c) // len(g) for c in zip(*g)] if g else cent[j] for j, g in enumerate(groups)]
    at = [(i, v, near(v)) for i, v in kept]
    each = Counter()
    for _, v, j in at:
        each[j] += dist(v, cent[j])
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    fit = lambda x: x if x < 1 << 63 else None
    gap = {j: any(dist(v, cent[j]) >= 1 << 63 for _, v, a in at if a == j) for j in range(len(cent))}
    whole = None if any(gap.values()) else fit(sum(each.values()))
    return sorted(((i or 0, j, fit(dist(v, cent[j])) or 0, (None if gap[j] else fit(each[j])) or 0, whole or 0, names[j])
                   for i, v, j in at))


def clustered(sp, rows, **kw):
    df = sp.createDataFrame([(i, v, "c", 0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, x int")
    out = simplex_clusters.clusters(df, **kw).collect()
    return sorted(tuple(0 if x is None else x for x in r) for r in out)


@pytest.mark.parametrize("pivots", [0, 1, 6])
def test_clusters_match_brute_force(sp, pivots):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for i in range(300)]
    rows += [(i, list(rows[i][1])) for i in range(40)]  # repeated rows
    rows += [(400 + i, [0.5] * 5) for i in range(30)]  # equal vectors
    rows += [(500, None), (501, [1.0, 2.0]), (502, [1.0, None, 1.0, 1.0, 1.0]), (503, [float("nan")] * 5),
             (504, [float("inf")] + [0.0] * 4), (None, [0.1] * 5), (BIG, [-0.2] * 5)]
    got = clustered(sp, rows, k=8, rounds=10, dim=5, pivots=pivots)
    assert got == brute_clusters(rows, 8, 10, 1024, 5)
    assert BIG in {r[0] for r in got}


def test_clusters_of_wide_components_few_vectors_and_empty_tables(sp):
    rows = [(i, [float(i) * 10.0 ** (i % 12), -1e30 if i % 5 == 0 else 3.25, 0.1]) for i in range(40)]
    assert clustered(sp, rows, k=3, rounds=4, dim=3) == brute_clusters(rows, 3, 4, 1024, 3)
    few = [(1, [0.25, 1.0]), (2, [0.5, -1.0])]
    assert clustered(sp, few, dim=2) == brute_clusters(few, 8, 10, 1024, 2)
    assert clustered(sp, [(1, None)], dim=2) == []
    same = [(i, [1.0, 1.0]) for i in range(20)]
    assert clustered(sp, same, dim=2) == brute_clusters(same, 8, 10, 1024, 2)


def test_simplex_bounds_hold_and_leave_centroids_out():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 3000, (8, 16))
    v = np.floor(centres[rng.integers(0, 8, 500)] + rng.normal(0, 300, (500, 16))).astype(np.int64)
    c = np.floor(centres).astype(np.int64)
    simplex = simplex_clusters.Simplex(v[:64], 6)
    assert len(simplex.pivots) == 6
    a, t = simplex.apexes(v), simplex.apexes(c)
    true = np.sqrt(simplex_clusters.squared(v, c).astype(float))
    low, high = simplex_clusters.bounds(a, t)
    assert (low <= true + 1e-3).all() and (true <= high + 1e-3).all()
    at, d, out = simplex_clusters.nearest(v, a, c, t)
    assert (at == true.argmin(axis=1)).all() and (d == simplex_clusters.squared(v, c).min(axis=1)).all()
    assert out > 0.5 * true.size


# --- ranked lexical search -------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items, k):
    bags = [(i, Counter(brute_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(brute_terms(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // length
            s = sum(w[t] * ((10 ** 9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=lambda r: (r[0], r[1]))


def ranks(sp, docs, items, **kw):
    d = sp.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id long, text string, row string, term int")
    q = sp.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, block string")
    out = nra_search.ranked(d, q, **kw).collect()
    return sorted((tuple(r) for r in out), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("shard,block", [(8192, 500), (40, 3)])
def test_ranks_match_brute_force(sp, shard, block):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "ß9", "the", "THE"]
    draw = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.08)), 63)] for _ in range(n))
    docs = [(i, draw(rng.randrange(1, 120))) for i in range(400)]
    docs += [(i, docs[i][1]) for i in range(30)] + [(1000 + i, docs[5][1].upper()) for i in range(20)]  # copies and ties
    docs += [(None, docs[3][1]), (BIG, docs[3][1]), (5000, None), (5001, ""), (5002, " .,- "), (5003, draw(30_000))]
    items = [(i, draw(rng.randrange(1, 25))) for i in range(12)] + [(20, None), (21, "zzz"), (None, "w1"), (3, "w2 w2 W3")]
    assert ranks(sp, docs, items, k=10, shard=shard, block=block) == brute_ranks(docs, items, 10)


def test_ranks_of_empty_tables(sp):
    assert ranks(sp, [(1, "a b")], []) == []
    assert ranks(sp, [], [(1, "a b")]) == []
    assert ranks(sp, [(1, "a")], [(1, "a")]) == brute_ranks([(1, "a")], [(1, "a")], 10)


def test_nra_resolves_members_ties_and_scores_before_reading_all():
    rng = np.random.default_rng(1)
    for trial in range(60):
        size, lists, total = 300, [], np.zeros(300, np.int64)
        for _ in range(rng.integers(1, 7)):
            docs = rng.permutation(size)[:rng.integers(1, size)]
            top = rng.choice([3, 50, 10 ** 6])
            impacts = np.sort(rng.integers(1, top + 1, len(docs)))[::-1].astype(np.int64)
            lists.append((docs, impacts))
            total[docs] += impacts
        ids = rng.permutation(size) * 3
        want = sorted(((-int(s), int(ids[d]), d) for d, s in enumerate(total) if s))[:10]
        got, _ = nra_search.nra(lists, ids, 10, depth=int(rng.integers(1, 40)))
        assert [(d, s) for d, s in got] == [(d, -s) for s, _, d in want]
    steep = [(np.arange(5000), np.sort(rng.integers(1, 1 << 40, 5000))[::-1]) for _ in range(2)]
    _, read = nra_search.nra(steep, np.arange(5000), 10, depth=16)
    assert read < 2000


# --- divergence rules ------------------------------------------------------------------

def brute_base(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    again = {i + o for i in range(len(ws) - 2) if windows[tuple(ws[i:i + 3])] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(again), len(ws) < 50 or 100 * len(again) > 50 * len(ws))


def rule_texts():
    rng = random.Random(3)
    prose = lambda n, v=300: " ".join(f"{chr(97 + rng.randrange(26))}{rng.randrange(v)}x" for _ in range(n))
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n\n \nx\r\nx",
             "# * $ a|b <c> && %", "é à ü 漢字 𝔘𝔫 ½", "a\x00b \x01 c", "a b c d a b c d e a b", "  a b"]
    texts += [prose(n) for n in (49, 50, 51, 120, 400)] + [prose(400, 4), prose(20) + "\n" + "k l m n\n" * 90, prose(30_000)]
    return texts


def test_base_measures_match_brute_force(sp):
    texts = rule_texts()
    docs = sp.createDataFrame([(i, t, "en", "w", "r") for i, t in enumerate(texts)],
                              "doc_id long, text string, lang string, ws string, ref string")
    got = {r["doc_id"]: tuple(r)[1:7] for r in divergence_rules.judged(docs).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def js(p, q):
    p, q = np.array(p, float) / max(1, sum(p)), np.array(q, float) / max(1, sum(q))
    m = (p + q) / 2
    h = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
    return math.sqrt(max(0.0, (h(p) + h(q)) / 2))


def prose_rows(rng, lang, words, n, start):
    weights = [1 / (i + 1) for i in range(len(words))]
    line = lambda k: " ".join(rng.choices(words, weights, k=k))
    return [(start + i, line(rng.randrange(100, 400)), lang) for i in range(n)]


def test_distances_and_verdicts(sp):
    rng = random.Random(5)
    first, second = [f"{a}{b}a" for a in "bcdfg" for b in "aeiou"], [f"{a}{b}é" for a in "klmnp" for b in "aeiou"]
    # enough of other words that windows seldom repeat
    first, second = first + [f"q{i}u" for i in range(3000)], second + [f"ö{i}" for i in range(3000)]
    rows = prose_rows(rng, "l1", first, 60, 0) + prose_rows(rng, "l2", second, 40, 100) + [(200, prose_rows(rng, "", first, 1, 0)[0][1], None)]
    junk = " ".join(f"{rng.choice(first)}{rng.choice('#$%')}{rng.choice('#$%')}{rng.choice('#$%')}" for _ in range(300))
    rows += [(300, junk, "l1"), (301, rows[70][1], "l1"), (302, rows[3][1], "l2"), (303, rows[3][1], "l1")]
    rows += [(400, "a b c " * 60, "l1"), (401, None, "l1"), (402, "x", "zz"), (None, rows[3][1], "l1"), (303, rows[3][1], "l1")]
    docs = sp.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, classes int, key string")
    got = divergence_rules.judged(docs).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in [*range(60), *range(100, 140), 303])
    assert kept[None] and not any(kept[i] for i in (300, 301, 302, 400, 401, 402))
    assert len({tuple(r) for r in got if r["doc_id"] == 303}) == 1
    # the word distance by hand
    ref = Counter(w for _, t, lang in rows if lang == "l1" and t and len(t) >= divergence_rules.MIN_CHARS for w in t.split())
    total = sum(ref.values())
    common = [w for w, n in ref.items() if n * divergence_rules.COMMON >= total]
    bag = Counter(rows[0][1].split())
    p, q = [bag[w] for w in common], [ref[w] for w in common]
    want = js(p + [sum(bag.values()) - sum(p)], q + [total - sum(q)])
    assert abs(next(r for r in got if r["doc_id"] == 0)["word_distance"] - want) < 1e-9


def test_rules_run_without_python_and_on_empty_tables(sp):
    docs = sp.createDataFrame([], "doc_id long, text string, lang string")
    assert divergence_rules.judged(docs).collect() == []
    some = sp.createDataFrame([(1, "a b " * 40, None), (2, None, None)], "doc_id long, text string, lang string")
    refs = divergence_rules.word_references(some)
    for df in (divergence_rules.judged(some), divergence_rules.measures(some, refs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert divergence_rules.judged(some).count() == 2
