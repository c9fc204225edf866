"""Index, near duplicates, containment, top-k, chaining: brute force and edge cases."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ledgerflow.llm import bbit_minhash, chaining, containment, topk_inner, warc_index
from ledgerflow.llm.common import importable, parted
from ledgerflow.llm.components import connected_components

DOCS = "doc_id long, text string, sig string, component_id string"


@pytest.fixture(scope="module")
def sp(spark):
    importable(spark)
    return spark


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def brute_components(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def doc_rows():
    rng = random.Random(1)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.choice([8, 40, 150, 400]))
        texts += [base, base.upper()] + [edited(rng, base, s) for s in (0.005, 0.01, 0.02, 0.04, 0.08)]
    texts += [None, "", "  \n\t ", "one", "ONE", "one two", "a b c", prose(rng, 30_000)]
    return list(enumerate(texts))


@pytest.mark.parametrize("k,threshold,block", [(3, 0.85, 1 << 20), (5, 0.8, 600)])
def test_near_duplicates_match_brute_force(sp, k, threshold, block):
    rows = doc_rows()
    docs = sp.createDataFrame([(i, t, "s", "c") for i, t in rows], DOCS)
    got = {r["doc_id"]: r for r in bbit_minhash.near_duplicates(docs, k, threshold, block).collect()}
    want = brute_components(rows, k, round(threshold * 100), 100)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_nulls_repeats_and_empty_tables(sp):
    docs = sp.createDataFrame([(None, "a b c d e f", "", ""), (1, "a b c d e f", "", ""), (1, "a b c d e f", "", ""),
                               (2, "a b c d e f", "", ""), (3, None, "", "")], DOCS)
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in bbit_minhash.near_duplicates(docs).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert bbit_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_bit_counts_estimate_similarity():
    rng = np.random.default_rng(3)
    a, b = bbit_minhash.permutations(512)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for shared in (0, 500, 1000):
        x, y = pool[:1000], np.concatenate([pool[:shared], pool[1500:2500 - shared]])
        want = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        sx, sy = (np.frombuffer(bbit_minhash.pack_low_bits(bbit_minhash.minima(s, a, b)), np.uint64) for s in (x, y))
        assert abs(bbit_minhash.estimate(sx, sy[None, :], 512)[0] - want) < 0.1


def test_components_match_union_find(sp):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    edges += [(2000, 2000 + i) for i in range(1, 50)]
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    want, seen = {}, set()
    for start in sorted(near):
        if start in seen:
            continue
        todo, part = [start], set()
        while todo:
            x = todo.pop()
            if x not in part:
                part.add(x)
                todo += near[x]
        seen |= part
        want |= {x: start for x in part if len(part) > 1}
    got = connected_components(sp.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == want
    assert connected_components(sp.createDataFrame([], "u long, v long")).count() == 0


def test_containment_matches_brute_force(sp):
    rng = random.Random(2)
    items = [(i, prose(rng, n)) for i, n in enumerate((3, 5, 14, 30, 59, 200))] + [(90, None), (91, " "), (92, "lone")]
    docs = [(i, prose(rng, 2000) + " " + edited(rng, items[i % 6][1], s).upper() + "\n" + prose(rng, 50))
            for i, s in enumerate((0, 0, 0, 0, 0, 0, .02, .02, .02, .02, .01, .01, .3, .3, .3))] + [(70, None), (71, "x")]
    got = containment.contained_items(sp.createDataFrame(docs, "doc_id long, text string"),
                                      sp.createDataFrame(items + items[:2], "item_id long, text string"))
    grams = lambda w, k: {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
    want = set()
    for d, text in docs:
        for i, item in items:
            w, iw = ((t or "").lower().split() for t in (text, item))
            g = grams(iw, min(5, len(iw))) if iw else set()
            n = len(g & grams(w, min(5, len(iw)))) if g else 0
            if g and 10 * n >= 8 * len(g):
                want.add((d, i, len(g), n))
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in got.collect()} == want
    assert len(want) >= 9


def test_top_k_matches_brute_force(sp):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, .2 + i % 7, 24)]) for i in range(600)]
    rows += [(600 + i, rows[50][1]) for i in range(40)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 24),
                                                          (950, [float("inf")] * 24), (1000, rows[3][1][:5])]
    table = sp.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, norm int")
    ints = {}
    for r in table.collect():
        v = r["embedding"]
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints[r["vec_id"]] = np.floor(256 * np.array(v + [0.0] * (24 - len(v)))).astype(np.int64)
    want = set()
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ ints[i]), i) for i in ints if i != q)[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_inner.top_k_inner(table).collect()}
    assert got == want
    assert topk_inner.top_k_inner(table.limit(0)).count() == 0


def test_loser_tree_merges_any_runs():
    rng = random.Random(6)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc_index.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_archives_round_trip(sp):
    tricky = "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n é𝔘"
    rows = [(1, "http://B.example.org:80/x?q=1#f", "same"), (2, "http://a.example.org/", "same"), (3, None, None),
            (4, "http://a.example.org/", ""), (5, "bad\nurl%", tricky), (None, "http://a.example.org/", "own"),
            (7, "http://a.example.org/", tricky * 3000), (7, "http://a.example.org/", tricky * 3000)]
    pages = sp.createDataFrame(rows, "page_id long, url string, html string")
    got = warc_index.capture_index(pages).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got) == [
        (0, "response", None), (1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None),
        (5, "response", None), (7, "response", None), (7, "response", None)]
    assert {(r["page_id"], r["url"], r["payload_bytes"]) for r in got} == {
        (i, u, len((h or "").encode())) for i, u, h in rows}
    keys = [(r["url_key"], r["capture_time"]) for r in got]
    assert keys == sorted(keys)
    assert warc_index.capture_index(pages.limit(0)).count() == 0


def test_repeated_passages_are_found_and_cut(sp):
    rng = random.Random(8)
    passage = prose(rng, 80)
    docs = [(i, prose(rng, 300) + "\n" + edited(rng, passage, s) + " " + prose(rng, 200))
            for i, s in enumerate((0, 0, 0.04, 0))] + [(10 + i, prose(rng, 200)) for i in range(5)]
    docs += [(20, None), (21, ""), (22, passage), (23, prose(rng, 25_000) + " " + passage)]
    df = sp.createDataFrame([(i, t, len(t or "")) for i, t in docs], "doc_id long, text string, n_chars long")
    found = chaining.repeated_passages(df)
    got = defaultdict(int)
    for r in found.collect():
        assert r["doc_id"] > r["other_doc_id"]
        got[r["doc_id"]] = max(got[r["doc_id"]], r["n_words"])
    assert set(got) == {1, 2, 3, 22, 23} and all(n >= 60 for n in got.values())
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in chaining.without_passages(df, found).collect()}
    assert set(left) == {i for i, _ in docs} - {22}
    assert left[0][0] == docs[0][1] and left[20] == (None, 0)
    for i in (1, 3, 23):
        assert left[i][0].split() == (docs[i if i < 20 else -1][1]).replace(passage, " ").split()
        assert left[i][1] == len(left[i][0])
    assert chaining.repeated_passages(df.limit(0)).count() == 0


def test_winnowing_keeps_the_least_of_every_window():
    rng = np.random.default_rng(9)
    for n in (0, 1, 5, 16, 17, 300):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64)
        got = set(chaining.winnow(h, 16).tolist())
        want = {i + 16 - 1 - int(np.argmin(h[i:i + 16][::-1])) for i in range(max(0, n - 15))}
        assert got == want or n < 17 and len(got) == (1 if n else 0)


def brute_chain_scores(segs, k):
    """Best score of a chain that ends in each segment, over all segments before it."""
    half, score = chaining.GAP_COST / 2, [x[3] for x in segs]
    for x in sorted(range(len(segs)), key=lambda i: (segs[i][0], segs[i][2])):
        s, _, o, own = segs[x]
        for y, (ys, ye, yo, _) in enumerate(segs):
            end, oend = ye - (k - 1), yo + ye - ys - (k - 1)
            if end <= s and oend <= o:
                score[x] = max(score[x], own + score[y] - half * (s - end + o - oend))
    return score


def test_chains_match_brute_force():
    rng = np.random.default_rng(11)
    for n, reach in ((60, 200), (80, 800), (40, 3000), (1, 10)):
        p, q = rng.integers(0, reach, n), rng.integers(0, reach, n)
        run = np.arange(0, 90, 9)  # passages one after the other, each beyond the last one's reach
        at = [(0, 5), (200, 150), (350, 900), (600, 400)]
        p = np.concatenate([p] + [a + run for a, _ in at])
        q = np.concatenate([q] + [b + run for _, b in at])
        segs = chaining.segments(p, q, 5)
        assert all(e > s for s, e, _, _ in segs) and len(segs) <= len(p)
        found = chaining.chains(segs, 5)
        assert sorted(x for c in found for x in c) == list(range(len(segs)))
        want = brute_chain_scores(segs, 5)
        score, half = {}, chaining.GAP_COST / 2
        whole = []  # the best chain before it was cut at gaps
        for c in found:
            steps = [segs[x] for x in c]
            for (s, e, o, _), (t, _, u, _) in zip(steps, steps[1:]):
                assert e - 4 <= t and o + e - s - 4 <= u and max(t - e, u - o - e + s) <= chaining.MAX_GAP
            got = steps[0][3]
            for (s, e, o, _), (t, _, u, own) in zip(steps, steps[1:]):
                got += own - half * (t - e + 4 + u - (o + e - s) + 4)
            score[c[-1]] = got
            whole.append(got)
        # no chain scores more than the best to its end, and where none was cut it is that
        assert all(v <= want[x] + 1e-9 for x, v in score.items())
    for _ in range(30):  # dense: nothing to cut
        p = np.sort(rng.integers(0, 60, 25))
        q = rng.integers(0, 40, 25)
        segs = chaining.segments(p, q, 5)
        want = brute_chain_scores(segs, 5)
        first = chaining.chains(segs, 5)[0]
        steps, half = [segs[x] for x in first], chaining.GAP_COST / 2
        got = steps[0][3] + sum(b[3] - half * (b[0] - a[1] + 4 + b[2] - (a[2] + a[1] - a[0]) + 4) for a, b in zip(steps, steps[1:]))
        assert got == pytest.approx(max(want))


def test_links_go_to_the_document_before():
    rng = np.random.default_rng(5)
    rows = sorted({(int(h), int(d), (int(t) << 32) + int(p)) for h, d, t, p in zip(
        rng.integers(0, 12, 900), rng.integers(0, 30, 900), rng.integers(0, 2, 900), rng.integers(0, 50, 900))})
    runs = {}
    for r in rows:
        runs.setdefault(r[0], {}).setdefault((r[1], r[2] >> 32), []).append(r)
    want, later = {}, set()
    for docs in runs.values():
        docs = list(docs.values())
        later |= set(docs[0][1:])
        for one, two in zip(docs, docs[1:]):
            want |= {r: one[min(n, len(one) - 1)][1:] for n, r in enumerate(two)}
    for step in (1, 3, 7, 1000):
        linker, got, hid = chaining._Linker(), {}, set()
        for a in range(0, len(rows), step):
            found, hidden = linker.links(tuple(np.array(c, np.int64) for c in zip(*rows[a:a + step])))
            for d, t, o, u, h in zip(*(x.tolist() for x in found)):
                got[(h, d, t)] = (o, u)
            hid |= set(zip(*(x.tolist() for x in hidden)))
        assert {k for k in got} == set(want) and hid == later
        assert all(got[k][0] == want[k][0] for k in want)
        assert step < 1000 or got == want


@pytest.mark.parametrize("parts", ["2", "9"])
def test_edited_passages_whose_halves_come_from_other_documents(sp, parts):
    rng = random.Random(21)
    x, y = prose(rng, 32), prose(rng, 32)
    docs = [(1, prose(rng, 90) + " " + x + " " + prose(rng, 60)), (2, prose(rng, 90) + " " + y + " " + prose(rng, 60))]
    docs += [(10 + i, prose(rng, 70) + " " + edited(rng, x + " " + y, 0.04) + " " + prose(rng, 50)) for i in range(31)]
    docs += [(100 + i, prose(rng, 150)) for i in range(20)]
    before = sp.conf.get("spark.sql.shuffle.partitions")
    sp.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = chaining.repeated_passages(sp.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        sp.conf.set("spark.sql.shuffle.partitions", before)
    got = {r["doc_id"] for r in found}
    assert len(got & set(range(11, 41))) >= 28 and not got & {1, 2, *range(100, 120)}


def test_passages_belong_to_their_text_and_helper_names_do_not_clash(sp):
    rng = random.Random(22)
    passage = prose(rng, 70)
    big = (1 << 60) + 1
    one, two = prose(rng, 40) + " " + passage + " " + prose(rng, 40), prose(rng, 300)
    docs = [(1, passage + " " + prose(rng, 30)), (5, one), (5, two), (5, one), (None, one), (big, one), (big + 2, prose(rng, 90) + " " + one)]
    df = sp.createDataFrame([(i, t, "x", 1, "s", [1], t) for i, t in docs],
                            "doc_id long, text string, s string, i int, t string, th array<int>, row string")
    found = chaining.repeated_passages(df)
    got = {r["doc_id"] for r in found.collect()}
    assert got == {5, big, big + 2}
    left = chaining.without_passages(df, found)
    assert left.columns == df.columns
    texts = sorted((r["doc_id"] or 0, len(r["text"].split())) for r in left.collect())
    assert (5, 300) in texts and (0, 150) in texts  # another text of the id, and no id: as they were
    assert all(n < 150 for i, n in texts if i == big)


def test_every_passage_shared_with_one_document_is_found(sp):
    rng = random.Random(12)
    shared = [prose(rng, n) for n in (80, 60, 70)]
    docs = [(1, (" " + prose(rng, 150) + " ").join(shared)), (2, (" " + prose(rng, 100) + " ").join(shared))]
    found = chaining.repeated_passages(sp.createDataFrame(docs, "doc_id long, text string")).collect()
    words = docs[1][1].split()
    assert sorted(" ".join(words[r["start"]:r["end"]]) for r in found) == sorted(shared)


def covered(docs, n):
    """Places of every word in a run of n words that an earlier document has."""
    seen, out = set(), set()
    for i, text in docs:
        w = text.split()
        here = [" ".join(w[a:a + n]) for a in range(len(w) - n + 1)]
        out |= {(i, a + x) for a, run in enumerate(here) if run in seen for x in range(n)}
        seen |= set(here)
    return out


def test_passages_whose_parts_occur_in_several_documents(sp):
    rng = random.Random(13)
    x, y, z, line = (prose(rng, n) for n in (30, 30, 40, 30))
    near = [(1, [x]), (2, [y]), (3, [x + " " + y]), (4, [x]), (5, [y]), (6, [x + " " + y]),
            (7, [z]), (8, [z + " " + prose(rng, 12)]),
            (10, [line, line + " " + prose(rng, 22)])]
    near += [(9, near[7][1]), (11, near[8][1][1:])]
    docs = sorted((i, " ".join([prose(rng, 120)] + [t + " " + prose(rng, 120) for t in ts])) for i, ts in near)
    want = covered(docs, 50)
    assert {i for i, _ in want} == {6, 9, 11}
    found = chaining.repeated_passages(sp.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {(r["doc_id"], p) for r in found for p in range(r["start"], r["end"])}
    assert want <= got and len(got - want) <= 10
    for r in found:
        assert r["identity"] >= 0.9 and r["n_words"] >= 50 and r["doc_id"] > r["other_doc_id"]


def test_no_run_of_equal_words_is_lost(sp):
    rng = random.Random(14)
    parts = [prose(rng, rng.randint(15, 45)) for _ in range(12)]
    docs = [(i, " ".join(rng.choice(parts) if rng.random() < 0.8 else prose(rng, 20) for _ in range(8)))
            for i in range(40)]
    want = covered(docs, 50)
    found = chaining.repeated_passages(sp.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(want) > 500 and want <= {(r["doc_id"], p) for r in found for p in range(r["start"], r["end"])}


def exchanged(df):
    """Rows that each exchange of ``df`` wrote, once it has run."""
    df._jdf.collectToPython()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name == "Exchange":
                out.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_texts_that_match_nothing_are_not_moved(sp):
    rng = random.Random(31)
    passage, copy = prose(rng, 70), prose(rng, 200)
    docs = [(i, prose(rng, 40), 1) for i in range(300)] + [(None, copy, 1)]
    docs += [(400, passage + " " + prose(rng, 20), 1), (401, prose(rng, 20) + " " + passage, 1), (500, copy, 1), (501, copy, 1)]
    df = sp.createDataFrame(docs, "doc_id long, text string, n_chars long")
    limit = sp.conf.get("spark.sql.autoBroadcastJoinThreshold")
    sp.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = chaining.repeated_passages(df)
        cut = chaining.without_passages(df, found)
        assert max(exchanged(cut)) < 20
        left = {r["doc_id"]: r["text"] for r in cut.collect()}
        assert set(left) == {i for i, _, _ in docs} - {501} and left[401] == docs[302][1].replace(passage, "")
        kept = corpus_pipeline.near_dedup(sp, df, "")
        assert max(exchanged(kept)) < 20
        assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in docs} - {501}
    finally:
        sp.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_parts_hold_every_row_once(sp):
    rows = sp.createDataFrame([(i, str(i % 7), "x") for i in range(500)] * 2 + [(None, "1", "y"), (3, None, "y"), (None, None, "y")],
                              "`k.1` long, may string, word string")
    keys = sp.createDataFrame([(3, None), (4, "4"), (None, "1"), (9, "nine"), (4, "4")], "`k.1` long, may string")
    for found in (keys, keys.limit(0), rows):
        may, no = parted(rows, found, ["k.1", "may"])
        assert may.columns == no.columns == rows.columns
        a, b = ([tuple(r) for r in x.collect()] for x in (may, no))
        assert sorted(map(str, a + b)) == sorted(str(tuple(r)) for r in rows.collect())
        wanted = {tuple(r) for r in found.select("`k.1`", "may").collect()}
        assert not {r[:2] for r in b} & wanted and (len(a) < 20 or found is rows)


def test_seeds_outside_passages_come_once_and_without_a_join(sp, monkeypatch):
    plans = {}

    def stored(df, name, old=chaining.stored):
        plans[name] = df
        return old(df, name)

    monkeypatch.setattr(chaining, "stored", stored)
    rng = random.Random(32)
    parts = [prose(rng, rng.randint(15, 45)) for _ in range(12)]
    docs = [(i, " ".join(rng.choice(parts) if rng.random() < 0.8 else prose(rng, 20) for _ in range(8))) for i in range(40)]
    chaining.repeated_passages(sp.createDataFrame(docs, "doc_id long, text string"))
    seeds = [r["h"] for r in plans["left-seeds"].collect()]
    assert len(seeds) == len(set(seeds)) > 0
    assert "LeftSemi" not in plans["left-seeds"]._jdf.queryExecution().executedPlan().toString()
