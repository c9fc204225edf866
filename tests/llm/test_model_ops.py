"""Classifiers, extraction, token counts, packing and the pipeline."""

import zlib

import duckdb
import numpy as np
import pytest
from tests.conftest import SMALL, SMOKE

import corpus_pipeline
from ledgerflow.llm import bfd_packing, host_suffix, pairwise_quality, queries, subword_langid, token_rollup, tokens
from ledgerflow.llm.common import importable
from ledgerflow.session import scratch_path


@pytest.fixture(scope="module")
def sp(spark):
    importable(spark)
    return spark


def test_quality_on_held_out_documents(sp):
    got = {r["doc_id"]: r for r in queries.op6_pairwise_quality(sp, SMALL).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{SMALL}/labels.parquet'").fetchall()
    held = [(got[i]["score"], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == pairwise_quality.held_out(i) for i in got)
    good, bad = (np.array([s for s, y in held if y == v]) for v in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (good >= 0.3).mean() > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_quality_without_labels_and_with_odd_texts(sp):
    docs = sp.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "x " * 50_000, 0.0)], "doc_id long, text string, score double")
    labels = sp.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    model = pairwise_quality.train(docs, labels)
    assert model is None
    assert [r["score"] for r in pairwise_quality.quality_scores(docs, model).collect()] == [0.5] * 3
    fitted = pairwise_quality.fit(*(np.array([pairwise_quality.features(t) for t in ts])
                                    for ts in (["a b c d."] * 4, ["a a a a"] * 4)), pairs=100)
    scored = pairwise_quality.quality_scores(docs, fitted).collect()
    assert len(scored) == 3 and scored[0]["score"] == scored[1]["score"]


def test_the_threshold_follows_all_labels_beyond_the_sample(sp):
    rng = np.random.default_rng(15)
    words = np.array([f"word{i}" for i in range(300)])
    rows = []
    for i in range(1500):  # good and bad overlap
        y = int(rng.random() < 0.855)
        text = rng.choice(words, 120)
        text[rng.random(120) < np.clip(rng.normal(0.1 if y else 0.2, 0.06), 0, 1)] = "!!!"
        rows.append((i, " ".join(text), y))
    docs = sp.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = sp.createDataFrame([(i, y) for i, _, y in rows] + [(10_000 + i, 0) for i in range(3000)],
                                "doc_id long, quality int")
    train = [(t, y) for i, t, y in rows if not pairwise_quality.held_out(i)]
    x, bad = np.array([pairwise_quality.features(t) for t, _ in train]), np.mean([not y for _, y in train])
    for sample in (100, 5000):
        model = pairwise_quality.train(docs, labels, sample)
        assert abs((model.score(x) < pairwise_quality.CUT).mean() - bad) < 0.04


def test_quality_is_learned_from_all_pairs_of_labelled_documents(sp):
    rng = np.random.default_rng(17)
    rows = []
    for i in range(260):  # kinds overlap
        y = int(i % 4 > 0)
        words = rng.choice([f"word{k}" for k in range(60)], 80)
        words[rng.random(80) < np.clip(rng.normal(0.15 if y else 0.25, 0.1), 0, 1)] = "!!!"
        rows.append((i, " ".join(words), y))
    docs = sp.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = sp.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = pairwise_quality.train(docs, labels, rounds=60)
    x, y = (np.array(c) for c in zip(*[(pairwise_quality.features(t), y) for i, t, y in rows
                                       if not pairwise_quality.held_out(i)]))
    assert np.allclose(model.mean, pairwise_quality.shaped(x).mean(axis=0), atol=1e-4)
    z = pairwise_quality.steps(x, model.mean, model.scale) / pairwise_quality.Z_STEP
    pairs = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])

    def loss(w):
        return np.logaddexp(0, -pairs @ w).mean() + pairwise_quality.L2 / 2 * w @ w

    best = np.zeros(z.shape[1])
    for _ in range(30):  # Newton's method over every pair
        p = 1 / (1 + np.exp(pairs @ best))
        curve = (pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + pairwise_quality.L2 * np.eye(len(best))
        best = best - 0.7 * np.linalg.solve(curve, -(pairs * p[:, None]).mean(axis=0) + pairwise_quality.L2 * best)
    assert loss(model.weights) < loss(best) + 0.003
    assert (model.strength(x) < model.threshold - 1e-9).sum() == (y == 0).sum()


def test_weighted_quantile_counts_what_values_stand_for():
    x = np.random.default_rng(16).normal(size=101)
    assert pairwise_quality.weighted_quantile(x, np.ones(101), 0.14) == pytest.approx(np.quantile(x, 0.14))
    heavy = np.where(x > 0, 5.0, 1.0)
    assert pairwise_quality.weighted_quantile(x, heavy, 0.3) == pytest.approx(np.quantile(np.repeat(x, heavy.astype(int)), 0.3), abs=0.05)


def test_fits_do_not_depend_on_partitioning(sp):
    docs = sp.read.parquet(f"{SMOKE}/documents.parquet")
    labels = sp.read.parquet(f"{SMOKE}/labels.parquet")
    one, many = docs.coalesce(1), docs.repartition(5, "text")
    a, b = (pairwise_quality.train(d, labels) for d in (one, many))
    assert (a.weights == b.weights).all() and a.threshold == b.threshold
    got = [sorted(subword_langid.language_of(docs, subword_langid.train(d)).select("doc_id", "score").collect())
           for d in (one, many)]
    assert got[0] == got[1]


def test_language_on_held_out_documents(sp):
    got = queries.op8_subword_langid(sp, SMALL).collect()
    lang = dict(duckdb.sql(f"select doc_id, lang from '{SMALL}/documents.parquet'").fetchall())
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r in held)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_language_of_odd_texts(sp):
    rows = [(i, "the cat sat on the mat", "en", "x") for i in range(30)] + [
        (40 + i, "der hund läuft über den weg", "de", "x") for i in range(30)]
    rows += [(100, None, "en", "x"), (101, "123 !!", "en", "x"), (102, "the mat", None, "x"), (None, "den weg", "de", "x")]
    docs = sp.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = subword_langid.train(docs)
    got = {r["doc_id"]: r for r in subword_langid.language_of(docs, model).collect()}
    assert (got[100]["lang_pred"], got[101]["lang_pred"], got[100]["score"]) == ("und", "und", 0.0)
    assert (got[102]["lang_pred"], got[None]["lang_pred"]) == ("en", "de")
    empty = subword_langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in subword_langid.language_of(docs, empty).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>";</script></head><body class="has-sidebar">
<nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><!-- <article> -->
<article><h1>A &amp; B</h1><p><b>One&nbsp;two<br>three <p>Four &lt;five&gt;</p><div class="ad">Buy</div>
<ul><li>six<li>seven</ul><form><input name=x> Mail</form><section class="comments"><p>Nice!</p></section></article>
<aside>More</aside><footer>&copy; us</footer>"""


def test_main_text_by_markup():
    main, _ = host_suffix.by_markup(PAGE)
    assert main == ["A & B", "One two three", "Four <five>", "six", "seven"]
    kept = "<article><h1>A</h1><p>x <math><mi>y</mi></math></p></article>"
    for head in ("<head><title>t</title>", "<head><title>t</title></head>", "<head><meta charset=utf-8><style>p{}</style>",
                 "<svg>", "<object data=1>", "<title>"):
        assert host_suffix.by_markup(f"<html>{head}<body>{kept}")[0] == ["A", "x y"], head
    assert host_suffix.by_markup(None) == (None, []) and host_suffix.by_markup("a < b <i") == (None, ["a < b <i"])


def test_repeated_runs_go_where_markup_is_silent(sp):
    menu = "home news sport weather travel money food shop about contact help"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{menu} {i} today</div><div>Story number {i} tells of {'x' * i} alone"
             f"</div><p>{menu}</p></body>") for i in range(1, 6)]
    rows += [(10, "http://other.example/", f"<div>{menu}</div>"), (11, None, None), (12, "http://h.example/12", ""),
             (13, "http://h.example/13", f"<div>{menu}</div>"), (14, "http://a.example/", PAGE), (14, "http://a.example/", PAGE)]
    pages = sp.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = host_suffix.main_text(pages).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(text[i] == f"{i} today\nStory number {i} tells of {'x' * i} alone" for i in range(1, 6))
    assert (text[10], text[11], text[12], text[13]) == (menu, "", "", menu)
    assert text[14].startswith("A & B\nOne two three")
    assert host_suffix.main_text(pages.limit(0)).count() == 0


def test_runs_of_marked_menus_and_of_short_blocks_decide_too(sp):
    items = "home news sport weather travel money food shop about contact help login".split()
    menu = "".join(f"<li>{w}</li>" for w in items)
    notice = "all rights to these pages belong to the owners of this host"
    rows = [(1, "http://a.example/1", f"<nav><ul>{menu}</ul></nav><article><p>one story</p></article><footer>{notice}</footer>"),
            (2, "http://a.example/2", f"<body><ul>{menu}</ul><p>another story alone</p><div>{notice}</div></body>"),
            (3, "http://a.example/3", f"<article><p>{notice} 3</p><p>third</p></article><div>{notice}</div>"),
            (4, "http://b.example/4", f"<body><ul>{menu}</ul><p>home</p></body>")]
    text = {r["page_id"]: r["text"] for r in
            host_suffix.main_text(sp.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text == {1: "one story", 2: "another story alone", 3: f"{notice} 3\nthird", 4: "\n".join([*items, "home"])}


def test_runs_of_a_host_match_searching_them_all():
    rng = np.random.default_rng(8)
    pages = [(f"h{i % 2}", i, [" ".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(3)]) for i in range(12)]
    want = {}
    for host, page, texts in pages:
        words = " ".join(texts).split()
        for i in range(len(words) - 3):
            want.setdefault((host, tuple(words[i:i + 4])), set()).add(page)
    got = host_suffix.host_runs(pages, 4)
    assert sorted((h, a, b) for h, _, a, b in got) == sorted((h, min(x), max(x)) for (h, _), x in want.items())


def test_suffix_groups_share_their_first_tokens():
    rng = np.random.default_rng(7)
    for run in (1, 2, 3, 5, 8):
        s = rng.integers(0, 3, 200)
        order, starts = host_suffix.suffix_groups(s, run)
        want = {}
        for i in range(200):
            want.setdefault(tuple(s[i:i + run]) if i + run <= 200 else (i, "end"), set()).add(i)
        got = [set(x.tolist()) for x in np.split(order, starts[1:])]
        whole = {frozenset(x) for k, x in want.items() if k[-1:] != ("end",)}
        assert whole <= {frozenset(x) for x in got}


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_ids_equal_the_files_own():
    texts = [r[0] for r in duckdb.sql(f"select text from '{SMOKE}/documents.parquet'").fetchall()]
    texts += ["", "It's DON'T 'sfoo <|endoftext|>x", "a\x1cb 　 Ünï ß İ ﬁ 𝔘 é ́ ٣ x²y \t\n\r\x0b", "Σας ΣΑΣ.", "c!!(d)--e"]
    assert [tokens.load("word_bpe_49k").ids(t) for t in texts] == reference_ids(texts)


def test_a_tokenizer_that_forgets_gives_the_same_ids():
    tok, text = tokens.load("word_bpe_49k"), "The cat, the  CAT sat.  "
    before = tok.packed(text)
    tok.forget()
    assert not tok.words and not tok.words.old and not tok.parts
    assert tok.packed(text) == before == tok.packed(text)


def test_packing_round_trip(sp):
    rows = [(r[0], r[1]) for r in duckdb.sql(f"select doc_id, text from '{SMOKE}/documents.parquet'").fetchall()]
    rows += [(9000, None), (9001, ""), (9002, "word " * 20_000)]
    docs = sp.createDataFrame([(*r, "o") for r in rows], "doc_id long, text string, offset string")
    whole = bfd_packing.packed_sequences(docs)
    digest = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in bfd_packing.piece_digests(whole).collect()}
    pieces = whole.collect()
    want = {i: ids + [2] for (i, _), ids in zip(rows, reference_ids([t or "" for _, t in rows]))}
    back, seqs = {}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0 and p["doc_tokens"] == len(want[p["doc_id"]])
        assert p["start"] == len(back.get(p["doc_id"], [])) and digest[p["doc_id"], p["start"]] == zlib.crc32(p["ids"])
        back.setdefault(p["doc_id"], []).extend(ids)
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert back == want
    padding = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    assert padding < 0.02 * sum(map(len, want.values()))
    assert bfd_packing.packed_sequences(docs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_window():
    p = lambda n: bfd_packing.Piece(1, 0, bytes(4 * n), n)
    windows = bfd_packing.best_fit_decreasing([p(n) for n in (60, 50, 45, 40, 38, 5)], 100)
    assert sorted(sorted(len(x) for x in w.pieces) for w in windows) == [[5, 45, 50], [38], [40, 60]]


def test_rollup_follows_changes_and_ignores_replays(sp):
    versions = {"w@1": ("word_bpe_49k", None), "b@1": ("byte_bpe_50k", None)}
    r = token_rollup.TokenRollup(sp, scratch_path(sp, "rollup"), versions)
    schema = "op string, doc_id long, source string, lang string, text string, n_tokens string"
    batch = lambda rows: sp.createDataFrame([(*x, "z") for x in rows], schema)
    assert r.totals().count() == 0
    one = batch([("insert", 1, "s", "en", "a b c"), ("insert", 2, "s", None, "d e"), ("insert", 2, "s", None, "d e"),
                 ("insert", 3, "t", "en", None), ("insert", None, "t", "en", "x y z w")])
    assert r.apply(1, one) and not r.apply(1, one)
    two = batch([("delete", 1, None, None, None), ("revise", 2, "t", "en", "one two three"), ("delete", 77, None, None, None),
                 ("insert", 4, "s", "en", "q")])
    assert r.apply(2, two) and not r.apply(2, two)
    assert r.apply(3, batch([])) and r.batches() == [1, 2, 3]
    live = [("t", "en", None), ("t", "en", "x y z w"), ("t", "en", "one two three"), ("s", "en", "q")]
    want = {}
    for name, (kind, _) in versions.items():
        for source, lang, text in live:
            n, t = want.get((source, lang, name), (0, 0))
            want[source, lang, name] = (n + 1, t + tokens.load(kind).count(text))
    assert {(x["source"], x["lang"], x["tokenizer"]): (x["n_docs"], x["n_tokens"]) for x in r.totals().collect()} == want


def test_pipeline_stages_keep_columns_and_clean_documents(sp):
    docs = sp.read.parquet(f"{SMOKE}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    odd = sp.createDataFrame([(10**6, None, None, None, None), (None, "short text here", "en", "s", 15)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(sp, docs, SMOKE)
        path = scratch_path(sp, name)
        out.write.parquet(path)
        docs = sp.read.parquet(path)
        assert docs.columns == columns
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {None, 10**6} <= kept and kept - {None, 10**6} <= ids and len(kept) > len(ids) / 2
    pieces = corpus_pipeline.STAGES[-1][1](sp, docs, SMOKE)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == kept


def test_pipeline_on_an_empty_table(sp):
    docs = sp.read.parquet(f"{SMOKE}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(sp, docs, SMOKE)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
