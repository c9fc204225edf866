"""Ids beside nulls, ids with several texts, columns named like helpers: every operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerflow.llm import (bbit_minhash, bfd_packing, chaining, containment, pairwise_quality, subword_langid, token_rollup,
                            topk_inner, warc_index)
from ledgerflow.llm.common import importable
from ledgerflow.session import scratch_path

BIG = 1 << 60
IDS = [None, BIG + 1, BIG + 3, 2 ** 53 + 1, -7]
CLASH = "th int, s string, i long, t string, row string, fp string, sig string, hub long, p long, q long, u long, key string"


@pytest.fixture(scope="module")
def sp(spark):
    importable(spark)
    return spark


def prose(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def table(sp, rows, more=()):
    names = [c.split()[0] for c in CLASH.split(", ")]
    return sp.createDataFrame([(*r, *[1 if c.split()[1] in ("int", "long") else "x" for c in CLASH.split(", ")]) for r in rows],
                              "doc_id long, text string" + "".join(f", {x}" for x in more) + ", " + CLASH), names


def test_packing_and_rollup_keep_ids(sp):
    rng = random.Random(1)
    docs, _ = table(sp, [(i, prose(rng, 30)) for i in IDS])
    got = {r["doc_id"] for r in bfd_packing.piece_digests(bfd_packing.packed_sequences(docs)).collect()}
    assert got == set(IDS)
    rollup = token_rollup.TokenRollup(sp, scratch_path(sp, "ids-rollup"), {"a": ("word_bpe_49k", None)})
    rows = [(i, "text of some words", "s", "en") for i in IDS]
    changes = sp.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    rollup.apply(1, changes.withColumn("op", F.lit("insert")))
    assert rollup.totals().first()["n_docs"] == len(IDS)
    rollup.apply(2, changes.where(F.col("doc_id") == BIG + 1).withColumn("op", F.lit("delete")))
    assert rollup.totals().first()["n_docs"] == len(IDS) - 1


def test_archives_keep_ids(sp):
    rows = [(i, f"http://x.org/{n}", "same" if n % 2 else f"own {n}") for n, i in enumerate(IDS)]
    pages = sp.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, sha string, owner int")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc_index.capture_index(pages).collect()}
    assert set(got) == set(IDS)
    assert got[2 ** 53 + 1] == ("revisit", BIG + 1) and got[BIG + 1] == ("response", None)


def test_near_duplicates_tell_the_texts_of_an_id_apart(sp):
    rng = random.Random(2)
    one, two = prose(rng, 200), prose(rng, 200)
    near = " ".join(one.split()[:-2])
    for rows in ([(1, one), (3, two), (3, near), (BIG + 1, two), (None, one), (BIG + 3, near)],):
        for order in (rows, rows[::-1]):
            docs, _ = table(sp, order)
            got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"])
                         for r in bbit_minhash.near_duplicates(docs.coalesce(1)).collect())
            assert got == sorted([(1, 196, 1, True), (3, 196, 3, True), (3, 194, 1, False), (BIG + 1, 196, 3, False),
                                  (0, 196, None, True), (BIG + 3, 194, 1, False)])
            left = corpus_pipeline.near_dedup(sp, docs, "")
            assert left.columns == docs.columns
            assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(0, one), (1, one), (3, two)])


def test_containment_quality_and_language_keep_ids(sp):
    rng = random.Random(3)
    item = prose(rng, 30)
    docs, _ = table(sp, [(i, prose(rng, 50) + " " + item) for i in IDS] + [(9, prose(rng, 40))] * 2)
    items = sp.createDataFrame([(BIG + 5, item, 1), (None, "a b c d e", 2)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in containment.contained_items(docs, items).collect()}
    assert got == {(i, BIG + 5) for i in IDS if i is not None} or got == {(i, BIG + 5) for i in IDS}
    model = subword_langid.fit(["aaa bbb", "ccc ddd"], ["x", "y"])
    assert [r["doc_id"] for r in subword_langid.language_of(docs, model).collect()].count(BIG + 1) == 1
    assert model.predict("² ½ ⅓ Ⅷ 12")[0] == "und" and model.predict("aaa")[0] in "xy" and model.predict(None) == ("und", 0.0)
    labels = sp.createDataFrame([(i, n % 2, 0) for n, i in enumerate(IDS)], "doc_id long, quality int, toxic int")
    scorer = pairwise_quality.train(docs, labels)
    if scorer is not None:
        assert {r["doc_id"] for r in pairwise_quality.quality_scores(docs, scorer).collect()} == {*IDS, 9}


def test_passages_keep_ids(sp):
    rng = random.Random(4)
    passage = prose(rng, 80)
    docs, _ = table(sp, [(i, prose(rng, 30) + " " + passage + " " + prose(rng, 30)) for i in IDS])
    found = chaining.repeated_passages(docs)
    assert {r["doc_id"] for r in found.collect()} == set(IDS) - {None, -7}
    left = chaining.without_passages(docs, found)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(IDS)


@pytest.mark.parametrize("size", [3e5, 1e12, 3e38])
def test_large_vectors_take_part(sp, size):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 1, 6))]) for i in (0, 1, 2, 3, 7, 50, 100, BIG)]
    rows[1][1][2] = size
    rows[5][1][0] = -size
    vectors = sp.createDataFrame([(*r, 1.0, "m") for r in rows], "vec_id long, embedding array<double>, bound double, m string")
    ints = {i: [int(256 * x) if abs(x) >= 2 ** 53 else int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q)[:5]
        want |= {(q, n, i, -s if abs(s) < 1 << 63 else None) for n, (s, i) in enumerate(best, 1)}
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_inner.top_k_inner(vectors).collect()}
    assert got == want
