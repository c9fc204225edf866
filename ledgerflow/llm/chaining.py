"""Substring dedup by collinear chaining (operator 5).

Seeds are the winnowed k-word runs of every document (the least hash of every
WINDOW runs in a row, so two copies of WINDOW + k - 1 words always share a seed).
One pass over the texts writes them, with the words as 16-bit hashes (unequal words pass
for equal once in 65,536 comparisons); no text is read or moved again. Seeds are sorted
by (hash, document) over all partitions; every
occurrence is matched to one in the document before, so there are as many matches as
occurrences, never all pairs, and a seed that all documents share is dealt over many
tasks. Matches on one diagonal become segments, and the segments of two
documents are chained in order with a gap cost; the best chain end before a segment
comes from a Fenwick tree over places in the earlier text. Chains are cut at gaps of
more than MAX_GAP words. Then the words themselves are aligned: segments word by word,
gaps by their longest common subsequence, ends by extension while equal words outweigh
the others, which gives the fuzzy passages with their share of equal words.

The seeds of one passage may have come last from several documents. Each of them still
leads to a chain, and a chain is kept if the stretch of repeated seeds around it,
whoever they come from, is long enough for a passage; its ends are extended over that
whole stretch. So a passage is found when any one of its seeds leads to a document
that has it, and in a family of edited copies each is compared with the ones before it.

For passages of equal words this is made complete: where seeds in a row are repeated and
a run of MIN_WORDS words among them lies in no passage found, the runs of that many words
are hashed, there and wherever those seeds occur, and matched to their first occurrence.

A passage counts from MIN_WORDS words. The later document holds the copy; documents are
in order of (doc_id, hash of the text).

Cases: null and blank texts have no passages; rows without doc_id take no part;
repetition inside one document is not reported; equal rows count once, and texts that
share a doc_id are separate documents (a passage names its text by ``text_hash``); very
long texts are hashed and aligned whole; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import WordHashes, parted, run_hashes, stored, word_list

K = 5
WINDOW = 20
MIN_WORDS = 50
MAX_GAP = 40        # words between two segments of a chain, in either text
GAP_COST = 0.05     # per word that is skipped, half for each text
MIN_IDENTITY = 0.7  # equal words in an aligned passage
DENSE = 0.3         # score of a chain to its words from which it is sure to be a passage: of
                    # equal texts it is some k * 2 / (WINDOW + 1), of words edited in one of
                    # ten half of that
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_hash(text: Column) -> Column:
    """Tells apart the texts of one doc_id."""
    return F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int")


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash (the last of equals) of every ``window`` in a row."""
    n = len(h)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(h[::-1]))]) if n else np.empty(0, np.int64)
    # least of each window by doubling: packs the hash's top bits with the place, later first
    place = np.uint64(1 << 24) - np.uint64(1) - np.arange(n, dtype=np.uint64) % np.uint64(1 << 24)
    x = (h & ~np.uint64((1 << 24) - 1)) | place
    width = 1
    while width * 2 <= window:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if width < window:
        x = np.minimum(x[:len(x) - (window - width)], x[window - width:])
    at = np.uint64(1 << 24) - np.uint64(1) - (x & np.uint64((1 << 24) - 1))
    start = np.arange(len(x), dtype=np.int64)
    return np.unique(start + ((at.astype(np.int64) - start) % (1 << 24)))


def hashed_texts(docs: DataFrame, k: int, window: int) -> DataFrame:
    """(doc_id, th, text) -> (doc_id, th, n, w, hs, ps): the number of words, their hashes,
    two bytes each, and the hashes and positions of the winnowed seeds."""

    def run(batches):
        cache = WordHashes()
        for pdf in batches:
            out = []
            for i, th, text in zip(pdf["doc_id"], pdf["th"], pdf["text"]):
                words = cache.of(word_list(text))
                h = run_hashes(words, k)
                p = winnow(h, window)
                out.append((i, th, len(words), words.astype(np.uint16).tobytes(), h[p].view(np.int64), p.astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "th", "n", "w", "hs", "ps"])

    return docs.mapInPandas(run, "doc_id long, th int, n int, w binary, hs array<long>, ps array<int>")


def seeds(texts: DataFrame) -> DataFrame:
    """(h, doc_id, at) of every seed; ``at`` is the text's hash and the position in one."""
    each = texts.select("doc_id", "th", F.explode(F.arrays_zip("hs", "ps")).alias("s"))
    return each.select(F.col("s.hs").alias("h"), "doc_id",
                       (F.shiftleft(F.col("th").cast("long"), 32) + F.col("s.ps")).alias("at"))


POS = (1 << 32) - 1


class _Linker:
    """Matches of rows that come in order of (h, doc_id, at): the n-th row of a hash and
    document to the n-th (or last) row of that hash and the document before. In texts that
    repeat themselves matches so keep to one diagonal."""

    CHUNK = 200_000

    def __init__(self):
        self.held = None     # rows of the last document and, for the same hash, of the one before
        self.closed = False  # another document than the first has come

    def links(self, rows: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """(doc_id, at, other, oat, h) of the rows that have a match, and (h, doc_id, at) of
        the later rows of a hash's first document, which no match needs to name."""
        old = 0 if self.held is None else len(self.held[0])
        h, d, t = rows if self.held is None else (np.concatenate(x) for x in zip(self.held, rows))
        new_h = np.append(True, h[1:] != h[:-1])
        new_run = new_h | np.append(True, (d[1:] != d[:-1]) | (t[1:] >> 32 != t[:-1] >> 32))
        starts = np.flatnonzero(new_run)
        sizes = np.diff(np.append(starts, len(h)))
        run = np.cumsum(new_run) - 1
        rank = np.arange(len(h)) - starts[run]
        first = new_h[starts][run]
        before = np.maximum(run - 1, 0)
        source = starts[before] + np.minimum(rank, sizes[before] - 1)
        fresh = np.arange(len(h)) >= old
        i = np.flatnonzero(fresh & ~first)
        o = source[i]
        hidden = fresh & first & (rank > 0)
        keep = starts[-1] if new_h[starts[-1]] else starts[-2]
        self.held = tuple(x[keep:] for x in (h, d, t))
        return (d[i], t[i], d[o], t[o], h[i]), tuple(x[hidden] for x in (h, d, t))

    def last(self) -> tuple[np.ndarray, ...] | None:
        """The last row, as arrays."""
        return None if self.held is None else tuple(x[-1:] for x in self.held)


def matches(seed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, at, other, oat, h) over all seeds, and (doc_id, at, h) of the seeds that
    matches may not name, though another document has them; stored. Rows are dealt by range, so
    partitions may meet inside a hash: the first document's rows of each partition are
    then matched to the last row of the one before."""
    ordered = (seed.withColumn("th", F.shiftright("at", 32)).repartitionByRange("h", "doc_id", "th")
               .sortWithinPartitions("h", "doc_id", "at"))
    names = ["doc_id", "at", "other", "oat"]

    def run(batches):
        part, linker, head, waiting, n = TaskContext.get().partitionId(), _Linker(), None, [], 0

        def done():
            nonlocal head, waiting, n
            rows = tuple(np.concatenate([w[j] for w in waiting]) for j in range(3))
            waiting, n = [], 0
            (*out, h), hidden = linker.links(rows)
            yield batch([pa.array(x) for x in out], 0, h)
            yield batch([pa.array(hidden[j]) for j in (1, 2)] * 2, 3, hidden[0])
            head = head or tuple(int(x[0]) for x in rows)
            if not linker.closed:  # the first document's rows
                mine = (rows[0] == head[0]) & (rows[1] == head[1]) & (rows[2] >> 32 == head[2] >> 32)
                linker.closed = not mine.all()
                yield batch([pa.array(rows[j][mine]) for j in (1, 2)] * 2, 1, rows[0][mine])

        def batch(cols, kind, h):
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array(np.full(len(h), kind, np.int8)), pa.array(np.full(len(h), part, np.int32)), pa.array(h)],
                names=[*names, "kind", "part", "h"])

        for b in batches:
            if not b.num_rows:
                continue
            waiting.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "doc_id", "at")))
            n += b.num_rows
            if n >= linker.CHUNK:
                yield from done()
        if n:
            yield from done()
        end = linker.last()
        if end is not None:
            yield batch([pa.array(end[j]) for j in (1, 2)] * 2, 2, end[0])

    found = stored(ordered.select("h", "doc_id", "at").mapInArrow(
        run, "doc_id long, at long, other long, oat long, kind byte, part int, h long"), "matches")
    # one row for each partition, so this window is small
    ends = found.where("kind = 2").select(
        F.lead("part").over(Window.orderBy("part")).alias("part"), "h", F.col("doc_id").alias("other"), F.col("at").alias("oat"))
    border = (found.where("kind = 1").select("part", "h", "doc_id", "at").join(F.broadcast(ends), ["part", "h"])
              .where("doc_id <> other or shiftright(at, 32) <> shiftright(oat, 32)").select(*names, "h"))
    hidden = found.where("kind = 3").select("doc_id", "at", "h")
    return found.where("kind = 0").select(*names, "h").unionByName(border), hidden


def segments(pos: np.ndarray, opos: np.ndarray, k: int) -> list[tuple[int, int, int, float]]:
    """(start, end, other start, score) of runs of matches on one diagonal with no gap of
    more than MAX_GAP words; the score is the words their seeds cover less the cost of the
    others."""
    shift = opos.astype(np.int64) - pos
    order = np.lexsort((pos, shift))
    p, d = pos[order].astype(np.int64), shift[order]
    if not len(p):
        return []
    step = np.diff(p)
    cut = np.flatnonzero((np.diff(d) != 0) | (step > MAX_GAP + k)) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(p))
    gain = np.append(0, np.minimum(step, k))
    gain[starts] = k
    covered = np.add.reduceat(gain, starts)
    length = p[ends - 1] + k - p[starts]
    score = covered - GAP_COST * (length - covered)
    return [(int(p[a]), int(p[b - 1]) + k, int(p[a] + d[a]), float(x)) for a, b, x in zip(starts, ends, score)]


def chains(segs: list[tuple[int, int, int, float]], k: int) -> list[list[int]]:
    """Chains of segments (indices, in order) that rise in both texts, best first; each
    segment is in one. The score of a chain is that of its segments less GAP_COST / 2 for
    each word skipped in either text; segments may overlap by less than k words. With
    ends brought forward by that, a step costs the same whichever chain it ends, so the best
    end before a segment is a maximum over the ends that precede it in the other text:
    ends enter a Fenwick tree of prefix maxima, at their rank there, once the segments
    in hand start behind them. Chains are cut where a gap exceeds MAX_GAP words."""
    if len(segs) == 1:
        return [[0]]
    n = len(segs)
    half = GAP_COST / 2
    end = [e - (k - 1) for _, e, _, _ in segs]
    oend = [o + e - s - (k - 1) for s, e, o, _ in segs]
    ranks = sorted(set(oend))
    tree = [(-np.inf, -1)] * (len(ranks) + 1)
    score, back = [0.0] * n, [-1] * n
    entering = sorted(range(n), key=lambda y: end[y])
    entered = 0
    for x in sorted(range(n), key=lambda y: (segs[y][0], segs[y][2])):
        s, _, o, own = segs[x]
        while entered < n and end[entering[entered]] <= s:
            y = entering[entered]
            entered += 1
            value = (score[y] + half * (end[y] + oend[y]), y)
            at = bisect_left(ranks, oend[y]) + 1
            while at < len(tree):
                tree[at] = max(tree[at], value)
                at += at & -at
        best, at = (-np.inf, -1), bisect_right(ranks, o)
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - half * (s + o)
        score[x] = own + max(0.0, gain)
        back[x] = best[1] if gain > 0 else -1
    out, used = [], [False] * n
    for x in sorted(range(n), key=lambda y: -score[y]):
        chain = []
        while x >= 0 and not used[x]:
            used[x] = True
            if chain and max(segs[chain[-1]][0] - segs[x][1], segs[chain[-1]][2] - segs[x][2] - segs[x][1] + segs[x][0]) > MAX_GAP:
                out.append(chain[::-1])
                chain = []
            chain.append(x)
            x = back[x]
        if chain:
            out.append(chain[::-1])
    return out


def stretch_of(pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of every run of repeated seeds with no gap of more than MAX_GAP
    words, whoever they come from; ``pos`` ascending."""
    cut = np.flatnonzero(np.diff(pos) > MAX_GAP + k) + 1
    return pos[np.append(0, cut)], pos[np.append(cut, len(pos)) - 1] + k


def candidates(pos, other, oat, k: int, window: int, min_words: int):
    """(other, oth, score, starts, ends, other starts, left, right) of the chains of a document
    that may belong to a passage; left and right are the words beyond a chain's ends to
    look at when they are extended."""
    order = np.lexsort((pos, oat >> 32, other))
    pos, other, oth, opos = pos[order], other[order], oat[order] >> 32, oat[order] & POS
    first, last = stretch_of(np.unique(pos).astype(np.int64), k)
    long_ = last - first + 2 * (window - 1) >= min_words
    if not long_.any():
        return
    cut = np.flatnonzero((np.diff(other) != 0) | (np.diff(oth) != 0)) + 1
    found = []
    for a, b in zip(np.append(0, cut), np.append(cut, len(pos))):
        segs = segments(pos[a:b], opos[a:b], k)
        for c in chains(segs, k):
            s, e = segs[c[0]][0], segs[c[-1]][1]
            at = int(np.searchsorted(first, s, side="right")) - 1
            if long_[at]:
                found.append((sum(segs[x][3] for x in c), s, e, a, [segs[x] for x in c], int(first[at]), int(last[at])))
    found.sort(key=lambda x: -x[0])
    sure: list[tuple[int, int]] = []  # dense chains, which will be passages and hold the chains within them
    for score, s, e, a, chain, lo, hi in found:
        if any(x - window <= s and e <= y + window for x, y in sure):
            continue
        if e - s >= min_words and score >= DENSE * (e - s):
            sure.append((s, e))
        # what an extension gains in the stretch may carry it half as far beyond
        yield (int(other[a]), int(oth[a]), score, [x[0] for x in chain], [x[1] for x in chain], [x[2] for x in chain],
               2 * (s - lo + window) + 64, 2 * (hi - e + window) + 64)


def equal_words(a: list, b: list) -> int:
    """Words of a longest common subsequence of two short gaps."""
    if not a or not b:
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        prev = row[:]
        for j, y in enumerate(b):
            left = prev[j] + 1 if x == y else max(left, prev[j + 1])
            row[j + 1] = left
    return row[-1]


def extend(words: np.ndarray, i: int, own: np.ndarray, j: int, step: int, reach: int) -> tuple[int, int]:
    """Words to take in beyond (i, j) in direction ``step``, and how many are equal:
    up to the last place where the equal words still outweigh the others, ``reach``
    words away at most. Looked at in short pieces, since most ends are near."""
    best = best_equal = score = equal = n = 0
    reach = min(reach, i + 1, j + 1) if step < 0 else min(reach, len(words) - i, len(own) - j)
    while n < reach:
        m = min(32, reach - n)
        if step > 0:
            same = words[i + n:i + n + m] == own[j + n:j + n + m]
        else:
            same = (words[i - n - m + 1:i - n + 1] == own[j - n - m + 1:j - n + 1])[::-1]
        for x in same.tolist():
            n, equal, score = n + 1, equal + x, score + (1 if x else -2)
            if x and score > 0 and n - equal <= n * (1 - MIN_IDENTITY):
                best, best_equal = n, equal
            if score <= -4:
                return best, best_equal
    return best, best_equal


def align(chain: list[tuple[int, int, int]], words: np.ndarray, own: np.ndarray,
          left: int, right: int) -> tuple[int, int, int, int, int]:
    """(start, end, own start, own end, equal words) of a chain of (start, end, own
    start) on both texts, its ends extended into ``left`` and ``right`` words."""
    s, _, o = chain[0]
    e, oe, equal = s, o, 0
    for p, end, q in chain:
        over = max(e - p, oe - q, 0)
        p, q = p + over, q + over
        if p >= end:
            continue
        if p > e and q > oe:
            equal += equal_words(words[e:p].tolist(), own[oe:q].tolist())
        equal += int((words[p:end] == own[q:q + end - p]).sum())
        e, oe = end, q + end - p
    n, same = extend(words, s - 1, own, o - 1, -1, left)
    s, o, equal = s - n, o - n, equal + same
    n, same = extend(words, e, own, oe, 1, right)
    return s, e + n, o, oe + n, equal + same


def stretches(pos: np.ndarray, k: int, window: int, min_words: int) -> list[tuple[int, int]]:
    """(first, last) position of every run of seeds that can hold all seeds of a passage
    of ``min_words`` equal words: winnowing leaves no two of a passage's seeds over
    ``window`` apart, and none of its ends over window - 1 runs from a seed."""
    pos = np.unique(pos)
    ends = np.flatnonzero(np.diff(pos) > window)
    runs = zip(pos[np.append(0, ends + 1)].tolist(), pos[np.append(ends, len(pos) - 1)].tolist())
    return [(a, b) for a, b in runs if b - a + k + 2 * (window - 1) >= min_words]


def unexplained(pos: np.ndarray, spans: list[tuple[int, int]], n_words: int, k: int, window: int,
                min_words: int) -> np.ndarray:
    """Which seeds lie in stretches where a run of ``min_words`` words may be repeated that
    is in none of the passages ``spans`` of this text of ``n_words`` words."""
    out = np.zeros(len(pos), bool)
    for a, b in stretches(pos, k, window, min_words):
        lo, hi = max(0, a - window + 1), min(n_words, b + k + window - 1)
        at = lo  # where the first run that is in no passage may start
        for s, e in sorted(spans):
            if s <= at:
                at = max(at, e - min_words + 1)
        if at + min_words <= hi:
            out |= (pos >= a) & (pos <= b)
    return out


def whole_runs(words: DataFrame, found: DataFrame, hidden: DataFrame, wanted: DataFrame, k: int, window: int,
               min_words: int) -> DataFrame:
    """Passages, as ``repeated_passages`` has them, of equal words that start from the seeds
    ``wanted`` (h, distinct): every run of ``min_words`` words wherever these seeds occur is
    hashed and matched to its first occurrence."""
    keys = ["doc_id", "th"]
    of = found.join(wanted, "h", "left_semi")
    places = of.select("doc_id", "at").unionAll(of.select("other", "oat")).unionAll(
        hidden.join(wanted, "h", "left_semi").select("doc_id", "at"))
    held = places.groupBy("doc_id", F.shiftright("at", 32).cast("int").alias("th")).agg(
        F.collect_set(F.col("at").bitwiseAND(POS).cast("int")).alias("ps"))

    def ranges(batches):
        for pdf in batches:
            out = []
            for i, th, ps in zip(pdf["doc_id"], pdf["th"], pdf["ps"]):
                runs = stretches(np.asarray(ps), k, window, min_words)
                if runs:
                    out.append((i, th, [a for a, _ in runs], [b for _, b in runs]))
            yield pd.DataFrame(out, columns=["doc_id", "th", "a", "b"])

    spans = stored(held.mapInPandas(ranges, "doc_id long, th int, a array<int>, b array<int>"), "stretches")

    def runs(batches):
        for pdf in batches:
            out, n = [], 0
            for i, th, w, starts, ends in zip(pdf["doc_id"], pdf["th"], pdf["w"], pdf["a"], pdf["b"]):
                own, hs, ps = np.frombuffer(w, np.uint16).astype(np.uint64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for a, b in zip(starts, ends):
                    a = max(0, int(a) - window + 1)
                    h = run_hashes(own[a:int(b) + k + window - 1], min_words)
                    hs.append(h.view(np.int64))
                    ps.append(a + np.arange(len(h)))
                h, at = np.concatenate(hs), np.concatenate(ps)
                at, one = np.unique(at, return_index=True)  # stretches may meet
                out.append(pd.DataFrame({"doc_id": np.full(len(at), i, np.int64), "th": np.full(len(at), th, np.int32),
                                         "h": h[one], "pos": at.astype(np.int32)}))
                n += len(at)
                if n > 200_000:
                    yield pd.concat(out)
                    out, n = [], 0
            if out:
                yield pd.concat(out)

    near, _ = parted(words, spans, keys)
    # one row for each text on either side, so no run comes twice
    w = stored(near.dropDuplicates(keys).join(spans, keys).mapInPandas(runs, "doc_id long, th int, h long, pos int"),
               "whole-runs")
    own = stored(w.groupBy("h").agg(F.min(F.struct("doc_id", "th", "pos")).alias("o"), F.count("*").alias("n"))
                 .where("n > 1").select("h", F.col("o.doc_id").alias("other"), F.col("o.th").alias("oth"),
                                        F.col("o.pos").alias("opos")), "run-owners")
    hits = (w.join(own, "h").where("doc_id > other or doc_id = other and th > oth").groupBy(*keys, "other")
            .agg(F.collect_list(F.struct("pos", "opos")).alias("m")))

    def joined(batches):
        for pdf in batches:
            out = []
            for i, th, other, m in zip(pdf["doc_id"], pdf["th"], pdf["other"], pdf["m"]):
                p, q = (np.array([x[c] for x in m], np.int64) for c in ("pos", "opos"))
                out += [(i, th, other, a, b, a + shift, b + shift, b - a, 1.0)
                        for a, b, shift in covering_runs(p, q, min_words)]
            yield pd.DataFrame(out, columns=["doc_id", "text_hash", "other_doc_id", "start", "end", "other_start",
                                             "other_end", "n_words", "identity"])

    return hits.mapInPandas(joined, PASSAGES)


def covering_runs(pos: np.ndarray, opos: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(start, end, shift) of passages of equal words, from matches of n words: side by
    side on one diagonal they are one passage, and of passages that overlap only as
    many are taken as cover every matched word (in repetitive texts they are many)."""
    shift = opos - pos
    order = np.lexsort((pos, shift))
    pos, shift = pos[order], shift[order]
    cuts = np.flatnonzero((np.diff(pos) > n) | (np.diff(shift) != 0))
    starts, ends = pos[np.append(0, cuts + 1)], pos[np.append(cuts, len(pos) - 1)] + n
    shifts = shift[np.append(0, cuts + 1)]
    out, done, best = [], -1, None
    for x in sorted(zip(starts.tolist(), ends.tolist(), shifts.tolist())):
        if best and x[0] > done:  # nothing else reaches beyond what is covered
            out.append(best)
            done, best = best[1], None
        if x[1] > done and (best is None or x[1] > best[1]):
            best = x
        if best and x[0] > done:
            out.append(best)
            done, best = best[1], None
    return out + [best] if best else out


PASSAGES = ("doc_id long, text_hash int, other_doc_id long, start int, end int, other_start int, other_end int, "
            "n_words int, identity double")


def repeated_passages(docs: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, other_doc_id, start, end, other_start, other_end, n_words,
    identity): word ranges (end exclusive) of passages of ``doc_id`` that an earlier
    document has."""
    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("th"), text.alias("text")).where(
        "doc_id is not null and text is not null")
    texts = stored(hashed_texts(d, k, window), "hashed-texts")
    words = texts.select("doc_id", "th", "w")  # twice, where a row is repeated
    links, hidden = matches(seeds(texts))
    # a document's matches are as many as its seeds
    of_text = links.groupBy("doc_id", F.shiftright("at", 32).cast("int").alias("th"))
    packed = of_text.agg(F.collect_list(F.struct("at", "other", "oat")).alias("m"))
    schema = ("doc_id long, th int, other long, oth int, score double, ss array<int>, es array<int>, os array<int>, "
              "l int, r int")

    def chained(batches):
        for batch in batches:
            out = []
            rows = batch.column("m")
            flat = rows.flatten()
            pos, other, oat = (flat.field(j).to_numpy(zero_copy_only=False) for j in range(3))
            pos = pos & POS
            at = rows.offsets.to_numpy() - rows.offsets[0].as_py()
            for i, th, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), at, at[1:]):
                out += [(i, th, *c) for c in candidates(pos[a:b], other[a:b], oat[a:b], k, window, min_words)]
            cols = list(zip(*out)) if out else [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (
                pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), *[pa.list_(pa.int32())] * 3, pa.int32(),
                pa.int32()))], names=["doc_id", "th", "other", "oth", "score", "ss", "es", "os", "l", "r"])

    found = stored(packed.mapInArrow(chained, schema), "chains")

    def cut(batches):
        """The other text's words around each chain."""
        for pdf in batches:
            base, own = [], []
            for w, es, ss, os, left, right in zip(pdf["w"], pdf["es"], pdf["ss"], pdf["os"], pdf["l"], pdf["r"]):
                a = max(0, int(os[0]) - int(left))
                base.append(a)
                own.append(w[2 * a:2 * (int(os[-1]) + int(es[-1]) - int(ss[-1]) + int(right))])
            yield pdf.drop(columns="w").assign(base=base, own=own)

    ends = found.select("doc_id", "th").unionAll(found.select("other", "oth"))
    chained_words = parted(words, ends, ["doc_id", "th"])[0].dropDuplicates(["doc_id", "th"])
    other = chained_words.select(F.col("doc_id").alias("other"), F.col("th").alias("oth"), "w")
    with_own = found.join(other, ["other", "oth"]).mapInPandas(
        cut, "other long, oth int, doc_id long, th int, score double, ss array<int>, es array<int>, os array<int>, "
             "l int, r int, base int, own binary")

    def aligned(batches):
        """The passages of one document after the other; a chain within one that was found
        before adds no word."""
        at, spans = None, []
        for pdf in batches:
            out = []
            for i, th, other, ss, es, os, left, right, base, own, w in zip(*(pdf[c] for c in (
                    "doc_id", "th", "other", "ss", "es", "os", "l", "r", "base", "own", "w"))):
                if at != (i, th):
                    at, spans = (i, th), []
                if any(a <= ss[0] and es[-1] <= b for a, b in spans):
                    continue
                chain = [(int(s), int(e), int(o) - base) for s, e, o in zip(ss, es, os)]
                a, b, c, e, equal = align(chain, np.frombuffer(w, np.uint16), np.frombuffer(own, np.uint16), left, right)
                share = equal / max(1, b - a, e - c)
                if b - a >= min_words and share >= MIN_IDENTITY:
                    out.append((i, th, other, a, b, c + base, e + base, b - a, min(1.0, share)))
                    spans.append((a, b))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PASSAGES.split(", ")])

    both = with_own.join(chained_words, ["doc_id", "th"]).sortWithinPartitions("doc_id", "th", F.desc("score"), "other", "oth")
    passages = stored(both.mapInPandas(aligned, PASSAGES).distinct(), "passages")

    spans = passages.groupBy(F.col("doc_id"), F.col("text_hash").alias("th")).agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    lengths = texts.select("doc_id", "th", "n").distinct()
    seen = of_text.agg(F.collect_list(F.struct("at", "h")).alias("m"))
    checked = (seen.join(lengths, ["doc_id", "th"]).join(spans, ["doc_id", "th"], "left")
               .select("m", "n", F.col("spans.start").alias("ss"), F.col("spans.end").alias("es")))

    def unchained(batches):
        """The seeds' hashes; copies of a passage share them, so each comes once from a batch."""
        for batch in batches:
            rows = batch.column("m")
            flat = rows.flatten()
            pos, h = (flat.field(j).to_numpy(zero_copy_only=False) for j in range(2))
            pos, out = pos & POS, np.zeros(len(pos), bool)
            at = rows.offsets.to_numpy() - rows.offsets[0].as_py()
            for a, b, n, ss, es in zip(at, at[1:], *(batch.column(c).to_pylist() for c in ("n", "ss", "es"))):
                out[a:b] = unexplained(pos[a:b], list(zip(ss or (), es or ())), n, k, window, min_words)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[out]))], names=["h"])

    wanted = stored(checked.mapInArrow(unchained, "h long").distinct(), "left-seeds")
    return passages.unionByName(whole_runs(words, links, hidden, wanted, k, window, min_words)).distinct()


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the words of their passages cut out of ``text_col``; what white
    space followed a passage goes with it, and ``length_col`` is counted anew. Spans are
    cut only from the text in which they were found. A document of which nothing is left
    goes; those without passages stay as they are."""
    spans = stored(passages.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s")), "spans")
    # the row in one struct, so that its columns may have any name
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col(f"row.`{text_col}`")
    keys = ["doc_id", "text_hash"]
    may, no = parted(row.withColumns({"doc_id": F.col(f"row.`{id_col}`").cast("long"),
                                      "text_hash": text_hash(text.cast("string"))}), spans, keys)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else cut_words(t, zip(a, b)) for t, a, b in zip(texts, starts, ends)],
                         dtype=object)

    has = F.col("s").isNotNull()
    # one join for the rows with passages and those without
    joined = may.join(spans, keys, "left").withColumn("cut", cut(F.when(has, text), "s.start", "s.end")).where(
        ~has | F.col("cut").rlike(r"[^\x20\x09-\x0D]"))
    new = {text_col: F.when(has, F.col("cut")).otherwise(text)}
    if length_col in docs.columns:
        n = F.col(f"row.`{length_col}`")
        new[length_col] = F.when(has, F.length("cut").cast(docs.schema[length_col].dataType)).otherwise(n)
    return no.select("row.*").unionByName(
        joined.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))


def cut_words(text: str, spans) -> str:
    """``text`` without these word ranges, sorted by start."""
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, done = [], 0  # done: words taken or cut so far
    for a, b in spans:
        a, b = min(int(a), len(at) - 1), min(int(b), len(at) - 1)
        if a > done:
            out.append(text[at[done] if done else 0:at[a]])
        done = max(done, b)
    return "".join(out) + text[at[done] if done else 0:]
