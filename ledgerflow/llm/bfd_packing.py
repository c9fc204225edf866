"""Sequence packing by best-fit decreasing (operator 10).

Each task tokenizes its documents and packs pools of a bounded number of tokens.
Overlong documents are first cut into full windows; the rest of each goes, longest
first, into the tightest open window that holds it, found by a segment tree over
remaining capacity. Then the emptiest windows are dealt out, cut, over gaps of
MIN_PIECE tokens or more, and the pool's last part-filled window moves on to the
next pool. What is left at a task's end is cut into sequences of a power of two,
which need no padding. No rows are shuffled; sequence ids are the partition's
number and a running number, the same again when a lost task is run anew.

Cases: null and empty texts are the end id alone; a null doc_id packs like any
other; rows repeated with one doc_id are packed each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import doc_columns
from ledgerflow.llm.tokens import little_endian, load

WINDOW = 4096
END_ID = 2
POOL = 1 << 21      # tokens packed at once
MIN_PIECE = 32      # gaps and cut pieces from here on


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: bytes  # four for each
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc_id, self.start, self.ids[:4 * n], self.doc_tokens),
                Piece(self.doc_id, self.start + n, self.ids[4 * n:], self.doc_tokens))


@dataclass
class Window:
    size: int
    pieces: list[Piece] = field(default_factory=list)
    used: int = 0

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += len(piece)

    @property
    def room(self) -> int:
        return self.size - self.used


class CapacityTree:
    """Segment tree over 0..size: which remaining capacities have an open window."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.windows: dict[int, list[Window]] = {}

    def _mark(self, room: int, change: int) -> None:
        at = room + self.leaves
        while at:
            self.any[at] += change
            at //= 2

    def add(self, window: Window) -> None:
        self.windows.setdefault(window.room, []).append(window)
        self._mark(window.room, 1)

    def tightest(self, need: int) -> Window | None:
        """Take out a window with the least room that is ``need`` or more."""
        at = need + self.leaves
        if not self.any[at]:
            while at > 1 and not (at % 2 == 0 and self.any[at + 1]):
                at //= 2  # up until a right neighbour holds something
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._mark(room, -1)
        return self.windows[room].pop()


def best_fit_decreasing(pieces: list[Piece], size: int = WINDOW) -> list[Window]:
    tree, out = CapacityTree(size), []
    for piece in sorted(pieces, key=lambda p: -len(p)):
        window = tree.tightest(len(piece))
        if window is None:
            window = Window(size)
            out.append(window)
        window.put(piece)
        if window.room:
            tree.add(window)
    return out


def fill_gaps(windows: list[Window], least: int = MIN_PIECE) -> list[Window]:
    """Deal the emptiest windows out, cut, over the gaps of the fuller ones."""
    order = sorted(windows, key=lambda w: w.room)
    lo, loose = 0, []
    while lo < len(order):
        w = order[lo]
        if w.room < least:
            lo += 1
            continue
        if not loose:
            if len(order) - lo < 2:
                break
            loose = order.pop().pieces
            continue
        piece = loose.pop()
        if len(piece) > w.room:
            piece, rest = piece.cut(w.room)
            loose.append(rest)
        w.put(piece)
    if loose:  # what no gap took is a window again
        last = Window(order[0].size if order else windows[0].size)
        for piece in loose:
            last.put(piece)
        order.append(last)
    return order


def powers_of_two(pieces: list[Piece], size: int) -> Iterator[Window]:
    """Windows whose fill is a power of two each, greatest first."""
    total, todo = sum(len(p) for p in pieces), list(reversed(pieces))
    while total:
        want = min(size, 1 << (total.bit_length() - 1))
        w = Window(want)
        while w.room:
            piece = todo.pop()
            if len(piece) > w.room:
                piece, rest = piece.cut(w.room)
                todo.append(rest)
            w.put(piece)
        total -= want
        yield w


def pack(pieces: Iterator[Piece], size: int = WINDOW, pool: int = POOL) -> Iterator[Window]:
    """Windows of a stream of whole documents."""
    held: list[Piece] = []
    tokens = 0

    def closed() -> Iterator[Window]:
        nonlocal held, tokens
        windows = fill_gaps(best_fit_decreasing(held, size)) if held else []
        windows.sort(key=lambda w: w.room)
        held = windows.pop().pieces if windows and windows[-1].room >= MIN_PIECE else []
        tokens = sum(len(p) for p in held)
        yield from windows

    for piece in pieces:
        while len(piece) >= size:
            head, piece = piece.cut(size)
            full = Window(size)
            full.put(head)
            yield full
        if len(piece):
            held.append(piece)
            tokens += len(piece)
            if tokens >= pool:
                yield from closed()
    yield from closed()
    yield from powers_of_two(held, size)


def packed_sequences(docs: DataFrame, size: int = WINDOW, tokenizer: str = "word_bpe_49k",
                     tokenizer_path: str | None = None, end_id: int = END_ID,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian unsigned 32-bit), length,
    doc_tokens, sequence_id, offset."""
    d = doc_columns(docs, id_col, text_col)

    def run(batches):
        tok, end = load(tokenizer, tokenizer_path), little_endian([end_id])

        def whole():
            for pdf in batches:
                for i, text in zip(pdf["doc_id"], pdf["text"]):
                    ids = tok.packed(text) + end
                    yield Piece(None if i is None else int(i), 0, ids, len(ids) // 4)

        base, out, n = TaskContext.get().partitionId() << 36, [], 0
        try:
            for number, window in enumerate(pack(whole(), size)):
                offset = 0
                for p in window.pieces:
                    out.append((p.doc_id, p.start, p.ids, len(p), p.doc_tokens, base + number, offset))
                    offset += len(p)
                n += offset
                if n > POOL:
                    yield frame(out)
                    out, n = [], 0
            yield frame(out)
        finally:
            tok.forget()

    def frame(rows):
        # ids by themselves: pandas would make floats of them beside a null
        out = pd.DataFrame([r[1:] for r in rows], columns=["start", "ids", "length", "doc_tokens", "sequence_id", "offset"])
        return out.assign(doc_id=pd.array([r[0] for r in rows], dtype="Int64"))[["doc_id", *out.columns]]

    return d.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id long, start long, ids binary, length long, doc_tokens long, "
                              "sequence_id long, offset long")


def piece_digests(sequences: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return sequences.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                            "sequence_id", "offset")
