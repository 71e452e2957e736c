"""Hierarchical multi-length packing.

A document's tokens are cut into full windows of the longest tier while it is longer than that; what
remains is routed to the shortest tier that holds it. Each tier is packed best-fit by decreasing length
into windows of its size. Gaps in the windows are filled from shorter tiers, first with whole pieces,
then with the head of one piece that is cut. Every window is therefore full, and as tiers are powers of
two it needs no padding. What is left at the end of a partition (less than a window) becomes sequences
of falling powers of two. Sequences of one tier are dealt to step groups so that the groups' attention
costs (sum of squared piece lengths) stay even.

Partitions are packed independently and as a stream: memory is bounded by FLUSH_TOKENS and the longest
document, no row is moved, and a lost task repeats the same work from its split of the input.

Defined cases: a null or empty text is the end id alone; a null doc_id is kept as null; repeated rows are
packed each on their own; a very long text fills windows of the longest tier and leaves one rest; columns other
than doc_id and text, whatever their names, are ignored; an empty table gives no pieces."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokenize import word_encoder

TIERS = (256, 512, 1024, 2048)
FLUSH_TOKENS = 1 << 20
GROUP = 8
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, tier int, step_group long"
)


@dataclass(order=True)
class Piece:
    length: int
    number: int
    doc_id: int | None = field(compare=False)
    start: int = field(compare=False)
    ids: bytes = field(compare=False, repr=False)
    doc_tokens: int = field(compare=False)

    def split(self, n: int, number: int) -> tuple[Piece, Piece]:
        return (
            Piece(n, self.number, self.doc_id, self.start, self.ids[: n * 4], self.doc_tokens),
            Piece(self.length - n, number, self.doc_id, self.start + n, self.ids[n * 4 :], self.doc_tokens),
        )


class Packer:
    def __init__(self, tiers: tuple[int, ...] = TIERS, group: int = GROUP):
        self.tiers, self.group, self.pool, self.tokens, self.count = tuple(sorted(tiers)), group, [], 0, 0
        self.done: list[tuple[int, list[Piece]]] = []

    def number(self) -> int:
        self.count += 1
        return self.count

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit numbers."""
        n, top, at = len(ids) // 4, self.tiers[-1], 0
        while n - at >= top:
            self.done.append((top, [Piece(top, self.number(), doc_id, at, ids[at * 4 : (at + top) * 4], n)]))
            at += top
        if at < n:
            self.pool.append(Piece(n - at, self.number(), doc_id, at, ids[at * 4 :], n))
            self.tokens += n - at

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def flush(self) -> None:
        """Packs the pool; pieces that fill no window stay in it."""
        by: dict[int, list[Piece]] = {t: [] for t in self.tiers}
        for p in self.pool:
            by[self.tier(p.length)].append(p)
        short = sorted(p for t in self.tiers[:-1] for p in by[t])
        self.pool = []
        for t in reversed(self.tiers):
            floor = self.tiers[self.tiers.index(t) - 1] if t != self.tiers[0] else 0
            if t == self.tiers[-1]:
                own = sorted(by[t], reverse=True)
            else:
                cut = bisect_right(short, Piece(floor, 1 << 60, None, 0, b"", 0))
                own, short = short[cut:][::-1], short[:cut]
            gaps: list[tuple[int, int]] = []
            windows: list[list[Piece]] = []
            for p in own:
                i = bisect_right(gaps, (p.length, -1))
                if i < len(gaps):
                    room, w = gaps.pop(i)
                    windows[w].append(p)
                    insort(gaps, (room - p.length, w))
                else:
                    windows.append([p])
                    insort(gaps, (t - p.length, len(windows) - 1))
            spare: list[Piece] = []
            for room, w in gaps:
                window = windows[w]
                while room and (i := bisect_right(short, Piece(room, 1 << 60, None, 0, b"", 0))):
                    p = short.pop(i - 1)
                    window.append(p)
                    room -= p.length
                if room and short:
                    head, rest = short.pop(0).split(room, self.number())
                    window.append(head)
                    insort(short, rest)
                    room = 0
                if room:
                    spare += window
                else:
                    self.done.append((t, window))
            if not short:
                self.pool += self.chop(spare, t)
            else:
                self.pool += spare
        self.pool += short
        self.tokens = sum(p.length for p in self.pool)

    def chop(self, pieces: list[Piece], size: int) -> list[Piece]:
        """Full windows of the pieces in a row, where no shorter piece is left; returns the rest."""
        window, room = [], size
        for p in pieces:
            while p is not None:
                if p.length <= room:
                    window.append(p)
                    room -= p.length
                    p = None
                else:
                    head, p = p.split(room, self.number())
                    window.append(head)
                    room = 0
                if not room:
                    self.done.append((size, window))
                    window, room = [], size
        return window

    def close(self) -> None:
        self.flush()
        left, total = self.pool, sum(p.length for p in self.pool)
        self.pool, self.tokens = [], 0
        while total:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            before = len(self.done)
            left = self.chop(left, size) if len(left) else []
            made = len(self.done) - before
            total -= size * made

    def take(self) -> list[tuple[int, int, list[Piece]]]:
        """(tier, step group, pieces) of the finished sequences."""
        out: list[tuple[int, int, list[Piece]]] = []
        for t in sorted({t for t, _ in self.done}):
            own = sorted((w for k, w in self.done if k == t), key=lambda w: -sum(p.length**2 for p in w))
            groups = -(-len(own) // self.group)
            names = [self.number() for _ in range(groups)]
            for i, w in enumerate(own):
                turn, place = divmod(i, groups)
                out.append((t, names[place if turn % 2 == 0 else groups - 1 - place], w))
        self.done = []
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, group: int = GROUP) -> DataFrame:
    """One row per piece of (doc_id, text): where it lies in its document and in its sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        encoder, packer, sequences = word_encoder(tokenizer), Packer(tiers, group), 0
        end = np.array([end_id], "<u4").tobytes()

        def rows() -> pa.RecordBatch:
            nonlocal sequences
            cols: list[list] = [[] for _ in range(10)]
            for tier, step, window in packer.take():
                at, total = 0, sum(p.length for p in window)
                for p in window:
                    for c, v in zip(cols, (p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, base + sequences, at, total, tier, base + step)):
                        c.append(v)
                    at += p.length
                sequences += 1
            kinds = [pa.int32() if i == 8 else pa.int64() for i in range(10)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            ids, at = encoder.encode_batch(b.column(1))
            raw, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), (at * 4).tolist()
            for doc_id, x, y in zip(b.column(0).to_pylist(), at[:-1], at[1:]):
                packer.add(doc_id, bytes(raw[x:y]) + end)
                if packer.tokens >= FLUSH_TOKENS:
                    packer.flush()
            if len(packer.done) >= 1024:
                yield rows()
        packer.close()
        if packer.done:
            yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
