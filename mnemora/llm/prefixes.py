"""Candidate pairs of similar sets by prefixes of rare members: exact, and linear where a set's rarest members are rare.

Members are ordered by how many sets hold them, the rarest first. Two sets of a Jaccard similarity t share a member
among the first n - ceil(t n) + 1 of each, so each set is sent to these alone: about a fifth of its members at 0.8. A member that no other set
holds is left out. The order needs no exact counts, only the same ones everywhere: members are counted in CELLS cells, where each
set's members are, and the table of cells, of fixed size, is all that is gathered. Families of texts from one template
have the template's members in common, and these come last; in their prefixes stands what each has of its own.

Pairs of sets of different components that share a member pass if their sizes allow the similarity, and what follows the
member in both, its place in each order being known, is enough for the overlap. Members of more than GROUP rows
give no pairs but are named, so that their rows can be compared in another way."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import mix

#: Cells that members are counted in, those of a block that is summed up by itself, rows of a member that are compared pairwise at most.
CELLS, CELL_BLOCK, GROUP = 1 << 22, 1 << 12, 128
_MOST = np.iinfo(np.uint16).max


def cell_counts(sets: DataFrame) -> np.ndarray:
    """Of each cell the members in it (65,535 at most), over all sets (column shingles: sorted 64-bit hashes)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            raw = np.frombuffer(b"".join(x.as_buffer() for x in b.column(0)), np.uint64)
            np.add.at(total, (raw & np.uint64(CELLS - 1)).astype(np.int64), 1)
        parts = np.minimum(total, _MOST).astype(np.uint16).reshape(-1, CELL_BLOCK)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["part", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(CELL_BLOCK, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint16)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([np.minimum(total, _MOST).astype(np.uint16).tobytes()], pa.binary())})

    out = np.zeros((CELLS // CELL_BLOCK, CELL_BLOCK), np.uint16)
    for r in sets.select("shingles").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(summed, "part int, counts binary").collect():  # CELLS / CELL_BLOCK rows at most
        out[r["part"]] = np.frombuffer(bytes(r["counts"]), np.uint16)
    return out.reshape(-1)


def prefix(members: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(members, their places in the order) of a set's prefix, without those that no other set holds."""
    n = len(members)
    held = counts[(members & np.uint64(len(counts) - 1)).astype(np.int64)]
    first = np.lexsort((mix(members), held))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
    place = np.flatnonzero(held[first] > 1)
    return members[first[place]], place


def prefix_rows(sets: DataFrame, similarity: float) -> DataFrame:
    """member, n, node, component, place: a row for each member of each set's prefix. sets: (node, component, shingles)."""
    shared = sets.sparkSession.sparkContext.broadcast(cell_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [prefix(np.frombuffer(x.as_buffer(), np.uint64), shared.value, similarity) for x in b.column(2)]
            size = np.array([len(m) for m, _ in found], np.int64)
            n = np.array([len(x.as_buffer()) // 8 for x in b.column(2)], np.int64)
            node, component = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), size) for i in (0, 1))
            flat = lambda i, kind: np.concatenate([x[i] for x in found]).astype(kind, copy=False) if found else np.zeros(0, kind)
            columns = [flat(0, np.uint64).view(np.int64), np.repeat(n, size).astype(np.int32), node, component, flat(1, np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["member", "n", "node", "component", "place"])

    return sets.select("node", "component", "shingles").mapInArrow(run, "member long, n int, node long, component long, place int")


def passing(start: np.ndarray, size: np.ndarray, n: np.ndarray, component: np.ndarray, place: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (indices) of rows of one member that may have the similarity, for groups of rows; groups of a size together."""
    for m in np.unique(size[size > 1]).tolist():
        first, (x, y) = start[size == m], np.triu_indices(m, 1)
        for k in range(0, len(first), step := max(1, (1 << 20) // len(x))):
            at = first[k : k + step, None]
            i, j = (at + x).ravel(), (at + y).ravel()
            on = (component[i] != component[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
            i, j = i[on], j[on]
            needed = np.ceil(similarity / (1 + similarity) * (n[i].astype(np.int64) + n[j]) - 1e-9)
            on = np.minimum(n[i] - place[i], n[j] - place[j]) >= needed
            yield i[on], j[on]


def close_pairs(rows: DataFrame, similarity: float, whole_keys: Callable) -> DataFrame:
    """a > b: pairs of nodes of different components to verify, for rows of prefix_rows; and a row (member, null) for each
    member of more than GROUP rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, columns in whole_keys(batches, rows=1 << 14, most=GROUP):
            member, n, node, component, place = (c.to_numpy(zero_copy_only=False) for c in columns)
            start = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]]))
            size = np.diff(np.append(start, len(member)))
            hot = start if piece else start[size > GROUP]  # a piece of a member's rows is of more
            size = np.where(size > GROUP, 0, size) if not piece else np.zeros(len(start), np.int64)
            for i, j in passing(start, size, n, component, place, similarity):
                found = np.unique(np.stack([np.maximum(node[i], node[j]), np.minimum(node[i], node[j])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
            if len(hot):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(member[hot])), pa.nulls(len(np.unique(member[hot])), pa.int64())], names=["a", "b"])

    return rows.repartition("member").sortWithinPartitions("member", "node").mapInArrow(run, "a long, b long").distinct()
