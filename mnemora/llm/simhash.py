"""SimHash near-duplicates with pivot distance tables.

A fingerprint bit is 1 if it is set in over half of the XXH64 values of a text's word shingles.
Fingerprints of at most `distance` differing bits are linked, as follows.

1. Documents are grouped by fingerprint (map-side combined), so copies cost one node.
2. The 64 bits are cut into `blocks` parts. Two linked fingerprints agree on at least blocks-distance
   parts, so they meet under one of the C(blocks, distance) keys made of so many parts. The number of parts
   follows the number of fingerprints (`blocks_for`), so a key holds about as many rows at every size.
3. Inside a key of more than SMALL rows the bits that vary are cut into distance+1 parts, and only rows that
   agree on one of them meet: the same rule once more. Among these, a table of Hamming distances to `pivots`
   reference fingerprints discards a pair as soon as one coordinate differs by more than `distance` (the
   triangle inequality); survivors are verified. A task joins what it finds in all its keys to a spanning
   forest, so a group of g gives it g-1 edges. A key of more than HOT rows isn't held: its rows are dealt
   again by longer keys.
4. Components join nodes; every document gets the smallest doc_id of its component.

`similar_documents` is the wide form for a similarity of the sets of distinct shingles instead of a number of
bits. Texts of equal sets collapse first. For a similarity of 0.8 keys of fingerprint bits are no use: two such
texts agree on a bit with probability 0.85 only, so a pair needs some 150 keys to meet and every document as many
rows. The block keys are therefore made of min-wise shingles: `values_for` of them to a key, `keys_needed`
keys, by which a pair at the similarity meets with a probability of over 0.9995. Within a key everything is
decided by fingerprints of WIDE bits over the distinct shingles: first each row is proposed together with the
key's medoid (the row nearest to the key's bitwise majority). Once these pairs are verified and joined to
components, the rows of different components that still meet in a key find each other by prefixes of their rare shingles
(`prefixes`); where even these are too frequent, the rows of one are compared in blocks: the pivot table discards,
then sizes and `allowed_bits` (three deviations over the mean). Every pair that remains is verified by the exact
Jaccard similarity of the two whole texts' distinct shingles, and verified pairs alone make components; a task
returns a spanning forest of them. Pivots are drawn from the rows themselves here: random references are all about
as far from every text.

Defined cases: a null or empty text has fingerprint zero (no shingles) and is linked like any other; fewer words
than a shingle count as one shingle; repeated rows and ties share a component; a null id stays null in the result
and is never a component's name: a component of rows without ids has none; very long texts are taken whole; other
columns, whatever their names, are ignored; empty tables give empty results."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prefixes
from .common import written
from .components import Forest, components
from .words import FOLD, SPACE, mix, shingle_hashes, text_buffer, word_hashes

SEED = 42
WIDE = 512
SMALL, HOT = 32, 1 << 20
#: Rows of one key that a star is made of at once, and rows of a block where a key's components are compared.
STAR, BLOCK = 1 << 16, 256
_FOLD, _SPACE = bytes(FOLD.tolist()), bytes(32 if s else i for i, s in enumerate(SPACE.tolist()))
_TRANSLATE = bytes(_SPACE[_FOLD[i]] for i in range(256))


def text_shingles(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    import xxhash

    w = text.translate(_TRANSLATE).split()
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w), SEED)] if w else [], np.uint64)
    joined = memoryview(b" ".join(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[: len(w) - words] + 1).tolist()]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    total, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int) -> int:
    return majority(text_shingles(text, words))


def fingerprints(docs: DataFrame, words: int = 4, id_column: str = "doc_id") -> DataFrame:
    """id, fp long (the fingerprint's bits as a signed number): one row per row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            data, o = data.tobytes(), offsets.tolist()
            fps = np.array([fingerprint(data[x:y], words) for x, y in zip(o[:-1], o[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_column, "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, fp long")


def _parts(blocks: int) -> list[int]:
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    return [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges[:-1], edges[1:])]


def key_masks(blocks: int, distance: int) -> list[int]:
    """Two numbers that differ in at most distance bits agree under at least one of these masks."""
    if blocks <= distance:
        raise ValueError("blocks has to be more than distance")
    return [sum(c) for c in combinations(_parts(blocks), blocks - distance)]


def blocks_for(n: int, distance: int, rows: int = 4) -> int:
    """The fewest parts for which n evenly spread fingerprints give a key so many rows at most."""
    blocks = distance + 1
    while blocks < 16 and n / 2 ** (64 * (blocks - distance) / blocks) > rows:
        blocks += 1
    return blocks


def pivot_points(count: int, size: int = 1) -> np.ndarray:
    """Reference fingerprints of size 64-bit words: fixed pseudo-random bits."""
    return np.random.default_rng(20_240_229).integers(0, 1 << 64, (count, size), dtype=np.uint64)


def bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """[fingerprints, pivots] distances."""
    return np.stack([bits_between(fps, p) for p in pivots], axis=1)


def linked(fps: np.ndarray, distance: int, table: np.ndarray) -> np.ndarray:
    """For each of the distinct fingerprints fps, the index of the head of its linked group.

    Groups grow breadth-first over the rows that no group has taken yet, so a dense group of g rows is
    taken in a few sweeps instead of g * g comparisons."""
    head = np.full(len(fps), -1, np.int64)
    left = np.arange(len(fps))
    while len(left):
        first = int(left[0])
        head[first] = first
        queue, left = [first], left[1:]
        while queue and len(left):
            i = queue.pop()
            rows = left
            for c in range(table.shape[1]):
                rows = rows[np.abs(table[rows, c] - table[i, c]) <= distance]
                if len(rows) < 8:
                    break
            rows = rows[bits_between(fps[rows], fps[i]) <= distance]
            if len(rows):
                head[rows] = first
                queue.extend(rows.tolist())
                left = left[head[left] < 0]
    return head


def varying_parts(fps: np.ndarray, parts: int) -> list[int]:
    """Masks that share out the bits in which fingerprints (one word each) differ."""
    vary = int(np.bitwise_or.reduce(fps[:, 0] ^ fps[0, 0]))
    bits = [1 << i for i in range(64) if vary >> i & 1]
    return [sum(bits[i::parts]) for i in range(parts)]


def bucket_edges(key: np.ndarray, fps: np.ndarray, distance: int, pivots: np.ndarray, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indices) of rows sorted by key (any number of whole keys) that connect what chains of links
    within keys connect: the linked pairs of a key of SMALL rows at most; a larger one is split once by
    varying_parts, and where a part is large as well, a star for each linked group."""
    n = len(key)
    table = pivot_table(fps, pivots)
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    size = np.bincount(group)
    small = size[group] <= SMALL
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(SMALL, int(size.max()))):
        i = np.flatnonzero(small[: n - step] & (group[: n - step] == group[step:]))
        if not len(i):
            break
        for c in range(table.shape[1]):
            i = i[np.abs(table[i, c] - table[i + step, c]) <= distance]
        i = i[bits_between(fps[i], fps[i + step]) <= distance]
        a.append(i + step)
        b.append(i)
    ends = np.cumsum(size)
    for g in np.flatnonzero(size > SMALL).tolist():
        s, e = int(ends[g] - size[g]), int(ends[g])
        if split:
            for mask in varying_parts(fps[s:e], distance + 1):
                part = fps[s:e, 0] & np.uint64(mask)
                order = np.argsort(part, kind="stable")
                x, y = bucket_edges(part[order], fps[s:e][order], distance, pivots, False)
                a.append(s + order[x])
                b.append(s + order[y])
        else:
            head = linked(fps[s:e], distance, table[s:e])
            tied = np.flatnonzero(head != np.arange(e - s))
            a.append(s + tied)
            b.append(s + head[tied])
    return np.concatenate(a), np.concatenate(b)


def whole_keys(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15, most: int | None = None) -> Iterator[tuple[bool, list[pa.Array]]]:
    """Columns of batches sorted by the first, cut between its values, some rows at a time. With most, a value
    of more rows comes piece by piece, marked True."""
    held: list[pa.RecordBatch] = []
    count, hot = 0, None
    for batch in batches:
        while batch.num_rows:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            if hot is not None:
                n = int(np.searchsorted(key, hot, "right"))
                if n:
                    yield True, batch.slice(0, n).columns
                    batch = batch.slice(n)
                if n < len(key):
                    hot = None
                continue
            held.append(batch)
            count += len(key)
            batch = batch.slice(len(key))
            first, last = held[0].column(0)[0].as_py(), int(key[-1])
            if count >= rows and first != last:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                at = int(np.searchsorted(whole.column(0).to_numpy(zero_copy_only=False), last, "left"))
                yield False, whole.slice(0, at).columns
                held, count = [whole.slice(at)], whole.num_rows - at
            if most is not None and count > most and held[0].column(0)[0].as_py() == last:
                hot = last
                for x in held:
                    yield True, x.columns
                held, count = [], 0
    if count:
        yield False, pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns


def key_edges(keyed: DataFrame, distance: int, pivots: np.ndarray) -> DataFrame:
    """a, b: a task's spanning forest of the links within keys, for rows (key, fp); b is null for the rows of
    a hot key, which take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for hot, (key, fp) in whole_keys(batches, most=HOT):
            f = fp.to_numpy(zero_copy_only=False)
            if hot:
                yield pa.RecordBatch.from_arrays([fp, pa.nulls(len(f), pa.int64())], names=["a", "b"])
                continue
            i, j = bucket_edges(key.to_numpy(zero_copy_only=False), f.view(np.uint64).reshape(-1, 1), distance, pivots)
            a, b = forest.joined(f[i], f[j])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, spark: SparkSession, distance: int = 4, blocks: int | None = None, pivots: int = 16) -> DataFrame:
    """a, b: edges between fingerprints that connect exactly those that chains of links connect.
    nodes: (fp), distinct."""
    blocks = blocks or blocks_for(nodes.count(), distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in key_masks(blocks, distance)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    found = written(key_edges(nodes.select(F.explode(keys).alias("key"), "fp"), distance, pivot_points(pivots)), spark, "simhash-edges")
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    edges = found.where("b is not null")
    return edges if hot.isEmpty() else edges.unionByName(links(written(hot, spark, "simhash-hot"), spark, distance, blocks + 2, pivots))


def values_for(n: int) -> int:
    """Min-wise shingles to a key for n texts."""
    return max(2, int(np.ceil(np.log(max(n, 2)) / np.log(64))))


def keys_needed(similarity: float, values: int, missed: float = 4e-4) -> int:
    """Keys by which a pair at the similarity meets but with the probability missed."""
    return max(1, int(np.ceil(np.log(missed) / np.log1p(-(similarity**values)))))


def allowed_bits(similarity: float, n: np.ndarray, slack: float = 3.0) -> np.ndarray:
    """Differing bits of WIDE that texts of a Jaccard similarity have on average, slack deviations, and what
    majorities of so few as n shingles differ more."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return WIDE * share + slack * np.sqrt(WIDE * share * (1 - share)) + WIDE / np.maximum(n, 1)


def set_number(h: np.ndarray) -> int:
    """A signed number of a set of hashes, the sum of its members' numbers modulo 2**64."""
    return int(mix(h ^ np.uint64(0x5DEECE66D1234567)).sum(dtype=np.uint64).view(np.int64))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """WIDE bits: majorities of values mixed from the distinct hashes."""
    n, total = len(h), np.zeros((WIDE // 64, 64), np.int64)
    for i in range(0, n, 1 << 12):
        more = mix(h[i : i + (1 << 12)] + np.arange(WIDE // 64, dtype=np.uint64)[:, None])
        total += np.unpackbits(more.view(np.uint8).reshape(*more.shape, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return np.packbits(total * 2 > n, bitorder="little").tobytes()


def distinct_shingles(column: pa.Array, words: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its shingles."""
    h, before = shingle_hashes(*word_hashes(column), words)
    return [np.unique(h[a:b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist())]


def minwise_keys(sets: list[np.ndarray], values: int, keys: int) -> np.ndarray:
    """[texts, keys]: each the mix of `values` smallest shingles, every one under an order of its own. Texts
    without shingles share theirs."""
    n = np.array([len(x) for x in sets], np.int64)
    out = np.zeros((len(sets), keys), np.uint64)
    some = np.flatnonzero(n)
    rng = np.random.default_rng(20_240_301)
    flat = np.concatenate([sets[i] for i in some.tolist()]) if len(some) else np.zeros(0, np.uint64)
    starts = np.cumsum(n[some]) - n[some]
    for k in range(keys):
        for x, odd in rng.integers(0, 1 << 64, (values, 2), dtype=np.uint64):
            if len(some):
                least = np.minimum.reduceat((flat ^ x) * (odd | np.uint64(1)), starts)
                out[some, k] = mix(out[some, k] + least)
        out[:, k] = mix(out[:, k] ^ np.uint64(k + 1))
    return out


def medoids(start: np.ndarray, size: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Per key, the row nearest to the bitwise majority of its rows; the first of two or of equals."""
    head = start.copy()
    for g in np.flatnonzero(size > 2).tolist():
        rows = fps[start[g] : start[g] + size[g]]
        ones = np.zeros(WIDE, np.int64)
        for i in range(0, len(rows), 1 << 12):
            ones += np.unpackbits(rows[i : i + (1 << 12)].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        middle = np.packbits(ones * 2 > len(rows), bitorder="little").view(np.uint64)
        head[g] += int(bits_between(rows, middle).argmin())
    return head


def stars(key: np.ndarray, node: np.ndarray, n: np.ndarray, fps: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (indices) to verify of rows sorted by key (any number of whole keys): each row with its key's medoid, but
    where sizes (n) or fingerprints rule the similarity out."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(new, len(key)))
    i = np.flatnonzero(np.repeat(size > 1, size))
    j = np.repeat(medoids(new, size, fps), size)[i]
    i, j = i[node[i] != node[j]], j[node[i] != node[j]]
    on = (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])) & (bits_between(fps[i], fps[j]) <= allowed_bits(similarity, np.minimum(n[i], n[j])))
    return i[on], j[on]


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets of hashes; 1 for two empty ones."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return both / (len(x) + len(y) - both)


def joined_inside(key: np.ndarray, n: np.ndarray, fps: np.ndarray, component: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Verified pairs (indices) that join rows of different components, for rows sorted by key (any number of whole
    keys), until no other pair of a key would. Every row outside of a key's largest component meets all rows of
    other components, the nearest first; pivot table, sizes and fingerprints discard, the sets decide."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size, out = np.diff(np.append(new, len(key))), []
    for s, m in zip(new[size > 1].tolist(), size[size > 1].tolist()):
        _, label, count = np.unique(component[s : s + m], return_inverse=True, return_counts=True)
        if len(count) < 2:
            continue
        own, sizes = fps[s : s + m], n[s : s + m]
        pivots = own[:: max(1, m // 8)][:8] if m > SMALL else own[:0]
        table = pivot_table(own, pivots) if len(pivots) else np.zeros((m, 0), np.int16)
        for x in np.flatnonzero(label != count.argmax()).tolist():
            others = np.flatnonzero((label != label[x]) & (np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x])))
            allowed = allowed_bits(similarity, np.minimum(sizes, sizes[x]))
            for c in range(table.shape[1]):
                others = others[np.abs(table[others, c] - table[x, c]) <= allowed[others]]
            bits = bits_between(own[others], own[x])
            near = bits <= allowed[others]
            others = others[near][np.argsort(bits[near], kind="stable")]
            while len(others):
                y, others = int(others[0]), others[1:]
                if jaccard(sets[s + x], sets[s + y]) >= similarity - 1e-9:
                    out.append((s + x, s + y))
                    label[label == label[x]] = label[y]
                    others = others[label[others] != label[x]]
    return out


def keyed(nodes: DataFrame, *columns: str) -> DataFrame:
    return nodes.select(F.explode("keys").alias("key"), *columns)


def star_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """a > b: distinct pairs of nodes to verify. nodes: (node, n, fp, keys)."""

    def pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = stars(key, node, n, fps, similarity)
        if len(i):
            found = np.unique(np.stack([np.maximum(node[i], node[j]), np.minimum(node[i], node[j])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[tuple] = []
        for hot, (key, node, n, fp) in whole_keys(batches, most=STAR):
            fps = np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(len(node), -1)
            rows = *(x.to_numpy(zero_copy_only=False) for x in (key, node, n)), fps
            yield from pairs(*rows)
            if hot:  # a piece of a key: its medoid stands for it in the key's own star
                at = medoids(np.array([0]), np.array([len(fps)]), fps)
                heads.append(tuple(x[at] for x in rows))
        if heads:
            yield from pairs(*map(np.concatenate, zip(*heads)))

    rows = keyed(nodes, "node", "n", "fp").repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(run, "a long, b long").distinct()


def marked(hashes: DataFrame, most_bits: int = 1 << 28) -> np.ndarray:
    """Bits of which those of the numbers in hashes (h) are set, by their remainder: eight for each number, most_bits
    at most. The bits are set where the numbers are; the driver gathers the map alone, 32 MB at most."""
    size = min(most_bits, 1 << max(15, int(8 * hashes.count()).bit_length()))
    bit = F.pmod("h", F.lit(size)) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()
    out = np.zeros(size >> 3, np.uint8)
    for r in rows:
        out[(r["b"] - 1) << 12 : r["b"] << 12] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def shingle_sets(wanted: DataFrame, docs: DataFrame, spark: SparkSession, words: int) -> DataFrame:
    """node, shingles (sorted 64-bit hashes) of the nodes of wanted (node, rep), taken again from one text
    each. docs: (doc_id, text, hash). Texts aren't shuffled: a bit map of the wanted hashes tells nearly all others
    off where they are, and what it lets through goes by the sets' own numbers."""
    wanted = written(wanted.select("node", F.col("rep.hash").alias("h")), spark, "similar-wanted")
    shared = spark.sparkContext.broadcast(marked(wanted))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        seen: set[int] = set()
        for b in batches:
            h = b.column(1).to_numpy(zero_copy_only=False)
            at = h & (8 * len(bits) - 1)
            keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            keep[keep] = [x not in seen and not seen.add(x) for x in h[keep].tolist()]  # copies of a text count once
            if keep.any():
                found = distinct_shingles(b.column(0).filter(pa.array(keep)), words)
                yield pa.RecordBatch.from_arrays([pa.array([set_number(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], names=["node", "shingles"])

    own = docs.select("text", "hash").mapInArrow(sets, "node long, shingles binary").join(wanted.select("node"), "node", "left_semi")
    return written(own.groupBy("node").agg(F.first("shingles").alias("shingles")), spark, "similar-shingles")


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """key, node, component: rows (key, node, component) of keys where several components meet, dealt to smaller keys
    of some 2 * most rows, in which any two rows of a key and of different components meet. A key's rows
    within and without its largest component are cut into blocks; each block without meets every other block."""
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    most_rows = F.max_by("component", F.struct("n", "component")).alias("main")
    cut = lambda n: F.ceil(n / F.lit(most))
    keys = sizes.groupBy("key").agg(most_rows, F.max("n").alias("n"), F.sum("n").alias("all")).where("all > n")
    keys = keys.select("key", "main", cut(F.col("n")).alias("within"), cut(F.col("all") - F.col("n")).alias("without"))
    main, own = F.col("component") == F.col("main"), F.pmod(F.xxhash64("node"), F.when(F.col("component") == F.col("main"), F.col("within")).otherwise(F.col("without")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    inner = F.transform(upto("without"), lambda i: F.xxhash64("key", i, own, F.lit(0)))
    across = F.transform(upto("within"), lambda i: F.xxhash64("key", own, i, F.lit(0)))
    among = F.transform(F.filter(upto("without"), lambda i: i != own), lambda i: F.xxhash64("key", F.least(i, own), F.greatest(i, own), F.lit(1)))
    dealt = F.explode(F.when(main, inner).otherwise(F.concat(across, among)))
    return rows.join(keys, "key").select(dealt.alias("key"), "node", "component")


def inside_edges(named: DataFrame, docs: DataFrame, spark: SparkSession, words: int, similarity: float) -> DataFrame | None:
    """a, b: verified pairs that join components which meet in a key; None if none meet. named: (node, n, fp, keys,
    rep, component). The rows of such keys are candidates of each other by prefixes of their rare shingles: rows alike enough
    to meet, but no more, cost a fifth of their shingles each and no comparison with the rest of their key. Shingles too frequent for
    that even so are compared in blocks."""
    rows = keyed(named, "node", "component")
    keys = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(rows.join(keys.select("key"), "key", "left_semi").select("node").distinct(), spark, "similar-mixed")
    if met.isEmpty():
        return None
    wanted = named.join(met, "node", "left_semi").select("node", "n", "fp", "rep", "component")
    sets = shingle_sets(wanted, docs, spark, words)
    rare = written(prefixes.prefix_rows(sets.join(wanted.select("node", "component"), "node"), similarity), spark, "similar-prefixes")
    found = written(prefixes.close_pairs(rare, similarity, whole_keys), spark, "similar-close")
    edges = similar_pairs(found.where("b is not null"), sets, spark, similarity)
    hot = found.where("b is null").select(F.col("a").alias("member"))
    if hot.isEmpty():
        return edges
    mixed = rare.join(hot, "member").select(F.col("member").alias("key"), "node", "component")
    return edges.union(block_edges(mixed, wanted.select("node", "n", "fp").join(sets, "node"), spark, similarity))


def block_edges(mixed: DataFrame, full: DataFrame, spark: SparkSession, similarity: float) -> DataFrame:
    """a, b: verified pairs that join components within keys, for rows (key, node, component), in blocks. full: (node, n, fp, shingles)."""
    rows = written(blocks(mixed, BLOCK), spark, "similar-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for _, (key, node, component, n, fp, sets) in whole_keys(batches, rows=1 << 10):
            node = node.to_numpy(zero_copy_only=False)
            fps = np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(len(node), -1)
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets]
            found = joined_inside(key.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False), fps, component.to_numpy(zero_copy_only=False), own, similarity)
            if found:
                a, b = forest.joined(node[[i for i, _ in found]], node[[j for _, j in found]])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.join(full, "node").select("key", "node", "component", "n", "fp", "shingles").repartition("key").sortWithinPartitions("key", "node")
    return written(dealt.mapInArrow(run, "a long, b long"), spark, "similar-edges")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, spark: SparkSession, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose distinct shingles have the Jaccard similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node")
    return similar_pairs(pairs, shingle_sets(wanted, docs, spark, words), spark, similarity)


def similar_pairs(pairs: DataFrame, own: DataFrame, spark: SparkSession, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets, own (node, shingles), have the Jaccard similarity."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([jaccard(x, y) >= similarity - 1e-9 for x, y in zip(*sets)], pa.bool_()))

    side = lambda c: own.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "of_a", "of_b")
    return written(joined.mapInArrow(similar, "a long, b long"), spark, "similar-edges")


def near_duplicates(docs: DataFrame, spark: SparkSession, words: int = 4, distance: int = 4, blocks: int | None = None, pivots: int = 16) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    prints = written(fingerprints(docs, words), spark, "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), spark, "simhash-nodes")
    found = components(links(nodes.select("fp"), spark, distance, blocks, pivots), spark)
    own = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    own = own.join(own.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("fp", "component_id")
    return prints.join(own, "fp").select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, spark: SparkSession, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, hash (XXH64 of the text), component (a number), component_id for every row of docs."""
    values = values_for(docs.count())
    keys = keys_needed(similarity, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = distinct_shingles(b.column(1), words)
            of = pa.FixedSizeListArray.from_arrays(pa.array(minwise_keys(found, values, keys).view(np.int64).reshape(-1)), keys)
            cols = [pa.array([set_number(h) for h in found], pa.int64()), pa.array([len(h) for h in found], pa.int64()), pa.array([wide_fingerprint(h) for h in found], pa.binary()), of.cast(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], names=["doc_id", "hash", "node", "n", "fp", "keys"])

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = written(docs.mapInArrow(run, f"doc_id {kind}, hash long, node long, n long, fp binary, keys array<long>"), spark, "similar")
    one = F.first(F.struct("n", "fp", "keys")).alias("x")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "hash")).alias("rep")
    nodes = written(prints.groupBy("node").agg(one, rep).select("node", "x.*", "rep"), spark, "similar-nodes")
    edges = verified(written(star_pairs(nodes, similarity), spark, "similar-pairs"), docs, nodes, spark, words, similarity)
    found = components(edges, spark)
    named = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if (more := inside_edges(named, docs, spark, words, similarity)) is not None:
        found = components(edges.union(more), spark)
    own = nodes.join(found, "node", "left").select("node", "rep.doc_id", F.coalesce("component", "node").alias("component"))
    own = own.join(own.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("node", "component", "component_id")
    return prints.select("doc_id", "hash", "node").join(own, "node").select("doc_id", "hash", "component", "component_id")


def one_of_each(docs: DataFrame, spark: SparkSession, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each component of similar_documents, all its columns kept: the row of the smallest
    doc_id (nulls last), then of the smallest hash of the text; of equal rows any one. Texts are shuffled once."""
    found = written(similar_documents(docs, spark, words, similarity), spark, "similar-rows")
    rows = found.groupBy("component", "doc_id", "hash").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "hash", "n")).alias("x")
    kept = written(rows.groupBy("component").agg(least).select("x.*"), spark, "similar-kept")
    mark = "_kept"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    taken, kept_id, kept_hash, times = (f"{mark}_{c}" for c in ("own", "id", "hash", "times"))
    docs = docs.withColumn(taken, F.xxhash64("text"))
    side = kept.select(F.col("doc_id").alias(kept_id), F.col("hash").alias(kept_hash), F.col("n").alias(times))
    same = (F.col(taken) == F.col(kept_hash)) & F.col("doc_id").eqNullSafe(F.col(kept_id))
    out = docs.join(side.where(F.col(times) == 1), same, "left_semi")
    again = side.where(F.col(times) > 1)
    if not again.isEmpty():
        out = out.unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", taken]))
    return out.drop(taken)
