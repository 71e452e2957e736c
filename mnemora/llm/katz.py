"""Katz backoff of any order over words: Good-Turing discounted n-gram counts with exactly normalised weights.

Tokens are words (runs of bytes outside space and 0x09-0x0D, A-Z lower-cased) and one end per document;
a start context precedes each document. A word that no training document holds is one open type.

    P(w | v) = d(c(v w)) c(v w) / c(v)     if v w was seen, else  a(v) P(w | v without its first word)
    P(w)     = d(c(w)) c(w) / N            if w was seen, else the mass that is left over

v are the `order` - 1 tokens before w, at the start of a document as many as there are and the start. d(r) is the
Good-Turing discount of r <= MOST at that level, 1 beyond (an absolute discount where counts of counts do not allow
Good-Turing). a(v) = (1 - sum of P(w | v) over seen w) / (1 - sum of the lower P over seen w), so the probabilities
over all words and the open type sum to 1. A context whose followers keep all mass counts one occurrence more, which
leaves some; a context that training never saw gives the lower level's probability.

How it runs. Rows hold sorted arrays, never one token. The input is read in chunks, each a stretch of one input split
with at most CHUNK_TOKENS tokens or one document.

1. Every chunk sends its distinct words (64-bit hashes) with its training counts to the words' partitions. These add
   the counts up, store their part of the table, and answer each chunk in the order of its words. Equal counts are
   numbered, so a word's number says its count: the list of distinct counts (at most sqrt(2 N) entries) is all that
   is broadcast.
2. Level by level, every chunk sends its distinct n-grams (a context and a word) to the contexts' partitions (a
   context with many tokens is dealt by the whole n-gram), from the third level on with the probability that the
   level below gives them. The partitions add up, store their part of the table, and answer with the n-grams'
   counts and each context's sums. Sums of the dealt contexts, fewer than 8 a partition, are broadcast. The context
   of a token's next level is the n-gram that ends before it, its count that n-gram's.
3. Every chunk climbs the levels with its answers once more and sums its documents.

Hot words and copies cost one entry per chunk. Tables and answers are files in the shared folder (kind=table by
partition, kind=answer by chunk), so a lost task reads them again. Documents are read once for each level and once
more, never shuffled; those that aren't read from files are written to the shared folder first. Chunks and partitions
both grow with the input, so the number of rows, though not of what they hold, grows with its square: some 100 bytes
a row and at least CHUNK_TOKENS / partitions tokens in it.

Defined cases: a null or empty text is the end alone; a null doc_id counts as the empty text in the
split; repeated rows are scored each; a very long text is one chunk; columns other than doc_id and text, whatever
their names, are ignored; without training rows every token is the open type with probability 1; an empty table gives
no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, shared_dir, written
from .words import mix, word_hashes

CHUNK_TOKENS = 2_000_000
MOST = 5
END = np.uint64(0x5E4D_0F7E_C57E_11AD)
#: Word numbers are below these; 48 bits are more than any input has words.
START_ID, OPEN_ID = (1 << 48) - 2, (1 << 48) - 1
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ROWS = "kind string, chunk string, part int, a binary, b binary, c binary, d binary, e binary"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram(context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The 64-bit name of a context followed by a word."""
    return mix(context * _STEP + ids)


def pack(x: np.ndarray) -> bytes:
    """Numbers as byte planes under zstandard."""
    import zstandard

    size = x.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, size).T).tobytes())


def unpack(raw: bytes, kind=np.uint64) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw) if raw else b"", np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(kind)


def rising(x: np.ndarray) -> np.ndarray:
    """Differences of a rising series."""
    return np.diff(x, prepend=x.dtype.type(0))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (kind, chunk, part, a, b, c, d, e), the last ones left out where there are none."""
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "chunk", "part", "a", "b", "c", "d", "e"])


@dataclass
class Chunk:
    name: str
    doc_ids: pa.Array
    train: np.ndarray
    hashes: np.ndarray
    lengths: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_TOKENS) -> Iterator[Chunk]:
    """Batches of (doc_id, text, train, split) as chunks; the cuts depend on a split's rows alone."""
    held: list[tuple] = []
    split, number, tokens = None, 0, 0

    def made() -> Chunk:
        ids, train, h, n = zip(*held)
        return Chunk(f"{split}-{number}", pa.concat_arrays(ids), np.concatenate(train), np.concatenate(h), np.concatenate(n))

    for b in batches:
        names = np.array(b.column(3).to_pylist(), object)
        h, counts = word_hashes(b.column(1))
        h, lengths = np.insert(h, counts[1:], END), np.diff(counts) + 1
        at = np.concatenate([[0], np.cumsum(lengths)])
        train = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
        i = 0
        while i < b.num_rows:
            if names[i] != split:
                if held:
                    yield made()
                held, split, number, tokens = [], names[i], 0, 0
            other = np.flatnonzero(names[i:] != split)
            j = i + int(other[0]) if len(other) else b.num_rows
            full = int(np.searchsorted(at, at[i] + (most - tokens), side="left"))
            j = min(j, max(full, i + 1))
            held.append((b.column(0).slice(i, j - i), train[i:j], h[at[i] : at[j]], lengths[i:j]))
            tokens += int(at[j] - at[i])
            if tokens >= most:
                yield made()
                held, number, tokens = [], number + 1, 0
            i = j
    if held:
        yield made()


def discounts(n: list[int]) -> np.ndarray:
    """d(0..MOST) from the numbers of types seen 1..MOST+1 times."""
    if min(n) > 0:
        common = (MOST + 1) * n[MOST] / n[0]
        d = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if common < 1 else -1 for r in range(1, MOST + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([0.0, *d])
    part = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return np.array([0.0, *[(r - part) / r for r in range(1, MOST + 1)]])


class Words:
    """The unigram level: distinct counts rising, the first number of each, and probabilities."""

    def __init__(self, classes: list[tuple[int, int, int]], parts: int):
        """classes: (count, words, most of them in a partition) of counts over 0."""
        rows = sorted(classes)
        self.parts = parts
        self.counts = np.array([r[0] for r in rows], np.int64)
        number = np.array([r[1] for r in rows], np.int64)
        width = np.array([r[2] for r in rows], np.int64) * parts
        first = np.zeros(len(rows), np.int64)
        if len(rows):
            first[::-1] = np.cumsum(width[::-1]) - width[::-1]  # frequent words get small numbers
        self.first = first
        self.total, self.types = int((self.counts * number).sum()), int(number.sum())
        of = {int(c): int(n) for c, n in zip(self.counts, number)}
        self.discount = discounts([of.get(r, 0) for r in range(1, MOST + 2)])
        kept = np.where(self.counts <= MOST, self.discount[np.minimum(self.counts, MOST)], 1.0) * self.counts
        left = self.total - float((kept * number).sum())
        over = self.total if left > 1e-9 else self.total + 1
        self.p = kept / max(over, 1)
        self.open = (left if left > 1e-9 else 1.0) / max(over, 1)

    def ids(self, counts: np.ndarray, index: np.ndarray, part: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), OPEN_ID, np.uint64)
        seen = counts > 0
        k = np.searchsorted(self.counts, counts[seen].astype(np.int64))
        out[seen] = (self.first[k] + index[seen].astype(np.int64) * self.parts + part[seen]).astype(np.uint64)
        return out

    def level(self, ids: np.ndarray) -> np.ndarray:
        """The class of known words."""
        back = self.first[::-1]
        return len(back) - np.searchsorted(back, ids.astype(np.int64), side="right")

    def count(self, ids: np.ndarray, starts: int) -> np.ndarray:
        """Training tokens of words; the start context has as many as there are ends."""
        out = np.zeros(len(ids), np.int64)
        known = ids < np.uint64(START_ID)
        out[known] = self.counts[self.level(ids[known])]
        out[ids == np.uint64(START_ID)] = starts
        return out

    def prob(self, ids: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), self.open)
        known = ids < np.uint64(START_ID)
        out[known] = self.p[self.level(ids[known])]
        return out


def part_of_word(h: np.ndarray, parts: int) -> np.ndarray:
    return (h >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64) if parts > 1 else np.zeros(len(h), np.int64)


def read_answers(folder: str, chunk: str) -> list[tuple]:
    """(part, a, b, c) rows of a chunk, by part."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = filesystem(folder)
    files = [f.path for f in store.get_file_info(fs.FileSelector(f"{path}/kind=answer/chunk={chunk}")) if f.path.endswith(".parquet")]
    rows = [r for f in files for r in zip(*(c.to_pylist() for c in pq.ParquetFile(store.open_input_file(f)).read(columns=["part", "a", "b", "c"]).columns))]
    return sorted(rows, key=lambda r: r[0])


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (chunk, a, b, c, d, e) of each part from batches sorted by part."""
    part, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[2] != part:
                if rows:
                    yield part, rows
                part, rows = r[2], []
            rows.append((r[1], *r[3:]))
    if rows:
        yield part, rows


def exchange(sent: DataFrame, answer, folder: str) -> None:
    """Rows dealt by part, answered part by part, and written by kind and by the chunk that asked."""
    dealt = sent.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(answer, ROWS)
    dealt.repartition("kind", "chunk").write.partitionBy("kind", "chunk").parquet(folder)


def word_requests(batches: Iterator[pa.RecordBatch], parts: int, chunk_tokens: int = CHUNK_TOKENS) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches, chunk_tokens):
        u, inverse = np.unique(c.hashes, return_inverse=True)
        counts = np.bincount(inverse[np.repeat(c.train, c.lengths)], minlength=len(u)).astype(np.uint64)
        cuts = np.searchsorted(part_of_word(u, parts), np.arange(parts + 1))
        yield batch([("ask", c.name, p, u[a:b].tobytes(), pack(counts[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if a < b])


def word_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in by_part(batches):
        keys = [np.frombuffer(r[1], np.uint64) for r in rows]
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unpack(r[2]) for r in rows]).astype(float), len(u)).astype(np.uint64)
        order = np.argsort(total, kind="stable")
        ranked = total[order]
        new = np.ones(len(u), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        index = np.empty(len(u), np.uint64)
        index[order] = np.arange(len(u)) - np.maximum.accumulate(np.where(new, np.arange(len(u)), 0))
        yield batch([("table", f"{part:06d}", part, u.tobytes(), pack(total))])
        at = 0
        for r, k in zip(rows, keys):
            mine = inverse[at : at + len(k)]
            at += len(k)
            yield batch([("answer", r[0], part, pack(total[mine]), pack(index[mine]))])


def word_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0).to_pylist():
            count, n = np.unique(unpack(raw).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(count), pa.array(n, pa.int64())], names=["count", "n"])


def hot_limit(words: Words) -> float:
    """Tokens from which a context is dealt over all partitions."""
    return max(words.total / (8 * words.parts), 1.0)


@dataclass
class Climb:
    """A chunk at some level: what the levels so far say of every token, and the context of the next one."""

    chunk: Chunk
    counts: np.ndarray  # training count of every token
    ids: np.ndarray  # number of every token
    prob: np.ndarray  # probability of every token by the levels so far
    context: np.ndarray  # name of the context of every token at the next level
    seen: np.ndarray  # how often training saw that context


@dataclass
class Grams:
    """The distinct n-grams of a chunk whose context was seen, in the order they are sent."""

    known: np.ndarray  # the tokens (indices) that have one
    which: np.ndarray  # the n-gram of each of these
    at: np.ndarray  # a token (index) of each n-gram
    cuts: np.ndarray  # n-grams before each partition and in all


@dataclass
class Level:
    """A level's discounts, and the sums of the contexts that were dealt."""

    discount: np.ndarray
    hot: dict[int, tuple[np.ndarray, float]]


def first_level(c: Chunk, words: Words, folder: str, starts: int) -> Climb:
    u, inverse = np.unique(c.hashes, return_inverse=True)
    rows = read_answers(folder, c.name)
    counts = np.concatenate([unpack(r[1]) for r in rows]).astype(np.int64)
    index = np.concatenate([unpack(r[2]) for r in rows])
    if len(counts) != len(u):
        raise RuntimeError(f"chunk {c.name} was cut otherwise when it was counted")
    ids = words.ids(counts, index, part_of_word(u, words.parts))[inverse]
    context, seen = np.empty_like(ids), np.empty(len(ids), np.int64)
    context[1:], seen[1:] = ids[:-1], counts[inverse][:-1]
    context[c.starts], seen[c.starts] = START_ID, starts
    return Climb(c, counts[inverse], ids, words.prob(ids), context, seen)


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct names, an index of each, which one every name is)."""
    u, which = np.unique(names, return_inverse=True)
    at = np.empty(len(u), np.int64)
    at[which] = np.arange(len(names))
    return u, at, which


def grams(t: Climb, words: Words) -> Grams:
    known = np.flatnonzero(t.seen > 0)
    u, first, which = distinct(gram(t.context[known], t.ids[known]))
    at = known[first]
    context = t.context[at]
    dealt = t.seen[at] > hot_limit(words)
    part = mix(context + np.uint64(1) ^ np.where(dealt, u, np.uint64(0))) & np.uint64(words.parts - 1)
    # one number sorts by part and context: word numbers fit below the part, names of contexts lose their last bits
    free = np.uint64(65 - words.parts.bit_length())
    below = context if not len(context) or int(context.max()) >> int(free) == 0 else context >> (np.uint64(64) - free)
    order = np.argsort(part << free | below)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Grams(known, place[which], at[order], np.searchsorted(part[order], np.arange(words.parts + 1, dtype=np.uint64)))


def new_contexts(context: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where another context begins among sorted n-grams, or another partition."""
    new = np.concatenate([[True], context[1:] != context[:-1]])
    new[cuts[:-1][cuts[:-1] < cuts[1:]]] = True
    return new


def gram_requests(t: Climb, g: Grams, level: int) -> pa.RecordBatch | None:
    train = np.repeat(t.chunk.train, t.chunk.lengths)[g.known]
    counts = np.bincount(g.which[train], minlength=len(g.at)).astype(np.uint64)
    context, ids = t.context[g.at], t.ids[g.at]
    rows = []
    for p, (a, b) in enumerate(zip(g.cuts[:-1].tolist(), g.cuts[1:].tolist())):
        if a < b:
            more = ()
            if level > 2:  # at the second level both follow from the words' numbers
                new = np.concatenate([[True], context[a + 1 : b] != context[a : b - 1]])
                more = (pack(t.prob[g.at[a:b]]), pack(t.seen[g.at[a:b]][new].astype(np.uint64)))
            rows.append(("ask", t.chunk.name, p, pack(rising(context[a:b])), pack(ids[a:b]), pack(counts[a:b]), *more))
    return batch(rows) if rows else None


def gram_answers(batches: Iterator[pa.RecordBatch], words: Words, starts: int) -> Iterator[pa.RecordBatch]:
    for part, rows in by_part(batches):
        contexts = [np.cumsum(unpack(r[1]), dtype=np.uint64) for r in rows]
        sizes = np.cumsum([0, *map(len, contexts)])
        context, ids = np.concatenate(contexts), np.concatenate([unpack(r[2]) for r in rows])
        _, first, inverse = distinct(gram(context, ids))
        order = np.argsort(context[first])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first, inverse = first[order], place[inverse]
        total = np.bincount(inverse, np.concatenate([unpack(r[3]) for r in rows]).astype(float), len(first)).astype(np.uint64)
        own, word = context[first], ids[first]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        heads, group = np.flatnonzero(new), np.cumsum(new) - 1
        if rows[0][4] is None:
            lower, count = words.prob(word), words.count(own[heads], starts)
        else:
            lower = np.concatenate([unpack(r[4], np.float64) for r in rows])[first]
            count = np.zeros(len(heads), np.int64)
            for i, r in enumerate(rows):
                begins = np.concatenate([[True], contexts[i][1:] != contexts[i][:-1]])
                count[group[inverse[sizes[i] : sizes[i + 1]][begins]]] = unpack(r[5]).astype(np.int64)
        sums = np.stack([np.add.reduceat(np.where(total == r, np.uint64(1), np.uint64(0)), heads) for r in range(1, MOST + 1)] + [np.add.reduceat(np.where(total > MOST, total, np.uint64(0)), heads)])
        mass = np.add.reduceat(np.where(total > 0, lower, 0.0), heads)
        seen = total > 0
        yield batch([("table", f"{part:06d}", part, pack(rising(own[seen])), pack(word[seen]), pack(total[seen]))])
        hot = count > hot_limit(words)
        if hot.any():
            yield batch([("hot", f"{part:06d}", part, pack(own[heads][hot]), pack(sums[:, hot].reshape(-1)), pack(mass[hot]))])
        for i, r in enumerate(rows):
            mine = inverse[sizes[i] : sizes[i + 1]]
            asked = group[mine]
            asked = asked[np.concatenate([[True], asked[1:] != asked[:-1]])]
            yield batch([("answer", r[0], part, pack(total[mine]), pack(sums[:, asked].reshape(-1)), pack(mass[asked]))])


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many n-grams were seen 1..MOST+1 times."""
    for b in batches:
        for raw in b.column(0).to_pylist():
            n = np.bincount(np.minimum(unpack(raw), MOST + 2).astype(np.int64), minlength=MOST + 3)
            yield pa.RecordBatch.from_arrays([pa.array(range(1, MOST + 2), pa.int64()), pa.array(n[1 : MOST + 2], pa.int64())], names=["count", "n"])


def backoff(sums: np.ndarray, mass: np.ndarray, count: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, backoff weight) of contexts. sums: [MOST + 1, contexts]."""
    kept = (sums[:MOST] * (discount[1:] * np.arange(1, MOST + 1))[:, None]).sum(axis=0) + sums[MOST]
    left = count - kept
    over = np.where(left > 1e-9, count, count + 1.0)
    left = np.where(left > 1e-9, left, 1.0) / over
    return over, left / np.maximum(1 - mass, 1e-300)


def climbed(t: Climb, g: Grams, level: Level, folder: str, starts: int) -> Climb:
    """The chunk one level higher: its tokens' probabilities by this level's counts, else backed off."""
    seen, prob = np.zeros(len(t.ids), np.int64), t.prob.copy()
    if len(g.known):
        rows = read_answers(folder, t.chunk.name)
        counts = np.concatenate([unpack(r[1]) for r in rows]).astype(np.float64)
        if len(counts) != len(g.at):
            raise RuntimeError(f"chunk {t.chunk.name} was cut otherwise when its n-grams were counted")
        sums = np.concatenate([unpack(r[2]).reshape(MOST + 1, -1) for r in rows], axis=1).astype(np.float64)
        mass = np.concatenate([unpack(r[3], np.float64) for r in rows])
        context = t.context[g.at]
        new = new_contexts(context, g.cuts)
        own, which = context[new], np.cumsum(new) - 1
        for i in np.flatnonzero(np.isin(own, np.array(list(level.hot), np.uint64))):
            sums[:, i], mass[i] = level.hot[int(own[i])]
        over, weight = backoff(sums, mass, t.seen[g.at][new].astype(np.float64), level.discount)
        kept = np.where(counts <= MOST, level.discount[np.minimum(counts, MOST).astype(np.int64)], 1.0) * counts
        direct = np.where(counts > 0, kept / over[which], weight[which] * t.prob[g.at])
        prob[g.known] = direct[g.which]
        seen[g.known] = counts.astype(np.int64)[g.which]
    name = gram(t.context, t.ids)
    context, before = np.empty_like(name), np.empty_like(seen)
    context[1:], before[1:] = name[:-1], seen[:-1]
    context[t.chunk.starts], before[t.chunk.starts] = START_ID, starts
    return Climb(t.chunk, t.counts, t.ids, prob, context, before)


def summed(t: Climb, words: Words) -> pa.RecordBatch:
    c, first = t.chunk, t.chunk.starts
    base = np.log10((t.counts + 1) / (words.total + words.types + 1))
    cols = [
        c.doc_ids, pa.array(~c.train), pa.array(c.lengths, pa.int64()), pa.array(np.add.reduceat((t.counts > 0).astype(np.int64), first)),
        pa.array(np.full(len(first), words.total), pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(t.prob), first)),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def in_splits(docs: DataFrame, spark: SparkSession, train: Column) -> DataFrame:
    """doc_id, text, train, split of docs as they are read from files. Rows that have been moved, joined or made
    otherwise have no lasting place in a split: they are written to files first."""
    train = F.coalesce(train, F.lit(False)).alias("train")
    place = F.hex(F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))).alias("split")

    def as_read(plan) -> bool:
        below = plan.children()
        return plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "LogicalRelation") and all(as_read(below.apply(i)) for i in range(below.size()))

    if as_read(docs._jdf.queryExecution().analyzed()):
        try:
            return docs.select("doc_id", "text", train, place)
        except AnalysisException:  # a table that isn't files
            pass
    return written(docs.select("doc_id", "text", train), spark, "katz-rows").select("doc_id", "text", "train", place)


def scores(docs: DataFrame, spark: SparkSession, train: Column, order: int = 2, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text);
    train: which rows the model learns from; order: tokens that an n-gram has at most; chunk_tokens: tokens of a chunk."""
    if order < 1:
        raise ValueError("the order has to be 1 at least")
    rows = in_splits(docs, spark, train)
    parts = 1 << max(4, (2 * rows.rdd.getNumPartitions() - 1).bit_length())
    folders = [shared_dir(spark, f"katz-{k}") for k in range(1, order + 1)]
    context = spark.sparkContext
    spark_rows = "part int, a binary, b binary, c binary, d binary, e binary, chunk string"
    table = lambda k, kind: spark.read.schema(spark_rows).parquet(f"{folders[k - 1]}/kind={kind}")

    exchange(rows.mapInArrow(lambda it: word_requests(it, parts, chunk_tokens), ROWS), word_answers, folders[0])
    if rows.isEmpty():
        return spark.createDataFrame([], RESULT)
    classes = table(1, "table").select("b").mapInArrow(word_classes, "count long, n long").where("count > 0").groupBy("count").agg(F.sum("n").alias("n"), F.max("n").alias("w")).collect()
    words = Words([(r["count"], r["n"], r["w"]) for r in classes], parts)
    starts = rows.where("train").count()
    shared = context.broadcast(words)
    levels: list = []

    def climb(batches: Iterator[pa.RecordBatch], known: list) -> Iterator[tuple[Climb, Grams | None]]:
        """Chunks after the levels that are known, with their n-grams of the next one if there is any."""
        for c in chunks(batches, chunk_tokens):
            t = first_level(c, shared.value, folders[0], starts)
            for k, level in enumerate(known, 2):
                t = climbed(t, grams(t, shared.value), level.value, folders[k - 1], starts)
            yield t, grams(t, shared.value) if len(known) < order - 1 else None

    def ask(known: list, k: int):
        return lambda it: (out for t, g in climb(it, known) if (out := gram_requests(t, g, k)) is not None)

    for k in range(2, order + 1):
        exchange(rows.mapInArrow(ask(list(levels), k), ROWS), lambda it: gram_answers(it, shared.value, starts), folders[k - 1])
        n: dict[int, int] = {}
        hot: dict[int, tuple[np.ndarray, float]] = {}
        if starts:
            n = {r["count"]: r["n"] for r in table(k, "table").select("c").mapInArrow(gram_counts, "count long, n long").groupBy("count").agg(F.sum("n").alias("n")).collect()}
            for r in found_hot(spark, folders[k - 1], spark_rows):  # under 8 contexts a partition
                ids = unpack(bytes(r["a"]))
                for i, s, m in zip(ids.tolist(), unpack(bytes(r["b"])).reshape(MOST + 1, -1).T.astype(np.float64), unpack(bytes(r["c"]), np.float64).tolist()):
                    old = hot.get(i, (0.0, 0.0))
                    hot[i] = (old[0] + s, old[1] + m)
        levels.append(context.broadcast(Level(discounts([n.get(r, 0) for r in range(1, MOST + 2)]), hot)))

    done = list(levels)
    return rows.mapInArrow(lambda it: (summed(t, shared.value) for t, _ in climb(it, done)), RESULT)


def found_hot(spark: SparkSession, folder: str, schema: str) -> list:
    """The rows of kind hot; there may be none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/kind=hot")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return spark.read.schema(schema).parquet(f"{folder}/kind=hot").select("a", "b", "c").collect()
