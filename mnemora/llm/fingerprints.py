"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency ln(N / df) lies in a chosen band: terms in over a fifth
of all documents tell nothing, terms in less than one of exp(BAND[1]) documents are too rare to be shared. Document
frequencies are exact and cover all rows. The band's rare end bounds the lexicon: it can't hold more than
exp(BAND[1]) times as many terms as a document has on average, so its size (8 bytes a term, gathered and broadcast) is
bounded whatever the input. In a table of fewer than exp(BAND[1]) documents, 20,000, the rare end takes nothing away; in a
larger one terms of fewer than N / 20,000 documents leave the lexicon, so a pair that shares such terms is less alike there.

A document keeps its distinct lexicon terms, sorted. The lexicon is dealt at random to PARTS subsets; on LEVELS
levels, each a random quarter of the one before, the terms of every subset are hashed to 12 bits. The fingerprint is a
hash of all the text's distinct terms, then the subsets' hashes, three hex digits each, 000 where a subset has no term,
up to the last level that the text reaches. Dense levels tell short texts apart, thin ones still agree on long texts of
which a part was changed. `likeness` reads all levels alike.

Defined cases: a null or empty text has the fingerprint of 16 zeros and is like (1.0) only to another such;
equal texts have equal fingerprints; a text without lexicon terms is like only to one of the same terms; equal doc_ids
and repeated rows follow each other by their text's hash; a null doc_id stays null and sorts last; very long texts are
taken whole; columns other than doc_id and text, whatever their names, are ignored; the only document is its own next
one; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import mix, word_hashes

#: The last of 16 levels is full from 4**15 times as many terms as the first, more than a text can hold.
LEVELS, PARTS = 16, 32
#: Inverse document frequencies of the lexicon: in a fifth of all documents, in one of 20,000.
BAND = (1.6, 9.9)
#: Terms that a task holds before it adds them up.
FLUSH = 1 << 22
NULL_ID = -(1 << 63)


def distinct_terms(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of the distinct terms, sorted by both."""
    docs = np.repeat(np.arange(len(counts) - 1, dtype=np.int64), np.diff(counts))
    order = np.lexsort((h, docs))
    d, t = docs[order], h[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    return d[new], t[new]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term (its signed 64-bit hash), n: in how many documents it occurs, over all rows. Every task counts its
    distinct terms, FLUSH at a time, before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            terms, inverse = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return terms, np.bincount(inverse, np.concatenate([n for _, n in held]), len(terms)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            terms, n = held[0]
            for i in range(0, len(terms), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["term", "n"])

        for b in batches:
            _, t = distinct_terms(*word_hashes(b.column(0)))
            terms, n = np.unique(t, return_counts=True)
            held.append((terms, n))
            size += len(terms)
            if size >= FLUSH:
                held = [summed()]
                size = len(held[0][0])
                if size >= FLUSH // 2:
                    yield from rows()
                    held, size = [], 0
        if held:
            held = [summed()]
            yield from rows()

    return docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, band: tuple[float, float]) -> np.ndarray:
    """The sorted hashes of the terms whose inverse document frequency ln(N / df) lies in band. They are at most
    exp(band[1]) times the mean number of distinct terms of a document, whatever N is."""
    n = docs.count()
    inside = F.col("n").between(float(n * np.exp(-band[1])), float(n * np.exp(-band[0])))
    found = document_frequencies(docs).where(inside).select("term").toPandas()["term"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def fingerprints(column: pa.Array, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(per text a hash of all its distinct terms, 0 for none; [texts, LEVELS, PARTS] 12-bit hashes of its lexicon
    terms in each subset, 0 where a subset has none). kept: the lexicon."""
    h, counts = word_hashes(column)
    n = len(counts) - 1
    d, t = distinct_terms(h, counts)
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, d, mix(t ^ np.uint64(0x1234_5678_9ABC_DEF1)) | np.uint64(1))
    whole = np.where(np.bincount(d, minlength=n) > 0, mix(whole) | np.uint64(1), np.uint64(0))
    if len(kept):
        inside = kept[np.minimum(np.searchsorted(kept, t), len(kept) - 1)] == t
        d, t = d[inside], t[inside]
    else:
        d, t = d[:0], t[:0]
    r = mix(t ^ np.uint64(0xA5A5_5A5A_1234_4321))
    level = np.zeros(len(t), np.int64)
    for k in range(1, LEVELS):
        level += (r & np.uint64((1 << (2 * k)) - 1)) == 0
    part = ((r >> np.uint64(32)) & np.uint64(PARTS - 1)).astype(np.int64)
    sums = np.zeros(n * LEVELS * PARTS, np.uint64)
    for k in range(LEVELS):
        on = np.flatnonzero(level >= k)
        if not len(on):
            break
        # terms are sorted by document, so those of a subset are brought together by a stable sort of the subsets
        at = (d[on] * LEVELS + k) * PARTS + part[on]
        order = np.argsort(at, kind="stable")
        at, terms = at[order], t[on][order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sums[at[first]] = np.add.reduceat(mix(terms + np.uint64(k + 1)) | np.uint64(1), first)
    out = np.where(sums == 0, np.uint64(0), mix(sums) % np.uint64(4095) + np.uint64(1))
    return whole, out.astype(np.uint16).reshape(n, LEVELS, PARTS)


def text_of(whole: np.ndarray, fp: np.ndarray) -> list[str]:
    """Each fingerprint's hex digits: 16 of the whole text, then three for each subset up to the last level that has
    any term."""
    some = (fp > 0).any(axis=2)
    levels = np.where(some.any(axis=1), LEVELS - some[:, ::-1].argmax(axis=1), 0)
    flat = fp.reshape(len(fp), -1)
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    chars = np.stack([digits[(flat >> 8) & 15], digits[(flat >> 4) & 15], digits[flat & 15]], axis=2)
    return [f"{w:016x}" + x[: 3 * PARTS * k].tobytes().decode() for w, x, k in zip(whole.tolist(), chars.reshape(len(fp), -1), levels.tolist())]


def parse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of text_of for one fingerprint, as fingerprints of one text."""
    found = np.array([int(text[i : i + 3], 16) for i in range(16, len(text), 3)], np.uint16)
    return np.array([int(text[:16], 16)], np.uint64), np.pad(found, (0, LEVELS * PARTS - len(found))).reshape(1, LEVELS, PARTS)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of texts: an estimate of the Jaccard similarity of their lexicon terms.

    A subset of density q disagrees with probability 1 - exp(-q x) where x terms are in one text only, and is in use
    with 1 - exp(-q u) where u are in either. Densities fall by four, so over all levels PARTS log4(x) and
    PARTS log4(u) subsets, and a common constant, do: the number of agreeing subsets tells u / x. Equal fingerprints
    give 1, and texts without lexicon terms 0 otherwise."""
    used = (a[1] > 0) | (b[1] > 0)
    same = ((a[1] == b[1]) & used).sum(axis=(1, 2))
    used = used.sum(axis=(1, 2))
    share = lambda n: -np.expm1(-n * np.log(4) / PARTS)
    return np.where(a[0] == b[0], 1.0, np.where(used > 0, share(same) / np.maximum(share(used), 1e-12), 0.0)) + 0.0


def neighbours(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """id, absent (no id), h, packed (zstandard UTF-8 text), bucket, halo: all rows in buckets of descending ranges
    of (id, text hash).

    Sorted by (bucket, halo, absent, id descending, h), each row is followed by its next document: the first row of
    the next bucket is also sent to the end of this one (halo 1), the very first to the end of the last. An id
    that several quantiles fall on is split into as many buckets by ranges of the hash. The driver gathers the
    bounds and the first row of each bucket: a number for each partition, not for each document."""
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 8).alias("h")
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("doc_id").isNull().alias("absent"), h, F.coalesce("text", F.lit("")).alias("text"))
    wanted = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    quantiles = rows.agg(F.percentile_approx("id", [i / wanted for i in range(1, wanted)], 10 * wanted).alias("q")).first()["q"]
    bounds, repeats = np.unique(np.array(quantiles or [0], np.int64), return_counts=True)
    slices = int(repeats.max()) + 1

    def locate(v: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(bounds, v, side="left")
        r = np.where((at < len(bounds)) & (bounds[np.minimum(at, len(bounds) - 1)] == v), repeats[np.minimum(at, len(bounds) - 1)], 0)
        inside = np.where(r > 1, (h * r) >> 56, np.where(r == 1, 0, slices - 1))
        return (len(bounds) - at) * slices + inside

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, tuple] = {}
        for b in batches:
            v, absent, h = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            where = locate(v, h)
            order = np.lexsort((h, -v.astype(float), -v, absent, where))
            first = order[np.concatenate([[True], where[order][1:] != where[order][:-1]])]
            for k, row in zip(where[first].tolist(), zip(absent[first].tolist(), (-v[first].astype(object)).tolist(), h[first].tolist())):
                top[k] = min(top.get(k, row), row)
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array([x[0] for x in top.values()], pa.bool_()), pa.array([-x[1] for x in top.values()], pa.int64()), pa.array([x[2] for x in top.values()], pa.int64())], names=["bucket", "absent", "id", "h"])

    found = rows.select("id", "absent", "h").mapInArrow(heads, "bucket long, absent boolean, id long, h long")
    least = found.groupBy("bucket").agg(F.min(F.struct("absent", F.bitwise_not("id").alias("back"), "h")).alias("x")).collect()  # a row for each bucket
    firsts = {r["bucket"]: (r["x"]["absent"], r["x"]["back"] + 1, r["x"]["h"]) for r in least}
    order = sorted(firsts)
    follows = {firsts[k]: order[i - 1] for i, k in enumerate(order)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            v, absent, h = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            out = [(i, a, x, pack(t.encode()), k, 0) for i, a, x, t, k in zip(v.tolist(), absent.tolist(), h.tolist(), b.column(3).to_pylist(), locate(v, h).tolist())]
            out += [(i, a, x, p, follows[a, -i, x], 1) for i, a, x, p, k, _ in out if (a, -i, x) in follows]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], names=["id", "absent", "h", "packed", "bucket", "halo"])

    dealt = rows.mapInArrow(deal, "id long, absent boolean, h long, packed binary, bucket long, halo int")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "halo", "absent", F.desc("id"), "h")


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many code points of following."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def fingerprint_neighbours(docs: DataFrame, spark: SparkSession, band: tuple[float, float] = BAND) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and the likeness of both and of the next's."""
    shared = spark.sparkContext.broadcast(lexicon(docs, band))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        kept = shared.value
        held: tuple | None = None  # (bucket, id, text, whole, hashes) that waits for the next row

        def rows(pairs: list[tuple]) -> pa.RecordBatch:
            changed = [edited(a[2], b[2]) for a, b in pairs]
            own, after = ((np.array([x[3] for x in side], np.uint64), np.stack([x[4] for x in side])) for side in zip(*pairs))
            other = fingerprints(pa.array(changed, pa.string()), kept)
            cols = [
                pa.array([a[1] for a, _ in pairs], pa.int64()),
                pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                pa.array(text_of(*own)),
                pa.array(text_of(*other)),
                pa.array(likeness(own, other)),
                pa.array(likeness(own, after)),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in batches:
            texts = [unpack(x.as_py(), max_output_size=0) if x.is_valid else b"" for x in b.column("packed")]
            column = pa.array(texts, pa.binary()).cast(pa.string())
            pairs = []
            ids = [None if gone else i for i, gone in zip(b.column("id").to_pylist(), b.column("absent").to_pylist())]
            for k, i, halo, t, w, p in zip(b.column("bucket").to_pylist(), ids, b.column("halo").to_pylist(), column.to_pylist(), *fingerprints(column, kept)):
                row = (k, i, t, w, p)
                if held is not None and held[0] == k:
                    pairs.append((held, row))
                held = None if halo else row
            if pairs:
                yield rows(pairs)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs, spark).mapInArrow(run, schema)
