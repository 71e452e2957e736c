"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes outside space and 0x09-0x0D, with A-Z lower-cased. Its hash is multilinear: each byte
times a random number of its place in the word, added up modulo 2**64 by one running sum over the whole batch, then
mixed. It is no polynomial of one base, whose powers of two make whole families of words equal: for any two
different words the sums agree for 2**57 of the 2**64 values that one place's number could have, so a pair clashes with a probability of
2**-57 at most; hashes of two seeds, as the tokenizers' pieces have, agree with 2**-114. No Python object is made per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
#: Places of a word with numbers of their own; bytes hashed at once.
_SEGMENT, _BLOCK = 1 << 20, 1 << 16

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Breaks between words where punctuation is no part of a word: ASCII but letters and digits.
PLAIN = np.zeros(256, dtype=bool)
PLAIN[:128] = [not chr(i).isalnum() for i in range(128)]
#: What a byte counts as in a hash: with A-Z as a-z, and as it is.
FOLDED = FOLD.astype(np.uint64) + np.uint64(1)
RAW = np.arange(1, 257, dtype=np.uint64)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)

_tables: dict[int, np.ndarray] = {}


def _numbers(seed: int) -> np.ndarray:
    """The random numbers of a word's places."""
    if seed not in _tables:
        _tables[seed] = np.random.Generator(np.random.PCG64(0xC0FFEE + seed)).integers(0, 1 << 64, _SEGMENT, np.uint64)
    return _tables[seed]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each document and in all)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(breaks[data], out=inside[1:-1])
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[first] = inside[first + 1]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = inside[last + 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words before each document and in all)."""
    (out,), counts = prefix_hashes(column, (0,), breaks)
    return out, counts


def prefix_hashes(column: pa.Array, sizes: tuple[int, ...], breaks: np.ndarray = SPACE) -> tuple[list[np.ndarray], np.ndarray]:
    """(per size, the hash of every word's first bytes, of the whole word for 0; words before each
    document and in all)."""
    data, offsets = text_buffer(column)
    starts, ends, counts = word_spans(data, offsets, breaks)
    return span_hashes(data, starts, ends, sizes), counts


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...] = (0,), value: np.ndarray = FOLDED, seeds: tuple[int, ...] = (0,)
) -> list[np.ndarray]:
    """Per size, and for each of these per seed, the hash of the first bytes (all for 0) of rising spans that don't overlap. value: what
    each byte counts as; RAW tells upper from lower case."""
    out = [np.empty(len(starts), np.uint64) for _ in sizes for _ in seeds]
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(int(np.searchsorted(ends, base + _BLOCK, side="right")), i + 1)
        if ends[i] - base > _SEGMENT:  # longer than a segment: the tables don't grow with it
            for k, h in enumerate(out):
                size = sizes[k // len(seeds)]
                h[i] = _long(data[base : min(int(ends[i]), base + size) if size else int(ends[i])], value, seeds[k % len(seeds)])
            i += 1
            continue
        n = int(ends[j - 1] - base)
        s, whole = starts[i:j] - base, ends[i:j] - base
        place = np.zeros(n, np.int64)  # of each byte in its span
        place[s] = s
        np.subtract(np.arange(n), np.maximum.accumulate(place, out=place), out=place)
        values = value[data[base : base + n]]
        run = np.empty(n + 1, np.uint64)
        run[0] = 0
        for k, seed in enumerate(seeds):
            product = _numbers(seed)[place]
            product *= values
            np.cumsum(product, out=run[1:])
            for m, size in enumerate(sizes):
                e = np.minimum(whole, s + size) if size else whole
                out[m * len(seeds) + k][i:j] = mix(run[e] - run[s] + (e - s).astype(np.uint64) * _LENGTH)
        i = j
    return out


def _long(data: np.ndarray, value: np.ndarray, seed: int) -> np.uint64:
    """Of more than a segment: each segment's sum is mixed into the ones before it."""
    total = np.zeros(1, np.uint64)
    for i in range(0, len(data), _SEGMENT):
        part = data[i : i + _SEGMENT]
        own = (value[part] * _numbers(seed)[: len(part)]).sum(dtype=np.uint64)
        total = own + (mix(total) * np.uint64(_P) if i else total)
    return mix(total + np.uint64(len(data) * int(_LENGTH) % (1 << 64)))[0]


def shingle_hashes(h: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of so many words, runs before each document and in all) from hashes of words.
    A document of fewer words has one run, of all its words; one without words has none."""
    n = np.diff(counts)
    made = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    before = np.concatenate([[0], np.cumsum(made)])
    first = np.repeat(counts[:-1] - before[:-1], made) + np.arange(before[-1])
    size = np.repeat(np.minimum(n, words), made)
    out = np.zeros(len(first), np.uint64)
    for k in range(words):
        on = size > k
        out[on] = out[on] * np.uint64(_P) + h[first[on] + k]
    return mix(out + size.astype(np.uint64) * _LENGTH), before
