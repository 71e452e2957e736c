"""Whole-text encoding with the tokenizers library, each distinct piece of text once per worker.

Texts are cut into pieces at white space, and between an ASCII letter or digit and ASCII punctuation (an
apostrophe may begin a contraction and stays), where the library's own cuts make the pieces independent of each
other. Pieces are found and hashed for a whole Arrow batch at once: a 64-bit key and a second hash of 64 bits that is
compared wherever the key is known, so a piece whose key is another's is encoded by itself. The library encodes the pieces that a
worker hasn't met yet, thousands of them as one text, ids of the others come from a memo, and all ids are gathered
by offsets: no Python object is made for a piece that is known.

The memo is bounded in bytes (MEMO_BYTES, emptied when full); a piece of over LONG bytes is encoded each time
and not kept. A text with the string of a special token goes to the library whole, so results are those of
a plain `encode(text, add_special_tokens=False)`; with `special_as_text` such strings are ordinary text.

Defined cases: a null or empty text has no ids; a text without white space is one piece, however long."""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa

from .words import FOLDED, RAW, SPACE, span_hashes, text_buffer, word_spans

MEMO_BYTES = 96 << 20
#: What one piece in the memo takes beside its ids.
PIECE_BYTES = 128
LONG = 256
_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
_PUNCT = np.array([32 < i < 127 and not chr(i).isalnum() and chr(i) != "'" for i in range(256)])
_cache: dict[tuple[type, str], object] = {}


def load(path: str, special_as_text: bool = False):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special_as_text
    return t


def unicode_space_ends(data: np.ndarray) -> np.ndarray:
    """Positions right after a white-space character of more than one byte."""
    out = []
    two = np.flatnonzero(data[:-1] == 0xC2)
    out.append(two[np.isin(data[two + 1], (0x85, 0xA0))] + 2)
    if len(data) > 2:
        three = np.flatnonzero(np.isin(data[:-2], (0xE1, 0xE2, 0xE3)))
        a, b, c = (data[three + k].astype(np.int64) for k in range(3))
        code = ((a & 15) << 12) | ((b & 63) << 6) | (c & 63)
        #: White space beyond U+07FF.
        spaces = [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        out.append(three[np.isin(code, spaces)] + 3)
    return np.concatenate(out)


def inner_cuts(data: np.ndarray) -> np.ndarray:
    """Positions between an ASCII letter or digit and ASCII punctuation."""
    return np.flatnonzero(_ALNUM[data[:-1]] & _PUNCT[data[1:]]) + 1


class Encoder:
    """Common to both kinds of vocabulary; `cut` gives the spans of pieces, `together` their ids."""

    value = RAW

    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = load(path, special_as_text)
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.memo: dict[int, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size, self.pieces = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0
        self.check = np.empty(1 << 12, np.uint64)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raise NotImplementedError

    def keep(self, ids: np.ndarray, n: np.ndarray, check: np.ndarray) -> None:
        """Appends the ids of pieces of n ids each, and their second hashes."""
        total, count = self.used + len(ids), self.pieces + len(n)
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(total, np.uint32)])
        if count > len(self.start):
            self.start = np.concatenate([self.start[: self.pieces], np.empty(count, np.int64)])
            self.size = np.concatenate([self.size[: self.pieces], np.empty(count, np.int64)])
            self.check = np.concatenate([self.check[: self.pieces], np.empty(count, np.uint64)])
        self.ids[self.used : total] = ids
        self.start[self.pieces : count] = self.used + np.cumsum(n) - n
        self.size[self.pieces : count] = n
        self.check[self.pieces : count] = check
        self.used, self.pieces = total, count

    def whole_documents(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Documents that hold the string of a special token."""
        found = set()
        for s in self.special:
            s, at = s.encode(), 0
            while (at := raw.find(s, at)) >= 0:
                found.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at += 1
        return np.array(sorted(found), np.int64)

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as unsigned 32-bit numbers, ids before each text and in all)."""
        data, offsets = text_buffer(column)
        raw = data.tobytes()
        starts, ends, counts = self.cut(data, offsets)
        whole = self.whole_documents(raw, offsets)
        if len(whole):
            of = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
            out = np.isin(of, whole)
            starts, ends, of = np.concatenate([starts[~out], offsets[whole]]), np.concatenate([ends[~out], offsets[whole + 1]]), np.concatenate([of[~out], whole])
            order = np.argsort(starts, kind="stable")
            starts, ends, of = starts[order], ends[order], of[order]
            counts = np.searchsorted(of, np.arange(len(offsets)))
        h, check = span_hashes(data, starts, ends, value=self.value, seeds=(0, 1))
        keys = h.tolist()
        get = self.memo.get
        index = np.fromiter(map(get, keys, repeat(-1)), np.int64, len(keys))
        if len(missing := np.flatnonzero(index < 0)):
            if self.used * 4 + self.pieces * PIECE_BYTES > MEMO_BYTES:
                self.clear()
                get, missing = self.memo.get, np.arange(len(keys))
            _, at = np.unique(h[missing], return_index=True)
            new = missing[at]
            short = new[(ends[new] - starts[new] <= LONG) & ~np.isin(starts[new], offsets[whole])]
            self.learn(raw, starts, ends, keys, check, short)
            index[missing] = np.fromiter(map(get, h[missing].tolist(), repeat(-1)), np.int64, len(missing))
        before = self.used, self.pieces
        # long pieces, whole texts, and pieces whose key is another's: for this batch alone, those of equal hashes once
        alone = np.flatnonzero((index < 0) | (self.check[index] != check))
        if len(alone):
            own = np.where(np.isin(starts[alone], offsets[whole]), alone + 1, 0).astype(np.uint64)  # case may matter in a special string
            pairs = np.stack([h[alone], check[alone], own], axis=1)
            _, at, same = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
            first = self.pieces
            for i in alone[at].tolist():
                one = self.library(raw[starts[i] : ends[i]].decode())
                self.keep(one, np.array([len(one)]), check[i : i + 1])
            index[alone] = first + same.reshape(-1)
        n = self.size[index]
        done = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.start[index] - done[:-1], n) + np.arange(done[-1])]
        self.used, self.pieces = before
        return ids, done[counts]

    def learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, keys: list[int], check: np.ndarray, new: np.ndarray) -> None:
        for i in range(0, len(new), 1 << 14):
            part = new[i : i + (1 << 14)].tolist()
            texts = [raw[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist())]
            joined = [self.joins(t) for t in texts]
            for group, encode in ((True, self.together), (False, self.apart)):
                own = [k for k, j in enumerate(joined) if j == group]
                if own:
                    first = self.pieces
                    self.keep(*encode([texts[k] for k in own]), check[[part[k] for k in own]])
                    self.memo.update(zip([keys[part[k]] for k in own], range(first, self.pieces)))

    def joins(self, piece: bytes) -> bool:
        """Whether a piece may be encoded in one text with others."""
        raise NotImplementedError

    def together(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, their numbers) by one call of the library."""
        raise NotImplementedError

    def apart(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum())), n

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


class ByteEncoder(Encoder):
    """For byte-level vocabularies that keep white space: a piece is a run of white space with the
    characters after it. At white space a text is cut only where one of one byte follows another character; after a
    longer white-space character there is no cut, as one match of the library may span both."""

    def __init__(self, path: str, special_as_text: bool = False):
        super().__init__(path, special_as_text)
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)

    def joins(self, piece: bytes) -> bool:
        return SPACE[piece[0]] and not SPACE[piece[-1]]

    def together(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each piece begins with white space and ends without, so they are cut apart again: the ids of a piece
        spell its bytes."""
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(texts).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(self.width[ids])
        wanted = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        cuts = np.searchsorted(ends, wanted)
        if ends[-1] != wanted[-1] or (ends[cuts] != wanted).any():  # an odd vocabulary, or a last character that is white space of several bytes
            return self.apart(texts)
        return ids, np.diff(cuts, prepend=-1)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, ends, counts = word_spans(data, offsets, SPACE)
        marks = np.zeros(len(data) + 1, bool)
        marks[ends] = True
        if len(data):
            marks[unicode_space_ends(data)] = False
            marks[inner_cuts(data)] = True
        filled = offsets[:-1] < offsets[1:]
        marks[offsets[1:][filled]] = True
        ends = np.flatnonzero(marks)
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
        return starts, ends, np.searchsorted(ends, offsets, "right")


class WordEncoder(Encoder):
    """For vocabularies that drop white space: a piece is a run without white space of one byte. Where A-Z
    have the ids of a-z, they share pieces."""

    MARK = "\x01"

    def __init__(self, path: str, special_as_text: bool = False):
        super().__init__(path, special_as_text)
        if self.library("ABC XYZ").tolist() == self.library("abc xyz").tolist():
            self.value = FOLDED
        mark = self.library(self.MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None

    def joins(self, piece: bytes) -> bool:
        return self.mark is not None and b"\x01" not in piece

    def together(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A control character stands between the pieces as a word of its own, whose id cuts them apart again."""
        ids = np.array(self.tokenizer.encode_batch_fast([f" {self.MARK} ".join([t.decode() for t in texts])], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(ids == self.mark)
        if len(at) != len(texts) - 1:
            return self.apart(texts)
        return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, counts = word_spans(data, offsets, SPACE)
        if len(inner := inner_cuts(data)):
            marks = np.zeros((2, len(data) + 1), bool)
            marks[0, starts] = marks[1, ends] = marks[:, inner] = True
            starts, ends = np.flatnonzero(marks[0]), np.flatnonzero(marks[1])
            counts = np.searchsorted(starts, offsets)
        return starts, ends, counts


def _once(kind, path: str):
    if (kind, path) not in _cache:
        _cache[kind, path] = kind(path)
    return _cache[kind, path]


def byte_encoder(path: str) -> ByteEncoder:
    """The worker's encoder for a file, made once."""
    return _once(ByteEncoder, path)


def word_encoder(path: str) -> WordEncoder:
    return _once(WordEncoder, path)
