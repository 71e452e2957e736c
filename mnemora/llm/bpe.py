"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut before encoding, only where a character that isn't white space is followed by a space or a
newline: no match of the split pattern holds such a pair, so every match of the whole text lies in one piece.
The library's matcher can't hold a run of some hundred thousand white-space characters on its stack, so a run of
over RUN of them is matched here: the pattern takes all of it but the last character where text follows, and all
of it at the end of the text; that match is encoded as one. Decoding joins the raw bytes of the ids.

Defined cases: a null or empty text has no ids and decodes to no bytes; a text of any length without
white space is one piece, one of white space alone is one match; equal texts and repeated rows have equal ids;
other columns, whatever their names, are kept out; a null id is kept; an empty table gives no rows."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PIECE_CHARS = 1 << 16
RUN = 1 << 12
#: The white space of the split pattern (Unicode's property; Python's own class holds more).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(rf"(?<=[^{_WHITE}])(?=[ \n])")
_RUN = re.compile(rf"[{_WHITE}]{{{RUN},}}")
_encoders: dict[tuple[str, str], object] = {}


def encoder(path: str, pattern: str):
    import tiktoken

    if (path, pattern) not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """text cut at safe places into pieces of about size code points (more where none is found)."""
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def encode(enc, text: str, size: int = PIECE_CHARS) -> list[int]:
    if len(text) <= min(size, RUN):
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        b -= b < len(text)  # the last one may belong to the match that follows
        for piece in pieces(text[at:a], size):
            out += enc.encode_ordinary(piece)
        out += enc._encode_single_piece(text[a:b])
        at = b
    for piece in pieces(text[at:], size):
        out += enc.encode_ordinary(piece)
    return out


def decode(enc, ids: list[int]) -> bytes:
    return enc.decode_bytes(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """id, ids array<int>, decoded binary: one row per row of (id, text), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            ids = [encode(enc, x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([decode(enc, x) for x in ids], pa.binary())],
                names=[id_column, "ids", "decoded"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: digests of what encode_documents returns, made in
    the task that encodes so that ids need not travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, by_ids, by_text = [], [], []
            for x in b.column(1).to_pylist():
                ids = encode(enc, x or "")
                n.append(len(ids))
                by_ids.append(sha(",".join([names[i] for i in ids]).encode()))
                by_text.append(sha(decode(enc, ids)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(by_ids), pa.array(by_text)],
                names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(
        run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
