"""Round trips of the storing operators against plain readings of their contracts."""

import hashlib
import tarfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from mnemora.llm import bpe, media, packing, tokenfile  # noqa: E402
from mnemora.llm.common import shared_dir  # noqa: E402
from mnemora.llm.tokenize import ByteEncoder, WordEncoder  # noqa: E402

TEXTS = [
    "", None, "a", "x" * 64, "y" * 65, "foo  \nbar", "  \t lead and trail  ", "don't  we'll\n\n\n x", "12 34.5 &&&", "\x1cab!\x1c\x85 z",
    "é ́a İI ΣΑΣ ß", "<|endoftext|> x", "日本 語。", "½²Ⅷ abc½d", "word " * 3000, "q" * 5000, "a", "tie",
]


def docs(spark, texts=TEXTS):
    rows = [(i, t, f"extra{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


ODD = ["a", "B", "'s", "'", "s", ".", ",", "-", " ", "\n", "  ", "é", "\u3000", "\xa0", "1", "²", "\x01", "\x1c", "\u0338", "=", "日", "…", "ſ", "\u212a", "<|endoftext|>"]


def test_encoders_equal_the_library():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = TEXTS + ["a<|endoftext|>b <|startoftext|>", "q" * (1 << 21) + " b", "x≠y a-b.c,d'e's 's.'t", "\x01 a\x01b", "A.B a.b", "q" * 300, " ", "\n\n a"]
    texts += ["".join(rng.choices(ODD, k=rng.randrange(1, 14))) for _ in range(800)]
    for kind, name in ((ByteEncoder, "byte_bpe_50k.json"), (WordEncoder, "word_bpe_49k.json")):
        path = public_tokenizers.path(name)
        for special_as_text in (False, True):
            e, library = kind(path, special_as_text), Tokenizer.from_file(path)
            library.encode_special_tokens = special_as_text
            for _ in range(2):  # the second time from the memo
                ids, at = e.encode_batch(pa.array(texts))
                for i, t in enumerate(texts):
                    assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, (name, t and t[:60])
    assert [len(x) for x in e.encode_batch(pa.array([], pa.string()))] == [0, 1]


def test_memo_is_bounded(monkeypatch):
    import pyarrow as pa

    from mnemora.llm import tokenize

    monkeypatch.setattr(tokenize, "MEMO_BYTES", 20_000)
    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(20):
        texts = [f"w{k}x{i} common" for i in range(50)] + ["z" * 5000]
        ids, at = e.encode_batch(pa.array(texts))
        assert ids[at[-2] :].tolist() == e.tokenizer.encode(texts[-1], add_special_tokens=False).ids
        assert e.used * 4 + e.pieces * tokenize.PIECE_BYTES < 60_000


def test_media_round_trip(spark):
    folder = shared_dir(spark, "media-test")
    rows = media.store(docs(spark), spark, folder)
    got = {r["doc_id"]: r for r in media.read_back(rows, folder).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_width"], r["media_height"]) == (64, len(payload) // 64)
    again = docs(spark, ["same"] * 40 + [None, "other"]).repartition(5)
    folder2 = shared_dir(spark, "media-test")
    stored = media.store(again.withColumnRenamed("start", "digest"), spark, folder2)
    assert media.addresses(stored).count() == 3 and {r["payload_sha256"] for r in media.read_back(stored, folder2).collect()} == {r["digest"] for r in media.addresses(stored).collect()}
    assert got[0]["feature"] == got[1]["feature"] and got[2]["media_sha256"] == got[16]["media_sha256"]
    heads = media.header_columns(rows, folder).collect()
    assert all((h["width"], h["bits"]) == (64, 8) for h in heads)
    place = {r["digest"]: r for r in media.addresses(rows).collect()}
    for r in place.values():
        with tarfile.open(f"{folder.removeprefix('file://')}/{r['shard']}") as t:
            member = t.getmember(f"{r['digest'][:2]}/{r['digest']}.png")
            assert (member.offset_data, member.size) == (r["offset"], r["length"])


def test_media_of_nothing(spark):
    assert media.media_columns(docs(spark, []), spark).count() == 0


def test_token_files(spark):
    d = docs(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = tokenfile.write_tokens(d, spark, path)
    got = sorted(tokenfile.read_tokens(spark, files).collect())
    library, at = Tokenizer.from_file(path), 0
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert tuple(got[i]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for uri, first, _ in files:
        reader = tokenfile.Reader(uri)
        for k in range(len(reader)):
            ids = np.frombuffer(reader.read(k), "<u4").tolist()
            assert ids[-1] == 0 and k in reader.find(int(reader.doc_ids[k]))
            assert ids == library.encode(TEXTS[int(reader.doc_ids[k])] or "", add_special_tokens=False).ids + [0]


def test_ids_of_token_files(spark):
    least = -(1 << 63)
    rows = [(None, "a"), (least, "b"), (None, "c d"), (5, "e"), (5, "e"), (5, "f")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    files = tokenfile.write_tokens(d, spark, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(tokenfile.read_tokens(spark, files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, least, 5, 5, 5]
    found = [(i, r) for uri, _, _ in files for r in [tokenfile.Reader(uri)] for i in r.find(least)]
    assert len(found) == 1


def test_token_file_frames_are_plain_zstandard(spark):
    import io

    import zstandard

    uri = tokenfile.write_tokens(docs(spark, ["hello world", "b"]), spark, public_tokenizers.path("byte_bpe_50k.json"))[0][0]
    raw = open(uri.removeprefix("file://"), "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert len(plain) % 4 == 0 and plain


def test_damaged_frame_is_found(spark, tmp_path):
    uri = tokenfile.write_tokens(docs(spark, ["some text to damage " * 20]), spark, public_tokenizers.path("byte_bpe_50k.json"))[0][0]
    raw = bytearray(open(uri.removeprefix("file://"), "rb").read())
    raw[20] ^= 0xFF
    (tmp_path / "x").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017
        tokenfile.Reader(str(tmp_path / "x")).read(0)


def test_empty_token_table(spark):
    files = tokenfile.write_tokens(docs(spark, []), spark, public_tokenizers.path("byte_bpe_50k.json"))
    assert files == [] and tokenfile.read_tokens(spark, files).count() == 0


def test_tiktoken_pieces_and_decoding(spark):
    enc = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for t in TEXTS:
        t = t or ""
        for size in (1, 7, 1 << 16):
            assert "".join(bpe.pieces(t, size)) == t
            assert bpe.encode(enc, t, size) == enc.encode_ordinary(t)
        assert bpe.decode(enc, enc.encode_ordinary(t)) == t.encode()
    for body in (" " * 9000, "\n" * 9000, " \n\t\u3000\xa0" * 3000):  # long white space is matched by the operator itself
        for t in (body, "a" + body + "b c", "a" + body, body + "b", "x\x1c" + body + "\x1cz  ", "it's " + body + "'s " + body):
            assert bpe.encode(enc, t) == enc.encode_ordinary(t) == bpe.encode(enc, t, 7)
    long = " " * 2_000_000 + "b"  # more than the library's matcher can hold
    assert bpe.decode(enc, bpe.encode(enc, long)) == long.encode()
    args = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert bpe.encode_digests(docs(spark, []), *args).count() == 0
    assert [r["doc_id"] for r in bpe.encode_digests(spark.createDataFrame([(None, "a")], "doc_id long, text string"), *args).collect()] == [None]
    full = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark), *args).collect()}
    for r in bpe.encode_digests(docs(spark), *args).collect():
        f = full[r["doc_id"]]
        assert r["n_tokens"] == len(f["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, f["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(bytes(f["decoded"])).hexdigest()


def check_pieces(rows, texts, most=2048):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["sequence_tokens"] == sum(x["length"] for x in rows)
            at += r["length"]
        assert at <= most and at & (at - 1) == 0  # a power of two: no padding


def test_packing(spark):
    texts = TEXTS + ["some words here " * n for n in range(1, 200, 3)]
    rows = packing.pack(docs(spark, texts).repartition(3), public_tokenizers.path("word_bpe_49k.json")).collect()
    check_pieces(rows, texts)
    assert packing.pack(docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packer_keeps_most_documents_whole_and_groups_even():
    rng = np.random.default_rng(3)
    p = packing.Packer()
    lengths = rng.integers(1, 3000, 800)
    for i, n in enumerate(lengths):
        p.add(i, np.arange(n, dtype="<u4").tobytes())
    p.close()
    windows = p.take()
    assert sum(x.length for _, _, w in windows for x in w) == lengths.sum()
    full = [t for t, _, w in windows if sum(x.length for x in w) == t]
    assert len(full) == len(windows)
    cut = sum(x.length < len(x.ids) // 4 or x.length != x.doc_tokens for _, _, w in windows for x in w if x.doc_tokens <= 2048)
    assert cut < 0.6 * len(lengths)
    cost = {}
    for t, g, w in windows:
        if t == 2048:
            cost.setdefault(g, []).append(sum(x.length**2 for x in w))
    sizes = {g: len(c) for g, c in cost.items()}
    assert max(sizes.values()) - min(sizes.values()) <= 1


def thue_morse(power, one="a", other="b"):
    return "".join((one, other)[bin(i).count("1") % 2] for i in range(2**power))


@pytest.mark.parametrize("power", range(9, 14))
def test_words_that_a_polynomial_hash_confuses_keep_their_ids(power):
    """A word of 2**power letters and the one with its letters exchanged have equal polynomials of any base modulo 2**64."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from mnemora.llm import tokenize
    from mnemora.llm.words import word_hashes

    pair = [thue_morse(power), thue_morse(power, "b", "a")]
    texts = [*pair, " ".join(pair), pair[1] + "\n" + pair[0], thue_morse(power, "Q", "z"), thue_morse(power, "z", "Q")]
    h, _ = word_hashes(pa.array(pair))
    assert h[0] != h[1]
    for kind, name in ((tokenize.ByteEncoder, "byte_bpe_50k.json"), (tokenize.WordEncoder, "word_bpe_49k.json")):
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        encoder = kind(public_tokenizers.path(name))
        for batch in (texts, texts[::-1]):  # the second time from the memo
            ids, counts = encoder.encode_batch(pa.array(batch))
            assert [ids[a:b].tolist() for a, b in zip(counts, counts[1:])] == [e.ids for e in plain.encode_batch(batch, add_special_tokens=False)]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "ByteEncoder"), ("word_bpe_49k.json", "WordEncoder")])
def test_pieces_with_equal_keys_are_told_apart(monkeypatch, name, kind):
    """Were all keys equal, the second hash would still give every piece its own ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from mnemora.llm import tokenize

    real = tokenize.span_hashes
    monkeypatch.setattr(tokenize, "span_hashes", lambda *a, **k: [np.zeros_like(real(*a, **k)[0]), real(*a, **k)[1]])
    texts = ["one two three two", "two one", "", "three's <|endoftext|> one", "Z" * 400 + " one", None]
    ids, counts = getattr(tokenize, kind)(public_tokenizers.path(name)).encode_batch(pa.array(texts))
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    assert [ids[a:b].tolist() for a, b in zip(counts, counts[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
