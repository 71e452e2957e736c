"""The registered queries over a whole table against plain loops, and the classifier against a plain convolution."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")

from tokenizers import Tokenizer  # noqa: E402

from mnemora.llm import katz, pii, queries, toxicity  # noqa: E402
from mnemora.llm.common import bucket  # noqa: E402
from test_katz import Brute, words  # noqa: E402
from test_media_tokens_packing import check_pieces  # noqa: E402


@pytest.fixture(scope="module")
def table(small):
    rows = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def collected(spark, small, name):
    return queries.QUERIES[name](spark, small).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, small, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = queries.QUERIES[name](spark, small)
    ref = db.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in ref.description)
    order = [[c[0] for c in ref.description].index(c) for c in columns]
    assert sorted(got.columns) == columns
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, (tuple(r[i] for i in order) for r in ref.fetchall())))


def test_media_query(spark, small, table):
    got = {r["doc_id"]: r for r in collected(spark, small, "op2_media")}
    assert set(got) == set(table)
    features = {}
    for i, t in table.items():
        raw = t.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert features.setdefault(t, (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])


def test_token_file_query(spark, small, table):
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in collected(spark, small, "op3_token_files")}
    assert set(got) == set(table)
    for i in sorted(table):
        ids = np.array(library.encode(table[i], add_special_tokens=False).ids + [0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packing_query(spark, small, table):
    rows = collected(spark, small, "op4_packing")
    number = {i: k for k, i in enumerate(sorted(table))}
    check_pieces([{**r.asDict(), "doc_id": number[r["doc_id"]]} for r in rows], [table[i] for i in sorted(table)])


def test_byte_bpe_query(spark, small, table):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in collected(spark, small, "op5_byte_bpe")}
    assert set(got) == set(table)
    for i, t in table.items():
        ids = library.encode_ordinary(t)
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha, hashlib.sha256(t.encode()).hexdigest())


def test_katz_query(spark, small, table):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in table}
    brute = Brute([t for i, t in table.items() if not held[i]], 2)
    got = {r["doc_id"]: r for r in collected(spark, small, "op10_katz")}
    assert set(got) == set(table)
    some = sorted(table, key=lambda i: len(table[i]))
    for i in table:
        w = words(table[i])
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held[i], len(w), sum(brute.uni[x] > 0 for x in w), brute.n)
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((brute.uni[x] + 1) / (brute.n + len(brute.uni) + 1)) for x in w), abs=1e-6)
    for i in some[:40]:  # the plain loops take long
        assert got[i]["score"] == pytest.approx(brute.score(table[i]), abs=1e-8)


def test_small_chunks_give_the_same_katz_scores(spark, tmp_path):
    """Texts longer than a chunk are chunks of their own, short ones share one; scores don't change."""
    texts = ["a b a b c", "x " * 300 + "a b", None, "", "the cat sat on the mat", "c b a " * 100] * 4
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    rows = spark.read.parquet(str(tmp_path / "docs"))
    scored = lambda **how: sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["score"], 9), round(r["base_score"], 9)) for r in katz.scores(rows, spark, bucket("doc_id", 7) != 2, 3, **how).collect())
    assert scored(chunk_tokens=20) == scored(chunk_tokens=1) == scored()


def test_score_is_a_plain_convolution():
    rng = np.random.default_rng(5)
    model = toxicity.Model(bits=9)
    model.tables = [rng.normal(0, 1, (512, model.dim)).astype(np.float32) for _ in range(toxicity.TABLES)]
    model.kernels = [rng.normal(0, 1, (w, toxicity.TABLES * model.dim, model.filters)).astype(np.float32) for w in model.widths]
    model.biases = [rng.normal(0, 1, model.filters).astype(np.float32) for _ in model.widths]
    model.out, model.offset, model.scale = rng.normal(0, 1, len(model.widths) * model.filters).astype(np.float32), 0.25, (1.5, -0.5)
    texts = ["one two three", "", None, "A! b? c.", "word " * 50, "x", "two one", "the quick brown fox jumps over the lazy dog " * 9]
    h, counts = toxicity.hashed(pa.array(texts))
    got = model.score(h, counts)
    for d, t in enumerate(texts):
        tokens = "".join(c if c.isalnum() or c > "\x7f" else " " for c in (t or "")).split()
        vectors = []
        for w in tokens:
            rows = model.rows(toxicity.hashed(pa.array([w]))[0])
            vectors.append(np.concatenate([table[r[0]] for table, r in zip(model.tables, rows)]))
        vectors += [np.zeros(toxicity.TABLES * model.dim)] * (max(model.widths) - 1)
        best = []
        for width, kernel, bias in zip(model.widths, model.kernels, model.biases):
            for f in range(model.filters):
                value = 0.0
                for at in range(len(tokens)):
                    value = max(value, bias[f] + sum(float(vectors[at + k] @ kernel[k, :, f]) for k in range(width)))
                best.append(value)
        z = sum(a * b for a, b in zip(best, model.out)) + model.offset
        assert got[d] == pytest.approx(1 / (1 + np.exp(-(1.5 * z - 0.5))), abs=1e-4)


def test_a_large_labelled_text_is_passed_over(spark):
    docs = spark.createDataFrame([(i, "t" * (1000 if i == 3 else 10), "en") for i in range(8)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    assert sorted(toxicity.labelled_sample(docs, labels, most_bytes=75)["doc_id"]) == [0, 1, 2, 4, 5, 6, 7]
    assert len(toxicity.labelled_sample(docs, labels, most_bytes=5)) == 0


def test_null_ids_and_clashing_columns(spark):
    """Ids without a value and columns of any name go through the storing operators."""
    from mnemora.llm import media, packing, tokenfile

    rows = spark.createDataFrame([(None, "a b", "x"), (1, None, "y"), (1, "a b", "y"), (2, "c " * 40_000, "z")], "doc_id long, text string, start string")
    stored = media.media_columns(rows.select("doc_id", "text"), spark).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in stored) == [("1", 0), ("1", 3), ("2", 80_000), ("None", 3)]
    packed = packing.pack(rows, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted({(str(r["doc_id"]), r["doc_tokens"]) for r in packed}) == [("1", 1), ("1", 3), ("2", 40_001), ("None", 3)]
    assert sum(r["length"] for r in packed) == 1 + 3 + 40_001 + 3
    files = tokenfile.write_tokens(rows, spark, public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(str(r["doc_id"]) for r in tokenfile.read_tokens(spark, files).collect()) == ["1", "1", "2", "None"]


def test_field_runs_on_documents_of_weak_tokens(spark):
    docs = spark.createDataFrame([(1, "nothing 1 here 2"), (2, None), (3, "call +1 555 123 4567 or 5551234567")], "doc_id long, text string")
    assert pii.find(docs, pii.learn(docs)).count() == 3
