"""Toxicity on held-out rows, personal data against plain patterns, fingerprints against plain sets."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from mnemora.llm import fingerprints, pii, toxicity
from mnemora.llm.queries import op1_toxicity, op6_fingerprints, op7_pii
from mnemora.llm.words import PLAIN, word_hashes

SMALL = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_words():
    h, c = word_hashes(pa.array(["A b a", "b", None, "", " x\tA ", "bA b"]))
    assert c.tolist() == [0, 3, 4, 4, 4, 6, 8] and h[0] == h[2] == h[5] and h[1] == h[3] == h[7] and len(set(h.tolist())) == 4
    long = word_hashes(pa.array(["w" * 3_000_000 + " w"]))[0]
    assert long[0] != long[1]
    assert word_hashes(pa.array(["clown, a"]), PLAIN)[0][0] == word_hashes(pa.array(["Clown"]))[0][0]


def test_toxicity_on_held_out_rows(spark):
    got = op1_toxicity(spark, LARGER).toPandas()
    labels = pd.read_parquet(f"{LARGER}/labels.parquet")
    rows = got.merge(labels, on="doc_id")
    held = rows[rows["held_out"]]
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all() and len(got) == 10_000
    assert auc(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.95
    assert (held[held["predicted"] == 1]["toxic"]).mean() > 0.8


def test_toxicity_edges(spark):
    bad, good = ["you clown fool here"] * 60, ["a nice plain day"] * 60
    sample = pd.DataFrame({"text": [x for p in zip(bad, good) for x in p], "lang": ["en", None] * 60, "toxic": [1, 0] * 60})
    model = toxicity.fit(sample, bits=12)
    rows = [(1, None, "en", 5), (2, "", None, 5), (3, "you clown fool here", "en", 5), (4, "a nice plain day", "xx", 5), (4, "a nice plain day", "xx", 5), (5, "a day " * 90_000 + "you clown fool here", "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = toxicity.classify(docs, model).toPandas().sort_values("doc_id")
    assert got["toxic"].tolist() == [False, False, True, False, False, True]
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()) == [1, 2, 4, 4]
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    none = toxicity.fit(sample.iloc[:0], bits=12)
    assert toxicity.classify(docs, none).where("toxic").count() == 0
    assert toxicity.classify(docs.limit(0), model).count() == 0


def test_sample_is_bounded_and_keeps_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "a" * 10, "en"), (1, "b" * 10, "en"), (1, "b" * 10, "en"), (2, "c" * 1000, None), (3, None, "en"), (4, "d", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels)
    assert sorted((r.doc_id, (r.text or "")[:1], r.toxic) for r in got.itertuples()) == [(1, "a", 1), (1, "b", 1), (2, "c", 0), (3, "", 0)]
    small = toxicity.labelled_sample(docs, labels, most_bytes=100)
    assert sum(len(t or "") for t in small["text"]) <= 100 and len(toxicity.labelled_sample(docs, labels, most_rows=1)) == 1
    assert len(toxicity.labelled_sample(docs.limit(0), labels)) == 0


def test_pooling_in_pieces_is_the_same():
    rng = np.random.default_rng(0)
    sample = pd.DataFrame({"text": ["x y z"] * 40 + ["p q r"] * 40, "lang": ["en"] * 80, "toxic": [1] * 40 + [0] * 40})
    model = toxicity.fit(sample, bits=10)
    h = rng.integers(0, 1 << 62, (500, 1 + len(toxicity.PREFIXES)), dtype=np.uint64)
    counts = np.array([0, 0, 1, 3, 120, 500])
    whole = model.pooled(h, counts)
    old, toxicity.CHUNK_WORDS = toxicity.CHUNK_WORDS, 16
    try:
        assert np.allclose(model.pooled(h, counts), whole, atol=1e-6)
    finally:
        toxicity.CHUNK_WORDS = old


def plain_spans(text):
    out = []
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    out += [("email", *m.span()) for m in email.finditer(text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        s = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


NASTY = [
    "a@b.c@d.e x@y", "@x.y a..b@c.d.e-", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (499) 555-6503, +12 +4 5", "é😀 a%b+c@d.e 9@9.9",
    "41111111111111111111111111", "x" * 50_000 + "@a.b", "1" * 5000, "0000.0.0.0 0255.1.1.1",
]


def test_base_spans():
    for t in [*NASTY, " ".join(NASTY)]:
        assert pii.base_spans(t) == plain_spans(t), t[:60]


def training():
    phones = [f"call +1 (499) 555-65{i:02d} or mail me{i}@x.com; again (499) 555-65{i:02d} or 17 of 2024" for i in range(40)]
    cards = [f"pay by 4111 1111 1111 1111 then, in {i} days, 4111.1111.1111.1111 or +44 20 7946 09{i:02d} and 20 7946 09{i:02d}" for i in range(10, 40)]
    return phones * 3 + cards + ["in 2024 we saw 300 birds and 41 cats"] * 30


def added(field, t):
    return [(k, t[a:b]) for k, a, b in field.added(t, pii.base_spans(t))]


def test_field_finds_what_patterns_miss():
    field = pii.Field(pii.statistics(training()))
    for t, want in (
        ("ring +1 (212) 555-0199 soon. Later: 555-0199 is right, 2024 too", [("phone", "555-0199")]),  # the same again
        ("ring +44 20 7946 0958 soon. As was said: 20 7946 0958 is right, 2024 too", [("phone", "20 7946 0958")]),
        ("paid by 4111 1111 1111 1111 soon. As was said: 4111.1111.1111.1111 is right, 2024 too", [("card", "4111.1111.1111.1111")]),
        ("ring +1 (212) 555-0199 soon. Later: 212.555.0199 it is", [("phone", "212.555.0199")]),  # the same last digits
        ("call (499) 555-6511 now, there is no plus", [("phone", "499) 555-6511")]),  # no base span at all
        ("no data 2024 and 2024 again 12345 12345", []),
        ("from 10.20.30.400 and 10.20.30.400", []),  # refused by the check
    ):
        assert added(field, t) == want, t
    nothing = pii.Field({})
    assert all(added(nothing, t) == [] for t in ("call (499) 555-6511 now", "in 2024 and 2024"))


def exact(unary, pairs, weight):
    """Marginals by enumeration."""
    n, k = unary.shape
    total = np.zeros((n, k))
    for y in np.ndindex(*[k] * n):
        p = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(w[y[i], y[j]] for (i, j), w in zip(pairs, weight)))
        for i in range(n):
            total[i, y[i]] += p
    return total / total.sum(axis=1, keepdims=True)


def test_marginals_against_enumeration():
    rng, field = np.random.default_rng(2), pii.Field({})
    for pairs, tolerance in (([], 1e-9), ([(0, 1), (1, 2), (2, 3)], 1e-4), ([(0, 1), (0, 3), (1, 2), (3, 4)], 1e-4), ([(0, 1), (1, 2), (2, 3), (0, 3)], 0.06)):
        n = 5 if len(pairs) == 4 and (3, 4) in pairs else 4
        unary = rng.normal(0, 1, (n, len(pii.LABELS)))
        weight = [rng.normal(0, 0.5, (len(pii.LABELS),) * 2) for _ in pairs]
        assert np.abs(np.exp(field.marginals(unary, pairs, weight)) - exact(unary, pairs, weight)).max() < tolerance


def test_skip_factors():
    pairs = lambda t: pii.edges(t, pii.tokens(t))
    assert pairs("555-0199 and then 555-0199") == ([], [("same", 0, 1)])
    assert pairs("555-0199 555-0199") == ([(0, 1)], [])
    assert [p[1:] for p in pairs("41 11 22 33 and then 41 11 22 33 and then 41112233")[1]] == [(0, 4), (1, 5), (2, 6), (3, 7), (4, 8), (5, 8), (6, 8), (7, 8)]
    assert len(pairs("12 34 " * 20_000)[1]) == 0
    assert pairs("1-212-555-0199 and then 212-555-0199")[1] == [("tail", 0, 1)]
    assert pairs("me@host7.com and then you@host7.com")[1] == [("part", 0, 1)] and pairs("10.1.2.3 and then 10.1.2.99")[1] == [("part", 0, 1)]
    assert pairs("abcdefg17 and then abcdefgh17")[1] == [("edit", 0, 1)]


def test_statistics_cover_all_texts(spark):
    texts = training()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "no digits"])], "doc_id long, text string").repartition(3)
    a, b = pii.learn(docs), pii.Field(pii.statistics(texts))
    assert np.allclose(a.shape, b.shape) and np.allclose(a.pair, b.pair) and np.allclose(a.cue, b.cue)
    assert np.allclose(pii.learn(docs.limit(0)).pair, pii.Field({}).pair)


def test_redaction(spark):
    rows = [(1, "mail a@b.com now", 1), (2, None, 2), (3, "", 3), (4, "clean text 2024", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int")
    field = pii.Field({})
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs, field).collect()}
    assert got == {1: "mail <EMAIL> now", 2: None, 3: "", 4: "clean text 2024"}
    found = {r["doc_id"]: r for r in pii.find(docs, field).collect()}
    assert [tuple(s) for s in found[1]["base"]] == [("email", 5, 12)] and found[2]["base"] == []
    assert pii.redact(docs.limit(0), field).count() == 0


def test_pii_query(spark):
    got = {r["doc_id"]: r for r in op7_pii(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        spans = [f"{k}:{a}:{b}" for k, a, b in plain_spans(r["text"])]
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(filter(None, g["spans"].split(",")))
        assert [g[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in spans) for k in pii.KINDS]


def brute_fingerprint(text, lexicon):
    """(hash of all terms, {(level, part): 12 bits}) with Python's integers."""
    mask = (1 << 64) - 1

    def mix(h):
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & mask
        return h ^ h >> 31

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    terms = {w: int(word_hashes(pa.array([w]))[0][0]) for w in set(re.findall(r"[^\x20\x09-\x0D]+", low))}
    whole = (mix(sum(mix(t ^ 0x123456789ABCDEF1) | 1 for t in terms.values()) & mask) | 1) if terms else 0
    sums = {}
    for w, t in terms.items():
        if w in lexicon:
            r, k = mix(t ^ 0xA5A55A5A12344321), 0
            while k < fingerprints.LEVELS and r % 4**k == 0:
                sums[k, r >> 32 & 31] = (sums.get((k, r >> 32 & 31), 0) + (mix((t + k + 1) & mask) | 1)) & mask
                k += 1
    return whole, {at: mix(x) % 4095 + 1 for at, x in sums.items()}


def test_fingerprint_query(spark):
    got = {r["doc_id"]: r for r in op6_fingerprints(spark, SMALL).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()), reverse=True)
    assert len(got) == len(rows)
    df = {}
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        for w in set(re.findall(r"[^\x20\x09-\x0D]+", low)):
            df[w] = df.get(w, 0) + 1
    low, high = (len(rows) * np.exp(-x) for x in fingerprints.BAND[::-1])
    lexicon = {w for w, n in df.items() if low <= n <= high}
    assert 0 < len(lexicon) < len(df)
    by_text = {}
    for at, ((i, t), (j, after)) in enumerate(zip(rows, rows[1:] + rows[:1])):
        k, g = len(t) // 2, got[i]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
        own, other, nxt = (fingerprints.parse(x) for x in (g["fingerprint"], g["edited_fingerprint"], got[j]["fingerprint"]))
        assert g["near_edited"] == fingerprints.likeness(own, other)[0] and g["near_next"] == fingerprints.likeness(own, nxt)[0]
        assert by_text.setdefault(t, g["fingerprint"]) == g["fingerprint"]
        if at % 40 == 0:
            for text, found in ((t, own), (t[: len(t) - k] + after[:k], other)):
                whole, sums = brute_fingerprint(text, lexicon)
                assert int(found[0][0]) == whole and {(int(a), int(b)): int(found[1][0, a, b]) for a, b in np.argwhere(found[1][0])} == sums
    near, far = np.array([g["near_edited"] for g in got.values()]), np.array([g["near_next"] for g in got.values()])
    assert near.mean() > far.mean() + 0.2


def test_both_ends_of_the_band(spark):
    """Terms too common and terms too rare are no part of what is compared; the texts' own hash still tells them apart."""
    rows = [(i, f"every half{i % 2} tenth{i % 10} own{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    band = (1.0, 3.0)  # from one of 20 to one of 2.7 documents
    kept = fingerprints.lexicon(docs, band)
    assert sorted(kept.tolist()) == sorted(word_hashes(pa.array([" ".join(f"tenth{i}" for i in range(10))]))[0].tolist())
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_neighbours(docs, spark, band).collect()}
    marks = {i: fingerprints.parse(r["fingerprint"]) for i, r in got.items()}
    assert all(fingerprints.likeness(marks[i], marks[i + 10])[0] == 1.0 and got[i]["fingerprint"] != got[i + 10]["fingerprint"] for i in range(90))
    assert all(fingerprints.likeness(marks[i], marks[i + 1])[0] < 1.0 for i in range(99))


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(4)
    for n in (6, 60, 600, 20_000):
        for share in (0.0, 0.2, 0.5, 0.8, 1.0):
            found = []
            for _ in range(30):
                words = [f"w{x}" for x in rng.integers(0, 1 << 50, 2 * n)]
                common = int(n * share)
                a, b = words[:n], words[:common] + words[n : 2 * n - common]
                kept = np.unique(word_hashes(pa.array([" ".join(words)]))[0])
                p = fingerprints.fingerprints(pa.array([" ".join(a), " ".join(b)]), kept)
                found.append(float(fingerprints.likeness((p[0][:1], p[1][:1]), (p[0][1:], p[1][1:]))[0]))
            assert abs(np.mean(found) - common / (2 * n - common)) < 0.08, (n, share, np.mean(found))


def test_fingerprint_edges(spark):
    least = -(1 << 63)
    rows = [(5, None, 1), (4, "", 1), (3, "one two three", 1), (3, "other words", 1), (None, "last one", 1), (9, "é" * 9, 1), (8, "word " * 40_000, 1), (least, "least of all", 1), (3, "other words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int")
    got = fingerprints.fingerprint_neighbours(docs, spark).toPandas()
    assert len(got) == 9 and got["near_edited"].between(0, 1).all() and set(got["doc_id"].dropna().astype(int)) == {5, 4, 3, 9, 8, least} and got["doc_id"].isna().sum() == 1
    assert (got[got["n_chars"] == 0]["fingerprint"] == "0" * 16).all()
    one = fingerprints.fingerprint_neighbours(docs.where("doc_id = 9"), spark).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.fingerprint_neighbours(docs.limit(0), spark).count() == 0


def test_a_hot_id_is_dealt_to_many_buckets(spark):
    rows = [(7, f"text {i % 400} of the hot one") for i in range(1500)] + [(i, f"text {i}") for i in range(1000, 1600)] + [(None, f"none {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    dealt = fingerprints.neighbours(docs, spark).toPandas()
    hot = dealt[(dealt["id"] == 7) & (dealt["halo"] == 0)]
    assert len(hot) == 1500 and hot["bucket"].nunique() > 3
    got = fingerprints.fingerprint_neighbours(docs, spark).toPandas()
    assert len(got) == len(rows)
    order = dealt[dealt["halo"] == 0].sort_values(["absent", "id", "h"], ascending=[True, False, True])
    import zstandard

    texts = [zstandard.ZstdDecompressor().decompress(x).decode() for x in order["packed"]]
    want = sorted(hashlib.sha256(fingerprints.edited(a, b).encode()).hexdigest() for a, b in zip(texts, texts[1:] + texts[:1]))
    assert sorted(got["edited_sha256"]) == want


def test_document_frequencies_cover_all_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(f"common w{i % 3} x{i}",) for i in range(90)], "text string").repartition(5)
    n = sorted(r["n"] for r in fingerprints.document_frequencies(docs).collect())
    assert n == [1] * 90 + [30] * 3 + [90]
    assert len(fingerprints.lexicon(docs, (0.5, 2.0))) == 3
