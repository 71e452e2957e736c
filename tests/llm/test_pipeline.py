"""The pipeline's stages on a small table, and the whole of it against plain loops."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mnemora.llm import pii, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def clean_rows(spark, docs, sf):
    """Rows whose score, taken alone, stays under their language's threshold."""
    model = toxicity.fit(toxicity.labelled_sample(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    score = lambda t: float(model.score(*toxicity.hashed(pa.array([t], pa.string())))[0])
    return [r for r in docs.collect() if score(r["text"]) < model.thresholds.get(r["lang"], model.threshold)]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(rows):
    """The row of the smallest doc_id of each group that pairs of similarity 0.8 connect; all pairs are compared."""
    sets, head = [shingle_set(r["text"]) for r in rows], list(range(len(rows)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                head[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        best[root(i)] = min(best.get(root(i), r), r, key=lambda x: x["doc_id"])
    return list(best.values())


def redacted(text, field):
    """Characters under spans go, the kind of the span that begins first stands for a run of touching ones."""
    base = pii.base_spans(text)
    out, spans, i = "", sorted(base + field.added(text, base), key=lambda s: (s[1], -s[2], s[0])), 0
    while i < len(text):
        own = [s for s in spans if s[1] == i]
        if not own:
            out, i = out + text[i], i + 1
            continue
        end = own[0][2]
        while more := [s[2] for s in spans if s[1] < end < s[2]]:
            end = max(more)
        out, i = out + f"<{own[0][0].upper()}>", end
    return out


def test_run_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = one_of_each(clean_rows(spark, docs, small))
    assert len({r["doc_id"] for r in rows}) == len(rows) < docs.count()
    field = pii.learn(spark.createDataFrame(rows, docs.schema))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {r["doc_id"]: np.array(library.encode(redacted(r["text"] or "", field), add_special_tokens=False).ids + [1], "<u4") for r in rows}
    assert any(redacted(r["text"] or "", field) != (r["text"] or "") for r in rows)
    pieces, sequences = corpus_pipeline.run(spark, small).collect(), {}
    assert {p["doc_id"] for p in pieces} == wanted.keys()
    at = dict.fromkeys(wanted, 0)
    for p in sorted(pieces, key=lambda p: p["start"]):
        d, n = p["doc_id"], p["length"]
        assert p["start"] == at[d] and p["doc_tokens"] == len(wanted[d]) and p["ids_crc32"] == zlib.crc32(wanted[d][at[d] : at[d] + n].tobytes())
        at[d] += n
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], n))
    assert at == {d: len(x) for d, x in wanted.items()}
    for s in sequences.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= 2048 and end & (end - 1) == 0


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        docs = out
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0.7 * counts[0]
    texts = [r["text"] for r in docs.collect()]
    assert not any(re.search(r"[A-Za-z0-9]@[a-z0-9]+\.example\.com", t) for t in texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_near_duplicates_keep_one_of_each(spark):
    text = "these are the words of a text that was copied"
    rows = [(4, text, "en", "s", 1), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (9, "something else altogether stands in this one", "en", "s", 1), (None, text, "en", "s", 1), (2, "another text under the id of the copy", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"], r["text"][:4]) for r in got.collect()) == [(2, "anot"), (2, "thes"), (9, "some")]
    assert got.columns == docs.columns
