"""Fill-in-middle against plain regular expressions, the automaton scan against a byte-by-byte loop."""

import hashlib
import re

import numpy as np
import pytest

from mnemora.llm import infill

A, B = "a" * 3000, "é\nß" * 900
TEXTS = [None, "", "\n", "\n\n\n", "one", "one\n", "one\ntwo", "é\nßß\n\n" * 3, A, A + "\n" + A, B, "x\n" * 2000, "has <P> inside\nline", "<S>", "a<M>\nb", "\r\n \r", "\U0001f600\n" * 700, "tail\n" * 511 + "t" * 5, "😀" * 2000]


def parts(text, key, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("span_bytes", [64 << 10, 100])
def test_every_text_is_cut_as_the_expression_cuts_it(spark, span_bytes):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(None, "null\nid\n"), (3, "again\nagain\n" * 200), (3, "again\nagain\n" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    done = infill.fill_in_middle(docs, spark, span_bytes=span_bytes)
    got = done.withColumn("back", infill.restore(done["output"], done["form"])).collect()
    want = sorted((str(k), str(t), *map(str, parts(t, k)), t or "") for k, t in rows)
    assert sorted((str(r.doc_id), str(r.text), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.back) for r in got) == want
    assert {"psm", "spm", "plain"} == {r.form for r in got}


def test_spans_of_a_long_text(spark, monkeypatch):
    """Cuts far inside a text of many spans, with characters cut by chunk and span borders."""
    monkeypatch.setattr(infill, "SPAN", 777)
    text = "".join(f"zeile {i} äöü 😀\n" * (1 + i % 3) for i in range(900))
    rows = [(i, text[i:]) for i in range(6)] + [(7, "z" * 5000), (8, "\n" * 5000)]
    got = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), spark, span_bytes=777).collect()
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == sorted((k, *parts(t, k)) for k, t in rows)


def test_rates_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a\nb\n", "kept", 5, "row"), (2, None, None, None, None)], "doc_id long, text string, output string, n long, _row string")
    got = sorted(infill.fill_in_middle(docs, spark, rate=0).collect())
    assert [(r.form, r.output, r.n, r._row) for r in got] == [("plain", "a\nb\n", 2, "row"), ("plain", "", 0, None)]
    assert infill.fill_in_middle(docs, spark, rate=100, spm_rate=100).where("doc_id = 1").first().form == "spm"
    assert infill.fill_in_middle(docs.limit(0), spark).collect() == []


#: Words: 0 between words before the first letter, 1 in a word, 2 after a word's first blank; a unit is a word with its blanks' first one.
WORDS = infill.Automaton.of({32: 0, 10: 0}, [[0, 2, 2], [1, 1, 1]], [[0, 1, 0], [0, 0, 0]], [0, 1, 0])


@pytest.mark.parametrize("seed", range(4))
def test_scan_of_an_automaton_with_three_states(seed, monkeypatch):
    """Any automaton, chunks of any size: counts and cuts are those of one walk over the bytes."""
    monkeypatch.setattr(infill, "CHUNK", 5 + seed)
    monkeypatch.setattr(infill, "TOGETHER", 3)
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("ab  é\n"), size=rng.integers(0, 60))) for _ in range(40)] + ["", " ", "a"]
    raw = [t.encode() for t in texts]
    size = np.array([len(b) for b in raw])
    h1, h2 = rng.integers(0, 2**32, len(raw)), rng.integers(0, 2**32, len(raw))
    n, x, y = infill.cuts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size, h1, h2, WORDS)
    for i, b in enumerate(raw):
        state, at = 0, []
        for j, byte in enumerate(b):
            k = WORDS.kinds[byte]
            if WORDS.ends[k, state]:
                at.append(len(b[: j + 1].decode()))
            state = WORDS.follow[k, state]
        total = len(at) + WORDS.open[state]
        assert n[i] == total
        for want, got in zip(sorted((h1[i] % (total + 1), h2[i] % (total + 1))), (x[i], y[i])):
            assert got == (0 if want == 0 else at[want - 1] if want <= len(at) else len(texts[i]))
