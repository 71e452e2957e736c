"""Katz scores against a dictionary version, and exact normalisation."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mnemora.llm import katz
from mnemora.llm.common import bucket

TEXTS = [
    "a b a b c", "a b c d", None, "", "the cat the cat sat", "the dog sat", "zzz the cat", "a b", "A B", "the cat sat on the mat", "unseen words only", "a", "the the the the", "b\tc\x0bd  e",
] * 3 + ["x " * 500, "cat é 日本"]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</end>"]


class Brute:
    def __init__(self, texts, order=2):
        self.levels = [Counter() for _ in range(order)]
        for t in texts:
            w = ["<start>"] * (order - 1) + words(t)
            for i in range(order - 1, len(w)):
                for k in range(order):
                    self.levels[k][tuple(w[i - k : i + 1])] += 1
        self.uni = Counter({g[0]: c for g, c in self.levels[0].items()})
        self.n = sum(self.uni.values())
        self.context = Counter()
        for level in self.levels[1:]:
            for g, c in level.items():
                self.context[g[:-1]] += c
        self.d = [katz.discounts([sum(x == r for x in level.values()) for r in range(1, 7)]) for level in self.levels]
        left = self.n - sum(self.keep(0, c) for c in self.uni.values())
        self.over = self.n if left > 1e-9 else self.n + 1
        self.open = (left if left > 1e-9 else 1.0) / max(self.over, 1)

    def keep(self, k, c):
        return c * (self.d[k][c] if c <= katz.MOST else 1.0)

    def p(self, w, v):
        """Of w after the tokens v, all that the order takes."""
        if not v:
            return self.keep(0, self.uni[w]) / self.over if self.uni[w] else self.open
        n, k = self.context[v], len(v)
        if not n:
            return self.p(w, v[1:])
        seen = {g[-1]: c for g, c in self.levels[k].items() if g[:-1] == v}
        left = n - sum(self.keep(k, c) for c in seen.values())
        over = n if left > 1e-9 else n + 1
        left = (left if left > 1e-9 else 1.0) / over
        if w in seen:
            return self.keep(k, seen[w]) / over
        return left / (1 - sum(self.p(x, v[1:]) for x in seen)) * self.p(w, v[1:])

    def score(self, text):
        k = len(self.levels) - 1
        w = ["<start>"] * k + words(text)
        return sum(math.log10(self.p(w[i], tuple(w[i - k : i]))) for i in range(k, len(w)))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("katz") / "documents.parquet")
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "a b", "null id")]
    spark.createDataFrame(rows, "doc_id long, text string, train string").repartition(3).write.parquet(path)
    return path


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, stored, order, monkeypatch):
    rows = spark.read.parquet(stored)
    if order == 3:
        rows = rows.repartition(2)  # no files of its own
    got = katz.scores(rows, spark, bucket("doc_id", 7) != 2, order).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))}
    train = [t for i, t in enumerate(TEXTS) if not held[i]] + ["a b"]
    b = Brute(train, order)
    assert len(got) == len(TEXTS) + 1
    for r in got:
        t = "a b" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        w = words(t)
        assert r["held_out"] == (r["doc_id"] is not None and held[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(b.uni[x] > 0 for x in w), b.n)
        base = sum(math.log10((b.uni[x] + 1) / (b.n + len(b.uni) + 1)) for x in w)
        assert r["base_score"] == pytest.approx(base, abs=1e-9)
        assert r["score"] == pytest.approx(b.score(t), abs=1e-9)


def test_probabilities_sum_to_one():
    b = Brute(TEXTS, 3)
    for v in [*b.context, ("never", "seen"), ("the", "seen")]:
        assert sum(b.p(w, v) for w in [*b.uni, "open"]) == pytest.approx(1, abs=1e-9)


def test_chunks_do_not_change_scores(spark, stored):
    rows = spark.read.parquet(stored)
    key = lambda got: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], round(r["score"], 9)) for r in got)
    scored = lambda: key(katz.scores(rows, spark, bucket("doc_id", 7) != 2, 3).collect())
    whole, old = scored(), katz.chunks.__defaults__
    katz.chunks.__defaults__ = (20,)  # what workers get as well: functions travel with their defaults
    try:
        import pyarrow as pa

        b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a b", "c " * 50, None]), pa.array([True, False, True]), pa.array(["s", "s", "t"])], names=["i", "t", "r", "s"])
        made = list(katz.chunks(iter([b, b])))
        assert [len(c.lengths) for c in made] == [2, 1, 2, 1] and sum(c.lengths.sum() for c in made) == 2 * (3 + 51 + 1)
    finally:
        katz.chunks.__defaults__ = old
    assert key(katz.scores(rows.repartition(7), spark, bucket("doc_id", 7) != 2, 3).collect()) == whole


def test_without_training_rows_and_without_rows(spark, stored, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.read.parquet(stored)
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in katz.scores(rows, spark, F.lit(False), 3).collect())
    rows.limit(0).write.parquet(str(tmp_path / "none"))
    assert katz.scores(spark.read.parquet(str(tmp_path / "none")), spark, F.lit(True)).count() == 0


def test_planes_round_trip():
    x = np.array([0, 1, 1 << 40, 7], np.uint64)
    assert (katz.unpack(katz.pack(x)) == x).all() and len(katz.unpack(katz.pack(x[:0]))) == 0
