"""Memory of the Arrow functions on texts: it follows a piece's size, not the batch's."""

import tracemalloc

import pyarrow as pa
import pytest

from mnemora.functions import text as T

ODD = ["", None, "Ａ  b", "x" * 50, "é" * 30, "ab" * 30 + "\n", "  ", "\U0001f600" * 25, None, "ẞ"]


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 20])
def test_pieces(most):
    for texts in (pa.array(ODD, pa.string()), pa.array(ODD * 3, pa.string()).slice(7, 15), pa.array([], pa.string()), pa.array([None, None], pa.string())):
        parts = list(T.pieces(texts, most))
        assert [x for p in parts for x in p.to_pylist()] == texts.to_pylist()
        assert all(len(p) == 1 or sum(len((x or "").encode()) for x in p.to_pylist()) <= most for p in parts)


@pytest.mark.parametrize("work", ["normalize", "repetition"])
def test_pieces_change_nothing(work, monkeypatch):
    f, texts = getattr(T, work).func, pa.array(ODD * 9, pa.string()).slice(3)
    whole = f(texts)
    monkeypatch.setattr(T, "PIECE_BYTES", 40)
    assert f(texts).to_pylist() == whole.to_pylist() and len(whole) == len(texts) and f(texts.slice(0, 0)).type == whole.type


@pytest.mark.parametrize("work", ["normalize", "repetition"])
def test_memory_of_a_large_batch(work):
    texts = pa.array(["some words of a text " * 100] * 8000)  # 16.8 MB
    getattr(T, work).func(texts.slice(0, 10))
    tracemalloc.start()
    getattr(T, work).func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20, peak


def test_visits_pass_on_few_vectors_at_once(spark, monkeypatch):
    """A query stands in as many rows as it visits buckets; they leave a task in frames of VISIT_BYTES, which no result shows."""
    import numpy as np
    from pyspark.sql import functions as F

    from mnemora.operators import neighbours as N

    rng = np.random.default_rng(3)
    rows = [(i, i % 5, i % 3, [float(x) for x in rng.normal(size=4)], 1) for i in range(60)]
    queries = spark.createDataFrame(rows, "vec_id long, grp long, query_key long, v array<double>, n int").withColumn("floor", F.lit(-np.inf)).coalesce(1)
    pivots = rng.normal(size=(7, 4))
    pick = lambda: sorted((r["vec_id"], r["bucket"]) for r in N.visits(queries, pivots, np.ones(7), np.ones(7), 4, 1, 6).collect())
    whole = pick()
    assert len(whole) == 60 * 5
    frames = []
    monkeypatch.setattr(N, "VISIT_BYTES", 10 * 8 * 4)
    real = type(queries).mapInPandas

    def traced(df, f, schema, **how):
        frames.extend(len(x) for x in f(iter([df.toPandas()])))
        return real(df, f, schema, **how)

    monkeypatch.setattr(type(queries), "mapInPandas", traced)
    N.visits(queries, pivots, np.ones(7), np.ones(7), 4, 1, 6)
    assert sum(frames) == 300 and max(frames) <= 10


def test_freed_memory_goes_back():
    from mnemora.llm.common import give_back

    give_back()
    held = [bytes(1000) for _ in range(10)]
    give_back()
    assert all(len(x) == 1000 for x in held)
