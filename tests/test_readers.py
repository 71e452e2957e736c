"""The neighbour reader's bounds, folds in one pass, JSON arrays in splits, published tables, batch normalisation."""

import json
import unicodedata

import numpy as np
import pytest

from mnemora.functions import text as T
from mnemora.operators import neighbours as N
from mnemora.operators import readout as O
from mnemora.operators import records as R
from mnemora.operators import validate as X
from mnemora.sources import arrays, io
from pyspark.sql import functions as F

KIND = "vec_id long, grp long, query_key long, layers array<array<double>>, value double"


def brute(queries, references, k):
    unit = lambda r: np.concatenate([np.array(v) / max(np.linalg.norm(v), 1e-6) for v in r[3]])
    want = {}
    for i, g, q, layers, _ in queries:
        best = {}
        for r in references:
            if g != r[1] and q != r[2]:
                s = (round(float(unit((0, 0, 0, layers)) @ unit(r)) / len(layers), 9), -r[0], r[4])
                best[r[1]] = max(best.get(r[1], s), s)
        top = sorted(best.values(), reverse=True)[:k]
        if top:
            w = np.exp((np.array([t[0] for t in top]) - top[0][0]) / 0.1)
            want[i] = (round(float((w * [t[2] for t in top]).sum() / w.sum()), 6), len(top))
    return want


def told(df):
    return {r["vec_id"]: (round(r["value"], 6), r["effective_k"]) for r in df.collect()}


def clustered(n, seed, spread=0.02, clusters=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (clusters, 2, 6))
    return [(i, int(rng.integers(30)), int(rng.integers(9)), (centers[i % clusters] + spread * rng.normal(0, 1, (2, 6))).tolist(), float(rng.integers(3) - 1)) for i in range(n)]


def test_bounds_skip_buckets_and_lose_nothing(spark):
    rows, asked = clustered(600, 1), clustered(90, 2)
    df, q = spark.createDataFrame(rows, KIND), spark.createDataFrame(asked, KIND)
    trace: list[int] = []
    got = told(N.nearest(q, df, 3, 0.1, strict=False, block_bytes=12 * 8 * 20, growth=2, trace=trace))
    assert got == brute(asked, rows, 3)
    assert len(trace) > 2 and sum(trace) < 90 * 24 / 2  # 24 pivots; a visit of all buckets would be 90 * 24
    trace.clear()
    assert told(N.nearest(q, df, 3, 0.1, strict=False, trace=trace)) == got and trace == [90]


def test_equal_references_fill_one_bucket_in_parts(spark):
    """A third of all references in one place, zero vectors, and ties that go to the smaller id."""
    rows = [(i, i % 7, i % 5, [[1.0, 0.0], [0.0, 1.0]], float(i % 3)) for i in range(80)] + [(100 + i, i % 7, i % 5, [[0.0, 0.0], [float(i), 1.0]], 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, KIND)
    for size in (12 * 8, 1000):
        assert told(N.nearest(df, df, 4, 0.1, block_bytes=size)) == brute(rows, rows, 4)
    assert N.nearest(df, df.limit(0), 3, 0.1, strict=False).collect() == []
    assert N.nearest(df.limit(0), df, 3, 0.1).collect() == []
    bad = df.withColumn("layers", F.transform("layers", lambda v: F.transform(v, lambda x: F.when(F.col("vec_id") == 5, float("nan")).otherwise(x))))
    for a, b in ((bad, df), (df, bad)):
        with pytest.raises(Exception, match="finite"):
            N.nearest(a, b, 1, 0.1, strict=False).collect()
    with pytest.raises(Exception, match="shape"):
        N.nearest(df.withColumn("layers", F.slice("layers", 1, 1)), df, 1, 0.1, strict=False).collect()


def test_plan_has_no_gathered_references(spark):
    import inspect

    source = inspect.getsource(N)
    assert "toPandas" not in source and "crossJoin" not in source


@pytest.mark.parametrize("fold_bytes", [O.FOLD_BYTES, 200])
def test_folds_in_one_pass_or_several(spark, fold_bytes):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, int(rng.integers(3)), int(rng.integers(2)), f"g{rng.integers(6)}", rng.normal(0, 1, 5).tolist()) for i in range(80)] + [(90, 0, 1, 0, "alone", [1.0, 0.0, 0.0, 0.0, 0.0]), (91, 7, 0, 0, "only", [1.0, 2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, layer long, cls long, regime long, grp string, v array<double>").repartition(3)
    got = {r["vec_id"]: (r["fold"], r["prediction"]) for r in O.leave_group_out(df, fold_bytes=fold_bytes).collect()}
    want = {}
    for i, layer, _, regime, grp, v in rows:
        rest = [r for r in rows if r[1] == layer and r[4] != grp]
        if not rest:
            continue
        center = np.mean([r[5] for r in rest], axis=0)
        unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
        means = {}
        for c in {r[2] for r in rest if r[3] == regime}:
            means[c] = unit(np.mean([unit(np.array(r[5]) - center) for r in rest if r[2] == c and r[3] == regime], axis=0))
        if means:
            want[i] = (grp, min(means, key=lambda c: (-round(float(unit(np.array(v) - center) @ means[c]), 9), c)))
    assert got == want
    plan = O.leave_group_out(df)._jdf.queryExecution().executedPlan().toString()
    assert "array_except" not in plan


TEXTS = ["plain", 'quote " and \\" and \\\\', "commas, [brackets], {braces}", "line\nbreak", "ünï 😀", "", 'ends with \\', "],[", '{"a":1}']


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_arrays_in_splits(spark, tmp_path, size):
    rows = [{"id": i, "text": TEXTS[i % len(TEXTS)] * (i % 4), "more": [{"x": [i, None]}] * (i % 3)} for i in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(rows[:1] + [{"id": 99, "text": None}]))
    (tmp_path / "c.json").write_text(" [ ] \n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        schema = "id long, text string, more array<struct<x:array<long>>>"
        if size == 64:
            assert arrays.pieces(spark, str(tmp_path / "a.json")).rdd.getNumPartitions() > 20
        got = [(r["id"], r["text"], [m["x"] for m in r["more"] or []]) for r in io.read_json(spark, str(tmp_path), schema).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(r["id"], r["text"], [m["x"] for m in r.get("more", [])]) for r in rows + rows[:1] + [{"id": 99, "text": None}]]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("few", [100_000, 0])
def test_fields_of_an_object_in_splits(spark, tmp_path, few, monkeypatch):
    monkeypatch.setattr(arrays, "MOST_SPLITS", few)
    rows = [{"q": TEXTS[i % len(TEXTS)], "n": i} for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps({"note": "x, [y] \"z\":", "other": [{"q": "no", "n": -1}, {"q": "no", "n": -2}], "n": 5, "meta": {"a": 1, "b": [2, 3]}, "kind": rows[:30], "last": []}))
    (tmp_path / "b.json").write_text(json.dumps({"kind": rows[30:]}, indent=2))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        got = arrays.read_field(spark, str(tmp_path), "kind", "struct<q:string,n:long>").orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["pos"], r["r"]["q"], r["r"]["n"]) for r in got] == [(i, r["q"], r["n"]) for i, r in enumerate(rows)]


def test_broken_elements_are_an_error_and_arrays_can_be_written(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"id": 1}, {"id": ]')
    with pytest.raises(Exception):  # noqa: B017
        io.read_json(spark, str(tmp_path / "x.json"), "id long").collect()
    arrays.write_array(spark.range(10).repartition(2), str(tmp_path / "out"))
    assert sorted(x["id"] for f in (tmp_path / "out").glob("part*") for x in json.loads(f.read_text())) == list(range(10))


def test_publish_swaps_a_pointer(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        io.read_published(spark, path)
    io.publish(spark.range(3), path, spark)
    reader = io.read_published(spark, path)
    io.publish(spark.range(5), path, spark)
    assert (reader.count(), io.read_published(spark, path).count()) == (3, 5)
    with pytest.raises(Exception, match="boom"):  # a write that fails leaves the rows as they were
        io.publish(spark.range(1).select(F.raise_error(F.lit("boom")).cast("long").alias("id")), path, spark)
    assert io.read_published(spark, path).count() == 5
    (tmp_path / "t" / "_pointers" / "0000000003").write_text("")  # of a writer that died before it wrote the name
    assert io.read_published(spark, path).count() == 5
    io.publish(spark.range(7), path, spark)
    assert io.read_published(spark, path).count() == 7 and [n for n, _ in io.versions(spark, path)] == [2, 4]


def test_of_two_writers_one_gets_an_error(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    io.publish(spark.range(3), path, spark)
    monkeypatch.setattr(io, "_numbers", lambda *_: [])
    monkeypatch.setattr(io, "versions", lambda *_: [])
    with pytest.raises(OSError, match="another writer"):
        io.publish(spark.range(9), path, spark)
    monkeypatch.undo()
    assert io.read_published(spark, path).count() == 3


class Failing:
    """A file system whose renames to or from the named paths fail."""

    def __init__(self, fs, bad):
        self.fs, self.bad = fs, bad

    def rename(self, a, b):
        return False if self.bad(a.toString(), b.toString()) else self.fs.rename(a, b)

    def __getattr__(self, name):
        return getattr(self.fs, name)


def test_replace_loses_nothing_when_a_rename_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    io.replace(spark.range(3), path, spark)
    real = io._hadoop
    for bad in (lambda a, b: a == path, lambda a, b: b == path and a.count(".") and not moved.append(a) and len(moved) == 1):
        moved: list = []
        monkeypatch.setattr(io, "_hadoop", lambda s, p, bad=bad: (Failing(real(s, p)[0], bad), real(s, p)[1]))
        with pytest.raises(OSError):
            io.replace(spark.range(9), path, spark)
        monkeypatch.undo()
        assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_dead_drivers_lock_is_taken_over(spark, tmp_path):
    folder = tmp_path / "cache"
    folder.mkdir()
    lock = folder / f"{io.contract_digest({'m': 1})}.lock"
    lock.write_text('{"owner": "app-1"}')
    with pytest.raises(OSError, match="app-1"):
        io.cached(spark, str(folder), {"m": 1}, lambda: spark.range(2))
    assert io.cached(spark, str(folder), {"m": 1}, lambda: spark.range(2), stale=0).count() == 2 and not lock.exists()


def test_missing_journal_has_no_finished_rows(spark, tmp_path):
    assert io.read_done(spark, str(tmp_path / "none")).collect() == []


def test_normalize_equals_the_plain_form(spark):
    odd = ["Ｆｏｏ　Straße", " a\t\n b ", None, "", "ﬁ Ⅷ ½ İ ς Σ", "İx", "é é", "\x1c a \x85 b  ", "\U000f0000 private \U000f0001", "K", "가", "á̧", " ", "ß" * 500]
    odd += ["".join(map(chr, range(i, i + 400))) for i in range(0x20, 0xD400, 400)]
    plain = [None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in odd]
    got = spark.createDataFrame(list(enumerate(odd)), "i int, t string").coalesce(1).select("i", T.normalize("t").alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == plain


def test_keys_fold_width_and_sharp_s_and_refuse_odd_memories(spark):
    kind = "sample_id string, query string, memories array<struct<memory_id:string,memory_text:string>>, source string"
    rows = [("1", "Ｓtraße  X", [("m", "t")], "x"), ("2", "STRASSE x", [("m", "t"), ("n", "t")], "x")]
    keyed = R.keyed_items(spark.createDataFrame(rows, kind), F.lit("g"), spark.createDataFrame([], "group_id string"))
    assert {r["query_key"] for r in keyed.collect()} == {"strasse x"} and keyed.count() == 3
    for wrong in ([], [("m", "a"), ("m", "b")]):
        with pytest.raises(Exception, match="memory ids"):
            R.keyed_items(spark.createDataFrame([("3", "q", wrong, "x")], kind), F.lit("g"), spark.createDataFrame([], "group_id string")).collect()


def test_calibration_names_samples_and_ids(spark):
    rows = spark.createDataFrame([("a", "calibration", 1), ("b", "heldout", 2), ("b", "heldout", 2), *[(x, "heldout", 3 + i) for i, x in enumerate("cdefg")]], "g string, s string, id long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    found = lambda chosen: sorted((r["constraint"], r["key"]) for r in X.calibration(rows, "g", "s", 0.2, "id", chosen).collect())
    assert found(ids(1)) == [("duplicate_sample", "2")]
    assert found(ids(3, 99)) == [("duplicate_sample", "2"), ("missing_calibration", "99"), ("not_chosen", "1"), ("not_in_calibration", "3")]
    assert found(ids()) == [("duplicate_sample", "2"), ("no_calibration", "all"), ("not_chosen", "1")]
