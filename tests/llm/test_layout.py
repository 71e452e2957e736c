"""The clustered layout against plain loops over all rows and files."""

import zlib

import pytest

from mnemora.llm import layout
from pyspark.sql import functions as F


def plain(rows, levels, file_rows):
    """rows (doc_id, source, lang, text); the same columns as the operator, in sorted order."""
    least = (0, b"")
    text = lambda s: least if s is None else (1, s.encode())
    four = [(text(s), text(g), -1 if t is None else len(t.encode()), zlib.crc32(("" if i is None else str(i)).encode()) % 365) for i, s, g, t in rows]
    n, digits = len(rows), (levels - 1).bit_length()
    cells = [tuple(levels * sum(v[d] < x[d] for v in four) // n for d in range(4)) for x in four]
    z = [sum(((c[d] >> j) & 1) << (4 * j + d) for j in range(digits) for d in range(4)) for c in cells]
    order = sorted(range(n), key=lambda i: (z[i], rows[i][0] is not None, rows[i][0] or 0))
    place = {i: k for k, i in enumerate(order)}
    files = {}
    for i in range(n):
        files.setdefault(place[i] // file_rows, set()).add(cells[i])
    bounds = {f: [(min(c[d] for c in held), max(c[d] for c in held)) for d in range(4)] for f, held in files.items()}
    out = []
    for i in range(n):
        box = [(c - (d > 1), c + (d > 1)) for d, c in enumerate(cells[i])]
        matching = sum(any(all(a <= c[d] <= b for d, (a, b) in enumerate(box)) for c in held) for held in files.values())
        touched = sum(all(low <= b and high >= a for (low, high), (a, b) in zip(bounds[f], box)) for f in files)
        f = place[i] // file_rows
        out.append((str(rows[i][0]), z[i], place[i], f, touched, matching, ",".join(f"{a},{b}" for a, b in bounds[f])))
    return sorted(out)


def told(df):
    return sorted((str(r.doc_id), r.z, r.position, r.file, r.files_touched, r.files_matching, r.file_bounds) for r in df.collect())


@pytest.mark.parametrize("levels,file_rows,fan", [(8, 7, 2), (4, 20, 256), (2, 1, 3)])
def test_layout_against_loops(spark, monkeypatch, levels, file_rows, fan):
    monkeypatch.setattr(layout, "FAN", fan)
    monkeypatch.setattr(layout.tree_sums, "__defaults__", (fan,))
    hot = [(i, "hot", "en", "x" * (i * i % 97)) for i in range(70)]
    rows = hot + [(i, f"s{i % 9}", ["de", "en", "fr", None][i % 4], "é" * (i % 50)) for i in range(70, 150)]
    rows += [(None, None, None, None), (None, "é", "z", ""), (5, "hot", "en", "same"), (5, "hot", "en", "same"), (200, "Z", "", "y" * 9000), (201, "", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumn("z", F.lit("other")).withColumn("length", F.lit(1)).repartition(5)
    assert told(layout.clustered(docs, spark, levels, file_rows)) == plain(rows, levels, file_rows)


def test_equal_rows_one_row_and_no_rows(spark):
    kind = "doc_id long, source string, lang string, text string"
    same = [(1, "a", "b", "c")] * 30
    assert told(layout.clustered(spark.createDataFrame(same, kind), spark, 8, 4)) == plain(same, 8, 4)
    assert told(layout.clustered(spark.createDataFrame(same[:1], kind), spark)) == plain(same[:1], 8, 2000)
    assert told(layout.clustered(spark.createDataFrame([], kind), spark)) == []


def test_sums_in_a_tree(spark):
    got = layout.tree_sums(spark.range(40).where("id % 3 <> 1").selectExpr("id as part", "id + 1 as n"), 40, 3).collect()
    parts = [i for i in range(40) if i % 3 != 1]
    assert dict(got) == {p: sum(q + 1 for q in parts if q < p) for p in parts}
