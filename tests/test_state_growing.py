"""Keyed stream state across restarts, and streams of files that grow."""

import json
from datetime import UTC, datetime, timedelta

import pytest

from mnemora.streaming import growing, state
from mnemora.streaming import journal as S
from pyspark.sql import functions as F

DAY = datetime(2024, 1, 1, tzinfo=UTC)
ROW = "key string, place long, digest string, ok boolean, at timestamp"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    with open(folder / f".{name}", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    (folder / f".{name}").rename(folder / name)


def delivery(key, place, ok, minute, digest="d"):
    return {"key": key, "place": place, "digest": digest, "ok": ok, "at": (DAY + timedelta(minutes=minute)).isoformat()}


def run(spark, src, tmp_path, **how):
    rows = S.tail(spark, str(src), ROW).withWatermark("at", "10 minutes")
    out = S.drain_to_files(state.key_runs(rows, spark, 3600, **how), spark, str(tmp_path / "out"), str(tmp_path / "log"))
    return sorted((r["place"], r["key"], r["action"], r["attempt"]) for r in out.collect())


def test_a_restart_never_repeats_a_valid_key_and_retries_an_invalid_one(spark, tmp_path):
    src = tmp_path / "in"
    put(src, "0.json", [delivery("a", 0, True, 0), delivery("b", 1, False, 1), delivery("b", 2, False, 2)])
    first = [(0, "a", "run", 1), (1, "b", "run", 1), (2, "b", "run", 2)]
    assert run(spark, src, tmp_path) == first
    put(src, "1.json", [delivery("a", 3, True, 3), delivery("b", 4, True, 4), delivery("b", 5, True, 5), delivery("a", 6, True, 6, "other")])
    second = first + [(3, "a", "skip", 1), (4, "b", "run", 3), (5, "b", "skip", 3), (6, "a", "conflict", 1)]
    assert run(spark, src, tmp_path) == second
    # another key's time moves the watermark more than an hour past a and b: they are forgotten
    put(src, "2.json", [delivery("c", 7, True, 200)])
    run(spark, src, tmp_path)
    put(src, "3.json", [delivery("c", 8, True, 201), delivery("a", 9, True, 202)])
    assert run(spark, src, tmp_path)[-3:] == [(7, "c", "run", 1), (8, "c", "skip", 1), (9, "a", "run", 1)]


def test_state_begins_with_an_earlier_journal(spark, tmp_path):
    src = tmp_path / "in"
    journal = spark.createDataFrame([("a", 0, "d", False, DAY), ("a", 1, "d", True, DAY), ("b", 2, "d", False, DAY)], ROW)
    put(src, "0.json", [delivery("a", 3, True, 1), delivery("b", 4, True, 2), delivery("c", 5, False, 3)])
    assert run(spark, src, tmp_path, done=state.journal_state(journal)) == [(3, "a", "skip", 2), (4, "b", "run", 2), (5, "c", "run", 1)]


def test_strict_state_refuses_another_content(spark, tmp_path):
    src = tmp_path / "in"
    put(src, "0.json", [delivery("a", 0, True, 0), delivery("a", 1, True, 1, "other")])
    with pytest.raises(Exception, match="another content"):
        run(spark, src, tmp_path, strict=True)


def test_endpoints_rest_and_wake_by_timer(spark, tmp_path):
    src = tmp_path / "in"

    def drain():
        rows = S.tail(spark, str(src), "endpoint string, at timestamp, place long, kind string, seconds double", 1).withWatermark("at", "1 minute")
        out = S.drain_to_files(state.endpoints(rows, spark), spark, str(tmp_path / "out"), str(tmp_path / "log"))
        return [(r["endpoint"], round(r["at"] - DAY.timestamp(), 3), r["event"], round(r["latency"], 6), r["count"], r["failures"], r["active"], r["until"] and round(r["until"] - DAY.timestamp(), 3)) for r in out.orderBy("endpoint", "at", "event").collect()]

    event = lambda e, s, k, x=0.0: {"endpoint": e, "at": (DAY + timedelta(seconds=s)).isoformat(), "place": s, "kind": k, "seconds": x}
    # the batch holds u's events out of order; they are applied in order of time
    put(src, "0.json", [event("u", 20, "failure"), event("u", 10, "acquire"), event("u", 5, "acquire"), event("v", 1, "success", 10.0)])
    assert drain() == []
    put(src, "1.json", [event("w", 100, "acquire")])
    got = drain()
    assert got == [("u", 5.0, "acquire", 30.0, 0, 0, 1, 0.0), ("u", 10.0, "acquire", 30.0, 0, 0, 2, 0.0), ("u", 20.0, "failure", 90.0, 1, 1, 1, 140.0), ("v", 1.0, "success", 26.0, 1, 0, 0, 0.0)]
    put(src, "2.json", [event("w", 300, "success", 30.0)])  # nothing of u: a timer ends its rest
    got = drain()
    assert ("u", 140.0, "rested", 90.0, 1, 1, 1, 0.0) in got and ("w", 100.0, "acquire", 30.0, 0, 0, 1, 0.0) in got
    put(src, "3.json", [event("u", 301, "success", 40.0), event("w", 500, "acquire")])
    got = drain()
    assert ("u", 301.0, "success", 80.0, 2, 0, 0, 0.0) in got and len(got) == 8


def lines(spark, path, tmp_path, name, **options):
    q = growing.growing_lines(spark, str(path), **options)
    return sorted((r["file"].rsplit("/", 1)[-1], r["at"], r["value"]) for r in S.drain_to_files(q, spark, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-log")).collect())


def test_growing_files_give_whole_lines_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_text("one\ntwo\nthr")
    (folder / "_hidden").write_text("no\n")
    assert lines(spark, folder, tmp_path, "x") == [("a", 0, "one"), ("a", 4, "two")]
    with open(folder / "a", "a") as f:
        f.write("ee\n\nfünf\r\n")
    (folder / "b").write_text("x\n")
    want = [("a", 0, "one"), ("a", 4, "two"), ("a", 8, "three"), ("a", 14, ""), ("a", 15, "fünf"), ("b", 0, "x")]
    assert lines(spark, folder, tmp_path, "x") == want == lines(spark, folder, tmp_path, "fresh")
    assert lines(spark, folder, tmp_path, "none") == want and lines(spark, tmp_path / "absent", tmp_path, "absent") == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_ranges_of_any_size_give_each_line_once(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(growing, "STEP", 5)
    text = "a\n\nbb\nccc ccc ccc\n\n\nd\r\nlast\n"
    (tmp_path / "f").write_text(text)
    reader = growing.GrowingReader({"path": str(tmp_path), "range": str(size)})
    parts = reader.partitions({}, reader.latestOffset())
    got = [(r["at"], r["value"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    places = [0]
    for line in text.split("\n")[:-2]:
        places.append(places[-1] + len(line) + 1)
    assert sorted(got) == list(zip(places, [x.removesuffix("\r") for x in text.split("\n")[:-1]]))


@pytest.mark.parametrize("change,error", [("shorten", "shortened"), ("replace", "replaced"), ("rewrite", "replaced"), ("remove", "gone"), ("more", "more than 2")])
def test_changed_input_is_refused_after_a_restart(spark, tmp_path, change, error):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_text("one\ntwo\n")
    (folder / "b").write_text("x\n")
    assert len(lines(spark, folder, tmp_path, "x", mostfiles=2)) == 3
    {"shorten": lambda: (folder / "a").write_text("one\n"), "replace": lambda: (folder / "a").write_text("eins\nzwei\ndrei\n"), "rewrite": lambda: (folder / "a").write_text("one\ntwO\nmore\n"),
     "remove": lambda: (folder / "a").unlink(), "more": lambda: (folder / "c").write_text("y\n")}[change]()
    with pytest.raises(Exception, match=error):
        lines(spark, folder, tmp_path, "x", mostfiles=2)


def test_grown_lines_meet_keyed_state(spark, tmp_path):
    """A journal that grows while its reader is restarted: no valid key runs again."""
    file = tmp_path / "journal"

    def drain():
        rows = growing.growing_lines(spark, str(file)).select(F.from_json("value", ROW).alias("r")).select("r.*").withWatermark("at", "10 minutes")
        out = S.drain_to_files(state.key_runs(rows, spark, 3600), spark, str(tmp_path / "out"), str(tmp_path / "log"))
        return sorted((r["place"], r["action"]) for r in out.collect())

    text = [json.dumps(delivery("a", i, i > 0, i)) + "\n" for i in range(3)]
    file.write_text(text[0] + text[1] + text[2][:9])
    assert drain() == [(0, "run"), (1, "run")]
    file.write_text("".join(text))
    assert drain() == [(0, "run"), (1, "run"), (2, "skip")]
