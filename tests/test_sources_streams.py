"""Readers, writers and streams over small files."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from mnemora.sources import io
from mnemora.streaming import journal as S

ROWS = [{"source": "s", "sample_id": str(i), "query": "q x", "context": "", "memories": [{"memory_id": "m", "memory_text": "t", "gold_policy": "ignore", "gold_score": 0.0}]} for i in range(3)]


def test_json_lines_arrays_gzip_and_empty(spark, tmp_path):
    lines = "\n".join(json.dumps(r, ensure_ascii=False) for r in ROWS) + "\n\n"
    (tmp_path / "a.jsonl").write_text(lines)
    (tmp_path / "b.json").write_text(json.dumps(ROWS, indent=1))
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write(lines)
    (tmp_path / "d.jsonl").write_text("")
    assert [io.read_json(spark, str(tmp_path / n), io.SAMPLE).count() for n in ("a.jsonl", "b.json", "c.jsonl.gz", "d.jsonl")] == [3, 3, 3, 0]
    (tmp_path / "e.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):  # noqa: B017
        io.read_json(spark, str(tmp_path / "e.jsonl"), io.SAMPLE).collect()


def test_tolerant_scan_and_journal(spark, tmp_path):
    (tmp_path / "done.jsonl").write_text('{"uid": "a"}\n\n{"uid": "b"}\n{"uid": "a"}\n{"uid": "c')
    assert sorted(r["uid"] for r in io.read_done(spark, str(tmp_path / "done.jsonl")).collect()) == ["a", "b"]
    (tmp_path / "j.jsonl").write_text('{"key": "k1", "status": "ok"}\n{"key": "k2", "status": "error"}\n{"key": "k3", "_journal_recovery": true}\n{"key": "k4"')
    rows = io.read_journal(spark, str(tmp_path / "j.jsonl"), spark.createDataFrame([(2,)], "line int"))
    assert [(r["line"], r["key"]) for r in rows.collect()] == [(1, "k1")]
    assert [r["line"] for r in io.torn_lines(spark, str(tmp_path / "j.jsonl")).collect()] == [4]
    assert io.read_journal(spark, str(tmp_path / "j.jsonl"), strict=True).count() == 2
    (tmp_path / "k.jsonl").write_text('{"key": "k1"}\n{broken\n{"key": "k3"}\n')
    with pytest.raises(Exception, match="broken line"):
        io.read_journal(spark, str(tmp_path / "k.jsonl"), strict=True).collect()
    both = str(tmp_path / "[jk].jsonl")
    with pytest.raises(ValueError, match="file's name"):
        io.read_journal(spark, both, spark.createDataFrame([(1,)], "line int"))
    named = io.numbered_lines(spark, both).where("file like '%k.jsonl' and line = 1").select("file", "line")
    assert sorted(r["key"] for r in io.read_journal(spark, both, named).collect()) == ["k1", "k2", "k3"]


def test_line_numbers_over_splits(spark, tmp_path):
    lines = ["" if i % 7 == 0 else f"line {i} " + "x" * (i % 50) for i in range(1, 3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("only\n\nlast")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = io.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["line"], r["value"]) for r in got if r["file"].endswith("a.txt")) == [(i, t) for i, t in enumerate(lines, 1) if t]
    assert sorted((r["line"], r["value"]) for r in got if r["file"].endswith("b.txt")) == [(1, "only"), (3, "last")]


def test_predictions_benchmark_and_pool(spark, tmp_path):
    flat = spark.createDataFrame([("s", "a", "ignore"), ("s", "b", "support")], "sample_id string, memory_id string, policy string")
    nested = spark.createDataFrame([("s", [("a", "dominate")])], "sample_id string, predictions array<struct<memory_id:string,policy:string>>")
    assert {r["uid"]: r["policy"] for r in io.read_predictions(flat, nested).collect()} == {"s::a": "dominate", "s::b": "support"}
    (tmp_path / "b.json").write_text(json.dumps({"single": [{"q": "x"}, {"q": "y"}]}))
    got = io.read_benchmark(spark, str(tmp_path / "b.json"), "struct<q:string>", "single").collect()
    assert [(r["sample_id"], r["q"]) for r in got] == [("single_0000", "x"), ("single_0001", "y")]
    own = spark.createDataFrame([(1, ["a", " "]), (2, [" "])], "level int, instructions array<string>")
    other = spark.createDataFrame([(1, ["z"]), (2, ["z"]), (3, ["z"])], "level int, instructions array<string>")
    assert {r["level"]: r["instructions"] for r in io.instruction_pool(own, other).collect()} == {1: ["a"], 2: ["z"], 3: ["z"]}


def test_write_once_cache_and_resume(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "once")
    assert io.write_once(df, path, spark) is True and io.write_once(df.repartition(3), path, spark) is False
    with pytest.raises(ValueError, match="other rows"):
        io.write_once(spark.range(6), path, spark)
    calls = []
    make = lambda: calls.append(1) or spark.range(2)
    for _ in range(2):
        assert io.cached(spark, str(tmp_path / "cache"), {"model": "m", "n": 1}, make).count() == 2
    assert calls == [1]
    (tmp_path / "cache" / f"{io.contract_digest({'m': 2})}.lock").write_text("")
    with pytest.raises(Exception):  # noqa: B017  another writer is at work
        io.cached(spark, str(tmp_path / "cache"), {"m": 2}, make)
    io.require_contract(spark, str(tmp_path / "run"), {"a": 1})
    io.require_contract(spark, str(tmp_path / "run"), {"a": 1})
    with pytest.raises(ValueError, match="other rows"):
        io.require_contract(spark, str(tmp_path / "run"), {"a": 2})
    for n in (3, 2):
        io.replace(spark.range(n), str(tmp_path / "put"), spark)
    assert spark.read.parquet(str(tmp_path / "put")).count() == 2 and [p.name for p in tmp_path.iterdir() if p.name.startswith("put")] == ["put"]
    for n in (2, 5):
        assert io.resume(spark.range(n), spark, str(tmp_path / "resume"), "id", lambda t: t.withColumn("x", F.lit(1))).count() == n
    io.append_json(spark.range(1), str(tmp_path / "app"))
    io.append_json(spark.range(1), str(tmp_path / "app"))
    assert spark.read.json(str(tmp_path / "app")).count() == 2


def test_stream_conflicts_and_state_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate([[("a", "h1"), ("b", "h1")], [("a", "h1")], [("b", "h2")]]):
        (src / f"{i}.json").write_text("".join(json.dumps({"k": k, "d": d, "o": i, "status": "ok" if d == "h1" else "error", "v": i}) + "\n" for k, d in rows))
    tail = S.tail(spark, str(src), "k string, d string, o long, status string, v double", 1)
    out = S.update_batches(S.check_redelivery(tail, "k", "d"), spark, str(tmp_path / "out"), str(tmp_path / "log"))
    last = {r["key"]: r["x"] for r in out.groupBy("key").agg(F.max_by(F.struct("deliveries", "conflict"), "batch").alias("x")).collect()}
    assert (last["a"]["deliveries"], last["a"]["conflict"]) == (2, False) and (last["b"]["deliveries"], last["b"]["conflict"]) == (2, True)
    tail = S.tail(spark, str(src), "k string, d string, o long, status string, v double", 1)
    state = {r["k"]: r for r in S.drain_complete(S.key_state(tail, "k", "o", "status", "v"), spark, str(tmp_path / "out2"), str(tmp_path / "log2")).collect()}
    assert state["b"]["latest_status"] == "error" and state["b"]["valid_value"] == 0.0 and state["b"]["invalid"] == 1


def test_dispatch_restarts_where_it_was(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    (src / "0.json").write_text('{"k": "a"}\n')

    def call(frames):
        yield from frames

    def run():
        tasks = S.tail(spark, str(src), "k string")
        q = S.dispatch(tasks, call, "k string", lambda df, i: seen.extend(r["k"] for r in df.collect()), str(tmp_path / "log"))
        q.awaitTermination()

    run()
    (src / "1.json").write_text('{"k": "b"}\n')
    run()
    assert seen == ["a", "b"]


def test_streaming_router_equals_replay(spark, tmp_path):
    import random

    from mnemora.operators import journal as J

    rng, src = random.Random(2), tmp_path / "in"
    src.mkdir()
    events = [{"e": rng.choice("uvw"), "at": i, "s": rng.random() * 60, "f": rng.random() < 0.3} for i in range(120)]
    for k in range(3):
        part = events[40 * k : 40 * k + 40]
        rng.shuffle(part)  # a batch may hold its events in any order
        (src / f"{k}.json").write_text("".join(json.dumps(x) + "\n" for x in part))
        os.utime(src / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken in order of their times
    tail = S.tail(spark, str(src), "e string, at long, s double, f boolean", 1)
    out = S.update_batches(S.router(tail, "e", "s", "f", "at"), spark, str(tmp_path / "out"), str(tmp_path / "log"))
    last = out.groupBy("endpoint").agg(F.max_by(F.struct("latency", "count", "failures", "until"), "batch").alias("x")).select("endpoint", "x.*")
    got = {r["endpoint"]: (round(r["latency"], 6), r["count"], r["failures"], r["until"]) for r in last.collect()}
    whole = J.router_replay(spark.createDataFrame(events, "e string, at long, s double, f boolean"), "e", "at", "s", "f")
    assert got == {r["e"]: (round(r["latency"], 6), r["count"], r["failures"], r["until"]) for r in whole.collect()}


def test_streams_end_by_count_or_idle_time(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    (src / "0.json").write_text('{"k": "a"}\n{"k": "b"}\n')

    def run(log):
        return S.tail(spark, str(src), "k string").writeStream.foreachBatch(lambda df, i: seen.extend(r["k"] for r in df.collect())).option("checkpointLocation", str(tmp_path / log)).start()

    assert S.until_done(run("a"), lambda: len(seen), 2, 30) is True
    assert S.until_done(run("b"), lambda: 0, 5, 0.5) is False
