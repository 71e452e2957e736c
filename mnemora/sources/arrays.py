"""JSON arrays in files of any size, read in splits.

A JSON array is one value, so a reader of values takes a file in one task. Here files are read as the pieces between commas,
which Spark splits by bytes as it splits lines. A task doesn't know whether its split begins inside a string, nor how
deep: it computes the split's effect from both, the state it leaves and how much deeper it is then. Effects compose, so a
prefix over the splits of a file gives each one's true state; then every split cuts its own elements, and only those that
reach over an edge, a head and a tail for each split, are put together by a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

QUOTE, BACKSLASH, COMMA, OPEN, CLOSE = 34, 92, 44, (91, 123), (93, 125)
#: Splits whose states are broadcast at most; those of more are joined by a shuffle of the pieces.
MOST_SPLITS = 100_000
#: The last key of the text before an array.
KEY = r'"((?:[^"\\]|\\.)*)"\s*:\s*\z'


def marks(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Whether each byte stands in a string (its quotes included), the change of depth at each byte outside, and whether the
    text after data is inside. data begins inside a string or not, and ends after a comma, so never within an escape."""
    slash = data == BACKSLASH
    quote = data == QUOTE
    if slash.any():  # a quote after an odd run of backslashes is a character
        at = np.arange(len(data))
        last = np.maximum.accumulate(np.where(slash, -1, at))
        run = np.concatenate([[0], (at - last)[:-1]])
        quote &= run % 2 == 0
    count = np.cumsum(quote) + int(inside)
    within = (count % 2 == 1) | quote
    depth = np.where(within, 0, np.isin(data, OPEN).astype(np.int64) - np.isin(data, CLOSE))
    return within, depth, bool(count[-1] % 2) if len(data) else inside


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the split) and value: what stands between commas."""
    return spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """(file, start) and bytes of the stretches of each batch that lie in one split, with a comma after each piece."""
    for b in batches:
        if not b.num_rows:
            continue
        file, start = b.column("file").to_pylist(), b.column("start").to_numpy()
        edges = [0, *[i for i in range(1, b.num_rows) if start[i] != start[i - 1] or file[i] != file[i - 1]], b.num_rows]
        values = b.column("value").cast(pa.binary()).to_pylist()
        for i, j in zip(edges, edges[1:]):
            yield (file[i], int(start[i])), np.frombuffer(b",".join(values[i:j]) + b",", np.uint8)


def effects(found: DataFrame) -> DataFrame:
    """file, start and, for a split that begins outside (0) and inside (1) a string: inside, whether it ends in one, and
    deeper, the change of depth."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: dict[tuple, list] = {}
        for split, data in _runs(batches):
            state = had.setdefault(split, [[False, 0], [True, 0]])
            for s in state:
                _, depth, s[0] = marks(data, s[0])
                s[1] += int(depth.sum())
        keys = list(had)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([[s[0] for s in had[k]] for k in keys], pa.list_(pa.bool_())), pa.array([[s[1] for s in had[k]] for k in keys], pa.list_(pa.int64()))],
            names=["file", "start", "inside", "deeper"],
        )

    return found.mapInArrow(scan, "file string, start long, inside array<boolean>, deeper array<long>")


def states(effect: DataFrame) -> DataFrame:
    """file, start, inside, depth at which each split begins: the effects of the file's splits before it, composed. A file's
    splits are one row here, two numbers for each."""
    step = lambda s, e: F.struct(F.element_at(e["inside"], s["inside"].cast("int") + 1).alias("inside"), (s["depth"] + F.element_at(e["deeper"], s["inside"].cast("int") + 1)).alias("depth"))
    first = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("depth"))
    grow = lambda a, e: F.concat(a, F.array(step(F.element_at(a, -1), e)))
    by_file = effect.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "inside", "deeper"))).alias("e"))
    whole = by_file.select("file", F.arrays_zip(F.col("e.start").alias("start"), F.slice(F.aggregate("e", F.array(first), grow), F.lit(1), F.size("e")).alias("s")).alias("x"))
    return whole.select("file", F.explode("x").alias("x")).select("file", "x.start", "x.s.inside", "x.s.depth")


def fragments(found: DataFrame, begun: DataFrame, level: int) -> DataFrame:
    """file, start, number, last, held, text: what stands between the boundaries of each split, which are the commas at
    depth level and the brackets that lead to it and away. number counts within the split, last marks what is open at
    its end, held what is inside an array of that depth."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, list] = {}
        rest: dict[tuple, list[bytes]] = {}
        for split, data in _runs(_with_state(batches, state)):
            inside, depth, number = state[split]
            within, change, state[split][0] = marks(data, inside)
            at = depth + np.cumsum(change)
            border = ~within & (((change > 0) & (at == level)) | ((change < 0) & (at == level - 1)) | ((data == COMMA) & (at == level)))
            ends = np.flatnonzero(border)
            raw, begin = data.tobytes(), 0
            open_at = depth >= level
            rows = []
            for e in ends.tolist():
                rows.append((number, open_at, b"".join([*rest.pop(split, []), raw[begin:e]])))
                number, begin, open_at = number + 1, e + 1, bool(at[e] >= level)
            rest.setdefault(split, []).append(raw[begin:])
            state[split][1:] = [int(at[-1]), number]
            yield _rows(split, [(n, False, h, t) for n, h, t in rows])
        for split, left in rest.items():
            yield _rows(split, [(state[split][2], True, state[split][1] >= level, b"".join(left))])

    def _with_state(batches: Iterator[pa.RecordBatch], state: dict) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, s, i, d in zip(*(b.column(c).to_pylist() for c in ("file", "start", "inside", "depth"))):
                state.setdefault((f, s), [i, d, 0])
            yield b

    def _rows(split: tuple, rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int64(), pa.bool_(), pa.bool_(), pa.binary()))]
        columns[3] = columns[3].cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([split[0]] * n, pa.string()), pa.array([split[1]] * n, pa.int64()), *columns], names=["file", "start", "number", "last", "held", "text"])

    if begun.count() <= MOST_SPLITS:  # a row for each split: the pieces stay in place
        placed = found.join(F.broadcast(begun), ["file", "start"])
    else:
        moved = found.withColumn("id", F.monotonically_increasing_id()).join(begun.hint("shuffle_hash"), ["file", "start"])
        placed = moved.repartition("file", "start").sortWithinPartitions("file", "start", "id").drop("id")
    return placed.mapInArrow(cut, "file string, start long, number long, last boolean, held boolean, text string")


def elements(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """file, number (counted over the whole file), held, text of everything between the boundaries of depth level."""
    found = pieces(spark, path)
    cut = written(fragments(found, written(states(effects(found)), "array-states"), level), "array-pieces")
    splits = cut.where("last").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", F.col("number").alias("n")))).alias("s"))
    # a row for each split
    base = splits.select("file", F.explode(F.transform("s", lambda s, i: F.struct(s["start"].alias("start"), F.aggregate(F.slice("s", F.lit(1), i), F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("base")))).alias("x")).select("file", "x.*")
    placed = cut.join(written(base, "array-splits"), ["file", "start"]).select("file", "start", (F.col("base") + F.col("number")).alias("number"), (F.col("last") | (F.col("number") == 0)).alias("edge"), "held", "text")
    edge = placed.where("edge").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("start", "held", "text"))).alias("p"))
    joined = edge.select("file", "number", F.element_at("p", 1)["held"].alias("held"), F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"))
    return placed.where("not edge").select("file", "number", "held", "text").unionByName(joined)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that each are a JSON array of objects; what can't be parsed is an error."""
    rows = elements(spark, path).where(F.col("held") & (F.trim(F.translate("text", "\r\n\t", "   ")) != ""))
    return rows.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_field(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """pos, r: the objects of the array that is a field of a JSON object. The positions run on over several files, in order
    of their names."""
    every = written(elements(spark, path, 2), "array-elements")
    blank = F.trim(F.translate("text", "\r\n\t", "   ")) == ""
    heads = every.where("not held").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("number", F.regexp_extract("text", KEY, 1).alias("name")))).alias("heads"))  # a row for each field of an object
    heads = written(heads, "array-fields")
    mine = every.where(F.col("held") & ~blank).join(heads, "file")
    head = F.element_at(F.filter("heads", lambda h: h["number"] < F.col("number")), -1)
    kept = mine.withColumn("_head", head).where(F.col("_head.name") == field).select("file", (F.col("number") - F.col("_head.number") - 1).alias("at"), "text")
    kept = written(kept, "array-rows")
    sizes = kept.groupBy("file").agg((F.max("at") + 1).alias("n"))
    every_file = sizes.agg(F.sort_array(F.collect_list(F.struct("file", "n"))).alias("f")).select(F.explode(F.transform("f", lambda f, i: F.struct(f["file"].alias("file"), F.aggregate(F.slice("f", F.lit(1), i), F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("base")))).alias("x")).select("x.*")
    return kept.join(written(every_file, "array-files"), "file").select((F.col("at") + F.col("base")).cast("int").alias("pos"), F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r"))


def write_array(df: DataFrame, path: str, field: str | None = None) -> None:
    """df as JSON arrays, a file for each partition and a line for each row; with field each array is that field of an object."""
    head, tail = ("[", "]") if field is None else ('{"%s":[' % field, "]}")

    def bracket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = head
        for b in batches:
            if b.num_rows:
                lines = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([lead + lines[0], *["," + x for x in lines[1:]]])], names=["value"])
                lead = ","
        if lead == ",":
            yield pa.RecordBatch.from_arrays([pa.array([tail])], names=["value"])

    df.select(F.to_json(F.struct(*[f"`{c}`" for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(bracket, "value string").write.text(path)


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character that isn't blank is a bracket."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).collect()
    return bool(head) and re.match(r"\[", head[0]["c"]) is not None
