"""A clustered layout by interleaved coordinates, and how many files a query near each row would touch.

Every value of a row becomes a coordinate of `levels` by its rank among all rows, the coordinates' digits are
interleaved to z, and the rows are numbered by z and id; every `file_rows` of them are a file. For each row's query (equal
coordinates in the first two dimensions, at most one away in the others) the files that hold a row inside it and the
files whose bounds meet it are counted without meeting rows and files in pairs: each file's occupied cells are sparse
grids of one 64-bit number for each pair of the first two coordinates, a sliding-window OR along the third and then the
fourth dimension dilates them, and what they cover is added up cell by cell; the bounds, dilated likewise, are added up
from their corners by running sums along each dimension.

Ranks and positions are exact and distributed: rows are sorted by ranges, each range counts its own, and the sums of the
ranges before it are made in a tree of FAN ranges a node. What is collected is the value at which each coordinate begins
(levels of each dimension); what is broadcast is a row for each cell (levels**4 at most). Neither grows with the input.

Defined cases: a null value is smallest, the coordinate of null is 0; a null text has length -1; the date of a null id is
that of an empty string, and null ids come first; repeated rows are rows of their own, whose order doesn't matter; only
a text's length is used, so texts of any length are taken; an empty table gives an empty table; columns other than
doc_id, source, lang and text, whatever their names, are ignored."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket, written

#: Coordinates in each dimension (a power of two, 8 at most), rows of a file, ranges summed up by one task, rows of a range.
LEVELS, FILE_ROWS, FAN, RANGE_ROWS = 8, 2000, 256, 2_000_000

#: The dimensions; the last two are those in which a query reaches one coordinate further. A round of z takes them from the last to the first.
DIMENSIONS = ("source", "lang", "length", "date")


def values(docs: DataFrame) -> DataFrame:
    """doc_id and the four values of each document."""
    length = F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long")
    return docs.select("doc_id", F.col("source").alias("source"), F.col("lang").alias("lang"), length.alias("length"), bucket("doc_id", 365).alias("date"))


def summed(rows: DataFrame, spark: SparkSession, order: list[str], weight: str | None = None, parts: int | None = None) -> DataFrame:
    """rows with before: the sum of weight (1 without one) over all rows that come before in order, nulls first."""
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = (rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)).sortWithinPartitions(*by)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had, part = 0, TaskContext.get().partitionId()
        for b in batches:
            w = np.ones(b.num_rows, np.int64) if weight is None else b.column(weight).to_numpy()
            upto = had + np.cumsum(w)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part), pa.int64()), pa.array(upto - w)], names=[*b.schema.names, "part", "own"])
            had = int(upto[-1]) if len(upto) else had

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local = written(ranged.mapInArrow(own, f"{kinds}, part long, own long"), spark, "ranges")
    totals = local.groupBy("part").agg((F.max("own") if weight is None else F.sum(weight)).alias("n"))
    if weight is None:
        totals = totals.withColumn("n", F.col("n") + 1)
    last = totals.agg(F.max("part")).first()[0]
    offsets = tree_sums(totals, (last or 0) + 1)
    out = local.join(offsets.hint("shuffle_hash"), "part")
    return out.select(*rows.columns, (F.col("own") + F.col("offset")).alias("before"))


def tree_sums(totals: DataFrame, parts: int, fan: int = FAN) -> DataFrame:
    """part, offset: the sum of n over smaller parts, of rows (part, n) with parts below `parts`. No task sees more
    than fan of them: sums of fan parts are summed up in turn."""
    inside = Window.partitionBy(F.expr(f"part div {fan}")).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = totals.select("part", F.expr(f"part div {fan}").alias("node"), F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("offset"))
    if parts <= fan:
        return own.select("part", "offset")
    nodes = totals.groupBy(F.expr(f"part div {fan}").alias("part")).agg(F.sum("n").alias("n"))
    above = tree_sums(nodes, -(-parts // fan), fan).select(F.col("part").alias("node"), F.col("offset").alias("above"))
    return own.join(above.hint("shuffle_hash"), "node").select("part", (F.col("offset") + F.col("above")).alias("offset"))


def starts(rows: DataFrame, spark: SparkSession, n: int, levels: int) -> dict[str, list[tuple[int, object]]]:
    """For each dimension the coordinates over 0 that occur and the smallest value of each: levels - 1 at most."""
    counts = rows.groupingSets([[d] for d in DIMENSIONS], *DIMENSIONS).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
    ranked = summed(counts.select("gid", *DIMENSIONS, "n"), spark, ["gid", *DIMENSIONS], "n")
    # n rows of each dimension of a smaller grouping id come before a dimension's values
    gid = {d: sum(1 << (len(DIMENSIONS) - 1 - j) for j, e in enumerate(DIMENSIONS) if e != d) for d in DIMENSIONS}
    out: dict[str, list] = {d: [] for d in DIMENSIONS}
    smaller = F.expr(f"(before % {n}L) * {levels} div {n}L")
    for r in ranked.groupBy("gid", smaller.alias("c")).agg(*[F.min(d).alias(d) for d in DIMENSIONS]).where("c > 0").collect():
        d = next(d for d in DIMENSIONS if gid[d] == r["gid"])
        out[d].append((int(r["c"]), r[d]))
    return {d: sorted(x) for d, x in out.items()}


def coordinate(value: Column, begins: list[tuple[int, object]]) -> Column:
    out = F.lit(0).cast("long")
    for c, low in sorted(begins):
        out = F.when(value >= F.lit(low), F.lit(c).cast("long")).otherwise(out)
    return out


def interleave(coordinates: list[Column], levels: int) -> Column:
    """Binary digits of the coordinates, highest first, each round from the last dimension to the first."""
    digits, k, z = (levels - 1).bit_length(), len(coordinates), F.lit(0).cast("long")
    for j in range(digits):
        for i, c in enumerate(coordinates):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(c, j).bitwiseAND(F.lit(1).cast("long")), j * k + i))
    return z


def separate(z: Column, levels: int, k: int = len(DIMENSIONS)) -> list[Column]:
    """The coordinates that z interleaves."""
    digits = (levels - 1).bit_length()
    out = []
    for i in range(k):
        c = F.lit(0).cast("long")
        for j in range(digits):
            c = c.bitwiseOR(F.shiftleft(F.shiftright(z, j * k + i).bitwiseAND(F.lit(1).cast("long")), j))
        out.append(c)
    return out


def place(docs: DataFrame, spark: SparkSession, levels: int = LEVELS, file_rows: int = FILE_ROWS) -> DataFrame:
    """doc_id, z, position, file of each document, as a table in the shared folder."""
    if levels & (levels - 1) or not 1 < levels <= 8:
        raise ValueError("levels has to be 2, 4 or 8")
    rows = written(values(docs).withColumn("at", F.monotonically_increasing_id()), spark, "layout-values")
    n = rows.count()
    begins = starts(rows, spark, n, levels) if n else {d: [] for d in DIMENSIONS}
    z = interleave([coordinate(F.col(d), begins[d]) for d in DIMENSIONS], levels)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS + 1)
    ordered = summed(rows.select("doc_id", "at", z.alias("z")), spark, ["z", "doc_id", "at"], parts=parts)
    return written(ordered.select("doc_id", "z", F.col("before").alias("position"), F.expr(f"before div {file_rows}").alias("file")), spark, "layout")


def matching(cells: DataFrame, levels: int) -> DataFrame:
    """source, lang, bit, matching: the number of files with a row within one step of each cell, of rows (file, z).
    Cells no file reaches have no row."""
    source, lang, length, date = separate(F.col("z"), levels)
    one = F.lit(1).cast("long")
    grid = cells.select("file", source.alias("source"), lang.alias("lang"), F.call_function("shiftleft", one, (length * levels + date).cast("int")).alias("bits"))
    grid = grid.groupBy("file", "source", "lang").agg(F.bit_or("bits").alias("bits"))
    every = (1 << levels * levels) - 1
    column = lambda j: sum(1 << (i * levels + j) for i in range(levels))
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    b = F.col("bits")
    wide = b.bitwiseOR(F.shiftleft(b, levels)).bitwiseOR(F.shiftrightunsigned(b, levels)).bitwiseAND(signed(every))
    grid = grid.withColumn("bits", wide)
    up = F.shiftleft(b.bitwiseAND(signed(every & ~column(levels - 1))), 1)
    down = F.shiftrightunsigned(b.bitwiseAND(signed(every & ~column(0))), 1)
    grid = grid.withColumn("bits", b.bitwiseOR(up).bitwiseOR(down))
    held = F.filter(F.sequence(F.lit(0), F.lit(levels * levels - 1)), lambda i: F.call_function("shiftrightunsigned", F.col("bits"), i).bitwiseAND(one) == 1)
    return grid.select("source", "lang", F.explode(held).alias("bit")).groupBy("source", "lang", "bit").agg(F.count("*").alias("matching"))


def touched(cells: DataFrame, levels: int) -> DataFrame:
    """The four coordinates of every cell and touched: the number of files whose bounds are within one step of it in the
    last two dimensions and hold it in the others. A file's bounds add 1 from their lower corner on and take
    it back after the upper ones; running sums along each dimension spread that over the cells."""
    at = dict(zip(DIMENSIONS, separate(F.col("z"), levels)))
    bounds = cells.groupBy("file").agg(*[f(at[d]).alias(f"{p}_{d}") for d in DIMENSIONS for p, f in (("low", F.min), ("high", F.max))])
    reach = {d: int(d in DIMENSIONS[2:]) for d in DIMENSIONS}
    edges = {d: ((1, F.greatest(F.col(f"low_{d}") - reach[d], F.lit(0))), (-1, F.col(f"high_{d}") + 1 + reach[d])) for d in DIMENSIONS}
    corners = [F.struct(F.lit(math.prod(sign for sign, _ in c)).alias("add"), *[x.alias(d) for d, (_, x) in zip(DIMENSIONS, c)]) for c in itertools.product(*edges.values())]
    inside = " and ".join(f"{d} < {levels}" for d in DIMENSIONS)
    deltas = bounds.select(F.explode(F.array(*corners)).alias("c")).select("c.*").where(inside).groupBy(*DIMENSIONS).agg(F.sum("add").alias("add"))
    every = cells.sparkSession.range(levels ** len(DIMENSIONS)).select(*[F.expr(f"id div {levels**k} % {levels}").alias(d) for k, d in enumerate(DIMENSIONS)])
    grid = every.join(deltas, list(DIMENSIONS), "left").withColumn("add", F.coalesce("add", F.lit(0)))
    for d in DIMENSIONS:
        along = Window.partitionBy(*[f for f in DIMENSIONS if f != d]).orderBy(d).rowsBetween(Window.unboundedPreceding, 0)
        grid = grid.withColumn("add", F.sum("add").over(along))
    return grid.withColumnRenamed("add", "touched")


def clustered(docs: DataFrame, spark: SparkSession, levels: int = LEVELS, file_rows: int = FILE_ROWS) -> DataFrame:
    """doc_id, z, position, file, files_touched, files_matching, file_bounds (minimum and maximum of each coordinate)."""
    rows = place(docs, spark, levels, file_rows)
    cells = written(rows.groupBy("file", "z").agg(F.count("*").alias("n")), spark, "layout-cells")
    count = touched(cells, levels).withColumn("bit", (F.col("length") * levels + F.col("date")).cast("int"))
    count = count.join(matching(cells, levels), ["source", "lang", "bit"], "left")
    count = count.select(interleave([F.col(d) for d in DIMENSIONS], levels).alias("z"), F.col("touched").cast("long").alias("files_touched"), F.coalesce("matching", F.lit(0)).cast("long").alias("files_matching"))
    one_file = Window.partitionBy("file")
    bounds = [f(c).over(one_file).cast("string") for c in separate(F.col("z"), levels) for f in (F.min, F.max)]
    bounded = rows.select("*", F.concat_ws(",", *bounds).alias("file_bounds"))
    # a row for each cell: levels**4 at most
    return bounded.join(F.broadcast(count), "z").select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")
