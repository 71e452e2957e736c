"""Fill-in-middle: each text becomes prefix, suffix and middle, cut between units that an automaton tells.

A unit ends where the automaton says so; a text of n units is cut after two numbers of units that the id's hash draws.
The scan is parallel: texts are cut into chunks of bytes anywhere, each chunk gives its transition function (the state it
leaves from every state that it may be entered in) and the number of units that end in it from each of these. Functions
compose associatively, so a prefix scan by doubling gives each chunk's entry state and the units before it; then only
the chunk that holds a cut is walked again. All chunks of a batch take each step at once.

Texts over SPAN bytes are dealt in spans: tasks give each span's function, one small task per text composes them (a text
has at most 2**31 / SPAN of them) and names the span of each cut, and only these spans are walked again. Smaller texts
are scanned where they are, without a shuffle.

Defined cases: a null text counts as empty and comes back as an empty output; a null id is hashed as an empty string;
texts that are empty or contain a control string, and those that the rate spares, are plain: their output is the text, and
prefix and middle are null; texts of any length are taken whole; repeated rows are transformed each, alike; an
empty table gives an empty table; other columns are kept, but those named n, form, prefix_chars, middle_chars or output
are replaced."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")

#: Bytes of a chunk, chunks that take a step together, bytes over which a text is dealt in spans of that size.
CHUNK, TOGETHER, SPAN = 1024, 4096, 64 << 10


class Automaton(NamedTuple):
    """A DFA over bytes: kind of each byte, and for each kind and state the next state and whether a unit ends
    after the byte (one byte wide, or the last byte of its character). open tells the states in which the text's
    end ends a unit. State 0 is the first."""

    kinds: np.ndarray
    follow: np.ndarray
    ends: np.ndarray
    open: np.ndarray

    @classmethod
    def of(cls, kinds: dict[int, int], follow: list[list[int]], ends: list[list[int]], open: list[int]) -> Automaton:
        """Bytes not in kinds are of the last kind of follow. One more kind, of no byte, changes nothing."""
        table = np.full(256, len(follow) - 1, np.int16)
        for byte, kind in kinds.items():
            table[byte] = kind
        states = len(open)
        return cls(table, np.array([*follow, range(states)], np.int64), np.array([*ends, [0] * states], np.int64), np.array(open, np.int64))


#: Lines with their newline: state 0 is between lines, 1 inside one.
LINES = Automaton.of({10: 0}, [[0, 0], [1, 1]], [[1, 1], [0, 0]], [0, 1])


def matrix(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of chunks as columns, and which of them are inside."""
    steps = np.arange(int(size.max(initial=0)))[:, None]
    inside = steps < size
    return data[np.where(inside, begin + steps, 0)] if len(data) else np.zeros(inside.shape, np.uint8), inside


class Functions(NamedTuple):
    """Of each chunk: the state it leaves and the units that end in it by the state it is entered in, and its characters."""

    leave: np.ndarray
    units: np.ndarray
    chars: np.ndarray


def functions(data: np.ndarray, begin: np.ndarray, size: np.ndarray, a: Automaton) -> Functions:
    """The function of each chunk of data."""
    states = len(a.open)
    leave, units, chars = np.empty((len(begin), states), np.int64), np.zeros((len(begin), states), np.int64), np.empty(len(begin), np.int64)
    follow, ends = a.follow.ravel(), a.ends.ravel()
    for i in range(0, len(begin), TOGETHER):
        raw, inside = matrix(data, begin[i : i + TOGETHER], size[i : i + TOGETHER])
        chars[i : i + TOGETHER] = (((raw & 0xC0) != 0x80) & inside).sum(axis=0)
        kind = np.where(inside, a.kinds[raw], np.int16(len(a.follow) - 1)) * np.int16(states)
        state, count = np.tile(np.arange(states), (raw.shape[1], 1)), units[i : i + TOGETHER]
        for step in kind:
            at = step[:, None] + state
            count += ends[at]
            state = follow[at]
        leave[i : i + TOGETHER] = state
    return Functions(leave, units, chars)


def composed(f: Functions, text: np.ndarray) -> Functions:
    """For each chunk the composition of its text's functions up to and with it. text is ascending; a step composes with
    what stands 1, 2, 4, ... chunks before."""
    leave, units, chars = f.leave.copy(), f.units.copy(), f.chars.copy()
    first = np.searchsorted(text, text)
    place = np.arange(len(text)) - first
    back = 1
    while back <= place.max(initial=0):
        to = np.flatnonzero(place >= back)
        by, entered = to - back, leave[to - back]
        leave[to], units[to], chars[to] = (
            np.take_along_axis(leave[to], entered, 1), units[by] + np.take_along_axis(units[to], entered, 1), chars[by] + chars[to],
        )
        back *= 2
    return Functions(leave, units, chars)


def before(f: Functions, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk, from composed functions: the state it is entered in, the units and characters before it."""
    later = np.concatenate([[False], text[1:] == text[:-1]])[: len(text)]
    shift = lambda x: np.where(later, np.concatenate([[0], x[:-1]])[: len(x)], 0)
    return shift(f.leave[:, 0]), shift(f.units[:, 0]), shift(f.chars)


def chosen(upto: np.ndarray, text: np.ndarray, whose: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The first chunk of text whose (a text's number) by whose end at least wanted units have ended, wanted being 1 at
    least and no more than there are. upto: units ended by the end of each chunk."""
    last = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]])[: len(text)])
    total = np.zeros((int(text[-1]) if len(text) else 0) + 2, np.int64)
    total[text[last] + 1] = upto[last]
    offset = np.cumsum(total)
    return np.searchsorted(offset[text] + upto, offset[whose] + wanted)


def walked(data: np.ndarray, begin: np.ndarray, size: np.ndarray, enter: np.ndarray, wanted: np.ndarray, a: Automaton) -> np.ndarray:
    """Characters of each chunk up to where the wanted-th unit in it ends."""
    out, states = np.zeros(len(begin), np.int64), len(a.open)
    follow, ends = a.follow.ravel(), a.ends.ravel()
    for i in range(0, len(begin), TOGETHER):
        raw, inside = matrix(data, begin[i : i + TOGETHER], size[i : i + TOGETHER])
        kind = np.where(inside, a.kinds[raw], np.int16(len(a.follow) - 1)) * np.int16(states)
        state, need = enter[i : i + TOGETHER].copy(), wanted[i : i + TOGETHER].copy()
        count = np.zeros(len(need), np.int64)
        for step, lead in zip(kind, ((raw & 0xC0) != 0x80) & inside):
            count += lead & (need > 0)
            at = step + state
            need -= ends[at]
            state = follow[at]
        out[i : i + TOGETHER] = count
    return out


def drawn(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units of the prefix, and of prefix and middle."""
    x, y = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(x, y), np.maximum(x, y)


def cuts(data: np.ndarray, begin: np.ndarray, size: np.ndarray, h1: np.ndarray, h2: np.ndarray, a: Automaton = LINES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in data: the number of units, and the characters before each of the two cuts."""
    chunks = -(-size // CHUNK)
    text = np.repeat(np.arange(len(size)), chunks)
    place = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    at, length = begin[text] + place * CHUNK, np.minimum(size[text] - place * CHUNK, CHUNK)
    f = composed(functions(data, at, length, a), text)
    enter, units, chars = before(f, text)
    last = np.cumsum(chunks) - 1
    some = chunks > 0
    ended, n, whole = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    ended[some], whole[some] = f.units[last[some], 0], f.chars[last[some]]
    n[some] = ended[some] + a.open[f.leave[last[some], 0]]
    found = []
    for wanted in drawn(n, h1, h2):
        out = np.where(wanted > ended, whole, 0)
        inside = np.flatnonzero((wanted > 0) & (wanted <= ended))
        c = chosen(f.units[:, 0], text, inside, wanted[inside])
        out[inside] = chars[c] + walked(data, at[c], length[c], enter[c], wanted[inside] - units[c], a)
        found.append(out)
    return n, found[0], found[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of an array of strings or binaries without nulls."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), edges[:-1], np.diff(edges)


def in_place(a: Automaton):
    """A column function of (text, h1, h2): struct of n, from, to."""

    def scan(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        n, x, y = cuts(*buffers(text), h1.to_numpy(), h2.to_numpy(), a)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(x), pa.array(y)], names=["n", "from", "to"])

    return F.arrow_udf(scan, "struct<n: long, from: long, to: long>")


def spans(giant: DataFrame) -> DataFrame:
    """_key, span, bytes: the spans of each text of giant."""
    raw = F.col("_text").cast("binary")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("_text") - 1) / SPAN).cast("int")), lambda i: F.substring(raw, i * SPAN + 1, F.lit(SPAN)))
    return giant.select("_key", F.posexplode(pieces).alias("span", "bytes"))


def dealt(giant: DataFrame, a: Automaton) -> DataFrame:
    """_key, n, from, to of the distinct texts of giant (_key, _text, _h1, _h2), their spans dealt to all tasks."""
    kind = "_key string, span int, leave array<long>, units array<long>, chars long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, begin, size = buffers(b.column("bytes"))
            chunks = -(-size // CHUNK)
            span = np.repeat(np.arange(len(size)), chunks)
            place = np.arange(len(span)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            f = composed(functions(data, begin[span] + place * CHUNK, np.minimum(size[span] - place * CHUNK, CHUNK), a), span)
            last = np.cumsum(chunks) - 1
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), b.column("span"), pa.array(f.leave[last].tolist(), pa.list_(pa.int64())), pa.array(f.units[last].tolist(), pa.list_(pa.int64())), pa.array(f.chars[last])],
                names=["_key", "span", "leave", "units", "chars"],
            )

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("span")
        f = Functions(*[np.array(table.column(c).to_pylist(), np.int64) for c in ("leave", "units", "chars")])
        text = np.zeros(table.num_rows, np.int64)
        f = composed(f, text)
        enter, units, chars = before(f, text)
        ended = f.units[-1, :1]
        n = ended + a.open[f.leave[-1, 0]]
        rows = []
        for side, wanted in enumerate(drawn(n, *(table.column(c)[:1].to_numpy() for c in ("_h1", "_h2")))):
            if 0 < wanted[0] <= ended[0]:
                c = chosen(f.units[:, 0], text, text[:1], wanted)[0]
                rows.append((c, enter[c], wanted[0] - units[c], chars[c]))
            else:
                rows.append((-1, 0, 0, f.chars[-1] if wanted[0] else 0))
            rows[-1] = (table.column("_key")[0].as_py(), n[0], side, *rows[-1])
        return pa.table([pa.array(list(x)) for x in zip(*rows)], schema=pa.schema([("_key", pa.string()), ("n", pa.int64()), ("side", pa.int64()), *[(c, pa.int64()) for c in ("span", "enter", "wanted", "chars")]]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, begin, size = buffers(b.column("bytes"))
            enter, wanted = b.column("enter").to_numpy(), b.column("wanted").to_numpy()
            chunks = -(-size // CHUNK)
            span = np.repeat(np.arange(len(size)), chunks)
            place = np.arange(len(span)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            at, length = begin[span] + place * CHUNK, np.minimum(size[span] - place * CHUNK, CHUNK)
            f = composed(functions(data, at, length, a), span)
            # the state that each chunk is entered in depends on its span's own
            later = place > 0
            own, units, chars = enter[span], np.zeros(len(span), np.int64), np.zeros(len(span), np.int64)
            own[later] = f.leave[np.flatnonzero(later) - 1, enter[span][later]]
            units[later] = f.units[np.flatnonzero(later) - 1, enter[span][later]]
            chars[later] = f.chars[np.flatnonzero(later) - 1]
            c = chosen(f.units[np.arange(len(span)), enter[span]], span, np.arange(len(size)), wanted)
            found = chars[c] + walked(data, at[c], length[c], own[c], wanted - units[c], a)
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("side"), pa.array(found)], names=["_key", "side", "found"])

    parts = int(giant.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = spans(giant).repartition(parts, "_key", "span").mapInArrow(scan, kind)
    each = own.groupBy("_key", "span").agg(*[F.first(c).alias(c) for c in ("leave", "units", "chars")])
    draws = giant.groupBy("_key").agg(F.first("_h1").alias("_h1"), F.first("_h2").alias("_h2"))
    sides = each.join(draws, "_key").groupBy("_key").applyInArrow(compose, "_key string, n long, side long, span long, enter long, wanted long, chars long")
    sides = written(sides, giant.sparkSession, "infill-cuts")
    asked = spans(giant).join(sides.where("span >= 0"), ["_key", "span"]).select("_key", "side", "bytes", "enter", "wanted")
    more = asked.mapInArrow(walk, "_key string, side long, found long").groupBy("_key", "side").agg(F.first("found").alias("found"))
    whole = sides.join(more, ["_key", "side"], "left").withColumn("at", F.col("chars") + F.coalesce("found", F.lit(0)))
    return whole.groupBy("_key").agg(F.first("n").alias("n"), F.max(F.when(F.col("side") == 0, F.col("at"))).alias("from"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("to"))


def draws(key: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of seed:key as numbers."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, spark: SparkSession, seed: int = 7, rate: int = 100, spm_rate: int = 50, units: Automaton = LINES, span_bytes: int = SPAN) -> DataFrame:
    """docs with n (units of the text), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output."""
    text = F.coalesce("text", F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    held = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | held | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), text.alias("_text"), h1.alias("_h1"), h2.alias("_h2"), form.alias("_form"))
    small = rows.where(F.octet_length("_text") <= span_bytes).withColumn("_cut", in_place(units)("_text", "_h1", "_h2"))
    key = F.sha2(F.concat(F.concat_ws(":", "_h1", "_h2", F.lit("")), F.col("_text")), 256)
    giant = written(rows.where(F.octet_length("_text") > span_bytes).withColumn("_key", key).drop("_text"), spark, "infill-texts").withColumn("_text", F.col("_row.text"))
    large = giant.join(dealt(giant, units).select("_key", F.struct("n", "from", "to").alias("_cut")), "_key").drop("_key")
    every = small.unionByName(large)
    first, last = F.col("_cut.from"), F.col("_cut.to")
    prefix, middle = F.substring("_text", F.lit(1), first.cast("int")), F.substring("_text", (first + 1).cast("int"), (last - first).cast("int"))
    suffix = F.substring("_text", (last + 1).cast("int"), F.length("_text"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    plain = F.col("_form") == "plain"
    output = F.when(plain, F.col("_text")).when(F.col("_form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return every.select(
        *kept, F.col("_cut.n").alias("n"), F.col("_form").alias("form"), F.when(~plain, first).alias("prefix_chars"), F.when(~plain, last - first).alias("middle_chars"), output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    rest = lambda text, head, mark: F.substring(text, F.length(head) + 1 + len(mark), F.length(text))
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    mark = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    first = F.substring_index(body, SUFFIX, 1), F.substring_index(body, PREFIX, 1)
    head = F.when(form == "psm", first[0]).otherwise(first[1])
    tail = F.substring(body, F.length(head) + 1 + F.length(mark), F.length(body))
    second = F.substring_index(tail, MIDDLE, 1)
    middle = rest(tail, second, MIDDLE)
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, second)).otherwise(F.concat(second, middle, head))
