"""Text functions as column expressions; the two that Spark can't express are Arrow UDFs."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: The names of the reliance levels in a leading tag.
RELIANCE = ("Minimal", "Light", "Moderate", "Strong", "Maximal")
SEPARATOR = "\n\n---\n\n"
#: What a prompt says about a memory of each policy.
HINTS = {
    "ignore": "(This preference is NOT relevant to the current request - do not let it influence your response)",
    "support": "(This preference can enhance your response but should not dominate it)",
    "dominate": "(This preference MUST strongly shape your response - it is essential)",
}


def separator(text: str, n: int) -> str:
    """A private character that text, of which n characters are other uses of it, doesn't hold otherwise."""
    return next(c for c in map(chr, range(0xF0000, 0xFFFFE)) if text.count(c) == n)


#: Bytes of texts that are worked on at once: their code points, sums and copies take some forty times that.
PIECE_BYTES = 1 << 20


def pieces(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """texts in slices of most bytes at most (PIECE_BYTES), or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, before + (PIECE_BYTES if most is None else most), "right")))
        yield texts.slice(at, end - at)
        at, before = end, int(ends[end - 1])


def in_pieces(texts: pa.Array, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """work(texts), a row for each, piece by piece, so that memory follows a piece's size and not a batch's."""
    return pa.concat_arrays([work(p) for p in pieces(texts)]) if len(texts) else work(texts)


def in_one(texts: pa.Array, change: Callable[[str, str], str]) -> pa.Array:
    """change(text, separator) applied to all texts of a batch at once, joined by a character that none of them holds. It
    has to keep the separators and nothing may reach over them."""
    each = texts.fill_null("").to_pylist()
    sep = separator("".join(each), 0)
    done = change(sep.join(each), sep).split(sep)
    return pc.if_else(texts.is_valid(), pa.array(done, pa.string()), pa.scalar(None, pa.string())) if len(texts) else pa.array([], pa.string())


def _normal(text: str, sep: str) -> str:
    folded = unicodedata.normalize("NFKC", text).casefold()
    return re.sub(f" ?{sep} ?", sep, re.sub(r"\s+", " ", folded)).strip(" ")


@F.arrow_udf(StringType())
def normalize(texts: pa.Array) -> pa.Array:
    """NFKC, case folding, runs of white space as one space, trimmed; many texts at a time."""
    return in_pieces(texts, lambda p: in_one(p, _normal))


def normalize_plain(text: Column) -> Column:
    """The part of normalize that SQL has: lower case and collapsed white space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def canonical_json(rows: pd.Series) -> pd.Series:
    """JSON text with sorted keys, ", " and ": ", characters unescaped."""
    return rows.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False))


def mask_reliance_tag(text: Column) -> Column:
    """text without one leading reliance tag, trimmed."""
    return F.trim(F.regexp_replace(text, rf"(?i)^\s*\[Memory-Reliance:\s*({'|'.join(RELIANCE)})\]\s*", ""))


def query_id(prefix: list[Column], body: Column) -> Column:
    """prefix parts and the first ten hex digits of the body's MD5, joined by '::'."""
    return F.concat_ws("::", *prefix, F.substring(F.md5(body), 1, 10))


def sample_query_id(directory: Column, event: Column, task: Column, target: Column, query: Column) -> Column:
    """query_id over the five fields' canonical JSON; missing prefix parts are NA."""
    quoted = lambda c: F.coalesce(F.to_json(F.array(c)), F.lit("[null]"))
    field = lambda name, c: F.concat(F.lit(f'"{name}": '), F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(quoted(c), r"(?s)^\[(.*)\]$", 1)))
    body = F.concat(F.lit("{"), F.concat_ws(", ", field("directory_index", directory), field("event_id", event), field("query", query), field("target", target), field("task", task)), F.lit("}"))
    return query_id([F.coalesce(c.cast("string"), F.lit("NA")) for c in (directory, event, task)], body)


def with_instruction(query: Column, instruction: Column) -> Column:
    """The trimmed instruction above the trimmed query; the query alone without an instruction."""
    none = F.coalesce(instruction, F.lit("")) == ""
    return F.when(none, F.trim(query)).otherwise(F.concat(F.trim(instruction), F.lit(SEPARATOR), F.trim(query)))


def messages(system: Column, user: Column) -> Column:
    """[{role, content}], trimmed; the system message only where it isn't blank."""
    both = F.array(
        F.struct(F.lit("system").alias("role"), F.trim(F.coalesce(system, F.lit(""))).alias("content")),
        F.struct(F.lit("user").alias("role"), F.trim(user).alias("content")),
    )
    return F.filter(both, lambda m: (m["role"] != "system") | (m["content"] != ""))


def numbered_list(items: Column, hints: bool = False, drop_ignored: bool = False) -> Column:
    """'1. text' lines of an array of (text, policy), with the policy's hint; numbers skip dropped items."""
    kept = F.filter(items, lambda m: m["policy"] != "ignore") if drop_ignored else items
    table = F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])
    hint = lambda m: F.coalesce(F.concat(F.lit(" "), F.try_element_at(table, m["policy"])), F.lit(""))
    line = lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), m["text"], hint(m) if hints else F.lit(""))
    return F.array_join(F.transform(kept, line), "\n")


#: Characters of a context and of a list of memories that a system prompt takes.
LIMITS = (3000, 2000)


def system_prompt(template: str, context: Column, memories: Column, limits: tuple[int, int] = LIMITS) -> Column:
    """template with {context} and {memories} filled by cut texts, which aren't searched for names again."""
    cut = lambda text, n: F.substring(F.coalesce(text, F.lit("")), 1, n)
    return filled(template, context=cut(context, limits[0]), memories=cut(memories, limits[1]))


@F.pandas_udf(StringType())
def python_list(items: pd.Series) -> pd.Series:
    """An array of strings as Python writes a list."""
    return items.map(lambda x: None if x is None else repr([str(v) for v in x]))


#: The prompts of the judges, and what a rubric's answer has to hold.
SCHEMA_SINGLE = "You are a helpful assistant. Return the JSON requested by the evaluation rubric: match (boolean), OPB, UPB, RII, FM, VG, Judge (each numeric 0 to 5), and reason. Do not omit match or rename any metric."
SCHEMA_MULTI = (
    "You are a helpful assistant. Follow the evaluation rubric without changing its scoring criteria. Return one JSON object containing ALL these fields: full_match (boolean), "
    'match (string "n/{slots}", with integer n between 0 and {slots}), OPB, UPB, RII, FM, VG, Judge (each numeric 0 to 5), and reason (string). '
    "There are exactly {slots} persona entries; evaluate them in their original order. full_match must be true if and only if all entries match. Do not omit match, full_match, or reason. Do not rename any metric."
)
PREFERENCE = """You are given:
1) A single preference attribute.
2) One response written for a given context.

Your task is to judge whether the response follows the preference.

If the response follows the preference, label it as "follow". Otherwise, label it as "do_not_follow".

Preference:
{preference}

Response:
{response}

Only output a JSON object:
{"label": "follow" | "do_not_follow"}"""
COMPLETENESS = """You are an expert evaluator of task-oriented written messages.

You are given the following information:
- Task: {task}

Below is the generated message:
{response}

Evaluate how effectively the message achieves the specified task.

First, provide a brief explanation for your evaluation.
Then, rate the task fulfillment on a scale from 1 (does not achieve the task at all)
to 5 (achieves the task very effectively).

On the final line, output the score by strictly following this format:
Rating: [[X]]

Replace X with an integer from 1 to 5.
Do not include any additional text on the final line."""
DEPENDENCE_SYSTEM = """You are an expert evaluator of how strongly a response depends on the given memory / project history / user profile.

You are given a rubric written in natural language describing how to score the memory dependence of an answer relative to its context/history.

RUBRIC (natural language description):
{rubric}

You MUST output a single JSON object that strictly follows the schema described in the rubric as 'global_instructions.output_schema'. Do NOT output any text before or after the JSON. Do NOT use code fences."""
DEPENDENCE_USER = """Please evaluate how strongly the following ANSWER depends on the provided MEMORY / CONTEXT, according to the rubric.

TASK TYPE:
{task}

MEMORY / CONTEXT (includes user profile, cross-session summaries, recent events, and any relevant artifacts if present):
{context}

USER QUERY:
{query}

ANSWER TO EVALUATE (may contain internal thinking segments like <think>...</think>):
{answer}

Now follow the rubric and produce your evaluation as a JSON object."""


def filled(template: str, **fields: Column) -> Column:
    """template with each {name} replaced by its field, a missing one by nothing; what a field holds is not
    searched for names again."""
    pieces, rest = [], template
    while found := min(((rest.find(f"{{{n}}}"), n) for n in fields if f"{{{n}}}" in rest), default=None):
        at, name = found
        pieces += [F.lit(rest[:at]), F.coalesce(fields[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces, F.lit(rest))


def judge_schema(slots: Column) -> Column:
    """The system message of a verdict over so many persona entries."""
    return F.when(slots == 1, F.lit(SCHEMA_SINGLE)).otherwise(filled(SCHEMA_MULTI, slots=slots))


def official_prompt(template: str, texts: Column, single: Column, question: Column) -> Column:
    """template with {persona} and {question}: the one text (or nothing) of a single row, else the list as Python
    writes it."""
    persona = F.when(single, F.coalesce(F.get(texts, F.lit(0)), F.lit(""))).otherwise(python_list(texts))
    return filled(template, persona=persona, question=question)


def without_line(text: Column, line: Column) -> Column:
    """text without the one line that equals line; null unless it occurs exactly once."""
    lines = F.split(text, "\n", -1)
    count = F.size(F.filter(lines, lambda x: x == line))
    return F.when(count == 1, F.array_join(F.filter(lines, lambda x: x != line), "\n"))


def labelled_parts(parts: list[tuple[str, Column]], sep: str = "\n") -> Column:
    """'label: value' of the parts that aren't blank, joined."""
    return F.concat_ws(sep, *[F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in parts])


#: Repeats that count as degenerate, the longest unit looked for, and how long several characters'
#: repeats are at least.
SINGLE_TIMES, UNIT_TIMES, LONGEST_UNIT, LEAST_CHARS = 20, 10, 30, 40


_ALNUM: list[np.ndarray] = []


def _alnum(codes: np.ndarray) -> np.ndarray:
    """Whether each code is of a letter or digit; those beyond Unicode aren't."""
    if not _ALNUM:
        _ALNUM.append(np.fromiter((i <= sys.maxunicode and chr(i).isalnum() for i in range(sys.maxunicode + 2)), bool, sys.maxunicode + 2))
    return _ALNUM[0][np.minimum(codes, sys.maxunicode + 1)]


def joined_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (none null), a code that stands nowhere else after each, and where each text begins."""
    sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes + 1) - 1
    codes = np.empty(int(sizes.sum()) + len(sizes), np.uint32)
    own = np.ones(len(codes), bool)
    own[ends] = False
    codes[own] = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    codes[ends] = sys.maxunicode + 1 + np.arange(len(ends))
    return codes, ends - sizes


def periodic_runs(codes: np.ndarray, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches, of `least` positions or more, at which a code equals the one a period
    later."""
    differs = np.flatnonzero(codes[:-period] != codes[period:]) if len(codes) > period else np.zeros(0, np.int64)
    edges = np.concatenate([[-1], differs, [max(0, len(codes) - period)]])
    long = np.flatnonzero(np.diff(edges) > least)
    return edges[long] + 1, edges[long + 1]


def first_repetitions(texts: pa.Array) -> pa.Array:
    """Of each text unit, characters and offset of the first degenerate repetition, null for none: a letter or digit SINGLE_TIMES in a row,
    else a unit of two characters or more UNIT_TIMES in a row, on one line, with a letter or digit in it and
    LEAST_CHARS in all.

    Found for all texts at once, from the runs at which their codes, with a code of its own between any two texts, agree with
    themselves shifted by a period. Where the first run of a text is no repetition the next one after it is looked at, in
    rounds that take a step in every such text."""
    codes, begin = joined_codes(texts.fill_null(""))
    n = len(begin)
    unit, size, offset = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    whose = lambda at: np.searchsorted(begin, at, "right") - 1
    a, b = periodic_runs(codes, 1, SINGLE_TIMES - 1)
    single = _alnum(codes[a])
    a, b = a[single], b[single]
    of, first = np.unique(whose(a), return_index=True)
    unit[of], size[of], offset[of] = 1, b[first] - a[first] + 1, a[first]
    lines = np.concatenate([[0], np.cumsum(codes == 10)])
    letters = np.concatenate([[0], np.cumsum(_alnum(codes))])
    found = []  # of each run: period, first and last start of a repetition, end of agreement
    for p in range(2, LONGEST_UNIT + 1):
        a, b = periodic_runs(codes, p, (UNIT_TIMES - 1) * p)
        one_line = lines[np.minimum(a + p, len(codes))] == lines[a]
        a, b = a[one_line], b[one_line]
        found.append(np.stack([np.full(len(a), p), a, b - (UNIT_TIMES - 1) * p, b]))
    period, low, last, end = np.concatenate(found, axis=1) if n else np.zeros((4, 0), np.int64)
    of = whose(low)
    open_at, some = np.zeros(n, np.int64), offset < 0
    while len(of):
        start = np.maximum(low, open_at[of])
        on = np.flatnonzero((start <= last) & some[of])
        period, low, last, end, of, start = period[on], low[on], last[on], end[on], of[on], start[on]
        order = np.lexsort((end, period, start, of))
        text, first = np.unique(of[order], return_index=True)
        pick = order[first]
        p, at = period[pick], start[pick]
        long = p * (1 + (end[pick] - at) // p)
        good = (long >= LEAST_CHARS) & (letters[at + p] > letters[at])
        t = text[good]
        unit[t], size[t], offset[t], some[t] = p[good], long[good], at[good], False
        open_at[text] = at + long
    hit = offset >= 0
    where = np.flatnonzero(hit)
    raw = codes.astype("<u4").tobytes()
    units = np.full(n, None, object)
    units[where] = [raw[4 * x : 4 * (x + y)].decode("utf-32-le") for x, y in zip(offset[where].tolist(), unit[where].tolist())]
    none = ~hit
    return pa.StructArray.from_arrays([pa.array(units, pa.string()), pa.array(size, pa.int32(), mask=none), pa.array(offset - begin, pa.int32(), mask=none)], names=["unit", "characters", "offset"])


def first_repetition(text: str) -> tuple[str, int, int] | None:
    """(unit, characters, offset) of one text, as first_repetitions finds it."""
    found = first_repetitions(pa.array([text]))[0].as_py()
    return None if found["unit"] is None else (found["unit"], found["characters"], found["offset"])


@F.arrow_udf(StructType([StructField("unit", StringType()), StructField("characters", IntegerType()), StructField("offset", IntegerType())]))
def repetition(texts: pa.Array) -> pa.Array:
    """first_repetitions of a batch, piece by piece; nulls for none."""
    return in_pieces(texts, first_repetitions)


def has_single_repetition(text: Column, times: int = 20) -> Column:
    """Whether one letter or digit stands times in a row."""
    return text.rlike(rf"([A-Za-z0-9])\1{{{times - 1},}}")


def contains_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def stable_seed(key: Column, base: int = 0) -> Column:
    """The first eight hex digits of SHA-256 as a number, plus base."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") + F.lit(base)


def sample_key(sample_id: Column, uid: Column) -> Column:
    """sample_id, or uid where that is blank; an error where both are."""
    return F.coalesce(F.nullif(sample_id, F.lit("")), F.nullif(uid, F.lit("")), F.raise_error(F.lit("a row without an id")).cast("string"))


def endpoint(spec: Column, default_cap: int = 1) -> tuple[Column, Column]:
    """(url, capacity) of 'URL[=CAP]', cut at the last '='."""
    cap = F.regexp_extract(spec, r"=(\d+)$", 1)
    return F.regexp_replace(spec, r"=\d+$", ""), F.when(cap != "", cap.cast("int")).otherwise(default_cap)


def hashed_choice(pool: Column, key: Column) -> Column:
    """An element of pool picked by the key's hash (stands in for a seeded random choice)."""
    return F.element_at(pool, (F.pmod(stable_seed(key), F.size(pool).cast("long")) + 1).cast("int"))


def span_positions(spans: Column, offsets: Column) -> Column:
    """Numbers of the tokens (start, end) that overlap each span (start, end)."""
    hit = lambda s: F.filter(F.transform(offsets, lambda o, i: F.when((o["start"] < s["end"]) & (o["end"] > s["start"]), i)), lambda p: p.isNotNull())
    return F.transform(spans, hit)


def find_in_order(text: Column, needles: Column) -> Column:
    """Start (0-based) of each needle, searched after the end of the one before; -1 if missing."""

    def step(acc: Column, needle: Column) -> Column:
        found = F.call_function("locate", needle, text, acc["at"] + 1)
        return F.struct(
            F.when(found > 0, found - 1 + F.length(needle)).otherwise(acc["at"]).alias("at"),
            F.concat(acc["out"], F.array(found - 1)).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(needles, zero, step)["out"]
