"""Prompts in SQL: a table function whose rows and columns follow from its arguments.

    SELECT * FROM rendered(TABLE(samples), layout => 'grouped', style => 'official', template => 'Given {persona}: {question}')

gives a row for each counterfactual stream of each sample (sample_id, context, query, memories with memory_id, memory_text
and a coefficient c). The layout and the style are looked up when the query is analysed: an unknown one, or a table
without the columns, is an analysis error. A style says whether a row holds a prompt or messages; styles are those that
the function was registered with, so sessions don't share them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType

from .text import LIMITS

NEEDED = ("sample_id", "context", "query", "memories")
Kept = list[tuple[str, list]]


def _without(some: list, gone: list) -> list:
    ids = {m["memory_id"] for m in gone}
    return [m for m in some if m["memory_id"] not in ids]


def streams(layout: str, every: list) -> Kept:
    """(kind, memories kept) of each stream of a sample, as operators.records.stream_layout has them."""
    plus, minus = [m for m in every if (m["c"] or 0) > 0], [m for m in every if (m["c"] or 0) < 0]
    clean = _without(every, minus)
    alone = lambda *kinds: [(k, {"only": [m], "empty": [], "without": _without(every, [m])}[k]) for m in every for k in kinds]
    full, base = [("full", every)], [("clean", clean)]
    made: dict[str, Callable[[], Kept]] = {
        "leave_one_out": lambda: full + alone("without"),
        "isolated": lambda: full + alone("only", "empty"),
        "joint_isolated": lambda: base + alone("only", "empty"),
        "hybrid": lambda: full + alone("only", "empty", "without"),
        "policy_grouped": lambda: full + [("without_negative", clean)] * bool(minus) + [("without_positive", _without(every, plus))] * bool(plus),
        "policy_ordered": lambda: full + [("clean", clean)] * bool(minus) + [("without_positive", _without(clean, plus))] * bool(plus),
        "grouped": lambda: base + [("clean_without", _without(clean, [m])) for m in plus],
    }
    return made[layout]()


def official(template: str, row: Row, kept: list) -> str:
    """{persona}: the one text of a sample of one memory (or nothing), else the list as Python writes it; {question}."""
    texts = [m["memory_text"] for m in kept]
    persona = (texts[0] if texts else "") if len(row["memories"]) == 1 else str(texts)
    return _filled(template, persona=persona, question=row["query"])


def system(template: str, row: Row, kept: list) -> str:
    """{context} and {memories}, a numbered list, both cut."""
    listed = "\n".join(f"{i}. {m['memory_text']}" for i, m in enumerate(kept, 1))
    return _filled(template, context=(row["context"] or "")[: LIMITS[0]], memories=listed[: LIMITS[1]])


def chat(template: str, row: Row, kept: list) -> list[tuple[str, str]]:
    """The system prompt and the query as messages, trimmed; the first only where it isn't blank."""
    said = [("system", system(template, row, kept).strip()), ("user", (row["query"] or "").strip())]
    return [m for m in said if m[0] == "user" or m[1]]


def _filled(template: str, **fields: str | None) -> str:
    """template with the fields in place of their names; what a field holds isn't searched again."""
    out, rest = [], template
    while found := min(((rest.find(f"{{{n}}}"), n) for n in fields if f"{{{n}}}" in rest), default=None):
        at, name = found
        out += [rest[:at], fields[name] or ""]
        rest = rest[at + len(name) + 2 :]
    return "".join([*out, rest])


Style = tuple[Callable, str, DataType]
#: Style: its function, and the name and type of its column.
STYLES: dict[str, Style] = {
    "official": (official, "prompt", StringType()),
    "system": (system, "prompt", StringType()),
    "chat": (chat, "messages", ArrayType(StructType().add("role", StringType()).add("content", StringType()))),
}


def table_function(styles: dict[str, Style], layouts: tuple[str, ...]):
    class Rendered:
        @staticmethod
        def analyze(samples: AnalyzeArgument, layout: AnalyzeArgument, style: AnalyzeArgument, template: AnalyzeArgument) -> AnalyzeResult:
            if not samples.isTable:
                raise ValueError("the first argument is a table")
            has = samples.dataType.fieldNames()
            if missing := [c for c in NEEDED if c not in has]:
                raise ValueError(f"the table has no {', '.join(missing)}")
            for name, given, known in (("layout", layout, layouts), ("style", style, styles)):
                if given.value not in known:
                    raise ValueError(f"{name} {given.value} is none of {', '.join(sorted(known))}")
            _, column, kind = styles[style.value]
            schema = StructType().add("sample_id", samples.dataType["sample_id"].dataType).add("stream", IntegerType()).add("kind", StringType())
            return AnalyzeResult(schema.add(column, kind))

        def eval(self, samples: Row, layout: str, style: str, template: str) -> Iterator[tuple]:
            make = styles[style][0]
            for i, (kind, kept) in enumerate(streams(layout, list(samples["memories"] or []))):
                yield samples["sample_id"], i, kind, make(template, samples, kept)

    return udtf(Rendered)


def register(spark: SparkSession, name: str = "rendered", styles: dict[str, Style] | None = None) -> None:
    """Makes the table function known to a session under a name."""
    from ..operators.records import LAYOUTS

    spark.udtf.register(name, table_function(styles or STYLES, LAYOUTS))
