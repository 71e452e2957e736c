"""Raw benchmark rows as unified records. Every function takes a DataFrame whose columns are the raw
fields and a position column, and returns the six fields; metadata is a string map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import records as R


def numbered(prefix: str, position: str) -> Column:
    return F.format_string(f"{prefix}_%04d", F.col(position).cast("int"))


def _map(**fields: Column) -> Column:
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])


def from_single(rows: DataFrame, source: str, prefix: str, position: str = "pos") -> DataFrame:
    """(question, persona, implicit_persona, intent_type, intent, reason): one memory per row."""
    key = numbered(prefix, position)
    one = F.array(R.memory(F.concat(key, F.lit("_m0")), F.col("persona"), R.policy(F.col("intent_type"), strict=True)))
    return R.unified(rows, source, key, F.col("question"), F.col("implicit_persona"), one, _map(split=F.lit("implicit_single"), intent=F.col("intent"), reason=F.col("reason")))


def from_multi(rows: DataFrame, source: str, prefix: str, position: str = "pos") -> DataFrame:
    """(question, persona array, implicit_persona array, intent_type letters): a memory per letter."""
    key = numbered(prefix, position)
    policies = F.transform(R.letter_labels(F.col("intent_type")), lambda c: R.policy(c, strict=True))
    context = F.array_join("implicit_persona", "\n\n")
    return R.unified(rows, source, key, F.col("question"), context, R.parallel_memories(F.col("persona"), policies, key), _map(split=F.lit("implicit_multi")))


def from_flags(rows: DataFrame, source: str, prefix: str, position: str = "pos") -> DataFrame:
    """(task, prompt, preference_attribute array, preference_label array<boolean>)."""
    key = numbered(prefix, position)
    memories = R.parallel_memories(F.col("preference_attribute"), F.transform("preference_label", R.flag_policy), key)
    return R.unified(rows, source, key, F.col("task"), F.col("prompt"), memories, _map(task=F.col("task")))


def from_levels(rows: DataFrame, source: str) -> DataFrame:
    """(sample_id, query, history, level): the whole history is the one memory, the context is empty."""
    level = F.col("level")
    one = F.array(
        F.struct(
            F.lit("history").alias("memory_id"), F.col("history").alias("memory_text"), R.level_policy(level).alias("gold_policy"), level.cast("double").alias("gold_score")
        )
    )
    return R.unified(rows, source, F.col("sample_id"), F.col("query"), F.lit(""), one, _map(level=level))


def persona_context(summary: Column, lists: dict[str, Column], human: Column, person: Column, time: Column, history: Column) -> Column:
    """Labelled lines of the parts that are there; then the history: the elements of a JSON list, the text
    itself if it is no JSON, nothing if it is JSON of another kind."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    joined = [line(k, F.array_join(v, ", ")) for k, v in lists.items()]
    roles = F.when(human.isNotNull() | person.isNotNull(), F.concat(F.lit("Participants: human="), F.coalesce(human, F.lit("")), F.lit("; virtual_person="), F.coalesce(person, F.lit(""))))
    head = F.concat_ws("\n", line("Persona summary", summary), *joined, roles, line("Current query time", time))
    parsed = F.try_parse_json(history)
    elements = F.array_join(F.from_json(history, "array<string>"), "\n")
    said = F.when(parsed.isNull(), history).when(F.schema_of_variant(parsed).startswith("ARRAY"), elements)
    return F.concat(head, F.when((F.coalesce(history, F.lit("")) != "") & said.isNotNull(), F.concat(F.lit("\n\nDialogue history:\n"), said)).otherwise(""))


def from_lists(rows: DataFrame, source: str, prefix: str) -> DataFrame:
    """(id, query, must, nice, irr arrays, summary, traits, style, domains, values, human, virtual_person,
    query_time, history)."""
    key = F.concat(F.lit(f"{prefix}_"), F.col("id").cast("string"))
    lists = {"Traits": F.col("traits"), "Style": F.col("style"), "Domains": F.col("domains"), "Values": F.col("values")}
    context = persona_context(F.col("summary"), lists, F.col("human"), F.col("virtual_person"), F.col("query_time"), F.col("history"))
    return R.unified(rows, source, key, F.col("query"), context, R.ranked_lists(F.col("must"), F.col("nice"), F.col("irr"), key), _map(query_time=F.col("query_time")))


def prompt_heads(memories: DataFrame, chars: int) -> DataFrame:
    """sample_id, head: of each sample the first memories (pos, text cut to chars), in order of pos and text, that the first chars
    characters of a list of all but one of its memories can reach. Places in the list are found from lengths alone."""
    lines = chars // 4 + 2  # a line has four characters at least: a digit, a point, a space, and its end
    short = memories.select("sample_id", "pos", F.substring(F.coalesce("memory_text", F.lit("")), 1, chars).alias("text"))
    places = short.groupBy("sample_id", "pos").agg(F.sum(F.length("text") + 4).alias("chars"))
    w = Window.partitionBy("sample_id").orderBy("pos")
    places = places.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= lines).withColumn("_to", F.sum("chars").over(w))
    reached = places.where(F.col("_to") - F.col("chars") < 2 * chars + 4).select("sample_id", "pos")  # the one left out has chars + 4 at most
    rows = short.join(reached, ["sample_id", "pos"]).withColumn("_n", F.row_number().over(Window.partitionBy("sample_id", "pos").orderBy("text"))).where(F.col("_n") <= lines)
    return rows.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("head"))


def render_streams(memories: DataFrame, contexts: DataFrame, template: str, kinds: tuple[str, ...] = ("full", "without", "only")) -> DataFrame:
    """sample_id, kind, memory_id, prompt: one prompt for each counterfactual stream of R.removal_streams, the template filled with the
    context and the memories that the stream keeps, numbered anew, both cut as T.system_prompt cuts them.

    memories: a row (sample_id, memory_id, pos, memory_text) each, listed by pos, then text; a null text is an empty line. contexts: a row
    (sample_id, context) each. A cut list shows a sample's first memories only, so a stream needs these and its own memory."""
    from ..functions import text as T

    chars = T.LIMITS[1]
    cut = lambda text, n: F.substring(F.coalesce(text, F.lit("")), 1, n)
    listed = lambda kept: cut(T.numbered_list(F.transform(kept, lambda m: F.struct(m["text"].alias("text")))), chars)
    heads = prompt_heads(memories, chars).join(contexts.select("sample_id", cut(F.col("context"), T.LIMITS[0]).alias("context")), "sample_id", "left").withColumn("all", listed(F.col("head")))
    stream = lambda kind, text: F.struct(F.lit(kind).alias("kind"), T.system_prompt(template, F.col("context"), text).alias("prompt"))
    alone = [stream(k, F.col("all") if k == "full" else F.lit("")) for k in ("full", "empty") if k in kinds]
    own = F.struct("pos", "text")
    at = F.array_position("head", own).cast("int")  # of one of equal rows; 0: beyond what the list shows
    rest = F.when(at == 0, F.col("all")).otherwise(listed(F.concat(F.slice("head", F.lit(1), at - 1), F.slice("head", at + 1, F.size("head")))))
    each = [stream(k, {"without": rest, "only": listed(F.array(own))}[k]) for k in ("without", "only") if k in kinds]
    parts = []
    if alone:
        parts.append(heads.select("sample_id", F.lit(None).cast("string").alias("memory_id"), F.explode(F.array(*alone)).alias("s")))
    if each:
        rows = memories.select("sample_id", F.col("memory_id").cast("string").alias("memory_id"), "pos", cut(F.col("memory_text"), chars).alias("text"))
        parts.append(rows.join(heads, "sample_id").select("sample_id", "memory_id", F.explode(F.array(*each)).alias("s")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("sample_id", "s.kind", "memory_id", "s.prompt")


#: What makes a prompt of row columns: context, query, the memories kept, all memories.
Renderer = Callable[[Column, Column, Column, Column], Column]
#: Renderers by name.
RENDERERS: dict[str, Renderer] = {}


def renderer(name: str, make: Renderer) -> None:
    """Registers how prompts of a style are made; another one under the same name is an error."""
    if RENDERERS.setdefault(name, make) is not make:
        raise ValueError(f"there is a renderer {name}")


def system_renderer(template: str) -> Renderer:
    from ..functions import text as T

    listed = lambda kept: T.numbered_list(F.transform(kept, lambda m: F.struct(m["memory_text"].alias("text"), m["gold_policy"].alias("policy"))))
    return lambda context, query, kept, everyone: T.system_prompt(template, context, listed(kept))


def official_renderer(template: str) -> Renderer:
    from ..functions import text as T

    return lambda context, query, kept, everyone: T.official_prompt(template, F.transform(kept, lambda m: m["memory_text"]), F.size(everyone) == 1, query)


def render_layout(samples: DataFrame, layout: str, style: str | Renderer) -> DataFrame:
    """sample_id, stream, kind, prompt: a layout's prompts in a registered style, or by a renderer. memories need a coefficient c."""
    make = RENDERERS[style] if isinstance(style, str) else style
    streams = R.stream_layout(samples, layout).join(samples.select("sample_id", "context", "query", "memories"), "sample_id")
    kept = F.filter("memories", lambda m: F.array_contains("kept", m["memory_id"]))
    return streams.select("sample_id", "stream", "kind", make(F.col("context"), F.col("query"), kept, F.col("memories")).alias("prompt"))


def input_report(samples: DataFrame, calibration: DataFrame) -> DataFrame:
    """Samples, groups (query_id of the metadata, else sample_id) and calibration groups."""
    group = F.coalesce(F.try_element_at("metadata", F.lit("query_id")), F.col("sample_id"))
    g = samples.select(group.alias("group_id")).join(calibration.select("group_id").distinct().withColumn("c", F.lit(1)), "group_id", "left")
    return g.agg(F.count("*").alias("samples"), F.countDistinct("group_id").alias("groups"), F.countDistinct(F.when(F.col("c") == 1, F.col("group_id"))).alias("calibration_groups"))
