"""Prompts by the table function, prompts computed once, repetitions of a batch."""

import random

import pyarrow as pa
import pytest

from mnemora.functions import rendering
from mnemora.functions import text as T
from mnemora.operators import compose as C
from mnemora.operators import records as R
from mnemora.operators import unify as U
from pyspark.sql import functions as F

KIND = "sample_id string, context string, query string, memories array<struct<memory_id:string,memory_text:string,gold_policy:string,c:double>>"
ROWS = [
    ("1", "about {memories}", "q {persona}", [("a", "first's", "support", 1.0), ("b", "zweite", "ignore", -1.0), ("c", "third", "support", 0.0)]),
    ("2", "", " q ", [("a", "only {question}", "dominate", 0.5)]), ("3", None, "q", []), ("4", "x", "q", [("a", "t", "ignore", -1.0), ("b", "u", "dominate", 2.0)]),
]


def rendered(spark, layout, style, template):
    rendering.register(spark)
    samples = spark.createDataFrame(ROWS, KIND)
    return spark.sql(f"SELECT * FROM rendered(TABLE(SELECT * FROM {{s}}), layout => '{layout}', style => '{style}', template => :t)", args={"t": template}, s=samples)


@pytest.mark.parametrize("layout", R.LAYOUTS)
def test_the_table_function_equals_the_columns(spark, layout):
    samples = spark.createDataFrame(ROWS, KIND)
    for style, template, make in (("official", "P {persona} Q {question}", U.official_renderer), ("system", "C {context} M {memories}", U.system_renderer)):
        want = U.render_layout(samples, layout, make(template))
        got = rendered(spark, layout, style, template)
        assert got.columns == ["sample_id", "stream", "kind", "prompt"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_style_decides_the_columns(spark):
    got = {(r["sample_id"], r["stream"]): [tuple(m) for m in r["messages"]] for r in rendered(spark, "leave_one_out", "chat", "{context} {memories}").collect()}
    assert got["2", 0] == [("system", "1. only {question}"), ("user", "q")] and got["3", 0] == [("user", "q")]


@pytest.mark.parametrize("layout,style,error", [("none", "official", "layout none"), ("isolated", "odd", "style odd")])
def test_unknown_names_are_analysis_errors(spark, layout, style, error):
    with pytest.raises(Exception, match=error):
        rendered(spark, layout, style, "x")


def test_a_table_without_the_columns_is_refused(spark):
    rendering.register(spark)
    with pytest.raises(Exception, match="no context, query, memories"):
        spark.sql("SELECT * FROM rendered(TABLE(SELECT '1' AS sample_id), layout => 'isolated', style => 'official', template => '')")


@pytest.mark.parametrize("heavy", [1024, 2, 10**9])
def test_shared_prompts_are_computed_once(spark, heavy, tmp_path):
    rows = spark.createDataFrame([(i, f"m{i % 7} none" if i % 5 else None, "none" if i % 3 else "") for i in range(60)], "k long, only string, empty string").repartition(4)

    def compute(asked):
        def run(frames):
            for f in frames:
                for d in f["digest"]:
                    with open(tmp_path / d, "a") as out:
                        out.write("x")
                yield f.assign(v=[[float(len(p)), 1.0] for p in f["prompt"]])[["digest", "v"]]

        return asked.mapInPandas(run, "digest string, v array<double>")

    done = C.computed_once(rows, ["only", "empty"], compute, heavy)
    assert done.columns == ["k", "only", "empty", "v_only", "v_empty"]
    assert sorted((r["k"], r["v_only"][0], r["v_empty"][0]) for r in done.collect()) == [(i, float(len(f"m{i % 7} none")) if i % 5 else 0.0, 4.0 if i % 3 else 0.0) for i in range(60)]
    assert len(list(tmp_path.iterdir())) == 7 + 2 and all(p.read_text() == "x" for p in tmp_path.iterdir())
    deltas = {r["k"]: r["delta"] for r in C.isolated_differences(rows, compute).collect()}
    assert deltas[1] == [3.0, 0.0] and deltas[0] == [0.0, 0.0]


def plain_repetition(t):
    """The definition, place by place."""
    for i, c in enumerate(t):
        if c.isalnum() and t[i : i + 20] == c * 20:
            n = 20
            while t[i + n : i + n + 1] == c:
                n += 1
            return c, n, i
    i = 0
    while i < len(t):
        for p in range(2, 31):
            unit = t[i : i + p]
            if len(unit) == p and "\n" not in unit and t[i : i + 10 * p] == unit * 10:
                n = 10
                while t[i + n * p : i + (n + 1) * p] == unit:
                    n += 1
                if n * p >= 40 and any(c.isalnum() for c in unit):
                    return unit, n * p, i
                i += n * p - 1
                break
        i += 1
    return None


def test_repetitions_of_a_batch_follow_the_definition():
    rng = random.Random(4)
    texts = ["", "ab" * 30, "x" * 19, "hi " + "x" * 25, "--" * 40 + "abcd" * 12, "abc\n" * 20, "-" * 60, "é😀" * 25, "a" * 10]
    texts += ["".join("".join(rng.choice("ab -\n1é") for _ in range(rng.randrange(1, 7))) * rng.randrange(1, 25) for _ in range(rng.randrange(1, 6))) for _ in range(500)]
    got = T.first_repetitions(pa.array([*texts, None])).to_pylist()
    assert [None if g["unit"] is None else tuple(g.values()) for g in got] == [*map(plain_repetition, texts), None]
    assert sum(g["unit"] is not None for g in got) > 100


def test_labels_stand_for_themselves(spark):
    df = spark.createDataFrame([("ignore",), ("dominant",), ("other",), (None,)], "l string")
    assert [r[0] for r in df.select(R.intent(F.col("l"))).collect()] == ["忽略偏好", "以偏好为主线", "other", None]
