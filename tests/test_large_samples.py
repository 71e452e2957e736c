"""Samples of many memories: queries whose work may not grow with the square of a sample."""

import pytest
from pyspark.sql import functions as F

from mnemora.operators import records as R
from mnemora.operators import unify as U
from mnemora.plans import registry

M = 20_000


@pytest.fixture(scope="module")
def one_sample(spark, tmp_path_factory):
    """One sample of M memories, all policies in it."""
    at = str(tmp_path_factory.mktemp("one-sample"))
    i = spark.range(M).withColumnRenamed("id", "doc_id")
    text = F.concat(F.lit("memory "), F.col("doc_id").cast("string"))
    i.select("doc_id", text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length(text).cast("long").alias("n_chars")).write.parquet(f"{at}/documents.parquet")
    i.select("doc_id", (F.col("doc_id") % 4 > 0).cast("long").alias("quality"), (F.col("doc_id") % 2).alias("toxic")).write.parquet(f"{at}/labels.parquet")
    return at


def test_counterfactual_streams_of_a_large_sample(spark, one_sample):
    got = registry.QUERIES["counterfactual_streams"](spark, one_sample).groupBy("kind", "removed").count().collect()
    assert {(r["kind"], r["removed"], r["count"]) for r in got} == {("full", 0, 1), ("without", 1, M), ("only", M - 1, M)}


def test_removal_streams_are_removal_sets(spark):
    nested = spark.createDataFrame([("s", [("a",), ("b",), ("c",)]), ("t", [("a",)])], "sample_id string, memories array<struct<memory_id:string>>")
    kinds = ("full", "without", "only", "empty")
    want = sorted((r["sample_id"], r["kind"], r["memory_id"] or "", len(r["removed"])) for r in R.removal_sets(nested, kinds).collect())
    rows = nested.select("sample_id", F.explode("memories").alias("m")).select("sample_id", "m.memory_id")
    assert sorted((r["sample_id"], r["kind"], r["memory_id"] or "", r["removed"]) for r in R.removal_streams(rows, kinds).collect()) == want


def test_rendered_streams_of_a_large_sample(spark, one_sample):
    assert [tuple(r) for r in registry.QUERIES["rendered_streams"](spark, one_sample).select("sample_id", "prompts", "with_head").collect()] == [("s::en", 1 + 2 * M, 1 + 2 * M)]


def test_prompts_of_streams(spark):
    """Against lists made whole and then cut: short and long texts, empty and null ones, equal rows, samples beyond the cut."""
    memories = [("a", str(i), i, ["", "x" * 30, None, "y" * 2500, "{context}"][i % 5]) for i in range(9)]
    memories += [("b", str(i), i, "") for i in range(700)] + [("c", str(i), i, "z" * 21) for i in range(200)]
    memories += [("d", "0", 0, "same"), ("d", "0", 0, "same"), ("d", "0", 0, "other"), ("e", "0", 0, "one")]
    contexts = {"a": "A" * 3100, "b": None, "c": "C", "d": "D", "e": "E"}
    kinds = ("full", "without", "only", "empty")

    def prompt(s, kept):
        return "C: " + (contexts[s] or "")[:3000] + "\n" + "\n".join(f"{i}. {t}" for i, t in enumerate(kept, 1))[:2000]

    want = []
    for s in contexts:
        own = sorted(((m, p, t or "") for x, m, p, t in memories if x == s), key=lambda m: (m[1], m[2]))
        texts = [t for _, _, t in own]
        want += [(s, "full", "", prompt(s, texts)), (s, "empty", "", prompt(s, []))]
        want += [(s, "without", m, prompt(s, texts[:i] + texts[i + 1 :])) for i, (m, _, _) in enumerate(own)] + [(s, "only", m, prompt(s, [t])) for m, _, t in own]
    rows = spark.createDataFrame(memories, "sample_id string, memory_id string, pos int, memory_text string")
    made = U.render_streams(rows, spark.createDataFrame(list(contexts.items()), "sample_id string, context string"), "C: {context}\n{memories}", kinds)
    assert sorted((r["sample_id"], r["kind"], r["memory_id"] or "", r["prompt"]) for r in made.collect()) == sorted(want)


def test_stream_layouts_of_a_large_sample(spark, one_sample):
    neg, pos = M // 4, M // 4  # quality 0; neither, toxic 0
    got = {r["layout"]: (r["prompts"], r["kept"]) for r in registry.QUERIES["stream_layouts"](spark, one_sample).collect()}
    assert got == {
        "leave_one_out": (1 + M, M + M * (M - 1)), "isolated": (1 + 2 * M, 2 * M), "joint_isolated": (1 + 2 * M, M - neg + M), "hybrid": (1 + 3 * M, 2 * M + M * (M - 1)),
        "policy_grouped": (3, M + M - neg + M - pos), "policy_ordered": (3, M + M - neg + M - neg - pos), "grouped": (1 + pos, M - neg + pos * (M - neg - 1)),
    }


def test_layout_streams_are_stream_layouts(spark):
    kind = "sample_id string, memories array<struct<memory_id:string,c:double>>"
    nested = spark.createDataFrame([("s", [("a", 1.0), ("b", 0.0), ("c", -1.0), ("d", 1.0)]), ("t", [("a", -1.0)]), ("u", [("a", None), ("b", 0.0)])], kind)
    want = sorted((x, r["sample_id"], r["kind"], len(r["kept"])) for x in R.LAYOUTS for r in R.stream_layout(nested, x).collect())
    rows = nested.select("sample_id", F.explode("memories").alias("m")).select("sample_id", "m.memory_id", "m.c")
    assert sorted((r["layout"], r["sample_id"], r["kind"], r["kept"]) for r in R.layout_streams(rows).collect()) == want
    assert {r["layout"] for r in R.layout_streams(rows, ("grouped",)).collect()} == {"grouped"}


def test_ablation_of_a_large_sample(spark, one_sample):
    """The ignored ones of odd id go; no row holds a whole sample, whose policies were looked up one after another."""
    got = registry.QUERIES["ablation_filter"](spark, one_sample)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("s::en", M, M)]  # quality 0: ids that 4 divides


def test_ablation_is_ablate(spark):
    rows = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("s", "d"), ("t", "a")], "sample_id string, memory_id string")
    policies = spark.createDataFrame([("s", "a", "ignore"), ("s", "a", "ignore"), ("s", "b", "support"), ("s", "d", None), ("x", "a", "ignore")], "sample_id string, memory_id string, policy string")
    assert {(r["sample_id"], r["memory_id"]): r["kept"] for r in R.ablation(rows, policies).collect()} == {("s", "a"): False, ("s", "b"): True, ("s", "c"): True, ("s", "d"): True, ("t", "a"): True}
    with pytest.raises(Exception, match="two policies of s::b"):
        R.ablation(rows, policies.union(spark.createDataFrame([("s", "b", "dominate")], policies.schema))).collect()
