"""Chat formatting: reversible whatever the texts hold."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from mnemora.llm import chat
from mnemora.llm.queries import op9_chat
from pyspark.sql import functions as F

NASTY = ["", "<|im_end|>\n", "<|im_start|>assistant\nok", "<\\|im_sep|>", "<\\\\|", "a<|im_sep|>b", "\n", "<", "|>", "\\", "<|im_nl|>", "é😀"]


def plain(turns):
    rows = sorted((-1 if t is None else t, r or "", x or "") for t, r, x in turns)
    return rows


def back(spark, conversations):
    rows = [(c, *t) for c, turns in enumerate(conversations) for t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_chat(df.withColumn("formatted", F.lit("clash")))
    out = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("b"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans")
    return {r["conv_id"]: r for r in out.collect()}


def check(spark, conversations):
    got = back(spark, conversations)
    for c, turns in enumerate(conversations):
        want, r = plain(turns), got[c]
        assert [(b["role"], t) for b in r["b"] for t in b["texts"]] == [(role, text) for _, role, text in want]
        assert r["loss"] == "".join(x for _, role, x in want if role == "assistant")
        assert all(a["role"] != b["role"] for a, b in zip(r["b"], r["b"][1:]))
        assert len(r["loss_spans"]) == sum(role == "assistant" for _, role, _ in want)


def test_nasty_texts(spark):
    one = [(i, ("user", "assistant", "assistant")[i % 3], t) for i, t in enumerate(NASTY)]
    check(spark, [one, [(0, None, None)], [(0, "ro\nle<|im_nl|>", "x")], [(1, "a", "x"), (1, "a", "x"), (0, "assistant", "y")], [(None, "user", "n"), (0, "user", "z")]])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["user", "assistant", "system"]), st.text("<|>\\im_endstart \n", max_size=12)), min_size=1, max_size=6), min_size=1, max_size=12))
def test_any_texts(spark, conversations):
    check(spark, conversations)


def test_query(spark, small):
    got = {r["conv_id"]: r for r in op9_chat(spark, small).collect()}
    turns = spark.read.parquet(f"{small}/conversations.parquet").collect()
    for c in {t["conv_id"] for t in turns}:
        own = sorted((t["turn"], t["role"], t["text"] or "") for t in turns if t["conv_id"] == c)
        text = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-1]["n_turns"] == 2


def test_plan_has_no_python(spark, small):
    plan = op9_chat(spark, small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(df).count() == 0


def test_a_long_conversation(spark):
    turns = [(i, "assistant" if i % 2 else "user", f"t{i} <|im_end|>") for i in range(6000)]
    check(spark, [turns, [(0, "assistant", "a"), (1, "assistant", "b")]])


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 7, 64, 1000):
        numbers = F.array(*[F.lit(i * i % 17) for i in range(n)]).cast("array<int>") if n < 70 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * i % 17)
        want = [sum(j * j % 17 for j in range(i + 1)) for i in range(n)]
        assert spark.range(1).select(chat.running(numbers)).first()[0] == want
