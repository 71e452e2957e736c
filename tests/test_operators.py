"""Golden cases of the operators, with values worked out by hand."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from mnemora.functions import parse as P
from mnemora.functions import text as T
from mnemora.functions import vectors as V
from mnemora.operators import compose as C
from mnemora.operators import gates as G
from mnemora.operators import journal as J
from mnemora.operators import ranking as K
from mnemora.operators import readout as O
from mnemora.operators import records as R
from mnemora.operators import relational as L
from mnemora.operators import unify as U
from mnemora.operators import validate as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_labels_and_targets(spark):
    rows = spark.createDataFrame([(x,) for x in ("must", "nice", "irr", "A", "以偏好为主线", "what")], "l string")
    assert [r[0] for r in rows.select(R.policy(F.col("l"))).collect()] == ["dominate", "support", "ignore", "ignore", "dominate", None]
    with pytest.raises(Exception, match="unknown label"):
        rows.select(R.policy(F.col("l"), strict=True)).collect()
    assert one(spark, R.signed_target(F.lit(5), True)) == 1 and one(spark, R.signed_target(F.lit(0.5), False)) == 0 and one(spark, R.signed_target(F.lit(9), True)) is None
    assert [r[0] for r in spark.range(1, 6).select(R.level_policy(F.col("id"))).collect()] == ["ignore", "support", "support", "support", "dominate"]


def test_memory_builders(spark):
    texts, labels = F.array(*map(F.lit, ["p", "q", "r"])), R.letter_labels(F.lit("ACAA"))
    m = one(spark, R.zipped_memories(texts, labels, F.lit("s")))
    assert [(x["memory_id"], x["gold_policy"], x["gold_score"]) for x in m] == [("s_m0", "ignore", 0.0), ("s_m1", "dominate", 1.0), ("s_m2", "ignore", 0.0)]
    m = one(spark, R.ranked_lists(F.array(F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("b")), F.lit("k")))
    assert [(x["memory_text"], x["gold_policy"]) for x in m] == [("a", "dominate"), ("b", "ignore")]
    lo, hi = R.layer_window(F.lit(36))
    assert (one(spark, lo), one(spark, hi)) == (16, 24)


def test_expansion_skips_blank_rows(spark):
    df = spark.createDataFrame([("q", "c"), (" ", "c"), ("q", None)], "query string, context string")
    assert R.expand_levels(df, [1, 2], True).count() == 3


def test_limit_comes_before_resume(spark):
    rows, done = spark.range(10).withColumnRenamed("id", "uid"), spark.createDataFrame([(2,), (9,)], "uid long")
    assert sorted(r["uid"] for r in R.without_done(rows, done, "uid", "uid", 1, 4).collect()) == [1, 3, 4]


def test_streams(spark):
    s = spark.createDataFrame([("s", [("a",), ("b",)])], "sample_id string, memories array<struct<memory_id:string>>")
    got = {(r["kind"], r["memory_id"]): r["removed"] for r in R.removal_sets(s, ("full", "without", "only", "empty")).collect()}
    assert got == {("full", None): [], ("without", "a"): ["a"], ("without", "b"): ["b"], ("only", "a"): ["b"], ("only", "b"): ["a"], ("empty", None): ["a", "b"]}
    c, p = arr(1, 0, -1), F.array(*map(F.lit, ["dominate", "support", "ignore"]))
    modes = ("leave_one_out", "isolated", "joint_isolated", "hybrid", "policy_grouped", "policy_ordered", "grouped")
    assert [one(spark, R.stream_count(m, c, p)) for m in modes] == [4, 7, 7, 10, 3, 3, 2]
    with pytest.raises(ValueError, match="policies"):
        R.stream_count("grouped", c)


def test_stream_layouts(spark):
    s = spark.createDataFrame([("s", [("a", 1.0), ("b", 0.0), ("c", -1.0)])], "sample_id string, memories array<struct<memory_id:string,c:double>>")
    got = {x: [(r["kind"], "".join(r["kept"])) for r in R.stream_layout(s, x).orderBy("stream").collect()] for x in R.LAYOUTS}
    assert got["leave_one_out"] == [("full", "abc"), ("without", "bc"), ("without", "ac"), ("without", "ab")]
    assert got["isolated"] == [("full", "abc"), ("only", "a"), ("empty", ""), ("only", "b"), ("empty", ""), ("only", "c"), ("empty", "")]
    assert got["joint_isolated"][0] == ("clean", "ab") and got["joint_isolated"][1:] == got["isolated"][1:]
    assert got["hybrid"][1:4] == [("only", "a"), ("empty", ""), ("without", "bc")] and len(got["hybrid"]) == 10
    assert got["policy_grouped"] == [("full", "abc"), ("without_negative", "ab"), ("without_positive", "bc")]
    assert got["policy_ordered"] == [("full", "abc"), ("clean", "ab"), ("without_positive", "b")]
    assert got["grouped"] == [("clean", "ab"), ("clean_without", "b")]
    none = s.select("sample_id", F.array().cast("array<struct<memory_id:string,c:double>>").alias("memories"))
    assert [R.stream_layout(none, x).count() for x in R.LAYOUTS] == [1] * 7


def test_renderers(spark):
    U.RENDERERS.clear()
    U.renderer("official", U.official_renderer("{persona}|{question}"))
    with pytest.raises(ValueError, match="renderer"):
        U.renderer("official", U.system_renderer("x"))
    kind = "sample_id string, context string, query string, memories array<struct<memory_id:string,memory_text:string,gold_policy:string,c:double>>"
    s = spark.createDataFrame([("1", "", "q", [("a", "{question}", "support", 1.0)]), ("2", "", "q", [("a", "x", "support", 1.0), ("b", "it's", "ignore", -1.0)])], kind)
    got = {(r["sample_id"], r["stream"]): r["prompt"] for r in U.render_layout(s, "leave_one_out", "official").collect()}
    assert got == {("1", 0): "{question}|q", ("1", 1): "|q", ("2", 0): "['x', \"it's\"]|q", ("2", 1): "[\"it's\"]|q", ("2", 2): "['x']|q"}
    U.RENDERERS.clear()


def test_records_and_splits(spark):
    kind = "sample_id string, query string, memories array<struct<memory_id:string,memory_text:string,gold_policy:string,gold_score:double>>, source string"
    s = spark.createDataFrame([("1", " A  b", [("m", "t", "ignore", 0.0)], "x"), ("2", "q", [("m", "t", "dominate", 1.0), ("n", "t", "ignore", 0.0)], "x")], kind)
    rows = R.native_records(s, {"ignore": "not_apply", "dominate": "apply"}).orderBy("sample_id", "memory_id").collect()
    assert [(r["regime"], r["label"]) for r in rows] == [("single", "not_apply"), ("multi", "apply"), ("multi", "not_apply")]
    with pytest.raises(Exception, match="unexpected label"):
        R.native_records(s, {"ignore": "x"}).collect()
    keyed = R.keyed_items(s, F.col("sample_id"), spark.createDataFrame([("1",)], "group_id string")).orderBy("uid").collect()
    assert [(r["uid"], r["split"], r["query_key"]) for r in keyed] == [("1::m", "calibration", "a b"), ("2::m", "heldout", "q"), ("2::n", "heldout", "q")]
    with pytest.raises(Exception, match="no prediction"):
        R.chosen_policies(spark.createDataFrame([("u",)], "uid string"), spark.createDataFrame([], "uid string, policy string"), "predicted", strict=True).collect()
    assert [r["kind"] for r in R.judge_tasks(s, native=True).collect()] == ["native", "native"]
    p = R.project_split(spark.range(100).select("id", (F.col("id") % 10).alias("p")), "p", 0.5, 3)
    assert X.disjoint(p, "p", "split").count() == 0 and p.select("p", "split").distinct().groupBy("split").count().count() == 2
    assert sorted(r["id"] for r in R.head_per(p, ["p"], ["id"], 1).collect()) == list(range(10))


@pytest.mark.parametrize(
    ("text", "want"),
    [("<think>{no}</think> {\"a\": 1} end", '{"a": 1}'), ("x ```json\n{\"a\": {\"b\": 2}}\n``` y", '{"a": {"b": 2}}'), ("[1, 2]", None), ("no json", None), ("{broken", None)],
)
def test_extract_json(spark, text, want):
    assert one(spark, P.extract_json(F.lit(text))) == want


def test_verdicts(spark):
    assert one(spark, P.single_verdict(F.lit('{"match": true}'))) is True and one(spark, P.single_verdict(F.lit('{"match": "true"}'))) is None
    v = lambda js, slots: one(spark, P.multi_verdict(F.lit(js), F.lit(slots)))
    assert v('{"match": "1/2", "full_match": false}', 2)["matched"] == 1 and v('{"match": "1/2", "full_match": true}', 2)["consistent"] is False
    assert v('{"match": "1/2", "full_match": false}', 3) is None and v('{"match": "3/2", "full_match": false}', 2) is None
    m = lambda js: one(spark, P.bounded_metric(F.lit(js), "safety"))
    assert m('{"safety": 9}') == 5 and m('{"safety": "2.5"}') == 2.5 and m('{"other": 1}') is None
    assert one(spark, P.parse_label(F.lit('{"label": "follow"}'))) == "follow" and one(spark, P.parse_label(F.lit("they do_not_follow it"))) == "do_not_follow"
    rating = lambda t: one(spark, P.parse_rating(F.lit(t)))
    assert rating("Rating: [[1]] no, rating: [[4]]") == 4 and rating("text\n**Final score: 3/5**\n") == 3 and rating("[[7]]") is None and rating("3/5") is None and rating("nothing") is None
    assert rating("Task  Fulfillment = [ 2 / 5 ]") == 2 and rating("score 3") is None and rating("final rating: 6") is None and rating("Score: 4] extra") is None
    assert rating("Rating: 2\nthanks") == 2 and rating("Rating: 2\nscore=5") == 5
    fenced = 'as {notes} say ```json\n{"overall_memory_dependence_score": 3}\n```'
    assert one(spark, P.parse_score(F.lit(fenced))) is None  # from the first brace to the last is no JSON
    assert one(spark, P.parse_score(F.lit(fenced.replace("{notes}", "notes")))) == 3
    six = '"OPB": 1, "UPB": 9, "RII": -1, "FM": "2", "VG": true, "Judge": 3'
    full = one(spark, P.verdict(F.lit('{%s, "match": true, "reason": "r"}' % six), F.lit(1)))  # noqa: UP031
    assert full["metrics"] == {"OPB": 1, "UPB": 5, "RII": 0, "FM": 2, "VG": 1, "Judge": 3} and full["full_match"] is True and full["reason"] == "r"
    assert one(spark, P.verdict(F.lit('{"OPB": 1, "match": true}'), F.lit(1))) is None and one(spark, P.verdict(F.lit('{%s, "match": "1/2"}' % six), F.lit(2))) is None  # noqa: UP031
    score = lambda v: one(spark, P.parse_score(F.lit('{"overall_memory_dependence_score": %s}' % v)))  # noqa: E731, UP031
    assert [score(x) for x in ("5", "3.0", "6", "true", "2.5")] == [5, 3, None, None, None]


def test_text(spark):
    df = spark.createDataFrame([("Ｆoo  STRAẞE　x",)], "t string")
    assert df.select(T.normalize("t")).first()[0] == "foo strasse x"
    assert one(spark, T.mask_reliance_tag(F.lit(" [memory-reliance: STRONG]  hello "))) == "hello"
    assert one(spark, T.with_instruction(F.lit(" q "), F.lit("i "))) == "i\n\n---\n\nq" and one(spark, T.with_instruction(F.lit(" q "), F.lit(""))) == "q"
    reps = spark.createDataFrame([("a" * 19,), ("xx" + "a" * 20,), ("ab" * 10,), ("abcd" * 10,), ("-" * 30,), (None,)], "t string").select(T.repetition("t").alias("r")).collect()
    assert [r["r"]["unit"] for r in reps] == [None, "a", None, "abcd", None, None] and reps[1]["r"]["offset"] == 2
    assert one(spark, T.without_line(F.lit("a\nb\nc"), F.lit("b"))) == "a\nc" and one(spark, T.without_line(F.lit("b\nb"), F.lit("b"))) is None
    js = spark.createDataFrame([('{"b":1,"a":[1,2],"é":"x"}',)], "t string")
    assert js.select(T.canonical_json("t")).first()[0] == '{"a": [1, 2], "b": 1, "é": "x"}'
    assert spark.createDataFrame([(["a", "it's"],)], "t array<string>").select(T.python_list("t")).first()[0] == "['a', \"it's\"]"
    assert one(spark, T.find_in_order(F.lit("ab ab x"), F.array(*map(F.lit, ["ab", "ab", "zz", "x"])))) == [0, 3, -1, 6]
    assert [m["role"] for m in one(spark, T.messages(F.lit(" "), F.lit("u")))] == ["user"]
    assert one(spark, T.contains_cjk(F.lit("日本"))) is True


def test_vectors(spark):
    assert one(spark, V.tangent_transport(arr(1, 0), arr(0, math.pi / 2))) == pytest.approx([0, 1])
    assert one(spark, V.tangent_transport(arr(1, 0), arr(5, 0))) == [1, 0]
    assert one(spark, V.radial_projection(arr(0, 2), arr(3, 4))) == [0, 5]
    assert sum(one(spark, V.softmax(arr(1, 2, 3)))) == pytest.approx(1)
    assert one(spark, V.position_ids(F.array(*map(F.lit, [0, 1, 1])))) == [0, 0, 1] and one(spark, V.last_position(F.array(*map(F.lit, [0, 0])))) == 0


def test_composition(spark):
    d = F.array(F.struct(F.lit(1.0).alias("c"), arr(1, 0).alias("d")), F.struct(F.lit(-1.0).alias("c"), arr(0, 2).alias("d")), F.struct(F.lit(0.5).alias("c"), arr(2, 0).alias("d")))
    assert one(spark, C.transport_sum(d, 2)) == [2, -2] and one(spark, C.signed_mean(d, 2)) == [1, -2]
    assert one(spark, C.hybrid(F.lit(1.0), arr(1, 0), arr(-1, 0))) == [1, 0]
    assert one(spark, C.policy_ordered(arr(2, 2), arr(1, 1), arr(0, 1), F.lit(-1.0), F.lit(1.0))) == [2, 1]
    assert one(spark, C.counterfactual_logits(arr(1, 1), F.array(arr(0, 1), arr(1, 3)), arr(0, 0), 2)) == [1, 1]


def test_gram(spark):
    def solve(*deltas):
        return C.gram(spark.createDataFrame([(1, list(deltas))], "k long, deltas array<struct<c:double,d:array<double>>>"), "k").first()["moved"]

    assert solve((1.0, [1.0, 0.0]), (-1.0, [0.0, 2.0])) == pytest.approx([1, -2])
    assert solve((0.5, [2.0, 2.0])) == [1, 1]
    assert solve((1.0, [1.0, 0.0]), (1.0, [3.0, 0.0])) == pytest.approx([2, 0])


def test_gates(spark):
    zero = arr(0, 0, 0)
    assert one(spark, G.kl_gate(arr(1, 2, 3), zero)) == pytest.approx(0) and one(spark, G.fisher_gate(arr(1, 2, 3), zero)) == 1
    assert one(spark, G.kl_gate(arr(9, 0, 0), arr(-50, 0, 0))) == 2
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 0.0), (3, float("nan"))], "s long, m double")
    got = [r[0] for r in df.select("s", "m", G.bounded_attention(F.col("m"), ["s"]).alias("g")).orderBy("s", "m").select("g").collect()]
    assert got == pytest.approx([0.5 + 1 / 3, 0.5 + 3 / 5, 1, 1])
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, -1.0), (1, 3.0), (2, nan), (2, 3.0), (3, inf), (3, 1.0), (4, -3.0), (4, 1.0), (5, 1.0), (5, 4.0)], "s long, m double")
    got = {(r["s"], i): (r["b"], r["n"]) for i, r in enumerate(df.select("s", "m", G.bounded_attention(F.col("m"), ["s"]).alias("b"), G.normalized_attention(F.col("m"), ["s"]).alias("n")).orderBy("s", "m").collect())}
    assert [x[0] for x in got.values()][:2] == pytest.approx([0.5, 0.5 + 3 / 4.5])  # a negative mass counts as none
    assert [x[1] for x in got.values()] == pytest.approx([0.25, math.sqrt(3), 1, 1, 0.25, 1, 1, 1, math.sqrt(0.4), math.sqrt(1.6)])
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, nan), (1, 2, -4.0), (1, 3, 6.0)], "s long, t int, x double")
    assert [r[0] for r in df.select("t", G.temporal(F.col("x"), ["s"], "t").alias("g")).orderBy("t").select("g").collect()] == pytest.approx([1.0, 0.5, 0.5, 1.25])
    assert [one(spark, G.condition_gate(c, F.lit(0.5), arr(1, 2), arr(0, 0))) for c in G.CONDITIONS] == pytest.approx([0.5, 1, 0.5, 1, 0, 0])
    assert one(spark, G.shifted(F.array(F.lit(0), F.lit(2)), F.lit(10), F.lit(4))) == [6, 8]
    assert one(spark, G.attention_state(arr(3), arr(1), F.lit(2.0), F.lit(0.5), F.lit(4.0), "both")[0]) == [2] and one(spark, G.attention_state(arr(3), arr(1), F.lit(2.0), F.lit(0.5), F.lit(4.0), "steer")[1]) == 8
    assert one(spark, G.attention_mass(F.array(arr(1, 2), arr(3, 4)), F.array().cast("array<int>"))) == 0 and one(spark, G.attention_mass(F.array(arr(1, 2), arr(3, 4)), F.array(F.lit(0), F.lit(1)))) == 2.5


def test_sampling(spark):
    logits = F.array(*[F.log(F.lit(x)) for x in (0.5, 0.25, 0.25)])
    assert [x["token"] for x in one(spark, G.nucleus(logits, 0.5))] == [0] and [x["token"] for x in one(spark, G.nucleus(logits, 0.51))] == [0, 1]
    kept = G.nucleus(logits, 1.0)
    assert [one(spark, G.sample(kept, F.lit(u))) for u in (0.0, 0.5, 0.51, 0.76, 1.0)] == [0, 0, 1, 2, 2]
    assert one(spark, G.greedy(arr(1, 3, 3))) == 1


def test_neighbours_exclude_own_group_and_key(spark):
    rows = [(1, 1, "a", [[1.0, 0.0]], 0.0), (2, 1, "b", [[0.9, 0.1]], -1.0), (3, 2, "a", [[0.8, 0.2]], 0.5), (4, 3, "c", [[0.0, 1.0]], 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, grp long, query_key string, layers array<array<double>>, value double")
    got = {r["vec_id"]: r for r in O.nearest(df.where("vec_id = 1"), df.where("vec_id > 1"), 3, 0.1).collect()}
    assert got[1]["effective_k"] == 1 and got[1]["value"] == 1.0
    with pytest.raises(Exception, match="no reference"):
        O.nearest(df.where("vec_id = 1"), df.where("vec_id < 3"), 3, 0.1).collect()
    assert O.nearest(df.where("vec_id = 1"), df.where("vec_id < 3"), 3, 0.1, strict=False).count() == 0
    for k, t in ((0, 0.1), (1, 0.0), (1, float("inf"))):
        with pytest.raises(ValueError, match="temperature"):
            O.nearest(df, df, k, t)
    odd = df.withColumn("layers", F.when(F.col("vec_id") == 2, F.array(F.array(F.lit(1.0)))).otherwise(F.col("layers")))
    with pytest.raises(ValueError, match="shapes"):
        O.nearest(df, odd, 1, 0.1)


def test_blocks_of_references_change_nothing(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(12)), int(rng.integers(5)), [rng.normal(0, 1, 4).tolist() for _ in range(2)], float(rng.integers(3) - 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, grp long, query_key long, layers array<array<double>>, value double")
    unit = np.array([np.concatenate([np.array(v) / np.linalg.norm(v) for v in r[3]]) for r in rows])
    want = {}
    for i, g, q, _, _ in rows:
        best = {}
        for j, h, p, _, value in rows:
            if g != h and q != p:
                s = (round(float(unit[i] @ unit[j]) / 2, 9), -j, value)
                best[h] = max(best.get(h, s), s)
        top = sorted(best.values(), reverse=True)[:3]
        w = np.exp((np.array([t[0] for t in top]) - top[0][0]) / 0.1)
        want[i] = float((w * [t[2] for t in top]).sum() / w.sum())
    for size in (O.BLOCK_BYTES, 2000):
        got = {r["vec_id"]: r["value"] for r in O.nearest(df, df, 3, 0.1, block_bytes=size).collect()}
        assert got == pytest.approx(want, abs=1e-6)


def test_centroids_and_macro_recall(spark):
    rows = [(i, 0, c, 0, i, v) for i, (c, v) in enumerate([(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.0, 1.0]), (1, [0.1, 0.9])])]
    df = spark.createDataFrame(rows, "vec_id long, layer long, cls long, regime long, grp long, v array<double>")
    assert all(r["prediction"] == r["cls"] for r in O.predict(df, df, ["layer"], "vec_id").collect())
    assert {r["vec_id"]: r["prediction"] for r in O.leave_group_out(df).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    p = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 2, 0)], "layer long, cls long, prediction long")
    assert O.class_metrics(p, ["layer"], ordinal=True).first()["level_mae"] == 1.0
    assert {r["cls"]: (r["n"], r["recall"]) for r in O.class_recalls(p, ["layer"]).collect()} == {0: (2, 0.5), 2: (1, 0.0)}
    ref = spark.createDataFrame([(0, 0.5, 0.5), (1, 0.5, 0.6)], "layer long, macro_recall double, accuracy double")
    out = O.layer_report(ref, spark.createDataFrame([(0, 0.2, 0.3), (1, 0.4, 0.1)], "layer long, macro_recall double, accuracy double")).first()
    assert (out["layer"], out["held_macro_recall"], out["held_accuracy"], out["peak_layer"]) == (0, 0.2, 0.3, 1)
    m = O.class_metrics(spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 2, 2)], "layer long, cls long, prediction long"), ["layer"]).first()
    assert m["macro_recall"] == 0.75 and m["classes"] == 2


def test_ranks_and_cover(spark):
    g = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", ["y"]), ("d", ["z"]), ("e", ["z"])], "g string, labels array<string>")
    r = K.hash_rank(g, "g", 1)
    order = sorted("abcde", key=lambda k: hashlib.sha256(f"rq1-reference|1|{k}".encode()).hexdigest())
    assert [x["g"] for x in r.orderBy("rank").collect()] == order and [x["rank"] for x in K.hash_rank(g, "g", 1, digits=1).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    z = min("de", key=order.index)
    assert K.greedy_cover(r, "g", "labels", "rank", ["x", "y", "z"], 1, 3) == ["b", z, next(k for k in order if k not in ("b", z))]
    for wanted, seen, count, error in ((["x", "y", "z"], 1, 1, "not 1"), (["x", "w"], 1, 2, "w"), (["x", "y", "z"], 2, 6, "not 6"), (["z"], 3, 4, "less than 3")):
        with pytest.raises(ValueError, match=error):
            K.greedy_cover(r, "g", "labels", "rank", wanted, seen, count)
    df = spark.createDataFrame([("k", 1, "u"), ("k", 2, "v")], "k string, o int, s string")
    assert K.last_per_key(df, ["k"], ["o"]).first()["s"] == "v"
    t = spark.createDataFrame([("k", 1.0, 2), ("k", 1.0, 1)], "k string, s double, pos int")
    assert K.best_per_key(t, ["k"], "s", ["pos"]).first()["pos"] == 1
    assert one(spark, K.allocation(F.lit(10), F.lit(100), 0.25)) == 3


def test_router(spark):
    e = spark.createDataFrame([("u", 1, 40.0, False), ("u", 2, 5.0, True), ("u", 3, 5.0, True), ("v", 1, 10.0, False), ("w", 5, 1.0, True), ("w", 6, 50.0, False)], "e string, o int, l double, f boolean")
    got = {r["e"]: (round(r["latency"], 9), r["count"], r["failures"], r["until"]) for r in J.router_replay(e, "e", "o", "l", "f").collect()}
    assert got == {"u": (90.0, 3, 2, 243.0), "v": (26.0, 1, 0, 0.0), "w": (82.0, 2, 0, 125.0)}
    start = J.router_start(spark.createDataFrame([("u", True, 0.0), ("v", False, 7.0)], "endpoint string, reachable boolean, at double"))
    got = {r["e"]: (r["latency"], r["until"]) for r in J.router_replay(e.where("e = 'v'"), "e", "o", "l", "f", start).collect()}
    assert got == {"v": (74.0, 307.0)} and one(spark, J.rest(F.lit(9))) == 480.0
    w = J.ewma(e.where("e = 'u'"), ["e"], "o", "l").first()
    assert w["latency"] == pytest.approx(((30 * 0.8 + 40 * 0.2) * 0.8 + 1) * 0.8 + 1) and w["n"] == 3
    s = spark.createDataFrame([("a", 1.0, 0), ("b", None, 2)], "key string, valid_value double, invalid long")
    x = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "j")], "key string, kind string")
    assert {r["kind"]: (r["expected"], r["valid"]) for r in J.valid_by_kind(s, x, "key", "kind").collect()} == {"k": (2, 1), "j": (1, 0)}


def test_router_and_ewma_of_a_key_in_many_parts(spark):
    import random

    r = random.Random(5)
    log = [("hot" if r.random() < 0.8 else "ab"[r.random() < 0.5], i, float(r.randrange(1, 200)), r.random() < (0.9 if i // 40 % 2 else 0.2)) for i in range(900)]
    log += [("bad", i, 1.0, True) for i in range(5)] + [("good", i, 2.0, None) for i in range(300)]
    state, smooth = {}, {}
    for k, o, s, f in log:
        l, n, bad, until = state.get(k, (30.0, 0, 0, 0.0))
        bad = bad + 1 if f else 0
        state[k] = (max(l, 90.0) if f else 0.8 * l + 0.2 * s, n + 1, bad, o + min(600.0, 60 * 2 ** min(bad, 3)) if f else until)
        smooth[k] = 0.8 * smooth.get(k, 30.0) + 0.2 * s
    r.shuffle(log)
    rows = spark.createDataFrame(log, "e string, o int, l double, f boolean")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for parts in (1, 4, 37):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            cut = J.in_parts(rows, ["e"], ["o"]).groupBy("e").agg(F.count_distinct("_part").alias("n"), F.count("*").alias("c")).collect()
            assert sum(x["c"] for x in cut) == len(log) and (parts == 1 or max(x["n"] for x in cut) > 1)
            got = {x["e"]: (x["latency"], x["count"], x["failures"], x["until"]) for x in J.router_replay(rows, "e", "o", "l", "f").collect()}
            assert got.keys() == state.keys()
            for k, x in got.items():
                assert x[0] == pytest.approx(state[k][0]) and x[1:] == state[k][1:]
            assert {x["e"]: x["latency"] for x in J.ewma(rows, ["e"], "o", "l").collect()} == pytest.approx(smooth)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_overlap_join_equals_nested_loop(spark):
    import random

    rng = random.Random(4)
    iv = lambda: [(rng.randrange(3), s := rng.randrange(200), s + rng.randrange(1, 60)) for _ in range(80)]
    a, b = iv(), iv()
    l, r = spark.createDataFrame(a, "g int, l_start long, l_end long"), spark.createDataFrame(b, "g int, r_start long, r_end long")
    got = sorted(tuple(x) for x in L.overlap(l, r, ["g"], 25).select("g", "l_start", "l_end", "r_start", "r_end").collect())
    assert got == sorted((g, s, e, t, f) for g, s, e in a for h, t, f in b if g == h and s < f and t < e)


def test_division_and_violations(spark):
    req = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a")], "sample_id string, key string")
    got = {r["sample_id"]: r["all_present"] for r in L.divide(req, req.where("sample_id = 't' or key = 'a'"), "sample_id", ["sample_id", "key"]).collect()}
    assert got == {"s": False, "t": True}
    p = spark.createDataFrame([("s::m", "s", "m", 1.0, "calibration"), ("s::m", "s", "m", float("nan"), "heldout")], "uid string, sample_id string, memory_id string, coefficient double, split string")
    assert sorted(r["constraint"] for r in X.predictions(p).collect()) == ["one_split", "prediction", "unique"]
    with pytest.raises(ValueError, match="unique"):
        X.require(X.unique(p, ["uid"]))
    X.require(X.unique(req, ["sample_id", "key"]))
    assert X.predictions(p.limit(1)).count() == 0 and X.predictions(p.limit(1), spark.createDataFrame([("s", "m"), ("s", "n")], "sample_id string, memory_id string")).first()["constraint"] == "missing"
    assert X.predictions(p.limit(1).withColumn("split", F.lit("evaluation"))).first()["detail"] == "split"
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [float("inf"), 0.0])], "i long, v array<double>")
    assert sorted(r["key"] for r in X.vectors(v, "i", "v", 2).collect()) == ["2", "3"]
    a, b = spark.createDataFrame([("x", "h1")], "k string, d string"), spark.createDataFrame([("x", "h2")], "k string, d string")
    assert X.unchanged(a, b, "k", ["d"]).count() == 1 and X.unchanged(a, a, "k", ["d"]).count() == 0


def test_repetition_is_what_the_definition_says():
    import random
    import re

    single, unit = re.compile(r"(\S)\1{19,}"), re.compile(r"(.{2,30}?)\1{9,}")
    rng, found = random.Random(3), 0
    for _ in range(1500):
        t = "".join("".join(rng.choice("ab- \n.é") for _ in range(rng.randrange(1, 7))) * rng.randrange(1, 26) for _ in range(rng.randrange(1, 5)))
        every = [(m.group(1), len(m.group()), m.start()) for p in (single, unit) for m in p.finditer(t)]
        want = next(((u, n, at) for u, n, at in every if any(c.isalnum() for c in u) and (len(u) == 1 or n >= 40)), None)
        assert T.first_repetition(t) == want, t
        found += want is not None
    assert found > 500


def test_constraints(spark):
    a = spark.createDataFrame([("s", "a", "g", "p", [[1.0, 2.0]]), ("s", "b", "x", None, [[1.0, float("nan")]])], "sample_id string, memory_id string, group_id string, gold_policy string, v array<array<double>>")
    source = spark.createDataFrame([("s", "a", "g", "p"), ("s", "b", "g", "p"), ("s", "c", "g", "p")], "sample_id string, memory_id string, group_id string, gold_policy string")
    assert sorted((r["constraint"], r["detail"]) for r in X.artifact(a, source, "v", 1, 2).collect()) == [("artifact", "group,not finite"), ("missing", "")]
    g = spark.createDataFrame([("s", "text"), ("t", "other")], "sample_id string, generated_text string")
    sha = hashlib.sha256(b"text").hexdigest()
    j = spark.createDataFrame([("s", "k", "m", "ok", "1", sha), ("s", "k", "m", "ok", "2", sha), ("u", "k", "m", "ok", "1", sha), ("t", "k", None, "error", "", sha)], "sample_id string, kind string, memory_id string, status string, judge_result string, generation_sha256 string")
    assert sorted(r["constraint"] for r in X.judgments(g, j, g.limit(1).select("sample_id")).collect()) == ["conflict", "not generated", "not in the benchmark", "other text"]
    p = spark.createDataFrame([("a", "x", "x", ["m"], ["m", "n"]), ("b", "x", "y", ["m"], ["m"])], "k string, r string, n string, spans array<string>, ids array<string>")
    assert sorted((r["constraint"], r["key"]) for r in X.prompts(p, "k", "r", "n", F.col("spans"), F.col("ids")).collect()) == [("prompt", "b"), ("span", "a")]
    now, before = spark.createDataFrame([("a", 5), ("b", 1)], "path string, bytes long"), spark.createDataFrame([("a", 4), ("b", 2), ("c", 1)], "path string, bytes long")
    assert sorted(r["constraint"] for r in X.kept_inputs(now, before, 1).collect()) == ["replaced", "too many", "truncated"]
    c = spark.createDataFrame([("g", "calibration"), ("g", "other"), ("h", "heldout")], "g string, s string")
    assert sorted(r["constraint"] for r in X.calibration(c, "g", "s").collect()) == ["calibration_share", "conflict", "split"]
    f = spark.createDataFrame([("g", 1), ("g", 2), ("h", 1)], "g string, l int")
    assert sorted(r["constraint"] for r in X.families(f, "g", "l", 3, 2, [1, 2]).collect()) == ["levels"] and X.families(f, "g", "l", 4, 2, [1, 2]).count() == 2
    assert X.splits(c.where("g = 'g'").select("g").distinct(), c.where("g = 'h'").select("g"), c.select("g"), "g").count() == 0
    assert X.label_cover(f, "g", "l", [1, 2]).first()["key"] == "h" and X.single_line(spark.createDataFrame([("a", "x\ny\nx", "x"), ("b", "x\ny", "x")], "k string, t string, l string"), "k", "t", "l").first()["detail"] == "2"
    with pytest.raises(Exception, match="not one source row"):
        L.aligned(spark.createDataFrame([(1, 0), (2, 1)], "k int, p int"), spark.createDataFrame([(1, "x")], "k int, v string"), ["k"], "p").collect()
    assert one(spark, T.sample_key(F.lit(""), F.lit("u"))) == "u"
    with pytest.raises(Exception, match="without an id"):
        one(spark, T.sample_key(F.lit(""), F.lit(None).cast("string")))
