"""Queries over prompts, digests and verdict texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from .base import items, query, r6, samples, table
from .base import ITEMS


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies made from labels: plain, fenced, in braces, and no JSON at all."""
    l = table(spark, sf_dir, "labels")
    body = F.concat(F.lit('{"match": '), F.when(F.col("quality") == 1, "true").otherwise("false"), F.lit(', "score": '), (F.col("doc_id") % 7).cast("string"), F.lit(', "label": "'), F.when(F.col("toxic") == 1, "do_not_follow").otherwise("follow"), F.lit('"}'))
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("<think>maybe {x}</think>\nso ```json\n"), body, F.lit("\n``` done"))).when(k == 2, F.concat(F.lit("I say "), body, F.lit(" ok"))).otherwise("I would follow it")
    return l.select("doc_id", "quality", "toxic", raw.alias("raw"))


VERDICTS = """v AS (SELECT doc_id, quality, toxic, concat('{"match": ', CASE WHEN quality=1 THEN 'true' ELSE 'false' END, ', "score": ', doc_id%7, ', "label": "', CASE WHEN toxic=1 THEN 'do_not_follow' ELSE 'follow' END, '"}') AS body FROM labels),
 w AS (SELECT doc_id, quality, toxic, CASE doc_id%4 WHEN 0 THEN body WHEN 1 THEN concat('<think>maybe {x}</think>', chr(10), 'so ```json', chr(10), body, chr(10), '``` done') WHEN 2 THEN concat('I say ', body, ' ok') ELSE 'I would follow it' END AS raw FROM v),
 j AS (SELECT *, trim(regexp_replace(raw,'(?s)<think>.*?</think>','','g')) AS plain FROM w), x AS (SELECT *, coalesce(nullif(regexp_extract(plain,'(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```',1),''), nullif(regexp_extract(plain,'(?s)(\\{.*\\})',1),'')) AS js FROM j)"""


@query(f"""WITH {VERDICTS} SELECT doc_id, js AS json FROM x""")
def think_strip_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("doc_id", P.extract_json(F.col("raw")).alias("json"))


@query(f"""WITH {VERDICTS} SELECT doc_id, CAST(js->'$.match' AS BOOLEAN) AS matched, CASE WHEN js IS NOT NULL THEN least(5.0,greatest(0.0,CAST(js->'$.score' AS DOUBLE))) END AS score FROM x""")
def verdict_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir).withColumn("j", P.extract_json(F.col("raw")))
    return v.select("doc_id", P.single_verdict(F.col("j")).alias("matched"), P.bounded_metric(F.col("j"), "score").alias("score"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey%5 <= 3 AND o_orderkey%2=0 THEN CAST(o_orderkey%5 AS INT) END AS matched, CASE WHEN o_orderkey%5 <= 3 AND o_orderkey%2=0 THEN (o_orderkey%3=0) = (o_orderkey%5=3) END AS consistent FROM orders""")
def multi_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    slots = F.when(F.col("o_orderkey") % 2 == 0, 3).otherwise(4)
    js = F.concat(F.lit('{"match": " '), (F.col("o_orderkey") % 5).cast("string"), F.lit(' / 3", "full_match": '), F.when(F.col("o_orderkey") % 3 == 0, "true").otherwise("false"), F.lit("}"))
    v = o.select("o_orderkey", P.multi_verdict(js, slots).alias("m"))
    return v.select("o_orderkey", "m.matched", "m.consistent")


@query(f"""WITH {VERDICTS} SELECT doc_id, CASE WHEN js IS NOT NULL THEN js->>'$.label' ELSE nullif(regexp_extract(raw,'\\b(do_not_follow|follow)\\b',1),'') END AS label FROM x""")
def parse_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("doc_id", P.parse_label(F.col("raw")).alias("label"))


@query("""SELECT doc_id, CASE doc_id%4 WHEN 0 THEN CAST(doc_id%5+1 AS INT) WHEN 1 THEN CAST(doc_id%5+1 AS INT) WHEN 2 THEN CAST(doc_id%5+1 AS INT) END AS rating FROM labels""")
def parse_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % 5 + 1).cast("string")
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.lit("Rating: [[2]] then rating: [["), n, F.lit("]]"))).when(k == 1, F.concat(F.lit("it is fine\n**Final score: ["), n, F.lit(" / 5]**\n"))).when(k == 2, F.concat(F.lit("Rating = "), n)).otherwise("no idea, 9 of 10")
    return table(spark, sf_dir, "labels").select("doc_id", P.parse_rating(text).alias("rating"))


@query("""SELECT doc_id, CASE WHEN doc_id%4=0 AND doc_id%7 BETWEEN 1 AND 5 THEN CAST(doc_id%7 AS INT) WHEN doc_id%4=2 THEN 3 END AS score FROM labels""")
def score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("doc_id") % 4, (F.col("doc_id") % 7).cast("string")
    value = F.when(k == 0, n).when(k == 1, F.lit("true")).when(k == 2, F.lit("3.0")).otherwise(F.lit("2.5"))
    return table(spark, sf_dir, "labels").select("doc_id", P.parse_score(F.concat(F.lit('{"overall_memory_dependence_score": '), value, F.lit("}"))).alias("score"))


@query(r"""SELECT doc_id, length(m) AS chars, md5(m) AS masked_md5 FROM (SELECT doc_id, trim(regexp_replace(text, '^[ \t\n\x0b\f\r]+', ''), ' ') AS m FROM documents)""")
def tag_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, T.RELIANCE)), (F.col("doc_id") % 5 + 1).cast("int"))
    masked = T.mask_reliance_tag(F.concat(F.lit(" [memory-reliance: "), level, F.lit("] "), F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", masked.alias("m")).select("doc_id", F.length("m").cast("long").alias("chars"), F.md5("m").alias("masked_md5"))


@query("""SELECT doc_id, concat(source,'::',lang,'::',substr(md5(concat('{"lang": "',lang,'", "n": ',n_chars,'}')),1,10)) AS query_id FROM documents""")
def query_id_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"lang": "'), F.col("lang"), F.lit('", "n": '), F.col("n_chars").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", T.query_id([F.col("source"), F.col("lang")], body).alias("query_id"))


@query("""SELECT doc_id, concat(source,'::NA::',lang,'::',substr(md5(concat('{"directory_index": "',source,'", "event_id": null, "query": "q", "target": ',n_chars,', "task": "',lang,'"}')),1,10)) AS query_id FROM documents""")
def sample_query_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = T.sample_query_id(F.col("source"), F.lit(None).cast("string"), F.col("lang"), F.col("n_chars"), F.lit("q"))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("query_id"))


@query("""SELECT doc_id, CAST(concat('0x',substr(sha256(CAST(doc_id AS VARCHAR)),1,8)) AS BIGINT)+7 AS seed FROM documents""")
def stable_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.stable_seed(F.col("doc_id").cast("string"), 7).alias("seed"))


@query("""SELECT conv_id, turn, sha256(CASE WHEN turn%2=0 THEN trim(text, ' ') ELSE concat('Be brief.', chr(10), chr(10), '---', chr(10), chr(10), trim(text, ' ')) END) AS prompt_sha256 FROM conversations""")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    instruction = F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.lit(" Be brief. "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.with_instruction(F.col("text"), instruction), 256).alias("prompt_sha256"))


@query(f"""WITH {ITEMS}, k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY memory_id) AS i FROM items WHERE policy<>'ignore')
 SELECT s.sample_id, sha256(coalesce(string_agg(CASE WHEN i IS NOT NULL THEN concat(i,'. ',text,CASE policy WHEN 'support' THEN ' (This preference can enhance your response but should not dominate it)' ELSE ' (This preference MUST strongly shape your response - it is essential)' END) END, chr(10) ORDER BY i),'')) AS list_sha256 FROM (SELECT DISTINCT sample_id FROM items) s LEFT JOIN k USING (sample_id) GROUP BY 1""")
def memory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.transform("memories", lambda m: F.struct(m["memory_text"].alias("text"), m["gold_policy"].alias("policy")))
    return samples(spark, sf_dir).select("sample_id", F.sha2(T.numbered_list(pairs, hints=True, drop_ignored=True), 256).alias("list_sha256"))


@query("""SELECT doc_id, md5(concat('Context: ', substr(text,1,3000), ' / ', substr(source,1,2000))) AS prompt_md5 FROM documents""")
def system_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.system_prompt("Context: {context} / {memories}", F.col("text"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(p).alias("prompt_md5"))


@query("""SELECT conv_id, turn, CASE WHEN turn%3=0 THEN 1 ELSE 2 END::BIGINT AS n, length(trim(text, ' ')) AS chars FROM conversations""")
def message_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.messages(F.when(F.col("turn") % 3 == 0, F.lit("  ")).otherwise(F.lit("Be kind.")), F.col("text"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", m.alias("m"))
    return c.select("conv_id", "turn", F.size("m").cast("long").alias("n"), F.length(F.element_at("m", -1)["content"]).cast("long").alias("chars"))


@query("""SELECT doc_id, concat_ws(chr(10), concat('lang: ',lang), CASE WHEN quality=1 THEN 'quality: good' END, concat('id: ',doc_id)) AS card FROM documents JOIN labels USING (doc_id)""")
def labelled_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    parts = [("lang", F.col("lang")), ("quality", F.when(F.col("quality") == 1, F.lit("good")).otherwise(F.lit(" "))), ("id", F.col("doc_id").cast("string"))]
    return d.select("doc_id", T.labelled_parts(parts).alias("card"))


@query("""SELECT doc_id, CASE WHEN len(list_filter(string_split(text,chr(10)), lambda x: x = string_split(text,chr(10))[1]))=1 THEN md5(array_to_string(string_split(text,chr(10))[2:], chr(10))) END AS rest_md5 FROM documents""")
def exact_line_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.without_line(F.col("text"), F.substring_index("text", "\n", 1))).alias("rest_md5"))


@query("""SELECT s_suppkey, concat('http://h', s_suppkey, '?a=b') AS url, CASE WHEN s_suppkey%2=0 THEN CAST(s_suppkey%9 AS INT) ELSE 1 END AS cap FROM supplier""")
def endpoint_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    spec = F.concat(F.lit("http://h"), key, F.lit("?a=b"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("="), (F.col("s_suppkey") % 9).cast("string"))).otherwise(""))
    url, cap = T.endpoint(spec)
    return table(spark, sf_dir, "supplier").select("s_suppkey", url.alias("url"), cap.alias("cap"))


@query("""WITH d AS (SELECT doc_id, text, instr(text,'the') AS a FROM documents), e AS (SELECT doc_id, a, CASE WHEN a>0 THEN a+2 ELSE 0 END AS skip, text FROM d) SELECT doc_id, CAST(a-1 AS INT) AS first, CAST(CASE WHEN instr(substr(text,skip+1),'the')>0 THEN instr(substr(text,skip+1),'the')+skip-1 ELSE -1 END AS INT) AS second FROM e""")
def sequential_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.find_in_order(F.col("text"), F.array(F.lit("the"), F.lit("the")))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("f")).select("doc_id", F.get("f", F.lit(0)).alias("first"), F.get("f", F.lit(1)).alias("second"))


@query("""SELECT o_orderkey, CAST(len(list_filter(range(20), lambda i: i*5 < (o_orderkey%60)+17 AND i*5+4 > o_orderkey%60)) AS BIGINT) AS tokens, CAST(coalesce(list_min(list_filter(range(20), lambda i: i*5 < (o_orderkey%60)+17 AND i*5+4 > o_orderkey%60)),-1) AS BIGINT) AS first FROM orders""")
def span_token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct((i * 5).alias("start"), (i * 5 + 4).alias("end")))
    spans = F.array(F.struct((F.col("o_orderkey") % 60).alias("start"), (F.col("o_orderkey") % 60 + 17).alias("end")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.get(T.span_positions(spans, offsets), F.lit(0)).alias("p"))
    return o.select("o_orderkey", F.size("p").cast("long").alias("tokens"), F.coalesce(F.array_min("p"), F.lit(-1)).cast("long").alias("first"))


@query("""SELECT doc_id, (['a','b','c'])[CAST(CAST(concat('0x',substr(sha256(CAST(doc_id AS VARCHAR)),1,8)) AS BIGINT)%3+1 AS BIGINT)] AS choice FROM documents""")
def hashed_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.hashed_choice(F.array(*map(F.lit, "abc")), F.col("doc_id").cast("string")).alias("choice"))


@query()
def repetition_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("r", T.repetition("text"))
    return c.select("conv_id", "turn", "r.unit", "r.characters", "r.offset")


@query("""SELECT event_id, sha256(props) AS digest FROM events""")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tight = F.regexp_replace("props", " ", "")
    return table(spark, sf_dir, "events").select("event_id", F.sha2(T.canonical_json(tight), 256).alias("digest"))


@query("""SELECT page_id, length(trim(regexp_replace(regexp_replace(html,'<[^>]*>',' ','g'),'[ \\t\\n\\r\\f]+',' ','g'), ' ')) AS chars, CAST(len(regexp_extract_all(html,'<[a-z]+')) AS BIGINT) AS tags FROM pages""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\r\f]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).cast("long").alias("chars"), F.size(F.regexp_extract_all("html", F.lit("(<[a-z]+)"), 1)).cast("long").alias("tags"))


@query(f"""WITH {ITEMS}, t AS (SELECT policy, concat(text, CASE memory_id%3 WHEN 0 THEN ' 记忆' WHEN 1 THEN ' カナ' ELSE '' END) AS text FROM items) SELECT policy, count(*) FILTER (WHERE regexp_matches(text,'[一-鿿]')) AS cjk, round(avg(length(text)),6) AS mean_chars FROM t GROUP BY 1""")
def language_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("memory_id") % 3 == 0, " 记忆").when(F.col("memory_id") % 3 == 1, " カナ").otherwise("")
    rows = items(spark, sf_dir).select("policy", F.concat("text", tail).alias("text"))
    return rows.groupBy("policy").agg(F.count_if(T.contains_cjk(F.col("text"))).alias("cjk"), r6(F.avg(F.length("text"))).alias("mean_chars"))
