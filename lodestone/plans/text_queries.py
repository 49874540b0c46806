"""Queries over documents, pages and their labels: reshapes, predicates, extraction, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import rewards as rw
from lodestone.functions import text as tx
from lodestone.operators import ordering, sampling
from lodestone.plans.registry import query

#: A response made of a document: thought and answer, spoilt for some rows.
_RESPONSE = """CASE doc_id % 6 WHEN 0 THEN '<think>' || text || '</think> <answer>' || doc_id || '</answer>'
 WHEN 1 THEN '<think> </think><answer>' || doc_id || '</answer>' WHEN 2 THEN '<think>a</think><think>b</think><answer>c</answer>'
 WHEN 3 THEN 'x<think>a</think><answer>b</answer>' WHEN 4 THEN '<think>a</think>' || chr(10) || '<answer>\\boxed{' || doc_id || '}</answer>' ELSE '<answer>' || text || '</answer>' END"""


def _response():
    i, s = F.col("doc_id").cast("string"), F.col("text")
    return F.expr("doc_id % 6"), [
        F.concat(F.lit("<think>"), s, F.lit("</think> <answer>"), i, F.lit("</answer>")), F.concat(F.lit("<think> </think><answer>"), i, F.lit("</answer>")),
        F.lit("<think>a</think><think>b</think><answer>c</answer>"), F.lit("x<think>a</think><answer>b</answer>"),
        F.concat(F.lit("<think>a</think>\n<answer>\\boxed{"), i, F.lit("}</answer>")), F.concat(F.lit("<answer>"), s, F.lit("</answer>")),
    ]


def _responses(t):
    kind, options = _response()
    out = options[-1]
    for k, o in enumerate(options[:-1]):
        out = F.when(kind == k, o).otherwise(out)
    return t.documents.select("doc_id", "text", out.alias("response"))


@query("SELECT doc_id, doc_id % 6 IN (0, 4) AS ok FROM documents")
def format_check(t):
    return _responses(t).select("doc_id", tx.think_answer_format(F.col("response")).alias("ok"))


@query(f"SELECT doc_id, regexp_extract(r, '<think>', 0) <> '' AND starts_with(r, '<think>') AND doc_id % 6 <> 2 AS ok FROM (SELECT doc_id, {_RESPONSE} AS r FROM documents)")
def think_format(t):
    return _responses(t).select("doc_id", tx.think_format(F.col("response")).alias("ok"))


@query(f"SELECT doc_id, regexp_extract(r, '<answer>(.*?)</answer>', 1, 's') AS answer FROM (SELECT doc_id, {_RESPONSE} AS r FROM documents)")
def answer_extract(t):
    return _responses(t).select("doc_id", tx.answer_part(F.col("response")).alias("answer"))


@query("SELECT doc_id, doc_id % 6 <> 5 AS ok FROM documents")
def thinking_then_content(t):
    return _responses(t).select("doc_id", tx.thinking_then_content(F.col("response")).alias("ok"))


@query("SELECT doc_id, doc_id % 6 <> 5 AS ok FROM documents")
def tool_answer_format(t):
    return _responses(t).select("doc_id", tx.tool_answer_format(F.col("response")).alias("ok"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 4 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS boxed FROM documents")
def boxed_last(t):
    return _responses(t).select("doc_id", tx.last_boxed(F.col("response")).alias("boxed"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS inside FROM documents")
def boxed_removed(t):
    boxed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\\boxed{"), F.col("doc_id").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("\\fbox{"), F.col("doc_id").cast("string"), F.lit("}")))
    return t.documents.select("doc_id", tx.remove_boxed(boxed).alias("inside"))


@query("SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS output FROM documents")
def stop_word_cut(t):
    reply = F.concat(F.lit("User: x Assistant: <think>"), F.col("text"), F.lit("<|im_end|> tail</s>"))
    return t.documents.select("doc_id", tx.cut_stop_words(reply).alias("output"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id || '' WHEN 1 THEN '1' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') WHEN 2 THEN '\\frac{1}{2}' WHEN 3 THEN '\\sqrt{3}' ELSE CAST(doc_id AS VARCHAR) END AS answer FROM documents""")
def answer_normalise(t):
    i = F.col("doc_id").cast("string")
    raw = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x = $"), i, F.lit("$ dollars"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("1,"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")))
        .when(F.col("doc_id") % 5 == 2, F.lit("\\frac12")).when(F.col("doc_id") % 5 == 3, F.lit("\\sqrt3 units")).otherwise(F.concat(F.lit("\\text{"), i, F.lit("}")))
    )
    return t.documents.select("doc_id", tx.normalise_answer(raw).alias("answer"))


_SQLS = "CASE doc_id % 5 WHEN 0 THEN 'select  a' || chr(10) || ' from t where b = ' || doc_id WHEN 1 THEN 'SELECT (a FROM t;' WHEN 2 THEN 'WITH x AS (SELECT 1) SELECT * FROM x' WHEN 3 THEN 'update t set a = ''x'' ;' ELSE 'hello' END"


def _sqls(t):
    i = F.col("doc_id")
    sql = F.when(i % 5 == 0, F.concat(F.lit("select  a\n from t where b = "), i.cast("string"))).when(i % 5 == 1, F.lit("SELECT (a FROM t;")).when(i % 5 == 2, F.lit("WITH x AS (SELECT 1) SELECT * FROM x")).when(i % 5 == 3, F.lit("update t set a = 'x' ;")).otherwise(F.lit("hello"))
    return t.documents.select("doc_id", sql.alias("sql"))


@query(f"SELECT doc_id, CASE WHEN ends_with(s, ';') THEN s ELSE s || ';' END AS cleaned FROM (SELECT doc_id, trim(regexp_replace({_SQLS}, '\\s+', ' ', 'g')) AS s FROM documents)")
def sql_clean(t):
    return _sqls(t).select("doc_id", tx.clean_sql(F.col("sql")).alias("cleaned"))


@query("SELECT doc_id, doc_id % 5 IN (0, 2, 3) AS pre, doc_id % 5 IN (0, 3) AS strict, doc_id % 5 IN (0, 2, 3) AS with_cte FROM documents")
def sql_validity(t):
    return _sqls(t).select("doc_id", tx.sql_precheck(F.col("sql")).alias("pre"), tx.sql_valid(F.col("sql")).alias("strict"), tx.sql_valid(F.col("sql"), allow_cte=True).alias("with_cte"))


@query(f"SELECT doc_id, trim({_SQLS}) AS answer FROM documents")
def sql_answer(t):
    return _sqls(t).select("doc_id", tx.sql_answer(F.concat(F.lit("so <answer> "), F.col("sql"), F.lit(" </answer>"))).alias("answer"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'excellent' WHEN doc_id % 3 = 1 THEN 'discard' END AS either, CASE WHEN doc_id % 6 = 3 THEN 'excellent' WHEN doc_id % 3 = 1 THEN 'discard' END AS strict FROM documents")
def verdict_parse(t):
    i = F.col("doc_id")
    said = F.when(i % 6 == 0, F.lit("excellent, not discard")).when(i % 3 == 0, F.lit("excellent")).when(i % 3 == 1, F.lit("discard")).otherwise(F.lit("?"))
    return t.documents.select("doc_id", tx.verdict(said, "excellent", "discard").alias("either"), tx.verdict(said, "excellent", "discard", both_is_good=False).alias("strict"))


@query("SELECT doc_id, text AS verdict_text FROM documents WHERE doc_id % 3 = 0")
def verdict_filter(t):
    said = F.when(F.col("doc_id") % 3 == 0, F.lit("excellent")).otherwise(F.lit("poor"))
    return t.documents.where(tx.verdict(said, "excellent", "discard") == "excellent").select("doc_id", F.col("text").alias("verdict_text"))


@query("SELECT doc_id, 'a' || doc_id AS content, doc_id % 2 = 0 AS paired FROM documents")
def tags_stripped(t):
    i = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<answer> <|begin_of_box|>a"), i, F.lit("<|end_of_box|></answer>"))).otherwise(F.concat(F.lit("<|begin_of_box|>a"), i))
    paired = tx.count_of(raw, "<|begin_of_box|>") == tx.count_of(raw, "<|end_of_box|>")
    return t.documents.select("doc_id", tx.strip_answer_tags(raw).alias("content"), paired.alias("paired"))


@query("SELECT doc_id, n_chars % 7 || ',' || doc_id AS codes, '<|s_' || n_chars % 7 || '|><|s_' || doc_id || '|>' AS tokens FROM documents")
def speech_codes(t):
    text = F.concat(F.lit("<|s_"), (F.col("n_chars") % 7).cast("string"), F.lit("|> x <|s_"), F.col("doc_id").cast("string"), F.lit("|>"))
    codes = tx.speech_codes(text)
    return t.documents.select("doc_id", F.array_join(codes, ",").alias("codes"), tx.speech_tokens(codes).alias("tokens"))


@query("""SELECT doc_id, total > 0 AND latin > 0.5 * total AND cjk <= 0.05 * total AS english FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '[一-鿿]')) AS cjk, len(regexp_extract_all(text, '\\p{L}')) AS total FROM documents)""")
def lang_detect(t):
    return t.documents.select("doc_id", tx.is_english(F.col("text")).alias("english"))


@query("SELECT doc_id, regexp_matches(text, '[A-Za-z]') AS latin, regexp_matches(text, '[一-鿿]') AS cjk FROM documents")
def char_classes(t):
    return t.documents.select("doc_id", tx.has_latin(F.col("text")).alias("latin"), tx.has_cjk(F.col("text")).alias("cjk"))


@query("SELECT doc_id, trim(regexp_replace(replace(text, chr(10), 'n'), '[!,.;:?、！，。；：？《》 ]+', '', 'g')) AS bare FROM documents")
def punct_strip(t):
    return t.documents.select("doc_id", tx.remove_punctuation(F.replace("text", F.lit("\n"), F.lit("n"))).alias("bare"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>?', '', 'g') AS bare FROM pages")
def tag_strip(t):
    return t.pages.select("page_id", tx.strip_tags(F.col("html")).alias("bare"))


@query("""SELECT doc_id, trim(regexp_replace(upper(replace(replace(replace(replace(s, ' ', ''), '&', ''), ',', ''), 'ß', 'ss')), '[!,.;:?、！，。；：？《》 ]+', '', 'g')) AS normal FROM (SELECT doc_id, replace(text, chr(10), '') AS s FROM documents)""")
def transcript_normalise(t):
    return t.documents.select("doc_id", tx.normalise_transcript(F.concat(F.lit("<sil>"), F.replace("text", F.lit("\n"), F.lit("")))).alias("normal"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]|[A-Za-z'']+')) AS n FROM documents")
def mixed_tokens(t):
    return t.documents.select("doc_id", F.size(tx.mixed_tokens(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+')) AS words, round(len(regexp_extract_all(text, '[^\\s]+')) * 1.3, 4) AS estimate FROM documents")
def token_estimate(t):
    return t.documents.select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("words"), F.round(tx.token_estimate(F.col("text")), 4).alias("estimate"))


@query("SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[^\\s]+')) <= 500")
def token_length_filter(t):
    return t.documents.where(F.size(tx.words(F.col("text"))) <= 500).select("doc_id")


@query("SELECT doc_id, lang || '_' || substr(md5(text || '|' || source), 1, 8) AS id FROM documents")
def content_hash_id(t):
    return t.documents.select("doc_id", tx.content_id(F.col("lang"), F.concat("text", F.lit("|"), "source")).alias("id"))


@query("SELECT doc_id, rtrim('set_' || lang || '___' || source, '_') AS name FROM documents")
def clean_names(t):
    raw = F.concat(F.lit("lmms-lab/set("), "lang", F.lit("), "), "source", F.lit("-)"))
    return t.documents.select("doc_id", tx.clean_name(raw).alias("name"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'processed' END AS split FROM documents")
def split_names(t):
    path = F.element_at(F.array(*map(F.lit, ["/a/Train.parquet", "/a/test_1.parquet", "/b/dev/x", "/c/other"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", tx.split_name(path).alias("split"))


@query("SELECT page_id, 'CREATE TABLE p' || page_id || ' (' || chr(10) || 'a int,' || chr(10) || 'b int' || chr(10) || ');' AS ddl, 2 AS n FROM pages")
def ddl_extract(t):
    i = F.col("page_id").cast("string")
    script = F.concat(F.lit("-- x\nCREATE TABLE p"), i, F.lit(" (\n   a int,\n\n  b int\n);\ninsert into p values (1);\ncreate  table q (c int);"))
    found = tx.ddl_statements(script)
    return t.pages.select("page_id", found[0].alias("ddl"), F.size(found).alias("n"))


@query("""SELECT doc_id, CASE WHEN n_chars <= 5000 THEN -0.3 WHEN n_chars >= 10240 THEN 0.3 ELSE round(-0.3 + 0.6 * (n_chars - 5000) / 5240, 6) END AS length_reward,
  CASE WHEN doc_id % 2 = 1 THEN round(1 + CASE WHEN n_chars <= 5000 THEN -0.3 WHEN n_chars >= 10240 THEN 0.3 ELSE -0.3 + 0.6 * (n_chars - 5000) / 5240 END, 6) ELSE 0.0 END AS final FROM documents""")
def length_reward(t):
    size = rw.length_reward(F.col("n_chars"))
    return t.documents.select("doc_id", F.round(size, 6).alias("length_reward"), F.round(rw.final_reward(F.col("doc_id") % 2, size), 6).alias("final"))


@query("SELECT doc_id, round(least(-(n_chars - (4096 - 1024)) / 1024.0 * 0.5, 0.0), 6) AS penalty FROM documents")
def overlong_penalty(t):
    return t.documents.select("doc_id", F.round(rw.overlong_penalty(F.col("n_chars"), 4096, 1024, 0.5), 6).alias("penalty"))


@query("SELECT doc_id, round(greatest(0.0, least(1.0, exp(-12 * pow((doc_id % 100) / 100.0, 1.5)))), 9) AS reward FROM documents")
def error_reward(t):
    return t.documents.select("doc_id", F.round(rw.error_reward((F.col("doc_id") % 100) / 100.0), 9).alias("reward"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 NOT IN (0, 4) THEN -1.0 WHEN doc_id % 3 = 0 THEN 1.0 WHEN doc_id % 4 = 0 THEN 1.0 ELSE 0.0 END AS reward FROM documents")
def composed_reward(t):
    i = F.col("doc_id")
    return _responses(t).select("doc_id", rw.composed(tx.think_answer_format(F.col("response")), i % 3 == 0, F.when(i % 4 == 0, True)).alias("reward"))


@query("""SELECT doc_id, 'documents/' || lang AS data_source, text || '  Think step by step.' AS content, 'user' AS role, 'general' AS ability, 'rule' AS style, source AS ground_truth, 'train' AS split,
 row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents""")
def rl_prompt_reshape(t):
    numbered = ordering.row_numbers(t.documents.select("doc_id", "text", "lang", "source"), ["doc_id"], "number")
    row = F.struct(
        F.concat(F.lit("documents/"), "lang").alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.concat("text", F.lit("  Think step by step.")).alias("content"))).alias("prompt"),
        F.lit("general").alias("ability"), F.struct(F.lit("rule").alias("style"), F.col("source").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit("train").alias("split"), (F.col("number") - 1).alias("index")).alias("extra_info"),
    )
    r = numbered.select("doc_id", row.alias("r"))
    return r.select("doc_id", "r.data_source", F.col("r.prompt")[0]["content"].alias("content"), F.col("r.prompt")[0]["role"].alias("role"), "r.ability", F.col("r.reward_model.style").alias("style"), F.col("r.reward_model.ground_truth").alias("ground_truth"), F.col("r.extra_info.split").alias("split"), F.col("r.extra_info.index").alias("idx"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE lang || chr(10) || source END AS query FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def query_builder(t):
    extra = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    built = F.when(F.length(extra) > 0, F.concat_ws("\n", F.col("lang"), extra)).otherwise(F.col("lang"))
    return t.documents.select("doc_id", built.alias("query")).unionByName(t.benchmark.select(F.col("item_id").alias("doc_id"), F.col("text").alias("query")))


@query("SELECT doc_id, 'BEFORE ' || text || ' AFTER' AS prompt, 'sqlR1_' || source AS data_source, CASE WHEN doc_id % 2 = 0 THEN lang END AS metadata FROM documents WHERE doc_id % 5 <> 0")
def text2sql_reshape(t):
    prompt = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("system"))).otherwise(F.array(F.lit("system"), F.col("text")))
    meta = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.col("lang"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = t.documents.select("doc_id", "source", prompt.alias("p"), F.when(F.size(meta) > 0, meta).alias("m")).where(F.size("p") >= 2)
    return rows.select("doc_id", F.concat(F.lit("BEFORE "), F.element_at("p", -1), F.lit(" AFTER")).alias("prompt"), F.concat(F.lit("sqlR1_"), "source").alias("data_source"), F.try_element_at("m", F.lit("lang")).alias("metadata"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'Describe: ' ELSE 'Beschreibe: ' END || source || CASE WHEN doc_id % 2 = 0 THEN ' /no_think' ELSE '' END AS message FROM documents")
def user_message(t):
    base = F.when(F.col("lang") == "en", F.lit("Describe: ")).otherwise(F.lit("Beschreibe: "))
    return t.documents.select("doc_id", F.concat(base, "source", F.when(F.col("doc_id") % 2 == 0, F.lit(" /no_think")).otherwise("")).alias("message"))


@query("SELECT doc_id, 'You judge answers.' || chr(10) || 'Q: ' || lang || chr(10) || 'A: ' || source AS prompt, 'system' || ',' || 'user' AS roles FROM documents")
def chat_build(t):
    user = F.format_string("You judge answers.\nQ: %s\nA: %s", "lang", "source")
    chat = F.array(F.struct(F.lit("system").alias("role"), F.lit("You judge.").alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    rows = t.documents.select("doc_id", chat.alias("c"))
    return rows.select("doc_id", F.col("c")[1]["content"].alias("prompt"), F.array_join(F.transform("c", lambda m: m["role"]), ",").alias("roles"))


@query("SELECT doc_id * 4 + k AS rollout_index, doc_id, k FROM documents, (SELECT unnest(generate_series(0, 3)) AS k)")
def rollout_expansion(t):
    from lodestone.operators.groups import rollouts

    return rollouts(t.documents.select("doc_id"), 4, "doc_id").select("rollout_index", "doc_id", F.col("k").cast("long").alias("k"))


@query("SELECT doc_id, f AS speed, round(n_chars / f, 6) AS duration FROM documents, (VALUES (0.9), (1.0), (1.1)) AS s(f) WHERE f = 1.0 OR CAST('0x' || substr(md5(doc_id || '-42'), 1, 7) AS BIGINT) % 100 < 80")
def speed_perturbation(t):
    """Three speeds for the training split, one for the others."""
    rows = sampling.split(t.documents.select("doc_id", "n_chars"), "doc_id", {"train": 80, "val": 15, "test": 5})
    speeds = F.explode(F.when(F.col("split") == "train", F.array(F.lit(0.9), F.lit(1.0), F.lit(1.1))).otherwise(F.array(F.lit(1.0))))
    return rows.select("doc_id", "n_chars", speeds.alias("speed")).select("doc_id", "speed", F.round(F.col("n_chars") / F.col("speed"), 6).alias("duration"))


@query("SELECT doc_id, right(text, length(text) // 2) AS prompt_tail, left(text, length(text) // 2) AS response_head FROM documents")
def valid_slice(t):
    rows = t.documents.select("doc_id", F.split("text", "").alias("ids"))
    mask = F.transform("ids", lambda x, i: F.when(i < F.floor(F.size("ids") / 2), 1).otherwise(0))
    rows = rows.withColumn("k", F.aggregate(mask, F.lit(0), lambda s, x: s + x))
    part = lambda start: F.when(F.col("k") > 0, F.array_join(F.slice("ids", start, F.col("k")), "")).otherwise("")
    return rows.select("doc_id", part(-F.greatest("k", F.lit(1))).alias("prompt_tail"), part(F.lit(1)).alias("response_head"))


@query("SELECT doc_id, len(p) AS n, list_sum(p) AS total FROM (SELECT doc_id, list_concat([1, 2, 3], list_transform(generate_series(1, mx - doc_id % 4), lambda x: 0)) AS p FROM (SELECT doc_id, max(doc_id % 4) OVER (PARTITION BY source) AS mx FROM documents))")
def pad_to_longest(t):
    longest = t.documents.groupBy("source").agg(F.max(F.col("doc_id") % 4).alias("most"))  # a row a batch, from partial maxima
    pad = F.array_repeat(F.lit(0), (F.col("most") - F.col("doc_id") % 4).cast("int"))
    rows = t.documents.select("doc_id", "source").join(longest, "source").select("doc_id", F.concat(F.array(F.lit(1), F.lit(2), F.lit(3)), pad).alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0), lambda s, x: s + x).cast("long").alias("total"))


@query("SELECT doc_id, len(s) AS n, list_sum(s) AS total FROM (SELECT doc_id, range(1, 4 + doc_id % 4)[1:mn] AS s FROM (SELECT doc_id, min(3 + doc_id % 4) OVER (PARTITION BY source) AS mn FROM documents))")
def curtail_to_shortest(t):
    size = (F.col("doc_id") % 4 + 3).cast("int")
    shortest = t.documents.groupBy("source").agg(F.min(size).alias("least"))
    rows = t.documents.select("doc_id", "source").join(shortest, "source").select("doc_id", F.slice(F.sequence(F.lit(1), size), F.lit(1), F.col("least")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


@query("SELECT doc_id, lang FROM documents WHERE n_chars >= 200 AND n_chars <= 5000 AND (doc_id % 3 <> 0 OR doc_id % 30 <= 18)")
def duration_filter(t):
    codec = F.when(F.col("doc_id") % 3 == 0, F.array_repeat(F.lit(1), (F.col("doc_id") % 30).cast("int")))
    ok = F.col("n_chars").between(200, 5000) & (codec.isNull() | (F.size(codec) <= 18))
    return t.documents.where(ok).select("doc_id", "lang")


@query("""SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE n_chars < 3000) WHERE n <= 101 AND NOT regexp_matches(lower(text), 'q')""")
def capped_language_filter(t):
    first = t.documents.where(F.col("n_chars") < 3000).select("doc_id", "text").orderBy("doc_id").limit(101)
    return first.where(~F.lower("text").rlike("q")).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 6 NOT IN (0, 4) THEN 'INVALID_FORMAT' WHEN doc_id % 4 <> 0 THEN 'INCORRECT_ANSWER' ELSE 'VALID' END AS reason FROM documents")
def tagged_rejection(t):
    ok = tx.think_answer_format(F.col("response"))
    return _responses(t).select("doc_id", F.when(~ok, "INVALID_FORMAT").when(F.col("doc_id") % 4 != 0, "INCORRECT_ANSWER").otherwise("VALID").alias("reason"))


@query("SELECT doc_id, try_cast(v AS INTEGER) AS value, v = '' OR try_cast(v AS INTEGER) IS NULL AS rejected FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' || doc_id WHEN 1 THEN 'x' ELSE '' END AS v FROM documents)")
def parameter_coercion(t):
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, "x").otherwise("")
    params = t.documents.select("doc_id", F.create_map(F.lit("n"), raw).alias("m"))
    value = F.try_element_at("m", F.lit("n")).try_cast("int")
    return params.select("doc_id", value.alias("value"), (~F.map_contains_key("m", "n") | value.isNull()).alias("rejected"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'stop' END AS reason FROM documents WHERE doc_id % 4 = 0")
def finish_reason_filter(t):
    reason = F.element_at(F.array(*map(F.lit, ["stop", "length", "content_filter", "tool_calls"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", reason.alias("reason")).where(F.col("reason") == "stop")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 256 WHEN doc_id % 3 = 1 THEN 512 ELSE 1024 END AS bucket FROM documents")
def pad_bucket(t):
    n = F.element_at(F.array(F.lit(10), F.lit(300), F.lit(900)), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.documents.select("doc_id", F.when(n <= 256, 256).when(n <= 512, 512).otherwise(1024).alias("bucket"))


@query("SELECT source, floor_div AS batch, string_agg(doc_id, '#' ORDER BY doc_id) AS packed, count(*) AS n FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS floor_div FROM documents) GROUP BY source, floor_div")
def batch_pack(t):
    numbered = ordering.row_numbers(t.documents.select("source", "doc_id"), ["source", "doc_id"], "number")
    first = numbered.groupBy(F.col("source").alias("of")).agg(F.min("number").alias("first"))
    rows = numbered.join(F.broadcast(first), F.col("source").eqNullSafe(F.col("of")))  # a row a source
    packed = rows.select("source", "doc_id", F.floor((F.col("number") - F.col("first")) / 5).alias("batch")).groupBy("source", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), "#").alias("packed"))
    return packed.select("source", "batch", "packed", F.size(F.filter(F.split("packed", "#"), lambda x: F.trim(x) != "")).cast("long").alias("n"))


@query("""SELECT doc_id, md5(doc_id || '-42') AS ticket FROM documents ORDER BY md5(doc_id || '-42'), doc_id LIMIT 100""")
def hash_sample(t):
    return sampling.sample(t.documents.select("doc_id"), "doc_id", 100).withColumn("ticket", sampling.ticket("doc_id"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '-42'), doc_id) AS n FROM documents) WHERE n <= 7")
def stratified_sample(t):
    return sampling.sample_each(t.documents.select("source", "doc_id"), "source", "doc_id", 7)


@query("SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 95 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, CAST('0x' || substr(md5(doc_id || '-42'), 1, 7) AS BIGINT) % 100 AS b FROM documents)")
def hash_split(t):
    return sampling.split(t.documents.select("doc_id"), "doc_id", {"train": 80, "val": 15, "test": 5})


@query("SELECT doc_id, copy FROM (SELECT doc_id, unnest(generate_series(0, CAST(ceil(2500.0 / (SELECT count(*) FROM documents)) AS BIGINT) - 1)) AS copy FROM documents) ORDER BY copy, md5(doc_id || '-42'), doc_id LIMIT 2500")
def over_sample(t):
    docs = t.documents.select("doc_id")
    return sampling.oversample(docs, "doc_id", docs.count(), 2500).select("doc_id", F.col("copy").cast("long").alias("copy"))


@query("SELECT stream, doc_id, round(n / CASE stream WHEN 0 THEN 3.0 ELSE 1.0 END, 6) AS turn FROM (SELECT 0 AS stream, doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT 1, doc_id, row_number() OVER (ORDER BY doc_id) FROM documents WHERE lang = 'fr')")
def weighted_interleave(t):
    part = lambda lang: t.documents.where(F.col("lang") == lang).select("doc_id")
    return sampling.interleave([(part("en"), 3.0), (part("fr"), 1.0)], "doc_id").select("stream", "doc_id", F.round("turn", 6).alias("turn"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 90 // (SELECT count(DISTINCT lang) FROM documents)")
def quota_allocation(t):
    return sampling.quota(t.documents.select("lang", "doc_id"), "lang", "doc_id", 90)


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def prefix_limit(t):
    return t.documents.select("doc_id").orderBy("doc_id").limit(50)


@query("SELECT doc_id, substr(name, 1, strpos(name || '(', '(') - 1) AS tool FROM (SELECT doc_id, source || '(' || lang || ')' AS name FROM documents)")
def tool_name(t):
    call = F.concat("source", F.lit("("), "lang", F.lit(")"))
    return t.documents.select("doc_id", F.trim(F.substring_index(call, "(", 1)).alias("tool"))


@query("""SELECT doc_id, CASE WHEN u < 85 THEN 'success' WHEN u < 95 THEN 'partial' ELSE 'error' END AS outcome, CASE u % 4 WHEN 0 THEN 'friendly' WHEN 1 THEN 'formal' WHEN 2 THEN 'curt' ELSE 'playful' END AS persona FROM (SELECT doc_id, CAST('0x' || substr(md5(doc_id || '-42'), 1, 7) AS BIGINT) % 100 AS u FROM documents)""")
def simulated_outcome(t):
    u = sampling.bucket("doc_id", 100)
    persona = F.element_at(F.array(*map(F.lit, ["friendly", "formal", "curt", "playful"])), (u % 4 + 1).cast("int"))
    return t.documents.select("doc_id", F.when(u < 85, "success").when(u < 95, "partial").otherwise("error").alias("outcome"), persona.alias("persona"))
