"""Agents, tools, tasks and evaluation on records made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import plugins
from lodestone.functions import text as tx
from lodestone.operators import evaluation, tools
from lodestone.plans.registry import query


def _params(i):
    one = lambda name, kind, need: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.concat(F.lit(name + " of "), i.cast("string")).alias("description"), need.alias("required"))
    return F.array(one("size", "integer", i % 2 == 0), one("name", "string", F.lit(True)))


@query("""SELECT p_partkey, '{"type":"object","properties":{"size":{"type":"integer","description":"size of ' || p_partkey || '"},"name":{"type":"string","description":"name of ' || p_partkey || '"}},"required":[' || CASE WHEN p_partkey % 2 = 0 THEN '"size",' ELSE '' END || '"name"]}' AS schema FROM part""")
def function_schema(t):
    return t.part.select("p_partkey", tools.function_schema(_params(F.col("p_partkey"))).alias("schema"))


@query("""SELECT p_partkey, '**' || p_name || '**\\nFunction: ' || p_brand || '\\n- size (integer)' || CASE WHEN p_partkey % 2 = 0 THEN ' [Required]' ELSE '' END || '\\n- name (string) [Required]' AS prompt FROM part""")
def tool_prompt(t):
    return t.part.select("p_partkey", tools.tool_text(F.col("p_name"), F.col("p_brand"), _params(F.col("p_partkey"))).alias("prompt"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_brand END, 'string') AS type, coalesce(CASE WHEN p_partkey % 2 > 0 THEN false END, true) AS required FROM part")
def tool_defaults(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("type"), F.when(F.col("p_partkey") % 2 > 0, False).alias("required"))
    return tools.with_defaults(rows, type="string", required=True)


@query("SELECT p_partkey, p_partkey % 4 > 0 AND length(p_name) >= 10 AS scenario_ok, p_partkey % 5 > 0 AS tool_ok, p_partkey % 6 IN (1, 2, 3, 5) AS task_ok FROM part")
def record_validation(t):
    i = F.col("p_partkey")
    params = F.when(i % 5 > 0, _params(i)).otherwise(F.transform(_params(i), lambda p: p.withField("description", F.lit(None).cast("string"))))
    points = F.when(i % 6 == 0, F.array().cast("array<string>")).when(i % 6 == 4, F.array(F.lit("fly(x)"))).otherwise(F.array(F.lit("walk (x)"), F.lit("done")))
    return t.part.select("p_partkey", tools.scenario_valid(F.when(i % 4 > 0, F.col("p_brand")).otherwise(F.lit("")), F.col("p_name"), F.lit("c")).alias("scenario_ok"), tools.tool_valid(F.col("p_name"), F.col("p_brand"), params).alias("tool_ok"), tools.task_valid(points, F.array(F.lit("walk"), F.lit("run"))).alias("task_ok"))


@query("SELECT l_orderkey, string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey, p_name) AS names FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 30 GROUP BY l_orderkey HAVING count(*) >= 2")
def ordered_lookup(t):
    ids = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    found = tools.ordered_lookup(ids, "l_orderkey", "ids", t.part.where(F.col("p_size") <= 30), "p_partkey", "p_name", 2)
    return found.select("l_orderkey", F.array_join("values", "|").alias("names"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name, c_nationkey FROM customer")
def upsert_by_key(t):
    new = t.customer.where(F.col("c_custkey") % 3 == 0).select("c_custkey", F.lit("new").alias("c_name")).unionByName(t.customer.select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit("added").alias("c_name")))
    return tools.upsert(t.customer.select("c_custkey", "c_name", "c_nationkey"), new, "c_custkey")


@query("SELECT event_id, false AS success, CASE WHEN event_type = 'click' THEN 'TimeoutError' ELSE 'ExecutionError' END AS error_type FROM events")
def error_results(t):
    kind = F.when(F.col("event_type") == "click", "timeout").otherwise(F.col("event_type"))
    return t.events.select("event_id", tools.error_result(kind).alias("r")).select("event_id", "r.success", "r.error_type")


@query("SELECT event_id, value BETWEEN 0 AND 50 AS in_range, value > 40.0 AS high, value >= 40.0 AS passed FROM events")
def score_range(t):
    v = F.try_parse_json(F.concat(F.lit('{"overall_score": '), F.col("value").cast("string"), F.lit("}")))
    s = F.try_variant_get(v, "$.overall_score", "double")
    return t.events.select("event_id", s.between(0, 50).alias("in_range"), (s > 40.0).alias("high"), (s >= 40.0).alias("passed"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS run_id, coalesce(CASE WHEN event_type = 'click' THEN 'c' END, 'default') AS setting FROM events")
def run_ids(t):
    settings = F.create_map(F.lit("click"), F.lit("c"))
    return t.events.select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("run_id"), F.coalesce(F.try_element_at(settings, F.col("event_type")), F.lit("default")).alias("setting"))


@query("""SELECT event_id, 'tool ' || event_type AS content, CASE WHEN event_id % 2 = 0 THEN 'f' END AS called FROM events""")
def parse_response(t):
    reply = F.concat(F.lit('{"choices": [{"finish_reason": "'), F.when(F.col("event_id") % 2 == 0, "tool_calls").otherwise("stop"), F.lit('", "message": {"content": "tool '), "event_type", F.lit('", "tool_calls": [{"name": "f"}]}}]}'))
    schema = "struct<choices: array<struct<finish_reason: string, message: struct<content: string, tool_calls: array<struct<name: string>>>>>>"
    first = F.from_json(reply, schema)["choices"][0]
    return t.events.select("event_id", first["message"]["content"].alias("content"), F.when(first["finish_reason"] == "tool_calls", first["message"]["tool_calls"][0]["name"]).alias("called"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '[1]' END AS value, 'u' || doc_id AS updated FROM documents")
def nested_update(t):
    i = F.col("doc_id").cast("string")
    row = F.struct(F.struct(F.concat(F.lit('["'), F.when(F.col("doc_id") % 2 == 0, i).otherwise("[1]"), F.lit('"]')).alias("ground_truth")).alias("reward_model"), F.array(F.struct(F.lit("u").alias("content"))).alias("prompt"))
    rows = t.documents.select("doc_id", row.alias("r"))
    fixed = F.col("r").withField("reward_model.ground_truth", F.from_json("r.reward_model.ground_truth", "array<string>")[0])
    added = F.transform("r.prompt", lambda m, k: F.when(k == 0, m.withField("content", F.concat(m["content"], i))).otherwise(m))
    return rows.select("doc_id", fixed["reward_model"]["ground_truth"].alias("value"), added[0]["content"].alias("updated"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 WHEN doc_id % 3 = 1 THEN -1.0 END AS score FROM documents")
def scorer_registry(t):
    i = F.col("doc_id")
    rows = t.documents.select("doc_id", F.when(i % 3 == 0, "math").when(i % 3 == 1, "format").otherwise("other").alias("source"), F.concat(F.lit("so \\boxed{1,"), F.lpad((i % 900 + 100).cast("string"), 3, "0"), F.lit("}")).alias("r"), (i % 900 + 1100).cast("string").alias("g"))
    return plugins.score(rows, "source", "r", "g").select("doc_id", "score")


@query("SELECT item_id, 'reply ' || substr(md5(text), 1, 8) AS response FROM benchmark")
def model_completion(t):
    return plugins.complete(t.benchmark, "text").select("item_id", "response")


@query()
def text_embedding(t):
    return plugins.embed(t.benchmark, "text").select("item_id", F.size("embedding").alias("size"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)), 6) AS rms FROM embeddings")
def vector_rms(t):
    return t.embeddings.select("vec_id", F.round(plugins.rms(F.col("embedding")), 6).alias("rms"))


@query("SELECT 3 AS samples, 4 AS trajectories, 2 AS correct, 1 AS incorrect, 1 AS parse_error, 0 AS error, round(2.0 / 3, 6) AS sample_accuracy")
def sql_evaluation(t):
    cases = [
        ("a", "<answer>SELECT r_name FROM region</answer>", "SELECT r_name AS x FROM region ORDER BY 1"),
        ("a", "no answer", "SELECT 1"),
        ("b", "<answer>SELECT count(*) FROM nation WHERE n_regionkey = 0</answer>", "SELECT count(*) FROM nation"),
        ("c", "<answer>SELECT nope FROM region</answer>", "SELECT neither FROM region"),
    ]
    counts = evaluation.summary(evaluation.evaluate(t.spark, cases, {"region": t.region, "nation": t.nation}))
    return counts.select(*(F.col(c).cast("int").alias(c) for c in ("samples", "trajectories", "correct", "incorrect", "parse_error", "error")), "sample_accuracy")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 0 AND doc_id % 2 = 0")
def record_validity(t):
    gt = F.concat(F.lit('{"gt_parse": {"text_sequence": "'), F.when(F.col("doc_id") % 2 == 0, "x").otherwise(" "), F.lit('"}}'))
    text = F.get_json_object(gt, "$.gt_parse.text_sequence")
    return t.documents.where((F.length(F.trim(text)) > 0) & (F.col("n_chars") > 0) & (F.col("n_chars") <= 50000000)).select("doc_id", "n_chars")


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.n_chars > 100")
def image_rows(t):
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "quality", F.when(F.col("n_chars") > 100, F.array("lang")).alias("messages"), F.array("source").alias("images"))
    return rows.where(F.col("messages").isNotNull() & F.col("images").isNotNull()).select("doc_id", "quality")


@query("SELECT source, lang, count(*) AS valid, sum(n_chars) AS chars FROM documents GROUP BY source, lang")
def per_source_stats(t):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("valid"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)the')) AS n FROM documents")
def keyword_counts(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("(?i)the")).cast("long").alias("n"))
