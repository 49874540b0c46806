"""Databases as sources, results as text, typed records, layouts and graphs over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import plugins
from lodestone.functions import text as tx
from lodestone.operators import chat, evaluation, layout, tools
from lodestone.plans.registry import query
from lodestone.sources import files
from lodestone.storage import scratch


@query("SELECT n_regionkey, count(*) AS nations, max(n_name) AS last FROM nation GROUP BY n_regionkey")
def sqlite_query(t):
    path = scratch(t.spark, "base").removeprefix("file:") + ".sqlite"
    files.write_sqlite(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path, "nation")
    return files.sqlite_rows(t.spark, path, "SELECT n_regionkey, count(*) AS nations, max(n_name) AS last FROM nation GROUP BY 1", "n_regionkey long, nations long, last string")


@query("SELECT call_id, n_name FROM nation, (VALUES (1, 0), (2, 3)) AS c(call_id, region) WHERE n_regionkey = region")
def sql_tool_rows(t):
    """Tool calls with a query each, their rows beside the call."""
    path = scratch(t.spark, "base").removeprefix("file:") + ".sqlite"
    files.write_sqlite(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path, "nation")
    calls = t.spark.createDataFrame([(i, f'{{"name": "execute_sql", "arguments": {{"sql": "SELECT n_name FROM nation WHERE n_regionkey = {r}"}}}}') for i, r in ((1, 0), (2, 3))], "call_id int, call string")
    return files.sqlite_tool(calls, path, "call", "n_name string")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'spider' WHEN 1 THEN 'bird' ELSE 'synsql' END || '_' || lower(lang) AS name FROM documents")
def catalog_names(t):
    source = F.when(F.col("doc_id") % 3 == 0, "Spider").when(F.col("doc_id") % 3 == 1, "bird").otherwise("synsql")
    return t.documents.select("doc_id", files.catalog_name(source, F.col("lang")).alias("name"))


@query("""WITH r AS (SELECT string_agg(line, chr(10) ORDER BY k) AS body, count(*) AS n FROM (SELECT 1 AS k, 'n_name' AS line UNION ALL SELECT 2, n_name FROM nation WHERE n_nationkey = 0)),
l AS (SELECT count(*) AS n, sum(length(CAST(c_custkey AS VARCHAR)) + 3 + length(c_name) + 1) AS size FROM customer)
SELECT 'short' AS kind, length(body) :: BIGINT AS size, body AS text FROM r UNION ALL SELECT 'cut', 9000 + 23, 'Truncated to 50 rows since returned response too long: x' || chr(10) || repeat('y', 20) FROM l""")
def result_text(t):
    short = evaluation.pretty(t.nation.where(F.col("n_nationkey") == 0).select("n_name"))
    cut = evaluation.pretty(t.customer.select(F.repeat(F.lit("y"), 500).alias("x")))
    return t.spark.createDataFrame([("short", len(short), short), ("cut", len(cut), cut[:77])], "kind string, size long, text string")


@query("SELECT event_id, '{\"id\":' || event_id || ',\"at\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\",\"kind\":\"' || upper(event_type) || '\"}' AS json, true AS same FROM events")
def typed_records(t):
    """Typed records to dictionaries and back: times in ISO form, an enumeration by its value."""
    record = F.struct(F.col("event_id").alias("id"), F.date_trunc("second", "ts").alias("at"), F.upper("event_type").alias("kind"))
    rows = t.events.select("event_id", record.alias("r"), F.to_json(record, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("json"))
    back = F.from_json("json", rows.schema["r"].dataType, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"})
    return rows.select("event_id", "json", (back == F.col("r")).alias("same"))


@query("SELECT label, count(*) AS n, 'run-7' AS experiment, 0.5 AS temperature, '[\"' || label || '\"]' AS tags FROM embeddings GROUP BY label")
def evaluation_sink(t):
    path = scratch(t.spark, "evaluation")
    rows = t.embeddings.groupBy("label").agg(F.count("*").alias("n")).withColumn("logs", F.struct(F.array(F.col("label").cast("string")).alias("tags")))
    files.write_evaluation(rows, path, {"experiment": "run-7", "temperature": 0.5})
    return t.spark.read.parquet(path).select("label", "n", "experiment", "temperature", F.to_json("logs.tags").alias("tags"))


@query("SELECT 'full' AS kind, true AS written, count(*) AS n FROM region UNION ALL SELECT 'empty', false, 0")
def nonempty_sink(t):
    path = scratch(t.spark, "sink")
    done = [(k, files.write_nonempty(t.region.where(F.lit(k == "full")), f"{path}/{k}")) for k in ("full", "empty")]
    return t.spark.createDataFrame([(k, w, t.spark.read.parquet(f"{path}/{k}").count() if w else 0) for k, w in done], "kind string, written boolean, n long")


@query("SELECT n_nationkey AS src, n_regionkey + 100 AS dst, 'in' AS edge_type, 1.0 AS weight FROM nation")
def graph_edges_roundtrip(t):
    path = scratch(t.spark, "graph")
    edges = t.nation.select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst"), F.lit("in").alias("edge_type"), F.lit(1.0).alias("weight"))
    files.write_graph(t.nation.select("n_nationkey"), edges, path)
    return files.read_graph(t.spark, path)[1]


@query("SELECT doc_id, doc_id % 3 = n_chars % 3 AS matching FROM documents")
def placeholder_counts(t):
    n, m = (F.col("doc_id") % 3).cast("int"), (F.col("n_chars") % 3).cast("int")
    contents = F.array(F.concat(F.lit("look "), F.repeat(F.lit("<image>"), n)), F.lit("fine"))
    images = F.slice(F.array(*map(F.lit, "abc")), F.lit(1), m)
    return t.documents.select("doc_id", layout.placeholders_match(contents, {"<image>": F.size(images), "<video>": F.lit(0)}).alias("matching"))


_A = "SELECT doc_id, n_chars % 3000 + 1 AS w0, n_chars % 1700 + 1 AS h0 FROM documents"
_B = f"SELECT *, CASE WHEN w0 * h0 > 1000000 THEN CAST(floor(w0 * sqrt(1000000.0 / (w0 * h0))) AS BIGINT) ELSE w0 END AS w1, CASE WHEN w0 * h0 > 1000000 THEN CAST(floor(h0 * sqrt(1000000.0 / (w0 * h0))) AS BIGINT) ELSE h0 END AS h1 FROM ({_A})"
_C = f"SELECT *, CASE WHEN w1 * h1 < 3136 THEN CAST(floor(w1 * sqrt(3136.0 / (w1 * h1))) AS BIGINT) ELSE w1 END AS w2, CASE WHEN w1 * h1 < 3136 THEN CAST(floor(h1 * sqrt(3136.0 / (w1 * h1))) AS BIGINT) ELSE h1 END AS h2 FROM ({_B})"


@query(f"SELECT doc_id, CAST(CASE WHEN least(w2, h2) >= 28 THEN w2 WHEN w2 <= h2 THEN 28 ELSE floor(w2 * (28.0 :: DOUBLE / h2)) END AS BIGINT) AS w, CAST(CASE WHEN least(w2, h2) >= 28 THEN h2 WHEN w2 <= h2 THEN floor(h2 * (28.0 :: DOUBLE / w2)) ELSE 28 END AS BIGINT) AS h FROM ({_C})")
def image_resize_rule(t):
    return t.documents.select("doc_id", layout.resized(F.col("n_chars") % 3000 + 1, F.col("n_chars") % 1700 + 1, 1000000, 3136).alias("s")).select("doc_id", "s.w", "s.h")


@query("SELECT doc_id, array_to_string(list_transform(range(k), lambda i: CAST(floor(i * (total - 1) / greatest(k - 1, 1)) AS BIGINT)), ',') AS frames FROM (SELECT doc_id, n_chars % 300 AS total, least(n_chars % 300, doc_id % 9 + 1) AS k FROM documents)")
def frame_indices(t):
    return t.documents.select("doc_id", F.array_join(layout.frames(F.col("n_chars") % 300, F.col("doc_id") % 9 + 1), ",").alias("frames"))


@query("SELECT doc_id, '#' || source || '#' || lang || '#' AS packed, CASE WHEN doc_id % 3 > 0 THEN source || ',' || lang END AS parts, source || ',' || lang AS kept FROM documents")
def pack_and_unpack(t):
    packed = layout.packed(F.array("source", "lang"))
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(packed, F.lit("more#"))).otherwise(packed)
    noted = F.concat(F.lit("#"), "source", F.lit(" | why#"), "lang", F.lit("|because#"))
    return t.documents.select("doc_id", packed.alias("packed"), F.array_join(layout.unpacked(reply, F.lit(2)), ",").alias("parts"), F.array_join(layout.unpacked(noted, F.lit(2), True), ",").alias("kept"))


@query(r"""WITH RECURSIVE x AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN '漢字 ' || text ELSE text END AS text FROM conversations),
w AS (SELECT conv_id, turn, CASE WHEN cjk THEN string_split(text, '') ELSE regexp_extract_all(text, '[^ \t\r\n]+') END AS w, CASE WHEN cjk THEN '' ELSE ' ' END AS sep, CASE WHEN cjk THEN 14.4 ELSE 12 END AS wide FROM (SELECT *, regexp_matches(text, '[一-鿿]') AS cjk FROM x)),
r AS (SELECT conv_id, turn, w, sep, wide, 1 AS i, '' AS line, [] :: VARCHAR[] AS done, true AS go FROM w UNION ALL
  SELECT conv_id, turn, w, sep, wide, i + 1, CASE WHEN NOT go THEN line WHEN length(longer) * wide < 520 THEN longer WHEN line = '' THEN '' ELSE w[i] END, CASE WHEN go AND length(longer) * wide >= 520 AND line <> '' THEN list_append(done, line) ELSE done END, go AND (length(longer) * wide < 520 OR line <> '')
  FROM (SELECT *, CASE WHEN line = '' THEN w[i] ELSE line || sep || w[i] END AS longer FROM r WHERE i <= len(w) AND len(done) < 10))
SELECT conv_id, turn, array_to_string((CASE WHEN line = '' THEN done ELSE list_append(done, line) END)[:10], chr(10)) AS lines FROM r WHERE i = len(w) + 1 OR len(done) = 10""")
def wrapped_lines(t):
    """All texts; every fourth conversation's begin with two CJK characters, so they break between any two characters."""
    text = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("漢字 "), "text")).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.array_join(layout.wrapped(text), "\n").alias("lines"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND n_chars % 120 <= 91 THEN 1.0 ELSE -1.0 END AS score FROM documents")
def strict_box(t):
    """The box stands n_chars % 120 characters before the end, its own nine included at most."""
    box = F.when(F.col("doc_id") % 3 == 0, "\\boxed{7}").otherwise("\\boxed{8}")
    rows = t.documents.select("doc_id", F.lit("strict_box").alias("source"), F.concat(box, F.repeat(F.lit("x"), (F.col("n_chars") % 120).cast("int"))).alias("r"), F.lit("7").alias("g"))
    return plugins.score(rows, "source", "r", "g").select("doc_id", "score")


@query("""SELECT conv_id, '[{"role":"user","content":"hi"},{"role":"assistant","content":"","tool_calls":"f' || conv_id || '"},{"role":"tool","content":"r","tool_call_id":"c' || conv_id || '"}]' AS messages FROM (SELECT DISTINCT conv_id FROM conversations)""")
def tool_call_history(t):
    i, none = F.col("conv_id").cast("string"), F.lit(None).cast("string")
    start = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"), none.alias("tool_calls"), none.alias("tool_call_id")))
    asked = chat.appended(start, F.lit("assistant"), F.lit(""), tool_calls=F.concat(F.lit("f"), i))
    done = chat.appended(asked, F.lit("tool"), F.lit("r"), tool_call_id=F.concat(F.lit("c"), i))
    return t.conversations.select("conv_id").distinct().select("conv_id", F.to_json(done).alias("messages"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'search,read' WHEN 1 THEN 'read,write' END AS tools FROM documents WHERE doc_id % 4 < 2")
def agent_tools(t):
    i, known = F.col("doc_id") % 4, F.array(*map(F.lit, ["write", "read", "search"]))
    names = F.when(i == 0, F.array(*map(F.lit, ["search", "gone", "read"]))).when(i == 1, F.array(*map(F.lit, ["read", "write"]))).otherwise(F.array(F.lit("read"), F.lit("gone")))
    return t.documents.select("doc_id", tools.resolvable(names, known).alias("t")).where(F.col("t").isNotNull()).select("doc_id", F.array_join("t", ",").alias("tools"))


@query("""SELECT p_partkey, '{"type":"object","properties":{"size":{"type":"integer","description":"d","default":"' || p_size || '"},"kind":{"type":"string","description":"e","enum":["a","' || p_brand || '"]}},"required":["kind"]}' AS schema FROM part""")
def function_schema_full(t):
    none = F.lit(None).cast("array<string>")
    param = lambda name, kind, text, needed, enum, default: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(text).alias("description"), F.lit(needed).alias("required"), enum.alias("enum"), default.alias("default"))
    params = F.array(param("size", "integer", "d", False, none, F.col("p_size").cast("string")), param("kind", "string", "e", True, F.array(F.lit("a"), F.col("p_brand")), F.lit(None).cast("string")))
    return t.part.select("p_partkey", tools.function_schema(params, ("enum", "default")).alias("schema"))


@query("""SELECT doc_id, 'doc_' || substr(md5('{"a":"' || lang || '","b":"' || source || '","c":"' || doc_id || '"}'), 1, 8) AS id FROM documents""")
def canonical_id(t):
    record = F.create_map(F.lit("c"), F.col("doc_id").cast("string"), F.lit("a"), F.col("lang"), F.lit("b"), F.col("source"))
    return t.documents.select("doc_id", tx.content_id("doc", tx.canonical(record)).alias("id"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 10, r_name FROM region")
def appended_lines(t):
    path = scratch(t.spark, "log") + ".jsonl"
    for shift in (0, 10):
        files.write_jsonl(t.region.select((F.col("r_regionkey") + shift).alias("r_regionkey"), "r_name"), path, mode="append")
    return files.load(t.spark, path, "r_regionkey long, r_name string")


@query("SELECT * FROM (VALUES ('a', 1.0), ('b', -1.0), ('c', 0.0), ('d', 0.0)) AS v(sample_id, reward)")
def sql_rewards(t):
    cases = [("a", "<answer>SELECT r_name FROM region</answer>", "SELECT r_name AS x FROM region ORDER BY 1"), ("b", "no answer", "SELECT 1"), ("c", "<answer>SELECT count(*) FROM nation WHERE n_regionkey = 0</answer>", "SELECT count(*) FROM nation"), ("d", "<answer>SELECT nope FROM region</answer>", "SELECT neither FROM region")]
    return evaluation.rewards(evaluation.evaluate(t.spark, cases, {"region": t.region, "nation": t.nation})).select("sample_id", "reward")


@query("SELECT 'read' AS kind, count(*) AS n FROM region UNION ALL SELECT 'unreadable', 1 UNION ALL SELECT 'no_object', 2")
def json_object_counts(t):
    path = scratch(t.spark, "objects")
    texts = {f"{r['r_regionkey']}.json": '{"k": %d}' % r["r_regionkey"] for r in t.region.select("r_regionkey").collect()}  # five rows
    files.write_texts(t.spark, path, texts | {"a.json": "[1]", "b.json": "3", "c.json": "{open", "d.txt": "x"})
    return files.json_objects(t.spark, path, "k int")[1]
