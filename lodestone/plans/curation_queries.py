"""Queries on multimodal records, histories, prompts with schemas, counters, batches and copied files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import plugins
from lodestone.functions import text as tx
from lodestone.operators import curation, graph, metrics
from lodestone.plans.registry import query
from lodestone.sources import files, named
from lodestone.storage import scratch


@query("SELECT doc_id, '<image>' || chr(10) || text || '  Think.' AS content, CASE WHEN doc_id % 5 > 0 THEN 1 ELSE 0 END AS images, CASE WHEN doc_id % 5 > 0 THEN 'img-' || doc_id || '.png' END AS path FROM documents")
def image_prompts(t):
    image = F.when(F.col("doc_id") % 5 > 0, F.encode("source", "utf-8"))
    rows = t.documents.select("doc_id", curation.image_prompt(F.col("text"), "Think.", image, F.concat(F.lit("img-"), F.col("doc_id").cast("string"), F.lit(".png"))).alias("p"))
    return rows.select("doc_id", F.col("p.prompt")[0]["content"].alias("content"), F.size("p.images").alias("images"), F.get("p.images", F.lit(0))["path"].alias("path"))


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND NOT contains(lang || text, '<image') AND doc_id % 4 <> 3")
def one_image_filter(t):
    """Prompts with one image and a truth; every fourth question names a second image."""
    question = F.concat("text", F.when(F.col("doc_id") % 4 == 3, " see <image 2>").otherwise(""))
    rows = t.documents.join(t.labels, "doc_id").withColumn("p", curation.image_prompt(question, "Think.", F.encode("lang", "utf-8"), F.col("lang")))
    return rows.where(curation.one_image_and_truth(F.col("p.prompt"), F.col("quality"))).select("doc_id", "quality")


@query(r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS read FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0 AND n_chars % 11 > 0 AND (n_chars % 11) * 10000000 <= 50000000")
def reading_records(t):
    """Records of pictures n_chars % 11 by 10,000,000 pixels, with each document's text as JSON."""
    truth = F.to_json(F.struct(F.struct(F.col("text").alias("text_sequence")).alias("gt_parse")))
    rows = t.documents.select("doc_id", curation.reading_record("Read the text.", F.col("n_chars") % 11, F.lit(10_000_000), truth).alias("m"))
    return rows.where("m is not null").select("doc_id", F.col("m")[1]["content"].alias("read"))


@query("""WITH r AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'user: ' || event_type WHEN 1 THEN 'agent: ' || event_type
  WHEN 2 THEN 'execution: {' || chr(10) || '  "k": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || chr(10) || '}' || chr(10) || 'execution: "' || event_type || '"' END AS line FROM events)
SELECT user_id, string_agg(line, chr(10) ORDER BY event_id) AS history FROM r WHERE line IS NOT NULL GROUP BY user_id""")
def history_with_results(t):
    kind = F.col("event_id") % 4
    sender = F.when(kind == 0, "user").when(kind == 1, "agent").when(kind == 2, "execution").otherwise("system")
    message = F.when(kind == 2, F.concat(F.lit("["), "props", F.lit(', "'), "event_type", F.lit('"]'))).otherwise(F.col("event_type"))
    return curation.history_with_results(t.events.select("user_id", "event_id", sender.alias("sender"), message.alias("message")), "user_id", "event_id", "sender", "message")


@query("""SELECT item_id, 'Schema:' || chr(10) || 'CREATE TABLE nation (n_nationkey INT, n_name STRING, n_regionkey INT)' || chr(10) || CASE WHEN item_id % 2 = 0 THEN 'Knowledge: item ' || item_id || chr(10) ELSE '' END || 'Question: ' || text AS content FROM benchmark""")
def schema_prompts(t):
    knowledge = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("item "), F.col("item_id").cast("string")))
    chat = curation.schema_chat(F.col("text"), F.lit(curation.ddl("nation", t.nation)), knowledge, "You write SQL.")
    return t.benchmark.select("item_id", chat.alias("c")).select("item_id", F.col("c")[1]["content"].alias("content"))


@query("""WITH m AS (SELECT max(value) / 10 AS w FROM events WHERE value > 0), h AS (SELECT least(CAST(floor(value / w) AS BIGINT), 9) AS b, count(*) AS n FROM events, m WHERE value > 0 GROUP BY 1)
SELECT printf('%.2f-%.2fs', i * w, (i + 1) * w) AS label, coalesce(n, 0) AS n FROM m, range(10) r(i) LEFT JOIN h ON h.b = i""")
def labelled_histogram(t):
    counts = metrics.equi_width_histogram(t.events, "value", 10)
    width = t.events.where("value > 0").agg((F.max("value") / 10).alias("w"))  # one row
    return counts.crossJoin(F.broadcast(width)).select(F.format_string("%.2f-%.2fs", F.col("bucket") * F.col("w"), (F.col("bucket") + 1) * F.col("w")).alias("label"), "n")


@query("""SELECT user_id, concat_ws(',', CASE WHEN run < 0.9 THEN 'run' END, CASE WHEN good < 0.8 THEN 'good' END) AS reasons, concat_ws('; ', CASE WHEN run < 0.9 THEN 'look at errors' END, CASE WHEN good < 0.8 THEN 'compare meanings' END, CASE WHEN good < 0.8 THEN 'match approximately' END) AS advice
FROM (SELECT user_id, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS run, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) AS good FROM events GROUP BY user_id)""")
def recommendations(t):
    share = lambda c: F.avg(c.cast("int"))
    rates = t.events.groupBy("user_id").agg(share(F.col("event_type") != "error").alias("run"), share(F.col("value") > 10).alias("good"))
    reasons, say = curation.advice({c: F.col(c) for c in ("run", "good")}, {"run": 0.9, "good": 0.8}, {"run": "look at errors", "good": "compare meanings"}, {"good": "match approximately"})
    return rates.select("user_id", F.array_join(reasons, ",").alias("reasons"), F.array_join(say, "; ").alias("advice"))


@query("""WITH c AS (SELECT 'l_returnflag' AS counter, l_returnflag AS name, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_partkey', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem GROUP BY 2
  UNION ALL SELECT 'size', CAST(s AS VARCHAR), count(*) FROM (SELECT count(*) AS s FROM lineitem GROUP BY l_orderkey) GROUP BY 2)
SELECT counter, name, n FROM c QUALIFY row_number() OVER (PARTITION BY counter ORDER BY n DESC, name) <= 10""")
def combination_counters(t):
    """What combinations (orders) use most: methods, tools, and how many of them."""
    sizes = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("size"))
    return curation.most_common(t.lineitem, ["l_returnflag", "l_partkey"]).unionByName(curation.most_common(sizes, ["size"]))


_STATUS = """WITH s AS (SELECT lang IN ('en', 'fr') AS valid, source = 'web' AS box_error, n_chars % 10 = 0 AS many_turns, quality, contains(text, '.') AS boxed FROM documents LEFT JOIN labels USING (doc_id)),
k AS (SELECT *, valid AND NOT box_error AND NOT many_turns AS ok FROM s)"""


@query(f"""{_STATUS} SELECT count(*) AS total, count(*) FILTER (WHERE NOT valid) AS format_invalid, count(*) FILTER (WHERE valid AND box_error) AS box_format_error, count(*) FILTER (WHERE valid AND NOT box_error AND many_turns) AS multi_turn_discarded,
 count(*) FILTER (WHERE ok) AS format_valid, count(*) FILTER (WHERE ok AND quality IS NOT NULL) AS judge_success, count(*) FILTER (WHERE ok AND quality IS NULL) AS judge_error, count(*) FILTER (WHERE ok AND quality = 1) AS high_quality,
 count(*) FILTER (WHERE ok AND quality <> 1) AS low_quality, count(*) FILTER (WHERE ok AND quality = 1 AND boxed) AS high_quality_with_box, count(*) FILTER (WHERE ok AND quality = 1 AND NOT boxed) AS high_quality_without_box,
 round(count(*) FILTER (WHERE ok AND quality = 1) / count(*) FILTER (WHERE ok AND quality IS NOT NULL), 6) AS success_rate FROM k""")
def judge_counters(t):
    """Eleven counters of a judge's run, each a row's first status that holds, and the share of good ones among those judged."""
    valid, box, turns_, boxed = F.col("lang").isin("en", "fr"), F.col("source") == "web", F.col("n_chars") % 10 == 0, F.contains("text", F.lit("."))
    ok, q = valid & ~box & ~turns_, F.col("quality")
    counters = {
        "total": F.lit(True), "format_invalid": ~valid, "box_format_error": valid & box, "multi_turn_discarded": valid & ~box & turns_, "format_valid": ok, "judge_success": ok & q.isNotNull(),
        "judge_error": ok & q.isNull(), "high_quality": ok & (q == 1), "low_quality": ok & (q != 1), "high_quality_with_box": ok & (q == 1) & boxed, "high_quality_without_box": ok & (q == 1) & ~boxed,
    }
    row = t.documents.join(t.labels, "doc_id", "left").agg(*(F.count_if(c).alias(k) for k, c in counters.items()))
    return row.withColumn("success_rate", F.round(F.col("high_quality") / F.nullif("judge_success", F.lit(0)), 6))


@query("""WITH e AS (SELECT CASE WHEN value > 50 THEN 'strong' ELSE 'weak' END AS kind, user_id AS src, user_id % 13 + 1000 AS dst FROM events), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e)
SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, (SELECT count(*) FROM n) AS nodes, (SELECT count(DISTINCT dst) FROM e) AS components, (SELECT count(DISTINCT dst) FROM e) = 1 AS connected FROM e GROUP BY kind""")
def graph_edge_kinds(t):
    """Edges by kind, and whether all nodes hang together: users and the thirteen places they go to."""
    edges = t.events.select(F.when(F.col("value") > 50, "strong").otherwise("weak").alias("kind"), "user_id", (F.col("user_id") % 13 + 1000).alias("place"))
    edges = edges.select("kind", F.col("user_id").cast("long").alias("src"), F.col("place").cast("long").alias("dst"))
    nodes = edges.select("src").union(edges.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    # users and places are apart even where their numbers are equal: in the graph a user has an odd number, a place an even one
    ways = edges.select((2 * F.col("src") + 1).alias("src"), (2 * F.col("dst")).alias("dst")).where("src is not null and dst is not null").distinct()
    found = graph.components(ways.select(F.col("src").alias("id")).union(ways.select("dst")).distinct(), ways)
    whole = nodes.crossJoin(found.agg(F.count_distinct("component").alias("components")))  # a row each
    kinds = edges.groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))
    return kinds.crossJoin(F.broadcast(whole)).select("kind", "edges", "sources", "nodes", "components", (F.col("components") == 1).alias("connected"))  # one row


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 160")
def aligned_batch(t):
    return curation.aligned(t.events.select("event_id", "user_id"), "user_id", ["event_id"], 16, 10)


@query("SELECT a.c_custkey, b.o_orderkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) a JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders) b USING (i)")
def zipped_rows(t):
    """Customers beside as many orders, by place."""
    n = t.customer.count()
    orders = t.orders.select("o_orderkey", "o_totalprice")
    from lodestone.operators.ordering import row_numbers

    first = row_numbers(orders, ["o_totalprice", "o_orderkey"], "p").where(F.col("p") <= n).drop("p")
    return curation.zipped(t.customer.select("c_custkey"), ["c_custkey"], first, ["o_totalprice", "o_orderkey"]).select("c_custkey", "o_orderkey")


@query("SELECT event_id, doc_id FROM (SELECT event_id, event_id % 1500 AS i FROM events) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) ON i = k")
def indexed_lookup(t):
    rows = t.events.select("event_id", (F.col("event_id") % 1500).alias("i"))
    return curation.looked_up(rows, "i", t.documents.select("doc_id"), ["doc_id"]).select("event_id", "doc_id")


@query("SELECT 's' || s_suppkey || '.json' AS name, s_acctbal AS score FROM supplier WHERE s_acctbal > 4000")
def copied_files(t):
    """Evaluations of suppliers as files, of which those above a score are copied; what is read back is the copy."""
    source, target = scratch(t.spark, "evaluations"), scratch(t.spark, "good")
    named.write_files(t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("name"), F.to_json(F.struct(F.col("s_acctbal").alias("overall_score"))).alias("content")), source)
    named.copy_above(t.spark, source, target, "overall_score", 4000.0)
    back = t.spark.read.format("binaryFile").load(target)
    return back.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.get_json_object(F.col("content").cast("string"), "$.overall_score").cast("double").alias("score"))


@query("SELECT count(*) AS rows, true AS bounded, true AS kept FROM orders")
def sharded_cache(t):
    """A cache whose files have a thousand rows at most; it is made once."""
    path, made = scratch(t.spark, "shards"), []

    def make():
        made.append(1)
        return t.orders.select("o_orderkey")

    for _ in range(2):
        rows = files.cached(t.spark, path, make, max_rows=1000)
    sizes = rows.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("rows"), (F.max("n") <= 1000).alias("bounded"), F.lit(len(made) == 1).alias("kept"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality * 4, 5.0) >= 3.0")
def default_quality(t):
    """Quality where it is known, 5.0 where it is not, of at least 3.0."""
    return t.documents.join(t.labels, "doc_id", "left").where(F.coalesce(F.col("quality") * 4, F.lit(5.0)) >= 3.0).select("doc_id")


@query("SELECT doc_id, doc_id % 3 > 0 AND doc_id % 5 > 0 AS valid FROM documents")
def think_and_boxes(t):
    """A think pair, an answer, and as many ends of boxes as begins."""
    d = F.col("doc_id")
    reply = F.concat(F.when(d % 3 > 0, "<think>").otherwise(""), F.lit("a</think><answer>"), F.lit("<|begin_of_box|>"), F.col("source"), F.when(d % 5 > 0, "<|end_of_box|>").otherwise(""), F.lit("</answer>"))
    return t.documents.select("doc_id", tx.think_answer_boxes(reply).alias("valid"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 2 * CAST(json_extract(props, '$.k') AS BIGINT) END AS twice FROM events WHERE event_id % 4 <> 3")
def rows_skipped_on_error(t):
    """Rows whose mapping fails are dropped; how many is a count of the ones that failed."""
    props = F.when(F.col("event_id") % 4 == 3, "{broken").otherwise(F.col("props"))
    twice = 2 * F.try_variant_get(F.try_parse_json(props), "$.k", "bigint")
    return t.events.select("event_id", twice.alias("twice")).where("twice is not null")


@query("SELECT event_id, CASE WHEN event_id % 10 = 7 THEN '' ELSE upper(event_type) END AS response, event_id % 10 = 7 AS failed FROM events")
def failing_batches(t):
    """A client that refuses some prompts: its batches (of one) fail, the others go on."""

    def client(prompts):
        if any(p.endswith("7") for p in prompts):
            raise RuntimeError("refused")
        return [p.split(" ")[0].upper() for p in prompts]

    rows = t.events.select("event_id", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("prompt"))
    return plugins.complete(rows, "prompt", client, batch=1).select("event_id", "response", F.col("error").isNotNull().alias("failed"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 10 = 7 THEN -1.0 ELSE n_regionkey * 1.0 END AS score, CASE WHEN n_nationkey % 10 = 7 THEN 'no answer within 0.5 s' END AS error FROM nation")
def scores_within_time(t):
    """A scorer that takes too long for some rows: those have the worst score."""

    def client(prompts):
        import time

        time.sleep(2.0 * any(p.startswith("7:") for p in prompts))
        return [p.split(":")[1] for p in prompts]

    rows = t.nation.select("n_nationkey", F.concat_ws(":", F.col("n_nationkey") % 10, "n_regionkey").alias("prompt"))
    scored = plugins.complete(rows, "prompt", client, batch=1, seconds=0.5)
    return scored.select("n_nationkey", F.when(F.col("error").isNull(), F.col("response").cast("double")).otherwise(-1.0).alias("score"), "error")


@query("WITH RECURSIVE r(root, part, depth) AS (SELECT user_id, event_id, 0 FROM events WHERE event_id < 50 UNION ALL SELECT root, o.o_orderkey, depth + 1 FROM r JOIN orders o ON o.o_custkey = r.part WHERE depth < 2) SELECT root, part, depth FROM r")
def recursive_expansion(t):
    """A recursive query over events and the orders that hang on them."""
    sql = "WITH RECURSIVE r(root, part, depth) AS (SELECT user_id, event_id, 0 FROM {events} WHERE event_id < 50 UNION ALL SELECT root, o.o_orderkey, depth + 1 FROM r JOIN {orders} o ON o.o_custkey = r.part WHERE depth < 2) SELECT root, part, depth FROM r"
    return t.spark.sql(sql, events=t.events, orders=t.orders)
