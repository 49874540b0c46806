"""Streams, and round trips through file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import jsons
from lodestone.plans.registry import query
from lodestone.sources import arrays, files
from lodestone.streaming import events as ev


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(t):
    return ev.tumbling(t.events).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, s""")
def window_session(t):
    return ev.sessions(t.events).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, user_id % 50 AS u FROM events GROUP BY 1, 2")
def stream_distinct(t):
    rows = ev.read_stream(t.spark, f"{t.sf_dir}/events.parquet").select("ts", "event_type", (F.col("user_id") % 50).alias("u"))
    return ev.collect_stream(ev.distinct_within(rows, ["event_type", "u"], "60 days")).select("event_type", "u")


@query("SELECT 'cut-' || doc_id AS id, source AS audio, text, round(n_chars / 15.0, 3) AS duration FROM documents WHERE n_chars >= 15")
def stream_cuts(t):
    """A stream of documents as cuts of speech: their keys mapped, too short ones left out."""
    rows = ev.read_stream(t.spark, f"{t.sf_dir}/documents.parquet", max_files=1)
    cuts = rows.select(F.concat(F.lit("cut-"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("audio"), "text", F.round(F.col("n_chars") / 15.0, 3).alias("duration"))
    return ev.collect_stream(cuts.where(F.col("duration") >= 1.0))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    rows = ev.read_stream(t.spark, f"{t.sf_dir}/events.parquet")
    return ev.collect_stream(ev.tumbling(rows), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT conv_id, coalesce(min(i + 1) FILTER (WHERE e), count(*)) AS turns, CASE WHEN bool_or(e) THEN 'COMPLETED' ELSE 'RUNNING' END AS state FROM (SELECT *, i + 1 >= 5 OR contains(lower(text), 'tion the') AS e FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)) GROUP BY conv_id")
def session_replay(t):
    return ev.replay_sessions(t.conversations.select("conv_id", "turn", "text"), 5, "tion the")


def _trip(t, kind):
    return ev.scratch(t.spark, f"trip-{kind}")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def roundtrip_jsonl(t):
    path = _trip(t, "x") + ".jsonl"
    files.write_jsonl(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.load(t.spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT r_regionkey, r_name FROM region")
def roundtrip_json_array(t):
    path = _trip(t, "x")
    arrays.write_json_arrays(t.region.select("r_regionkey", "r_name"), path)
    return arrays.read_json_arrays(t.spark, path, "r_regionkey int, r_name string")


@query("SELECT s_suppkey, s_name FROM supplier")
def roundtrip_csv(t):
    path = _trip(t, "x") + ".csv"
    t.supplier.select("s_suppkey", "s_name").write.option("header", True).csv(path)
    return files.load(t.spark, path, "s_suppkey long, s_name string")


@query("SELECT doc_id, lang, source FROM documents")
def roundtrip_gzip(t):
    path = _trip(t, "x") + ".jsonl"
    t.documents.select("doc_id", "lang", "source").write.option("compression", "gzip").json(path)
    return files.load(t.spark, path, "doc_id long, lang string, source string")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def roundtrip_split(t):
    path = _trip(t, "x")
    files.write_jsonl(t.documents.where(F.col("lang").isin("en", "fr")).select("doc_id", "lang"), path, by="lang")
    return t.spark.read.schema("doc_id long, lang string").json(path)


@query("SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, source FROM documents WHERE lang = 'en'")
def many_files(t):
    a, b = _trip(t, "a") + ".parquet", _trip(t, "b") + ".parquet"
    files.write_parquet(t.documents.select("doc_id", "source"), a)
    files.write_parquet(t.documents.where(F.col("lang") == "en").select("doc_id", "source"), b)
    return files.load_all(t.spark, [a, b])


@query("SELECT 'u' || item_id AS id, regexp_replace(text, '\\s+', ' ', 'g') AS ref, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS hyp FROM benchmark")
def roundtrip_transcripts(t):
    path = _trip(t, "x")
    flat = F.regexp_replace("text", r"\s+", " ")
    files.write_transcripts(t.benchmark.select(F.concat(F.lit("u"), F.col("item_id").cast("string")).alias("id"), flat.alias("ref"), F.lower(flat).alias("hyp")), path)
    return files.recognition_texts(t.spark, path)


@query("SELECT 'a' || n_nationkey AS audio, n_name AS prompt_text, 'b' AS prompt_audio, 'c' AS text FROM nation WHERE n_nationkey % 2 = 0")
def pipe_labels(t):
    path = _trip(t, "x")
    k = F.col("n_nationkey").cast("string")
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("a"), k, F.lit("|"), "n_name", F.lit("||b|c"))).otherwise(F.concat(F.lit("a|"), k))
    t.nation.select(line.alias("value")).write.text(path)
    return files.pipe_labels(t.spark, path)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_id % 5 > 0")
def lenient_jsonl(t):
    path = _trip(t, "x")
    line = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit("}"))).otherwise(F.lit('{"event_id": oops'))
    t.events.select(line.alias("value")).write.text(path)
    return files.jsonl_lenient(t.spark, path, "event_id long, k int")


@query("SELECT n_nationkey, n_name FROM nation")
def roundtrip_graph(t):
    path = _trip(t, "x")
    files.write_graph(t.nation.select("n_nationkey", "n_name"), t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")), path)
    return files.read_graph(t.spark, path)[0]


@query("SELECT item_id, 'r1' AS run_id FROM benchmark UNION ALL SELECT item_id, 'r2' FROM benchmark WHERE item_id % 2 = 0")
def run_stamped(t):
    path = _trip(t, "x")
    files.write_run(t.benchmark.select("item_id"), path, "r1")
    files.write_run(t.benchmark.where(F.col("item_id") % 2 == 0).select("item_id"), path, "r2")
    return t.spark.read.parquet(path)


@query("SELECT page_id FROM pages WHERE contains(html, '<nav>')")
def page_filter(t):
    return t.pages.where(F.contains("html", F.lit("<nav>"))).select("page_id")


@query("SELECT event_id, 'f' AS name, props AS arguments FROM events UNION ALL SELECT event_id, 'g', '{}' FROM events WHERE event_id % 2 = 0")
def tool_call_rows(t):
    call = F.concat(F.lit('{"name": "f", "arguments": '), "props", F.lit("}"))
    again = F.when(F.col("event_id") % 2 == 0, F.concat(call, F.lit(' then {"arguments": {}, "name": "g"}'))).otherwise("")
    return t.events.select("event_id", F.explode(jsons.tool_calls(F.concat(call, F.lit(" and "), again, F.lit(" "), call))).alias("c")).select("event_id", "c.name", "c.arguments")
