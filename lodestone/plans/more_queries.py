"""Sources by folder, typed records, summaries, routing and combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph, sampling
from lodestone.plans.registry import query
from lodestone.sources import files
from lodestone.streaming import events as ev


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'fr'")
def folder_skip_list(t):
    path = ev.scratch(t.spark, "folder")
    for lang in ("en", "fr", "de", "es"):
        part = t.documents.where(F.col("lang") == lang).select("doc_id", "lang")
        part.coalesce(1).write.mode("append").parquet(f"{path}/{'CC3M-' if lang == 'fr' else ''}{lang}")
    return files.parquet_folder(t.spark, path, "cc3m|558k").select("doc_id", "lang")


@query("SELECT n_nationkey, n_name, true AS named FROM nation")
def json_folder(t):
    path = ev.scratch(t.spark, "docs")
    t.nation.select("n_nationkey", "n_name").write.option("maxRecordsPerFile", 1).json(path)  # one document a file
    rows = files.json_folder(t.spark, path, "n_nationkey int, n_name string")
    return rows.select("n_nationkey", "n_name", F.endswith("_source_file", F.lit(".json")).alias("named"))


@query("SELECT count(*) AS n FROM region")
def latest_file(t):
    path = ev.scratch(t.spark, "runs")
    t.region.limit(1).coalesce(1).write.parquet(f"{path}/a")
    t.region.coalesce(1).write.parquet(f"{path}/b")
    return t.spark.read.parquet(files.latest_of(t.spark, path, ["*.none", "*.parquet"])).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey FROM supplier")
def cached_table(t):
    path = ev.scratch(t.spark, "cache")
    for _ in range(2):
        rows = files.cached(t.spark, path, lambda: t.supplier.select("s_suppkey"))
    return rows


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN 't' || event_id END, 'i' || event_id) AS id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, 'agent') AS role FROM events WHERE event_id % 7 <> 0 OR event_id % 3 > 0")
def typed_trajectory(t):
    i = F.col("event_id")
    raw = t.events.select("event_id", F.when(i % 3 > 0, F.concat(F.lit("t"), i.cast("string"))).alias("trajectory_id"), F.when(i % 7 != 0, F.concat(F.lit("i"), i.cast("string"))).alias("id"), F.array(F.struct(F.when(i % 2 == 0, F.col("event_type")).alias("role"), F.lit("agent").alias("speaker"))).alias("turns"))
    rows = raw.select("event_id", F.coalesce("trajectory_id", "id").alias("id"), F.transform("turns", lambda x: F.coalesce(x["role"], x["speaker"])).alias("r"))
    return rows.where(F.col("id").isNotNull()).select("event_id", "id", F.col("r")[0].alias("role"))


@query("SELECT doc_id, text AS before, lower(text) AS after FROM documents ORDER BY md5(doc_id || '-42'), doc_id LIMIT 1")
def before_after_sample(t):
    done = t.documents.select("doc_id", F.lower("text").alias("after"))
    one = sampling.sample(t.documents.select("doc_id", F.col("text").alias("before")), "doc_id", 1)
    return one.join(done, "doc_id")


@query("SELECT event_type, user_id % 3 AS setting, round(100.0 * sum(event_id % 5) / sum(event_id % 11 + 5), 6) AS error_rate FROM events GROUP BY 1, 2")
def error_rate_summary(t):
    g = t.events.groupBy("event_type", (F.col("user_id") % 3).alias("setting"))
    return g.agg(F.round(100.0 * F.sum(F.col("event_id") % 5) / F.sum(F.col("event_id") % 11 + 5), 6).alias("error_rate")).orderBy("error_rate")


@query()
def tool_combinations(t):
    """Walks of each label's first vector, padded to three members from the label, at most six."""
    edges = graph.similarity_edges(t.embeddings, "vec_id", "embedding", 0.3, 0.3, 10)
    starts = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("id"))
    walk = graph.random_walks(edges, starts.select("id"), 5).groupBy("start").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    spare = t.embeddings.groupBy("label").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, 3).alias("spare"))
    rows = starts.join(walk, F.col("id") == F.col("start")).join(spare, "label")
    ids = F.when(F.size("ids") < 3, F.slice(F.array_distinct(F.concat("ids", "spare")), 1, 3)).otherwise(F.slice("ids", 1, 6))
    return rows.select("label", F.array_join(ids, ",").alias("members"))


@query("SELECT c_custkey, dist FROM (SELECT c_custkey, levenshtein(c_name, c_mktsegment) AS dist FROM customer)")
def edit_distance(t):
    return t.customer.select("c_custkey", F.levenshtein("c_name", "c_mktsegment").cast("long").alias("dist"))
