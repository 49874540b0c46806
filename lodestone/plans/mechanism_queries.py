"""Queries on state, table functions, sinks, sketches, sound and phrases."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import calls, phrases, sound
from lodestone.functions.vectors import rounded
from lodestone.operators import nearness, sketches
from lodestone.plans.registry import query
from lodestone.sources import arrays
from lodestone.storage import scratch
from lodestone.streaming import events as ev
from lodestone.streaming import turns

#: The turns of a conversation stand an hour apart, those of every seventh one two days from the fourth on.
_TURNS = "SELECT conv_id, turn, role, text, TIMESTAMP '2024-01-01' + to_hours(CAST(turn * CASE WHEN conv_id % 7 = 0 AND turn >= 3 THEN 48 ELSE 1 END AS BIGINT)) AS ts FROM conversations"


def _timed(rows):
    hours = F.col("turn") * F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") >= 3), 48).otherwise(1)
    return rows.select("conv_id", "turn", "role", "text", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=hours.cast("int"))).alias("ts"))


@query(f"""WITH t AS ({_TURNS}), e AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM t),
g AS (SELECT *, row_number() OVER w AS i, ts > lag(ts) OVER w + INTERVAL 1 DAY AS silent, row_number() OVER w >= 4 OR contains(lower(coalesce(text, '')), 'tion the') AS said FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, min(i) FILTER (WHERE said) AS stop, min(i) FILTER (WHERE silent) - 1 AS gap FROM g GROUP BY conv_id),
h AS (SELECT g.*, stop, gap, stop IS NOT NULL AND (gap IS NULL OR stop <= gap) AS done FROM g JOIN s USING (conv_id) WHERE i <= least(coalesce(stop, 1000), coalesce(gap, 1000)))
SELECT conv_id, count(*) AS turns, CASE WHEN bool_or(done) THEN 'COMPLETED' WHEN max(gap) IS NOT NULL OR max(ts) + INTERVAL 1 DAY <= (SELECT mark FROM e) THEN 'EXPIRED' ELSE 'PENDING' END AS state FROM h GROUP BY conv_id""")
def turn_loop_states(t):
    """A stream of turns through keyed state: the last state of each session."""
    rows = ev.read_stream(t.spark, f"{t.sf_dir}/conversations.parquet")
    changes = ev.collect_changes(turns.turn_loop(_timed(rows), 4, "tion the", "1 day", "1 hour"))
    return turns.latest_change(changes).select("conv_id", "turns", "state")


@query("SELECT a.event_id AS id, a.event_type AS ref, b.event_type AS hyp FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000 WHERE a.event_type = 'view' AND b.event_type = 'click'")
def joined_in_time(t):
    """Two streams of events: views of a user and clicks at most ten minutes apart."""
    side = lambda kind: ev.read_stream(t.spark, f"{t.sf_dir}/events.parquet").where(F.col("event_type") == kind).select(F.col("user_id").alias("id"), "ts", F.concat_ws(":", "event_type", "event_id").alias("text"))
    found = ev.collect_stream(turns.paired_in_time(side("view"), side("click"), "10 minutes", "400 days"))
    return found.select(F.split("ref", ":")[1].cast("long").alias("id"), F.split("ref", ":")[0].alias("ref"), F.split("hyp", ":")[0].alias("hyp"))


@query("SELECT doc_id, lang, nullif(source, 'web') AS source, n_chars FROM documents")
def json_arrays_sink(t):
    """Documents as JSON arrays in parts that one commit publishes, read again by the manifest."""
    path = scratch(t.spark, "arrays")
    arrays.write_json_arrays(t.documents.select("doc_id", "lang", F.nullif("source", F.lit("web")).alias("source"), "n_chars"), path, part_bytes=100_000)
    return arrays.read_json_arrays(t.spark, path, "doc_id long, lang string, source string, n_chars long")


@query("""SELECT event_id, place, CASE place WHEN 0 THEN event_type ELSE 'again' END AS name, CASE place WHEN 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE place WHEN 1 THEN event_type END AS of
FROM events, range(2) r(place) WHERE place = 0 OR event_id % 2 = 0""")
def tool_call_columns(t):
    """Calls in text by a table function whose columns come from its argument; a lateral join."""
    calls.register(t.spark)
    first = F.to_json(F.struct(F.col("event_type").alias("name"), F.from_json("props", "k long").alias("arguments")))
    second = F.to_json(F.struct(F.lit("again").alias("name"), F.struct(F.col("event_type").alias("of"), F.lit("many").alias("k")).alias("arguments")))
    text = F.concat(F.lit("I call {this} "), first, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" then "), second)).otherwise(" {"))
    return t.spark.sql("SELECT event_id, c.* FROM {rows} r, LATERAL tool_calls(r.text, 'k long, of string') c", rows=t.events.select("event_id", text.alias("text")))


@query("SELECT event_type, count(*) AS n, true AS median_near, true AS high_near, true AS distinct_near FROM events GROUP BY event_type")
def merged_sketches(t):
    """Sketches of four runs, merged, against the exact ranks and counts: within the bounds that the sketches promise."""
    path = scratch(t.spark, "sketches")
    for run in range(4):
        sketches.append_run(sketches.sketched(t.events.where(F.col("event_id") % 4 == run), ["event_type"], "value", "user_id"), path, f"run-{run}")
    some = sketches.merged(t.spark, path, ["event_type"]).select("event_type", "n", *(sketches.quantile(F.col("quantiles"), p).alias(f"q{i}") for i, p in enumerate((0.5, 0.95))), sketches.distinct(F.col("distinct")).alias("d"))
    exact = t.events.join(F.broadcast(some), "event_type").groupBy("event_type", "n").agg(*(F.avg((F.col("value") < F.col(f"q{i}")).cast("double")).alias(f"low{i}") for i in (0, 1)), *(F.avg((F.col("value") <= F.col(f"q{i}")).cast("double")).alias(f"high{i}") for i in (0, 1)), F.count_distinct("user_id").alias("users"), F.first("d").alias("d"))
    near = lambda i, p: (F.col(f"low{i}") - sketches.RANK_ERROR * 2 <= p) & (F.col(f"high{i}") + sketches.RANK_ERROR * 2 >= p)
    return exact.select("event_type", "n", near(0, 0.5).alias("median_near"), near(1, 0.95).alias("high_near"), (F.abs(F.col("d") - F.col("users")) <= F.greatest(F.col("users") * sketches.DISTINCT_ERROR * 4, F.lit(1.0))).alias("distinct_near"))


@query("SELECT doc_id, CAST(ceil((400 + n_chars % 300) * 441 / 320.0) AS BIGINT) AS samples, true AS same_level, true AS same_pitch FROM documents")
def resampled_tones(t):
    """A sine of each document's own pitch from 16 to 22.05 kHz, against the sine at the new rate."""
    pitch, n = F.col("doc_id") % 40 * 100 + 400, (F.col("n_chars") % 300 + 400).cast("int")
    wave = lambda count, rate: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.sin(i * pitch * (2 * 3.141592653589793 / rate)) / 2)
    rows = t.documents.select("doc_id", "n_chars", sound.resampled(wave(n, 16_000), F.lit(16_000), F.lit(22_050)).alias("x"))
    inner = lambda a: F.slice(a, 121, F.size("x") - 240)  # noqa: E731  away from the ends, beyond which is silence
    off = F.array_max(F.zip_with(inner(F.col("x")), inner(wave(F.size("x"), 22_050)), lambda a, b: F.abs(a - b)))
    level = F.array_max(F.transform(inner(F.col("x")), F.abs))
    return rows.select("doc_id", F.size("x").cast("long").alias("samples"), (F.abs(level - 0.5) < 0.02).alias("same_level"), (off < 0.001).alias("same_pitch"))


#: Phrases that overlap and hold each other.
PHRASES = ["an", "and", "andre", "de", "der", "er", "ers", "in", "ing", "nde", "on", "tion", "tions", "s t", "e w"]


@query(f"SELECT doc_id, md5(regexp_replace(text, '{'|'.join(sorted(PHRASES, key=len, reverse=True))}', '[*]', 'g')) AS rewritten FROM documents")
def phrase_rewriting(t):
    table = t.spark.createDataFrame([(p, "[*]") for p in PHRASES], T.StructType().add("phrase", "string").add("to", "string"))
    return t.documents.select("doc_id", F.md5(phrases.rewriter(table, "phrase", "to")(F.col("text")).cast("binary")).alias("rewritten"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.42")
def near_vector_pairs(t):
    return nearness.near_pairs(t.embeddings, "vec_id", "embedding", 0.42, block=64)[0].select("a", "b", rounded(F.col("cosine"), 6).alias("cosine"))
