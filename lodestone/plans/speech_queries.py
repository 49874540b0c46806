"""Transcript errors, speech data and batches over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import align
from lodestone.functions import text as tx
from lodestone.operators import batching, recognition, sampling
from lodestone.operators import speech as sp
from lodestone.plans.registry import query
from lodestone.sources import files
from lodestone.storage import bounded, scratch

# Words of conversations against a changed copy: "th" and "an" are misheard as what no word has; of texts of 8 words or more, fewer than a
# third of them misheard, a word is put in front and the last one lost. So the least alignment is known.
_WORDS = r"SELECT conv_id, role, w, list_transform(w, lambda x: replace(replace(x, 'th', 'tqz'), 'an', 'uqz')) AS m FROM (SELECT conv_id, role, regexp_extract_all(text, '[^ \t\r\n]+') AS w FROM conversations)"
_SHIFT = f"SELECT *, len(w) >= 8 AND 3 * wrong < len(w) AS shifted FROM (SELECT *, len(list_filter(list_zip(w, m), lambda p: p[1] <> p[2])) AS wrong FROM ({_WORDS}))"
_FRONT = f"SELECT *, CASE WHEN shifted THEN len(list_filter(list_zip(w[:-2], m[:-2]), lambda p: p[1] <> p[2])) ELSE wrong END AS s FROM ({_SHIFT})"


def _heard(t, shift: bool = True):
    w = F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0))
    rows = t.conversations.select("conv_id", "role", w.alias("ref"), F.transform(w, lambda x: F.replace(F.replace(x, F.lit("th"), F.lit("tqz")), F.lit("an"), F.lit("uqz"))).alias("hyp"))
    if not shift:
        return rows
    wrong = F.size(F.filter(F.arrays_zip("ref", "hyp"), lambda p: p["ref"] != p["hyp"]))
    moved = F.concat(F.array(F.lit("zzz")), F.slice("hyp", F.lit(1), F.greatest(F.size("hyp") - 1, F.lit(0))))
    return rows.withColumn("hyp", F.when((F.size("ref") >= 8) & (3 * wrong < F.size("ref")), moved).otherwise(F.col("hyp")))


@query(f"SELECT role, CAST(sum(len(w)) AS BIGINT) AS n, CAST(sum(len(w) - s - shifted :: INT) AS BIGINT) AS c, CAST(sum(s) AS BIGINT) AS s, count(*) FILTER (shifted) AS d, count(*) FILTER (shifted) AS i, round(100.0 * (sum(s) + 2 * count(*) FILTER (shifted)) / nullif(sum(len(w)), 0), 6) AS wer FROM ({_FRONT}) GROUP BY role")
def word_error_totals(t):
    return recognition.totals(recognition.aligned_pairs(_heard(t), "ref", "hyp", "role"), "role")


_CLASS = "CASE WHEN regexp_matches(b, '^[0-9]+$') THEN 'Number' WHEN regexp_matches(b, '^\\p{Han}+$') THEN 'Mandarin' WHEN regexp_matches(b, '^\\p{Latin}+$') THEN 'English' WHEN regexp_matches(b, '^\\p{Hiragana}+$') THEN 'Japanese' ELSE 'Other' END"
_PAIRS = f"SELECT unnest(w) AS r, unnest(m) AS h FROM ({_WORDS})"


@query(f"SELECT script, count(*) AS n, count(*) FILTER (r = h) AS c, count(*) FILTER (r <> h) AS s, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS i, round(100.0 * count(*) FILTER (r <> h) / count(*), 6) AS wer FROM (SELECT r, h, {_CLASS} AS script FROM (SELECT *, regexp_replace(r, '[&''@℃=.\\-_#+;]', '', 'g') AS b FROM ({_PAIRS}))) GROUP BY script")
def script_error_totals(t):
    return recognition.by_script(recognition.aligned_pairs(_heard(t, False), "ref", "hyp"))


@query(f"SELECT word, CAST(sum(a) AS BIGINT) AS corr, CAST(sum(e) AS BIGINT) AS tot_errs, CAST(sum(x) AS BIGINT) AS in_ref, CAST(sum(y) AS BIGINT) AS in_hyp FROM (SELECT r AS word, (r = h) :: INT AS a, (r <> h) :: INT AS e, 1 AS x, 0 AS y FROM ({_PAIRS}) UNION ALL SELECT h, 0, (r <> h) :: INT, 0, 1 FROM ({_PAIRS})) GROUP BY word")
def word_stats(t):
    return recognition.by_word(recognition.aligned_pairs(_heard(t, False), "ref", "hyp"))


# Where a word was put in front and the last one is lost, ties decide: through the misheard words at the start, each stands beside the one
# before it, and the last of them is the insertion.
_LEAD = f"SELECT *, coalesce(list_min(list_filter(range(1, len(w) + 1), lambda i: w[i] = m[i])), len(w) + 1) - 1 AS k FROM ({_SHIFT})"
_STEPS = f"""SELECT unnest(CASE WHEN NOT shifted THEN list_transform(range(1, len(w) + 1), lambda i: {{'r': w[i], 'h': m[i]}}) ELSE list_concat(
  list_transform(range(1, k + 1), lambda i: {{'r': w[i], 'h': CASE WHEN i = 1 THEN 'zzz' ELSE m[i - 1] END}}), [{{'r': '', 'h': CASE WHEN k = 0 THEN 'zzz' ELSE m[k] END}}],
  list_transform(range(k + 1, len(w)), lambda i: {{'r': w[i], 'h': m[i]}}), [{{'r': w[len(w)], 'h': ''}}]) END, recursive := true) FROM ({_LEAD})"""


@query(f"""SELECT word, CAST(sum(a) AS BIGINT) AS corr, CAST(sum(e) AS BIGINT) AS tot_errs, CAST(sum(x) AS BIGINT) AS in_ref, CAST(sum(y) AS BIGINT) AS in_hyp
FROM (SELECT r AS word, (r = h) :: INT AS a, (r <> h) :: INT AS e, 1 AS x, 0 AS y FROM ({_STEPS}) UNION ALL SELECT h, 0, (r <> h) :: INT, 0, 1 FROM ({_STEPS})) WHERE word <> '' GROUP BY word""")
def word_stats_with_gaps(t):
    """Errors by word where words are inserted and lost, too."""
    return recognition.by_word(recognition.aligned_pairs(_heard(t), "ref", "hyp"))


@query(f"""SELECT script, count(*) FILTER (r <> '') AS n, count(*) FILTER (r = h) AS c, count(*) FILTER (r <> h AND r <> '' AND h <> '') AS s, count(*) FILTER (h = '') AS d, count(*) FILTER (r = '') AS i, round(100.0 * count(*) FILTER (r <> h) / nullif(count(*) FILTER (r <> ''), 0), 6) AS wer
FROM (SELECT r, h, {_CLASS} AS script FROM (SELECT *, regexp_replace(CASE r WHEN '' THEN h ELSE r END, '[&''@℃=.\\-_#+;]', '', 'g') AS b FROM ({_STEPS}))) GROUP BY script""")
def script_totals_with_gaps(t):
    return recognition.by_script(recognition.aligned_pairs(_heard(t), "ref", "hyp"))


@query(r"""SELECT conv_id, turn, array_to_string(flatten(list_transform(list_filter(list_transform(list_filter(list_transform(regexp_extract_all(text, '[^ \t\r\n]+'), lambda x: upper(replace(x, 'ß', 'ss'))), lambda x: x NOT IN ('THE', 'UND')), lambda x: regexp_replace(x, '<[^>]*>?', '', 'g')), lambda x: x <> ''),
 lambda x: CASE x WHEN 'CAN' THEN ['C', 'AN'] WHEN 'IS' THEN ['I', 'S'] ELSE [x] END)), ' ') AS tokens FROM conversations""")
def normalised_tokens(t):
    w = F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0))
    return t.conversations.select("conv_id", "turn", F.array_join(recognition.normalised_tokens(w, ["THE", "UND"], {"CAN": ["C", "AN"], "IS": ["I", "S"]}), " ").alias("tokens"))


@query(f"SELECT conv_id, role, CASE WHEN len(w) = 0 THEN 1.0 ELSE round(wrong * 1.0 / len(w), 4) END AS hypo_wer FROM ({_SHIFT}) WHERE len(w) > 0 AND round(wrong * 1.0 / len(w), 4) <= 0.1")
def hypothesis_filter(t):
    rows = bounded(_heard(t, False)).select("conv_id", "role", recognition.hypothesis_error(F.col("ref"), F.col("hyp")).alias("hypo_wer"))
    return rows.where(F.col("hypo_wer") <= 0.1)


@query("""WITH RECURSIVE o AS (SELECT doc_id, n_chars, ntile(30) OVER w AS tile, row_number() OVER w AS number FROM documents WINDOW w AS (ORDER BY n_chars, doc_id)),
r AS (SELECT doc_id, n_chars, tile, number, number AS batch, n_chars AS total FROM o WHERE number = 1 UNION ALL
  SELECT o.doc_id, o.n_chars, o.tile, o.number, CASE WHEN o.tile = r.tile AND r.total + o.n_chars <= 50000 THEN r.batch ELSE o.number END, CASE WHEN o.tile = r.tile AND r.total + o.n_chars <= 50000 THEN r.total + o.n_chars ELSE o.n_chars END FROM r JOIN o ON o.number = r.number + 1)
SELECT doc_id, n_chars, tile, batch FROM r""")
def duration_buckets(t):
    return batching.duration_batches(t.documents, "doc_id", "n_chars", 30, 50000, segment=100)


@query("WITH g AS (SELECT user_id, max(event_id) AS done, max(value) > 2 * avg(value) AS valid FROM events GROUP BY user_id), n AS (SELECT *, row_number() OVER (ORDER BY done, user_id) AS i FROM g WHERE valid) SELECT user_id, done, valid FROM g WHERE NOT EXISTS (SELECT 1 FROM n WHERE i = 25) OR (done, user_id) <= (SELECT (done, user_id) FROM n WHERE i = 25)")
def valid_groups_until(t):
    groups = t.events.groupBy("user_id").agg(F.max("event_id").alias("done"), (F.max("value") > 2 * F.avg("value")).alias("valid"))
    return batching.until_valid(groups, "user_id", "done", "valid", 25)


@query("WITH k AS (SELECT event_id, event_id // 100 AS batch FROM events WHERE value > 30) SELECT event_id, batch FROM k ORDER BY batch, event_id LIMIT 200")
def batches_until_full(t):
    rows = t.events.where(F.col("value") > 30).select("event_id", F.expr("event_id div 100").alias("batch"))
    return batching.until_full(rows, "batch", "event_id", 200, 1000)


@query("SELECT doc_id, k, CASE WHEN k = 0 THEN '' ELSE array_to_string(list_transform(range(k), lambda i: '<|s_' || (doc_id + i) || '|>'), '') END AS prefix FROM (SELECT doc_id, least(CAST(floor((CAST('0x' || substr(md5(doc_id || '-42'), 1, 7) AS BIGINT) % 100 / 100.0 * 4 + 1) * 25) AS BIGINT), n_chars % 60) AS k FROM documents)")
def speech_prefix(t):
    codes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_chars").cast("long") % 60), lambda i: F.col("doc_id") + i)
    codes = F.slice(codes, F.lit(1), (F.col("n_chars") % 60).cast("int"))
    part = sp.prefix(codes, sampling.bucket("doc_id", 100) / 100.0)
    return t.documents.select("doc_id", F.size(part).cast("long").alias("k"), tx.speech_tokens(part).alias("prefix"))


@query("""SELECT doc_id, CASE kind WHEN 0 THEN 'user:a' || doc_id || '#assistant:b#user:c d#assistant:e#user:<speech>#assistant:' || lang WHEN 1 THEN 'user:' || CASE WHEN u < 30 THEN 'Transcribe the following audio into text:\\n\\n<speech>#assistant:' || lang ELSE 'Continue the following text using less than 50 words:\\n\\n<speech>#assistant:' || source END ELSE 'user:<speech>#assistant:' || lang END AS messages
FROM (SELECT *, doc_id % 3 AS kind, CAST('0x' || substr(md5(doc_id || '-42'), 1, 7) AS BIGINT) % 100 AS u FROM documents)""")
def speech_task(t):
    kind = F.col("doc_id") % 3
    question = F.when(kind == 0, F.concat(F.lit("USER: a"), F.col("doc_id").cast("string"), F.lit(" ASSISTANT: b USER: c d ASSISTANT: e <USER>: last")))
    messages = sp.messages(question, F.when(kind == 0, 3), F.when(kind == 1, F.col("source")), F.col("lang"), sampling.bucket("doc_id", 100) / 100.0)
    return t.documents.select("doc_id", F.array_join(F.transform(messages, lambda m: F.concat_ws(":", m["role"], m["content"])), "#").alias("messages"))


@query("SELECT doc_id, CASE WHEN english THEN 'en' ELSE 'zh' END AS kind, source AS response FROM (SELECT *, total > 0 AND latin > 0.5 * total AND cjk <= 0.05 * total AS english FROM (SELECT *, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '[一-鿿]')) AS cjk, len(regexp_extract_all(text, '\\p{L}')) AS total FROM documents)) WHERE doc_id % 4 > 0")
def generated_messages(t):
    response = F.when(F.col("doc_id") % 4 == 0, F.concat("source", F.lit(" <IMAGE> x"))).otherwise(F.col("source"))
    rows = t.documents.select("doc_id", sp.generated(F.col("text"), response, F.lit("en"), F.lit("zh")).alias("m")).where(F.col("m").isNotNull())
    return rows.select("doc_id", F.col("m")[0]["content"].alias("kind"), F.col("m")[1]["content"].alias("response"))


@query("SELECT doc_id, n <= 100 AS held_out FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '-42') DESC, doc_id DESC) AS n FROM documents)")
def last_holdout(t):
    return sampling.holdout(t.documents.select("doc_id"), "doc_id", 100)


@query("SELECT r_regionkey, r_regionkey + 3 AS length, CAST(sum(x) AS BIGINT) AS total FROM (SELECT r_regionkey, unnest(range(r_regionkey + 3)) * 2 AS x FROM region) GROUP BY r_regionkey")
def npy_units(t):
    path = scratch(t.spark, "units")
    keys = [r["r_regionkey"] for r in t.region.select("r_regionkey").collect()]  # five rows
    files.write_npy(t.spark, path, {f"u{k}.npy": [2 * i for i in range(k + 3)] for k in keys})
    records = t.region.select("r_regionkey", F.concat(F.lit("u"), F.col("r_regionkey").cast("string"), F.lit(".npy")).alias("units"), (F.col("r_regionkey") + 3).alias("length"))
    rows = files.npy_units(t.spark, records, path)
    return rows.select("r_regionkey", F.col("length").cast("long").alias("length"), F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT 'r' || r_regionkey || '.wav' AS name, CAST(8000 AS INT) AS rate, 100 * (r_regionkey + 1) AS samples, 0.5 AS peak FROM region")
def wav_folder(t):
    path = scratch(t.spark, "sound")
    keys = [r["r_regionkey"] for r in t.region.select("r_regionkey").collect()]  # five rows
    files.write_wav(t.spark, path, {f"{k % 2}/r{k}.wav": [0.5, -0.25] * (50 * (k + 1)) for k in keys}, 8000)
    rows = files.wav_samples(t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)).join(files.audio_files(t.spark, path).select("path"), "path")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "rate", F.size("samples").cast("long").alias("samples"), F.round(F.array_max("samples"), 3).cast("double").alias("peak"))


@query("SELECT vec_id, round(rms * 0.1 / nullif(least(rms, 1e9), 0) / 0.1, 4) AS snr_kept FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding) + 1e-8) AS rms FROM embeddings)")
def noise_at_ratio(t):
    """Noise of 20 dB below: the noise that is added has a tenth of the signal's level."""
    noise = F.reverse("embedding")
    mixed = sp.mix(F.col("embedding"), noise, F.lit(20.0))
    added = F.zip_with(mixed, "embedding", lambda a, b: a - b)
    return t.embeddings.select("vec_id", F.round(10 * sp.level(added) / sp.level(F.col("embedding")), 4).alias("snr_kept"))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * 1.0 + CASE WHEN i > 2 THEN 0.5 * e[i - 2] ELSE 0 END)), 5) AS total FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def room_response(t):
    wet = sp.convolved(F.col("embedding"), F.array(F.lit(2.0), F.lit(0.0), F.lit(1.0)))
    return t.embeddings.select("vec_id", F.round(F.aggregate(wet, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"SELECT 'sub' AS op, r AS ref, h AS hyp, count(*) AS n FROM ({_PAIRS}) WHERE r <> h GROUP BY r, h")
def substitution_histogram(t):
    pairs = recognition.aligned_pairs(_heard(t, False), "ref", "hyp")
    return pairs.where(F.col("op") != "cor").groupBy("op", "ref", "hyp").agg(F.count("*").alias("n"))


@query()
def characterised(t):
    return bounded(t.documents).select("doc_id", F.size(align.characterised("text")).alias("n"), align.display_width("text").alias("width"))
