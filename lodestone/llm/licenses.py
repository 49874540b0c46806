"""Licence recognition by sentence rules, in DataFrame operations only.

A text is cut into sentences, each normalised sentence is mapped to the identifier of a known licence sentence, and
the identifiers, in their order in the text, are matched against ordered licence rules. A rule consumes the sentences
that it matches, so a later rule can't take them again. Each document is a row of its own: no shuffle, no join, so
neither long texts nor common licence lines gather anywhere.

Every known sentence holds one of the SIGNS; only texts with one are cut and looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import license_rules

SENTENCES, NAMES, RULES = license_rules.sentences(), license_rules.names(), license_rules.rules()
KEYS = {license_rules.joined(name): key for name, key in NAMES.items()}
HEAD, ALONE, JOINT, ASIDE = license_rules.HEAD, license_rules.ALONE, license_rules.JOINT, license_rules.ASIDE
#: Each known sentence has one of these, before it is normalised; texts without them are not cut.
SIGNS = (
    r"(?i)licen[cs]e|(?:ed|able)[^A-Za-z0-9]+under|subject[^A-Za-z0-9]+to|cc0|cc[^A-Za-z0-9]+by|creative[^A-Za-z0-9]+commons|copyright|warrant|public[^A-Za-z0-9]+domain|free[^A-Za-z0-9]+software"
    r"|rights[^A-Za-z0-9]+reserved|permi[st]|redistribut|liable|endorse|anyone[^A-Za-z0-9]+is|a[^A-Za-z0-9]+copy[^A-Za-z0-9]+of[^A-Za-z0-9]+the|merchantability"
)
#: A sentence ends at punctuation before white space, and where a line without letters and digits follows.
BREAKS = r"[.!?;:]+[ \t\n\f\r]+|\n[^A-Za-z0-9\n]*\n"
#: A colon that ends no sentence.
COLON = r"(?i)(licen[cs]e|license-identifier):"
#: Sentences that speak of a licence without being known.
SPEAKS = r"\blicen[cs]ed? under\b|\bunder the terms of\b.*\blicen[cs]e\b|\bpermission (is|to) .*\bgranted\b|\bredistributions?\b.*\b(permitted|allowed)\b|\bspdx license identifier\b|\bgoverned by\b.*\blicen[cs]e\b"


def _plain(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.array(*map(F.lit, table.values())), F.array_position(F.array(*map(F.lit, table)), key).cast("int"))


def _identifiers(sentence: Column) -> Column:
    """The identifiers of a normalised sentence in their order, or null. Sets are looked up by hash, so most sentences end there.

    A known sentence has one; a head with names between "and" and "or" has that of each name.
    """
    head = F.regexp_extract(sentence, HEAD, 0)
    name = F.substring(sentence, F.length(head) + 1, F.length(sentence))
    for words, closed in license_rules.WHOLE.items():
        name = F.replace(name, F.lit(words), F.lit(closed))
    parts = F.split(F.regexp_replace(name, ASIDE, ""), JOINT)
    named = ((head != "") | (F.rlike(sentence, F.lit(ALONE)) & (F.size(parts) == 1))) & F.forall(parts, lambda p: p.isin(list(KEYS)))
    return F.when(sentence.isin(list(SENTENCES)), F.array(_looked_up(sentence, SENTENCES))).when(named, F.transform(parts, lambda p: _looked_up(p, KEYS)))


def scan(docs: DataFrame, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_sentences, n_known, n_left, sentence_ids, licenses, licensed, status.

    ``n_sentences``: of a text with one of the SIGNS, else 0. A known sentence may run over several lines; in a sentence
    that isn't known, each of its lines may be one.
    ``sentence_ids``: identifiers of known sentences in their order, comma-joined; ``n_left``: those that no rule
    consumed. ``licenses``: those whose rules match, in rule order; ``status``: ``licensed`` if there is one, else
    ``partial`` if sentences are known, ``unknown`` if a sentence speaks of a licence, ``none``. A null or empty text has
    no sentence. Repeated rows and null ids keep their rows; other columns are not read.
    """
    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<string>")
    cut = F.when(F.rlike(text, F.lit(SIGNS)), F.split(F.regexp_replace(text, COLON, "$1 "), BREAKS)).otherwise(none)
    blocks = F.filter(F.transform(cut, lambda s: F.struct(_plain(s).alias("plain"), s.alias("raw"))), lambda b: b["plain"] != "")
    blocks = F.transform(blocks, lambda b: F.struct(b["plain"].alias("plain"), b["raw"].alias("raw"), _identifiers(b["plain"]).alias("id")))
    rows = docs.select("doc_id", blocks.alias("b"))
    lines = lambda b: F.when(b["id"].isNotNull(), b["id"]).when(F.contains(b["raw"], F.lit("\n")), F.flatten(F.array_compact(F.transform(F.split(b["raw"], "\n"), lambda s: _identifiers(_plain(s)))))).otherwise(none)
    ids = F.array_compact(F.flatten(F.transform("b", lines)))
    rows = rows.select("doc_id", F.size("b").cast("long").alias("n_sentences"), ids.alias("ids"), F.exists("b", lambda b: F.rlike(b["plain"], F.lit(SPEAKS))).alias("speaks"))

    order = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in rules))
    start = F.struct(F.concat(F.lit(""), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")).alias("seq"), none.alias("found"))
    match = lambda a, r: F.struct(F.replace(a["seq"], r["ids"], F.lit("|")).alias("seq"), F.when(F.contains(a["seq"], r["ids"]), F.array_append(a["found"], r["name"])).otherwise(a["found"]).alias("found"))
    rows = rows.withColumn("m", F.when(F.size("ids") > 0, F.aggregate(order, start, match)).otherwise(start))
    left = F.length("m.seq") - F.length(F.replace("m.seq", F.lit("<"), F.lit("")))
    found = F.array_distinct("m.found")
    status = F.when(F.size(found) > 0, "licensed").when(F.size("ids") > 0, "partial").when(F.col("speaks"), "unknown").otherwise("none")
    return rows.select(
        "doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), left.cast("long").alias("n_left"), F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(found, ",").alias("licenses"), (F.size(found) > 0).alias("licensed"), status.alias("status"),
    )


def oracle_sql() -> str:
    pairs = lambda table: ", ".join(f"('{s}', '{k}')" for s, k in table.items())
    closed = "substr(s, length(head) + 1)"
    for words, whole in license_rules.WHOLE.items():
        closed = f"replace({closed}, '{words}', '{whole}')"
    keyed = lambda columns, rows: rf"""SELECT {columns}, t.s, CASE WHEN text_key IS NOT NULL THEN [text_key] WHEN len(list_filter(keys, lambda k: k IS NULL)) = 0 AND (head <> '' OR len(keys) = 1 AND regexp_matches(t.s, '{ALONE}')) THEN keys END AS key
  FROM (SELECT *, list_transform(regexp_split_to_array(regexp_replace({closed}, '{ASIDE}', '', 'g'), '{JOINT}'), lambda p: nm[p]) AS keys FROM (SELECT *, regexp_extract(s, '{HEAD}') AS head FROM {rows}), nm) t LEFT JOIN known ON t.s = known.s"""  # noqa: E731
    rules = ", ".join(f"({i}, '{name}', '{''.join(f'<{x}>' for x in ids)}')" for i, (name, ids) in enumerate(RULES))
    return rf"""
WITH RECURSIVE known(s, text_key) AS (VALUES {pairs(SENTENCES)}),
names(name, name_key) AS (VALUES {pairs(KEYS)}),
nm AS (SELECT map(list(name), list(name_key)) AS nm FROM names),
rules(n, name, ids) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, s[i] AS s, i FROM (SELECT r, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT r, regexp_split_to_array(regexp_replace(text, '{COLON}', '\1 ', 'g'), '{BREAKS}') AS s FROM d WHERE regexp_matches(text, '{SIGNS}')))),
p AS (SELECT * FROM (SELECT r, i, s AS raw, trim(lower(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))) AS s FROM w) WHERE s <> ''),
q AS ({keyed('r, i, raw', 'p')}),
l AS (SELECT r, i, j, trim(lower(regexp_replace(s[j], '[^A-Za-z0-9]+', ' ', 'g'))) AS s FROM (SELECT r, i, s, unnest(range(1, len(s) + 1)) AS j FROM (SELECT r, i, string_split(raw, chr(10)) AS s FROM q WHERE key IS NULL AND contains(raw, chr(10))))),
a AS (SELECT r, i, j, unnest(coalesce(key, [NULL])) AS key, unnest(range(len(coalesce(key, [NULL])))) AS u FROM (SELECT r, i, 0 AS j, key FROM q UNION ALL SELECT r, i, j, key FROM ({keyed('r, i, j', 'l')}))),
k AS (SELECT * FROM (SELECT r, count(*) AS n_sentences, bool_or(regexp_matches(s, '{SPEAKS}')) AS speaks FROM q GROUP BY r) JOIN
  (SELECT r, count(key) AS n_known, coalesce(string_agg(key, ',' ORDER BY i, j, u) FILTER (key IS NOT NULL), '') AS sentence_ids,
    coalesce(string_agg('<' || key || '>', '' ORDER BY i, j, u) FILTER (key IS NOT NULL), '') AS seq FROM a GROUP BY r) USING (r)),
m AS (SELECT r, 0 AS n, seq, [] :: VARCHAR[] AS found FROM k WHERE n_known > 0 UNION ALL
  SELECT r, m.n + 1, replace(m.seq, ids, '|'), CASE WHEN contains(m.seq, ids) AND NOT list_contains(found, name) THEN list_append(found, name) ELSE found END FROM m JOIN rules ON rules.n = m.n),
e AS (SELECT * FROM m WHERE n = {len(RULES)})
SELECT doc_id, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known,
  CAST(coalesce(length(e.seq) - length(replace(e.seq, '<', '')), 0) AS BIGINT) AS n_left, coalesce(sentence_ids, '') AS sentence_ids,
  coalesce(array_to_string(found, ','), '') AS licenses, coalesce(len(found), 0) > 0 AS licensed,
  CASE WHEN coalesce(len(found), 0) > 0 THEN 'licensed' WHEN coalesce(n_known, 0) > 0 THEN 'partial' WHEN coalesce(speaks, false) THEN 'unknown' ELSE 'none' END AS status
FROM d LEFT JOIN k USING (r) LEFT JOIN e USING (r)"""
