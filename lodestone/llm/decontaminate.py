"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

1. Count how often each benchmark term occurs in the documents (partial sums, so a very common term is no hot key).
2. For each benchmark window take its two rarest terms. A window with a term that never occurs can't match.
3. Store the postings (term, doc_id, pos) of those probe terms: the positional index.
4. Intersect the posting lists, offset-adjusted, from the rarest term on: what is left are alignments
   (doc_id, item, shift) of an item to a document.
5. Compare the item's words with the document's at each alignment, so matches are exact whatever step 4 let through.

Windows of different items or of one item at neighbouring places share an alignment, so long passages stay cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_BYTES, measured, small, split_words, spread_join, stored, words

WINDOW = 10


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Items (item, item_id, words) and their windows (item, at, terms). ``item`` identifies the row by its content."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("item", F.xxhash64(F.coalesce("item_id", F.lit("\0")), F.array_join("words", " "))).dropDuplicates(["item"])
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0))))
    windows = items.select("item", "words", at.alias("at")).select("item", "at", F.slice("words", F.col("at") + 1, window).alias("terms"))
    return items, windows


def _tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term), one row for each word. The array of words does not travel with its rows."""
    split = docs.select("doc_id", split_words(F.col("text")).alias("w"))
    lead = F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0)
    rows = split.select("doc_id", lead.alias("lead"), F.posexplode("w").alias("pos", "term"))
    return rows.where(F.col("term") != "").select("doc_id", (F.col("pos") - F.col("lead")).alias("pos"), "term")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` (term) occurs in all documents. Tokens are counted before they meet terms that are many."""
    tokens = _tokens(docs).select("term")
    if measured(terms) <= BROADCAST_BYTES:
        return tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return tokens.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term")


def positional_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Stored postings (term, doc_id, pos); of ``terms`` only, if given. Each file is a segment, sorted by term."""
    rows = _tokens(docs)
    if terms is not None:
        rows = spread_join(rows, terms, "term", ["doc_id", "pos"], "inner")
    return stored(rows.select("term", "doc_id", "pos").sortWithinPartitions("term"), "postings")


def rarest_terms(windows: DataFrame, counts: DataFrame, phrase: bool = True) -> DataFrame:
    """Windows with their rarest terms: (item, at, term1, off1, term2, off2); term2 is null for one word.

    For a ``phrase`` all terms must occur, so windows with one that never does are left out. Else such terms are passed
    over, and the two rarest of the others taken.
    """
    each = windows.select("item", "at", F.posexplode("terms").alias("off", "term"))
    each = each.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    each = each if phrase else each.where(F.col("n") > 0)
    ranked = each.groupBy("item", "at").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("t")).where(F.col("t")[0]["n"] > 0)
    second = F.get("t", F.lit(1))
    return ranked.select("item", "at", F.col("t")[0]["term"].alias("term1"), F.col("t")[0]["off"].alias("off1"), second["term"].alias("term2"), second["off"].alias("off2"))


def alignments(index: DataFrame, probes: DataFrame, slop: int = 0) -> DataFrame:
    """Intersect offset-adjusted posting lists: (doc_id, item, shift), ``shift`` the place of the item's word 0.

    With ``slop`` the second term may stand up to that many words off its place: proximity candidates.
    """
    first = spread_join(index.withColumnRenamed("term", "term1"), probes, "term1", ["doc_id", "pos"], "inner")
    first = first.select("doc_id", "item", (F.col("pos") - F.col("off1") - F.col("at")).alias("shift"), "term2", (F.col("pos") - F.col("off1") + F.col("off2")).alias("pos2"))
    single = first.where(F.col("term2").isNull()).select("doc_id", "item", "shift")
    if slop:
        first = first.withColumn("pos2", F.explode(F.sequence(F.col("pos2") - slop, F.col("pos2") + slop)))
    rest = first.where(F.col("term2").isNotNull()).alias("a").join(
        index.alias("b"),
        F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.term2") == F.col("b.term")) & (F.col("a.pos2") == F.col("b.pos")),
        "left_semi",
    )
    return single.unionByName(rest.select("doc_id", "item", "shift")).distinct()


def _probed(docs: DataFrame, benchmark: DataFrame, window: int, phrase: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    items, windows = benchmark_windows(benchmark, window)
    items = stored(items, "items")
    terms = stored(windows.select(F.explode("terms").alias("term")).distinct(), "terms")
    probes = stored(rarest_terms(windows, term_counts(docs, terms), phrase), "probes")
    wanted = stored(probes.select(F.explode(F.array_compact(F.array("term1", "term2"))).alias("term")).distinct(), "wanted")
    return items, probes, positional_index(docs, wanted)


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches of benchmark windows for every row of ``docs`` (doc_id, text): doc_id, n_words, hit_positions, item_ids.

    Null texts have no words; null or repeated doc_ids keep their rows, each judged by its own text. Items of no
    words match nothing; an item without id marks words but is not listed. Other columns are not read.
    """
    # Inside, a document is known by a hash of its id and text, so rows without id are apart. Should two hashes meet,
    # they share alignments, which step 5 tells apart.
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    items, probes, index = _probed(keyed.select(F.col("key").alias("doc_id"), "text"), benchmark, window)
    found = spread_join(alignments(index, probes), items, "item", ["doc_id"], "inner")
    found = found.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("item_id", "shift", "words")).alias("al"))
    rows = keyed.join(small(stored(found, "alignments")), "key", "left").select("doc_id", words(F.col("text")).alias("w"), "al")

    def equal(a):
        """'1' and '0' for each word of the item: whether the document has it there."""
        return F.array_join(F.transform(a["words"], lambda x, i: F.when(F.get("w", a["shift"] + i) == x, "1").otherwise("0")), "")

    def spans(b):
        """Places in the document where a window starts."""
        k = F.least(F.length(b["eq"]), F.lit(window))
        starts = F.filter(F.sequence(F.lit(0), F.length(b["eq"]) - k), lambda j: F.substring(b["eq"], j + 1, k) == F.substring(F.lit("1" * window), F.lit(1), k))
        return F.transform(starts, lambda j: F.struct((b["shift"] + j).alias("at"), k.alias("k")))

    rows = rows.select("doc_id", F.size("w").alias("n_words"), F.transform("al", lambda a: F.struct(a["item_id"].alias("item_id"), a["shift"].alias("shift"), equal(a).alias("eq"))).alias("al"))
    rows = rows.select("doc_id", "n_words", F.transform("al", lambda b: F.struct(b["item_id"].alias("item_id"), spans(b).alias("at"))).alias("al"))
    hits = F.filter("al", lambda b: F.size(b["at"]) > 0)
    rows = rows.select("doc_id", "n_words", F.coalesce(hits, F.expr("cast(array() as array<struct<item_id:string,at:array<struct<at:int,k:int>>>>)")).alias("al"))
    places = F.flatten(F.transform("al", lambda b: F.flatten(F.transform(b["at"], lambda s: F.sequence(s["at"], s["at"] + s["k"] - 1)))))
    ids = F.array_distinct(F.array_compact(F.transform("al", lambda b: b["item_id"])))
    return rows.select("doc_id", "n_words", F.array_distinct(places).alias("hit_positions"), F.array_sort(ids).alias("item_ids"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 3) -> DataFrame:
    """Distinct (doc_id, item_id) where the two rarest terms of a window stand within ``slop`` words of their distance."""
    items, probes, index = _probed(docs, benchmark, window, phrase=False)
    pairs = alignments(index, probes, slop).select("doc_id", "item").distinct()
    return spread_join(pairs, items.select("item", "item_id"), "item", ["doc_id"], "inner").select("doc_id", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of ``phrase_matches``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    m = phrase_matches(docs, benchmark, window)
    n_hit = F.size("hit_positions").cast("long")
    return m.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
