"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings (document, position, term) in the shared folder: those of every benchmark term in
every document, since no other term is ever asked for; another benchmark needs its own. A test phrase is found by taking its terms from the rarest on: the postings of the rarest term, moved back by
the term's offset, are the first candidates; the list of the next rarest is intersected with them, then the third; what
is left is confirmed against the postings of all terms. ``phrases`` returns exact matches, ``proximity`` stretches of the
documents that hold all terms of a phrase in any order.

Everything runs in DataFrame operations. Benchmark-sized tables are broadcast only under ``BROADCAST_ROWS`` counted
rows, as is the set of candidate documents; beyond that the same joins shuffle.

Defined results: null and empty texts have no words (0 hits, no items, the hash of the empty string); an item of fewer
than ten words is one window; repeated document rows keep their number and all get the result; repeated benchmark rows
count once; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import common

WINDOW = 10
#: Counted rows up to which a table is broadcast.
BROADCAST_ROWS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands after the last word of a document; no word can equal it.
END = "\x00"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def test_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each word of each window: item_id, item, s (start), size, i (position in the item), word, term."""
    held = items.select(F.col(f"`{id_col}`").alias("item_id"), words(common.text_of(text_col)).alias("w")).distinct()
    held = held.withColumn("item", F.xxhash64("item_id", "w")).filter(F.size("w") > 0)
    held = held.withColumn("size", F.least(F.lit(window), F.size("w")))
    starts = held.withColumn("s", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))))
    placed = starts.select("item_id", "item", "s", "size", "w", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("size") - 1)).alias("i"))
    return placed.select("item_id", "item", "s", "size", "i", F.element_at("w", F.col("i") + 1).alias("word")).withColumn("term", F.xxhash64("word"))


def build_index(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings: doc_id, text_hash, pos, term. A null term closes each document at its number of words."""
    spark = docs.sparkSession
    terms = windows.select("word", "term").distinct()
    n, kinds = terms.agg(F.count("*"), F.countDistinct("term")).first()
    if n != kinds:
        raise ValueError("two benchmark terms share a 64-bit hash")
    terms = terms.unionByName(spark.createDataFrame([(END,)], "word string").withColumn("term", F.lit(None).cast("long")))
    held = common.keyed(docs, id_col, text_col)
    tokens = held.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "word"))
    return common.cut(tokens.join(_small(terms, n), "word").select("doc_id", "text_hash", "pos", "term"), "postings")


def _same(left: DataFrame, right: DataFrame, *more: Column, how: str = "inner") -> DataFrame:
    """Join on the document (null ids match), and on ``more``; the right side's document columns go."""
    r = right.withColumnRenamed("doc_id", "r_doc_id").withColumnRenamed("text_hash", "r_text_hash")
    on = F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("text_hash") == F.col("r_text_hash"))
    for condition in more:
        on = on & condition
    out = left.join(r, on, how)
    return out.drop("r_doc_id", "r_text_hash")


def _rarest(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window that can occur with its three rarest places ``a`` (fewer in shorter ones): struct(n, i, term)."""
    counts = common.cut(index.filter("term is not null").groupBy("term").agg(F.count("*").alias("n")), "counts")
    ranked = windows.join(_small(counts), "term").groupBy("item_id", "item", "s", "size").agg(F.array_sort(F.collect_list(F.struct("n", "i", "term"))).alias("a"))
    return ranked.filter(F.size("a") == F.col("size")).withColumn("a", F.slice("a", 1, 3))


def phrases(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact occurrences: doc_id, text_hash, item_id, at (position in the document), size."""
    tests = common.cut(_rarest(index, windows), "tests")
    n_tests = tests.count()
    postings = index.filter("term is not null").select("doc_id", "text_hash", "pos", "term")
    first = _small(tests.select("*", F.col("a")[0]["term"].alias("term"), F.col("a")[0]["i"].alias("i")), n_tests)
    found = postings.join(first, "term").withColumn("shift", F.col("pos") - F.col("i")).filter(F.col("shift") + F.col("s") >= 0).drop("pos", "term", "i").distinct()
    for k in (1, 2):
        terms = tests.filter(F.size("a") > k).select(F.col("a")[k]["term"].alias("term")).distinct()
        own = postings.join(_small(terms, n_tests), "term", "left_semi").withColumnRenamed("pos", "r_pos").withColumnRenamed("term", "r_term").distinct()
        more, done = found.filter(F.size("a") > k), found.filter(F.size("a") <= k)
        found = _same(more, own, F.col("r_pos") == F.col("a")[k]["i"] + F.col("shift"), F.col("r_term") == F.col("a")[k]["term"]).drop("r_pos", "r_term").unionByName(done)
    found = common.cut(found.drop("a"), "aligned")
    near = found.select("doc_id", "text_hash").distinct()
    listed = _same(postings, _small(near), how="left_semi").withColumnRenamed("pos", "r_pos").withColumnRenamed("term", "r_term").distinct()
    places = _small(windows.select("item", "s", "i", "term").distinct(), n_tests * WINDOW)
    expected = found.join(places, ["item", "s"])
    hits = _same(expected, listed, F.col("r_pos") == F.col("i") + F.col("shift"), F.col("r_term") == F.col("term"))
    return (
        hits.groupBy("doc_id", "text_hash", "item_id", "item", "s", "shift", "size").agg(F.count("*").alias("n")).filter(F.col("n") == F.col("size"))
        .select("doc_id", "text_hash", "item_id", (F.col("shift") + F.col("s")).alias("at"), "size")
    )


def proximity(index: DataFrame, windows: DataFrame, slack: int = 5) -> DataFrame:
    """Documents' stretches of at most size + ``slack`` words that hold every term of a test window as often as the window
    does, in any order.

    The rarest term's postings anchor the search. Around an anchor a stretch has at most 2 (size + slack) - 1 places, so
    that the postings there fit a short array, over which the stretch slides: from each posting on, the last term that is
    still wanted ends it. Returns doc_id, text_hash, item_id, s, at (where the stretch starts), span: the shortest
    stretch near each anchor, the first of equals, each once.
    """
    tests = _rarest(index, windows)
    postings = index.filter("term is not null").select("doc_id", "text_hash", "pos", "term")
    window = ["item_id", "item", "s", "size"]
    first = tests.select(*window, F.col("a")[0]["term"].alias("term"))
    anchors = postings.join(first, "term").select("doc_id", "text_hash", *window, F.col("pos").alias("anchor")).distinct()
    counted = windows.select("item", "s", "i", "term").distinct().groupBy("item", "s", "term").agg(F.count("*").cast("int").alias("times"))
    needed = counted.groupBy("item", "s").agg(F.collect_list(F.struct("term", "times")).alias("needed"))
    listed = postings.withColumnRenamed("pos", "r_pos").withColumnRenamed("term", "r_term").distinct()
    wide = F.col("size") + slack
    near = _same(anchors.join(counted, ["item", "s"]), listed, F.col("r_term") == F.col("term"), F.abs(F.col("r_pos") - F.col("anchor")) < wide)
    place = F.array_sort(F.collect_list(F.struct(F.col("r_pos").alias("p"), F.col("r_term").alias("t"))))
    held = near.groupBy("doc_id", "text_hash", *window, "anchor").agg(place.alias("near")).join(needed, ["item", "s"])

    def ending(start: Column) -> Column:
        """Where the stretch from ``start`` on has every term; null if it never does."""
        at = lambda want: F.get(F.filter("near", lambda x: (x["t"] == want["term"]) & (x["p"] >= start)), want["times"] - 1)["p"]
        ends = F.transform("needed", at)
        return F.when(~F.exists(ends, lambda e: e.isNull()), F.array_max(ends))

    spans = F.transform("near", lambda x: F.struct((ending(x["p"]) - x["p"] + 1).alias("span"), x["p"].alias("at")))
    best = F.array_min(F.filter(spans, lambda x: x["span"].isNotNull() & (x["span"] <= wide)))
    return held.select("doc_id", "text_hash", "item_id", "s", best.alias("b")).filter("b is not null").select("doc_id", "text_hash", "item_id", "s", "b.at", "b.span").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document row: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = common.cut(test_windows(items), "windows")
    index = build_index(docs, windows, id_col, text_col)
    found = phrases(index, windows)
    covered = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1))))
    by_doc = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "size")).alias("at"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    by_doc = by_doc.select("doc_id", "text_hash", F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("items"))
    ends = index.filter("term is null").select("doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    out = _same(ends, by_doc, how="left")
    return out.select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), tests AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM tests),
grams AS (
  SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)
), found AS (SELECT doc_id, p, grams.size AS size, item_id FROM grams JOIN tests ON grams.size = tests.size AND grams.g = tests.g),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that hold a benchmark window."""
    found = contamination(docs, common.read(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id", "text_hash").distinct()
    found = common.cut(found, "found")  # so that the postings can go
    kept = _same(docs.withColumn("text_hash", F.xxhash64(common.text_of("text"))), found, how="left_anti")
    return kept.select("doc_id", "text", "lang", "source", "n_chars")
