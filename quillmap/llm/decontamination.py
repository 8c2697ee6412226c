"""Benchmark decontamination with a positional inverted index of the training texts.

``build_index`` reads the texts once and writes one posting (document, term, position) per
word that the test items contain, plus one end posting per document, whose
position is the number of words. Words that no test item has cannot take part in a
match and get no posting.

``matches`` looks a window of test words up from its rarest term: each posting of that term
gives one possible start, and the lists of the other terms, moved by their offsets, are
intersected with these starts, the second rarest first. With a slop of 0 this gives
exact phrases; with more, windows whose words all lie at most that far from their
places (proximity matches).

Only DataFrame operations are used; the text itself is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.llm.common import ascii_lower, fresh, hex_sha256, query, small_side, table, written

#: Words of a window.
WINDOW = 10

#: Between words: every ASCII character but digits and lower-case letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Stands for the end of a document; no word has a blank.
_END = " "


def words(text: Column) -> Column:
    """The words of a text in order, A-Z in lower case; none of a null text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def document_key(doc_id: Column, text: Column) -> Column:
    """Tells documents apart also where identifiers are null or repeated; rows that
    share both identifier and text have one result."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("hash"))


def test_windows(items: DataFrame, text: str, item_id: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: ``wid, terms`` of the distinct windows and ``wid, item`` of their items."""
    listed = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    slices = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, F.lit(size)))
    placed = written(listed.select("item", F.explode(slices).alias("terms")).distinct(), "windows-placed")
    distinct = placed.select("terms").distinct().withColumn("wid", F.monotonically_increasing_id())
    windows = written(distinct, "windows")
    return windows, written(placed.join(windows, "terms").select("wid", "item"), "window-items")


def build_index(docs: DataFrame, text: str, doc_id: str, terms: DataFrame) -> DataFrame:
    """Postings ``doc, term, pos`` (a written table) of the words that are in ``terms`` (``term``)."""
    ends = terms.sparkSession.createDataFrame([(_END,)], "term string")
    wanted = written(terms.union(ends).distinct(), "index-terms")
    listed = docs.select(
        document_key(F.col(doc_id), F.col(text)).alias("doc"),
        F.posexplode(F.concat(words(F.col(text)), F.array(F.lit(_END)))).alias("pos", "term"),
    )
    return written(listed.join(small_side(wanted), "term").select("doc", "term", "pos"), "postings")


def matches(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """``doc, wid, start, size`` of each place where a window occurs.

    ``start`` is the position that the place of the window's rarest term implies. Each
    other term must lie within ``slop`` positions of its own place.
    """
    terms = windows.select("wid", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term"))
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
    known = terms.join(counts, "term")
    by_rarity = Window.partitionBy("wid").orderBy("postings", "off")
    everything = Window.partitionBy("wid")
    ranked = known.withColumn("rank", F.row_number().over(by_rarity)).withColumn("found", F.count(F.lit(1)).over(everything))
    # A window with a term that no document has cannot occur.
    ranked = written(ranked.where("found = size").select("wid", "size", "off", "term", "rank"), "window-terms")

    anchors = ranked.where("rank = 1").select("wid", "size", "term", F.col("off").alias("anchor"))
    starts = index.join(small_side(anchors), "term").withColumn("start", F.col("pos") - F.col("anchor"))
    starts = written(starts.where("start >= 0").select("doc", "wid", "start", "size").distinct(), "starts")
    for ranks in ("rank = 2", "rank > 2"):
        offsets = ranked.where(ranks).select("wid", "off", "term")
        near = index.join(small_side(written(offsets.select("term").distinct(), "asked-terms")), "term", "left_semi")
        if ranks == "rank > 2":
            # Few starts are left once two terms have met: only their documents' lists are read on.
            left = written(starts.select("doc").distinct(), "asked-documents")
            near = near.join(small_side(left), "doc", "left_semi")
        needed = offsets.groupBy("wid").agg(F.count(F.lit(1)).alias("needed"))
        # Windows too short to have such a term stay as they are.
        done = starts.join(small_side(needed.select("wid")), "wid", "left_anti")
        places = F.col("start") + F.col("off")
        asked = starts.join(small_side(offsets), "wid").withColumn(
            "pos", F.explode(F.sequence(places - slop, places + slop)) if slop else places
        )
        met = asked.join(near, ["doc", "term", "pos"]).select("doc", "wid", "start", "size", "off").distinct()
        counted = met.groupBy("doc", "wid", "start", "size").agg(F.count(F.lit(1)).alias("met"))
        agreed = counted.join(small_side(needed), "wid").where("met = needed").select("doc", "wid", "start", "size")
        starts = written(done.select("doc", "wid", "start", "size").union(agreed), "starts")
    return starts


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id", size: int = WINDOW, slop: int = 0,
) -> DataFrame:
    """One row per row of ``docs``: ``doc`` (id and hash), ``n_words``, ``n_hit``, ``items`` (sorted strings).

    A word is hit if it lies inside any occurrence of ``size`` consecutive words of a
    test item (all words of a shorter item). Null and wordless texts have no words and
    no hits; items without words match nothing; equal windows of several items
    count for each of them. Empty tables give no rows or no hits. Other columns are not read.
    """
    windows, window_items = test_windows(items, item_text, item_id, size)
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    index = build_index(docs, text, doc_id, vocabulary)
    found = matches(index, windows, slop)
    places = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))
    hit = found.select("doc", "start", "size").distinct().select("doc", places.alias("pos")).distinct()
    hits = hit.groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("doc", "wid").distinct().join(small_side(window_items), "wid")
    named = named.select("doc", F.col("item").cast("string").alias("item")).distinct()
    # The list is no longer than the document's own windows.
    listed = named.groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    met = written(hits.join(listed, "doc"), "hits")
    ends = index.where(F.col("term") == _END).select("doc", F.col("pos").cast("bigint").alias("n_words"))
    return ends.join(small_side(met), "doc", "left").select(
        "doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no occurrence of any window, with all their columns."""
    (key,) = fresh(docs.columns, "doc")
    hit = contamination(docs, items, text, doc_id).where("n_hit > 0").select(F.col("doc").alias(key)).distinct()
    hit = written(hit, "contaminated")
    keyed = docs.withColumn(key, document_key(F.col(doc_id), F.col(text)))
    return keyed.join(small_side(hit), key, "left_anti").drop(key)


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
    WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
    b AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k
          FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    wins AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win
             FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM b)),
    sizes AS (SELECT DISTINCT k FROM wins),
    placed AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
               FROM (SELECT d.*, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
    met AS (SELECT doc_id, k, s, item_id FROM placed JOIN wins USING (k, win)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM met) GROUP BY doc_id),
    named AS (SELECT doc_id, count(DISTINCT item_id) AS n,
              string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
              FROM met GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(hit.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op8_decontamination", ORACLE)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc.id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        hex_sha256(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
