"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Benchmark items give windows of words. Each window is looked up from its
rarest terms in the corpus on: the index keeps, for those terms, every
document and position (postings); the lists of a window's rarest terms are
shifted by the terms' places in the window and intersected; what is left names
a document and a start, and the words there are compared with the whole window.
So a phrase match is exact. :func:`near` returns proximity matches from the
same lists.

The corpus is dealt by document and never grouped by term, so a term that is
in every document is no hot key; terms, windows and candidates are broadcast
only if counted below a bound, else Spark shuffles them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import ascii_lower, let, small, store

WINDOW = 13
#: How many of a window's rarest terms have lists that are intersected.
RAREST = 2


def words(text: Column) -> Column:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing A-Z; null and empty have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, terms) and which items have them (window_id, item_id).

    An item of fewer words than ``width``, but not none, is one window.
    """
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col).cast("string")).alias("w")).where("size(w) > 0 and item_id is not null")
    cut = let(F.col("w"), lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - width, F.lit(0))), lambda i: F.slice(x, i + 1, width)))
    each = w.select("item_id", F.explode(cut).alias("terms"))
    each = store(each.select(F.md5(F.concat_ws(" ", "terms")).alias("window_id"), "terms", "item_id").distinct(), "windows")
    return each.select("window_id", "terms").distinct(), each.select("window_id", "item_id")


def tokens(docs: DataFrame) -> DataFrame:
    return docs.select("key", F.posexplode(words(F.col("text"))).alias("pos", "term"))


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, start, n, window_id): every place where a document (key, text) has a window's words, from 0."""
    places = windows.select("window_id", F.size("terms").alias("n"), F.posexplode("terms").alias("at", "term"))
    places = store(places, "places")
    wanted = store(places.select("term").distinct(), "terms")
    often = tokens(docs).join(small(wanted), "term").groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    often = store(often, "uses")
    # windows with a term that no document has can't occur; the others' rarest terms, each place of a window once
    rare = places.join(small(often), "term", "left").withColumn("least", F.min(F.coalesce("uses", F.lit(0))).over(W.partitionBy("window_id"))).where("least > 0")
    rare = rare.withColumn("rank", F.row_number().over(W.partitionBy("window_id").orderBy("uses", "term", "at"))).where(F.col("rank") <= RAREST)
    rare = store(rare.select("window_id", "n", "at", "term", "rank"), "rare")
    listed = store(rare.select("term").distinct(), "listed")
    index = store(tokens(docs).join(small(listed), "term").select("term", "key", "pos"), "index")

    starts = index.join(small(rare.where("rank = 1")), "term").select("window_id", "n", "key", (F.col("pos") - F.col("at")).alias("start")).where("start >= 0")
    for rank in range(2, RAREST + 1):
        other = rare.where(F.col("rank") == rank).select("window_id", F.col("term"), "at")
        expected = starts.join(small(other), "window_id", "left").withColumn("pos", F.col("start") + F.col("at"))
        starts = expected.where("term is null").select("window_id", "n", "key", "start").unionByName(expected.where("term is not null").join(index, ["term", "key", "pos"], "left_semi").select("window_id", "n", "key", "start"))
    return store(starts.distinct(), "starts")


def exact(docs: DataFrame, starts: DataFrame, windows: DataFrame) -> DataFrame:
    """Those of ``starts`` where all words of the window stand."""
    candidates = starts.join(small(windows), "window_id")
    per_doc = candidates.groupBy("key").agg(F.collect_list(F.struct("window_id", "start", "n", "terms")).alias("c"))
    held = docs.join(small(store(starts.select("key").distinct(), "keys")), "key", "left_semi").join(per_doc, "key").select("key", "c", words(F.col("text")).alias("w"))
    return held.select("key", F.explode(let(F.col("w"), lambda w: F.filter("c", lambda c: F.slice(w, c["start"] + 1, c["n"]) == c["terms"]))).alias("c")).select("key", "c.window_id", "c.start", "c.n")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WINDOW, share: int = 20, keyed: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit; ``contaminated`` is
    ``n_hit > 0`` and ``share * n_hit >= n_words``. Null and empty texts have no
    words; what is found in a text holds for all rows that have it, whatever
    their ids; items without words or id have no windows. Other columns are
    ignored, on both sides. With ``keyed``, ``key`` is the text's (SHA-256).
    """
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("key"))
    rows = store(docs.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words")), "rows")
    texts = docs.select("key", "text")
    distinct, owners = windows(items, item_col, width=width)
    distinct = store(distinct, "distinct")
    starts = occurrences(texts, distinct)
    found = store(exact(texts, starts, distinct).distinct(), "found")

    before = W.partitionBy("key").orderBy("start", "n").rowsBetween(W.unboundedPreceding, -1)
    spans = found.select("key", "start", "n").distinct().withColumn("done", F.coalesce(F.max(F.col("start") + F.col("n")).over(before), F.lit(0)))
    hit = spans.groupBy("key").agg(F.sum(F.greatest(F.col("start") + F.col("n") - F.greatest("start", "done"), F.lit(0))).alias("n_hit"))
    of = found.select("key", "window_id").distinct().join(small(owners), "window_id").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = store(hit.join(of, "key"), "hit")
    out = rows.join(small(hit), "key", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *(["key"] if keyed else []))


def near(docs: DataFrame, phrases: DataFrame, within: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Proximity matches: (doc_id, phrase_id, start, end) of the least spans of at most ``within`` words with all terms of a phrase.

    ``phrases``: (phrase_id, terms). Spans are found per document from the
    phrase's postings alone: for each position of its rarest term, the least
    span around it (of equals the first), from every start in reach to the next
    place of each term. Null texts and phrases without terms have none; rows
    that share an id but not a text are searched apart; null ids are kept.
    """
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("key"))
    keyed = docs.where(text.isNotNull()).select(F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))
    terms = store(phrases.select("phrase_id", F.size(F.array_distinct("terms")).alias("n"), F.explode(F.array_distinct("terms")).alias("term")), "near")
    post = store(tokens(keyed).join(small(terms.select("term").distinct()), "term").distinct(), "index")  # equal texts once
    uses = post.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    first = terms.join(uses, "term", "left").withColumn("rank", F.row_number().over(W.partitionBy("phrase_id").orderBy("uses", "term"))).where("rank = 1")
    anchor = post.join(small(first.select("phrase_id", "n", "term")), "term").select("key", "phrase_id", "n", F.col("pos").alias("anchor"))
    block = F.floor(F.col("pos") / within)
    others = post.join(small(terms.select("phrase_id", "term")), "term").select("key", "phrase_id", "term", "pos", block.alias("block"))
    around = anchor.withColumn("block", F.explode(F.array(*[F.floor(F.col("anchor") / within) + k for k in (-1, 0, 1)])))
    pairs = around.join(others, ["key", "phrase_id", "block"]).where(F.abs(F.col("pos") - F.col("anchor")) < within)
    at = pairs.groupBy("key", "phrase_id", "n", "anchor").agg(F.collect_set(F.struct("term", "pos")).alias("at")).where(F.size(F.array_distinct(F.col("at.term"))) == F.col("n"))
    begun = at.withColumn("start", F.explode(F.array_distinct(F.filter(F.col("at.pos"), lambda p: p <= F.col("anchor")))))
    after = begun.select("key", "phrase_id", "n", "anchor", "start", F.explode(F.filter("at", lambda x: x["pos"] >= F.col("start"))).alias("x"))
    nearest = after.groupBy("key", "phrase_id", "n", "anchor", "start", "x.term").agg(F.min("x.pos").alias("pos"))
    spans = nearest.groupBy("key", "phrase_id", "n", "anchor", "start").agg(F.count(F.lit(1)).alias("c"), (F.greatest("anchor", F.max("pos")) + 1).alias("end"))
    spans = spans.where((F.col("c") == F.col("n")) & (F.col("end") - F.col("start") <= within))
    least = spans.groupBy("key", "phrase_id", "anchor").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("size"), "start", "end")).alias("s"))
    return rows.join(least.select("key", "phrase_id", "s.start", "s.end").distinct(), "key").select("doc_id", "phrase_id", "start", "end").distinct()


SQL = r"""
WITH lower_docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lower_items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
item_windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS win FROM lower_items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM lower_docs, lengths, unnest(range(1, len(w) - n + 2)) t(i)),
found AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found), unnest(range(i, i + n)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lower_docs LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
