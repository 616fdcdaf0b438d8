"""Benchmark decontamination by a positional inverted index, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adledger.llm.common import fresh, join_on, stored
from adledger.session import durable

WINDOW_WORDS = 10
#: Slots of the filter that thins the postings before the last join; its broadcast has at most so many rows.
FILTER_SLOTS = 1 << 17
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LENGTH_TERM = ""
DOC = ["doc_id", "_h"]


def words_of(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, with A-Z lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() is the quick way where it cannot touch anything but A-Z
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


@dataclass
class Phrases:
    """Distinct word windows of the searched items.

    ``items`` (wid, item_id), ``terms`` (wid, offset, word, n_terms), ``vocabulary`` (word,
    term). All grow with the items only.
    """

    items: DataFrame
    terms: DataFrame
    vocabulary: DataFrame


def phrases(items: DataFrame, window_words: int = WINDOW_WORDS, id_col: str = "item_id") -> Phrases:
    """Windows of ``window_words`` consecutive words; an item of fewer is one window, of none has none."""
    worded = items.select(F.col(id_col).alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window_words + 1))
    windows = worded.select("item_id", "words", F.explode(starts).alias("s")).select(
        "item_id", F.expr(f"slice(words, s, {window_words})").alias("window"))
    windows = stored(windows.distinct(), "windows")
    named = stored(windows.select("window").distinct().orderBy("window").withColumn("wid", F.monotonically_increasing_id()), "named")
    terms = named.select("wid", F.size("window").alias("n_terms"), F.posexplode("window").alias("offset", "word"))
    words = terms.select("word").union(items.sparkSession.range(1).select(F.lit(LENGTH_TERM).alias("word"))).distinct()
    vocabulary = stored(words.orderBy("word").withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    return Phrases(stored(windows.join(named, "window").select("wid", "item_id"), "items"), terms, vocabulary)


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Stored postings (term, doc_id, _h, pos) of every vocabulary word in every text.

    Each map task writes one segment, clustered by term, without a shuffle. The empty
    word's posting carries the length of the document. The vocabulary is a stored table,
    so Spark broadcasts it when its size is under the session's threshold and joins by
    shuffle otherwise.
    """
    words = F.array_append(words_of(F.col("text")), F.lit(LENGTH_TERM))
    tokens = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), F.posexplode(words).alias("pos", "word"))
    postings = tokens.join(vocabulary, "word").select("term", *DOC, "pos")
    return stored(postings.sortWithinPartitions("term", *DOC), "postings")


def ranked_terms(index: DataFrame, searched: Phrases) -> DataFrame:
    """(wid, n_terms, offset, term, rank): the words of each window from the rarest in the index on."""
    counts = index.groupBy("term").agg(F.count("*").alias("uses"))
    told = searched.vocabulary.join(counts, "term", "left").select("word", "term", F.coalesce("uses", F.lit(0)).alias("uses"))
    order = W.partitionBy("wid").orderBy("uses", "offset")
    return stored(searched.terms.join(told, "word").select(
        "wid", "n_terms", "offset", "term", F.row_number().over(order).alias("rank")), "ranked")


def _slot() -> Column:
    return F.pmod(F.xxhash64(*DOC), F.lit(FILTER_SLOTS))


def exact_matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(wid, n_terms, doc_id, _h, start): every occurrence of every window.

    Starts from the lists of each window's rarest word, moved back by its offset;
    intersects them with the moved lists of the second rarest; then asks for all other
    words of what is left at once. Before that last join the postings of documents
    without a candidate are mostly dropped by a hash filter of fixed size. Joins are on
    document and position, so no frequent word gathers in one task.
    """
    place = [*DOC, "term", "pos"]
    rarest = terms.where("rank = 1").select("wid", "n_terms", "term", "offset")
    at = index.join(rarest, "term").select("wid", "n_terms", *DOC, (F.col("pos") - F.col("offset")).alias("start"))
    at = at.where("start >= 0").distinct()
    second = terms.where("rank = 2").select("wid", "term", "offset")
    lists = join_on(index, second.select("term").distinct(), ["term"], "left_semi")
    asked = at.join(second, "wid").select("wid", "n_terms", *DOC, "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
    both = join_on(asked, lists, place).select("wid", "n_terms", *DOC, "start").distinct()
    found = durable(both.union(at.where("n_terms = 1")))
    others = terms.where("rank > 2").select("wid", "term", "offset")
    asked = found.where("n_terms > 2").join(others, "wid").select(
        "wid", "n_terms", *DOC, "start", "offset", "term", (F.col("start") + F.col("offset")).alias("pos"))
    slots = found.where("n_terms > 2").select(_slot().alias("slot")).distinct()
    thinned = index.withColumn("slot", _slot()).join(F.broadcast(slots), "slot", "left_semi").select(*place)
    whole = (
        join_on(asked, thinned, place).groupBy("wid", "n_terms", *DOC, "start")
        .agg(F.size(F.collect_set("offset")).alias("n")).where("n = n_terms - 2").drop("n")
    )
    return whole.union(found.where("n_terms <= 2"))


def proximity_matches(index: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """(wid, n_terms, doc_id, _h, start, moved): windows whose words all stand within ``slop`` places
    of where the rarest one puts them; moved is the sum of the smallest shifts, 0 for an
    exact match."""
    rarest = terms.where("rank = 1").select("wid", "n_terms", "term", "offset")
    at = index.join(rarest, "term").select("wid", "n_terms", *DOC, (F.col("pos") - F.col("offset")).alias("start")).distinct()
    others = terms.where("rank > 1").select("wid", "term", "offset")
    asked = at.join(others, "wid").select("wid", "n_terms", *DOC, "start", "offset", "term", (F.col("start") + F.col("offset")).alias("due"))
    shift = F.abs(F.col("pos") - F.col("due"))
    near = join_on(asked, index, [*DOC, "term"]).where(shift <= slop)
    one = near.groupBy("wid", "n_terms", *DOC, "start", "offset").agg(F.min(shift).alias("shift"))
    many = one.groupBy("wid", "n_terms", *DOC, "start").agg(F.count("*").alias("n"), F.sum("shift").alias("moved"))
    alone = at.where("n_terms = 1").withColumn("moved", F.lit(0).cast("bigint"))
    return many.where("n = n_terms - 1").drop("n").union(alone)


def contamination(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and ``_h`` per row of ``docs``.

    n_hit counts the words inside any occurrence of a window; items_sha256 is over the ids,
    sorted as strings, of the items that have one. Null or empty texts have no words;
    items that repeat a text all count; item rows that repeat an id are one item; a null
    item_id marks hits but is not listed. Empty tables give no rows or no hits.
    """
    searched = phrases(items, window_words)
    index = build_index(docs, searched.vocabulary)
    matches = durable(exact_matches(index, ranked_terms(index, searched)))
    spots = matches.select(*DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_terms") - 1)).alias("pos")).distinct()
    hits = spots.groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    named = matches.select(*DOC, "wid").distinct().join(searched.items, "wid")
    listed = named.groupBy(*DOC).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    lengths = index.join(searched.vocabulary.where(F.col("word") == LENGTH_TERM).select("term"), "term").select(
        *DOC, F.col("pos").cast("bigint").alias("n_words"))
    out = join_on(lengths, durable(join_on(hits, listed, DOC, "left")), DOC, "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
                      F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "_h")


def drop_contaminated(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, columns unchanged."""
    mark = fresh(docs, "_h")
    bad = contamination(docs, items, window_words).where("contaminated").select("doc_id", F.col("_h").alias(mark)).distinct()
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    return join_on(marked, durable(bad), ["doc_id", mark], "left_anti").select(*docs.columns)
