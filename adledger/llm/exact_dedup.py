"""Exact dedup by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adledger.llm.common import cut, fresh, join_on, stored
from adledger.operators.skew import lookup
from adledger.session import durable

BLOCK_BYTES = 4096
NAME_PARTS = 1024


def _numbered(keys: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows of ``keys`` with a dense integer ``name`` from 1 in sorted order.

    The order is cut in ``NAME_PARTS`` fixed ranges of a hash, so each window sorts an
    even share; a range's first number is the count of the ranges before it.
    """
    part = F.pmod(F.col(order[0]) if len(order) == 1 else F.xxhash64(*order), F.lit(NAME_PARTS)).cast("int")
    split = keys.withColumn("_part", part)
    sizes = split.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_part").orderBy(*order)
    return (
        split.join(F.broadcast(starts), "_part")  # at most NAME_PARTS rows
        .withColumn("name", F.row_number().over(inside) + F.col("_start")).drop("_part", "_start")
    )


def block_rows(docs: DataFrame, carried: list[str], block_bytes: int) -> DataFrame:
    """One row per fixed-size block of the UTF-8 bytes of ``text``: carried columns,
    n_blocks, pos, block. An empty text has one empty block."""
    body = F.col("text").cast("binary")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(block_bytes))).cast("int")
    cut = docs.select(*carried, "text", count.alias("n_blocks"))
    at = cut.select(*carried, "text", "n_blocks", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("pos"))
    return at.select(*carried, "n_blocks", "pos",
                     F.substring(body, F.col("pos") * block_bytes + 1, F.lit(block_bytes)).alias("block"))


def identities(docs: DataFrame, normalize: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, _h, text_sha256, n_blocks, identity): equal (n_blocks, identity) exactly for
    equal normalised texts.

    Blocks are put in order by (XXH64, content) and numbered; pairs of neighbouring names
    are then numbered the same way, halving the sequence until one name is left. Contents
    are compared only in the first round, after map-side combining, so a block that a
    third of all documents share travels once per map task. Rows find their block's name
    by its hash; if different blocks share a hash, those rows alone also compare content.
    Later rounds move integers. Rounds: log2 of the most blocks in a text.
    """
    text = F.coalesce(F.col("text"), F.lit("")) if normalize is None else F.coalesce(normalize, F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("_h"), F.sha2("text", 256).alias("text_sha256"), "text")
    carried = ["doc_id", "_h", "text_sha256"]
    # repeated rows are counted, not expanded, until the end
    blocks = block_rows(rows, carried, block_bytes).withColumn("_b", F.xxhash64("block"))
    # a set per hash: one exchange of contents, combined in the map tasks, sorted inside the hash
    sets = blocks.groupBy("_b").agg(F.sort_array(F.collect_set("block")).alias("set"))
    contents = stored(sets.select("_b", F.posexplode("set").alias("_o", "block"), (F.size("set") > 1).alias("_clash"))
                      .select("_b", "_o", F.when(F.col("_clash"), F.col("block")).alias("block")), "blocks")
    names = durable(_numbered(contents.select("_b", "_o"), ["_b", "_o"]))
    clashing = contents.where(F.col("block").isNotNull())
    keyed = blocks.groupBy(*carried, "n_blocks", "pos", "_b").agg(F.count("*").alias("copies"))
    if clashing.limit(1).count():
        told = blocks.join(clashing.select("_b").distinct(), "_b", "left_semi").join(clashing, ["_b", "block"])
        told = told.select(*carried, "pos", "_o").distinct()
        keyed = join_on(keyed, told, [*carried, "pos"], "left")
    else:
        keyed = keyed.withColumn("_o", F.lit(0))
    level = cut(keyed.withColumn("_o", F.coalesce("_o", F.lit(0))).join(names, ["_b", "_o"])
                    .select(*carried, "n_blocks", "copies", "pos", "name"))
    done = level.where(F.col("n_blocks") == 1)
    span = 1
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    level = level.where(F.col("n_blocks") > 1)
    while span < most:
        side = F.col("pos") % 2 == 0
        pairs = level.groupBy(*carried, "n_blocks", "copies", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(side, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~side, F.col("name"))), F.lit(0)).alias("b"))
        pairs = cut(pairs)
        named = _numbered(pairs.select("a", "b").distinct(), ["a", "b"])
        level = cut(pairs.join(named, ["a", "b"]).select(*carried, "n_blocks", "copies", "pos", "name"))
        span *= 2
        done = done.union(level.where(F.col("n_blocks") <= span))
        level = level.where(F.col("n_blocks") > span)
    return done.select(*carried, "n_blocks", "copies", F.col("name").alias("identity"))


def exact_groups(docs: DataFrame, normalize: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents with the group of equal texts they belong to.

    doc_id, keep_id (largest doc_id of the group), group_size (rows), kept, text_sha256.
    One output row per input row. A null text equals an empty one; a null doc_id is
    smaller than any; of rows that repeat id and text one is kept. An empty table gives
    an empty result.
    """
    ids = durable(identities(docs, normalize, block_bytes))
    groups = ids.groupBy("n_blocks", "identity").agg(
        F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    out = lookup(ids, groups, ["n_blocks", "identity"], "doc_id")
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), kept.alias("kept"), "text_sha256", "_h")


def drop_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The input's columns, with one row (largest doc_id) of each group of equal texts."""
    groups = exact_groups(docs, block_bytes=block_bytes)
    mark = fresh(docs, "_h")
    rows = durable(groups.groupBy("doc_id", F.col("_h").alias(mark)).agg(
        F.max("kept").alias("_kept"), F.count("*").alias("_rows")).where("_kept"))
    keyed = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    out = join_on(keyed, rows, ["doc_id", mark], "left_semi")
    repeated = rows.where("_rows > 1")
    if repeated.limit(1).count():
        once = join_on(keyed, repeated, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
        out = join_on(out, repeated, ["doc_id", mark], "left_anti").union(once)
    return out.select(*docs.columns)
