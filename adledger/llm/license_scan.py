"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along directories; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adledger.llm.common import once, stored
from adledger.llm.decontaminate import words_of
from adledger.operators.skew import lookup
from adledger.session import durable

# Short forms of well-known licence notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistributed under the BSD 3-Clause License."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "All rights reserved."),
]
HEADER_COSINE = 0.8
FILE_COSINE = 0.5
FILTER_SLOTS = 1 << 17
DOC = ["doc_id", "_h"]


def templates(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """Templates as a table; the short forms above unless ``rows`` are given."""
    known = [F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in (TEMPLATES if rows is None else rows)]
    held = F.array(*known) if known else F.array().cast("array<struct<license_id:string,text:string>>")
    return spark.range(1).select(F.inline(held))


def scan(files: DataFrame, known: DataFrame, header_cosine: float = HEADER_COSINE, file_cosine: float = FILE_COSINE) -> DataFrame:
    """doc_id, license_id, origin, similarity and ``_h`` per row of ``files`` (doc_id, path, text).

    Vectors are word counts times ln(1 + lines / (1 + uses)), with lines and uses counted
    over all texts; a word of no template weighs as one used once. A file's lines and the
    file as a whole are compared with every template, save those whose words bound the cosine
    under the limits: by Cauchy-Schwarz it is at most the norm of the unit template's weights
    on shared words, so the lightest words of a template that stay under the lower limit
    together lead to no match alone, however common or rare they are. origin is "file" if the whole text reaches ``file_cosine`` (it is a licence
    file and covers its directory and those below), else "header" if a line reaches
    ``header_cosine``, else "inherited" from the licence file in the nearest directory
    above, else "none" with null licence and similarity. Ties go to the smaller licence id;
    of several licence files in a directory the most similar counts.

    Null texts are empty; a null path is the root directory; rows that repeat id and text
    are one file for the statistics and all get its result; no templates or no files give
    no licence or no rows. Postings are stored once, without positions of other words;
    joins are by file and line, directories are resolved one row each, and files look
    theirs up by salted keys.
    """
    rows = files.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("path", F.lit("")).alias("path"),
                        F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    # a null id must join too: keep it apart as the smallest number
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    counts = known.select("license_id", F.explode(words_of(F.col("text"))).alias("word")).groupBy("license_id", "word").agg(F.count("*").alias("tf"))
    counts = stored(counts, "templates")
    sentinel = files.sparkSession.range(1).select(F.lit("").alias("word"))
    vocabulary = stored(counts.select("word").union(sentinel).distinct(), "terms")
    lines = once(rows, DOC).select(*DOC, F.posexplode(F.split("text", "\n")).alias("line", "body"))
    words = lines.select(*DOC, "line", F.posexplode(F.array_append(words_of(F.col("body")), F.lit(""))).alias("at", "word"))
    # the empty word's posting carries the number of words of its line
    postings = stored(words.join(vocabulary, "word").select(*DOC, "line", "word", F.when(F.col("word") == "", F.col("at")).alias("n_words")), "postings")
    uses = postings.groupBy("word").agg(F.count("*").alias("uses"))
    n_lines = F.lit(postings.where("word = ''").count())
    # one row per word of a template
    idf = stored(vocabulary.where("word != ''").join(uses, "word", "left").select(
        "word", F.log(1 + n_lines / (1 + F.coalesce("uses", F.lit(0)))).alias("idf"), F.log(1 + n_lines / 2).alias("idf_other")), "weights")
    weighted = counts.join(idf, "word").select("license_id", "word", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("license_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    target = stored(weighted.join(norms, "license_id").select("license_id", "word", F.try_divide("w", "norm").alias("w")), "target")
    # a match needs a word beyond those whose squares add up to less than the square of the lower limit, less what rounding adds
    lower = max(min(header_cosine, file_cosine) - 1e-6, 0.0) ** 2
    lightest = Window.partitionBy("license_id").orderBy("w", "word").rowsBetween(Window.unboundedPreceding, 0)
    needed = target.withColumn("light", F.sum(F.col("w") * F.col("w")).over(lightest)).where(F.col("light") >= lower).select("word").distinct()
    idf = stored(idf.join(needed.withColumn("needed", F.lit(True)), "word", "left").na.fill(False, ["needed"]), "idf")

    marked = durable(postings.join(idf.where("needed").select("word"), "word").select(*DOC).distinct())
    slot = F.pmod(F.xxhash64(*DOC), F.lit(FILTER_SLOTS))
    slots = marked.select(slot.alias("slot")).distinct()
    near = postings.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi")  # FILTER_SLOTS rows at most
    mine = near.join(marked, DOC, "left_semi").drop("slot")
    by_line = durable(mine.groupBy(*DOC, "line", "word").agg(F.count("*").alias("tf"), F.max("n_words").alias("n_words")))
    whole = by_line.groupBy(*DOC, "word").agg(F.sum("tf").alias("tf"), F.sum("n_words").alias("n_words")).withColumn("line", F.lit(-1))
    units = by_line.select(*DOC, "line", "word", "tf", "n_words").union(whole.select(*DOC, "line", "word", "tf", "n_words"))
    unit = [*DOC, "line"]
    tf = F.when(F.col("word") != "", F.col("tf"))
    valued = units.join(idf, "word", "left").withColumn("v", tf * F.col("idf"))
    size = valued.groupBy(*unit).agg(
        F.sum("n_words").alias("n"), F.coalesce(F.sum(tf), F.lit(0)).alias("inside"), F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("square"),
        F.max("idf_other").alias("idf_other"), F.coalesce(F.max("needed"), F.lit(False)).alias("needed"))
    size = size.where("needed").select(*unit, F.sqrt(F.col("square") + (F.col("n") - F.col("inside")) * F.col("idf_other") * F.col("idf_other")).alias("norm"))
    dots = valued.where("word != ''").join(target, "word").groupBy(*unit, "license_id").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    cosine = dots.join(size, unit).select(*unit, "license_id", F.round(F.try_divide("dot", "norm"), 6).alias("similarity"))
    order = F.struct((-F.col("similarity")).alias("least"), "license_id")
    best = cosine.withColumn("kind", F.when(F.col("line") < 0, "file").otherwise("header")).where(
        F.col("similarity") >= F.when(F.col("kind") == "file", file_cosine).otherwise(header_cosine))
    own = durable(best.groupBy(*DOC).agg(
        F.min(F.when(F.col("kind") == "file", order)).alias("file"), F.min(F.when(F.col("kind") == "header", order)).alias("header")))

    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    placed = rows.select(*DOC, folder.alias("dir")).join(own, DOC, "left")
    covers = durable(placed.where(F.col("file").isNotNull()).groupBy("dir").agg(F.min("file").alias("cover")))
    dirs = placed.select("dir").distinct()
    steps = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(steps)))).alias("depth"))
    up = up.select("dir", "depth", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/").alias("above"))
    nearest = durable(up.join(covers.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by("cover", "depth").alias("cover")))
    told = lookup(placed, nearest, "dir", "_h")
    chosen = F.coalesce("file", "header", "cover")
    origin = F.when(F.col("file").isNotNull(), "file").when(F.col("header").isNotNull(), "header").when(F.col("cover").isNotNull(), "inherited").otherwise("none")
    doc_id = F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id"))
    return told.select(doc_id.alias("doc_id"), chosen["license_id"].alias("license_id"), origin.alias("origin"), (-chosen["least"]).alias("similarity"), "_h")
