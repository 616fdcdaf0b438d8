"""Sinks: feed payload as JSON, CSV and text feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adledger import lexicon as lx
from adledger import schema
from adledger.functions.display import markdown_block
from adledger.operators.report import distribution, feed_order, feed_summary, median_price, ranked


def payload_rows(listings: DataFrame) -> DataFrame:
    """One JSON record per listing with sorted keys, in feed order."""
    columns = [f.name for f in schema.LISTING if f.name in listings.columns]
    return listings.orderBy(*feed_order()).select(schema.to_payload(columns).alias("value"))


def summary_payload(listings: DataFrame, generated_at: Column) -> DataFrame:
    """The feed's head as one row: time, statistics, source and trim distributions."""
    def counts(key: str) -> DataFrame:
        rows = distribution(listings, key)
        entry = F.struct((-F.col("count")).alias("o"), "label", "count")
        return rows.agg(F.transform(
            F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["label"], e["count"])
        ).alias("d"))

    return feed_summary(listings).withColumns({
        "median_price_eur": median_price(listings).scalar(),
        "sources": counts("source").scalar(), "trims": counts("trim").scalar(),
        "generated_at": generated_at.cast("string"),
    })


def write_json(listings: DataFrame, path: str, generated_at: Column) -> None:
    """The feed as JSON lines, compressed: most of a record is the names of its keys."""
    payload_rows(listings).write.mode("overwrite").option("compression", "gzip").text(f"{path}/listings")
    summary_payload(listings, generated_at).write.mode("overwrite").json(f"{path}/summary")


def csv_rows(listings: DataFrame) -> DataFrame:
    """The fixed export columns; lists in bracketed, quoted form."""
    def flat(name: str) -> Column:
        column = F.col(name)
        if isinstance(listings.schema[name].dataType, T.ArrayType):
            quoted = F.transform(column, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
            return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias(name)
        return column

    return listings.select(*[flat(c) for c in lx.CSV_COLUMNS])


#: Quotes inside a value are doubled.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}


def write_csv(listings: DataFrame, path: str) -> None:
    """The export columns in feed order; files of the folder follow each other by name."""
    csv_rows(listings.orderBy(*feed_order())).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def markdown_blocks(listings: DataFrame) -> DataFrame:
    """One text block per listing with its rank."""
    return ranked(listings, feed_order()).select("rank", markdown_block().alias("value"))


def feed_lines(listings: DataFrame, generated_at: Column) -> DataFrame:
    """The whole text feed as (place, value): head at 0, a block per listing, or one line if there is none."""
    head = F.concat_ws("\n", F.format_string(lx.FEED_TITLE, generated_at.cast("string")), F.lit(""), F.format_string(
        lx.FEED_COUNTS, "total_active", "new_listings", "price_changes"), F.lit(""))

    def line(place: int, value: Column) -> Column:
        return F.struct(F.lit(place).cast("bigint").alias("place"), value.alias("value"))

    lines = F.when(F.col("total_active") == 0, F.array(line(0, head), line(1, F.lit(lx.FEED_EMPTY)))).otherwise(F.array(line(0, head)))
    blocks = markdown_blocks(listings).select(F.col("rank").cast("bigint").alias("place"), "value")
    return feed_summary(listings).select(F.inline(lines)).unionByName(blocks)


def write_markdown(listings: DataFrame, path: str, generated_at: Column) -> None:
    """The text feed, sorted in range partitions; files of the folder follow each other by name."""
    feed_lines(listings, generated_at).orderBy("place").select("value").write.mode("overwrite").text(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(rank, value) of a written text feed; the head has rank 0."""
    parts = spark.read.option("lineSep", "\n## ").text(path)
    number = F.regexp_extract("value", r"^(?:## )?(\d+)\. ", 1)
    text = F.rtrim(F.regexp_replace("value", "^## ", ""), F.lit("\n"))
    return parts.select(F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0)).alias("rank"), text.alias("value"))
