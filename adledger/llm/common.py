"""Helpers shared by the text operators: input columns, row keys, durable cuts, edges.

A document row is known by ``doc_id`` together with the XXH64 of its text (``_h``), so
tables with repeated ids or whole repeated rows join without multiplying. Null ids are
one more id: all joins on it are null-safe. Input columns other than those an operator
names are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adledger.session import FREE_SHUFFLES, setting, work_path

#: Narrow rows of a task in the rounds of a loop.
TASK_ROWS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text read as empty."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have (names differ in more than case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def text_hash(column: str = "text") -> Column:
    return F.xxhash64(F.col(column))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the named columns of two frames."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the keys once, from the left side."""
    named = {k: fresh(left, f"_r_{k}".lower()) for k in keys}
    right = right.select(*[F.col(c).alias(named[c]) if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[named[k]]) for k in keys])
    joined = left.join(right, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*named.values())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: short lineage, known size, lost tasks
    of later stages read files."""
    path = work_path(df.sparkSession, name)
    # what is written needs its shuffle files no more; else they stay until the driver collects its garbage
    with setting(df.sparkSession, FREE_SHUFFLES, "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without repeats of ``keys``; only the repeated ones are shuffled whole."""
    repeated = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys))
    if not repeated.limit(1).count():
        return rows
    return rows.join(repeated, keys, "left_anti").union(rows.join(repeated, keys, "left_semi").dropDuplicates(keys))


def small_batches(spark: SparkSession, rows: int = 500):
    """Whole texts go to Python workers in batches of ``rows`` while jobs run in this block.
    Keeps buffers of workers and executors small."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def cut(df: DataFrame) -> DataFrame:
    """``stored`` for the rounds of a loop. A checkpoint keeps the size estimate of its plan, a
    product over joins that has twice the digits after each round and stalls the planner;
    a table just written has its true size."""
    return stored(df, "round")


def tasks_for(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Tasks for so many rows: one per ``each`` of them, but no fewer than cores."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with root the smallest node reachable, for nodes that have an edge.

    ``edges`` has bigint columns u, v. Alternates large-star and small-star rounds: each
    hooks the neighbours of a node to the smallest of them, and the edge count does not
    grow. Only neighbour minima are aggregated, so a node with very many neighbours is
    combined on the map side; its join is an ordinary one that AQE can split. The driver
    reads one (count, checksum) row per round. Steps of a round run in tasks by the number of
    edges left, as each task of a step, however small, leaves its files and its log.
    """
    tasks = None

    def star(e: DataFrame, larger_only: bool) -> DataFrame:
        both = e if larger_only else e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m"))
        least = least.select(F.col("u"), F.least("u", "_m").alias("m"))
        hooked = both.join(least, "u").coalesce(tasks)
        if larger_only:
            moved = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                least.select("u", F.col("m").alias("v")))
        else:
            moved = hooked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where(F.col("u") != F.col("v")).distinct().coalesce(tasks)

    def checksum(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = cut(edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = checksum(current)
    while seen[0]:
        tasks = tasks_for(edges.sparkSession, seen[0])
        current = cut(star(star(current, False), True))
        now = checksum(current)
        if now == seen:
            break
        seen = now
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
