"""Large keys and large tables in small: what only showed at size."""

import os
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from adledger.functions.text import scan
from adledger.operators import state
from adledger.plans import state_queries
from adledger.plans.bindings import listings
from adledger.schema import conform
from adledger.session import written
from adledger.sources import exports
from tests.check import _rows, duck

SHIFT = 8_850_000


@pytest.fixture(scope="module")
def shifted(sf_dir, tmp_path_factory):
    """The orders with keys as in a table of nine million."""
    out = str(tmp_path_factory.mktemp("shifted"))
    duckdb.execute(f"COPY (SELECT * REPLACE (o_orderkey + {SHIFT} AS o_orderkey) FROM '{sf_dir}/orders.parquet') TO '{out}/orders.parquet' (FORMAT parquet)")
    return out


@pytest.mark.parametrize("name", ["o_clu_2", "o_clu_3", "o_win_9", "o_jon_4", "o_clu_4", "o_str_1", "o_str_4"])
def test_prices_beyond_an_integer(spark, shifted, name):
    """The SQL cannot hold these prices in its INTEGER; a wider one gives what it means."""
    df = entry.queries()[name](spark, shifted)
    sql = entry.oracle_sql()[name]
    wide = sql.replace("as int) AS price_eur", "as bigint) AS price_eur")
    result = duck(shifted).execute(wide)
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, result.fetchall())


def test_the_json_feed_is_compressed(spark, sf_dir, tmp_path):
    rows = conform(listings(spark, sf_dir))
    exports.write_json(rows, str(tmp_path / "feed"), F.lit("2024-03-01"))
    folder = tmp_path / "feed" / "listings"
    size = sum(os.path.getsize(folder / f) for f in os.listdir(folder))
    text = spark.read.text(str(folder)).agg(F.count("*"), F.sum(F.length("value"))).first()
    assert text[0] == rows.count() and size * 5 < text[1]


def test_scans_do_not_translate_each_character(spark):
    df = spark.createDataFrame([("a\x01 12 \x02b\x03 7\x04",), ("",)], "t string")
    found = df.select(scan(F.col("t"), r"(\d+)", groups=1, left=3, right=2, shortest=1).alias("m"))
    assert "translate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [[tuple(m) for m in r.m] for r in found.collect()] == [[("12", "a  ", "  "), ("7", "b  ", " ")], []]


def test_no_ids_of_the_state_pass_the_driver(spark, sf_dir):
    plan = entry.queries()["o_snk_4"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    fresh, stored = state_queries._runs(spark, sf_dir)
    plan = state.upsert(fresh, written(stored), F.lit("2024-03-01").cast("timestamp")).state._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def plans_of(spark, job):
    """Texts of the plans that ``job`` runs; only what is planned as a broadcast is sent as one."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    adaptive = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.set(adaptive, "-1")
    try:
        job()
    finally:
        spark.conf.unset(adaptive)
    runs = store.executionsList()
    return [runs.apply(i).physicalPlanDescription() for i in range(runs.size()) if runs.apply(i).executionId() >= before]


def test_no_listings_of_a_stream_pass_the_driver(spark, sf_dir):
    """No join of a whole ingest is planned as a broadcast of what grows with the listings."""
    plans = plans_of(spark, lambda: entry.queries()["o_str_4"](spark, sf_dir).write.format("noop").mode("overwrite").save())
    assert len(plans) > 20
    assert [p for p in plans if "BroadcastExchange" in p] == []


def test_a_level_shuffles_open_rows_only_and_none_are_broadcast(spark, sf_dir):
    plans = plans_of(spark, lambda: entry.queries()["o_clu_4"](spark, sf_dir).write.format("noop").mode("overwrite").save())
    # the two shuffles of a level, told in the final and in the first plan
    assert 1 <= max(p.count("hashpartitioning(_key#") for p in plans) <= 4
    assert [p for p in plans if "BroadcastExchange" in p] == []


def test_whole_rows_of_a_run_are_shuffled_by_one_step_at_a_time(spark, sf_dir):
    plans = plans_of(spark, lambda: entry.queries()["o_snk_4"](spark, sf_dir).write.format("noop").mode("overwrite").save())
    wide = [re.findall(r"Exchange\s*\nInput \[(\d+)\]", p) for p in plans]
    # the steps: put, type, stage, put; each told in the final and in the first plan
    assert 1 <= max(sum(int(n) > 40 for n in p) for p in wide) <= 2
    assert [p for p in plans if "BroadcastExchange" in p] == []


def test_a_written_table_frees_its_shuffle_files(spark):
    def files():
        kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in kept.mkString("\n").split("\n") if "shuffle_" in f}

    before = files()
    assert written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    for _ in range(50):
        left = files() - before
        if not any(f.endswith(".data") for f in left):
            break
        time.sleep(0.2)
    # the count of rows after it has one of its own
    assert sum(f.endswith(".data") for f in left) <= 1
