"""Streams equal their batch forms over several micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.readwriter import DataFrameWriter

from adledger import lexicon as lx
from adledger.operators import history
from adledger.plans.batch import SNAPSHOT, listing_folder, run_pages
from adledger.plans.bindings import events
from adledger.sources.state_table import BatchFolder, Staged
from adledger.streaming import ingest, transitions
from tests.test_pages import pages


def checks(spark, sf_dir):
    return events(spark, sf_dir).select(
        "listing_id", F.col("captured_at").cast("timestamp").alias("captured_at"), "id", "is_online")


def drained(spark, stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def inbox(spark, sf_dir, tmp_path):
    """The checks as three files in time order, one micro-batch each."""
    df = checks(spark, sf_dir)
    path = str(tmp_path / "in")
    n = df.count()
    for part in range(3):
        df.filter((F.col("id") >= part * n // 3) & (F.col("id") < (part + 1) * n // 3)).coalesce(
            1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def ids(df):
    return sorted((r["listing_id"], r["id"], r["is_online"]) for r in df.collect())


def test_transitions_through_the_status_table(spark, sf_dir, tmp_path):
    folder = transitions.check_folder(spark, str(tmp_path / "store"), buckets=8)
    transitions.track_checks(inbox(spark, sf_dir, tmp_path), folder, str(tmp_path / "cp")).awaitTermination()
    assert ids(folder.log("transitions", transitions.TRANSITION)) == ids(
        history.status_transitions(checks(spark, sf_dir)))
    latest = {r["listing_id"]: r["is_online"] for r in folder.state.read().collect()}
    want = {r["listing_id"]: r["is_online"] for r in history.latest_status(checks(spark, sf_dir)).collect()}
    assert latest == want


def test_one_listing_with_many_checks_in_a_batch(spark, tmp_path):
    rows = spark.range(30_000).select(
        F.lit("x").alias("listing_id"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1_000_000).alias("captured_at"),
        "id", ((F.col("id") / 1000).cast("long") % 2 == 0).alias("is_online"))
    source = str(tmp_path / "in")
    rows.orderBy(F.xxhash64("id")).coalesce(1).write.parquet(source)
    folder = transitions.check_folder(spark, str(tmp_path / "store"))
    transitions.track_checks(spark.readStream.schema(rows.schema).parquet(source), folder, str(tmp_path / "cp")).awaitTermination()
    got = ids(folder.log("transitions", transitions.TRANSITION))
    assert got == ids(history.status_transitions(rows)) and len(got) == 30


CHECKS = "listing_id string, captured_at timestamp, id bigint, is_online boolean"


def at(minutes):
    return dt.datetime(2024, 3, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=minutes)


def streamed(spark, tmp_path, batches, make):
    """Rows that a stream of the given batches, (listing, minute, online) each, has put out."""
    source, out, cp = (str(tmp_path / n) for n in ("rows", "out", "cp"))
    n = 0
    for batch in batches:
        rows = [(k, at(m), n + i, online) for i, (k, m, online) in enumerate(batch)]
        n += len(rows)
        spark.createDataFrame(rows, CHECKS).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(CHECKS).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@pytest.mark.parametrize("cuts", [[6], [2, 4], [1, 1, 1, 1, 1, 1]])
def test_expiry_reports_each_stale_time_once(spark, tmp_path, cuts):
    """However the checks are cut into batches; within the watermark their order does not matter."""
    rows = [("a", 0, True), ("b", 1, True), ("a", 4, True), ("b", 9, True), ("a", 20, True), ("c", 60, True)]
    batches, done = [], 0
    for n in cuts:
        batches.append(rows[done:done + n])
        done += n
    got = streamed(spark, tmp_path, batches, lambda s: transitions.stream_expiry(s, ttl=300, delay="10 minutes"))
    want = {("a", 4), ("b", 1), ("b", 9), ("a", 20)}
    assert sorted((r["listing_id"], r["last_checked_at"]) for r in got.collect()) == sorted(
        (k, at(m).replace(tzinfo=None)) for k, m in want)


def test_counts_drop_rows_later_than_the_watermark(spark, tmp_path):
    batches = [[("a", 5, True), ("a", 70, False)], [("b", 61, True), ("b", 10, True)], [("c", 300, True)], [("d", 65, True)]]
    got = streamed(spark, tmp_path, batches, transitions.windowed_counts)
    # 70 - 10 has closed the first hour before its row of minute 10 comes; 65 comes after all
    assert sorted((r["window_start"].hour, r["online"], r["offline"]) for r in got.collect()) == [(0, 1, 0), (1, 1, 1)]


def test_windowed_counts_stream(spark, sf_dir, tmp_path):
    got = drained(spark, transitions.windowed_counts(inbox(spark, sf_dir, tmp_path)), tmp_path)
    batch = {r["window_start"]: (r["online"], r["offline"])
             for r in transitions.windowed_counts(checks(spark, sf_dir)).collect()}
    rows = {r["window_start"]: (r["online"], r["offline"]) for r in got.collect()}
    # windows still open at the watermark are not emitted in append mode
    assert rows and all(batch[w] == c for w, c in rows.items()) and len(rows) >= len(batch) - 2


def test_pages_become_state(spark, tmp_path):
    ad = "<article><a href='/de/d/{i}'>Corvette C6 LS3 | {i}</a><b class='_i2QOc'>{p} €</b></article>"
    source = str(tmp_path / "pages")
    folder = listing_folder(spark, str(tmp_path / "store"))
    for run, price in enumerate(("41.000", "39.500")):
        body = ad.format(i=1, p=price) + ad.format(i=2, p="50.000")
        pages(spark, [{"source": lx.AUTOUNCLE, "body": body}]).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        ingest.ingest_pages(stream, folder, str(tmp_path / "cp")).awaitTermination()
    got = {r["source_listing_id"]: (r["price_eur"], r["change_type"], r["previous_price_eur"])
           for r in folder.state.read().collect()}
    assert got == {"1": (39500, "price_change", 41000), "2": (50000, "unchanged", None)}
    assert folder.log("snapshots", SNAPSHOT).count() == 4


def test_a_provider_that_cannot_start_is_a_warning(spark, tmp_path):
    def broken():
        raise OSError("no model")

    body = "<article><a href='/de/d/1'>Corvette C6 LS3 | 1</a><b class='_i2QOc'>41.000 €</b></article>"
    folder = listing_folder(spark, str(tmp_path / "store"))
    warnings = run_pages(pages(spark, [{"source": lx.AUTOUNCLE, "body": body}]), folder, F.lit(at(0)), "one", provider=broken).collect()
    assert ("AI enrichment", "provider did not start: no model (1)") in {tuple(r) for r in warnings}
    assert [r["price_eur"] for r in folder.state.read().collect()] == [41000]


class Lost(Exception):
    pass


@pytest.mark.parametrize("lost_at", ["log", "staged", "put"])
def test_batches_survive_a_loss_at_each_write(spark, tmp_path, monkeypatch, lost_at):
    """A batch that is lost at any write and repeated leaves what one that was not lost would have left."""
    def counts(folder, version, n):
        rows = spark.range(n).select(F.concat(F.lit("k"), "id").alias("id"), F.lit(n).alias("n"))
        known = folder.state.near(rows, "id").withColumnRenamed("n", "_n")

        def compute():
            return Staged(rows.join(known, "id", "full").select("id", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n")),
                          seen=rows.withColumn("captured_at", F.current_timestamp()))

        folder.apply(version, compute)

    columns = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    folder = BatchFolder(spark, str(tmp_path / "f"), columns, "id", buckets=4)
    counts(folder, "one", 5)
    plain = DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        kind = "put" if path.endswith("/state") else "staged" if "/staged/" in path else "log" if "/seen/" in path else ""
        if kind == lost_at:
            raise Lost
        return plain(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    for _ in range(2):
        with pytest.raises(Lost):
            counts(folder, "two", 3)
    monkeypatch.setattr(DataFrameWriter, "parquet", plain)
    assert {r["id"]: r["n"] for r in folder.state.read().collect()} == {f"k{i}": 5 for i in range(5)}
    for _ in range(3):
        counts(folder, "two", 3)
    assert {r["id"]: r["n"] for r in folder.state.read().collect()} == {f"k{i}": 5 + 3 * (i < 3) for i in range(5)}
    assert folder.log("seen", columns).count() == 8


def test_a_new_stream_does_not_repeat_batch_names(spark, tmp_path):
    folder = transitions.check_folder(spark, str(tmp_path / "store"))
    for n, name in enumerate(("a", "b")):
        source = str(tmp_path / f"in{n}")
        spark.createDataFrame([(name, at(n), n, True)], CHECKS).write.parquet(source)
        stream = spark.readStream.schema(CHECKS).parquet(source)
        transitions.track_checks(stream, folder, str(tmp_path / f"cp{n}")).awaitTermination()
    assert folder.state.read().count() == folder.log("transitions", transitions.TRANSITION).count() == 2
