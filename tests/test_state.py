"""Upsert, overrides, quality and history quartiles on hand-worked cases."""

import csv
import datetime as dt

from pyspark.sql import functions as F

from adledger import lexicon as lx
from adledger import schema
from adledger.operators import filters, scoring, state, validation
from adledger.plans.batch import SNAPSHOT, STATE, Run, listing_folder, run_listings, store_run
from adledger.sources import exports
from tests.test_clusters import CAR, frame



def first_of_may():
    return F.lit("2024-05-01 10:00:00").cast("timestamp")


def second_of_may():
    return F.lit("2024-05-02 10:00:00").cast("timestamp")


def empty_state(spark):
    return spark.createDataFrame([], STATE)


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.select("id", *columns).collect()}


def test_two_runs(spark):
    one = frame(spark, [{"id": "a", "price_eur": 10, "mileage_km": 1, "cluster_id": "x"},
                        {"id": "b", "price_eur": None, "mileage_km": 2},
                        {"id": "c", "price_eur": 7}])
    first = state.upsert(one, empty_state(spark), first_of_may()).state.withColumns({
        "hidden": F.col("id") == "b",
        "cluster_id": F.when(F.col("id") == "a", F.lit("manual_1")),
    })
    two = frame(spark, [{"id": "a", "price_eur": 9, "mileage_km": 1, "cluster_id": "soft_full_z"},
                        {"id": "b", "price_eur": None, "mileage_km": 3}, {"id": "d"}])
    result = state.upsert(two, first, second_of_may())
    assert by_id(result.state, "change_type", "previous_price_eur", "hidden", "cluster_id") == {
        "a": ("price_change", 10, False, "manual_1"), "b": ("metadata_change", None, True, None),
        "c": ("new", None, False, None), "d": ("new", None, False, None)}
    times = by_id(result.state, "created_at", "last_seen_at")
    assert times["a"] == (dt.datetime(2024, 5, 1, 10), dt.datetime(2024, 5, 2, 10))
    assert times["c"] == (dt.datetime(2024, 5, 1, 10), dt.datetime(2024, 5, 1, 10))
    assert sorted(r["listing_id"] for r in result.snapshots.collect()) == ["a", "b", "d"]


def test_repeated_run_is_unchanged(spark):
    rows = [{**CAR, "id": f"r{i}", "location_raw": f"Ort{i}", "price_eur": 30000 + 2000 * i}
            for i in range(12)]
    first = run_listings(frame(spark, rows), empty_state(spark), first_of_may()).upsert.state
    again = run_listings(frame(spark, rows), first, second_of_may()).upsert
    assert {r["change_type"] for r in again.stored.collect()} == {"unchanged"}
    assert again.state.count() == 12


def test_same_id_twice_in_a_batch(spark):
    rows = [{"id": "a", "price_eur": 5}, {"id": "a", "price_eur": 6}, {"id": "a", "price_eur": 6}]
    result = state.upsert(frame(spark, rows), empty_state(spark), first_of_may())
    kinds = [r["change_type"] for r in result.snapshots.orderBy("pos").collect()]
    assert kinds == ["new", "price_change", "unchanged"]
    assert by_id(result.state, "price_eur") == {"a": (6,)}


def test_overrides_replace_even_by_null(spark):
    rows = spark.createDataFrame(
        [("l0", "price_eur", "123"), ("l0", "trim", ""), ("l0", "equipment", '["Navi"]'),
         ("l0", "score", "1"), ("l0", "first_registration", "2008"), ("l0", "model_year", "x"),
         ("l1", "hidden", "true")],
        "listing_id string, field string, value string").withColumn("updated_at", first_of_may())
    accepted, refused = state.split_overrides(rows)
    assert sorted(r["field"] for r in refused.collect()) == ["first_registration", "model_year", "score"]
    got = state.apply_overrides(frame(spark, [CAR, CAR]), accepted)
    assert by_id(got, "price_eur", "trim", "equipment", "hidden") == {
        "l0": (123, None, ["Navi"], False), "l1": (45200, "Grand Sport", [], True)}


def test_override_keys_win_last(spark):
    def rows(value, at):
        return spark.createDataFrame([("a", "trim", value)], "listing_id string, field string, value string"
                                     ).withColumn("updated_at", at)

    merged = state.merge_overrides(rows("Z06", first_of_may()), rows(None, second_of_may())).collect()
    assert [(r["field"], r["value"]) for r in merged] == [("trim", None)]


def test_payload_repairs(spark):
    df = spark.createDataFrame([('{"id":"a","trim":"Z99","risk_flags":null,"hidden":null}',),
                                ('{"id":"b","transmission":"manual","body_style":"SUV"}',)],
                               "payload_json string")
    got = {r["id"]: r for r in schema.from_payload(df).collect()}
    assert got["a"]["trim"] is None and got["a"]["risk_flags"] == [] and got["a"]["hidden"] is False
    assert got["b"]["transmission"] == "manual" and got["b"]["body_style"] is None


def test_index_quartiles(spark):
    for n in (1, 4, 10, 12, 13):
        values = [(i * 70_001 % 997,) for i in range(n)]
        df = spark.createDataFrame(values, "price_eur int")
        want = sorted(v for v, in values)
        got = validation.index_quartiles(df, "price_eur").first()
        assert (got["n"], got["q1"], got["q3"]) == (n, want[n // 4], want[3 * n // 4])


def test_outliers_need_ten_values_and_append(spark):
    def flags(n):
        history = frame(spark, [{"price_eur": 1000 + i, "mileage_km": 100 + i} for i in range(n)])
        fresh = frame(spark, [{"price_eur": 10, "mileage_km": 9999}, {"price_eur": 99999},
                              {"price_eur": 1005, "mileage_km": 1}])
        return by_id(validation.with_historical_flags(fresh, history).select(
            "id", F.transform("validation_flags", lambda f: f["code"]).alias("c")), "c")

    assert flags(12) == {
        "l0": (["price_below_historical_range", "mileage_above_historical_range"],),
        "l1": (["price_above_historical_range"],), "l2": ([],)}
    assert flags(9) == {"l0": ([],), "l1": ([],), "l2": ([],)}


def test_validation_codes(spark):
    df = frame(spark, [CAR, {"price_eur": 0, "mileage_km": 50, "power_hp": 1300, "engine": "LS7",
                             "trim": "Base", "first_registration": "2016-01"}])
    got = by_id(df.select("id", F.transform(
        validation.validation_flags(), lambda f: f["code"]).alias("c")), "c")
    assert got == {"l0": ([],), "l1": ([
        "price_zero", "mileage_very_low", "power_very_high", "year_out_of_range",
        "engine_trim_mismatch", "body_style_missing"],)}


def test_score_configuration(spark):
    df = frame(spark, [CAR, {}, {**CAR, "risk_flags": ["sold_or_reserved", "unknown"]}])

    def scores(config=None):
        return [r["score"] for r in scoring.with_score(df, config).orderBy("pos").collect()]

    # 20 + 8 (LS3) + 15 (manual) + 3 (Grand Sport) + 10 (body) + 5 (61,000 km) + 3 * 1.25
    assert scores() == [64, 12, 44]
    assert scores({"budget": {"engine": 0}, "risk_penalties": {"unknown": 50}}) == [56, 17, 0]
    assert scores({"base_score": "x", "mileage_distribution": []}) == [59, 12, 39]


def test_filters_ignore_what_says_nothing(spark):
    df = frame(spark, [CAR, {"price_eur": 1, "tuv_until": "2025-03"}])

    def ids(**params):
        return sorted(r["id"] for r in filters.filter_listings(df, params).collect())

    assert ids() == ids(price_min="x", nothing="1", trim=" ", eu_spec="yes") == ["l0", "l1"]
    assert ids(trim="grand sport") == [] and ids(engine=" ls3 ") == ["l0"]
    assert ids(tuv_min="2025") == ["l1"] and ids(mileage_max="61000") == ["l0"]


def test_quality_reports_silent_sources(spark):
    df = frame(spark, [{"source": "A"}, {"source": "A"}, {"source": ""}])
    got = validation.crawl_quality(df, min_total=3, min_by_source={"A": 3, "B": 1}).collect()
    assert sorted((r["scope"], r["actual"], r["expected"]) for r in got) == [("A", 2, 3), ("B", 0, 1)]


def test_state_table_rewrites_only_touched_buckets(spark, tmp_path):
    folder = listing_folder(spark, str(tmp_path / "f"), buckets=8)
    assert folder.state.read().count() == 0

    def apply(version, ids, price):
        rows = frame(spark, [{"id": i, "price_eur": price} for i in ids])
        store_run(folder, version, lambda: Run(state.upsert(rows, folder.state.read(), first_of_may()), rows))

    apply("one", [f"x{i}" for i in range(40)], 10)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "f/state").rglob("*.parquet")}
    assert len({p.parent.name for p in before}) == 8
    apply("two", ["x7", "new"], 20)
    kept = [p for p in before if p.exists() and p.stat().st_mtime_ns == before[p]]
    assert len({p.parent.name for p in kept}) >= 6
    got = {r["id"]: (r["price_eur"], r["change_type"]) for r in folder.state.read().collect()}
    assert len(got) == 41 and got["x7"] == (20, "price_change") and got["new"] == (20, "new") and got["x8"] == (10, "new")
    log = folder.log("snapshots", SNAPSHOT)
    assert log.count() == 42 and {r["batch"] for r in log.select("batch").distinct().collect()} == {"one", "two"}


def test_written_feeds(spark, tmp_path):
    """Content of the files themselves: head, order, quoting, and the line of an empty feed."""
    rows = frame(spark, [{"id": "a", "title": 'He said "hi", twice', "score": 10, "price_eur": 5, "inference_notes": ["x, y", "z"], "change_type": "new"},
                         {"id": "b", "title": "Best", "score": 90, "price_eur": None, "change_type": "price_change"}])

    def text(name):
        return "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))

    exports.write_markdown(rows, str(tmp_path / "md"), F.lit("2024-05-01"))
    lines = text("md").split("\n")
    assert lines[0] == "# Neue C6 Corvette-Angebote — 2024-05-01" and lines[2] == "Aktive Treffer: **2** · Neu: **1** · Preisänderungen: **1**"
    assert [x for x in lines if x.startswith("## ")] == ["## 1. Best — k.A.", '## 2. He said "hi", twice — 5 €']
    exports.write_markdown(rows.limit(0), str(tmp_path / "none"), F.lit("2024-05-01"))
    assert text("none").split("\n")[-2] == "Keine C6-Corvette-Angebote gefunden oder Quellen waren blockiert."
    exports.write_csv(rows, str(tmp_path / "csv"))
    parts = [list(csv.DictReader(p.open(newline=""))) for p in sorted((tmp_path / "csv").glob("part-*"))]
    told = [r for part in parts for r in part]
    assert [r["id"] for r in told] == ["b", "a"] and list(told[0]) == list(lx.CSV_COLUMNS)
    assert told[1]["title"] == 'He said "hi", twice' and told[1]["inference_notes"] == "['x, y', 'z']" and told[0]["price_eur"] == ""
