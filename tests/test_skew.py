"""Skew-safe building blocks equal the plain definition, with one key holding a third."""

import random

import pytest
from pyspark.sql import functions as F

from adledger.operators import graph, history, scan
from adledger.operators.dedupe import dedupe_urls, greedy_distinct
from adledger.operators.skew import has_partner, lag_in_blocks, lookup


def hot_keys(rng, n):
    return ["hot" if rng.random() < 0.34 else f"k{rng.randrange(n)}" for _ in range(n)]


def test_has_partner(spark):
    rng = random.Random(1)
    keys = [None if rng.random() < 0.1 else k for k in hot_keys(rng, 3000)]
    df = spark.createDataFrame(list(enumerate(keys)), "pos long, k string")
    steps, answer = has_partner(F.col("k"), "pos")
    got = {r["pos"]: r["a"] for r in df.withColumns(steps).select("pos", answer.alias("a")).collect()}
    assert got == {i: k is not None and keys.count(k) > 1 for i, k in enumerate(keys)}


def test_lookup(spark):
    rng = random.Random(2)
    keys = hot_keys(rng, 2000)
    df = spark.createDataFrame(list(enumerate(keys)), "pos long, k string")
    known = sorted(set(keys))[::2] + ["hot"]
    table = spark.createDataFrame([(k, f"v{k}") for k in set(known)], "k string, v string")
    got = {r["pos"]: r["v"] for r in lookup(df, table, "k", "pos").collect()}
    assert got == {i: f"v{k}" if k in known else None for i, k in enumerate(keys)}


def test_lag_in_blocks(spark):
    rng = random.Random(3)
    rows = [(i, k, rng.randrange(9)) for i, k in enumerate(hot_keys(rng, 2000))]
    df = spark.createDataFrame(rows, "pos long, k string, v int")
    got = lag_in_blocks(df, "k", F.floor(F.col("pos") / 7), [F.col("pos")],
                        {"before": F.col("v")}, first_flag="first").collect()
    last, want = {}, {}
    for pos, k, v in rows:
        want[pos] = (last.get(k), k not in last)
        last[k] = v
    assert {r["pos"]: (r["before"], r["first"]) for r in got} == want


def snapshot_rows(rng, n):
    kinds = ["unchanged"] * 6 + ["price_change", "metadata_change", "new"]
    rows, minute = [], 0
    for i, k in enumerate(hot_keys(rng, n)):
        minute += rng.choice([0, 1, 45, 300])
        rows.append((k, minute, i, rng.choice([None, 1, 2, 3]), i, rng.choice(kinds)))
    return rows


def snapshots(spark, rows):
    df = spark.createDataFrame(
        rows, "listing_id string, m int, id int, price_eur int, mileage_km int, change_type string")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return df.withColumn("captured_at", F.timestamp_seconds(F.unix_timestamp(start) + F.col("m") * 60))


@pytest.fixture
def many_parts(spark):
    """Small frames stay in as many range partitions as there are shuffle partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_running_sums_cross_partitions(spark, many_parts):
    rng = random.Random(9)
    rows = [(None if rng.random() < .2 else k, i, rng.randrange(9)) for i, k in enumerate(hot_keys(rng, 900))]
    df = spark.createDataFrame(rows, "k string, pos long, v int").repartition(5)
    ranged = scan.in_ranges(df, ["k"], [F.col("pos")])
    parts = {r["k"]: r["n"] for r in ranged.groupBy("k").agg(F.countDistinct(scan.PART).alias("n")).collect()}
    assert parts["hot"] > 2
    got = scan.running(ranged, scan.part_starts(ranged, ["k"], F.col("v")), ["k"], [F.col("pos")], "before", F.col("v"))
    sums, want, places = {}, {}, {}
    for k, pos, v in rows:
        want[pos] = (sums.get(k, 0), places.get(k, 0))
        sums[k], places[k] = sums.get(k, 0) + v, places.get(k, 0) + 1
    placed = {r["pos"]: r["place"] for r in scan.numbered(df, ["k"], [F.col("pos")]).collect()}
    assert {r["pos"]: (r["before"], placed[r["pos"]]) for r in got.collect()} == want


def test_one_listing_with_all_checks_in_one_hour_is_spread(spark, many_parts):
    """Equal to a loop, with one listing and one timestamp for nearly all rows."""
    rng = random.Random(10)
    rows = [("hot" if rng.random() < .9 else "cold", 5 if rng.random() < .9 else 6, i, rng.choice([None, 1, 2]), i,
             rng.choice(["unchanged", "unchanged", "unchanged", "price_change"])) for i in range(2000)]
    df = snapshots(spark, rows).withColumn("is_online", F.col("id") % 7 < 4)
    ranged = history._ranged(df)
    sizes = [r["count"] for r in ranged.groupBy("listing_id", scan.PART).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 700
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    flips, last, runs, calm = [], {}, {}, {}
    for k, _, i, price, _, kind in ordered:
        online = i % 7 < 4
        if last.get(k) != online:
            flips.append(i)
        last[k] = online
        if kind == "unchanged" and calm.get(k) is not None:
            runs[calm[k]] += 1
        else:
            runs[i] = 1
            calm[k] = i if kind == "unchanged" else None
    assert sorted(r["id"] for r in history.status_transitions(df).collect()) == sorted(flips)
    assert {r["id"]: r["count"] for r in history.collapse_unchanged(df).collect()} == runs
    series, seen = {}, {}
    for k, _, i, price, _, _ in ordered:
        if price is not None and seen.get(k) != price:
            seen[k] = price
            series.setdefault(k, []).append(i)
    assert sorted((r["listing_id"], r["point"], r["id"]) for r in history.price_series(df).collect()) == sorted(
        (k, n + 1, i) for k, s in series.items() if len(s) > 1 for n, i in enumerate(s))


def test_collapse_unchanged_equals_loop(spark):
    rows = snapshot_rows(random.Random(4), 1500)
    got = sorted((r["listing_id"], r["id"], r["count"], r["change_type"], r["price_eur"])
                 for r in history.collapse_unchanged(snapshots(spark, rows)).collect())
    want, open_run = [], {}
    for k, _, i, price, _, kind in rows:
        if kind == "unchanged" and k in open_run:
            open_run[k][2] += 1
            continue
        entry = [k, i, 1, kind, price]
        want.append(entry)
        if kind == "unchanged":
            open_run[k] = entry
        else:
            open_run.pop(k, None)
    assert got == sorted(tuple(w) for w in want)


def test_price_series_equals_loop(spark):
    rows = snapshot_rows(random.Random(5), 1500)
    got = sorted((r["listing_id"], r["point"], r["id"])
                 for r in history.price_series(snapshots(spark, rows), 20).collect())
    series, last = {}, {}
    for k, _, i, price, _, _ in rows:
        if price is not None and last.get(k) != price:
            last[k] = price
            series.setdefault(k, []).append(i)
    want = [(k, n + 1, i) for k, s in series.items() if len(s) > 1 for n, i in enumerate(s[:20])]
    assert got == sorted(want)


def greedy_loop(rows):
    ids, urls, want = set(), set(), []
    for pos, source, i, u in rows:
        if (source, i) not in ids and u not in urls:
            ids.add((source, i)), urls.add(u), want.append(pos)
    return want


KEYS = "pos long, source string, source_listing_id string, url string"


@pytest.mark.parametrize("settle", [0, 5, 1000])
def test_greedy_distinct_settles_components(spark, settle):
    """Small components, chains and a hot url, with and without further rounds."""
    rng = random.Random(settle)
    rows = [("s", f"i{rng.randrange(300)}", "hot" if rng.random() < .3 else f"u{rng.randrange(300)}") for _ in range(400)]
    rows += [("c", f"i{i // 2}", f"u{(i + 1) // 2}") for i in range(41)]
    rng.shuffle(rows)
    rows = [(n, *r) for n, r in enumerate(rows)]
    got = greedy_distinct(spark.createDataFrame(rows, KEYS), settle=settle)
    assert sorted(r["pos"] for r in got.collect()) == greedy_loop(rows)


def test_greedy_distinct_on_a_long_chain(spark, monkeypatch):
    """100,000 rows, each sharing one key with the next: rounds follow the logarithm."""
    n, rounds = 100_000, []
    monkeypatch.setattr(graph, "follow", lambda p, plain=graph.follow: rounds.append(1) or plain(p))
    order = list(range(n))
    random.Random(3).shuffle(order)
    place = {i: p for p, i in enumerate(order)}
    rows = [(place[i], "s", f"i{i // 2}", f"u{(i + 1) // 2}") for i in range(n)]
    got = {r["pos"] for r in greedy_distinct(spark.createDataFrame(rows, KEYS)).select("pos").collect()}
    assert got == set(greedy_loop(sorted(rows))) and len(rounds) <= 17


def test_components_equal_union_find(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(500), rng.randrange(500)) for _ in range(330)] + [(1000, 1000 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(200)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_greedy_distinct_equals_loop(spark):
    rng = random.Random(6)
    rows = [(i, "s", f"i{rng.randrange(12) if rng.random() < .7 else 0}", f"u{rng.randrange(12)}")
            for i in range(120)]
    df = spark.createDataFrame(rows, "pos long, source string, source_listing_id string, url string")
    ids, urls, want = set(), set(), []
    for pos, _, i, u in rows:
        if i not in ids and u not in urls:
            ids.add(i), urls.add(u), want.append(pos)
    assert sorted(r["pos"] for r in greedy_distinct(df).collect()) == want


def test_greedy_distinct_known_chains(spark):
    def kept(pairs):
        df = spark.createDataFrame([(n, "s", i, u) for n, (i, u) in enumerate(pairs)],
                                   "pos long, source string, source_listing_id string, url string")
        return sorted(r["pos"] for r in greedy_distinct(df).collect())

    assert kept([("i1", "u1"), ("i2", "u1"), ("i2", "u3")]) == [0, 2]
    assert kept([("i1", "u1"), ("i1", "u2"), ("i2", "u2")]) == [0, 2]


def test_dedupe_urls_prefers_real_ids_then_later_rows(spark):
    rows = [(0, "u1", "77"), (1, "u1", "ka-3"), (2, "u2", "as24-1"), (3, "u2", None), (4, "u1", "78")]
    df = spark.createDataFrame(rows, "pos long, url string, source_listing_id string")
    got = {r["url"]: (r["source_listing_id"], r["pos"]) for r in dedupe_urls(df).collect()}
    assert got == {"u1": ("78", 0), "u2": (None, 2)}
