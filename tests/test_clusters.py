"""Clustering cases and the closed form of the cross-fill against a mutual exchange."""

import random

from pyspark.sql.types import LongType, StructField, StructType

from adledger.operators.clusters import assign_clusters, enrich_clusters
from adledger.schema import LISTING, conform, repair


def frame(spark, rows):
    """Listings from dicts; ``pos`` is the position in the list."""
    names = [f.name for f in LISTING]
    base = {"source": "s", "title": "t"}
    full = [
        tuple({**base, "id": f"l{i}", "url": f"u{i}", **r}.get(n) for n in names) + (i,)
        for i, r in enumerate(rows)
    ]
    schema = StructType([*LISTING.fields, StructField("pos", LongType())])
    df = spark.createDataFrame(full, schema)
    return repair(conform(df, keep=("pos",)))


CAR = {"engine": "LS3", "trim": "Grand Sport", "price_eur": 45200, "mileage_km": 61000,
       "location_raw": "Kiel", "transmission": "manual", "body_style": "Targa",
       "exterior_color": "schwarz", "first_registration": "2010-04", "power_hp": 437}


def clusters(spark, rows, existing=None):
    stored = frame(spark, existing) if existing else None
    got = assign_clusters(frame(spark, rows), stored).collect()
    return {r["id"]: r["cluster_id"] for r in got}


def test_levels(spark):
    """One pair per level in a single batch; far-apart prices keep the pairs apart."""
    pairs = {
        "vin_": [{"vin": "VIN1"}, {"vin": "VIN1", "price_eur": 1}],
        "soft_full_": [{}, {"exterior_color": "Black"}],
        "soft_no_trim_": [{}, {"trim": None}],
        "soft_no_loc_": [{}, {"location_raw": "Ulm"}],
        "soft_no_eng_": [{}, {"engine": None}],
        "soft_legacy_": [{}, {"transmission": "automatic", "power_hp": None}],
        "singleton_": [{}, {"price_eur": 900_000, "mileage_km": 90000}],
    }
    rows = [
        {**CAR, "price_eur": 45_200 + 10_000 * n, **change}
        for n, pair in enumerate(pairs.values()) for change in pair
    ]
    got = clusters(spark, rows)
    for n, prefix in enumerate(pairs):
        first, second = got[f"l{2 * n}"], got[f"l{2 * n + 1}"]
        assert first.startswith(prefix) and second.startswith(prefix), (prefix, first, second)
        assert (first == second) == (prefix != "singleton_")


def test_adoption_prefers_manual_and_specific_keys(spark):
    stored = [{**CAR, "id": "a", "cluster_id": "soft_full_old"},
              {**CAR, "id": "b", "price_eur": 45900, "cluster_id": "manual_m"},
              {"id": "c", "title": "Einzelstück", "cluster_id": "old_title"},
              {**CAR, "id": "d", "trim": "Z06", "cluster_id": None}]
    got = clusters(spark, [CAR, {"title": "einzelstück!", "engine": "LS9"}], stored)
    assert got == {"l0": "manual_m", "l1": "old_title"}


def test_hot_cluster(spark):
    rows = [dict(CAR) for _ in range(400)] + [{**CAR, "price_eur": 10_000 * i} for i in range(1, 5)]
    got = clusters(spark, rows)
    assert len({got[f"l{i}"] for i in range(400)}) == 1 and len(set(got.values())) == 5


TAKEN = ["engine", "vin", "eu_spec"]


def test_cross_fill_properties(spark):
    """What a filled cluster must look like, whatever the way it was filled."""
    rng = random.Random(8)
    options = {
        "price_eur": [None, 100, 200, 300], "mileage_km": [None, 50, 60, 70], "engine": [None, "", "LS2", "LS3"],
        "vin": [None, "A", "B"], "eu_spec": [None, True, False],
    }
    groups = [[{**{f: rng.choice(o) for f, o in options.items()}, "score": rng.randrange(3), "cluster_id": f"c{g}"}
               for _ in range(rng.randint(1, 5))] for g in range(250)]
    got = {r["pos"]: r for r in enrich_clusters(frame(spark, [r for g in groups for r in g])).collect()}
    at = 0
    for group in groups:
        after = [got[at + i] for i in range(len(group))]
        at += len(group)
        if len(group) == 1:
            assert all(after[0][f] == group[0][f] for f in options)
            continue
        assert {r["score"] for r in after} == {max(r["score"] for r in group)}
        for field in ("price_eur", "mileage_km"):
            assert {r[field] for r in after} == {min((r[field] for r in group if r[field] is not None), default=None)}
        for field in TAKEN:
            there = {r[field] for r in group} - {None, ""}
            for before, now in zip(group, after, strict=True):
                if before[field] not in (None, ""):
                    assert now[field] == before[field]
                elif there:
                    assert now[field] in there
                else:
                    assert now[field] == before[field]


def test_cross_fill_by_hand(spark):
    rows = [
        {"cluster_id": "a", "accident_status": "unbekannt", "exterior_color": "rot", "mileage_km": 0},
        {"cluster_id": "a", "accident_status": "unfallfrei", "exterior_color": "Rot metallic", "mileage_km": 70, "engine": "LS3"},
        {"cluster_id": "b", "exterior_color": "schwarz", "mileage_km": 60},
        {"cluster_id": "b", "exterior_color": "red", "mileage_km": 50, "vin": "X"},
    ]
    got = [r for _, r in sorted((r["pos"], r) for r in enrich_clusters(frame(spark, rows)).collect())]
    assert [r["accident_status"] for r in got[:2]] == ["unfallfrei"] * 2 and got[0]["engine"] == "LS3"
    assert [r["exterior_color"] for r in got[2:]] == ["schwarz", "red"]
    assert [(r["mileage_km"], r["vin"]) for r in got[2:]] == [(50, "X")] * 2


def test_lists_merge_in_order_of_first_sight(spark):
    rows = [{"cluster_id": "c", "risk_flags": ["b", "a"], "image_urls": ["1"]},
            {"cluster_id": "c", "risk_flags": ["a", "c"], "image_urls": ["2", "1"]},
            {"cluster_id": "solo", "risk_flags": ["x"]}, {"cluster_id": None, "risk_flags": ["y"]}]
    got = {r["id"]: (r["risk_flags"], r["image_urls"]) for r in
           enrich_clusters(frame(spark, rows)).collect()}
    assert got["l0"] == got["l1"] == (["b", "a", "c"], ["1", "2"])
    assert got["l2"] == (["x"], []) and got["l3"] == (["y"], [])


def test_order_of_input_does_not_matter(spark):
    rows = [{**CAR, "location_raw": f"Ort {i % 3}", "price_eur": 40000 + 300 * (i % 7)}
            for i in range(40)]
    df = frame(spark, rows)
    one = {r["id"]: r["cluster_id"] for r in assign_clusters(df).collect()}
    two = {r["id"]: r["cluster_id"] for r in assign_clusters(df.orderBy("price_eur")).collect()}
    assert one == two
