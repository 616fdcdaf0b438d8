"""Listing-shaped inputs derived from the given tables.

The tables hold no vehicle ads, so each check projects one deterministic
listing-shaped view. The expressions are plain SQL and serve both engines: they
shape the input only, never the result of an operator. ``k`` below is the order key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adledger.session import spread

K = "o_orderkey"

# Q: one listing per order
LISTINGS = {
    "pos": f"{K}",
    "id": f"concat('q_', cast({K} as string))",
    "source": f"case {K} % 5 when 0 then 'AutoScout24' when 1 then 'Kleinanzeigen' "
              f"when 2 then 'AutoUncle' when 3 then 'Classic Trader' else 'mobile.de' end",
    "source_listing_id": f"case {K} % 4 when 0 then concat('ka-', cast({K} % 9 as string)) "
                         f"else cast({K} as string) end",
    "url": f"concat('https://www.ads.example/offer/', cast({K} as string))",
    "title": f"concat('Corvette C6 ', o_orderpriority)",
    "price_eur": f"case when {K} % 17 = 0 then null else cast(floor(o_totalprice) as int) end",
    "price_label": f"case {K} % 6 when 1 then 'VB' when 3 then 'auf Anfrage' end",
    "mileage_km": f"case when {K} % 13 = 0 then null "
                  f"else cast(({K} * 7919 % 200) * 1000 as int) end",
    "engine": f"case {K} % 6 when 0 then 'LS2' when 1 then 'LS3' when 2 then 'LS7' "
              f"when 3 then 'LS9' end",
    "probable_engine": f"case {K} % 12 when 4 then 'LS3' when 10 then 'LS7' end",
    "engine_confidence": f"cast(case when {K} % 6 < 4 then 1.0 when {K} % 12 = 4 then 0.86 "
                         f"when {K} % 12 = 10 then 0.9 end as double)",
    "engine_note": f"case when {K} % 6 < 4 then 'explicit' when {K} % 6 = 4 then 'inferred' end",
    "power_hp": f"case when {K} % 11 = 0 then null else cast(380 + {K} * 31 % 300 as int) end",
    "estimated_power_hp": f"case when {K} % 22 = 0 then 437 end",
    "power_note": f"case when {K} % 22 = 0 then 'estimated' end",
    "trim": f"case {K} % 7 when 0 then 'Base' when 1 then 'Grand Sport' when 2 then 'Z06' "
            f"when 3 then 'ZR1' when 4 then 'Special Edition' when 5 then 'Base' end",
    "transmission": f"case {K} % 8 when 0 then 'automatic' when 1 then 'manual' "
                    f"when 2 then 'unknown' when 3 then 'automatic' when 5 then 'manual' end",
    "body_style": f"case {K} % 9 when 0 then 'Cabrio' when 1 then 'Coupé' when 2 then 'Targa' "
                  f"when 4 then 'Coupé' when 5 then 'Cabrio' when 7 then 'Targa' end",
    "exterior_color": f"case {K} % 10 when 0 then 'schwarz' when 1 then 'black' when 2 then 'Rot' "
                      f"when 4 then 'Blau' when 5 then 'blue' when 7 then 'grau' when 8 then '' end",
    "interior_color": f"case {K} % 6 when 0 then 'beige' when 2 then 'black' when 3 then 'schwarz' end",
    "first_registration": f"case when {K} % 19 = 0 then null else concat("
                          f"cast(year(o_orderdate) + 8 as string), '-', "
                          f"lpad(cast(month(o_orderdate) as string), 2, '0')) end",
    "tuv_until": f"case when {K} % 5 = 2 then null else concat("
                 f"cast(2023 + {K} % 4 as string), '-', "
                 f"lpad(cast(1 + {K} % 12 as string), 2, '0')) end",
    "model_year": f"case when {K} % 3 = 0 then null else cast(2004 + {K} % 11 as int) end",
    "accident_status": f"case {K} % 4 when 0 then 'unfallfrei' when 1 then 'unfall' "
                       f"else 'unbekannt' end",
    "has_damage": f"case {K} % 6 when 0 then true when 1 then false end",
    "eu_spec": f"case {K} % 3 when 0 then true when 1 then false end",
    "location_raw": f"case when {K} % 23 = 0 then null "
                    f"else concat('Stadt ', cast(o_custkey % 25 as string)) end",
    "description_text": f"case when {K} % 4 = 3 then null else concat('Status ', o_orderstatus) end",
    "vin": f"case when {K} % 30 = 7 then concat('VIN', cast({K} as string)) end",
    "damage": f"case when {K} % 6 = 0 then 'damage_reported' end",
    "hidden": f"({K} % 29 = 0)",
    "score": f"cast({K} * 37 % 101 as int)",
    "change_type": "case o_orderpriority when '1-URGENT' then 'new' when '2-HIGH' then "
                   "'price_change' when '3-MEDIUM' then 'metadata_change' else 'unchanged' end",
    "cluster_id": f"case when {K} % 8 >= 6 then null "
                  f"else concat('c_', cast(cast(floor({K} / 8) as bigint) as string)) end",
    "status": "case o_orderstatus when 'O' then 'online' when 'F' then 'offline' end",
    "created_at": "o_orderdate",
    "risk_txt": f"case {K} % 7 when 1 then 'accident_reported' when 2 then 'damage_reported;no_tuv' "
                f"when 3 then 'mileage_unclear' when 5 then 'sold_or_reserved;modified_heavily' "
                f"else '' end",
    "image_txt": f"case {K} % 3 when 0 then '' when 1 then concat('img', cast({K} % 50 as string)) "
                 f"else concat('img', cast({K} % 50 as string), ';img', cast({K} % 7 as string)) end",
    "equip_txt": f"case {K} % 4 when 0 then 'Bose;Navi' when 2 then 'Navi' else '' end",
    "note_txt": f"case {K} % 9 when 4 then 'LS7 → Z06' else '' end",
}
_LISTS = {"risk_flags": "risk_txt", "image_urls": "image_txt", "equipment": "equip_txt",
          "inference_notes": "note_txt", "visual_flags": None, "conflict_flags": None}

# Q3: pairs of listings of one vehicle, perturbed so that every cascade level fires
G = f"cast(floor({K} / 2) as bigint)"
ODD = f"({K} % 2)"
MODE = f"({G} % 8)"
PAIRS = {
    "pos": K,
    "id": f"concat('p_', cast({K} as string))",
    "url": f"concat('https://www.ads.example/pair/', cast({K} as string))",
    "title": f"concat('Corvette ', cast({G} as string))",
    "source": f"case {ODD} when 0 then 'AutoScout24' else 'Kleinanzeigen' end",
    "source_listing_id": f"cast({K} as string)",
    "price_eur": f"cast(10000 + 1000 * {G} + 100 * {ODD} "
                 f"+ case when {MODE} = 6 and {ODD} = 1 then 40000000 else 0 end as int)",
    "mileage_km": f"cast(({G} * 7919 % 40) * 5000 + 1000 * {ODD} as int)",
    "power_hp": f"cast(400 + {G} % 4 * 50 as int)",
    "engine": f"case when {MODE} = 4 and {ODD} = 1 then null else "
              f"case {G} % 3 when 0 then 'LS2' when 1 then 'LS3' else 'LS7' end end",
    "trim": f"case when {MODE} = 2 and {ODD} = 1 then 'Grand Sport' "
            f"else case {G} % 2 when 0 then 'C6 Z06' else 'Base' end end",
    "location_raw": f"case when {MODE} = 3 and {ODD} = 1 then 'anderswo' "
                    f"else concat('Stadt ', cast({G} % 25 as string)) end",
    "transmission": f"case when {MODE} = 5 and {ODD} = 1 then 'automatic' else 'manual' end",
    "body_style": f"case {G} % 3 when 0 then 'Coupé' when 1 then 'Targa' end",
    "exterior_color": f"case {ODD} when 0 then 'schwarz' else 'Black' end",
    "first_registration": f"concat(cast(2005 + {G} % 9 as string), '-0', cast(1 + {ODD} as string))",
    "vin": f"case when {MODE} = 0 then concat('V', lpad(cast({G} as string), 16, '0')) end",
}

# E: snapshots and availability checks, one per event
EVENTS = {
    "listing_id": "concat('u_', cast(user_id as string))",
    "captured_at": "ts",
    "id": "event_id",
    "price_eur": "case when event_id % 6 = 5 then null else cast(floor(value) as int) end",
    "mileage_km": "cast(event_id % 40 * 1000 as int)",
    "change_type": "case event_type when 'purchase' then 'price_change' when 'error' then "
                   "'metadata_change' when 'signup' then 'new' else 'unchanged' end",
    "is_online": "(event_type <> 'error')",
    "http_status": "case event_type when 'error' then "
                   "case when event_id % 3 = 0 then null else 404 end else 200 end",
}


def sql(columns: dict[str, str], table: str, names: list[str] | None = None) -> str:
    """The binding as a query text for the checking engine."""
    picked = columns if names is None else {n: columns[n] for n in names}
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in picked.items()) + f" FROM {table}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def with_lists(df: DataFrame) -> DataFrame:
    """Turn the ';'-joined text columns into the listing's array columns."""
    empty = F.array().cast("array<string>")
    arrays = {
        name: F.when(F.col(text) == "", empty).otherwise(F.split(text, ";")) if text else empty
        for name, text in _LISTS.items()
    }
    return df.withColumns(arrays).drop(*[t for t in _LISTS.values() if t])


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_lists(project(spread(table(spark, sf_dir, "orders")), LISTINGS))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with a price that grows with the order key, wide enough for any of them."""
    wide = PAIRS | {"price_eur": re.sub(r"as int\)$", "as bigint)", PAIRS["price_eur"])}
    return project(spread(table(spark, sf_dir, "orders")), wide)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "events"), EVENTS)


def instant(column: str) -> Column:
    """A timestamp as text with microseconds, the same in both engines."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


INSTANT_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
