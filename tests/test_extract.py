"""Extraction rules: hits, misses and priority conflicts; price scan against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from adledger.functions import extract as x
from adledger.functions.text import scan, squash


def run(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", build(F.col("t"))).orderBy("i").collect()]


LOWER = lambda rule: lambda t: rule(F.lower(t))
UPPER = lambda rule: lambda t: rule(F.upper(t))

CASES = [
    ("price", x.price_eur, [
        ("Festpreis 48.700 €", 48700), ("48 700 EUR, 61.000 km", 48700), ("61.000 km für 39500", None),
        ("39500 bei 61000 km", None), ("04.2011 und 4999 €", None), ("990.000 €", None),
        ("€ 52000", 52000), ("51000 oder 50.000 VB", 50000), ("", None), ("a1234567b", None),
        (" 55 300 €", 55300),
    ]),
    ("label", LOWER(x.price_label_lower), [
        ("Auto zu VERSCHENKEN vb", "zu verschenken"), ("45.000 € VB", "VB"), ("Vbasis", None),
        ("Verhandlungsbasis", "VB"), ("Preis auf Anfrage", "auf Anfrage"),
    ]),
    ("mileage", x.mileage_km, [
        ("81.250 km", 81250), ("2009 km", None), ("600.000 km danach 50.000 km", None),
        ("12345kmh", None), ("72 000 km", 72000),
    ]),
    ("registration", x.first_registration, [
        ("EZ 11/2006", "2006-11"), ("EZ 3.2012, HU 5/2026", "2012-03"), ("Bj 2007", "2007-01"),
        ("HU neu 06/2009, EZ 01/2010", "2009-01"), ("HU neu 06/2009, Erstzulassung wohl 1/2010", "2010-01"), ("EZ 05/2004", None), ("2014", None),
    ]),
    ("inspection", x.tuv_until, [
        ("TÜV bis 9/2027", "2027-09"), ("hu12.2026", "2026-12"), ("TÜV neu", None),
    ]),
    ("engine", UPPER(x.engine_upper), [
        ("ls3 mit ls7 Köpfen", "LS7"), ("7.0 l", "LS7"), ("zr1", "LS9"), ("ZR1 Spoiler 6,2L", "LS3"),
        ("ZR1 Convertible", None), ("hubraum 6.0", "LS2"), ("16.2 L", None),
    ]),
    ("gearbox", LOWER(x.transmission_lower), [
        ("Automatik mit manual mode", "manual"), ("Getriebe manuell", "manual"),
        ("aut. Getriebe", "automatic"), ("CVT", None),
    ]),
    ("body", LOWER(x.body_style_lower), [
        ("Targa Cabrio", "Cabrio"), ("Hardtop Coupe", "Targa"), ("Coupé", "Coupé"), ("Kombi", None),
    ]),
    ("cc", LOWER(x.displacement_cc_lower), [
        ("6.2 SC", 6162), ("7,0 Liter", 7008), ("6.1 l, 6.0 l", None), ("6.0l", 5967),
    ]),
    ("owners", LOWER(x.owners_count_lower), [
        ("Anzahl Vorbesitzer: 3", 3), ("Vorbesitzer 40, 2. Hand", None), ("2 Hand", 2), ("Hand", None),
    ]),
    ("condition", LOWER(x.condition_lower), [
        ("Fahrzeugzustand: gebraucht; EZ", "Gebraucht"), ("Zustand: sehr gut", "Sehr gut"),
        ("Zustand: Unfall repariert", None), ("Zustand 1-", None),
    ]),
    ("vin", x.vin, [
        ("1g1yy25w185123456", "1G1YY25W185123456"), ("1G1YY26E075100001", None),
        ("X1G1YY25W185123456", None), ("IG1YY25W185123456", None),
    ]),
    ("accident", LOWER(x.accident_status_lower), [
        ("nicht unfallfrei", "unfall"), ("Unfallfrei!", "unfallfrei"), ("Garage", "unbekannt"),
    ]),
]


@pytest.mark.parametrize("name,rule,cases", CASES, ids=[c[0] for c in CASES])
def test_rule(spark, name, rule, cases):
    assert run(spark, [t for t, _ in cases], rule) == [e for _, e in cases]


def test_risk_flags_keep_rule_order(spark):
    got = run(spark, ["verkauft, Motorschaden, nicht unfallfrei", "top"],
              LOWER(x.risk_flags_lower))
    assert got == [["accident_reported", "damage_reported", "sold_or_reserved"], []]


def test_equipment_is_true_or_unknown(spark):
    df = spark.createDataFrame([("Bose, Lederlenkrad, HUD",), ("Bose und Bosch, Hudson HUD",),
                                ("Lederlenkrad und Ledersitze",)], "t string")
    rows = df.select(*[c.alias(n) for n, c in x.equipment_lower(F.lower("t")).items()]).collect()
    assert [r["bose_audio"] for r in rows] == [True, None, None]
    assert [r["head_up_display"] for r in rows] == [True, None, None]
    assert [r["leather_interior"] for r in rows] == [None, None, True]


def test_candidate(spark):
    titles = ["Suche Corvette C6", "Corvette Z06", "Corvette ls2", "C 6 Targa", "Corvette C8 C6",
              "Corvette 2013", "Corvette 2014", "Porsche LS3"]
    got = run(spark, titles, lambda t: x.is_candidate(t, F.lit("")))
    assert got == [False, False, True, True, False, True, False, False]


MARKED = {"12.500 €": 12500, "7500 EUR": 7500, "123 456 VB": 123456, "5000€": 5000}
BARE = {"9.900": 9900, "41500": 41500, "500.000": 500000}
NEITHER = ["80.000 km", "km 7500", "99 €", "08.2011", "1.234.567 €", "4.999 €", "500.001", "abc"]


def test_price_by_construction(spark):
    """Offers between long words: the first marked price counts, else the first bare one."""
    rng = random.Random(7)
    texts, want = [], []
    for _ in range(600):
        offers = rng.choices([*MARKED, *BARE, *NEITHER], k=rng.randrange(6))
        marked = [MARKED[o] for o in offers if o in MARKED]
        bare = [BARE[o] for o in offers if o in BARE]
        texts.append(" ".join(f"{'wort' * 8} {o} {'wort' * 8}" for o in offers))
        want.append((marked or bare or [None])[0])
    assert run(spark, texts, x.price_eur) == want


def test_scan_contexts_span_neighbouring_matches(spark):
    df = spark.createDataFrame([("aa 1111 bb 2222 cc",)], "t string")
    got = df.select(scan(F.col("t"), r"(\d{4})", groups=1, left=9, right=9, shortest=4)).first()[0]
    assert [(m["g1"], m["left"], m["right"]) for m in got] == [
        ("1111", "aa ", " bb 2222 "), ("2222", " 1111 bb ", " cc")]


def test_squash_handles_unicode_spaces(spark):
    assert run(spark, ["  a \n b "], squash) == ["a b"]
