"""Checks of the extraction rules on ad texts made from the orders table.

The text is composed from an order's columns; the SQL side never reads the text but
computes the expected value from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adledger.functions import extract as x
from adledger.functions import identity
from adledger.functions.text import blank_to_null, squash
from adledger.operators.normalize import damage_columns, normalize_listings, power_columns
from adledger.plans.bindings import K, table
from adledger.plans.registry import Registry
from adledger.session import dealt, spread

registry = Registry()

P = "cast(floor(o_totalprice) as bigint)"
GROUPED = (
    f"concat(cast(cast(floor({P} / 1000) as bigint) as string), '.', "
    f"lpad(cast({P} % 1000 as string), 3, '0'))"
)
PLAIN = f"cast({P} as string)"
KM = f"({K} * 7919 % 600 * 1000 + 500)"
KM_GROUPED = f"concat(cast(cast(floor({KM} / 1000) as bigint) as string), '.500')"
MONTH = f"(1 + {K} % 12)"
YEAR = f"(2003 + cast(floor({K} / 7) as bigint) % 12)"


def texts(spark: SparkSession, sf_dir: str, text_sql: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders")).selectExpr(
        f"{K} AS order_id", f"{text_sql} AS t")


def modes(n: int, *branches: str) -> str:
    """SQL CASE over the order key modulo ``n``."""
    arms = " ".join(f"when {i} then {b}" for i, b in enumerate(branches[:-1]))
    return f"case {K} % {n} {arms} else {branches[-1]} end"


def rule(name: str, text_sql: str, expected: dict[str, str], build) -> None:
    """Register one rule: ``build(text column)`` gives the columns named in ``expected``."""
    columns = ", ".join(f"{e} AS {n}" for n, e in expected.items())

    @registry.add(name, f"SELECT {K} AS order_id, {columns} FROM orders")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        built: dict[str, Column] = build(F.col("t"))
        return texts(spark, sf_dir, text_sql).select(
            "order_id", *[built[n].alias(n) for n in expected]
        )


def s(text: str) -> str:
    return f"'{text}'"


IN_RANGE = f"case when {P} between 5000 and 500000 then cast({P} as int) end"
rule(
    "o_nrm_3",
    modes(6, f"concat('VB ', {GROUPED}, ' €')", f"concat('Preis ', {PLAIN}, ' fest')",
          f"concat('nur ', {PLAIN}, ' km gelaufen')",
          f"concat('km-Stand ', {PLAIN}, ' und Preis ', cast(10000 + {K} % 1000 as string), ' EUR')",
          f"concat('Baujahr 2008, ', {GROUPED}, 'VB')", "'kein Preis'"),
    {"price_eur": modes(6, IN_RANGE, IN_RANGE, "null", f"cast(10000 + {K} % 1000 as int)",
                        IN_RANGE, "null")},
    lambda t: {"price_eur": x.price_eur(t)},
)
rule(
    "o_nrm_4",
    modes(6, s("zu verschenken, VB"), s("Preis VB"), s("Verhandlungsbasis"),
          s("Preis auf Anfrage"), s("VBX nichts"), s("")),
    {"price_label": modes(6, s("zu verschenken"), s("VB"), s("VB"), s("auf Anfrage"), "null",
                          "null")},
    lambda t: {"price_label": x.price_label_lower(F.lower(t))},
)
rule(
    "o_nrm_6",
    modes(4, f"concat('Laufleistung ', {KM_GROUPED}, ' km')",
          f"concat('Stand: ', cast({KM} as string), 'km, Garage')",
          f"concat('2011 km, dann ', cast({KM} as string), ' km')", s("viele kmh")),
    {"mileage_km": modes(
        4, f"case when {KM} >= 1000 and {KM} <= 500000 then cast({KM} as int) "
           f"when {KM} < 1000 then 500 end",
        f"case when {KM} between 10000 and 500000 then cast({KM} as int) end",
        f"case when {KM} between 10000 and 500000 then cast({KM} as int) end", "null")},
    lambda t: {"mileage_km": x.mileage_km(t)},
)
HP = f"(200 + {K} % 1000)"
rule(
    "o_nrm_7",
    modes(3, f"concat('Leistung ', cast({HP} as string), ' PS')",
          f"concat('stark: ', cast({HP} as string), 'hp')", s("PS 437")),
    {"power_hp": modes(3, *[f"case when {HP} between 250 and 1000 then cast({HP} as int) end"] * 2,
                       "null")},
    lambda t: {"power_hp": x.power_hp(t)},
)
KW = f"(50 + {K} % 1100)"
rule(
    "o_nrm_8", f"concat('Motor mit ', cast({KW} as string), ' kW')",
    {"power_kw": f"case when {KW} between 100 and 999 then cast({KW} as int) end"},
    lambda t: {"power_kw": x.power_kw(t)},
)
YM = f"concat(cast({YEAR} as string), '-', lpad(cast({MONTH} as string), 2, '0'))"
rule(
    "o_nrm_9",
    modes(5, f"concat('EZ ', cast({MONTH} as string), '/', cast({YEAR} as string))",
          f"concat('HU ', cast({MONTH} as string), '/2012 EZ 04/2008')",
          f"concat('TÜV neu bis 05/2011, Erstzulassung ', cast({MONTH} as string), '.2009')",
          f"concat('gebaut ', cast({YEAR} as string))", s("Oldtimer von 05/1969")),
    {"first_registration": modes(
        5, f"case when {YEAR} between 2005 and 2013 then {YM} end",
        f"concat('2012-', lpad(cast({MONTH} as string), 2, '0'))",
        f"concat('2009-', lpad(cast({MONTH} as string), 2, '0'))",
        f"case when {YEAR} between 2005 and 2013 then concat(cast({YEAR} as string), '-01') end",
        "null")},
    lambda t: {"first_registration": x.first_registration(t)},
)
rule(
    "o_nrm_10",
    modes(4, f"concat('HU bis ', cast({MONTH} as string), '/', cast(2020 + {K} % 8 as string))",
          f"concat('TÜV', cast({MONTH} as string), '.', cast(2020 + {K} % 8 as string))",
          s("EZ 04/2008"), f"concat('tuv bis: ', cast({MONTH} as string), '/2024')"),
    {"tuv_until": modes(
        4, *[f"concat(cast(2020 + {K} % 8 as string), '-', lpad(cast({MONTH} as string), 2, '0'))"]
        * 2, "null", "null")},
    lambda t: {"tuv_until": x.tuv_until(t)},
)
rule(
    "o_nrm_11",
    modes(10, s("LS2 gegen LS9 getauscht"), s("ls7 Motor, 6.2 L"), s("7,0 V8 Sauger"),
          s("ZR1 Coupe"), s("ZR1 Cabrio 6.2 l"), s("ZR1 Felgen, 6,0 V 8"), s("6.2L"),
          s("6.0 Liter"), s("17.0 l Tank"), s("V8")),
    {"engine": modes(10, s("LS9"), s("LS7"), s("LS7"), s("LS9"), s("LS3"), s("LS2"), s("LS3"),
                     s("LS2"), "null", "null")},
    lambda t: {"engine": x.engine_upper(F.upper(t))},
)
HP12 = f"(385 + {K} % 290)"
BAND = (
    f"case when {HP12} between 395 and 410 then 'LS2' when {HP12} between 425 and 445 then 'LS3' "
    f"when {HP12} between 500 and 520 then 'LS7' when {HP12} between 630 and 660 then 'LS9' end"
)
rule(
    "o_nrm_12", f"concat(case {K} % 5 when 0 then 'LS3 ' else '' end, cast({HP12} as string), ' PS')",
    {"probable_engine": f"case when {K} % 5 <> 0 then {BAND} end",
     "engine_confidence":
        f"cast(case when {K} % 5 = 0 then 1.0 when {HP12} between 395 and 410 then 0.86 "
        f"when {HP12} between 425 and 445 then 0.86 when {HP12} between 500 and 520 then 0.9 "
        f"when {HP12} between 630 and 660 then 0.92 end as double)"},
    lambda t: {
        "probable_engine": F.when(
            x.engine_upper(F.upper(t)).isNull(), x.probable_engine(x.power_hp(t))),
        "engine_confidence": F.when(
            x.engine_upper(F.upper(t)).isNotNull(), F.lit(1.0)
        ).otherwise(x.probable_engine_confidence(x.power_hp(t))),
    },
)
STOCK = ("case {} when 'LS2' then 404 when 'LS3' then 437 when 'LS7' then 512 "
         "when 'LS9' then 647 end")
E13 = f"case {K} % 6 when 0 then 'LS2' when 1 then 'LS3' when 2 then 'LS7' when 3 then 'LS9' end"
PE13 = f"case when {K} % 6 > 3 and {K} % 2 = 0 then 'LS3' end"
HP13 = f"case when {K} % 6 > 3 and {K} % 2 = 0 then 430 when {K} % 4 = 1 then 500 end"
SHOWN = f"coalesce({E13}, {PE13})"


@registry.add("o_nrm_13", f"""
SELECT {K} AS order_id,
  CASE WHEN {HP13} IS NULL THEN {STOCK.format(SHOWN)} END AS estimated_power_hp,
  CASE WHEN {HP13} IS NULL AND {SHOWN} IS NOT NULL THEN concat('Motor ', {SHOWN},
    ' → Leistung ca. ', cast({STOCK.format(SHOWN)} AS string), ' PS geschätzt') END AS power_note,
  CASE WHEN {E13} IS NOT NULL THEN 'Motorcode explizit im Inserat erkannt'
       WHEN {PE13} IS NOT NULL THEN concat('Leistung ', cast({HP13} AS string),
         ' PS → wahrscheinlich ', {PE13}) END AS engine_note
FROM orders""")
def power_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr(
        f"{K} AS order_id", f"{E13} AS engine", f"{PE13} AS probable_engine", f"{HP13} AS power_hp"
    ).withColumns(power_columns())
    return df.select("order_id", "estimated_power_hp", "power_note", "engine_note")


TITLE14 = modes(6, s("Corvette ZR1"), s("Corvette ZO6 Targa"), s("Corvette Grand-Sport"),
                s("Corvette C6"), s("Traumwagen"), s("Chevrolet V8"))
TEXT14 = modes(4, s("Z06 Optik"), s("427 Edition"), s("Corvette"), s("nichts"))
SPECIFIC14 = modes(4, s("Z06"), s("Special Edition"), s("Base"), "null")


@registry.add("o_nrm_14", f"""
SELECT {K} AS order_id, {modes(6, s("ZR1"), s("Z06"), s("Grand Sport"), s("Base"),
                              SPECIFIC14, SPECIFIC14)} AS trim FROM orders""")
def trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr(
        f"{K} AS order_id", f"{TITLE14} AS a", f"concat({TITLE14}, ' ', {TEXT14}) AS b")
    return df.select("order_id", x.trim_upper(F.upper("a"), F.upper("b")).alias("trim"))


rule(
    "o_nrm_15",
    modes(7, s("6-Gang Schalter, Automatik"), s("Getriebe: manuell"), s("Manuelles Getriebe"),
          s("Automatikgetriebe"), s("6L80 A6"), s("Aut. Getriebe"), s("Tiptronic")),
    {"transmission": modes(7, s("manual"), s("manual"), "null", s("automatic"),
                           s("automatic"), s("automatic"), "null")},
    lambda t: {"transmission": x.transmission_lower(F.lower(t))},
)
BODY_T = modes(5, s("Roadster"), s("T-Top"), s("Coupé"), s("Wagen"), s("Cabrio Targa"))
BODY_D = modes(3, s("mit hardtop"), s("als Convertible"), s("ohne Angabe"))
BODY_DX = modes(3, s("Targa"), s("Cabrio"), "null")


@registry.add("o_nrm_16", f"""
SELECT {K} AS order_id, {modes(5, s("Cabrio"), s("Targa"), s("Coupé"), BODY_DX, s("Cabrio"))}
  AS body_style FROM orders""")
def body_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr(
        f"{K} AS order_id", f"lower({BODY_T}) AS a", f"lower(concat({BODY_T}, ' ', {BODY_D})) AS b")
    return df.select("order_id", F.coalesce(
        x.body_style_lower(F.col("a")), x.body_style_lower(F.col("b"))).alias("body_style"))


rule(
    "o_nrm_17",
    modes(3, f"concat('MJ: ', cast({YEAR} as string))",
          f"concat('Baujahr ', cast({YEAR} as string))", f"concat('Jahr ', cast({YEAR} as string))"),
    {"model_year": modes(3, *[f"case when {YEAR} between 2004 and 2014 then cast({YEAR} as int) end"]
                         * 2, "null")},
    lambda t: {"model_year": x.model_year(t)},
)
rule(
    "o_nrm_18",
    modes(6, s("6,2 Kompressor"), s("6.0 Liter"), s("7.0l"), s("6,2 L"), s("6.4 l, 7.0 l"),
          s("16.2 Liter")),
    {"displacement_cc": modes(6, "6162", "5967", "7008", "6162", "null", "null")},
    lambda t: {"displacement_cc": x.displacement_cc_lower(F.lower(t))},
)
rule(
    "o_nrm_19", modes(4, s("Heckantrieb und Allrad"), s("RWD"), s("4WD"), s("Frontantrieb")),
    {"drivetrain": modes(4, s("Heckantrieb"), s("Heckantrieb"), s("Allrad"), "null")},
    lambda t: {"drivetrain": x.drivetrain_lower(F.lower(t))},
)
rule(
    "o_nrm_20",
    modes(6, s("Fahrzeugzustand: Gebrauchtfahrzeug; top"), s("Zustand: sehr gut, gepflegt"),
          s("Zustand: Note 2"), s("Zustand unfallfrei"), s("Fahrzeugzustand: x, Zustand: wie neu"),
          s("ohne Angabe")),
    {"condition": modes(6, s("Gebrauchtfahrzeug"), s("Sehr gut"), "null", "null",
                        "null", "null")},
    lambda t: {"condition": x.condition_lower(F.lower(t))},
)
N21 = f"({K} % 25)"
rule(
    "o_nrm_21",
    modes(4, f"concat('Anzahl Vorbesitzer: ', cast({N21} as string), ', 1. Hand')",
          f"concat('Vorbesitzer ', cast({N21} as string))", f"concat(cast({N21} as string), '. Hand')",
          s("aus erster Hand")),
    {"owners_count": modes(4, *[f"case when {N21} between 1 and 20 then cast({N21} as int) end"] * 3,
                           "null")},
    lambda t: {"owners_count": x.owners_count_lower(F.lower(t))},
)
rule(
    "o_nrm_22",
    f"concat({modes(3, s('Ohne Scheckheft'), s('Scheckheftgepflegt'), s('gepflegt'))}, "
                f"' / ', {modes(4, s('keine Garantie'), s('Werksgarantie'), s('ohne'), s('-'))})",
    {"service_history": modes(3, "false", "true", "null"),
     "warranty": modes(4, "false", "true", "null", "null")},
    lambda t: {"service_history": x.service_history_lower(F.lower(t)),
               "warranty": x.warranty_lower(F.lower(t))},
)
OPTIONS = {
    "magnetic_ride": (s("Magnetic Ride"), s("Fahrwerk")),
    "active_exhaust": (s("Klappenauspuff"), s("Auspuff")),
    "head_up_display": (s("HUD"), s("Uhr")),
    "navigation": (s("Navi"), s("Karte")),
    "bose_audio": (s("Bose Sound"), s("Radio")),
    "leather_interior": (s("Ledersitze"), s("Lederlenkrad")),
    "heated_seats": (s("Sitzheizung"), s("Sitze")),
}
BLOCKERS = f"case {K} % 5 when 1 then ' Hudson Bosch' else '' end"
OPTION_TEXT = "concat(" + ", ' ', ".join(
    f"case {K} % {m} when 0 then {yes} else {no} end"
    for m, (yes, no) in zip((2, 3, 4, 5, 6, 7, 8), OPTIONS.values())
) + f", {BLOCKERS})"
rule(
    "o_nrm_23", OPTION_TEXT,
    {name: (f"case when {K} % {m} = 0"
            + (f" and {K} % 5 <> 1" if name in ("head_up_display", "bose_audio") else "")
            + " then true end")
     for m, name in zip((2, 3, 4, 5, 6, 7, 8), OPTIONS)},
    lambda t: x.equipment_lower(F.lower(t)),
)
VIN_OK = f"concat('1g1yy26e', lpad(cast({K} % 9 + 1 as string), 9, '5'))"
rule(
    "o_nrm_24",
    modes(3, f"concat('FIN: ', {VIN_OK}, '.')", f"concat('x', {VIN_OK})",
          s("VIN 1G1YY26E075100001")),
    {"vin": modes(3, f"upper({VIN_OK})", "null", "null"),
     "vin_with_zero": modes(3, f"upper({VIN_OK})", "null", s("1G1YY26E075100001"))},
    lambda t: {"vin": x.vin(t), "vin_with_zero": x.vin(t, allow_zero=True)},
)
rule(
    "o_nrm_25",
    modes(4, s("nicht unfallfrei"), s("unfallfrei, Scheckheft"), s("Unfallwagen, sonst unfallfrei"),
          s("Garage")),
    {"accident_status": modes(4, s("unfall"), s("unfallfrei"), s("unfall"), s("unbekannt"))},
    lambda t: {"accident_status": x.accident_status_lower(F.lower(t))},
)
RISK = [("accident_reported", s("Unfallwagen")), ("damage_reported", s("Frontschaden")),
        ("no_tuv", s("ohne TÜV")), ("salvage_import_possible", s("US Import")),
        ("mileage_unclear", s("Meilen")), ("modified_heavily", s("Rennstrecke")),
        ("sold_or_reserved", s("reserviert"))]
RISK_ON = [f"({K} % {m} = 0)" for m in (2, 3, 4, 5, 6, 7, 8)]
RISK_TEXT = "concat_ws(', ', 'Auto', " + ", ".join(
    f"case when {on} then {word} end" for on, (_, word) in zip(RISK_ON, RISK)) + ")"
RISK_SQL = "concat_ws('|', " + ", ".join(
    f"case when {on} then '{flag}' end" for on, (flag, _) in zip(RISK_ON, RISK)) + ")"
rule(
    "o_nrm_26", RISK_TEXT, {"risk_flags": RISK_SQL},
    lambda t: {"risk_flags": F.array_join(x.risk_flags_lower(F.lower(t)), "|")},
)
rule(
    "o_nrm_27",
    f"concat({RISK_TEXT}, case {K} % 11 when 1 then ', unfallfrei' else '' end)",
    {"damage": f"case when {RISK_ON[1]} then case when {RISK_ON[0]} then "
               f"'accident_reported; damage_reported' else 'damage_reported' end end",
     "has_damage": f"case when {RISK_ON[1]} then true "
                   f"when {K} % 11 = 1 and not {RISK_ON[0]} then false end",
     "origin_country": f"case when {RISK_ON[3]} then 'US' end",
     "origin_confidence": f"cast(case when {RISK_ON[3]} then 0.7 end as double)"},
    lambda t: damage_columns(
        x.risk_flags_lower(F.lower(t)), x.accident_status_lower(F.lower(t)), F.lower(t)),
)
rule(
    "o_flt_2",
    modes(10, s("Suche Corvette C6"), s("Corvette C 6"), s("Corvette LS3"), s("Corvette 2008"),
          s("Corvette Z06"), s("Corvette C7 2014"), s("Corvette C6 mit LT1"), s("Porsche 2008"),
          s("C6 Targa"), s("Corvette 2004")),
    {"candidate": modes(10, "false", "true", "true", "true", "false", "false", "false", "false",
                        "true", "false")},
    lambda t: {"candidate": x.is_candidate(t, F.lit(""))},
)

PRICE5 = modes(4, s("VB"), f"concat({GROUPED}, ' € VB')", s(""), s("Preis fehlt"))
TEXT5 = modes(3, f"concat('Corvette C6 fuer ', {GROUPED}, ' €')", s("Corvette C6 Verhandlungsbasis"),
              s("Corvette C6"))
P5 = modes(3, IN_RANGE, "null", "null")


@registry.add("o_nrm_5", f"""
SELECT {K} AS order_id,
  {modes(4, "null", IN_RANGE, P5, P5)} AS price_eur,
  {modes(4, s("VB"), s("VB"), *[f"case when {P5} is null then {modes(3, 'null', s('VB'), 'null')} end"]
         * 2)} AS price_label
FROM orders""")
def price_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = dealt(table(spark, sf_dir, "orders")).selectExpr(
        f"{K} AS pos", "'AutoUncle' AS source", f"cast({K} as string) AS source_listing_id",
        f"concat('https://x.example/', cast({K} as string)) AS url", f"{TEXT5} AS title",
        "'' AS description", f"{PRICE5} AS price_text", "cast(null as string) AS location_raw",
        "cast(null as array<string>) AS image_urls",
    )
    return normalize_listings(cards, keep=("pos",)).select(
        F.col("pos").alias("order_id"), "price_eur", "price_label")


AD_TITLE = modes(3, s("Corvette C6 Z06"), s("Corvette  C6 Cabrio"), s("Porsche 911 2008"))
AD_TEXT = (
    f"concat('Erstzulassung ', cast({MONTH} as string), '/2007, ', cast(20000 + {K} % 90000 as string), "
    f"' km, 404 PS, ', case {K} % 2 when 0 then 'Automatik' else 'Handschaltung' end)"
)


@registry.add("o_nrm_31", f"""
SELECT {K} AS order_id, concat('autouncle_', left(sha1(cast({K} AS string)), 10)) AS id,
  case {K} % 3 when 0 then 'Chevrolet Corvette C6 Z06' else 'Chevrolet Corvette C6 Cabrio' end AS model,
  case {K} % 3 when 0 then 'Corvette C6 Z06' else 'Corvette C6 Cabrio' end AS title,
  case {K} % 3 when 0 then 'Coupé' else 'Cabrio' end AS body_style,
  case when {K} % 3 = 0 or {K} % 2 = 1 then 'manual' else 'automatic' end AS transmission,
  cast(20000 + {K} % 90000 as int) AS mileage_km, 404 AS power_hp, 'LS2' AS probable_engine,
  concat('2007-', lpad(cast({MONTH} AS string), 2, '0')) AS first_registration,
  concat_ws('|', 'price_missing',
    case when {K} % 3 = 0 then 'engine_trim_mismatch' end, 'price_fully_missing') AS codes
FROM orders WHERE {K} % 3 < 2""")
def whole_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in one projection; ads for other cars are dropped, none fails the run."""
    cards = dealt(table(spark, sf_dir, "orders")).selectExpr(
        f"{K} AS pos", "'AutoUncle' AS source", f"cast({K} as string) AS source_listing_id",
        f"concat('https://x.example/', cast({K} as string)) AS url", f"{AD_TITLE} AS title",
        f"{AD_TEXT} AS description", "'' AS price_text", "cast(null as string) AS location_raw",
        "cast(null as array<string>) AS image_urls",
    )
    return normalize_listings(cards, keep=("pos",)).select(
        F.col("pos").alias("order_id"), "id", "model", "title", "body_style", "transmission",
        "mileage_km", "power_hp", "probable_engine", "first_registration",
        F.array_join(F.transform("validation_flags", lambda f: f["code"]), "|").alias("codes"))


@registry.add("o_nrm_1", """
SELECT page_id, rtrim(
  split_part(split_part(concat(lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)),
    regexp_extract(url, '^https?://[^/?#]*(.*)$', 1)), '#', 1), '?', 1), '/') AS canonical
FROM pages""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", identity.canonical_url(F.col("url")).alias("canonical"))


@registry.add("o_nrm_2", """
SELECT page_id, concat('classic_trader_', left(sha1(case when page_id % 2 = 0
  then cast(page_id as string) else rtrim(split_part(split_part(url, '#', 1), '?', 1), '/') end), 10))
  AS id FROM pages""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select(
        "page_id", identity.stable_id(F.lit("Classic Trader"), own, F.col("url")).alias("id"))


@registry.add("o_nrm_30", r"""
SELECT doc_id, nullif(trim(regexp_replace(text, '[\s\x{00A0}\x{0085}\x{000B}\x{2028}\x{2029}\x{2000}-\x{200A}\x{3000}\x{202F}\x{205F}\x{1680}]+', ' ', 'g')), '')
  AS clean FROM documents""")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", blank_to_null(squash(F.col("text"))).alias("clean"))
