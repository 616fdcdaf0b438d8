"""Checks of filters, scores, orders, reports and validation on the listing view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adledger.functions import display as d
from adledger.operators import filters, report, scoring, validation
from adledger.operators.clusters import best_members, filled_count
from adledger.operators.normalize import infer, model_name
from adledger.operators.state import with_created_at
from adledger.plans.bindings import LISTINGS, listings, sql, table
from adledger.plans.interactive import query_listings
from adledger.plans.registry import Registry
from adledger.schema import conform

registry = Registry()
Q = f"WITH q AS ({sql(LISTINGS, 'orders')}) "


# --- filters ----------------------------------------------------------------

def filter_check(name: str, params: dict[str, str], where: str) -> None:
    @registry.add(name, f"{Q} SELECT id, source, price_eur, score FROM q WHERE {where}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.filter_listings(listings(spark, sf_dir), params).select(
            "id", "source", "price_eur", "score")


filter_check(
    "o_flt_1",
    {"source": " AutoUncle ", "price_min": "20000", "price_max": "abc", "colour": "red",
     "trim": "", "risk_free": "maybe"},
    "source = 'AutoUncle' AND price_eur >= 20000",
)
filter_check(
    "o_flt_1a",
    {"source": "Kleinanzeigen", "transmission": "manual", "change_type": "unchanged"},
    "source = 'Kleinanzeigen' AND transmission = 'manual' AND change_type = 'unchanged'",
)
filter_check("o_flt_1b", {"engine": "ls3"}, "engine = 'LS3' OR probable_engine = 'LS3'")
filter_check(
    "o_flt_1c",
    {"price_min": "50000", "price_max": "250000", "mileage_min": "10000",
     "mileage_max": "120000", "score_min": "40"},
    "price_eur BETWEEN 50000 AND 250000 AND mileage_km BETWEEN 10000 AND 120000 AND score >= 40",
)
filter_check("o_flt_1d", {"risk_free": "1"}, "risk_txt = ''")
filter_check(
    "o_flt_1e", {"ez_min": "2005", "ez_max": "2008", "tuv_min": "2024"},
    "left(first_registration, 4) BETWEEN '2005' AND '2008' AND left(tuv_until, 4) >= '2024'",
)
filter_check("o_flt_1f", {"eu_spec": "false"}, "eu_spec = false")


@registry.add("o_flt_3", f"{Q} SELECT id, hidden FROM q WHERE NOT hidden")
def hidden_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.visible(listings(spark, sf_dir)).select("id", "hidden")


@registry.add("o_agg_13", f"""{Q} SELECT count(*) FILTER (WHERE trim = 'Z06' AND price_eur <= 200000)
  AS total, count(*) AS total_all FROM q""")
def filter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_counts(
        listings(spark, sf_dir), {"trim": "Z06", "price_max": "200000"})


# --- scores -----------------------------------------------------------------

SCORE_SQL = """greatest(0, least(100, cast(trunc(
  20
  + case coalesce(engine, probable_engine) when 'LS2' then 0 when 'LS3' then 8 when 'LS7' then 16
      when 'LS9' then 25 else -8 end
  + case transmission when 'manual' then 15 when 'automatic' then 4 else 0 end
  + case trim when 'Grand Sport' then 3 when 'Z06' then 7 when 'ZR1' then 12 else 0 end
  + case when body_style <> 'Cabrio' then 10 else 0 end
  + case when mileage_km <= 30000 then 10 when mileage_km <= 80000 then 5
      when mileage_km <= 150000 then 2 else 0 end
  + 1.25 * ((case when coalesce(engine, probable_engine) is not null then 1 else 0 end)
      + (case when mileage_km is not null then 1 else 0 end)
      + (case when price_eur is not null then 1 else 0 end)
      + (case when image_txt <> '' then 1 else 0 end))
  + case when eu_spec then 3 else 0 end
  - case risk_txt when 'accident_reported' then 18 when 'damage_reported;no_tuv' then 22
      when 'mileage_unclear' then 8 when 'sold_or_reserved;modified_heavily' then 24 else 0 end
) as int)))"""


@registry.add("o_scr_1", f"{Q} SELECT id, {SCORE_SQL} AS score FROM q")
def preference_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_score(listings(spark, sf_dir)).select("id", "score")


YEAR_SQL = "coalesce(model_year, try_cast(left(first_registration, 4) as int))"
EXTENTS = f"""e AS (SELECT min(price_eur) p0, max(price_eur) p1, min(mileage_km) m0,
  max(mileage_km) m1, min({YEAR_SQL}) y0, max({YEAR_SQL}) y1, min(power_hp) h0, max(power_hp) h1
  FROM q)"""
ACCIDENT_SQL = ("case when has_damage then 0.0 when not has_damage then 1.0 "
                "when accident_status = 'unfallfrei' then 1.0 "
                "when accident_status in ('', 'unbekannt') then 0.5 else 0.0 end")
EU_SQL = "case when eu_spec then 1.0 when not eu_spec then 0.0 else 0.5 end"
# weights 3 of 14 for price and mileage, 2 for the year, 1 each otherwise
PREFERENCES = {"price_eur": 4, "mileage_km": 4, "model_year": 2, "accident": 2, "eu_spec": 2,
               "power_hp": 2, "power_hp_dir": 1, "transmission": -1, "body_style": 1}


def _norm(value: str, low: str, high: str, up: bool) -> str:
    span = f"cast({value} - {low} as double) / ({high} - {low})"
    return f"case when {value} is null then 0.0 else {span if up else f'1 - {span}'} end"


MY_SCORE_SQL = f"""cast(greatest(0, least(100, floor(round(
  100 * (0.25 * {_norm('price_eur', 'p0', 'p1', False)} + 0.25 * {_norm('mileage_km', 'm0', 'm1', False)}
    + 0.125 * {_norm(YEAR_SQL, 'y0', 'y1', True)} + 0.125 * {ACCIDENT_SQL} + 0.125 * {EU_SQL}
    + 0.125 * {_norm('power_hp', 'h0', 'h1', True)})
  + case transmission when 'manual' then 10 when 'automatic' then -10 else 0 end
  + case body_style when 'Coupé' then -10 when 'Cabrio' then 10 else 0 end, 9) + 0.5))) as int)"""


@registry.add("o_scr_3", f"{Q}, {EXTENTS} SELECT id, {MY_SCORE_SQL} AS my_score FROM q, e")
def personal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_personal_score(listings(spark, sf_dir), PREFERENCES).select(
        "id", "my_score")


@registry.add("o_agg_8", f"""{Q}, {EXTENTS} SELECT p0 AS price_eur_min, p1 AS price_eur_max,
  m0 AS mileage_km_min, m1 AS mileage_km_max, y0 AS model_year_min, y1 AS model_year_max,
  h0 AS power_hp_min, h1 AS power_hp_max FROM e""")
def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.factor_extents(listings(spark, sf_dir))


@registry.add("o_flt_4", f"""{Q}, {EXTENTS}, s AS (SELECT q.*, {MY_SCORE_SQL} AS my_score FROM q, e)
SELECT id, my_score FROM s WHERE coalesce(status, 'unknown') = 'online'
  AND lower(concat_ws(' ', nullif(title, ''), description_text, source, engine, probable_engine,
      trim, transmission, body_style)) LIKE '%urgent%'
  AND left(coalesce(first_registration, ''), 4) <= '2008' AND price_eur <= 300000
  AND my_score >= 30 AND risk_txt = ''""")
def page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_listings(
        listings(spark, sf_dir), preferences=PREFERENCES, status="online", text=" Urgent ",
        ez_to="2008", price_max=300000, score_min=30, hide_risk=True,
    ).select("id", "my_score")


# --- reports ----------------------------------------------------------------

@registry.add("o_agg_1", f"""{Q} SELECT count(*) AS total_active,
  count(*) FILTER (WHERE change_type = 'new') AS new_listings,
  count(*) FILTER (WHERE change_type NOT IN ('new', 'unchanged')) AS changed_listings,
  count(*) FILTER (WHERE change_type = 'price_change') AS price_changes,
  count(*) FILTER (WHERE risk_txt <> '') AS risk_warnings,
  cast(round_even(sum(price_eur) / count(price_eur), 0) AS int) AS avg_price_eur,
  min(price_eur) AS min_price_eur, max(price_eur) AS max_price_eur,
  cast(round_even(sum(mileage_km) / count(mileage_km), 0) AS int) AS avg_mileage_km
FROM q WHERE NOT hidden""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.feed_summary(filters.visible(listings(spark, sf_dir)))


@registry.add("o_agg_2", f"""{Q}, r AS (SELECT price_eur AS p, row_number() OVER (ORDER BY price_eur) AS i,
  count(*) OVER () AS n FROM q WHERE price_eur IS NOT NULL)
SELECT cast(trunc(avg(p)) AS int) AS median_price_eur FROM r
WHERE i IN ((n + 1) // 2, (n + 2) // 2)""")
def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.median_price(listings(spark, sf_dir))


@registry.add("o_agg_3", f"""{Q} SELECT coalesce(nullif(trim, ''), 'k.A.') AS label,
  count(*) AS count FROM q GROUP BY 1""")
def trim_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distribution(listings(spark, sf_dir), "trim")


MINIMUMS = {"AutoScout24": 5, "Kleinanzeigen": 100_000_000, "Carsharing": 3}


@registry.add("o_agg_4", f"""{Q}, w(scope, expected) AS (VALUES ('AutoScout24', 5),
  ('Kleinanzeigen', 100000000), ('Carsharing', 3)),
r AS (SELECT 'total' AS scope, (SELECT count(*) FROM q) AS actual, 200000000 AS expected
  UNION ALL SELECT w.scope, (SELECT count(*) FROM q WHERE source = w.scope), expected FROM w)
SELECT scope, cast(actual AS bigint) AS actual, cast(expected AS bigint) AS expected,
  concat('Crawler quality: only ', actual, ' ', scope, ' listings parsed; expected at least ',
    expected) AS message FROM r WHERE actual < expected""")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.crawl_quality(
        listings(spark, sf_dir), min_total=200_000_000, min_by_source=MINIMUMS)
    return found.withColumn("message", validation.quality_message())


@registry.add("o_agg_6", f"""{Q}, g AS (SELECT coalesce(cluster_id, id) AS group_id, * FROM q),
p AS (SELECT group_id, id, row_number() OVER (PARTITION BY group_id
  ORDER BY coalesce(status = 'online', false) DESC, score DESC, id) AS r FROM g),
s AS (SELECT group_id, source, min(pos) AS fp FROM g GROUP BY 1, 2),
t AS (SELECT group_id, string_agg(source, ' + ' ORDER BY fp) AS source_summary FROM s GROUP BY 1)
SELECT group_id, cast(count(*) AS bigint) AS offer_count, min(g.pos) AS pos, any_value(source_summary)
  AS source_summary, any_value(p.id) AS primary_id
FROM g JOIN t USING (group_id) JOIN p USING (group_id) WHERE p.r = 1 GROUP BY 1""")
def group_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cluster_groups(listings(spark, sf_dir))


@registry.add("o_win_8", f"""{Q}, p AS (SELECT coalesce(cluster_id, id) AS group_id, id,
  row_number() OVER (PARTITION BY coalesce(cluster_id, id)
    ORDER BY CASE WHEN status = 'online' THEN 0 ELSE 1 END, score DESC, id) AS r FROM q)
SELECT group_id, id AS primary_id FROM p WHERE r = 1""")
def primaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cluster_primary(listings(spark, sf_dir))


@registry.add("o_agg_12", f"""{Q} SELECT id, cast(
  (price_eur IS NOT NULL)::int + (price_label IS NOT NULL)::int + (mileage_km IS NOT NULL)::int
  + (engine IS NOT NULL)::int + (probable_engine IS NOT NULL)::int
  + (engine_confidence IS NOT NULL)::int + (engine_note IS NOT NULL)::int
  + (power_hp IS NOT NULL)::int + (estimated_power_hp IS NOT NULL)::int
  + (power_note IS NOT NULL)::int + (trim IS NOT NULL)::int
  + (first_registration IS NOT NULL)::int + (tuv_until IS NOT NULL)::int
  + (transmission IS NOT NULL)::int + (body_style IS NOT NULL)::int
  + (coalesce(exterior_color, '') <> '')::int + (interior_color IS NOT NULL)::int
  + (location_raw IS NOT NULL)::int + (vin IS NOT NULL)::int
  + (description_text IS NOT NULL)::int + (accident_status <> 'unbekannt')::int
  + (damage IS NOT NULL)::int + (has_damage IS NOT NULL)::int + (eu_spec IS NOT NULL)::int
  + CASE WHEN risk_txt = '' THEN 0 ELSE len(string_split(risk_txt, ';')) END
  + CASE WHEN image_txt = '' THEN 0 ELSE len(string_split(image_txt, ';')) END
  + CASE WHEN equip_txt = '' THEN 0 ELSE len(string_split(equip_txt, ';')) END
  + CASE WHEN note_txt = '' THEN 0 ELSE 1 END AS int) AS filled FROM q""")
def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complete(listings(spark, sf_dir)).select("id", filled_count().alias("filled"))


def _complete(df: DataFrame) -> DataFrame:
    """The listing view with every column of the listing schema."""
    return conform(df, keep=("pos",))


# --- orders -----------------------------------------------------------------

@registry.add("o_srt_1", f"""{Q}, s AS (SELECT id, price_eur, {SCORE_SQL} AS score FROM q
  WHERE NOT hidden AND price_eur BETWEEN 10000 AND 400000 AND risk_txt = '')
SELECT row_number() OVER (ORDER BY score DESC, coalesce(price_eur, 0) DESC,
  coalesce(price_eur, 999999999), id) AS rank, id, price_eur, score FROM s""")
def ranked_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: score, visible listings, filters, total order with rank."""
    scored = scoring.with_score(listings(spark, sf_dir))
    chosen = filters.filter_listings(
        filters.visible(scored),
        {"price_min": "10000", "price_max": "400000", "risk_free": "true"})
    narrow = chosen.select("id", "price_eur", "score")
    return report.ranked(narrow, report.feed_order()).select("rank", "id", "price_eur", "score")


def order_check(name: str, order, select: dict[str, str], sql_order: str, cte: str = "") -> None:
    """An order is checked through the rank that it gives to every listing."""
    columns = ", ".join(f"{e} AS {n}" for n, e in select.items())

    @registry.add(name, f"""{Q}{cte} SELECT row_number() OVER (ORDER BY {sql_order}) AS rank, id
      FROM (SELECT {columns} FROM q)""")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = listings(spark, sf_dir).withColumn("my_score", F.col("score"))
        return report.ranked(df.select(*select), order()).select("rank", "id")


order_check(
    "o_srt_2", report.state_order, {"id": "id", "price_eur": "price_eur"},
    "coalesce(price_eur, 999999999), id")
PAGE_ORDERS = {
    "status-online": "case status when 'online' then 1 when 'offline' then 2 else 3 end",
    "status-offline": "case status when 'online' then 1 when 'offline' then 2 else 3 end DESC",
    "score-asc": "score", "score-desc": "score DESC",
    "price-asc": "coalesce(nullif(price_eur, 0), 999999999)",
    "price-desc": "coalesce(price_eur, 0) DESC",
    "mileage-asc": "coalesce(nullif(mileage_km, 0), 999999999)",
    "mileage-desc": "coalesce(mileage_km, 0) DESC",
    "ez-asc": "coalesce(first_registration, 'ZZZZ')",
    "ez-desc": "coalesce(first_registration, '') DESC",
    "created-desc": "created_at DESC", "created-asc": "created_at", "source": "source",
}
_ORDER_INPUT = {c: c for c in ("id", "status", "score", "price_eur", "mileage_km",
                               "first_registration", "created_at", "source")}
for _name, _sql in PAGE_ORDERS.items():
    order_check(
        f"o_srt_3_{_name.replace('-', '_')}", lambda n=_name: report.list_order(n),
        {**_ORDER_INPUT, "my_score": "score"}, f"{_sql}, id")
STATIC_ORDERS = {
    "score": "score DESC", "price-asc": "coalesce(price_eur, 999999999)",
    "price-desc": "coalesce(price_eur, 0) DESC", "mileage-asc": "coalesce(mileage_km, 999999999)",
}
for _name, _sql in STATIC_ORDERS.items():
    order_check(
        f"o_srt_5_{_name.replace('-', '_')}", lambda n=_name: report.static_order(n),
        {c: c for c in ("id", "score", "price_eur", "mileage_km")}, f"{_sql}, id")


# --- display and small functions --------------------------------------------

NA = "'k.A.'"


def _dots(value: str) -> str:
    return f"replace(format('{{:,}}', {value}), ',', '.')"


@registry.add("o_fn_1", f"""{Q} SELECT id,
  coalesce({_dots('price_eur')} || ' €', {NA}) AS eur,
  coalesce({_dots('mileage_km')} || ' km', {NA}) AS km FROM q""")
def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select(
        "id", d.format_eur(F.col("price_eur")).alias("eur"),
        d.format_km(F.col("mileage_km")).alias("km"))


PRICE_SQL = (f"case when price_eur is not null then concat_ws(' ', {_dots('price_eur')} || ' €', "
             f"price_label) else coalesce(price_label, {NA}) end")
POWER_SQL = (f"coalesce(cast(power_hp as varchar) || ' PS', "
             f"'ca. ' || cast(estimated_power_hp as varchar) || ' PS', {NA})")
ENGINE_SQL = (f"coalesce(engine, 'wahrscheinlich ' || probable_engine || ' (' || "
              f"cast(cast(round_even(engine_confidence * 100, 0) as int) as varchar) || '%)', {NA})")
VARIANT_SQL = (f"case when trim <> 'Base' then concat_ws(' ', trim, body_style) "
               f"when body_style is not null then 'C6 ' || body_style else coalesce(trim, {NA}) end")
GEAR_SQL = (f"case transmission when 'manual' then 'Schalter' when 'automatic' then 'Automatik' "
            f"else coalesce(transmission, {NA}) end")


def display_check(name: str, columns: dict, sqls: dict[str, str]) -> None:
    chosen = ", ".join(f"{e} AS {n}" for n, e in sqls.items())

    @registry.add(name, f"{Q} SELECT id, {chosen} FROM q")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return listings(spark, sf_dir).select("id", *[c().alias(n) for n, c in columns.items()])


display_check("o_fn_2", {"price": d.price_display}, {"price": PRICE_SQL})
display_check("o_fn_3", {"power": d.power_display}, {"power": POWER_SQL})
display_check(
    "o_fn_4", {"engine": d.engine_display, "note": d.engine_note_display},
    {"engine": ENGINE_SQL, "note": "case when engine is null then engine_note end"})
display_check(
    "o_fn_5", {"variant": d.variant_display, "gear": d.transmission_display},
    {"variant": VARIANT_SQL, "gear": GEAR_SQL})
display_check(
    "o_fn_7", {"per_1000": d.price_per_1000_km},
    {"per_1000": "cast(round_even(price_eur / nullif(mileage_km, 0) * 1000, 0) as int)"})
display_check(
    "o_fn_8", {"year": d.item_year, "accident": d.accident_norm, "eu": d.eu_spec_norm},
    {"year": YEAR_SQL, "accident": f"cast({ACCIDENT_SQL} as double)",
     "eu": f"cast({EU_SQL} as double)"})


@registry.add("o_fn_6", f"""{Q} SELECT id, concat(provider,
  CASE WHEN score % 4 > 0 THEN concat(' (', cast(cast(round_even(score / 101.0 * 100, 0) AS int) AS varchar), '%)')
    ELSE '' END, CASE WHEN description_text IS NOT NULL THEN ': ' || description_text ELSE '' END) AS ai
FROM (SELECT *, CASE WHEN trim IS NULL THEN 'AI' ELSE trim END AS provider FROM q)""")
def ai_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.when(F.col("score") % 4 > 0, F.col("score") / F.lit(101.0))
    df = listings(spark, sf_dir).withColumn("ai_enrichment", F.struct(
        F.col("trim").alias("provider"), confidence.alias("confidence"),
        F.col("description_text").alias("notes")))
    return df.select("id", d.ai_summary_display().alias("ai"))


# --- inference, validation, outliers ----------------------------------------

INFER_SQL = f"""{Q}, a AS (SELECT *, CASE engine WHEN 'LS7' THEN 'Z06' WHEN 'LS9' THEN 'ZR1' END AS implied FROM q),
b AS (SELECT *, coalesce(implied, trim) AS t,
  implied IS NOT NULL AND trim IS DISTINCT FROM implied AS off FROM a),
c AS (SELECT *, coalesce(t IN ('Z06', 'ZR1'), false) AS track FROM b)
SELECT id, t AS trim, CASE WHEN track THEN 'manual' ELSE transmission END AS transmission,
  CASE WHEN track THEN 'Coupé' WHEN body_style = 'Coupé' THEN 'Targa' ELSE body_style END AS body_style,
  concat_ws('|', CASE WHEN off THEN engine || ' → ' || implied END,
    CASE WHEN track AND transmission IS DISTINCT FROM 'manual' THEN t || ' → Schalter' END,
    CASE WHEN track AND body_style IS DISTINCT FROM 'Coupé' THEN t || ' → Coupé' END,
    CASE WHEN NOT track AND body_style IN ('Coupé', 'Targa') THEN 'Coupé/Coupe → Targa' END) AS notes,
  concat_ws('|', CASE WHEN off AND trim IS NOT NULL THEN 'conflict_' || lower(engine) || '_trim_'
      || replace(lower(trim), ' ', '_') END,
    CASE WHEN track AND transmission <> 'manual' THEN 'conflict_' || lower(t) || '_transmission_'
      || transmission END,
    CASE WHEN track AND body_style <> 'Coupé' THEN 'conflict_' || lower(t) || '_body_'
      || lower(body_style) END) AS conflicts
FROM c"""


@registry.add("o_nrm_28", INFER_SQL)
def inferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer(listings(spark, sf_dir)).select(
        "id", "trim", "transmission", "body_style",
        F.array_join("inference_notes", "|").alias("notes"),
        F.array_join("conflict_flags", "|").alias("conflicts"))


@registry.add("o_nrm_29", f"""{Q} SELECT id, 'Chevrolet Corvette C6' || coalesce(' ' ||
  CASE WHEN trim = 'Base' AND body_style IS NOT NULL THEN body_style ELSE trim END, '') AS model
FROM q""")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select(
        "id", model_name(F.col("trim"), F.col("body_style")).alias("model"))


# amounts around every limit, by order key
EDGE = {
    "id": "id",
    "price_eur": "case pos % 11 when 0 then -5 when 1 then 0 when 2 then 50 when 3 then 99 "
                 "when 4 then 600001 when 5 then null else price_eur end",
    "mileage_km": "case pos % 10 when 0 then -1 when 1 then 0 when 2 then 99 when 3 then 500001 "
                  "when 4 then null else mileage_km end",
    "power_hp": "case pos % 8 when 0 then -1 when 1 then 0 when 2 then 49 when 3 then 1201 "
                "else power_hp end",
    "price_label": "price_label", "engine": "engine", "probable_engine": "probable_engine",
    "trim": "trim", "body_style": "body_style",
    "first_registration": "case pos % 6 when 0 then '2001-05' when 1 then '2019-01' "
                          "else first_registration end",
}
EDGE_SQL = (f"{Q}, v AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in EDGE.items()) + " FROM q)")


def _codes(*cases: tuple[str, str, str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT id, '{field}' AS field, '{severity}' AS severity, '{code}' AS code FROM v "
        f"WHERE {where}" for where, field, severity, code in cases)


VALIDATION_SQL = EDGE_SQL + " " + _codes(
    ("price_eur < 0", "price_eur", "critical", "price_negative"),
    ("price_eur = 0", "price_eur", "error", "price_zero"),
    ("price_eur BETWEEN 1 AND 99 AND price_label IS NULL", "price_eur", "warning",
     "price_very_low"),
    ("price_eur > 500000", "price_eur", "warning", "price_very_high"),
    ("price_eur IS NULL", "price_eur", "info", "price_missing"),
    ("mileage_km < 0", "mileage_km", "critical", "mileage_negative"),
    ("mileage_km = 0", "mileage_km", "error", "mileage_zero"),
    ("mileage_km BETWEEN 1 AND 99", "mileage_km", "warning", "mileage_very_low"),
    ("mileage_km > 500000", "mileage_km", "warning", "mileage_very_high"),
    ("mileage_km IS NULL", "mileage_km", "info", "mileage_missing"),
    ("power_hp < 0", "power_hp", "critical", "power_negative"),
    ("power_hp = 0", "power_hp", "error", "power_zero"),
    ("power_hp BETWEEN 1 AND 49", "power_hp", "warning", "power_very_low"),
    ("power_hp > 1200", "power_hp", "warning", "power_very_high"),
    ("cast(left(first_registration, 4) AS int) NOT BETWEEN 2004 AND 2014", "first_registration",
     "warning", "year_out_of_range"),
    ("(coalesce(engine, probable_engine) = 'LS9' AND trim <> 'ZR1') OR "
     "(coalesce(engine, probable_engine) = 'LS7' AND trim <> 'Z06') OR "
     "(coalesce(engine, probable_engine) = 'LS3' AND trim IN ('Z06', 'ZR1')) OR "
     "(coalesce(engine, probable_engine) = 'LS2' AND trim NOT IN ('Base', 'Special Edition'))",
     "engine", "warning", "engine_trim_mismatch"),
    ("trim IS NULL", "trim", "info", "trim_missing"),
    ("body_style IS NULL", "body_style", "info", "body_style_missing"),
    ("price_eur IS NULL AND price_label IS NULL", "price_eur", "warning", "price_fully_missing"),
)


@registry.add("o_val_1", VALIDATION_SQL)
def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = listings(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in EDGE.items()])
    return df.select("id", F.explode(validation.validation_flags()).alias("f")).select(
        "id", "f.field", "f.severity", "f.code")


QUARTILE_SQL = """(SELECT count(*) AS n,
  min(v) FILTER (WHERE i = n // 4) AS q1, min(v) FILTER (WHERE i = 3 * n // 4) AS q3
  FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n
        FROM q WHERE {c} IS NOT NULL))"""


@registry.add("o_agg_7", f"""{Q} SELECT 'price_eur' AS measure, * FROM {QUARTILE_SQL.format(c='price_eur')}
UNION ALL SELECT 'mileage_km', * FROM {QUARTILE_SQL.format(c='mileage_km')}""")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = listings(spark, sf_dir)
    parts = [
        validation.index_quartiles(df, c).select(F.lit(c).alias("measure"), "n", "q1", "q3")
        for c in ("price_eur", "mileage_km")
    ]
    return parts[0].unionByName(parts[1])


# fresh rows far outside the stored range, so that every outlier code occurs
OUT = {
    "price_eur": "case pos % 9 when 0 then price_eur * 20 when 1 then -2000000 else price_eur end",
    "mileage_km": "case pos % 7 when 0 then mileage_km * 30 else mileage_km end",
}
OUTLIER_SQL = f"""{Q}, p AS {QUARTILE_SQL.format(c='price_eur')},
m AS {QUARTILE_SQL.format(c='mileage_km')},
f AS (SELECT id, {OUT['price_eur']} AS price_eur, {OUT['mileage_km']} AS mileage_km FROM q)
SELECT id, 'price_below_historical_range' AS code FROM f, p WHERE price_eur < q1 - 3.0 * (q3 - q1)
UNION ALL SELECT id, 'price_above_historical_range' FROM f, p WHERE price_eur > q3 + 3.0 * (q3 - q1)
UNION ALL SELECT id, 'mileage_above_historical_range' FROM f, m WHERE mileage_km > q3 + 3.0 * (q3 - q1)"""


def _outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = listings(spark, sf_dir)
    fresh = stored.selectExpr(
        "id", *[f"cast({e} as int) AS {n}" for n, e in OUT.items()],
        "cast(array() as array<struct<field:string,severity:string,code:string,message:string>>)"
        " AS validation_flags")
    return validation.with_historical_flags(fresh, stored)


@registry.add("o_val_2", OUTLIER_SQL)
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outliers(spark, sf_dir).select(
        "id", F.explode("validation_flags").alias("f")).select("id", F.col("f.code").alias("code"))


@registry.add("o_jon_5", f"""{Q}, p AS {QUARTILE_SQL.format(c='price_eur')}
SELECT id, price_eur, q1, q3 FROM q, p""")
def every_listing_with_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = listings(spark, sf_dir)
    packed = validation.index_quartiles(df, "price_eur").select(F.struct("q1", "q3")).scalar()
    return df.select("id", "price_eur", packed.alias("r")).select(
        "id", "price_eur", "r.q1", "r.q3")


# --- joins and clusters on the listing view ---------------------------------

@registry.add("o_jon_6", f"""{Q} SELECT q.id, strftime(o.o_orderdate, '%Y-%m-%d') AS created_on
FROM q LEFT JOIN orders o ON q.id = 'q_' || cast(o.o_orderkey AS varchar)
  AND o.o_orderstatus <> 'F'""")
def created_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").selectExpr(
        "concat('q_', cast(o_orderkey as string)) AS id", "o_orderdate AS created_at")
    df = listings(spark, sf_dir).drop("created_at")
    return with_created_at(df, state).select(
        "id", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


@registry.add("o_prj_5", f"""{Q} SELECT id, cast(i - 1 AS int) AS idx, string_split(risk_txt, ';')[i] AS risk_flag
FROM q, range(1, 3) t(i) WHERE risk_txt <> '' AND i <= len(string_split(risk_txt, ';'))
UNION ALL SELECT id, NULL, NULL FROM q WHERE risk_txt = ''""")
def risk_flag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select(
        "id", F.posexplode_outer("risk_flags").alias("idx", "risk_flag"))


FILLED = registry.sql["o_agg_12"][len(Q):]


@registry.add("o_clu_5", f"""{Q}, f AS ({FILLED}), r AS (SELECT q.cluster_id, q.id, filled,
  row_number() OVER (PARTITION BY cluster_id ORDER BY filled DESC, score DESC, pos) AS n,
  count(*) OVER (PARTITION BY cluster_id) AS members
  FROM q JOIN f USING (id) WHERE cluster_id IS NOT NULL)
SELECT cluster_id, id AS best_id, filled AS best_filled, members FROM r WHERE n = 1""")
def best_of_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_members(_complete(listings(spark, sf_dir)))
