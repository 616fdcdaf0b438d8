"""Checks of state merge, overrides, enrichment and exports: two runs over the orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adledger import lexicon as lx
from adledger import schema
from adledger.functions import identity
from adledger.operators import enrichment, state
from adledger.operators.skew import shuffled
from adledger.plans import listing_queries as lq
from adledger.plans.batch import SNAPSHOT, Run, listing_folder, store_run
from adledger.plans.bindings import K, LISTINGS, listings, sql, table, with_lists
from adledger.plans.registry import Registry
from adledger.session import spread, work_path
from adledger.sources import exports

registry = Registry()
Q = f"WITH q AS ({sql(LISTINGS, 'orders')})"
RUN_AT = "2024-03-01 06:00:00"

# the second run: finished orders are gone, pending ones are new, some values moved
MOVED = {
    "price_eur": "case when pos % 5 = 1 then cast(floor(price_eur * 0.5) as int) "
                 "when pos % 31 = 0 then null else price_eur end",
    "mileage_km": "case when pos % 7 = 2 then mileage_km + 1000 else mileage_km end",
    "cluster_id": "case when pos % 3 = 0 then concat('soft_full_', id) else cluster_id end",
}
STORED_CLUSTER = "case when pos % 4 = 1 then concat('manual_', id) else cluster_id end"
TWO_RUNS = f"""{Q}, o AS (SELECT o_orderkey AS k, o_orderstatus AS st FROM orders),
stored AS (SELECT q.* REPLACE ({STORED_CLUSTER} AS cluster_id) FROM q JOIN o ON k = pos WHERE st <> 'P'),
fresh AS (SELECT q.* REPLACE ({", ".join(f"{e} AS {c}" for c, e in MOVED.items())}, false AS hidden)
  FROM q JOIN o ON k = pos WHERE st <> 'F')"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = spread(table(spark, sf_dir, "orders"))
    both = with_lists(orders.selectExpr(
        "o_orderstatus AS st", *[f"{e} AS {n}" for n, e in LISTINGS.items()]))
    clean = both.withColumn("change_type", F.lit("new"))
    run1 = clean.filter("st <> 'P'").withColumn("cluster_id", F.expr(STORED_CLUSTER))
    stored = schema.conform(run1, keep=("created_at",)).withColumns({
        "created_at": F.col("created_at").cast("timestamp"),
        "last_seen_at": F.col("created_at").cast("timestamp"),
    })
    moved = clean.filter("st <> 'F'").withColumns({c: F.expr(e) for c, e in MOVED.items()})
    fresh = schema.conform(moved.withColumn("hidden", F.lit(False)), keep=("pos",))
    return fresh, stored


def _now():
    return F.lit(RUN_AT).cast("timestamp")


TYPED = f"""{TWO_RUNS}, typed AS (SELECT f.id, f.pos, f.price_eur, f.mileage_km,
  CASE WHEN s.id IS NULL THEN 'new' WHEN s.price_eur IS DISTINCT FROM f.price_eur THEN 'price_change'
    WHEN s.mileage_km IS DISTINCT FROM f.mileage_km THEN 'metadata_change' ELSE 'unchanged' END
    AS change_type,
  CASE WHEN s.id IS NOT NULL AND s.price_eur IS DISTINCT FROM f.price_eur THEN s.price_eur END
    AS previous_price_eur,
  coalesce(s.hidden, false) AS hidden,
  CASE WHEN s.cluster_id LIKE 'manual_%' THEN s.cluster_id ELSE f.cluster_id END AS cluster_id
  FROM fresh f LEFT JOIN stored s USING (id))"""
STATE_COLUMNS = ["id", "price_eur", "mileage_km", "change_type", "previous_price_eur", "hidden",
                 "cluster_id"]
STATE_SQL = f"""{TYPED} SELECT {", ".join(STATE_COLUMNS)} FROM typed
UNION ALL SELECT id, price_eur, mileage_km, 'new', NULL, hidden, cluster_id FROM stored
WHERE id NOT IN (SELECT id FROM fresh)"""


@registry.add("o_ups_1", STATE_SQL)
def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh, stored = _runs(spark, sf_dir)
    return state.upsert(fresh, stored, _now()).state.select(*STATE_COLUMNS)


@registry.add("o_ups_2", f"""{TYPED} SELECT id AS listing_id, '{RUN_AT}' AS captured_at, price_eur,
  mileage_km, change_type FROM typed""")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh, stored = _runs(spark, sf_dir)
    return state.upsert(fresh, stored, _now()).snapshots.select(
        "listing_id", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at"),
        "price_eur", "mileage_km", "change_type")


@registry.add("o_jon_1", f"""{TWO_RUNS} SELECT f.id, s.id IS NOT NULL AS matched,
  s.price_eur AS old_price, s.mileage_km AS old_km FROM fresh f LEFT JOIN stored s USING (id)""")
def fresh_with_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh, stored = _runs(spark, sf_dir)
    old = stored.select("id", F.lit(True).alias("m"), F.col("price_eur").alias("old_price"),
                        F.col("mileage_km").alias("old_km"))
    return fresh.join(old, "id", "left").select(
        "id", F.coalesce("m", F.lit(False)).alias("matched"), "old_price", "old_km")


@registry.add("o_snk_4", f"{STATE_SQL}")
def stored_and_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state as read from its table after the second run was put in place, twice."""
    fresh, stored = _runs(spark, sf_dir)
    folder = listing_folder(spark, work_path(spark, "state"))
    folder.state.put(stored)

    def run() -> Run:
        return Run(state.upsert(fresh, folder.state.read(), _now()), fresh.limit(0))

    for _ in range(2):
        store_run(folder, "second", run)
    log = shuffled(folder.log("snapshots", SNAPSHOT).select(F.col("listing_id").alias("id")).distinct())
    known = folder.state.read()
    written = known.join(log, "id", "left_semi")
    return written.unionByName(known.join(log, "id", "left_anti")).select(*STATE_COLUMNS)


# a batch with many rows per id: every event re-lists its user's offer
BATCH_STORED = {
    "id": "concat('u_', cast(c_custkey as string))",
    "price_eur": "cast(floor(c_acctbal) as int)", "mileage_km": "cast(5000 as int)",
    "hidden": "(c_custkey % 10 = 0)",
    "cluster_id": "case when c_custkey % 3 = 0 then concat('manual_', c_name) end",
}


@registry.add("o_win_10", f"""WITH s AS ({sql(BATCH_STORED, 'customer')}),
e AS (SELECT 'u_' || cast(user_id AS varchar) AS id, event_id AS pos, cast(floor(value) AS int) AS price_eur,
  cast(event_id % 3 * 1000 AS int) AS mileage_km, CASE WHEN event_type = 'error' THEN
    'manual_e' || cast(event_id AS varchar) END AS cluster_id FROM events),
l AS (SELECT *, row_number() OVER w AS rn, lag(price_eur) OVER w AS bp, lag(mileage_km) OVER w AS bk,
  first_value(cluster_id IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bm
  FROM e WINDOW w AS (PARTITION BY id ORDER BY pos)),
j AS (SELECT l.*, s.id IS NOT NULL AS known, CASE WHEN rn = 1 THEN s.price_eur ELSE bp END AS op,
  CASE WHEN rn = 1 THEN s.mileage_km ELSE bk END AS ok, s.hidden AS sh, s.cluster_id AS sc
  FROM l LEFT JOIN s USING (id))
SELECT id, pos, CASE WHEN rn = 1 AND NOT known THEN 'new' WHEN op IS DISTINCT FROM price_eur THEN
  'price_change' WHEN ok IS DISTINCT FROM mileage_km THEN 'metadata_change' ELSE 'unchanged' END AS change_type,
  coalesce(sh, false) AS hidden, coalesce(sc, bm) AS cluster_id FROM j""")
def within_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").selectExpr(
        *[f"{e} AS {n}" for n, e in BATCH_STORED.items()])
    fresh = table(spark, sf_dir, "events").selectExpr(
        "concat('u_', cast(user_id as string)) AS id", "event_id AS pos",
        "cast(floor(value) as int) AS price_eur", "cast(event_id % 3 * 1000 as int) AS mileage_km",
        "case when event_type = 'error' then concat('manual_e', cast(event_id as string)) end "
        "AS cluster_id", "false AS hidden", "cast(null as int) AS previous_price_eur")
    return state.type_changes(fresh, stored).select(
        "id", "pos", "change_type", "hidden", "cluster_id")


# --- overrides --------------------------------------------------------------

# one edit per line item; a later ship date is a later edit
EDITS = {
    "listing_id": "concat('q_', cast(l_orderkey as string))",
    "field": "case l_linenumber when 1 then 'price_eur' when 2 then 'trim' when 3 then 'engine' "
             "when 4 then 'score' when 5 then 'first_registration' when 6 then 'model_year' "
             "else 'eu_spec' end",
    "value": "case l_linenumber when 1 then cast(10000 + day(l_shipdate) as string) "
             "when 2 then case when month(l_shipdate) % 2 = 0 then '' else 'Z06' end "
             "when 3 then 'LS7' when 4 then '99' "
             "when 5 then case when day(l_shipdate) % 2 = 0 then '2008-06' else '06/2008' end "
             "when 6 then cast(2000 + day(l_shipdate) as string) else 'true' end",
    "updated_at": "l_shipdate",
    "flag": "l_returnflag",
}
ERROR_SQL = """CASE WHEN field = 'score' THEN 'unsupported field'
  WHEN field = 'first_registration' AND value LIKE '%/%' THEN 'not YYYY-MM'
  WHEN field = 'model_year' AND NOT cast(value AS int) BETWEEN 2004 AND 2014
    THEN 'model_year out of range' END"""
EDIT_SQL = f"ed AS (SELECT * FROM ({sql(EDITS, 'lineitem')}))"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in EDITS.items()])


@registry.add("o_flt_7", f"WITH {EDIT_SQL} SELECT listing_id, field, value, {ERROR_SQL} AS error FROM ed")
def refused_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, refused = state.split_overrides(_edits(spark, sf_dir))
    raw = F.coalesce("value", F.lit(""))  # '' was turned into null when accepted
    return accepted.withColumns({"value": raw, "error": F.lit(None).cast("string")}).unionByName(
        refused).select("listing_id", "field", "value", "error")


LAST_EDIT = f"""{EDIT_SQL}, ok AS (SELECT * FROM ed WHERE {ERROR_SQL} IS NULL),
le AS (SELECT listing_id, field, nullif(arg_max(value, updated_at), '') AS value FROM ok GROUP BY 1, 2),
m AS (SELECT listing_id AS id, list(field) AS fields,
  max(value) FILTER (WHERE field = 'price_eur') AS v_price_eur, max(value) FILTER (WHERE field = 'trim') AS v_trim,
  max(value) FILTER (WHERE field = 'engine') AS v_engine,
  max(value) FILTER (WHERE field = 'first_registration') AS v_first_registration,
  max(value) FILTER (WHERE field = 'model_year') AS v_model_year,
  max(value) FILTER (WHERE field = 'eu_spec') AS v_eu_spec FROM le GROUP BY 1)"""
EDITED = ["price_eur", "trim", "engine", "first_registration", "model_year", "eu_spec"]
_EDIT_TYPES = {"price_eur": "int", "model_year": "int", "eu_spec": "boolean"}
EDITED_SQL = ", ".join(
    f"CASE WHEN list_contains(fields, '{c}') THEN cast(v_{c} AS {_EDIT_TYPES.get(c, 'varchar')}) "
    f"ELSE {c} END AS {c}" for c in EDITED)


@registry.add("o_jon_2", f"{Q}, {LAST_EDIT} SELECT q.id, {EDITED_SQL} FROM q LEFT JOIN m USING (id)")
def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = state.split_overrides(_edits(spark, sf_dir).drop("flag"))
    merged = state.merge_overrides(accepted.limit(0), accepted)
    return state.apply_overrides(listings(spark, sf_dir), merged).select("id", *EDITED)


@registry.add("o_ups_3", f"""{Q}, {LAST_EDIT}, t AS (SELECT DISTINCT listing_id AS id FROM ok
  WHERE flag <> 'A') SELECT q.id, {EDITED_SQL.replace(
    "list_contains(fields", "t.id IS NOT NULL AND list_contains(fields")},
  t.id IS NOT NULL AS snapshot FROM q LEFT JOIN m USING (id) LEFT JOIN t USING (id)""")
def override_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits with flag A are stored already; the others arrive as the batch."""
    edits = _edits(spark, sf_dir)
    earlier, _ = state.split_overrides(edits.filter("flag = 'A'").drop("flag"))
    stored = state.merge_overrides(earlier.limit(0), earlier)
    rows = listings(spark, sf_dir)
    current = schema.conform(rows)
    after, _, snaps = state.apply_override_batch(
        current, stored, edits.filter("flag <> 'A'").drop("flag"), _now())
    made = snaps.filter("change_type = 'manual_override'").select(
        F.col("listing_id").alias("id"), F.lit(True).alias("s"))
    return after.join(made, "id", "left").select(
        "id", *EDITED, F.coalesce("s", F.lit(False)).alias("snapshot"))


@registry.add("o_ups_4", f"""{Q} SELECT id, CASE change_type WHEN 'new' THEN true
  WHEN 'price_change' THEN false ELSE hidden END AS hidden FROM q""")
def hide_and_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    orders = rows.filter("change_type IN ('new', 'price_change')").select(
        F.col("id").alias("listing_id"), (F.col("change_type") == "new").alias("hidden"))
    return state.set_hidden(rows, orders).select("id", "hidden")


# --- records ----------------------------------------------------------------

@registry.add("o_fn_9", f"""{Q} SELECT id, CASE WHEN trim = 'Z06' THEN NULL ELSE trim END AS trim,
  price_eur, eu_spec, engine_confidence,
  CASE WHEN risk_txt = '' THEN 0 ELSE len(string_split(risk_txt, ';')) END::int AS n_flags,
  json_object('change_type', change_type, 'id', id, 'price_eur', price_eur, 'title', title,
    'trim', CASE WHEN trim = 'Z06' THEN 'Z-06' ELSE trim END)::varchar AS narrow FROM q""")
def payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to sorted JSON and back; a bad trim becomes null, null lists empty."""
    rows = listings(spark, sf_dir).withColumns({
        "trim": F.when(F.col("trim") == "Z06", F.lit("Z-06")).otherwise(F.col("trim")),
        "risk_flags": F.when(F.size("risk_flags") > 0, F.col("risk_flags")),
    })
    names = [f.name for f in schema.LISTING if f.name in rows.columns]
    narrow = schema.to_payload(["title", "id", "trim", "price_eur", "change_type"])
    written = rows.select(schema.to_payload(names).alias("payload_json"), narrow.alias("narrow"))
    return schema.from_payload(written).select(
        "id", "trim", "price_eur", "eu_spec", "engine_confidence",
        F.size("risk_flags").alias("n_flags"), "narrow")


@registry.add("o_prj_6", f"""{Q} SELECT id AS listing_id, image_txt AS images,
  concat_ws(';', 'price_eur=' || price_eur, 'mileage_km=' || mileage_km, 'engine=' || engine,
    'probable_engine=' || probable_engine, 'engine_confidence=' || engine_confidence,
    'power_hp=' || power_hp, 'trim=' || trim, 'first_registration=' || first_registration,
    'tuv_until=' || tuv_until, 'transmission=' || transmission,
    'exterior_color=' || exterior_color, 'interior_color=' || interior_color,
    'accident_status=' || accident_status, 'damage=' || damage, 'location_raw=' || location_raw,
    'risk_flags=' || CASE WHEN risk_txt <> '' THEN to_json(string_split(risk_txt, ';'))::varchar END)
  AS known FROM q""")
def provider_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schema.conform(listings(spark, sf_dir))
    pairs = F.transform(
        F.map_entries("known_fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return enrichment.enrichment_input(rows).select(
        "listing_id", F.array_join("image_urls", ";").alias("images"),
        F.array_join(pairs, ";").alias("known"))


@registry.add("o_srt_6", f"""{Q} SELECT id, CASE WHEN image_txt = '' THEN '' ELSE
  split_part(image_txt, ';', 1) END AS first_image FROM q""")
def image_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schema.conform(listings(spark, sf_dir))
    return enrichment.enrichment_input(rows, max_images=1).select(
        F.col("listing_id").alias("id"), F.array_join("image_urls", ";").alias("first_image"))


def sample_provider() -> Callable[[dict], dict]:
    """A deterministic stand-in for a user's provider; it fails on listings without text."""
    def analyze(record: dict) -> dict:
        if record["description"] is None:
            raise ValueError("no description")
        return {
            "provider": "rules", "confidence": 0.5, "exterior_color": "grün",
            "interior_color": "", "transmission": "manual", "body_style": "Cabrio",
            "eu_spec": True, "equipment": ["bose", " Head   Up ", ""], "visual_flags": ["Kratzer"],
            "risk_flags": ["no_tuv"], "notes": record["title"],
            "evidence": {"images": str(len(record["image_urls"]))},
        }

    return analyze


_HIT = "description_text IS NOT NULL"


@registry.add("o_udf_1", f"""{Q} SELECT id, CASE WHEN {_HIT} THEN 'rules' END AS provider,
  CASE WHEN {_HIT} THEN title END AS notes,
  CASE WHEN NOT ({_HIT}) THEN 'no description' END AS error FROM q""")
def provider_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schema.conform(listings(spark, sf_dir))
    return enrichment.call_provider(enrichment.enrichment_input(rows), sample_provider).select(
        "id", "provider", "notes", "error")


@registry.add("o_enr_1", f"""{Q} SELECT id,
  CASE WHEN {_HIT} THEN coalesce(nullif(exterior_color, ''), 'grün') ELSE exterior_color END AS exterior_color,
  interior_color, CASE WHEN {_HIT} THEN coalesce(transmission, 'manual') ELSE transmission END AS transmission,
  body_style, CASE WHEN {_HIT} THEN coalesce(eu_spec, true) ELSE eu_spec END AS eu_spec,
  CASE WHEN {_HIT} THEN concat_ws(';', nullif(equip_txt, ''), CASE WHEN equip_txt LIKE '%Bose%' THEN NULL ELSE 'bose' END,
    'Head Up') ELSE equip_txt END AS equipment,
  CASE WHEN {_HIT} THEN concat_ws(';', nullif(risk_txt, ''), CASE WHEN risk_txt LIKE '%no_tuv%' THEN NULL ELSE 'no_tuv' END)
    ELSE risk_txt END AS risk_flags,
  CASE WHEN {_HIT} THEN 'Cabrio' END AS noted_body FROM q""")
def merged_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schema.conform(listings(spark, sf_dir))
    results = enrichment.call_provider(enrichment.enrichment_input(rows), sample_provider)
    return enrichment.merge_results(rows, results).select(
        "id", "exterior_color", "interior_color", "transmission", "body_style", "eu_spec",
        F.array_join("equipment", ";").alias("equipment"),
        F.array_join("risk_flags", ";").alias("risk_flags"),
        F.col("ai_enrichment.fields.body_style").alias("noted_body"))


@registry.add("o_set_3", f"""{Q} SELECT id, concat_ws(';', nullif(equip_txt, ''),
  CASE WHEN equip_txt LIKE '%Navi%' THEN NULL ELSE 'NAVI' END, 'Shop ' || source) AS merged,
  concat_ws(';', nullif(equip_txt, ''), CASE WHEN image_txt = '' THEN NULL
    WHEN split_part(image_txt, ';', 1) = split_part(image_txt, ';', 2) THEN split_part(image_txt, ';', 1)
    ELSE image_txt END) AS united FROM q""")
def ordered_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.array(F.lit(" NAVI"), F.concat(F.lit("Shop  "), "source"), F.lit("navi"))
    return listings(spark, sf_dir).select(
        "id",
        F.array_join(enrichment.merge_unique(F.col("equipment"), extra), ";").alias("merged"),
        F.array_join(F.array_union("equipment", "image_urls"), ";").alias("united"))


# --- URLs and images --------------------------------------------------------

HOST = (f"case {K} % 7 when 0 then 'www.kleinanzeigen.de' when 1 then 'WWW.AutoScout24.de' "
        f"when 2 then 'autouncle.de:443' when 3 then 'www.classic-trader.com' "
        f"when 4 then 'suchen.mobile.de' when 5 then 'shop.example' else '' end")
OFFER = (f"concat('https://', {HOST}, case {K} % 4 when 0 then concat('/s-anzeige/x/', "
         f"cast({K} as string), '-216-14') when 1 then concat('/d?id=', cast({K} as string)) "
         f"when 2 then concat('/a-E65B455D-A2CC-4BB9-ADBD-', lpad(cast({K} as string), 12, '0')) "
         f"else '/other' end)")


@registry.add("o_prj_2", f"""SELECT {K} AS order_id, CASE {K} % 7 WHEN 0 THEN 'Kleinanzeigen'
  WHEN 1 THEN 'AutoScout24' WHEN 2 THEN 'AutoUncle' WHEN 3 THEN 'Classic Trader'
  WHEN 4 THEN 'mobile.de' END AS source FROM orders""")
def sources_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(f"{K} AS order_id", f"{OFFER} AS u").select(
        "order_id", identity.identify_source(F.col("u")).alias("source"))


@registry.add("o_prj_3", f"""SELECT {K} AS order_id, CASE {K} % 4 WHEN 0 THEN cast({K} AS varchar)
  WHEN 1 THEN cast({K} AS varchar) WHEN 2 THEN 'e65b455d-a2cc-4bb9-adbd-' || lpad(cast({K} AS varchar), 12, '0')
  END AS token FROM orders""")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(f"{K} AS order_id", f"{OFFER} AS u").select(
        "order_id", identity.identity_token(F.col("u")).alias("token"))


@registry.add("o_prj_4", f"""SELECT {K} AS order_id, CASE {K} % 4 WHEN 0 THEN cast({K} AS varchar)
  ELSE 'ka-' || cast({K} AS varchar) END AS listing_id FROM orders""")
def ids_from_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(f"{K} AS order_id", f"{OFFER} AS u").select(
        "order_id", identity.listing_id_from_url(
            F.col("u"), F.concat(F.lit("ka-"), F.col("order_id").cast("string"))
        ).alias("listing_id"))


AS24 = "https://prod.pictures.autoscout24.net/listing-images/"
KA = "https://img.kleinanzeigen.de/api/v1/prod-ads/images/"
KEY = f"cast({K} % 100 as string)"


@registry.add("o_prj_1", f"""SELECT {K} AS order_id, concat_ws(' ', '{AS24}' || {KEY} || '.jpg/1920x1080.webp',
  '{KA}' || {KEY} || '?rule=$_59.AUTO', CASE WHEN {K} % 100 <> {K} % 7
    THEN '{KA}' || cast({K} % 7 AS varchar) || '?rule=$_59.AUTO' END,
  'https://x.example/' || {KEY} || '/250x188.webp') AS images FROM orders""")
def large_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = (f"array(concat('{AS24}', {KEY}, '.jpg/250x188.webp'), concat('{KA}', {KEY}, "
            f"'?rule=$_2.JPG'), concat('{KA}', cast({K} % 7 as string)), "
            f"concat('https://x.example/', {KEY}, '/250x188.webp'))")
    return table(spark, sf_dir, "orders").selectExpr(f"{K} AS order_id", f"{urls} AS u").select(
        "order_id", F.array_join(identity.large_images(F.col("u")), " ").alias("images"))


# --- exports ----------------------------------------------------------------

@registry.add("o_snk_1", f"""{Q}, s AS ({lq.registry.sql['o_agg_1'][len(Q) + 1:]}),
d AS (SELECT source AS label, count(*) AS n FROM q WHERE NOT hidden GROUP BY 1)
SELECT total_active, new_listings, avg_price_eur, (SELECT string_agg(label || '=' || n, ';'
  ORDER BY n DESC, label) FROM d) AS sources FROM s""")
def feed_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's head; written as JSON and read back."""
    path = work_path(spark, "feed")
    visible = schema.conform(listings(spark, sf_dir).filter("NOT hidden"))
    exports.write_json(visible, path, F.lit(RUN_AT))
    counts = F.transform("sources", lambda e: F.concat(
        e["label"], F.lit("="), e["count"].cast("string")))
    head = spark.read.schema(
        "total_active bigint, new_listings bigint, avg_price_eur int, "
        "sources array<struct<label:string,count:bigint>>").json(f"{path}/summary")
    rows = spark.read.text(f"{path}/listings").agg(F.count("*").alias("n"))
    return head.select(
        rows.scalar().alias("total_active"), "new_listings", "avg_price_eur",
        F.array_join(counts, ";").alias("sources"))


def _csv_sql(c: str) -> str:
    lists = {"inference_notes": "note_txt", "conflict_flags": "''"}
    if c in lists:
        t = lists[c]
        return (f"CASE WHEN {t} = '' THEN '[]' ELSE '[''' || replace({t}, ';', ''', ''') || ''']' END "
                f"AS {c}")
    return c


@registry.add("o_snk_2", f"{Q} SELECT {', '.join(_csv_sql(c) for c in lx.CSV_COLUMNS)} FROM q")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read back."""
    path, rows = work_path(spark, "csv"), schema.conform(listings(spark, sf_dir))
    exports.write_csv(rows, path)
    return spark.read.schema(exports.csv_rows(rows).schema).options(**exports.CSV_OPTIONS).csv(path)


def _line(prefix: str, value: str) -> str:
    return f"'{prefix}' || {value}"


MARKDOWN_SQL = "concat_ws(chr(10), " + ", ".join([
    f"'## ' || rank || '. ' || title || ' — ' || {lq.PRICE_SQL}", "''",
    "CASE WHEN image_txt <> '' THEN '![' || title || '](' || split_part(image_txt, ';', 1) || ')' || chr(10) END",
    _line("- Quelle: ", "source"), "'- Score: ' || score || '/100'",
    f"'- Variante/Motor: ' || {lq.VARIANT_SQL} || ' / ' || {lq.ENGINE_SQL}",
    _line("- PS: ", lq.POWER_SQL), _line("- Getriebe: ", lq.GEAR_SQL),
    _line("- Karosserie: ", f"coalesce(body_style, {lq.NA})"),
    _line("- Motor-Hinweis: ", "(CASE WHEN engine IS NULL THEN engine_note END)"),
    _line("- PS-Hinweis: ", "power_note"),
    _line("- Vermutungen: ", "nullif(note_txt, '')"),
    _line("- Ausstattung (AI): ", "replace(nullif(equip_txt, ''), ';', ', ')"),
    _line("- Kilometer: ", f"coalesce({lq._dots('mileage_km')} || ' km', {lq.NA})"),
    _line("- EZ: ", f"coalesce(first_registration, {lq.NA})"),
    _line("- TÜV/HU: ", f"coalesce(tuv_until, {lq.NA})"),
    _line("- Standort: ", f"coalesce(location_raw, {lq.NA})"),
    _line("- Unfallstatus: ", "accident_status"), _line("- Änderung: ", "change_type"),
    _line("- Risiko-Flags: ", "CASE WHEN risk_txt = '' THEN 'keine' ELSE replace(risk_txt, ';', ', ') END"),
    _line("- Link: ", "url"), "''",
]) + ")"


@registry.add("o_snk_3", f"""{Q}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC,
  coalesce(price_eur, 0) DESC, coalesce(price_eur, 999999999), id) AS rank FROM q)
SELECT cast(rank AS int) AS rank, rtrim(substr({MARKDOWN_SQL}, 4), chr(10)) AS value FROM r
UNION ALL SELECT 0, '# Neue C6 Corvette-Angebote — {RUN_AT}' || chr(10) || chr(10) || 'Aktive Treffer: **' || count(*) || '** · Neu: **'
  || count(*) FILTER (WHERE change_type = 'new') || '** · Preisänderungen: **' || count(*) FILTER (WHERE change_type = 'price_change') || '**' FROM q""")
def markdown_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as text with its head and read back block by block."""
    path = work_path(spark, "feed-text")
    exports.write_markdown(schema.conform(listings(spark, sf_dir)), path, F.lit(RUN_AT))
    return exports.read_blocks(spark, path)
