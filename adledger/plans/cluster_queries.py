"""Checks of duplicates, clustering and cross-fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adledger import lexicon as lx
from adledger.operators import clusters, dedupe
from adledger.operators.skew import has_partner
from adledger.plans.bindings import K, LISTINGS, PAIRS, listings, pairs, sql, table
from adledger.plans.registry import Registry
from adledger.schema import conform

registry = Registry()
Q = f"WITH q AS ({sql(LISTINGS, 'orders')})"
P = f"WITH p AS ({sql(PAIRS, 'orders')})"


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(listings(spark, sf_dir), keep=("pos",))


# --- exact duplicates -------------------------------------------------------

# pages as listings: hosts repeat, so the host stands for a listing URL
HOSTS = {
    "pos": "page_id", "id": "concat('h_', cast(page_id as string))",
    "url": "regexp_extract(url, '^https?://([^/?#]+)', 1)",
    "source_listing_id": "case page_id % 3 when 0 then concat('ka-', cast(page_id as string)) "
                         "when 1 then cast(page_id as string) end",
}


@registry.add("o_win_7", f"""WITH h AS ({sql(HOSTS, 'pages')}), r AS (SELECT *,
  row_number() OVER (PARTITION BY url ORDER BY CASE WHEN source_listing_id IS NULL
    OR source_listing_id LIKE 'ka-%' THEN 0 ELSE 1 END DESC, pos DESC) AS rn,
  min(pos) OVER (PARTITION BY url) AS seen_at FROM h)
SELECT url, id, seen_at AS pos FROM r WHERE rn = 1""")
def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").selectExpr(*[f"{e} AS {n}" for n, e in HOSTS.items()])
    return dedupe.dedupe_urls(hosts).select("url", "id", "pos")


# small overlapping key groups: two ids and two urls meet in every block of five rows
GREEDY = {
    "pos": K, "source": "'Kleinanzeigen'",
    "source_listing_id": f"concat('i', cast(cast(floor({K} / 5) as bigint) as string), '_', "
                         f"cast(({K} * 3 % 5) % 2 as string), cast({K} % 3 as string))",
    "url": f"concat('u', cast(cast(floor({K} / 5) as bigint) as string), '_', "
           f"cast(({K} * 2 % 5) % 3 as string))",
}


@registry.add("o_set_2", f"""WITH RECURSIVE g AS (SELECT *, pos // 5 AS b, pos % 5 AS i
  FROM ({sql(GREEDY, 'orders')})),
w AS (SELECT b, 0 AS i, ['' ] AS ids, [''] AS urls, cast([] AS bigint[]) AS kept FROM g GROUP BY b
  UNION ALL SELECT w.b, w.i + 1,
    CASE WHEN g.pos IS NOT NULL AND NOT list_contains(ids, source_listing_id)
      AND NOT list_contains(urls, url) THEN list_append(ids, source_listing_id) ELSE ids END,
    CASE WHEN g.pos IS NOT NULL AND NOT list_contains(ids, source_listing_id)
      AND NOT list_contains(urls, url) THEN list_append(urls, url) ELSE urls END,
    CASE WHEN g.pos IS NOT NULL AND NOT list_contains(ids, source_listing_id)
      AND NOT list_contains(urls, url) THEN list_append(kept, g.pos) ELSE kept END
  FROM w LEFT JOIN g ON g.b = w.b AND g.i = w.i WHERE w.i < 5)
SELECT unnest(kept) AS pos FROM w WHERE i = 5""")
def greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in GREEDY.items()])
    return dedupe.greedy_distinct(rows).select("pos")


@registry.add("o_set_1", f"""{Q}, p AS ({sql(PAIRS, 'orders')})
SELECT id, source, cast(0 AS int) AS part, pos FROM q UNION ALL SELECT id, source, 1, pos FROM p""")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = listings(spark, sf_dir).select("id", "source", F.lit(0).alias("part"), "pos")
    return first.unionByName(
        pairs(spark, sf_dir).select("id", "source", F.lit(1).alias("part"), "pos"))


# --- keys and cascade -------------------------------------------------------

def _slug(v: str) -> str:
    return (f"trim(regexp_replace(lower(coalesce(nullif({v}, ''), 'unknown')), '[^a-z0-9]+', '-', 'g'),"
            f" '-')")


TRIM_SQL = ("case when coalesce(trim, '') = '' then 'base' "
            "when trim = 'C6 Z06' then 'z06' else lower(trim) end")
BASES = " ".join(f"when '{g}' then '{e}'" for g, e in lx.COLOR_BASES.items())
COLOR_SQL = (f"case when coalesce(exterior_color, '') = '' then 'unknown' "
             f"else case lower(trim(exterior_color)) {BASES} else lower(trim(exterior_color)) end end")
AMOUNTS = ["coalesce(price_eur, 0) // 1000", "coalesce(mileage_km, 0) // 5000"]
LOOKS = [_slug("transmission"), _slug("body_style"), _slug(f"({COLOR_SQL})"),
         "coalesce(nullif(regexp_extract(first_registration, '[0-9]{4}'), ''), '0')",
         "coalesce(power_hp, 0) // 50"]


def _key(*parts: str) -> str:
    return "left(sha1(concat_ws('|', " + ", ".join(parts) + ")), 12)"


def _keys(trim_key: str) -> dict[str, str]:
    e, loc = _slug("engine"), _slug("location_raw")
    return {
        "full": _key(e, trim_key, loc, *AMOUNTS, *LOOKS),
        "no_trim": _key(e, loc, *AMOUNTS, *LOOKS),
        "no_loc": _key(e, trim_key, *AMOUNTS, *LOOKS),
        "no_eng": _key(trim_key, loc, *AMOUNTS, *LOOKS),
        "legacy": _key(e, trim_key, loc, *AMOUNTS),
    }


KEYS = _keys(_slug(f"({TRIM_SQL})"))
KEYED = ", k AS (SELECT p.*, " + ", ".join(f'{v} AS k_{n}' for n, v in KEYS.items()) + " FROM p)"


@registry.add("o_clu_1", f"""{P} SELECT id, {_slug('location_raw')} AS place,
  {COLOR_SQL} AS color, {TRIM_SQL} AS trim_key,
  coalesce(nullif(regexp_extract(first_registration, '[0-9]{{4}}'), ''), '0') AS year FROM p""")
def normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select(
        "id", clusters.slug(F.col("location_raw")).alias("place"),
        clusters.color_base(F.col("exterior_color")).alias("color"),
        clusters.match_trim(F.col("trim")).alias("trim_key"),
        clusters.match_year(F.col("first_registration")).alias("year"))


@registry.add("o_clu_2", f"""{P}{KEYED} SELECT id, k_full AS full, k_no_trim AS no_trim,
  k_no_loc AS no_loc, k_no_eng AS no_eng, k_legacy AS legacy FROM k""")
def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.with_match_keys(pairs(spark, sf_dir)).select("id", *lx.KEY_LEVELS)


def _cascade_sql() -> str:
    steps = [KEYED[2:], """c_vin AS (SELECT *, CASE WHEN vin IS NOT NULL
      AND count(*) OVER (PARTITION BY vin) > 1 THEN 'vin_' || lower(vin) END AS cluster FROM k)"""]
    last = "c_vin"
    for level in lx.KEY_LEVELS:
        steps.append(f"""c_{level} AS (SELECT * REPLACE (coalesce(cluster, CASE WHEN count(*)
          FILTER (WHERE cluster IS NULL) OVER (PARTITION BY k_{level}) > 1
          THEN 'soft_{level}_' || k_{level} END) AS cluster) FROM {last})""")
        last = f"c_{level}"
    return f"{P}, " + ", ".join(steps)


CASCADE = _cascade_sql()


@registry.add("o_clu_3", f"{CASCADE} SELECT id, cluster AS cluster_id FROM c_legacy")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = clusters.with_match_keys(pairs(spark, sf_dir)).select(
        "pos", "id", "vin", *lx.KEY_LEVELS)
    return clusters.cascade(keyed).select("id", "cluster_id")


@registry.add("o_win_9", f"""{P}{KEYED} SELECT id, count(*) OVER (PARTITION BY k_legacy) > 1 AS paired
FROM k""")
def partner_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = clusters.with_match_keys(pairs(spark, sf_dir)).select("pos", "id", "legacy")
    steps, paired = has_partner(F.col("legacy"), "pos")
    return keyed.withColumns(steps).select("id", paired.alias("paired"))


# the stored side: every pair's even row, under a manual cluster for half of the pairs
STORED = {
    "id": "concat('s_', id)", "title": "title", "price_eur": "price_eur",
    "mileage_km": "mileage_km", "power_hp": "power_hp", "engine": "engine", "trim": "trim",
    "location_raw": "location_raw", "transmission": "transmission", "body_style": "body_style",
    "exterior_color": "exterior_color", "first_registration": "first_registration",
    "cluster_id": "case cast(floor(pos / 2) as bigint) % 2 when 0 then concat('manual_', id) "
                  "else concat('old_', id) end",
}
STORED_SQL = "st AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in STORED.items()) + \
    " FROM p WHERE source = 'AutoScout24')"
LABELS = [*lx.KEY_LEVELS, "title"]
TITLE_KEY = (f"concat_ws('|', {_slug('title')}, coalesce(price_eur, 0) // 1000, "
             f"coalesce(mileage_km, 0) // 5000)")
POOL = ", ".join([
    STORED_SQL,
    "sk AS (SELECT *, " + ", ".join(f"{v} AS k_{n}" for n, v in KEYS.items())
    + f", {TITLE_KEY} AS k_title FROM st)",
    "pool AS (" + " UNION ALL ".join(
        f"SELECT {i} AS r, k_{n} AS key, arg_min(cluster_id, "
        f"(CASE WHEN cluster_id LIKE 'manual_%' THEN '0' ELSE '1' END) || lpad(cast(coalesce("
        f"price_eur, 999999999) AS varchar), 12, '0') || id) AS cluster FROM sk GROUP BY 2"
        for i, n in enumerate(LABELS)) + ")",
])
# the fresh side: odd rows only, so that no two of them pair up among themselves
FRESH = ("fk AS (SELECT *, " + ", ".join(f"{v} AS k_{n}" for n, v in KEYS.items())
         + f", {TITLE_KEY} AS k_title FROM p WHERE source = 'Kleinanzeigen'), "
         "fl AS (" + " UNION ALL ".join(
             f"SELECT id, {i} AS r, k_{n} AS key FROM fk" for i, n in enumerate(LABELS)) + ")")
ADOPTED = f"""{P}, {POOL}, {FRESH}, hit AS (SELECT fl.id, arg_min(cluster, fl.r) AS cluster
  FROM fl JOIN pool ON pool.r = fl.r AND pool.key = fl.key GROUP BY 1)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = pairs(spark, sf_dir)
    stored = both.filter("source = 'AutoScout24'").selectExpr(
        *[f"{e} AS {n}" for n, e in STORED.items()])
    return both.filter("source = 'Kleinanzeigen'"), stored


@registry.add("o_jon_4", f"""{ADOPTED} SELECT fk.id, hit.cluster AS cluster_id
FROM fk LEFT JOIN hit USING (id)""")
def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh, stored = _sides(spark, sf_dir)
    keyed = clusters.with_match_keys(fresh, title=True).select(
        "pos", "id", F.lit(None).cast("string").alias("cluster_id"), *LABELS)
    return clusters.adopt(keyed, stored).select("id", "cluster_id")


ALL_FRESH = FRESH.replace(" WHERE source = 'Kleinanzeigen'", "")


@registry.add("o_clu_4", f"""{CASCADE}, {POOL}, {ALL_FRESH}, hit AS (SELECT fl.id, arg_min(cluster, fl.r) AS cluster
  FROM fl JOIN pool ON pool.r = fl.r AND pool.key = fl.key GROUP BY 1)
SELECT c.id, coalesce(c.cluster, hit.cluster, 'singleton_' || k_full) AS cluster_id FROM c_legacy c LEFT JOIN hit USING (id)""")
def clusters_against_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole assignment: pairs by the cascade, what is left by the pool, the rest alone."""
    _, stored = _sides(spark, sf_dir)
    return clusters.assign_clusters(pairs(spark, sf_dir), stored).select("id", "cluster_id")


# --- inside clusters --------------------------------------------------------

@registry.add("o_clu_7", f"""{Q} SELECT id, CASE WHEN cluster_id IS NULL THEN score
  ELSE max(score) OVER (PARTITION BY cluster_id) END AS score FROM q""")
def best_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.enrich_clusters(_full(spark, sf_dir)).select("id", "score")


LISTS = {"risk_flags": "risk_txt", "image_urls": "image_txt", "equipment": "equip_txt",
         "inference_notes": "note_txt"}
ITEMS_SQL = "i AS (" + " UNION ALL ".join(
    f"SELECT cluster_id, pos, '{f}' AS field, unnest(string_split({t}, ';')) AS item, "
    f"generate_subscripts(string_split({t}, ';'), 1) - 1 AS idx FROM q "
    f"WHERE {t} <> '' AND cluster_id IS NOT NULL" for f, t in LISTS.items()) + ")"


@registry.add("o_agg_11", f"""{Q}, {ITEMS_SQL} SELECT cluster_id, field, item,
  min(pos) AS first_pos, cast(arg_min(idx, pos * 100 + idx) AS int) AS first_idx
FROM i GROUP BY 1, 2, 3""")
def merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.merged_items(_full(spark, sf_dir))


BEST = f"""{Q}, f AS (SELECT id AS fid, filled FROM (SELECT id, cast({{filled}} AS int) AS filled FROM q)),
b AS (SELECT q.*, row_number() OVER (PARTITION BY cluster_id ORDER BY filled DESC, score DESC, pos) AS rk,
  count(*) OVER (PARTITION BY cluster_id) AS members FROM q JOIN f ON id = fid)"""
FILLED_SQL = " + ".join(
    [f"({c} IS NOT NULL)::int" for c in lx.CROSS_FILL_FIELDS
     if c in LISTINGS and c not in ("exterior_color", "accident_status")]
    + ["(coalesce(exterior_color, '') <> '')::int", "(accident_status <> 'unbekannt')::int"]
    + [f"CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, ';')) END" for t in LISTS.values()])
_PLAIN = ["price_label", "engine", "probable_engine", "engine_confidence", "engine_note",
          "power_hp", "estimated_power_hp", "power_note", "trim", "first_registration", "tuv_until",
          "transmission", "body_style", "location_raw", "vin", "description_text",
          "accident_status", "damage", "has_damage", "eu_spec"]


def _own(c: str, prefix: str = "") -> str:
    if c == "accident_status":
        return f"nullif({prefix}{c}, 'unbekannt')"
    return f"nullif({prefix}{c}, '')" if c.endswith("color") else f"{prefix}{c}"


# per cluster: best's own value, else the first known one by position
_FINAL = ", ".join(
    f"coalesce(max({_own(c)}) FILTER (WHERE rk = 1), "
    f"arg_min({_own(c)}, pos) FILTER (WHERE {_own(c)} IS NOT NULL)) AS z_{c}"
    for c in [*_PLAIN, "exterior_color", "interior_color"])
_BASE = "case lower(trim({c})) " + BASES + " else lower(trim({c})) end"
CROSS = BEST.replace("{filled}", FILLED_SQL) + f""", z AS (SELECT cluster_id, {_FINAL},
  min(price_eur) AS z_price, min(mileage_km) FILTER (WHERE mileage_km > 0) AS z_min_km,
  coalesce(max(mileage_km) FILTER (WHERE rk = 1),
    arg_min(mileage_km, pos) FILTER (WHERE mileage_km IS NOT NULL)) AS z_anchor
  FROM b WHERE cluster_id IS NOT NULL GROUP BY 1),
l AS (SELECT cluster_id, {", ".join(
    f"arg_min({c}, -length({c}) * 1000000000 + pos) FILTER (WHERE coalesce({c}, '') <> '' AND "
    f"{_BASE.format(c=c)} = {_BASE.format(c='z_' + c)}) AS long_{c}"
    for c in ("exterior_color", "interior_color"))} FROM b JOIN z USING (cluster_id) GROUP BY 1)"""


def _color_out(c: str) -> str:
    best = f"(CASE WHEN length(long_{c}) > length(z_{c}) THEN long_{c} ELSE z_{c} END)"
    own = f"nullif({c}, '')"
    keep = (f"{own} IS NOT NULL AND NOT ({_BASE.format(c=c)} = {_BASE.format(c=best)} "
            f"AND length({best}) > length({own}))")
    return f"CASE WHEN {keep} THEN {c} ELSE coalesce({best}, {c}) END"


_SHARED = "b.cluster_id IS NOT NULL AND members >= 2"
_KM = """CASE WHEN rk = 1 OR mileage_km IS NULL THEN CASE WHEN z_anchor <= 0 THEN z_anchor ELSE z_min_km END
  WHEN mileage_km > 0 AND z_anchor > 0 THEN least(mileage_km, z_min_km) ELSE mileage_km END"""


@registry.add("o_clu_6", f"""{CROSS} SELECT b.id,
  CASE WHEN {_SHARED} THEN z_price ELSE price_eur END AS price_eur,
  CASE WHEN {_SHARED} THEN {_KM} ELSE mileage_km END AS mileage_km,
  {", ".join(f"CASE WHEN {_SHARED} THEN coalesce({_own(c)}, z_{c}, {c}) ELSE {c} END AS {c}" for c in _PLAIN)},
  {", ".join(f"CASE WHEN {_SHARED} THEN {_color_out(c)} ELSE {c} END AS {c}"
             for c in ("exterior_color", "interior_color"))}
FROM b LEFT JOIN z ON b.cluster_id = z.cluster_id LEFT JOIN l ON b.cluster_id = l.cluster_id""")
def cross_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.enrich_clusters(_full(spark, sf_dir)).select(
        "id", "price_eur", "mileage_km", *_PLAIN, "exterior_color", "interior_color")


@registry.add("o_clu_8", f"""{Q} SELECT id, CASE WHEN source = 'AutoUncle' THEN NULL
  WHEN source = 'AutoScout24' THEN 'manual_' || md5(cast(pos // 100 AS varchar))
  ELSE cluster_id END AS cluster_id FROM q""")
def manual_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = listings(spark, sf_dir)
    merges = state.filter("source = 'AutoScout24'").select(
        F.col("id").alias("listing_id"),
        F.md5(F.floor(F.col("pos") / 100).cast("string").cast("binary")).alias("group_id"))
    split = state.filter("source = 'AutoUncle'").select(F.col("id").alias("listing_id"))
    return clusters.unmerge(clusters.merge_manually(state, merges), split).select(
        "id", "cluster_id")


@registry.add("o_jon_9", f"""SELECT DISTINCT 'q_' || cast(l_orderkey + 3 AS varchar) AS id
FROM lineitem WHERE 'q_' || cast(l_orderkey + 3 AS varchar) NOT IN
  (SELECT 'q_' || cast(o_orderkey AS varchar) FROM orders)""")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('q_', cast(l_orderkey + 3 as string)) AS listing_id")
    return clusters.unknown_ids(requested, listings(spark, sf_dir))

