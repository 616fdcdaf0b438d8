"""Checks of page extraction and availability.

Most pages are composed from orders, one page per order, so that the SQL side can
state what must be found; the given page table serves where its markup suffices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adledger import lexicon as lx
from adledger import schema
from adledger.functions import availability as rules
from adledger.functions.identity import first_per_base
from adledger.operators import availability, state
from adledger.operators.normalize import normalize_listings
from adledger.plans.bindings import K, LISTINGS, listings, project, sql, table
from adledger.plans.registry import Registry
from adledger.session import dealt
from adledger.sources import cards
from adledger.sources.markup import Tree, with_markup
from adledger.sources.pages import (
    detail_updates, extract_listings, split_pages, structured_override,
)

registry = Registry()
ID = f"cast({K} as string)"
KM = f"(20000 + {K} % 90000)"
PRICE = f"(10000 + {K} % 80000)"


def composed(spark: SparkSession, sf_dir: str, source: str, url: str, body: str) -> DataFrame:
    """Captured pages made from orders; ``url`` and ``body`` are SQL expressions."""
    return dealt(table(spark, sf_dir, "orders")).selectExpr(
        f"{K} AS page_no", f"'{source}' AS source", f"{url} AS url", "200 AS http_status",
        "cast(null as string) AS location_header", "cast(null as string) AS server_header",
        f"{body} AS body")


def _show_cards(df: DataFrame) -> DataFrame:
    return df.select(
        "page_no", "source_listing_id", "url", "title", "price_text", "location_raw",
        F.array_join("image_urls", " ").alias("images"))


# --- the given page table ---------------------------------------------------

CAPTURED = {
    "page_no": "page_id", "url": "url",
    "source": "case page_id % 3 when 0 then 'Kleinanzeigen' when 1 then 'mobile.de' else 'other' end",
    "http_status": "case page_id % 11 when 3 then null when 5 then 404 when 7 then 403 else 200 end",
    "server_header": "case page_id % 2 when 1 then 'Cloudflare' end",
    "body": "case page_id % 13 when 4 then '' else html end",
}
PROBLEM_SQL = """CASE WHEN http_status IS NULL THEN 'fetch failed'
  WHEN http_status = 403 AND server_header IS NOT NULL THEN 'blocked'
  WHEN http_status <> 200 THEN 'HTTP ' || http_status WHEN body = '' THEN 'empty page' END"""


@registry.add("o_src_1", f"""WITH c AS ({sql(CAPTURED, 'pages')})
SELECT source, url, {PROBLEM_SQL} AS problem FROM c WHERE source <> 'other'""")
def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = project(table(spark, sf_dir, "pages"), CAPTURED)
    good, bad = split_pages(pages, [lx.KLEINANZEIGEN, lx.MOBILE_DE])
    return good.select("source", "url", F.lit(None).cast("string").alias("problem")).unionByName(bad)


@registry.add("o_udf_2", """SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  cast(len(regexp_extract_all(html, '<li>')) AS int) AS items,
  cast(len(regexp_extract_all(html, '<a href=')) AS int) AS links,
  trim(regexp_extract(html, '<li><a href="[^"]*">([^<]*)<', 1)) AS first_link FROM pages""")
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = with_markup(table(spark, sf_dir, "pages"), "html")
    tree = Tree(F.col("nodes"))
    return marked.select(
        "page_id",
        F.try_element_at(tree.first(lambda n: n["tag"] == "html")["attrs"], F.lit("lang"))
        .alias("lang"),
        F.size(tree.all(lambda n: n["tag"] == "li")).alias("items"),
        F.size(tree.all(lambda n: n["tag"] == "a")).alias("links"),
        tree.text(tree.first(lambda n: n["tag"] == "a")).alias("first_link"))


@registry.add("o_src_13", r"""SELECT DISTINCT page_id AS page_no,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) || link AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS link FROM pages)""")
def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of the same host."""
    pages = table(spark, sf_dir, "pages").selectExpr("page_id AS page_no", "url", "html AS body")
    return cards.page_links(
        pages, r'href="(/[^"]*)"',
        lambda link, page: cards.authority(link) == cards.authority(page),
    ).select("page_no", "link")


@registry.add("o_src_12", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS u,
  generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS i FROM pages),
d AS (SELECT page_id, split_part(u, '?', 1) AS base, arg_min(u, i) AS u, min(i) AS i FROM l GROUP BY 1, 2)
SELECT page_id, string_agg(u, ' ' ORDER BY i) AS links FROM d GROUP BY 1""")
def first_per_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gallery's rule (first address per image, query ignored) on the pages' links."""
    urls = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.array_join(first_per_base(urls), " ").alias("links"))


# --- embedded application JSON ----------------------------------------------

# even orders: search page with two offers, odd ones: a detail page
OFFER_JSON = """to_json(named_struct('id', {id}, 'url', '/angebote/{tag}',
  'images', array('https://prod.pictures.autoscout24.net/listing-images/a.jpg/250x188.webp'),
  'price', named_struct('priceRaw', {raw}, 'priceFormatted', concat('€ ', cast({price} as string))),
  'location', named_struct('zip', '80331', 'city', 'München'),
  'vehicle', named_struct('make', 'Chevrolet', 'model', 'Corvette', 'modelVersionInput', 'C6 Z06',
    'mileageInKmRaw', {km}, 'nested', named_struct('a', 1), 'used', true),
  'vehicleDetails', array(named_struct('label', 'Getriebe', 'data', 'Schaltgetriebe'),
    named_struct('label', 'Leer', 'data', cast(null as string)))))"""


def _offer(tag: str, id_: str, raw: str) -> str:
    return OFFER_JSON.format(tag=tag, id=id_, raw=raw, price=PRICE, km=KM)


APP_PAGE = f"""concat('<html><script id="__NEXT_DATA__" type="application/json">{{"props":{{"pageProps":',
  case {K} % 4 when 3 then 'broken' when 1 then concat('{{"listingDetails":', {_offer('d', f"concat('d', {ID})", PRICE + ' + 7')}, '}}')
  else concat('{{"listings":[', {_offer('a', f"concat('a', {ID})", '0')}, ',',
    {_offer('b', f"concat('b', {ID})", PRICE + ' + 9')}, ']}}') end, '}}}}</script></html>')"""
APP_URL = f"concat('https://www.autoscout24.de/lst/', {ID})"
APP_SQL = f"""WITH a AS (SELECT {K} AS page_no, {K} % 4 AS m, {PRICE} AS p, {KM} AS km FROM orders),
o AS (SELECT *, 'a' AS tag, 0 AS plus FROM a WHERE m IN (0, 2) UNION ALL
  SELECT *, 'b', 9 FROM a WHERE m IN (0, 2) UNION ALL SELECT *, 'd', 7 FROM a WHERE m = 1)"""


@registry.add("o_src_4", f"""{APP_SQL} SELECT page_no, tag || page_no AS source_listing_id,
  'https://www.autoscout24.de/angebote/' || tag AS url, 'Chevrolet Corvette C6 Z06' AS title,
  concat('Chevrolet Corvette C6 Z06 Getriebe Schaltgetriebe Leer Chevrolet Corvette C6 Z06 ', km,
    ' True 80331 München') AS description,
  '€ ' || p AS price_text, '80331 München' AS location_raw,
  'https://prod.pictures.autoscout24.net/listing-images/a.jpg/1920x1080.webp' AS images FROM o""")
def app_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = composed(spark, sf_dir, lx.AUTOSCOUT24, APP_URL, APP_PAGE)
    return cards.app_json_cards(pages).select(
        "page_no", "source_listing_id", "url", "title", "description", "price_text",
        "location_raw", F.array_join("image_urls", " ").alias("images"))


@registry.add("o_src_5", f"""{APP_SQL} SELECT page_no, tag || page_no AS source_listing_id,
  cast(p + plus AS int) AS price_eur, cast(km AS int) AS mileage_km FROM o""")
def structured_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structured price wins (0 is none); the structured mileage fills the gap."""
    pages = composed(spark, sf_dir, lx.AUTOSCOUT24, APP_URL, APP_PAGE)
    normalized = normalize_listings(
        cards.app_json_cards(pages), keep=("page_no", "raw_price", "raw_mileage"))
    return structured_override(normalized).select(
        "page_no", "source_listing_id", "price_eur", "mileage_km")


# --- card pages -------------------------------------------------------------

ARTICLES = f"""concat('<body><article><p>Porsche</p><a href="/x">X</a></article>',
  '<article ', case {K} % 2 when 0 then concat('id="n', {ID}, '"') else '' end, '>',
  '<a href="/info">Info</a><h2>Corvette <b>C6</b></h2><a href="/angebote/', {ID}, '">zum Angebot</a>',
  '<script>var c6 = 1;</script><!-- EUR --><span>', cast({PRICE} as string), ' €</span><p>in köln</p>',
  '<img src="data:x"><img data-src="/i/1.jpg"><img src="/i/1.jpg"><br></article></body>')"""


@registry.add("o_src_6", f"""SELECT {K} AS page_no, CASE {K} % 2 WHEN 0 THEN 'n' || {ID} ELSE 'as24-1' END
    AS source_listing_id, 'https://www.autoscout24.de/angebote/' || {ID} AS url,
  'Info' AS title, {PRICE} || ' €' AS price_text, 'Köln' AS location_raw,
  'https://www.autoscout24.de/i/1.jpg' AS images FROM orders""")
def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = composed(spark, sf_dir, lx.AUTOSCOUT24, APP_URL, ARTICLES)
    return _show_cards(cards.as24_cards(pages))


RESULTS = f"""concat('<div data-testid="result-', {ID}, '"><h3>Corvette C6</h3>',
  '<a href="details.html?id=', {ID}, '">Details</a> ', cast({PRICE} as string), ' €</div>',
  '<div class="x vehicle-data-box" id="b', {ID}, '"><a href="../auto-inserat/', {ID}, '">C6 Targa</a></div>',
  '<div class="other">Corvette</div>')"""


@registry.add("o_src_6_results", f"""SELECT {K} AS page_no, 'result-' || {ID} AS source_listing_id,
  'https://suchen.mobile.de/fahrzeuge/details.html?id=' || {ID} AS url, 'Corvette C6' AS title,
  'Corvette C6 Details ' || {PRICE} || ' €' AS price_text, '' AS location_raw, '' AS images FROM orders
UNION ALL SELECT {K}, 'b' || {ID}, 'https://suchen.mobile.de/auto-inserat/' || {ID}, 'C6 Targa',
  'C6 Targa', '', '' FROM orders""")
def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = composed(
        spark, sf_dir, lx.MOBILE_DE, "'https://suchen.mobile.de/fahrzeuge/search.html?a=1'", RESULTS)
    return _show_cards(cards.result_cards(pages))


# three layouts: marked articles, plain articles, list items
AD = f"""concat('{{open}} data-adid="{{tag}}', {ID}, '"><h2><a href="/s-anzeige/{{tag}}/', {ID}, '-216-9">',
  'Corvette C6 {{tag}}</a></h2><p class="ad-price--main">', cast({PRICE} as string), ' € VB</p>',
  '<div class="main--description">mit &amp; ohne</div><div class="main--top--left">Ort ', {ID}, '</div>',
  '<img data-imgsrc="https://img.kleinanzeigen.de/api/v1/prod-ads/images/', {ID}, '?rule=$_2.JPG">{{close}}')"""


def _ad(tag: str, open_: str, close: str) -> str:
    return AD.format(tag=tag, open=open_, close=close)


MARKED = _ad("a", '<article class="x aditem"', "</article>")
PLAIN = _ad("b", "<article", "</article>")
ITEM = _ad("c", '<li class="ad-listitem"', "</li>")
AD_PAGE = f"case {K} % 3 when 0 then concat({PLAIN}, {MARKED}) when 1 then {PLAIN} else {ITEM} end"
KA_URL = "'https://www.kleinanzeigen.de/s-autos/c6/k0'"
AD_COLUMNS = f"""{K} AS page_no, t || {ID} AS source_listing_id,
  'https://www.kleinanzeigen.de/s-anzeige/' || t || '/' || {ID} || '-216-9' AS url,
  'Corvette C6 ' || t AS title, {PRICE} || ' € VB' AS price_text, 'Ort ' || {ID} AS location_raw,
  'https://img.kleinanzeigen.de/api/v1/prod-ads/images/' || {ID} || '?rule=$_59.AUTO' AS images"""


@registry.add("o_src_7", f"""SELECT {AD_COLUMNS} FROM (SELECT *, CASE {K} % 3 WHEN 0 THEN 'a'
  WHEN 1 THEN 'b' ELSE 'c' END AS t FROM orders)""")
def ad_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show_cards(cards.ad_cards(composed(spark, sf_dir, lx.KLEINANZEIGEN, KA_URL, AD_PAGE)))


# no card elements at all; the last segment runs to the end of the page
SEGMENTS = f"""concat('<div><h2 class="t"><a class="l" href="/s-anzeige/one/', {ID}, '-216-1">Corvette <i>C6</i></a></h2>',
  cast({PRICE} as string), ' € eins<h2> <a href="/s-anzeige/two">C6 zwei</a> </h2>', repeat('x', 2900),
  ' nah ', repeat('y', 200), ' fern</div>')"""


@registry.add("o_src_8", f"""SELECT {K} AS page_no, cast({ID} AS varchar) AS source_listing_id,
  'https://www.kleinanzeigen.de/s-anzeige/one/' || {ID} || '-216-1' AS url, 'Corvette C6' AS title,
  'Corvette C6 ' || {PRICE} || ' € eins' AS price_text FROM orders
UNION ALL SELECT {K}, 'ka-fallback-1', 'https://www.kleinanzeigen.de/s-anzeige/two', 'C6 zwei',
  'C6 zwei ' || repeat('x', 2900) || ' nah ' || repeat('y', 200) || ' fern' FROM orders""")
def segment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = composed(spark, sf_dir, lx.KLEINANZEIGEN, KA_URL, SEGMENTS)
    return cards.ad_segment_cards(pages).select(
        "page_no", "source_listing_id", "url", "title", "price_text")


AGGREGATED = f"""concat('<article><a href="/de/d/', {ID}, '/">Gebraucht Corvette C6 | 437 PS</a>',
  '<b class="p _i2QOc">', cast({PRICE} as string), '&nbsp;€</b>',
  '<div class="_v1SHB"><img src="/img/', {ID}, '.jpg"></div><img src="/other.jpg"></article>',
  '<article><a href="/de/d/', {ID}, '/">Corvette again</a></article>',
  '<article><a href="/de/d/zz">Porsche</a></article><article>kein Link</article>')"""


@registry.add("o_src_9", f"""SELECT {K} AS page_no, cast({ID} AS varchar) AS source_listing_id,
  'https://www.autouncle.de/de/d/' || {ID} || '/' AS url, 'Corvette C6' AS title,
  {PRICE} || ' €' AS price_text, '' AS location_raw,
  'https://www.autouncle.de/img/' || {ID} || '.jpg' AS images FROM orders""")
def aggregator_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = composed(
        spark, sf_dir, lx.AUTOUNCLE, "'https://www.autouncle.de/de/gebrauchtwagen'", AGGREGATED)
    return _show_cards(cards.aggregator_cards(pages))


LINKED = f"""concat('<script type="application/ld+json">{{"@type":"ItemList","itemListElement":[',
  '{{"@type":"ListItem","item":{{"@type":"Vehicle","name":"Corvette C6 ', {ID}, '","url":"/de/a/', {ID}, '",',
  '"image":["/1.jpg","/2.jpg"],"offers":[{{"price":', cast({PRICE} as string), '}}],"description":"Z06"}}}},',
  '{{"@type":"Car","headline":"Corvette C6","url":"https://x.example/c/', {ID}, '/","image":"/3.jpg",',
  '"offers":{{"price":"', cast({PRICE} + 1 as string), '"}}}},',
  '{{"@type":"Car","name":"again","url":"/de/a/', {ID}, '"}},{{"@type":"Person","name":"P","url":"/p"}}]}}</script>',
  '<script type="application/ld+json">not json</script>')"""


@registry.add("o_src_10", f"""SELECT {K} AS page_no, {ID} AS source_listing_id,
  'https://www.classic-trader.com/de/a/' || {ID} AS url, 'Corvette C6 ' || {ID} AS title,
  cast({PRICE} AS varchar) AS price_text, '' AS location_raw, '/1.jpg /2.jpg' AS images FROM orders
UNION ALL SELECT {K}, {ID}, 'https://x.example/c/' || {ID} || '/', 'Corvette C6',
  cast({PRICE} + 1 AS varchar), '', '/3.jpg' FROM orders""")
def linked_data_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = composed(
        spark, sf_dir, lx.CLASSIC_TRADER, "'https://www.classic-trader.com/de/automobile'", LINKED)
    return _show_cards(cards.linked_data_cards(pages))


# --- detail pages -----------------------------------------------------------

DETAIL = f"""concat('<h1>Corvette C6</h1>', case {K} % 2 when 0 then concat('<h2 id="viewad-price">',
    cast({PRICE} as string), ' €</h2>') else '<span class="oldprice">alt</span><b class="price">VB</b>' end,
  '<ul><li class="addetailslist--detail">Kilometerstand<span class="v"> ', cast({KM} as string), ' km</span></li>',
  '<li class="addetailslist--detail"><span>Getriebe</span><span>Manuell</span></li>',
  '<li class="addetailslist--detail">Unbekannt</li></ul>',
  '<dl><dt>getriebe</dt><dd>manuell</dd><dt>Leistung</dt><dd>437 PS</dd></dl>',
  '<img srcset="{{ka}}1?rule=$_35.JPG 1x, {{ka}}2 2x"><script>var g=["{{ka}}1?rule=$_57.JPG","{{ka}}3"];</script>')"""
DETAIL = DETAIL.replace("{ka}", "https://img.kleinanzeigen.de/api/v1/prod-ads/images/")
DETAIL_URL = f"concat('https://www.ads.example/offer/', {ID})"
FACTS_SQL = f"'Kilometerstand ' || {KM} || ' km Getriebe Manuell Leistung 437 PS'"
GALLERY_SQL = " || ' ' || ".join(
    f"'https://img.kleinanzeigen.de/api/v1/prod-ads/images/{i}?rule=$_59.AUTO'" for i in (1, 2, 3))


@registry.add("o_src_11", f"""SELECT {K} AS page_no, CASE {K} % 2 WHEN 0 THEN {PRICE} || ' €' ELSE 'VB' END
  AS price_text, {FACTS_SQL} AS facts_text, {GALLERY_SQL} AS images FROM orders""")
def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = composed(spark, sf_dir, lx.KLEINANZEIGEN, DETAIL_URL, DETAIL)
    return cards.detail_facts(pages).select(
        "page_no", "price_text", "facts_text", F.array_join("detail_images", " ").alias("images"))


PAGE_LINKS = f"""concat('<a href="/s-autos/seite:2/', {ID}, '">2</a><a href="/s-autos/seite:2/', {ID}, '">2</a>',
  '<link rel="next" href="/s-autos/seite:3/k?a=1&amp;b=2"><a href="https://elsewhere.example/s-autos/seite:4">4</a>',
  '<a href="/s-anzeige/s-autos/seite:5">5</a>')"""


@registry.add("o_src_13_pagination", f"""SELECT {K} AS page_no, 'https://www.kleinanzeigen.de/s-autos/seite:2/' || {ID}
  AS link, cast(0 AS int) AS pos FROM orders UNION ALL SELECT {K},
  'https://www.kleinanzeigen.de/s-autos/seite:3/k?a=1&b=2', 1 FROM orders""")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = composed(spark, sf_dir, lx.KLEINANZEIGEN, KA_URL, PAGE_LINKS)
    return cards.pagination_links(pages).select("page_no", "link", "pos")


@registry.add("o_jon_7", f"""WITH q AS ({sql(LISTINGS, 'orders')})
SELECT id, CASE pos % 2 WHEN 0 THEN cast(10000 + pos % 80000 AS int) ELSE price_eur END AS price_eur,
  CASE pos % 2 WHEN 0 THEN price_label ELSE 'VB' END AS price_label,
  cast(20000 + pos % 90000 AS int) AS mileage_km, 437 AS power_hp, 'manual' AS transmission,
  'Base' AS trim, 'LS3' AS probable_engine, {GALLERY_SQL} AS images FROM q""")
def detail_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schema.conform(listings(spark, sf_dir))
    pages = composed(spark, sf_dir, lx.KLEINANZEIGEN, DETAIL_URL, DETAIL).select("url", "body")
    return state.merge_detail(rows, detail_updates(rows, pages)).select(
        "id", "price_eur", "price_label", "mileage_km", "power_hp", "transmission", "trim",
        "probable_engine", F.array_join("image_urls", " ").alias("images"))


@registry.add("o_jon_8", f"""WITH q AS ({sql(LISTINGS, 'orders')}), d AS (SELECT l_orderkey, max(l_quantity) AS qty,
  count(*) AS n FROM lineitem GROUP BY 1)
SELECT id, CASE WHEN n % 2 = 0 THEN 'https://new.example/' || pos ELSE url END AS url,
  CASE WHEN n > 3 THEN cast(qty * 1000 AS int) ELSE price_eur END AS price_eur,
  CASE WHEN n IS NOT NULL THEN 'fresh title' ELSE title END AS title, mileage_km,
  CASE WHEN n % 3 = 0 THEN 'new.jpg' ELSE replace(image_txt, ';', ' ') END AS images
FROM q LEFT JOIN d ON l_orderkey = pos""")
def rescrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_quantity").alias("qty"), F.count("*").alias("n"))
    key = F.col("l_orderkey").cast("string")
    fresh = fresh.select(
        F.concat(F.lit("q_"), key).alias("id"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("https://new.example/"), key))
        .otherwise(F.lit("")).alias("url"),
        F.lit("fresh title").alias("title"), F.lit(None).cast("string").alias("description_text"),
        F.when(F.col("n") > 3, (F.col("qty") * 1000).cast("int")).alias("price_eur"),
        F.lit(None).cast("int").alias("mileage_km"),
        F.when(F.col("n") % 3 == 0, F.array(F.lit("new.jpg")))
        .otherwise(F.array().cast("array<string>")).alias("image_urls"))
    rows = schema.conform(listings(spark, sf_dir))
    return state.merge_rescrape(rows, fresh).select(
        "id", "url", "price_eur", "title", "mileage_km",
        F.array_join("image_urls", " ").alias("images"))


# --- the whole extraction job -----------------------------------------------

@registry.add("o_src_7_listings", f"""WITH a AS (SELECT *, CASE {K} % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END
  AS t FROM orders), u AS (SELECT {K} AS k, t FROM a UNION ALL SELECT {K}, 'b' FROM a WHERE t = 'a')
SELECT 'kleinanzeigen_' || left(sha1(CASE WHEN t = 'b' AND k % 3 = 0 THEN cast(k AS varchar) ELSE t || k END), 10)
  AS id, 'https://www.kleinanzeigen.de/s-anzeige/' || t || '/' || k || '-216-9' AS url,
  cast(10000 + k % 80000 AS int) AS price_eur, 'VB' AS price_label FROM u""")
def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of every classifieds page, normalized and made distinct: an ad that
    only the heading reading finds (a plain article beside a marked one) is added once."""
    pages = composed(spark, sf_dir, lx.KLEINANZEIGEN, KA_URL, AD_PAGE)
    return extract_listings(pages).select("id", "url", "price_eur", "price_label")


# --- availability -----------------------------------------------------------

@registry.add("o_src_14", f"""SELECT {K} AS order_id, {K} % 6 IN (0, 2, 3) AS blocked FROM orders""")
def block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = (f"case {K} % 6 when 0 then 'Just a moment... challenges.cloudflare.com cf_chl_opt' "
            f"when 1 then concat(repeat('x', 600), 'Just a moment challenges.cloudflare.com cf_chl_opt') "
            f"when 2 then 'Error at CloudFlare' when 3 then 'Just a moment cf_chl_opt' "
            f"when 4 then 'Just a moment challenges.cloudflare.com' else 'denied' end")
    status = f"case when {K} % 6 in (2, 3, 5) then 403 else 200 end"
    df = table(spark, sf_dir, "orders").selectExpr(
        f"{K} AS order_id", f"{body} AS b", f"{status} AS s")
    return df.select("order_id", rules.is_block_page(
        F.col("b"), F.col("s"), F.lit(None).cast("string")).alias("blocked"))


VEILS = f"""case {K} % 7 when 0 then 'Anzeige wurde leider nicht gefunden'
  when 1 then 'page  not found showDeletedVeil: false, showPausedVeil :false'
  when 2 then 'showPausedVeil: true showDeletedVeil: false'
  when 3 then concat('Page not found <script type="application/ld+json">{{"@type":["Car"],"url":"HTTPS://o.example/', {ID},
    '/","offers":{{"availability":"http://schema.org/InStock"}}}}</script>')
  when 4 then concat('Page not found <script type="application/ld+json">{{"@type":"Car","url":"https://o.example/none",',
    '"offers":[{{"availability":"InStock"}}]}}</script>')
  when 5 then 'Inserat ist gelöscht' else 'Corvette C6' end"""


def _confirmed(objects: Column) -> Column:
    return rules.confirms_live(objects, F.concat(F.lit("https://o.example/"), F.col("order_id").cast("string")))


@registry.add("o_flt_5", f"SELECT {K} AS order_id, {K} % 7 IN (0, 2, 4, 5) AS gone FROM orders")
def gone_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dealt(table(spark, sf_dir, "orders")).selectExpr(
        f"{K} AS order_id", f"{VEILS} AS body")
    return with_markup(df).select(
        "order_id", rules.is_gone_page(F.col("body"), _confirmed(F.col("objects"))).alias("gone"))


# captured answers: direct pages, canonical redirects of one to four hops, lost offers
def _hop(n: int) -> str:
    return f"concat('https://h{n}.example/s/', {ID}, '-216-1')"


CAPTURES = [
    (_hop(0), f"case {K} % 8 when 0 then 200 when 1 then 404 when 7 then null else 301 end",
     f"case {K} % 8 when 2 then '/' else concat('https://h1.example/s/', {ID}, '-216-1') end"),
    (_hop(1), f"case when {K} % 8 in (4, 5) then 302 when {K} % 8 = 6 then 500 else 200 end", _hop(2)),
    (_hop(2), f"case {K} % 8 when 5 then 301 else 200 end", _hop(3)),
    (_hop(3), "200", "cast(null as string)"),
]


@registry.add("o_ups_7", f"""SELECT 'q_' || {K} AS listing_id,
  cast(CASE {K} % 8 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 301 WHEN 3 THEN 200 WHEN 4 THEN 200
    WHEN 6 THEN 500 END AS int) AS http_status,
  CASE {K} % 8 WHEN 5 THEN 'redirect loop' WHEN 7 THEN 'all methods failed' END AS error_message,
  CASE {K} % 8 WHEN 0 THEN {_hop(0)} WHEN 3 THEN {_hop(1)} WHEN 4 THEN {_hop(2)} END AS online_url,
  {K} % 8 IN (0, 3, 4) AS is_online FROM orders""")
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select(
        "listing_id", "http_status", "error_message",
        F.when(F.col("is_online"), F.col("final_url")).alias("online_url"), "is_online")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    captures = None
    for url, status, location in CAPTURES:
        part = orders.selectExpr(
            f"{url} AS url", f"cast({status} as int) AS http_status",
            f"{location} AS location_header", "'Corvette' AS body", "false AS confirmed",
            "cast(null as string) AS error")
        captures = part if captures is None else captures.unionByName(part)
    checks = orders.selectExpr(f"concat('q_', {ID}) AS listing_id", f"{_hop(0)} AS url")
    return availability.classify_checks(checks, captures)


@registry.add("o_ups_6", f"""SELECT 'q_' || {K} AS id, CASE {K} % 8 WHEN 3 THEN {_hop(1)} WHEN 4 THEN {_hop(2)}
  ELSE {_hop(0)} END AS url FROM orders""")
def adopted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(f"concat('q_', {ID}) AS id", f"{_hop(0)} AS url")
    return availability.adopt_urls(rows, _verdicts(spark, sf_dir)).select("id", "url")


def _offer_page(order: str) -> str:
    return f"concat('https://p', cast({order} as string), '.example/s/', cast(o_custkey as string), '-216-1')"


# pages of an offer (customer) lead from order to order; the last one answers, is gone, or leads back
MOVED = f"""SELECT *, lead({K}) OVER w AS onward, first_value({K}) OVER w AS head FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY {K})"""
MOVED_PAGES = {
    "url": _offer_page(K),
    "http_status": "cast(case when onward is not null or o_custkey % 3 = 2 then 301 when o_custkey % 3 = 1 then 404 else 200 end as int)",
    "location_header": f"case when onward is not null then {_offer_page('onward')} when o_custkey % 3 = 2 then {_offer_page('head')} end",
}


@registry.add("o_ups_7_chains", f"""WITH m AS ({MOVED}), c AS (SELECT *, max({K}) OVER (PARTITION BY o_custkey) AS tail FROM m)
SELECT 'q_' || {K} AS listing_id, cast(CASE o_custkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 END AS int) AS http_status,
  CASE WHEN o_custkey % 3 = 2 THEN 'redirect loop' END AS error_message,
  CASE WHEN o_custkey % 3 = 0 THEN {_offer_page('tail')} WHEN onward IS NOT NULL THEN {_offer_page('onward')}
    WHEN o_custkey % 3 = 2 THEN {_offer_page('head')} END AS final_url, o_custkey % 3 = 0 AS is_online FROM c""")
def followed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains and loops of any length, followed to the end."""
    orders = table(spark, sf_dir, "orders")
    own = W.partitionBy("o_custkey").orderBy(K)
    moved = orders.withColumns({"onward": F.lead(K).over(own), "head": F.first(K).over(own)})
    captures = project(moved, MOVED_PAGES).selectExpr(
        "*", "'Corvette' AS body", "false AS confirmed", "cast(null as string) AS error")
    checks = orders.selectExpr(f"concat('q_', {ID}) AS listing_id", f"{_offer_page(K)} AS url")
    return availability.classify_checks(checks, captures, max_pages=None).drop("url")
