"""Page extraction on hand-written pages, odd markup included, and availability."""

import datetime as dt
import random

import pyarrow as pa
from pyspark.sql import functions as F

from adledger import lexicon as lx
from adledger.functions import availability as rules
from adledger.functions import identity
from adledger.operators import availability, graph
from adledger.schema import PAGE
from adledger.session import dealt, written
from adledger.sources import cards, markup
from adledger.sources.markup import Tree, linked_objects, with_markup
from adledger.sources.pages import extract_listings, split_pages


def pages(spark, rows):
    names = [f.name for f in PAGE]
    full = []
    for i, row in enumerate(rows):
        base = {"source": "x", "url": "https://h.example/p", "http_status": 200,
                "fetched_at": dt.datetime(2024, 1, 1), **row}
        full.append(tuple(base.get(n) for n in names) + (i,))
    df = spark.createDataFrame([f[:-1] + (f[-1],) for f in full],
                               ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PAGE)
                               + ", page_no long")
    return df


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_markup_survives_odd_pages(spark):
    bodies = ["", None, "<p>a<b>b</p>c", "<div><br><img src=x>t</div></div></span>", "a &lt; b&nbsp;c",
              "<script>if (a < b) '</p>'</script><p>x</p>", "<a href=1 href=2>z", "<p"]
    df = with_markup(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string"))
    tree = Tree(F.col("nodes"))
    texts = F.transform(tree.all(lambda n: n["tag"].isin("p", "div", "a")), tree.text)
    got = {r["i"]: (r["t"], r["parse_error"]) for r in df.select("i", texts.alias("t"), "parse_error").collect()}
    assert all(error is None for _, error in got.values())
    assert got[2][0] == ["a b"] and got[3][0] == ["t"] and got[5][0] == ["x"] and got[6][0] == ["z"]


def test_nested_articles_and_positions(spark):
    body = ("<article>Corvette C6 <a href='/a'>one</a><article id='in'>C6 <a href='/corvette'>two</a>"
            "</article></article>")
    got = cards.article_cards(pages(spark, [{"body": body}])).orderBy("idx").collect()
    assert [(r["source_listing_id"], r["url"]) for r in got] == [
        ("as24-0", "https://h.example/corvette"), ("in", "https://h.example/corvette")]


def test_broken_app_json_falls_back_to_articles(spark):
    body = ('<script id="__NEXT_DATA__">{"props":{"pageProps":{"listings":null}}}</script>'
            "<article><h2>Corvette C6</h2><a href='x?y=1'>l</a>44.000 €</article>")
    row = one(cards.as24_cards(pages(spark, [{"body": body}])))
    assert row["url"] == "https://h.example/x?y=1" and row["raw_price"] is None


def test_page_with_offers_ignores_its_articles(spark):
    body = ('<script id="__NEXT_DATA__">{"props":{"pageProps":{"listings":[{"id":7,"url":"/o",'
            '"vehicle":{"model":"Corvette","modelVersionInput":"C6","hp":437}}]}}}</script>'
            "<article><h2>Corvette C6</h2><a href='/no'>l</a></article>")
    row = one(cards.as24_cards(pages(spark, [{"body": body}])))
    assert (row["source_listing_id"], row["title"]) == ("7", "Chevrolet Corvette C6")
    assert "437" in row["description"]


def test_crawl_end_to_end(spark):
    ad = "<article class='aditem' data-adid='{i}'><h2><a href='/s-anzeige/x/{i}-216-1'>Corvette C6 Z06 {i}" \
         "</a></h2><p class='price'>{p} €</p></article>"
    rows = [
        {"source": lx.KLEINANZEIGEN, "body": ad.format(i=1, p="41.000") + ad.format(i=2, p="42.000")},
        {"source": lx.KLEINANZEIGEN, "body": ad.format(i=2, p="43.000")},
        {"source": lx.AUTOUNCLE, "body": "<article><a href='/de/d/9'>Corvette C6 | x</a></article>"},
        {"source": lx.AUTOUNCLE, "http_status": 500, "body": "x"},
        {"source": lx.MOBILE_DE, "body": None},
    ]
    usable, problems = split_pages(pages(spark, rows))
    assert sorted(r["problem"] for r in problems.collect()) == ["HTTP 500", "empty page"]
    got = extract_listings(usable).orderBy("pos").collect()
    assert [(r["source"], r["source_listing_id"], r["price_eur"], r["trim"]) for r in got] == [
        (lx.KLEINANZEIGEN, "1", 41000, "Z06"), (lx.KLEINANZEIGEN, "2", 42000, "Z06"),
        (lx.AUTOUNCLE, "9", None, "Base")]


def test_url_join(spark):
    base = "https://h.example:8/a/b/c?q=1#f"
    cases = {"": base, "/x": "https://h.example:8/x", "x": "https://h.example:8/a/b/x",
             "../x?y": "https://h.example:8/a/x?y", "../../../x": "https://h.example:8/x",
             "./x#z": "https://h.example:8/a/b/x#z", "//o.example/x": "https://o.example/x",
             "http://o.example": "http://o.example", "?z": "https://h.example:8/a/b/c?z"}
    df = spark.createDataFrame([(base, h) for h in cases], "b string, h string")
    got = {r["h"]: r["u"] for r in df.select("h", identity.url_join(F.col("b"), F.col("h")).alias("u")).collect()}
    assert got == cases


def test_canonical_url(spark):
    cases = {"HTTPS://User@H.Example:8/A/b//?q#f": "https://user@h.example:8/A/b", "h.example/x/": "h.example/x",
             "https://h.example": "https://h.example"}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r[0]: r[1] for r in df.select("u", identity.canonical_url(F.col("u"))).collect()}
    assert got == cases


def test_linked_objects_equal_those_of_the_node_arrays(spark):
    ld = '<script type="application/ld+json">{}</script>'.format
    bodies = [None, "", "no tags <", ld('{"a":{"b":[{"c":1}]}}') + ld("[{},{\"x\":\"ü\"}]"), ld("broken"), "<p>" + ld('{"p":1}') + "</div></p>",
              '<script>{"not":1}</script><style type="application/ld+json">{"s":1}</style>', '<script type="application/ld+json"/>{"t":1}',
              "<template type='x application/ld+json;y'>{\"t\":2}</template><br>" + ld('{"u":3}')]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    want = {(r["k"], i, o) for r in with_markup(df).collect() for i, o in enumerate(r["objects"])}
    assert {tuple(r) for r in linked_objects(df, ["k"]).collect()} == want and len(want) >= 9


def test_gone_page_signals(spark):
    live = ('<script type="application/ld+json">{"@graph":[{"@type":["Thing","Car"],"url":"https://o.example/1/",'
            '"offers":[{"availability":"https://schema.org/InStock"}]}]}</script>')
    bodies = {
        "ok": "Corvette", "gone": "Page not found", "proved": "Page not found" + live,
        "veil": "showDeletedVeil: true" + live, "other": ("404 not found" + live).replace("/1/", "/2/"),
    }
    df = with_markup(spark.createDataFrame(list(bodies.items()), "k string, body string"))
    confirmed = rules.confirms_live(F.col("objects"), F.lit("https://O.example/1"))
    got = {r[0]: r[1] for r in df.select("k", rules.is_gone_page(F.col("body"), confirmed)).collect()}
    assert got == {"ok": False, "gone": True, "proved": False, "veil": True, "other": True}


def test_checks_without_url_or_capture(spark):
    checks = spark.createDataFrame([("a", ""), ("b", "https://none.example"), ("c", "https://x.example/")],
                                   "listing_id string, url string")
    captures = spark.createDataFrame(
        [("https://x.example/", 200, None, "<h1>Nicht gefunden</h1>", False, None)],
        "url string, http_status int, location_header string, body string, confirmed boolean, error string")
    got = {r["listing_id"]: (r["http_status"], r["error_message"], r["is_online"])
           for r in availability.classify_checks(checks, captures).collect()}
    assert got == {"a": (None, "empty URL", False), "b": (None, "not captured", False),
                   "c": (410, "not found body", False)}


def page(offer, at, to=None, status=None):
    """Page ``at`` of an offer; ``to`` is the page it leads to."""
    url = "https://p{}.example/s/{}-216-1".format
    return (url(at, offer), status or (301 if to is not None else 200), None if to is None else url(to, offer), "Corvette", False, None)


CAPTURED = "url string, http_status int, location_header string, body string, confirmed boolean, error string"


def test_long_chains_and_loops(spark, monkeypatch):
    chain = [page(1, n, n + 1) for n in range(40)] + [page(1, 40)]
    # a loop of five with a tail of three, a page that leads to itself, one to nowhere, one that is gone at the end
    loop = [page(2, n, n + 1) for n in range(7)] + [page(2, 7, 3)]
    rest = [page(3, 0, 0), page(4, 0, 99), page(5, 0, 1), page(5, 1, status=404)]
    captures = spark.createDataFrame(chain + loop + rest, CAPTURED)
    checks = spark.createDataFrame([(r[0], r[0]) for r in chain + loop + rest] + [("blank", None)] * 50, "listing_id string, url string")
    writes = []
    monkeypatch.setattr(graph, "written", lambda df, plain=graph.written: writes.append(1) or plain(df))
    hops = graph.follow(spark.createDataFrame([(r[0], r[2]) for r in chain if r[2]], "node string, next string"))
    got = {r["node"]: (r["target"], r["hops"], r["looped"]) for r in hops.collect()}
    assert got == {r[0]: (chain[-1][0], 40 - n, False) for n, r in enumerate(chain[:-1])} and len(writes) == 1 + 6
    told = {r["listing_id"]: (r["http_status"], r["error_message"], r["final_url"])
            for r in availability.classify_checks(checks, captures, max_pages=None).collect()}
    want = {r[0]: (200, None, chain[-1][0]) for r in chain}
    want |= {r[0]: (None, "redirect loop", r[2]) for r in loop + rest[:1]}
    want |= {rest[1][0]: (None, "not captured", rest[1][2]), rest[2][0]: (404, None, rest[2][2]), rest[3][0]: (404, None, None),
             "blank": (None, "empty URL", None)}
    assert told == want
    # three pages at most: two redirects are followed
    short = {r["listing_id"]: r["error_message"] for r in availability.classify_checks(checks, captures).collect()}
    assert [short[r[0]] for r in chain[36:]] == ["redirect loop", "redirect loop", None, None, None]


def test_staleness(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:05:00",), (None,), ("?",)], "t string")
    now = F.lit("2024-01-01 00:06:40").cast("timestamp")
    assert [r[0] for r in df.select(rules.is_stale(F.col("t"), now)).collect()] == [True, False, True, True]
    assert all(r[0] for r in df.select(rules.is_stale(F.col("t"), now, force=True)).collect())


def test_plain_markup_is_read_as_by_the_parser():
    """The column reader gives the parser's nodes for any page, and takes plain pages itself."""
    rnd = random.Random(5)
    bits = ["<p>", "</p>", '<b class="a b">', "</b>", "<br>", "text &amp; x", "a < b", "&lt", "<script>var a=1;</script>",
            '<script type="application/ld+json">{"a":{"b":1}}</script>', "<!-- c -->", '<div id="1" id="2">', "</div>", "<style>x{}</style>",
            "<template>", "t", "</template>", "<title>q&amp;</title>", "<IMG SRC=x>", "<br/>", '<a href="x?a&amp;b">', "</a>", "<li>",
            "<script>if(a<b)</script>", "<!doctype html>", "&", "<", "<x-y>", "<input disabled>", "é€", "\x00", "<textarea>"]
    pages = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + [None, ""]
    got = [row for part in markup._marked(pa.array(pages, pa.string())) for row in part.to_pylist()]
    assert got == pa.array([markup._parse(p) for p in pages], type=markup._ARROW).to_pylist()
    plain = '<ul class="x"><li>one<br>two &amp; three<li><a href="/a">l</a></ul><!-- c --><script>var x = 1;</script>end'
    assert markup._Columns()._plain(plain)


def test_marked_pages_leave_in_small_batches():
    pages = pa.array(["<p>x</p>"] * 1000)
    assert max(len(part) for part in markup._marked(pages)) <= markup.PAGES_AT_ONCE


def test_rows_are_dealt_evenly(spark, tmp_path):
    """One file with one row group: all rows would be work of one task."""
    spark.range(60_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    sizes = [len(p) for p in dealt(spark.read.parquet(str(tmp_path / "t")), 4_000).rdd.glom().collect()]
    assert sum(sizes) == 60_000 and len(sizes) == 15 and max(sizes) < 6_000


def test_loops_end_by_their_own_length(spark, monkeypatch):
    """Short loops beside many chains do not go round until the hops exceed all nodes."""
    writes = []
    monkeypatch.setattr(graph, "written", lambda df: writes.append(1) or written(df))
    loops = [(6 * i + j, 6 * i + (j + 1) % 6) for i in range(300) for j in range(6)]
    tails = [(10_000 + i, 10_001 + i if i % 4 else 6 * i) for i in range(41)]
    rows = spark.createDataFrame([*loops, *tails, (20_000, 20_001)], "node bigint, next bigint")
    got = {r.node: r for r in graph.follow(rows).collect()}
    assert all(r.looped for n, r in got.items() if n != 20_000) and len(got) == 1_842
    assert not got[20_000].looped and got[20_000].target == 20_001
    assert len(writes) <= 1 + 2 * 5  # 2^11 hops would take eleven rounds
