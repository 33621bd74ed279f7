"""Corpus jobs against plain code on small fixtures."""

import collections
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewatch.functions.status import parse_verdict
from pagewatch.functions.urls import canon_url, url_variants, website_from_wikitext
from pagewatch.operators import corpus as W
from pagewatch.operators.markup import chunks_of, links_of, text_of
from pagewatch.operators.names import standardize_names

PAGE = """<html><head><title>T</title><base href="/news/2026/"></head><body>
<h1>Hello</h1><!-- c --><p>a &amp; b < c</p><script>var x="<a href='/no'>"</script>
<div style="display:none">For voters <b>on the go</b></div><svg><text>pic</text></svg>
<noscript>js off</noscript><a href="article-1#top">one</a><a href="/kit.PDF">kit</a><a href="/x.jpg">img</a>
<a href="https://other.example/y">off</a><a href="HTTPS://www.site.example/z/">abs</a><a>none</a></body></html>"""


def test_text_of_skips_code_and_keeps_hidden_text():
    assert text_of(PAGE).split("\n") == [
        "Hello", "a & b < c", "For voters", "on the go", "one", "kit", "img", "off", "abs", "none",
    ]
    assert text_of("<title>t</title>plain") == "plain"


def test_links_resolve_against_base():
    assert list(links_of("https://site.example/p/", PAGE)) == [
        ("https://site.example/news/2026/article-1", "page"),
        ("https://site.example/kit.PDF", "pdf"),
        ("https://other.example/y", "page"),
        ("https://www.site.example/z/", "page"),
    ]


def test_extract_links_keeps_the_site(spark):
    pages = spark.createDataFrame([(1, "https://site.example/p/", PAGE)], "page_id long, url string, html string")
    got = [(r["href"], r["kind"]) for r in W.extract_links(pages).orderBy("pos").collect()]
    assert ("https://other.example/y", "page") not in got and len(got) == 3


@pytest.mark.parametrize(
    "text,limit,pieces",
    [
        ("short", 10, ["short"]),
        (" \n ", 10, [""]),
        ("aaaa\n\nbbbb\n\ncc", 12, ["aaaa\n\nbbbb\n\n", "cc\n\n"]),
        ("aaaa\n\nbbbb\n\ncc", 11, ["aaaa\n\n", "bbbb\n\ncc\n\n"]),
        ("x" * 25, 10, ["x" * 10, "x" * 10, "x" * 5 + "\n\n"]),
        ("aa\n\n" + "y" * 12, 6, ["aa\n\n", "y" * 6, "y" * 6]),
        ("aa\n\n" + "y" * 9 + "\n\nz", 6, ["aa\n\n", "y" * 6, "yyy\n\n", "z\n\n"]),
    ],
)
def test_chunk_cases(text, limit, pieces):
    assert chunks_of(text, limit) == pieces


def test_chunk_properties():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(("a", "bb", " ", "\n", "\n\n")) for _ in range(rng.randrange(60)))
        limit = rng.choice((4, 7, 20))
        pieces = chunks_of(text, limit)
        assert pieces and all(len(p) <= limit for p in pieces)
        if len(text) > limit:
            joined, padded = "".join(pieces), text + "\n\n"
            assert padded.startswith(joined) and not padded[len(joined) :].strip()
            ends, at = {len("\n\n".join(text.split("\n\n")[: i + 1])) + 2 for i in range(text.count("\n\n") + 1)}, 0
            for piece in pieces[:-1]:
                at += len(piece)
                # a cut stands at a paragraph end, or no paragraph end was in reach
                assert at in ends or (len(piece) == limit and not ends & set(range(at - limit + 1, at + 1)))


def test_failed_chunk_quarantines_its_page(spark):
    pages = spark.createDataFrame([("good", "on the go\n\nfine"), ("bad", "BROKEN " * 5)], "page_id string, text string")

    def score(batches):
        for b in batches:
            raw = ["oops" if "BROKEN" in c else '{"classification":"ambiguous","confidence":0.4,"evidence":[{"quote":"q","why":"w"}],"rationale":"r"}' for c in b["chunk"]]
            yield b.assign(raw=raw)

    first = W.batch_scorer(score, "m1")
    verdicts, failed = W.classify_pages(pages, first, W.batch_scorer(score, "m2"), chunk_chars=10)
    assert [r["page_id"] for r in failed.collect()] == ["bad"]
    row = verdicts.collect()[0]
    assert (row["page_id"], row["classification"], row["model"], row["escalated"]) == ("good", "ambiguous", "m2", True)
    assert [e["quote"] for e in row["evidence"]] == ["q", "q"]


SITE = "https://s.example"


def planned(spark, seeds, edges, blocked, depth, budget):
    """Rows of the plan in fetch order; addresses are given without the site."""
    key = lambda u: f"s.example/{u}"
    s = spark.createDataFrame([(SITE, f"{SITE}/{u}", "seed", i, key(u)) for i, u in enumerate(seeds)], "site string, url string, via string, pos int, page_key string")
    e = spark.createDataFrame(
        [(SITE, key(u), i, f"{SITE}/{v}", "pdf" if v.endswith(".pdf") else "page") for u, vs in edges.items() for i, v in enumerate(vs)],
        "site string, page_key string, pos int, href string, kind string",
    )
    b = spark.createDataFrame([(SITE, key(u)) for u in blocked], "site string, page_key string")
    rows = W.crawl_plan(s, e, b, depth=depth, max_pages=budget).collect()
    return [(r["depth"], r["url"].removeprefix(f"{SITE}/")) for r in sorted(rows, key=lambda r: (r["depth"] < 0, r["depth"], r["place"]))]


def test_crawl_plan_by_hand(spark):
    edges = {
        "p1": ["p3", "media4", "z.pdf", "p2"],
        "media0": ["p5", "p1"],
        "p3": ["p6", "a.pdf"],
        "media4": ["p7"],
        "gone": ["p8", "never.pdf"],
    }
    # links come in the order of the pages they stand on, high-value ones first on each;
    # two ordinary pages are all the budget allows
    assert planned(spark, ["p1", "media0", "gone"], edges, ["gone"], 2, 2) == [
        (0, "media0"), (0, "p1"), (1, "p5"), (1, "media4"), (-1, "z.pdf"),
    ]
    assert planned(spark, ["p1"], edges, [], 0, 9) == [(0, "p1")]
    assert planned(spark, ["p1", "p1"], {"p1": ["p1", "p1"]}, [], 3, 9) == [(0, "p1")]


@pytest.mark.parametrize("seed", range(2))
def test_crawl_plan_properties(spark, seed):
    rng = random.Random(seed)
    pages = [f"{'media' if i % 4 == 0 else 'p'}{i}" for i in range(30)]
    papers = [f"d{i}.pdf" for i in range(6)]
    edges = {u: [rng.choice(pages + papers) for _ in range(5)] for u in pages}
    seeds, blocked = rng.sample(pages, 5), set(rng.sample(pages + papers, 4))
    plan = planned(spark, seeds, edges, blocked, 2, 4)
    urls = [u for _, u in plan]
    levels = [d for d, _ in plan if d >= 0]
    assert len(urls) == len(set(urls)) and not blocked & set(urls)
    assert levels == sorted(levels) and max(levels) <= 2
    high = [u for d, u in plan if d >= 0 and u.startswith("media")]
    assert len(high) <= 4 and len(levels) - len(high) <= 4 and sum(d < 0 for d, _ in plan) <= 4
    for d, u in plan:
        before = [v for e, v in plan if e == d - 1] if d > 0 else [v for e, v in plan if 0 <= e < 2]
        assert u in seeds if d == 0 else any(u in edges[v] for v in before)


def one_by_one(seeds, links, blocked, throttled, depth, budget):
    """(depth, url) in the order in which a crawler with a queue and a counter per host would fetch them."""
    high = lambda u: "media" in u
    host = lambda u: u.split("/")[2]
    order, strikes, spent, papers = [], collections.Counter(), collections.Counter(), set()

    def fetch(url, level, purse):
        if url in blocked or url in {u for _, u in order} or strikes[host(url)] == 3 or spent[purse] == budget:
            return False
        spent[purse] += 1
        strikes[host(url)] = strikes[host(url)] + 1 if url in throttled else 0
        order.append((level, url))
        return True

    level = sorted(seeds, key=lambda u: not high(u))
    for d in range(depth + 1):
        got = [u for u in level if fetch(u, d, high(u))]
        if d < depth:
            papers |= {v for u in got for v in links[u] if v.endswith(".pdf")}
        level = [v for u in got for v in sorted((v for v in links[u] if not v.endswith(".pdf")), key=lambda v: not high(v))]
    for u in sorted(papers):
        fetch(u, -1, "papers")
    return order


def test_crawl_plan_gives_up_throttling_hosts(spark):
    rng, want, given_up = random.Random(7), {}, 0
    rows = {"seeds": [], "edges": [], "blocked": [], "responses": []}
    for n in range(30):
        site = f"https://s{n}.example"
        pages = [f"https://{rng.choice('abc')}.s{n}.example/{rng.choice(('media', 'p', 'p'))}{i}" for i in range(40)]
        papers = [f"https://{rng.choice('abc')}.s{n}.example/d{i}.pdf" for i in range(12)]
        links = {u: rng.sample(pages + papers, 8) for u in pages}
        seeds = rng.sample(pages, 6)
        blocked = set(rng.sample(pages + papers, 5))
        throttled = {u for u in pages + papers if rng.random() < rng.choice((0.3, 0.6, 0.8))}
        budget, key = rng.choice((3, 8)), lambda u: u.removeprefix("https://")
        want[site] = budget, one_by_one(seeds, links, blocked, throttled, 2, budget)
        given_up += want[site][1] != one_by_one(seeds, links, blocked, set(), 2, budget)
        rows["seeds"] += [(site, u, "seed", i, key(u), budget) for i, u in enumerate(seeds)]
        rows["edges"] += [(site, key(u), i, v, "pdf" if v.endswith(".pdf") else "page") for u, vs in links.items() for i, v in enumerate(vs)]
        rows["blocked"] += [(site, key(u)) for u in blocked]
        # an answer may be listed twice; pages without an answer are not throttled
        rows["responses"] += [(site, key(u), rng.choice((429, 503))) for u in throttled] + [(site, key(u), 200) for u in pages[::3]]
    schemas = {
        "seeds": "site string, url string, via string, pos int, page_key string, budget int", "edges": "site string, page_key string, pos int, href string, kind string",
        "blocked": "site string, page_key string", "responses": "site string, page_key string, http_status int",
    }
    frames = {n: spark.createDataFrame(rows[n], schemas[n]) for n in rows}
    for budget in (3, 8):
        seeds = frames["seeds"].filter(F.col("budget") == budget).drop("budget")
        got = collections.defaultdict(list)
        plan = W.crawl_plan(seeds, frames["edges"], frames["blocked"], max_pages=budget, responses=frames["responses"])
        for r in sorted(plan.collect(), key=lambda r: (r["depth"] < 0, r["depth"], r["place"])):
            got[r["site"]].append((r["depth"], r["url"]))
        assert got == {site: order for site, (b, order) in want.items() if b == budget}
    assert given_up > 5


def test_crawl_plan_without_rows(spark):
    empty = {n: spark.createDataFrame([], s) for n, s in (("seeds", "site string, url string, via string, pos int, page_key string"), ("edges", "site string, page_key string, pos int, href string, kind string"), ("answers", "site string, page_key string, http_status int"))}
    assert W.crawl_plan(empty["seeds"], empty["edges"], responses=empty["answers"]).count() == 0


def test_robots(spark):
    urls = spark.createDataFrame(
        [("https://a.example/private/x",), ("https://a.example/ok",), ("https://down.example/",), ("https://none.example/z",), ("https://www.free.example:443/private",)],
        "url string",
    )
    docs = spark.createDataFrame(
        [
            ("a.example", 200, "User-agent: *\nDisallow: /\n\nUser-agent: pagewatch\nAllow: /private/pub\nDisallow: /private\nCrawl-delay: 3\n"),
            ("down.example", 503, ""),
            ("www.free.example:443", 200, "User-agent: *\nDisallow: /"),
        ],
        "host string, http_status int, body string",
    )
    overrides = spark.createDataFrame([("Free.Example", "Override")], "host string, posture string")
    out = {r["url"]: (r["allowed"], r["posture"], r["crawl_delay"]) for r in W.robots_audit(urls, docs, overrides, "pagewatch/1.0").collect()}
    assert out["https://a.example/private/x"] == (False, "respect", 3.0)
    assert out["https://a.example/ok"] == (True, "respect", 3.0)
    assert out["https://down.example/"] == (False, "respect", None)
    assert out["https://none.example/z"] == (True, "respect", None)
    assert out["https://www.free.example:443/private"][:2] == (True, "override")


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url,key",
    [
        ("HTTPS://WWW.A.Example/X/#f", "a.example/X"),
        ("http://a.example", "a.example/"),
        ("http://a.example/?q=1#z", "a.example/?q=1"),
        ("http://a.example/p;v=1?b=2", "a.example/p?b=2"),
        ("a.example/x", "a.example/x"),
        ("", "/"),
    ],
)
def test_canon_url(spark, url, key):
    assert one(spark, canon_url(F.col("u")), u=url) == key


def test_url_variants_share_the_key(spark):
    forms = one(spark, url_variants(F.col("u")), u="https://www.a.example/x/?q=1")
    assert len(forms) == 8 and "http://a.example/x?q=1" in forms


@pytest.mark.parametrize(
    "text,site",
    [
        ("| website = {{URL|janedoe.com}}", "https://janedoe.com"),
        ("|website={{url|https://doe.house.gov|Office}} {{url|doe.com|Campaign website}}", "https://doe.com"),
        ("| website = [https://doe.senate.gov Senate] [https://doeforus.com Campaign]", "https://doeforus.com"),
        ("| website = {{URL|doe.house.gov}}", None),
        ("| name = x", None),
    ],
)
def test_wikitext(spark, text, site):
    assert one(spark, website_from_wikitext(F.col("w")), w=text) == site


@pytest.mark.parametrize(
    "raw,cls,failed",
    [
        ('{"classification":"ambiguous","confidence":0.5}', "ambiguous", False),
        ('Sure: {"classification":"ambiguous"} ok', "ambiguous", False),
        ("not json", None, True),
        ("{broken", None, True),
        ("} {", None, True),
        ("", None, True),
    ],
)
def test_parse_verdict(spark, raw, cls, failed):
    v = one(spark, parse_verdict(F.col("r")), r=raw)
    assert (v["classification"], v["error"] is not None) == (cls, failed)


@pytest.mark.parametrize(
    "name,ledger,display",
    [
        ("LINDQUIST, OSKAR EMIL", "LINDQUIST, OSKAR EMIL", "Oskar Emil Lindquist"),
        ("PARDO,, INES", "PARDO, INES", "Ines Pardo"),
        ("VANTERPOOL, ODA B THE REV", "VANTERPOOL, ODA B", "Oda B Vanterpool"),
        ("KESTREL, WREN V", "KESTREL, WREN V", "Wren V Kestrel"),
        ("KESTREL, WREN DR V", "KESTREL, WREN V", "Wren Kestrel V"),
        ("OAKES, T. ALDEN ALDEN HON.", "OAKES, T. ALDEN", "T. Alden Oakes"),
        ("OAKES, T. T.", "OAKES, T. T.", "T. T. Oakes"),
        ("MCTAVISH-LORNE, ISLA", "MCTAVISH-LORNE, ISLA", "Isla McTavish-Lorne"),
        ("OAKES, BO III MD JR.", "OAKES, BO III JR.", "Bo Oakes III Jr."),
        ("OAKES, THE", "OAKES, THE", "The Oakes"),
        ("OAKES, DR.", "OAKES", "Oakes"),
        ("SOME COMMITTEE", "SOME COMMITTEE", "Some Committee"),
        ("", "", ""),
    ],
)
def test_names(spark, name, ledger, display):
    row = standardize_names(spark.createDataFrame([(name, 1)], "name string, other int")).first()
    assert (row["ledger_name"], row["display_name"], row["other"]) == (ledger, display, 1)


def test_null_name(spark):
    row = standardize_names(spark.createDataFrame([(None,)], "name string")).first()
    assert (row["name"], row["ledger_name"], row["display_name"]) == (None, "", "")


@pytest.mark.parametrize(
    "raw,confidence,quotes",
    [
        ('{"classification":"ambiguous","confidence":"0.8","evidence":["q"]}', 0.8, [("q", None)]),
        ('{"classification":"ambiguous","confidence":1,"evidence":[{"quote":"a","why":"b"},{"why":"c"}]}', 1.0, [("a", "b"), (None, "c")]),
        ('{"classification":"ambiguous","confidence":"high","evidence":"all of it"}', None, [("all of it", None)]),
        ('{"classification":"ambiguous","evidence":{"quote":"x"},"rationale":7}', None, None),
    ],
)
def test_odd_fields_do_not_fail_a_reply(spark, raw, confidence, quotes):
    v = one(spark, parse_verdict(F.col("r")), r=raw)
    assert (v["classification"], v["error"], v["confidence"]) == ("ambiguous", None, confidence)
    got = v["evidence"] and [(e["quote"], e["why"]) for e in v["evidence"]]
    assert quotes is None or got == quotes


def test_failed_reply_is_kept_whole(spark):
    reply = "sorry " * 500
    assert one(spark, parse_verdict(F.col("r")), r=reply)["error"].endswith(reply.strip())
    assert one(spark, parse_verdict(F.col("r")), r="[1, 2]")["error"] is not None


def test_blocked_children_take_no_place(spark):
    sites = spark.createDataFrame([("s", 0, "idx")], "site string, ord int, doc_url string")
    body = "<sitemapindex>" + "".join(f"<loc>c{i}</loc>" for i in range(5)) + "</sitemapindex>"
    docs = spark.createDataFrame([("idx", body)] + [(f"c{i}", f"<loc>p{i}</loc>") for i in (0, 1, 3, 4)], "doc_url string, body string")
    blocked = spark.createDataFrame([("c0",), ("c1",)], "doc_url string")
    # c2 was allowed but not fetched: it takes one of the two places
    assert [r["url"] for r in W.sitemap_urls(sites, docs, 2, 10, blocked).orderBy("pos").collect()] == ["p3"]


def test_only_a_few_pages_of_a_batch_become_python_texts():
    """A large Arrow batch costs Python a few pages' texts, whatever its rows; ids keep their type."""
    n = 4_000
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array([None, *range(1, n)], pa.int32()), "text": ["x" * 10_000] * n})
    run = W.few_pages(lambda rows: [(page, len(text)) for page, text in rows if page is None or page % 2], [("size", pa.int32())])
    tracemalloc.start()
    out = pa.Table.from_batches(run(iter([batch, batch.slice(0, 0)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000
    assert out.schema.field("page_id").type == pa.int32()
    assert out.column("page_id").to_pylist() == [None, *range(1, n, 2)] and set(out.column("size").to_pylist()) == {10_000}
    empty = list(W.few_pages(lambda rows: [], [("size", pa.int32())])(iter([batch])))
    assert sum(b.num_rows for b in empty) == 0 and empty[0].schema.names == ["page_id", "size"]
