"""Pages to rows, URLs, titles and files."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.functions import times, urls
from claimloom.operators import html, rollups, view
from claimloom.sources import files

TABLE = """<html><body><table><tr><th>Company</th><th>Country</th><th>Extortion Date</th><th>Data size</th></tr><tr data-id="7"><td><a href="/v/ostrava-1">Ostrava&nbsp;Glass</a></td><td>Norway</td><td>2027-02-11</td><td>7 TB</td></tr>
<tr><td><a href="/v/beta%20x/">Beta</a></td><td></td></tr><tr><td></td></tr></table><script>var x = "<td>no</td>"</script><a rel="next" href="?page=2">more</a><a href="https://else.example/?page=3">3</a><div class="my-pagination"><a href="/list/p4">4</a></div></body></html>"""
CARDS = """<main><article class="post-card" id="c1"><h2><a href="/x">Gamma Ltd</a></h2><time datetime="2026-01-02">2 Jan</time><span class="country">Italy</span><p>Data size: 3 TB</p><dl><dt>Deadline</dt><dd>3 days</dd></dl></article>
<div class="victim"><h3>Gamma LTD</h3></div><div class="victim"><h3>Delta</h3><h4>x</h4></div><div class="entry"><b class="title">Epsilon</b><i class="posted">May 1</i><div data-label="file-count">12</div></div></main>"""


def test_tables():
    p = html.parse_listing(TABLE, "https://a.example/list?page=1")
    assert p["parser"] == "html-table" and [r["organization"] for r in p["records"]] == ["Ostrava Glass", "Beta"]
    assert p["records"][0] == {"organization": "Ostrava Glass", "post_title": "Ostrava Glass", "record_id": "7", "reported_date": "2027-02-11", "country": "Norway", "sector": None, "claim_details": {"claimed_data_size": "7 TB"}} and p["records"][1]["record_id"] == "beta x"
    assert [x["url"] for x in p["links"]] == ["https://a.example/list?page=2", "https://a.example/list/p4"]


def test_cards():
    r = html.parse_listing(CARDS, "https://a.example/")["records"]
    assert [x["organization"] for x in r] == ["Gamma Ltd", "Epsilon"] and r[0]["record_id"] == "c1" and r[0]["reported_date"] == "2026-01-02" and r[0]["claim_details"] == {"claimed_data_size": "3 TB", "deadline": "3 days"}
    assert r[1]["reported_date"] == "May 1" and r[1]["claim_details"] == {"file_count": "12"}
    assert html.parse_listing("<h1>x</h1><a href='f.zip'>f</a>", "https://a.example/")["recognized"] is False and html.parse_listing("<div class='victim'>-</div>", "https://a.example/") == {"parser": "html-cards", "recognized": True, "records": [], "links": []}
    assert html.parse_listing(None, "")["records"] == [] and html.parse_listing("<div>" * 3000, "https://a.example/")["recognized"] is False


def test_adapters():
    own = {"a.example": lambda m, u: {"recognized": True, "parser": "own", "records": [{"organization": "Z"}]}, "x.a.example": lambda m, u: {"recognized": False}}
    assert html.parse_listing("", "https://x.a.example/", own)["parser"] == "own" and html.parse_listing("", "https://ba.example/", own)["recognized"] is False
    with pytest.raises(ValueError):
        html.register_adapter("a/b", own["a.example"])


def test_parsed_tables_and_walk(make):
    page = lambda n: f"<article class='card'><h2>Name {n} Ltd</h2></article><a rel='next' href='?page={n + 1}'>next</a>"
    c = make([("s", n, f"https://a.example/l?page={n}", None, page(n)) for n in (1, 2, 4)], "source_id string, page_no int, requested_url string, response_url string, body string")
    p = html.parsed_pages(c)
    assert sorted(r["organization"] for r in html.page_records(p).collect()) == ["Name 1 Ltd", "Name 2 Ltd", "Name 4 Ltd"]
    links = p.select("source_id", F.col("url").alias("from_key"), F.explode("links.url").alias("to_key"))
    got = {r["key"][-1]: r["depth"] for r in html.reachable(p.where("page_no = 1").select("source_id", F.col("url").alias("key")), links).collect()}
    first = html.reachable(p.where("page_no = 1").select("source_id", F.col("url").alias("key")), links, 2).collect()
    assert {(r["key"][-1], r["limited"]) for r in first} == {("1", True), ("2", True)}
    assert got == {"1": 0, "2": 1, "3": 2} and html.parsed_pages(c.limit(0)).count() == 0


def test_catalog_pages(make):
    prefix = "https://tracker.example/groups/"
    rows = "<table><tr><th>Status</th><th>Name</th><th>Type</th><th>First Seen</th></tr><tr><td>Inactive</td><td><a href='/groups/Big%20One'>Big One</a></td><td></td><td>May 2020</td></tr><tr><td>Active</td><td><a href='/groups/two'>Two</a></td><td>Ransom</td><td></td></tr></table><a href='?page=1'>2</a>"
    groups, links = html.tracker_rows(rows, "https://tracker.example/groups", prefix)
    assert [(g["group_id"], g["status"], g["types"], g["first_seen"]) for g in groups] == [("big-one", "inactive", None, "May 2020"), ("two", "active", "Ransom", None)] and links == ["https://tracker.example/groups?page=1"]
    more = "<table><tr><th>Name</th><th>Type</th></tr><tr><td><a href='/groups/big-one'>Big One</a></td><td>Broker</td></tr></table>"
    c = make([(0, "https://tracker.example/groups", None, rows), (1, "https://tracker.example/groups?page=1", None, more)], "page_no int, requested_url string, response_url string, body string")
    assert {r["group_id"]: r["types"] for r in html.catalog_rows(c, prefix).collect()} == {"big-one": "Broker", "two": "Ransom"}
    profile = "<div><h3>Extortion Links</h3><p><a href='HTTP://Site.example/a#x'>s</a> abcdefghijklmnop.onion/x. <a href='https://t.me/y'>m</a></p><h3>Communication</h3><a href='https://late.example'>l</a></div>"
    p = make([("g", "https://tracker.example/groups/g", profile)], "group_id string, url string, body string")
    assert [tuple(s) for s in html.group_endpoints(p).first()["leak_sites"]] == [("website", "http://Site.example/a"), ("onion", "http://abcdefghijklmnop.onion/x")]


def test_urls(make):
    rows = [("  <HTTPS://A.example/x/?b=2&a=1#f> ", "https://A.example/x/?b=2&a=1", "https://a.example/x?a=1&b=2", None, True), ("http://u:p@a.example/", None, None, "invalid_url", False), ("ftp://a.example/", None, None, "unsupported_scheme", False), ("http://a.example:99999/", None, None, "invalid_url", False), ("x.onion", "http://x.onion/", "http://x.onion/", None, True),
            ("http://10.0.0.1/a", "http://10.0.0.1/a", "http://10.0.0.1/a", None, False), ("http://localhost/", "http://localhost/", "http://localhost/", None, False), ("http://8.8.8.8", "http://8.8.8.8/", "http://8.8.8.8/", None, True), ("http://single/", "http://single/", "http://single/", None, False), ("", None, None, "invalid_url", False), (None, None, None, "invalid_url", False)]
    u = make([(i, r[0]) for i, r in enumerate(rows)], "n int, u string")
    c = F.col("u")
    got = {r["n"]: tuple(r)[1:] for r in u.select("n", urls.normalize_url(c), urls.canonical_url(c), urls.url_error(c), urls.is_public_target(c)).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}


def test_names_and_times(make):
    t = make([("Müller & Söhne GmbH",), ("株式会社 テスト",), ("Ｆｕｌｌ　Ｗｉｄｔｈ",), ("Straße",), ("--",), (None,)], "t string")
    assert [tuple(r) for r in t.select(tx.normalize_name("t"), tx.slugify("t"), tx.compact_name("t")).collect()] == [("muller sohne gmbh", "muller-sohne-gmbh", "mullersohnegmbh"), ("株式会社 テスト", "unknown", "株式会社テスト"), ("full width", "full-width", "fullwidth"), ("strasse", "strae", "strasse"), ("", "unknown", ""), (None, "unknown", "")]
    names = ["Acme Inc", "acme.com", "IBM", "Acme", "acme corp things", "the thing", "big ACME", "日本", "a", "Hello World", ""]
    assert [r[0] for r in make([(n,) for n in names], "t string").select(tx.looks_like_organization(F.col("t"))).collect()] == [True, True, True, True, True, False, True, True, False, True, False]
    d = make([("2 Sept 2026", None), ("Sep 23, 2026", None), ("31 Feb 2026", "2026-01-01T23:30:00-02:00"), (None, "bad")], "r string, f string")
    assert [str(r[0]) for r in d.select(times.claim_day(F.col("r"), F.col("f"))).collect()] == ["2026-09-02", "2026-09-23", "2026-01-02", "1970-01-01"]


def test_view(victims):
    v = victims(*[{"id": str(i), "organization": o, "post_title": o, "post_type": "victim", "group_id": "g", "group_name": "G", "country": "France", "listing_state": s, "reported_date": d} for i, (o, s, d) in enumerate([("Firm 10", "listed", "2026-01-02"), ("firm 9", "listed", "2026-01-02"), ("Éclair", "gone", "2026-01-03"), ("n/a", "listed", None)])], {"id": "h", "post_title": "Welcome", "post_type": "headline"})
    assert [r["id"] for r in view.page(view.filtered(v)).collect()] == ["2", "1", "0"] and [r["id"] for r in view.page(v.where("id <> 'h'"), 9, 2).collect()] != []
    assert view.filtered(v, "FIRM 9").count() == 1 and view.filtered(v, listing_state="unknown").count() == 1 and view.filtered(v, country="Spain").count() == 0


def test_captures_and_limits(make):
    schema = "source_id string, page_no int, requested_url string, response_url string, body string, content_type string, http_status int, fetch_error string, error_type string, fetched_at timestamp"
    rows = [("s", 1, "http://a.example/1", None, "x", "text/html; charset=x", 200, None, None, None), ("s", 2, "http://a.example/2", "http://b.example/2", "x", "text/html", 200, None, None, None), ("s", 3, "http://a.example/3", None, "x", "image/png", 200, None, None, None), ("s", 4, "http://a.example/4", None, None, None, 404, None, None, None), ("s", 5, "http://a.example/5", None, None, None, None, "request failed", "timeout", None), ("t", 1, "http://t.example/", None, None, None, None, "request failed", None, None)]
    c = make(rows, schema)
    assert [r[0] for r in c.select(rollups.capture_outcome()).collect()] == [None, "redirect_host_changed", "unsupported_content_type", "http_404", "timeout", "request failed"]
    assert {r["source_id"]: (r["status"], r["error"]) for r in rollups.source_results(c).collect()} == {"s": ("partial", "page_errors"), "t": ("offline", "request failed")}
    many = make([("s", i) for i in range(30)] + [("t", 1)], "source_id string, page_no int")
    assert {(r["source_id"], r["page_limit_reached"]): r["count"] for r in rollups.within_page_limit(many).groupBy("source_id", "page_limit_reached").count().collect()} == {("s", True): 25, ("t", False): 1}


def test_files(spark, make, tmp_path):
    p = str(tmp_path / "doc.json")
    files.write_document(p, {"groups": [{"group_id": "g", "name": "Ä"}], "schema_version": 1})
    assert json.load(open(p, encoding="utf-8"))["schema_version"] == 1 and [tuple(r) for r in files.read_document(spark, p, "groups", "group_id string, name string").collect()] == [("g", "Ä")]
    assert files.read_document(spark, str(tmp_path / "none.json"), "groups", "group_id string").count() == 0
    (tmp_path / "posts.json").write_text('[{"group_name": "a", "post_title": "b", "discovered": "c"}, 3, null]')
    assert sorted((r["group_name"] or "", bool(r["valid"])) for r in files.read_posts(spark, str(tmp_path / "posts.json")).collect()) == [("", False), ("", False), ("a", True)]
    for bad, read in (("[1]", lambda q: files.read_document(spark, q, "groups", "group_id string")), ('{"a": 1}', lambda q: files.read_posts(spark, q))):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            read(str(tmp_path / "bad.json"))
    t = str(tmp_path / "table")
    files.replace_table(make([(1,)], "a int"), t)
    files.replace_table(spark.read.parquet(t).selectExpr("a + 1 as a"), t)
    assert spark.read.parquet(t).first()[0] == 2
    with pytest.raises(ValueError):
        files.assert_arrays({"sightings": None}, "sightings")
    g = make([("g", "x", [("onion", "u")])], "group_id string, profile_url string, leak_sites array<struct<kind:string,url:string>>")
    assert files.public(g).columns == ["group_id", "leak_sites"]
    with pytest.raises(ValueError):
        rollups.check_catalog(make([], "group_id string, status string, leak_sites array<string>"), 1)


def test_everything_without_the_text_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['claimloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and not any(k.startswith(('p3', 'p7')) for k in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).parent.parent)).returncode == 0
