"""Whole runs over captures, imports of JSON archives, the catalog, log lines, orders and forms of time."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from claimloom import __main__ as commands
from claimloom.functions import times
from claimloom.operators import archive, cycle, history, rollups
from claimloom.session import cut

GROUPS = "group_id string, name string, status string, profile_url string, leak_sites array<struct<kind:string,url:string>>, leak_sites_scope string"
CAPTURES = "source_id string, page_no int, requested_url string, response_url string, body string, content_type string, http_status int, fetch_error string, error_type string, fetched_at timestamp"
SOURCES = "source_id string, group_id string, group_name string, source_host string, checked_at string, parser string, watchguard_profile_url string"


def groups(make, *rows):
    return make([(g, n, s, f"https://tracker.example/{g}", [("website", u) for u in urls], "extortion_links") for g, n, s, urls in rows], GROUPS)


def capture(source, page, url, names, error=None):
    body = None if error else "".join(f"<article class='card'><h2>{n}</h2></article>" for n in names) or "<div class='victim'></div>"
    return (source, page, url, None, body, "text/html", None if error else 200, error, error and "Timeout", dt.datetime(2026, 5, 1))


def test_two_runs(make, victims):
    g = groups(make, ("ash", "Ash", "active", ["http://ash.example/"]), ("birch", "Birch", "active", ["http://birch.example/", "http://birch2.example/"]), ("elm", "Elm", "inactive", ["http://elm.example/"]))
    ids = {r["url"].split("/")[2].split(".")[0]: r["source_id"] for r in rollups.planned_sources(g).collect()}
    prior = make([("gone", "ash", "Ash", "old.example", "2026-01-01T00:00:00Z", "html-cards", None), (ids["birch2"], "birch", "Birch", "birch2.example", "2026-01-01T00:00:00Z", "html-table", None)], SOURCES)
    legacy = {"id": "legacy", "group_id": "ash", "group_name": "Ash", "organization": "🇫🇷 Leak: Kestrel Mills Ltd [NEW]", "post_title": "🇫🇷 Leak: Kestrel Mills Ltd [NEW]", "source_id": "gone", "last_seen_at": "2026-01-01T00:00:00Z", "listing_state": "listed"}
    story = {"id": "story", "group_id": "ash", "post_title": "Our own news", "post_type": "headline", "source_id": "gone", "source_ids": ["gone"], "listing_state": "listed", "last_seen_at": "2026-01-01T00:00:00Z"}
    first = make([capture(ids["ash"], 1, "http://ash.example/", ["Kestrel Mills Ltd", "Dune Works GmbH"]), capture(ids["birch"], 1, "http://birch.example/", ["Quay Foods Inc"])], CAPTURES)
    one = cycle.run(g, first, prior, victims(legacy, story), "2026-05-01T00:00:00Z")
    h = {r["organization"] or r["id"]: r for r in one.history.collect()}
    assert set(h) == {"Kestrel Mills Ltd", "Dune Works GmbH", "Quay Foods Inc", "story"} and h["Kestrel Mills Ltd"]["id"] == "legacy" and h["Kestrel Mills Ltd"]["country"] == "France"
    assert {k: r["listing_state"] for k, r in h.items()} == {"Kestrel Mills Ltd": "listed", "Dune Works GmbH": "listed", "Quay Foods Inc": "listed", "story": "unknown"}
    s = {r["source_id"]: r for r in one.sources.collect()}
    assert {k: s[v]["status"] for k, v in {**ids, "gone": "gone"}.items()} == {"ash": "ok", "birch": "ok", "birch2": "skipped_budget", "elm": "skipped_inactive", "gone": "not_in_catalog"}
    assert s[ids["ash"]]["victims_found"] == 2 and s[ids["birch2"]]["checked_at"] == "2026-01-01T00:00:00Z" and s[ids["birch2"]]["parser"] == "html-table" and s["gone"]["pages_scanned"] == 0
    assert one.run.first().asDict() == {"updated_at": "2026-05-01T00:00:00Z", "crawl_partial": True, "sources": 4, "sources_ok": 2, "sources_skipped_budget": 1, "pages_scanned": 2, "sightings": 4}
    assert {r["group_id"]: r["crawl_status"] for r in one.groups.collect()} == {"ash": "ok", "birch": "partial", "elm": "skipped_inactive"}
    # The next run: one listing is gone, one source fails, another is read at last.
    second = make([capture(ids["ash"], 1, "http://ash.example/", ["Dune Works GmbH"]), capture(ids["birch"], 1, "http://birch.example/", [], "timed out"), capture(ids["birch2"], 1, "http://birch2.example/", [])], CAPTURES)
    two = cycle.run(g, second, one.sources, one.history, "2026-05-02T00:00:00Z")
    assert {r["organization"]: (r["listing_state"], r["first_seen_at"], r["last_seen_at"]) for r in two.history.where("post_type = 'victim'").collect()} == {
        "Kestrel Mills Ltd": ("unknown", "2026-05-01T00:00:00Z", "2026-05-01T00:00:00Z"), "Dune Works GmbH": ("listed", "2026-05-01T00:00:00Z", "2026-05-02T00:00:00Z"), "Quay Foods Inc": ("unknown", "2026-05-01T00:00:00Z", "2026-05-01T00:00:00Z"),
    }
    assert two.run.first()["crawl_partial"] is False and {r["source_id"]: r["status"] for r in two.sources.collect()}[ids["birch"]] == "offline"


def test_import_of_a_json_archive(make, victims, tmp_path, capsys):
    groups(make, ("cl0p", "Cl0p", "active", []), ("ash", "Ash", "active", [])).write.parquet(str(tmp_path / "groups.parquet"))
    victims({"id": "a", "group_id": "ash", "organization": "Kestrel Mills Ltd", "post_title": "Kestrel Mills Ltd", "post_type": "victim"}).write.parquet(str(tmp_path / "history"))
    posts = [{"group_name": "clop", "post_title": "Dune Works GmbH", "discovered": "2024-03-01 10:00:00.5"}, {"group_name": "ASH", "post_title": "Kestrel Mills Ltd", "discovered": "20240302T10"}, "none", {"group_name": "who", "post_title": "X Ltd", "discovered": "2024-01-01"}, {"group_name": "ash", "post_title": "Quay Foods Inc", "discovered": "soon"}]
    (tmp_path / "posts.txt").write_text(json.dumps(posts))
    (tmp_path / "aliases.json").write_text('{"clop": "cl0p"}')
    run = lambda *more: commands.main(["import", "--posts", str(tmp_path / "posts.txt"), "--groups", str(tmp_path / "groups.parquet"), "--history", str(tmp_path / "history"), "--imported-at", "2026-01-01T00:00:00Z", "--aliases", str(tmp_path / "aliases.json"), *more])
    spark = victims().sparkSession
    assert run() == 0 and spark.read.parquet(str(tmp_path / "history")).count() == 1
    said = dict(x.split("=", 1) for x in capsys.readouterr().out.split("\n") if "=" in x)
    assert {k: said[k] for k in ("archive_rows", "matched_archive_rows", "invalid_rows", "unmatched_group_rows", "invalid_timestamps", "new_sightings", "existing_sightings_updated", "sighting_total")} == {
        "archive_rows": "5", "matched_archive_rows": "2", "invalid_rows": "1", "unmatched_group_rows": "1", "invalid_timestamps": "1", "new_sightings": "1", "existing_sightings_updated": "1", "sighting_total": "2",
    }
    assert run("--apply") == 0
    got = {r["organization"]: r for r in spark.read.parquet(str(tmp_path / "history")).collect()}
    assert got["Dune Works GmbH"]["first_seen_at"] == "2024-03-01T10:00:00.500000Z" and got["Kestrel Mills Ltd"]["id"] == "a" and got["Kestrel Mills Ltd"]["historical_import"]["earliest_discovered"] == "2024-03-02T10:00:00Z"
    with pytest.raises(ValueError):
        archive.group_keys(groups(make, ("ash", "Ash", "active", [])), archive.APPROVED_ALIASES)


@pytest.fixture(autouse=True)
def one_session(monkeypatch, spark):
    monkeypatch.setattr(commands, "build_session", lambda: spark)


def test_catalog_command(make, spark, tmp_path, capsys):
    prefix = "https://tracker.example/groups/"
    page = "<table><tr><th>Status</th><th>Name</th></tr><tr><td>Active</td><td><a href='/groups/two'>Two</a></td></tr><tr><td>Active</td><td><a href='/groups/one'>one</a></td></tr></table>"
    row = lambda n, body, error=None: ("t", n, f"https://tracker.example/groups?page={n}", None, body, "text/html", 200, error, None, dt.datetime(2026, 5, 1))
    profile = "<h3>Extortion Links</h3><p><a href='http://one.example/'>x</a></p>"
    make([("one", "https://tracker.example/groups/one", profile, *row(0, "")[2:4], "text/html", 200, None, None), ("two", "https://tracker.example/groups/two", None, *row(0, "")[2:4], None, None, "timed out", "Timeout")], "group_id string, url string, body string, requested_url string, response_url string, content_type string, http_status int, fetch_error string, error_type string").write.parquet(str(tmp_path / "profiles"))
    groups(make, ("two", "Two", "active", ["http://two.example/"])).write.parquet(str(tmp_path / "groups"))
    run = lambda rows: make(rows, CAPTURES).write.mode("overwrite").parquet(str(tmp_path / "captures")) or commands.main(["catalog", "--captures", str(tmp_path / "captures"), "--profiles", str(tmp_path / "profiles"), "--groups", str(tmp_path / "groups"), "--prefix", prefix])
    assert run([row(0, page)]) == 0
    assert [(r["group_id"], [s["url"] for s in r["leak_sites"]]) for r in spark.read.parquet(str(tmp_path / "groups")).orderBy("group_id").collect()] == [("one", ["http://one.example/"]), ("two", ["http://two.example/"])]
    assert run([row(0, page), row(1, None, "timed out")]) == 1 and run([row(0, "<p></p>")]) == 1 and spark.read.parquet(str(tmp_path / "groups")).count() == 2


def test_orders_and_log_lines(make, victims):
    assert [r["group_id"] for r in rollups.groups_in_order(make([("b", "alpha"), ("a", "Beta"), ("c", None)], "group_id string, name string")).collect()] == ["b", "a", "c"]
    assert [r["source_id"] for r in rollups.sources_in_order(make([("1", "b", "y"), ("2", "B", "x"), ("3", "a", None)], "source_id string, group_name string, source_host string")).collect()] == ["3", "2", "1"]
    v = victims({"id": "z", "last_seen_at": "2026"}, {"id": "a", "last_seen_at": "2026"}).withColumn("n", F.when(F.col("id") == "z", 0).otherwise(1))
    assert [r["id"] for r in history.latest_first(v, "n").collect()] == ["z", "a"]
    lines = rollups.events(make([("s 1", 3, None)], "source_id string, pages int, error string"), "source_result", "source_id", "pages", "error")
    assert lines.first()["line"] == "source_result source_id=s_1 pages=3" and rollups.event_fields(lines).first()["fields"] == {"source_id": "s_1", "pages": "3"}


def test_forms_of_iso_times(make):
    told = {
        "2026-09-20T10:11:12.123456789Z": "2026-09-20T10:11:12.123456Z", "20260920": "2026-09-20T00:00:00Z", "20260920T101112+0200": "2026-09-20T08:11:12Z", "2026-W01-1": "2025-12-29T00:00:00Z", "2026W53": "2026-12-28T00:00:00Z", "2025-W53-1": None,
        "2026-09-20 10": "2026-09-20T10:00:00Z", "2026-09-20x10:11,5": None, "2026-09-20T10:11:12,5-01:30": "2026-09-20T11:41:12.500000Z", "2026-02-30": None, "20 Sep 2026": None, "": None,
    }
    got = make([(k,) for k in told], "t string").select("t", times.iso_utc(times.moment(F.col("t"))).alias("m"))
    assert {r["t"]: r["m"] for r in got.collect()} == told
    now = cut(make([(1,)], "n int").select(times.now_utc().alias("t"))).first()[0]
    assert dt.datetime.strptime(now, "%Y-%m-%dT%H:%M:%SZ") <= dt.datetime.now(dt.UTC).replace(tzinfo=None) + dt.timedelta(seconds=1)
