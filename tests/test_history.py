"""Scenarios of the history: copies, mirrors, late batches, states, archive."""

import itertools

from pyspark.sql import functions as F

from claimloom.operators import archive, history, records
from claimloom.session import cut


def merged(h, *batch):
    return cut(history.merge_observations(h, *batch))

RECORD = "organization string, post_title string, record_id string, reported_date string, country string, country_basis string, sector string, post_type string, claim_details map<string,string>"
SEEN = RECORD + ", group_id string, group_name string, source_id string, source_host string, watchguard_profile_url string, observed_at string"


def seen(make, *rows):
    names = [c.split(" ")[0] for c in SEEN.split(", ")]
    base = {"group_name": "G", "watchguard_profile_url": "https://tracker.example/groups/g", "post_type": "victim"}
    return cut(records.normalize_records(make([tuple((({**base, **r}).get(c)) for c in names) for r in rows], SEEN)))


def test_copies_become_one_row(victims):
    rows = [
        {"id": "b", "group_id": "G", "organization": "Acme, Inc.", "post_title": "Acme, Inc.", "post_type": "victim", "first_seen_at": "2026-01-01T00:00:00.250Z", "last_seen_at": "2026-02-01T00:00:00Z", "source_id": "s2", "listing_state": "unknown", "claim_details": {"deadline": "x", "file_count": "3"}},
        {"id": "a", "group_id": "g", "organization": "ACME Inc", "post_title": "ACME Inc", "post_type": "victim", "first_seen_at": "2026-01-01T00:00:00Z", "last_seen_at": "2026-02-01T00:00:00.5Z", "source_ids": ["s1", "s0"], "listing_state": "listed", "country": "", "claim_details": {"deadline": ""}},
        {"id": "c", "group_id": "other", "organization": "Acme Inc", "post_title": "Acme Inc", "post_type": "victim", "country": "France"}, {"id": "h", "group_id": "g", "post_title": "Welcome", "post_type": "headline", "organization": "kept as it is"}, {"id": "x", "group_id": "g", "organization": "---", "post_title": "---", "post_type": "victim"},
    ]
    out = {r["id"]: r for r in history.canonical(victims(*rows)).collect()}
    assert sorted(out) == ["a", "c", "h", "x"] and out["h"]["organization"] == "kept as it is" and out["x"]["post_type"] == "victim"
    a = out["a"]
    assert a["first_seen_at"] == "2026-01-01T00:00:00Z" and a["last_seen_at"] == "2026-02-01T00:00:00.5Z" and a["source_ids"] == ["s0", "s1", "s2"] and a["source_id"] == "s0" and a["listing_state"] == "listed" and a["claim_details"] == {"deadline": "x", "file_count": "3"}


def test_normalising_twice_changes_nothing(make):
    r = seen(make, {"organization": "🇫🇷 Leak: Acme [NEW] [Sold]", "post_title": "🇫🇷 Leak: Acme [NEW] [Sold]", "claim_details": {"deadline": " ", "extra": " kept ", "description": "d" * 900}}, {"post_title": "Announcement for the Foo Ltd and its clients"}, {"post_title": "Welcome"}, {"post_title": None, "organization": None}, {"post_title": "Our company was hit", "organization": "Acme"})
    order = ["🇫🇷 Leak: Acme [NEW] [Sold]", "Announcement for the Foo Ltd and its clients", "Welcome", None, "Our company was hit"]
    rows = lambda df: sorted((x.asDict() for x in df.collect()), key=lambda x: order.index(x["post_title"]))
    once = rows(r)
    assert once[0]["organization"] == "Acme" and (once[0]["country"], once[0]["country_basis"]) == ("France", "flag_inferred") and once[0]["claim_details"]["extra"] == " kept " and len(once[0]["claim_details"]["description"]) == 500 and "deadline" not in once[0]["claim_details"]
    assert [x["post_type"] for x in once] == ["victim", "review", "headline", "review", "review"] and once[1]["organization"] == "Foo Ltd" and once[2]["organization"] is None
    assert rows(records.normalize_records(r)) == once


def test_observations_widen_and_keep(make, victims):
    first = seen(make, {"organization": "Acme", "post_title": "Acme", "record_id": "1", "group_id": "g", "source_id": "s1", "source_host": "h1", "observed_at": "2026-01-02T00:00:00Z", "claim_details": {"deadline": "a"}})
    h = merged(victims(), first)
    mirror = seen(make, {"organization": "ACME", "post_title": "ACME", "group_id": "G", "source_id": "s2", "source_host": "h2", "observed_at": "2026-01-03T00:00:00Z", "country": "France", "claim_details": {"file_count": "3"}})
    late = seen(make, {"organization": "Acme", "post_title": "Acme", "group_id": "g", "source_id": "s1", "observed_at": "2025-12-01T00:00:00Z"})
    results = []
    for batches in itertools.permutations([mirror, late]):
        out = h
        for b in batches:
            out = merged(out, b)
        results.append([r.asDict() for r in out.drop("group_id", "claim_details").collect()] + [out.select("claim_details").first()[0]])
    assert results[0] == results[1] and len(results[0]) == 2
    row = results[0][0]
    assert row["organization"] == "Acme" and row["record_id"] == "1" and row["country"] == "France" and row["first_seen_at"] == "2025-12-01T00:00:00Z" and row["last_seen_at"] == "2026-01-03T00:00:00Z" and row["source_ids"] == ["s1", "s2"] and row["source_id"] == "s1" and results[0][1] == {"deadline": "a", "file_count": "3"}


def test_unseen_listings_become_unknown_and_nothing_goes(make, victims):
    h = merged(victims(), seen(make, *[{"organization": o, "post_title": o, "group_id": "g", "source_id": "s1", "observed_at": "2026-01-02T00:00:00Z"} for o in ("Acme", "Bolt")]))
    out = merged(h, seen(make, {"organization": "Acme", "post_title": "Acme", "group_id": "g", "source_id": "s1", "observed_at": "2026-01-05T00:00:00Z"}))
    assert {r["organization"]: r["listing_state"] for r in out.collect()} == {"Acme": "listed", "Bolt": "unknown"}
    offline = merged(out, seen(make).limit(0), make([("g", "s1")], "group_id string, source_id string"))
    assert {r["listing_state"] for r in offline.collect()} == {"unknown"}
    state = history.aggregate_states(offline, make([("G",)], "group_id string"), make([("g", "bolt")], "group_id string, name string"))
    assert {r["organization"]: r["listing_state"] for r in state.collect()} == {"Acme": "unknown", "Bolt": "listed"}


def test_records_without_a_victim_go_by_source_and_record(make, victims):
    old = seen(make, {"post_title": "We have news", "record_id": "7", "group_id": "g", "source_id": "s1", "observed_at": "2026-01-02T00:00:00Z"})
    h = merged(victims(), old)
    again = merged(h, seen(make, {"post_title": "We have other news", "record_id": "7", "group_id": "g", "source_id": "s1", "observed_at": "2026-01-03T00:00:00Z"}))
    other = merged(h, seen(make, {"post_title": "We have news", "record_id": "7", "group_id": "g", "source_id": "s2", "observed_at": "2026-01-03T00:00:00Z"}))
    assert again.count() == 1 and again.first()["post_title"] == "We have news" and other.count() == 2


def test_archive_import(make, victims):
    groups = make([("acme-group", "Acme Group"), ("acmegroup", "Other"), ("solo", "Solo 3.0")], "group_id string, name string")
    posts = make(
        [("SOLO30", "Full data leak of Bolt Corp //", "2025-01-02T00:00:00Z"), ("solo", "Bolt Corp", "2025-01-05"), ("Solo 3.0", "*Bolt Corp*", "2025-01-03T00:00:00+00:00"), ("nobody", "Bolt Corp", "2025-01-03"), ("solo", "summary of the week", "2025-01-03"), ("solo", "Bolt Corp", "soon"), (None, None, None), ("acme group", "Bolt Corp", "2025-01-01")],
        "group_name string, post_title string, discovered string",
    )
    judged = archive.judged_posts(posts, groups)
    found = archive.archive_candidates(judged).collect()
    assert [(r["group_id"], r["organization"], r["first_seen_at"], r["last_seen_at"], r["archive_observations"], r["post_title"]) for r in found] == [("solo", "Bolt Corp", "2025-01-02T00:00:00Z", "2025-01-05T00:00:00Z", 3, "Bolt Corp")]
    live = victims({"id": "z", "group_id": "solo", "organization": "BOLT corp", "post_title": "BOLT corp", "post_type": "victim", "first_seen_at": "2026-01-01T00:00:00Z", "last_seen_at": "2026-01-02T00:00:00Z", "source_id": "s", "listing_state": "listed"})
    out = archive.import_archive(live, archive.archive_candidates(judged), "2026-03-01T00:00:00Z").collect()
    assert len(out) == 1 and out[0]["organization"] == "BOLT corp" and out[0]["first_seen_at"] == "2025-01-02T00:00:00Z" and out[0]["last_seen_at"] == "2026-01-02T00:00:00Z" and out[0]["historical_import"]["archive_observations"] == 3 and out[0]["source_ids"] == ["s"]
    new = archive.import_archive(victims(), archive.archive_candidates(judged), "2026-03-01T00:00:00Z").first()
    assert new["listing_state"] == "unknown" and new["post_type"] == "victim" and len(new["id"]) == 24
    s = archive.import_summary(judged, live, archive.archive_candidates(judged)).first().asDict()
    assert s == {"archive_rows": 8, "matched_archive_rows": 3, "excluded_headline_or_ambiguous": 1, "unmatched_group_rows": 3, "invalid_rows": 0, "invalid_timestamps": 1, "unique_group_organizations": 1, "new_sightings": 0, "existing_sightings_updated": 1, "matched_groups": 1, "sighting_total": 1}


def test_a_missing_alias_target_is_an_error(make):
    import pytest

    groups = make([("solo", "Solo")], "group_id string, name string")
    assert archive.group_keys(groups, {"lone": "solo"}).where(F.col("key") == "lone").count() == 1
    with pytest.raises(ValueError, match="gone"):
        archive.group_keys(groups, {"lone": "gone"})


def test_a_stream_merges_like_a_batch(spark, make, victims, tmp_path):
    from claimloom.streaming.merge import merging_writer

    rows = seen(make, *[{"organization": o, "post_title": o, "group_id": "g", "source_id": s, "observed_at": t} for o, s, t in (("Acme", "s1", "2026-01-02T00:00:00Z"), ("Acme", "s2", "2026-01-01T00:00:00Z"), ("Bolt", "s1", "2026-01-02T00:00:00Z"))])
    rows.write.parquet(str(tmp_path / "in"))
    victims().write.parquet(str(tmp_path / "history"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    merging_writer(stream, str(tmp_path / "history"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "history"))
    assert sorted((r["organization"], r["first_seen_at"], r["last_seen_at"], tuple(r["source_ids"])) for r in got.collect()) == [("Acme", "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z", ("s1", "s2")), ("Bolt", "2026-01-02T00:00:00Z", "2026-01-02T00:00:00Z", ("s1",))]
