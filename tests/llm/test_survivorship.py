"""Survivors against a plain second implementation."""

import random

from pyspark.sql import functions as F

from claimloom.llm.survivorship import survivors


def plain(rows):
    groups = {}
    for r in rows:
        if r.get("group_id") is not None and r.get("record_id") is not None:
            groups.setdefault((r["group_id"].lower(), r["record_id"].lower()), []).append(r)
    out = []
    for g in groups.values():
        if len(g) < 2:
            continue
        sid = min(r["id"] for r in g)
        out.append((sid, "listing_state", "listed" if any((r.get("listing_state") or "").strip().lower() == "listed" for r in g) else "unknown"))
        ids = {x for r in g for x in [*(r.get("source_ids") or []), r.get("source_id"), *((r.get("historical_import") or (None,) * 7)[6] or [])] if x and x.strip()}
        if ids:
            out.append((sid, "source_ids", ",".join(sorted(ids))))
        seen = [r["first_seen_at"] for r in g if r.get("first_seen_at")]
        if seen:
            out.append((sid, "first_seen_at", min(seen)[:-1] + ".000000Z"))
        for k in {k for r in g for k in (r.get("claim_details") or {})}:
            best = max(((r["last_seen_at"], r["id"], r["claim_details"][k]) for r in g if (r.get("claim_details") or {}).get(k) not in (None, "", "n/a", "—", "TBA")), default=None)
            if best:
                out.append((sid, "claim_details." + k, best[2]))
    return sorted(out)


def test_against_a_plain_version(victims, conventions):
    rnd = random.Random(7)
    pick = lambda *xs: rnd.choice(xs)
    rows = []
    for i in range(400):
        rows.append({
            "id": f"{i:04d}", "group_id": pick("G", "g", "h", None), "record_id": pick("1", "a", "A", "2", None), "source_id": pick("s1", "s2", None), "source_ids": pick(None, [], ["s3", "s1"], ["s3", None, ""]),
            "listing_state": pick("listed", " LISTED", "unknown", None), "first_seen_at": pick(None, "2023-01-04T01:02:03Z", "2022-01-04T01:02:03Z"), "last_seen_at": f"2023-01-{pick(*range(10, 28))}T00:00:00Z",
            "claim_details": pick(None, {}, {"deadline": "TBA"}, {"deadline": f"{i} days", "x": "y"}, {"deadline": "", "file_count": "n/a"}), "historical_import": pick(None, (None, None, None, None, None, None, ["m1", "s1"])),
        })
    out = survivors(victims(*rows), conventions())
    assert sorted(tuple(r) for r in out.collect()) == plain(rows)


def test_hot_group_and_empty_table(victims, conventions):
    rows = [{"id": f"{i:05d}", "group_id": "g", "record_id": "r", "source_id": "s", "last_seen_at": "2023-01-10T00:00:00Z", "claim_details": {"deadline": str(i)}} for i in range(3000)]
    got = {r["field_name"]: r["field_value"] for r in survivors(victims(*rows), conventions()).collect()}
    assert got == {"listing_state": "unknown", "source_ids": "s", "claim_details.deadline": "2999"}
    assert survivors(victims(), conventions()).count() == 0


def test_trust_goes_before_time(victims, conventions):
    rows = [
        {"id": "a", "group_id": "g", "record_id": "1", "source_id": "s", "first_seen_at": "2024-03-01T00:00:00Z", "last_seen_at": "2024-05-01T00:00:00Z", "claim_details": {"description": "new", "deadline": "n/a"}},
        {"id": "b", "group_id": "G", "record_id": "1", "source_id": "t", "first_seen_at": "2024-03-01", "last_seen_at": "2024-04-01T00:00:00Z", "claim_details": {"description": "old"}},
    ]
    value = lambda trust=None: {r["field_name"]: r["field_value"] for r in survivors(victims(*rows), conventions(), trust).collect()}
    plain, trusted = value(), value(F.when(F.col("source_id") == "t", 1).otherwise(0))
    assert plain["claim_details.description"] == "new" and trusted["claim_details.description"] == "old"
    assert plain["first_seen_at"] == "2024-03-01" and "claim_details.deadline" not in plain
