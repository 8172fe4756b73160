"""Content-derived keys: prefixes of SHA-256 over parts joined by a zero character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import clean_text, nz
from claimloom.functions.urls import canonical_url


def digest(length: int, *parts: Column) -> Column:
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.char(F.lit(0)), p)
    return F.left(F.sha2(joined, 256), F.lit(length))


def source_id(url: Column, group_id: Column) -> Column:
    """The id of a source: of its group and canonical URL, or the URL as it stands where that isn't valid."""
    return digest(20, F.lower(F.coalesce(group_id, F.lit(""))), F.coalesce(canonical_url(url), url))


def sighting_id(group_id: Column, source: Column, post_type: Column, name: Column, record_id: Column, fallback_name: Column) -> Column:
    """The id of a sighting. Victims go by group and name, so that mirrors collapse; others by group, source and record."""
    g, rid = F.lower(group_id), clean_text(record_id)
    return F.when((post_type == "victim") & (name != ""), digest(24, g, F.concat(F.lit("victim:"), name))).otherwise(
        digest(24, g, source, F.when(rid != "", F.concat(F.lit("record:"), F.lower(rid))).otherwise(F.concat(post_type, F.lit(":"), fallback_name)))
    )


def archive_id(group_id: Column, name: Column) -> Column:
    """The id of an archive's organisation; the group's case matters."""
    return digest(24, F.lit("historical-posts"), group_id, name)


def victim_key(group_id: Column, post_type: Column, name: Column) -> Column:
    """(group, name) of a victim that has both, else null."""
    return F.when((post_type == "victim") & nz(group_id).isNotNull() & nz(name).isNotNull(), F.struct(F.lower(group_id).alias("group"), name.alias("name")))
