"""The history of sightings: one row per victim, observations merged into it, and the state of each listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.collections import first_filled, known_sources, overlay
from claimloom.functions.keys import sighting_id, victim_key
from claimloom.functions.text import clean_text, normalize_name, nz
from claimloom.functions.times import order_key
from claimloom.operators.records import detail_entries, normalize_records
from claimloom.session import cut

FILLED = ("organization", "post_title", "record_id", "reported_date", "country", "country_basis", "sector", "source_host", "watchguard_profile_url")
_IMPORT = ("source", "earliest_discovered", "latest_discovered", "archive_observations", "archive_post_title", "imported_at")


def with_sources(df: DataFrame) -> DataFrame:
    return df.withColumn("source_ids", known_sources(F.col("source_ids"), F.col("source_id"), F.col("historical_import.matched_source_ids")))


def migrate(df: DataFrame) -> DataFrame:
    """Stored sightings in today's schema: headlines and reviews as they stand, all others normalised, victims still victims
    and with all their sources."""
    stored = F.coalesce(F.col("post_type").isin("headline", "review"), F.lit(False))
    other = with_sources(normalize_records(df.where(~stored).withColumn("__was", F.col("post_type").eqNullSafe("victim"))))
    other = other.withColumn("post_type", F.when(F.col("__was"), "victim").otherwise(F.col("post_type")))
    return df.where(stored).unionByName(other.select(df.columns))


def merge_copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``: that of the smallest id, its gaps filled from the others in the order of ids.

    First and last sighting are compared as times; sources, details and archive provenance are united; a listing is listed
    if any copy is. Two aggregations with partial results, so a key that a third of all rows share costs one row per input
    partition; nothing of a group is collected but the distinct sets of its sources.
    """
    at = F.col("id")
    sources = known_sources(F.col("source_ids"), F.col("source_id"), F.col("historical_import.matched_source_ids"))
    base = [c for c in df.columns if c not in {*FILLED, *keys, "id", "first_seen_at", "last_seen_at", "source_ids", "claim_details", "historical_import", "listing_state", "source_id"}]
    hist = F.col("historical_import")
    one = df.groupBy(*keys).agg(
        F.min("id").alias("id"), *[F.min_by(c, at).alias(c) for c in base], *[first_filled(F.col(c), at).alias(c) for c in FILLED],
        F.min_by(nz("first_seen_at"), F.when(nz("first_seen_at").isNotNull(), order_key(F.col("first_seen_at")))).alias("first_seen_at"),
        F.max_by(nz("last_seen_at"), F.when(nz("last_seen_at").isNotNull(), order_key(F.col("last_seen_at")))).alias("last_seen_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(sources)))).alias("source_ids"), F.min_by(nz("source_id"), at).alias("__primary"),
        F.when(F.max(F.when(F.col("listing_state") == "listed", 1)) == 1, "listed").otherwise("unknown").alias("listing_state"),
        *[first_filled(hist[c], at).alias(f"__h_{c}") for c in _IMPORT], F.flatten(F.collect_set(hist["matched_source_ids"])).alias("__h_ids"), F.max(hist.isNotNull()).alias("__h"),
    )
    provenance = F.struct(*[F.col(f"__h_{c}").alias(c) for c in _IMPORT], F.array_sort(F.array_distinct(F.filter("__h_ids", lambda x: nz(x).isNotNull()))).alias("matched_source_ids"))
    one = one.withColumn("historical_import", F.when(F.col("__h"), provenance)).withColumn("source_id", F.coalesce("__primary", F.get("source_ids", F.lit(0))))
    return one.join(detail_entries(df, keys, "id"), keys, "left").select(*[c for c in df.columns])


def canonical(df: DataFrame) -> DataFrame:
    """Sightings with one row per group and victim; headlines, reviews and victims without a name stay as they are."""
    stored = F.coalesce(F.col("post_type").isin("headline", "review"), F.lit(False))
    passed = df.where(stored)
    m = cut(migrate(df.where(~stored)).withColumn("__name", normalize_name(F.coalesce("organization", F.lit("")))).withColumn("__g", F.lower("group_id")))  # read three times
    named = (F.col("post_type") == "victim") & nz("__g").isNotNull() & (F.col("__name") != "")
    merged = merge_copies(m.where(named), ["__g", "__name"])
    rest = m.where(~F.coalesce(named, F.lit(False)))
    return passed.unionByName(merged.select(df.columns)).unionByName(rest.select(df.columns))


def latest_first(df: DataFrame, *then: str) -> DataFrame:
    """Rows as views list them: last seen, group and organisation, all descending; ties by ``then``, ascending, or by id.

    With ``then`` the number of a row in its input, earlier rows come first.
    """
    return df.orderBy(F.coalesce("last_seen_at", F.lit("")).desc(), F.lower(F.coalesce("group_name", F.lit(""))).desc(), F.lower(F.coalesce("organization", F.lit(""))).desc(), *(F.col(c) for c in then or ("id",)))


def _names(df: DataFrame) -> DataFrame:
    return df.withColumn("__org", normalize_name(F.coalesce("organization", F.lit("")))).withColumn("__title", normalize_name(F.coalesce("post_title", F.lit(""))))


def match_history(records: DataFrame, history: DataFrame) -> DataFrame:
    """``records`` with ``old_id``: the sighting that each continues, or null.

    The first of these that finds one: the same id; the same victim; the same source and record id; the same source and
    organisation, or title where there is none, unless both have record ids; an archived organisation of the group. Each is
    an equi-join; their results are ranked, ties going to the smallest id, of archived ones to the one last seen.
    ``records``: __rec (unique), __sid, group_id, source_id, record_id, post_type, __org, __title.
    """
    h = _names(with_sources(history)).withColumn("__g", F.lower("group_id"))
    r = records.select("__rec", "__sid", F.lower("group_id").alias("__g"), F.col("source_id").alias("__src"), F.lower(clean_text(F.col("record_id"))).alias("__rid"), "post_type", "__org", "__title")
    victim = (F.col("post_type") == "victim") & (F.col("__org") != "")
    by = lambda a, rank, tie=F.lit(""): a.select("__rec", F.struct(F.lit(rank).alias("rank"), tie.alias("late"), F.col("id").alias("id")).alias("m"))
    h_victim = h.where((F.col("post_type") == "victim") & (F.col("__org") != "")).select("id", "__g", "__org")
    h_src = h.select("id", "__g", F.lower(clean_text(F.col("record_id"))).alias("__hrid"), F.col("__org").alias("__horg"), F.col("__title").alias("__htitle"), F.explode("source_ids").alias("__src"))
    h_arch = h.where(F.col("historical_import").isNotNull() & (F.col("__org") != "")).select("id", "__g", "__org", "last_seen_at", "source_ids")
    same = r.join(h.select("id"), r["__sid"] == h["id"])
    identity = r.where(victim).join(h_victim, ["__g", "__org"])
    others = r.where(~F.coalesce(victim, F.lit(False)))
    record = others.where("__rid <> ''").join(h_src.withColumnRenamed("__hrid", "__rid"), ["__g", "__src", "__rid"])
    loose = (F.col("__rid") == "") | (F.col("__hrid") == "")
    by_org = others.where("__org <> ''").join(h_src.withColumnRenamed("__horg", "__org"), ["__g", "__src", "__org"]).where(loose)
    by_title = others.where("__org = '' and __title <> ''").join(h_src.withColumnRenamed("__htitle", "__title"), ["__g", "__src", "__title"]).where(loose)
    archived = others.where("__org <> ''").join(h_arch, ["__g", "__org"]).where(~F.array_contains("source_ids", F.col("__src")))
    found = by(same, 1).unionByName(by(identity, 2)).unionByName(by(record, 3)).unionByName(by(by_org, 4)).unionByName(by(by_title, 4))
    first = found.groupBy("__rec").agg(F.min("m").alias("m")).select("__rec", F.col("m.id").alias("near"))
    late = archived.groupBy("__rec").agg(F.max(F.struct(F.coalesce("last_seen_at", F.lit("")), "id")).alias("m")).select("__rec", F.col("m.id").alias("far"))
    return records.join(first, "__rec", "left").join(late, "__rec", "left").withColumn("old_id", F.coalesce("near", "far")).drop("near", "far")


def merge_observations(history: DataFrame, observed: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """The history after a batch of observations; its result doesn't depend on the order of the batch.

    ``observed``: normalised records with group_id, group_name, source_id, source_host, observed_at and
    watchguard_profile_url. Of a sighting, id, organisation, title and record id stay; date, country and sector follow the
    latest observation that has them; details are laid over; first and last sighting widen, late batches included; the state
    is listed. ``covered`` (group_id, source_id): sources that the batch looked at whole, by default those in ``observed``;
    their sightings that weren't observed become unknown. Nothing is ever removed.

    The history is migrated first, and written once, as it is read several times.
    """
    cols = history.columns
    history = cut(migrate(history))
    new = _names(observed.where(nz("post_title").isNotNull())).withColumn("__fallback", F.coalesce(nz("__org"), "__title"))
    new = new.withColumn("__sid", sighting_id(F.col("group_id"), F.col("source_id"), F.col("post_type"), F.col("__org"), F.col("record_id"), F.col("__fallback")))
    new = new.withColumn("__rec", F.sha2(F.to_json(F.struct("__sid", "group_id", "group_name", "source_id", "source_host", "record_id", "observed_at", "post_title", "organization", "reported_date", "country", "country_basis", "sector", "watchguard_profile_url", "claim_details")), 256)).dropDuplicates(["__rec"])
    new = cut(match_history(cut(new), history).withColumn("id", F.coalesce("old_id", "__sid")))
    at = F.struct(order_key(F.col("observed_at")).alias("at"), F.col("source_id").alias("s"), F.col("__rec").alias("r"))
    late = lambda c: F.max_by(F.when(nz(c).isNotNull(), F.col(c)), F.when(nz(c).isNotNull(), F.col("__at")))
    new = new.withColumn("__at", at)
    batch = new.groupBy("id").agg(
        *[F.max_by(c, "__at").alias(f"n_{c}") for c in ("group_id", "group_name", "watchguard_profile_url", "post_type")], *[F.min_by(c, "__at").alias(f"n_{c}") for c in ("organization", "post_title", "record_id", "source_id", "source_host")],
        *[late(c).alias(f"n_{c}") for c in ("reported_date", "country", "country_basis", "sector")], F.array_sort(F.collect_set("source_id")).alias("n_sources"),
        F.min_by("observed_at", order_key(F.col("observed_at"))).alias("n_first"), F.max_by("observed_at", order_key(F.col("observed_at"))).alias("n_last"),
    )
    latest = new.select("id", "__at", F.explode("claim_details").alias("k", "v")).where(nz("v").isNotNull()).groupBy("id", "k").agg(F.max_by("v", "__at").alias("v")).groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("n_details"))
    batch = batch.join(latest, "id", "left")
    seen = covered if covered is not None else observed.select("group_id", "source_id").distinct()
    seen = seen.select(F.lower("group_id").alias("__g"), F.col("source_id").alias("__s")).distinct()
    looked = with_sources(history).select("id", F.lower("group_id").alias("__g"), F.explode("source_ids").alias("__s")).join(seen, ["__g", "__s"], "left_semi").select("id").distinct().withColumn("__looked", F.lit(True))
    j = history.join(batch, "id", "full_outer").join(looked, "id", "left")
    hit, victim = F.col("n_post_type").isNotNull(), F.col("n_post_type") == "victim"
    earlier = F.when(nz("first_seen_at").isNotNull() & (order_key(F.col("first_seen_at")) <= order_key(F.col("n_first"))), F.col("first_seen_at")).otherwise(F.col("n_first"))
    later = F.when(nz("last_seen_at").isNotNull() & (order_key(F.col("last_seen_at")) > order_key(F.col("n_last"))), F.col("last_seen_at")).otherwise(F.col("n_last"))
    ids = known_sources(F.concat(F.coalesce("source_ids", F.array().cast("array<string>")), F.coalesce("n_sources", F.array().cast("array<string>"))), F.col("source_id"), F.col("historical_import.matched_source_ids"))
    matched = F.array_sort(F.array_distinct(F.concat(F.coalesce("historical_import.matched_source_ids", F.array().cast("array<string>")), F.col("n_sources"))))
    old = lambda c: F.coalesce(nz(c), F.col(f"n_{c}"))
    fresh = lambda c: F.coalesce(F.col(f"n_{c}"), F.col(c))
    primary = F.coalesce(nz("source_id"), "n_source_id")
    changed: dict[str, Column] = {
        **{c: fresh(c) for c in ("group_id", "group_name", "post_type", "watchguard_profile_url", "reported_date", "country", "country_basis", "sector")}, **{c: old(c) for c in ("organization", "post_title", "record_id")},
        "source_id": F.when(victim, primary).otherwise(F.col("n_source_id")), "source_host": F.coalesce(nz("source_host"), F.when(primary == F.col("n_source_id"), F.col("n_source_host"))),
        "source_ids": F.when(victim, ids), "first_seen_at": earlier, "last_seen_at": later, "listing_state": F.lit("listed"), "claim_details": overlay(F.col("claim_details"), F.col("n_details")),
        "historical_import": F.when(F.col("historical_import").isNotNull(), F.col("historical_import").withField("matched_source_ids", matched)),
    }
    unseen = {"listing_state": F.when(F.col("__looked"), "unknown").otherwise(F.col("listing_state"))}
    return j.select(*[F.col(c) if c == "id" else F.when(hit, changed[c]).otherwise(unseen.get(c, F.col(c))).alias(c) if c in changed else F.col(c) for c in cols])


def aggregate_states(history: DataFrame, active_groups: DataFrame, listed: DataFrame) -> DataFrame:
    """Victims' states by what any source of an active group listed: listed or unknown; other rows keep theirs.

    ``active_groups``: (group_id); ``listed``: (group_id, name) with names in normal form.
    """
    h = _names(history)
    key = victim_key(F.col("group_id"), F.col("post_type"), F.col("__org"))
    h = h.withColumn("__kg", key["group"]).withColumn("__kn", key["name"])
    live = listed.select(F.lower("group_id").alias("__kg"), F.col("name").alias("__kn")).distinct().join(active_groups.select(F.lower("group_id").alias("__kg")).distinct(), "__kg", "left_semi").withColumn("__live", F.lit(True))
    out = h.join(live, ["__kg", "__kn"], "left")
    return out.withColumn("listing_state", F.when(F.col("__kn").isNull(), F.col("listing_state")).when(F.col("__live"), "listed").otherwise("unknown")).select(history.columns)
