"""Back-filling the history from an archive of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.collections import known_sources
from claimloom.functions.keys import archive_id
from claimloom.functions.text import compact_name, normalize_name, nz
from claimloom.functions.times import iso_utc, moment
from claimloom.operators.records import classify_archive_titles
from claimloom.session import cut

# Labels of an archive and the ids of the groups they mean; they hold only with a catalog that has these groups.
APPROVED_ALIASES = {
    "lockbit3_fs": "lockbit-30", "lockbit3_cronos": "lockbit-30", "hunters": "hunters-international", "medusa": "medusa-blog", "quantum": "quantum-locker", "payloadbin": "payload",
    "trinity": "trinitylock", "cheers": "cheerscrypt", "unsafeleak": "unsafe", "dataleak": "dataleakes", "blacktor": "blckt0r", "malas": "malaslocker", "vendetta": "v-vendetta",
    "robinhood": "robbinhood", "lockbit3": "lockbit-30", "clop": "cl0p",
}


def group_keys(groups: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(key, group_id, group_name): compact names that mean one group. Keys of several groups are left out; aliases win.

    An alias whose group the catalog lacks is an error. The tables are those of the catalog, so the joins need no hint.
    """
    known = groups.where(nz("group_id").isNotNull()).select("group_id", F.coalesce(nz("name"), "group_id").alias("group_name"), "name")
    keys = known.select("group_id", "group_name", F.explode(F.array("group_id", "name")).alias("label")).withColumn("key", compact_name("label")).where("key <> ''")
    exact = keys.groupBy("key").agg(F.count_distinct("group_id").alias("n"), F.min("group_id").alias("group_id"), F.min("group_name").alias("group_name")).where("n = 1").drop("n")
    if not aliases:
        return exact
    given = groups.sparkSession.createDataFrame(sorted(aliases.items()), "label string, group_id string").withColumn("key", compact_name("label"))
    missing = given.join(known, "group_id", "left_anti").select("group_id").distinct().limit(5).collect()
    if missing:
        raise ValueError("aliases name groups that the catalog lacks: " + ", ".join(r[0] for r in missing))
    named = given.join(known.select("group_id", "group_name"), "group_id").select("key", "group_id", "group_name")
    return exact.join(named, "key", "left_anti").unionByName(named)


def judged_posts(posts: DataFrame, groups: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Posts with group, organisation, moment and ``outcome``: the first of invalid_row, unmatched_group, excluded,
    invalid_timestamp, else matched. Rows are invalid where the posts have a column ``valid`` that says so. Written once, as
    candidates and summary read it several times.
    """
    valid = F.coalesce(F.col("valid"), F.lit(False)) if "valid" in posts.columns else F.lit(True)
    p = classify_archive_titles(posts.select(F.col("group_name").alias("label"), "post_title", "discovered", valid.alias("valid"))).withColumn("key", compact_name(F.coalesce("label", F.lit(""))))
    p = p.join(group_keys(groups, aliases), "key", "left").withColumn("at", iso_utc(moment(F.col("discovered")))).withColumn("name", normalize_name(F.coalesce("organization", F.lit(""))))
    outcome = F.when(~F.col("valid"), "invalid_row").when(F.col("group_id").isNull(), "unmatched_group").when(F.col("organization").isNull(), "excluded").when(F.col("at").isNull(), "invalid_timestamp").otherwise("matched")
    return cut(p.withColumn("outcome", outcome))


def archive_candidates(judged: DataFrame) -> DataFrame:
    """One row per group and organisation of the matched posts: first and last discovery, number, title of the latest.

    Times are compared as texts. Of posts of one moment the smallest title is taken, as their order in the archive isn't kept.
    """
    m = judged.where("outcome = 'matched'")
    latest = m.groupBy("group_id", "name", "at").agg(F.min("post_title").alias("post_title")).groupBy("group_id", "name").agg(F.max_by("post_title", "at").alias("post_title"))
    c = m.groupBy("group_id", "name").agg(
        F.min("group_name").alias("group_name"), F.min_by("organization", F.struct("at", "post_title", "organization")).alias("organization"), F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"),
        F.count("*").cast("int").alias("archive_observations"), 
        F.min_by("country", F.when(F.col("country").isNotNull(), F.struct("at", "country"))).alias("country"), F.min_by("country_basis", F.when(F.col("country").isNotNull(), F.struct("at", "country"))).alias("country_basis"),
    )
    return c.join(latest, ["group_id", "name"]).withColumn("id", archive_id(F.col("group_id"), F.col("name")))


def import_archive(history: DataFrame, candidates: DataFrame, imported_at: str, source: str = "posts.txt") -> DataFrame:
    """The history with the candidates: those whose group and organisation it has widen its rows, the others are new rows."""
    c = candidates.select(*[F.col(x).alias(f"c_{x}") for x in candidates.columns])
    h = history.withColumn("__n", normalize_name(F.coalesce("organization", F.lit(""))))
    j = h.join(c, (h["group_id"] == c["c_group_id"]) & (F.col("__n") == c["c_name"]) & (F.col("__n") != "") & (h["group_id"] != ""), "full_outer")
    old, hit = F.col("id").isNotNull(), F.col("c_id").isNotNull()
    hist = F.col("historical_import")
    meta = F.struct(
        F.lit(source).alias("source"), F.col("c_first_seen_at").alias("earliest_discovered"), F.col("c_last_seen_at").alias("latest_discovered"), F.col("c_archive_observations").alias("archive_observations"),
        F.col("c_post_title").alias("archive_post_title"), F.coalesce(nz(hist["imported_at"]), F.lit(imported_at)).alias("imported_at"), hist["matched_source_ids"].alias("matched_source_ids"),
    )
    low = F.least(F.coalesce(nz("first_seen_at"), "c_first_seen_at"), F.col("c_first_seen_at"))
    high = F.when(nz("source_id").isNotNull(), F.col("last_seen_at")).otherwise(F.greatest(F.coalesce(nz("last_seen_at"), "c_last_seen_at"), F.col("c_last_seen_at")))
    widened = {
        "id": F.coalesce("id", "c_id"), "group_id": F.coalesce("group_id", "c_group_id"), "group_name": F.coalesce("group_name", F.when(~old, F.col("c_group_name"))), "organization": F.coalesce(nz("organization"), "c_organization"),
        "post_title": F.coalesce("post_title", F.when(~old, F.col("c_post_title"))), "post_type": F.lit("victim"), "country": F.coalesce(nz("country"), "c_country"), "country_basis": F.when(nz("country").isNotNull(), F.col("country_basis")).otherwise(F.col("c_country_basis")),
        "first_seen_at": low, "last_seen_at": high, "listing_state": F.when(old, F.col("listing_state")).otherwise("unknown"), "source_ids": F.when(old, known_sources(F.col("source_ids"), F.col("source_id"), hist["matched_source_ids"])).otherwise(F.array().cast("array<string>")),
        "historical_import": meta,
    }
    return j.select(*[F.when(hit, widened[c]).otherwise(F.col(c)).alias(c) if c in widened else F.col(c) for c in history.columns])


def import_summary(judged: DataFrame, history: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of counts: what became of the posts, and of the history if the import is applied."""
    h = history.withColumn("__n", normalize_name(F.coalesce("organization", F.lit("")))).where("__n <> '' and group_id <> ''")
    posts = judged.agg(F.count("*").alias("archive_rows"), *[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("matched", "matched_archive_rows"), ("excluded", "excluded_headline_or_ambiguous"), ("unmatched_group", "unmatched_group_rows"), ("invalid_row", "invalid_rows"), ("invalid_timestamp", "invalid_timestamps"))])
    hits = candidates.select("group_id", F.col("name").alias("__n")).join(h.groupBy("group_id", "__n").agg(F.count("*").alias("rows")), ["group_id", "__n"], "left")
    found = hits.agg(F.count("*").alias("unique_group_organizations"), F.count_if(F.col("rows").isNull()).alias("new_sightings"), F.coalesce(F.sum("rows"), F.lit(0)).alias("existing_sightings_updated"), F.count_distinct("group_id").alias("matched_groups"))
    total = history.agg(F.count("*").alias("__h"))
    return posts.join(found, F.lit(True)).join(total, F.lit(True)).withColumn("sighting_total", F.col("__h") + F.col("new_sightings")).drop("__h")
