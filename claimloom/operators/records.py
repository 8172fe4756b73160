"""Listing records: normal form of one row, one record per listing, and archive titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.collections import first_filled
from claimloom.functions.text import AMBIGUOUS, UNSUPPORTED, announced_name, bounded, clean_text, clean_title, country_from_flag, ingest_type, looks_like_organization, normalize_name, nz, undecorated, wrapped_organization
from claimloom.session import bind

#: Details that have a bound; others are kept as they are.
DETAIL_BOUNDS = {"description": 500, "claimed_data_size": 240, "file_count": 240, "deadline": 240, "organization_website": 240}


def bounded_details(details: Column) -> Column:
    """The known details cleaned and cut to their bounds, blank ones left out; null where none is left."""
    known = lambda k: k.isin(*DETAIL_BOUNDS)
    cut = F.transform_values(details, lambda k, v: F.when(k == "description", bounded(v, 500)).when(known(k), bounded(v, 240)).otherwise(v))
    kept = F.map_filter(cut, lambda k, v: ~known(k) | v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def normalize_records(df: DataFrame, type_column: str = "post_type") -> DataFrame:
    """Rows in the public schema: bounded texts, type and organisation by title, country with its basis.

    Needs organization, post_title, reported_date, country, country_basis, sector, claim_details; all other columns stay.
    Applied twice it gives the same. The texts are cleaned once per row; only the names cross to Python to be folded.
    """
    before = df.columns
    title = bounded(F.coalesce(nz("post_title"), F.col("organization")), 500)
    df = bind(df, "__t", F.struct(title.alias("title"), bounded(F.col("organization"), 240).alias("raw"), bounded(F.col("country"), 120).alias("country")))
    spoken = clean_text(F.coalesce(F.col("__t.raw"), F.col("__t.title"), F.lit("")))
    df = bind(df, "__c", F.struct(clean_title(spoken).alias("org"), country_from_flag(spoken)[0].alias("flag"), *[c.alias(n) for n, c in zip(("own_flag", "own_text"), country_from_flag(F.coalesce(F.col("__t.country"), F.lit(""))), strict=True)]))
    df = bind(df, "__h", clean_title(F.coalesce(F.col("__t.title"), F.col("__c.org"))))
    df = df.withColumn("__n", normalize_name("__h"))
    df = bind(df, "__k", ingest_type(F.col("__h"), F.col("__n")))
    candidate = nz(clean_text(F.coalesce(nz(F.col("__c.org")), F.col("__h"))))
    announced = F.lower("__h").rlike(r"^(?:important\s+)?announcement\b")
    organization = (
        F.when((F.col("__h") == "") | (F.col("__n") == ""), F.lit(None))
        .when(F.col("__k") == "headline", F.lit(None))
        .when((F.col("__k") == "review") & announced, announced_name(F.col("__h")))
        .when((F.col("__k") == "victim") & F.col("__t.raw").isNotNull(), F.coalesce(nz(F.col("__c.org")), F.col("__t.raw")))
        .otherwise(candidate)
    )
    country = F.coalesce(nz(F.col("__c.own_text")), F.col("__c.own_flag"), F.col("__c.flag"))
    basis = F.when(country.isNull(), F.lit(None)).when(F.col("country_basis").isin("explicit", "flag_inferred"), F.col("country_basis")).when(nz(F.col("__c.own_text")).isNotNull(), "explicit").otherwise("flag_inferred")
    new = {
        "post_title": F.col("__t.title"), type_column: F.col("__k"), "organization": organization, "reported_date": bounded(F.col("reported_date"), 120),
        "country": country, "country_basis": basis, "sector": bounded(F.col("sector"), 160), "claim_details": bounded_details(F.col("claim_details")),
    }
    return df.select(*[new.pop(c).alias(c) if c in new else F.col(c) for c in before], *[c.alias(n) for n, c in new.items()])


def detail_entries(df: DataFrame, keys: list[str], order: str, details: str = "claim_details") -> DataFrame:
    """(keys, claim_details): of each detail's key the first value in ``order`` that isn't empty."""
    entries = df.select(*keys, order, F.explode(details).alias("k", "v")).where(nz("v").isNotNull())
    return entries.groupBy(*keys, "k").agg(F.min_by("v", order).alias("v")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(details))


def dedupe_records(records: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """One record per listing of a scope, the first in ``order``, its gaps filled from the later ones.

    A victim is told by its name, other records by their id, else by type and name or title. ``records`` are normalised.
    """
    df = records.withColumn("__name", normalize_name(F.coalesce("organization", F.lit("")))).withColumn("__title", normalize_name(F.coalesce("post_title", F.lit(""))))
    rid = clean_text(F.col("record_id"))
    key = F.when((F.col("post_type") == "victim") & (F.col("__name") != ""), F.concat(F.lit("victim:"), F.col("__name"))).when(rid != "", F.concat(F.lit("record:"), F.lower(rid))).otherwise(F.concat("post_type", F.lit(":"), F.coalesce(nz("__name"), "__title")))
    df = df.withColumn("__key", key).withColumn("__ord", F.struct(*order))
    filled = ("record_id", "reported_date", "country", "country_basis", "sector")
    plain = [c for c in records.columns if c not in {*filled, *scope, "claim_details"}]
    on = [*scope, "__key"]
    one = df.groupBy(*on).agg(*[F.min_by(c, "__ord").alias(c) for c in plain], *[first_filled(F.col(c), F.col("__ord")).alias(c) for c in filled])
    return one.join(detail_entries(df, on, "__ord"), on, "left").select(*records.columns)


def classify_archive_titles(df: DataFrame, title: str = "post_title") -> DataFrame:
    """``df`` with ``organization``, ``country`` and ``country_basis`` of the victim that a title names; null where it names none."""
    before = [c for c in df.columns if c != title]
    df = bind(df, "__orig", F.left(clean_text(F.col(title)), F.lit(500)))
    df = bind(df, "__bare", undecorated(F.col("__orig")))
    df = bind(df, "__wrapped", wrapped_organization(F.col("__bare")))
    record = df.select(*before, "__orig", "__bare", "__wrapped", F.col("__bare").alias("post_title"), F.coalesce("__wrapped", "__bare").alias("organization"), *[F.lit(None).cast("string").alias(c) for c in ("reported_date", "country", "country_basis", "sector")], F.lit(None).cast("map<string,string>").alias("claim_details"))
    n = normalize_records(record, "__type")
    usable = (F.col("__bare") != "") & ~F.col("__bare").rlike(UNSUPPORTED)
    plain = ~F.col("__bare").rlike(AMBIGUOUS) & (F.col("__type") == "victim") & looks_like_organization(F.col("organization"))
    org = F.when(usable & F.col("__wrapped").isNotNull(), F.col("__wrapped")).when(usable & plain, F.col("organization"))
    return n.select(*before, F.col("__orig").alias(title), org.alias("organization"), F.when(org.isNotNull(), F.col("country")).alias("country"), F.when(org.isNotNull(), F.col("country_basis")).alias("country_basis"))
