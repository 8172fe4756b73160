"""The query surface: victims filtered, searched, sorted and paged, with their metrics and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import displayed_name, nz, search_text, state, state_label, usable_name, view_type
from claimloom.functions.times import claim_day

PAGE_SIZE = 100


def victims(df: DataFrame) -> DataFrame:
    """The sightings that the view counts as victims."""
    return df.where(view_type(F.col("post_type"), F.col("organization"), F.col("post_title")) == "victim")


def filtered(df: DataFrame, query: str = "", group_id: str = "", country: str = "", listing_state: str = "") -> DataFrame:
    """Victims that hold the query, in any of the searched columns, and equal each of the filters that is given."""
    out = victims(df)
    q = query.strip().lower()
    if q:
        out = out.where(F.contains(search_text(F.col("organization"), F.col("group_name"), F.col("country"), F.col("sector"), F.col("reported_date")), F.lit(q)))
    for column, value in (("group_id", group_id), ("country", country)):
        if value:
            out = out.where(F.col(column) == value)
    return out.where(state(F.col("listing_state")) == listing_state) if listing_state else out


def ordered(df: DataFrame) -> DataFrame:
    """Latest claims first, then by name and group without regard to case and accents, with numbers by value, then by id."""
    numeric = lambda c: F.collate(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(\d+)", "000000000000$1"), r"\d*(\d{12})(?!\d)", "$1"), "UNICODE_CI_AI")
    shown = displayed_name(F.col("organization"), F.col("post_title"))
    return df.orderBy(claim_day(F.col("reported_date"), F.col("first_seen_at")).desc(), numeric(shown), numeric(F.col("group_name")), F.col("id"))


def page(df: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of the ordered rows; numbers beyond the last page give the last. Spark takes the first rows without a full sort."""
    pages = max(1, -(-df.count() // size)) if number > 1 else 1
    return ordered(df).offset((min(max(number, 1), pages) - 1) * size).limit(size)


def metrics(df: DataFrame, sources: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: victims, those listed, groups and sources."""
    v = victims(df).agg(F.count("*").alias("total"), F.count_if(state(F.col("listing_state")) == "listed").alias("listed"))
    return v.join(groups.agg(F.count("*").alias("groups")), F.lit(True)).join(sources.agg(F.count("*").alias("sources")), F.lit(True))


def facets(df: DataFrame) -> DataFrame:
    """(facet, value, label): the groups and countries that a view offers as filters; a group's name is the one last seen."""
    v = victims(df)
    g = v.where(nz("group_id").isNotNull() & nz("group_name").isNotNull()).groupBy("group_id").agg(F.max_by("group_name", F.struct("last_seen_at", "id")).alias("label"))
    c = v.where(nz("country").isNotNull()).select("country").distinct()
    return g.select(F.lit("group").alias("facet"), F.col("group_id").alias("value"), "label").unionByName(c.select(F.lit("country").alias("facet"), F.col("country").alias("value"), F.col("country").alias("label")))


def rows(df: DataFrame) -> DataFrame:
    """What the view shows of each row."""
    name = displayed_name(F.col("organization"), F.col("post_title"))
    other = F.when(usable_name(F.col("post_title")) & (F.lower(F.trim("post_title")) != F.lower(name)), F.col("post_title"))
    note = F.when(F.col("country_basis") == "flag_inferred", "Inferred from flag")
    return df.select("id", name.alias("name"), other.alias("title"), F.col("group_name"), F.col("country"), note.alias("country_note"), F.col("sector"), claim_day(F.col("reported_date"), F.col("first_seen_at")).alias("day"), state_label(F.col("listing_state")).alias("state"))
