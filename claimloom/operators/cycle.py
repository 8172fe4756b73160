"""One run over the captured pages: from catalog, captures and what was known to the next history, sources, groups and run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import normalize_name, nz
from claimloom.functions.urls import host
from claimloom.operators import history, html, records, rollups
from claimloom.session import cut

#: An error that stands for a crawl stopped by its budget.
BUDGET = "crawl_budget_reached"


@dataclass
class Run:
    """What a run leaves: tables to replace the previous ones, and one row about itself."""

    history: DataFrame
    sources: DataFrame
    groups: DataFrame
    run: DataFrame


def observed_records(captures: DataFrame, adapters: dict | None = None) -> DataFrame:
    """The records that admitted captures list, one for each listing of a source."""
    latest = rollups.within_page_limit(rollups.latest_captures(captures)).where(rollups.capture_outcome().isNull())
    return records.dedupe_records(records.normalize_records(html.page_records(html.parsed_pages(latest, adapters))), ["source_id"], ["page_no", "pos"])


def source_rows(groups: DataFrame, captures: DataFrame, found: DataFrame, prior: DataFrame, at: str) -> DataFrame:
    """One row for each source of the catalog or of before, with what became of it in this run.

    A source that would be crawled but has no capture fell to the budget. Skipped sources keep host, parser and time of their
    last check; those that the catalog no longer has count nothing and keep the rest.
    """
    named = groups.select("group_id", F.coalesce(nz("name"), "group_id").alias("group_name"), F.col("profile_url").alias("watchguard_profile_url"))
    plan = rollups.planned_sources(groups).where("plan <> 'invalid_url'").groupBy("source_id").agg(F.min("group_id").alias("group_id"), F.min("plan").alias("plan"), F.min(host(F.col("url"))).alias("host"))
    latest = rollups.latest_captures(captures)
    result = rollups.source_results(latest).select("source_id", F.col("status").alias("r_status"), F.col("error").alias("r_error"), F.col("error_type").alias("r_type"), "pages_scanned", F.col("http_status").cast("int").alias("http_status"))
    limit = rollups.within_page_limit(latest.select("source_id", "page_no")).groupBy("source_id").agg(F.bool_or("page_limit_reached").alias("page_limit_reached"))
    old = prior.select("source_id", *[F.col(c).alias(f"p_{c}") for c in ("group_id", "group_name", "source_host", "checked_at", "parser", "watchguard_profile_url")])
    j = plan.join(named, "group_id", "left").join(result, "source_id", "left").join(limit, "source_id", "left").join(rollups.source_counts(found), "source_id", "left").join(old, "source_id", "full_outer")
    here, read = F.col("plan").isNotNull(), (F.col("plan") == "crawl") & F.col("r_status").isNotNull()
    status = F.when(~here, "not_in_catalog").when(read, F.col("r_status")).when(F.col("plan") == "crawl", "skipped_budget").otherwise(F.col("plan"))
    count = lambda c: F.when(read, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("int").alias(c)
    return j.select(
        "source_id", F.coalesce("group_id", "p_group_id").alias("group_id"), F.coalesce("group_name", "p_group_name").alias("group_name"), F.coalesce("p_source_host", "host").alias("source_host"), status.alias("status"),
        F.when(read, F.lit(at)).otherwise(F.col("p_checked_at")).alias("checked_at"), F.lit(at).alias("status_updated_at"), count("pages_scanned"), count("victims_found"), count("posts_review"), F.col("p_parser").alias("parser"),
        F.when(read, F.col("r_error")).alias("error"), F.when(read, F.col("r_type")).alias("error_type"), F.when(read, F.col("http_status")).alias("http_status"),
        (read & F.coalesce("page_limit_reached", F.lit(False))).alias("page_limit_reached"), F.coalesce("watchguard_profile_url", "p_watchguard_profile_url").alias("watchguard_profile_url"),
    )


def run_row(sources: DataFrame, sightings: DataFrame, at: str) -> DataFrame:
    """One row about a run: when, whether its budget cut it short, how much it read, and what it knows."""
    current = F.col("status") != "not_in_catalog"
    told = sources.agg(
        F.coalesce(F.bool_or((F.col("status") == "skipped_budget") | (current & F.col("error").eqNullSafe(BUDGET))), F.lit(False)).alias("crawl_partial"), F.count_if(current).alias("sources"), F.count_if(F.col("status") == "ok").alias("sources_ok"),
        F.count_if(F.col("status") == "skipped_budget").alias("sources_skipped_budget"), F.coalesce(F.sum("pages_scanned"), F.lit(0)).alias("pages_scanned"),
    )
    return told.join(sightings.agg(F.count("*").alias("sightings")), F.lit(True)).select(F.lit(at).alias("updated_at"), "*")


def run(groups: DataFrame, captures: DataFrame, sources: DataFrame, past: DataFrame, at: str, adapters: dict | None = None) -> Run:
    """A whole run: records read from the captures, merged into the history, and the state of every listing and source.

    Every source of the catalog or of before is looked at: what none of them lists any longer becomes unknown, and a victim is
    listed only if a source of an active group listed it in this run. Nothing is ever removed.
    """
    found = cut(observed_records(captures, adapters))
    rows = cut(source_rows(groups, captures, found, sources, at))
    known = rows.where("status <> 'not_in_catalog'").select("source_id", "group_id", "group_name", "source_host", "watchguard_profile_url")
    seen = cut(found.join(known, "source_id").withColumn("observed_at", F.lit(at)))
    merged = history.canonical(cut(history.merge_observations(past, seen, covered=rows.select("group_id", "source_id"))))
    listed = seen.where("post_type = 'victim'").select("group_id", normalize_name(F.coalesce("organization", F.lit(""))).alias("name")).where("name <> ''")
    active = groups.where(F.lower("status") == "active").select("group_id")
    after = cut(history.aggregate_states(merged, active, listed))
    current = rows.where("status <> 'not_in_catalog'")
    return Run(after, rows, rollups.group_status(groups, current).withColumn("checked_at", F.lit(at)), run_row(rows, after, at))
