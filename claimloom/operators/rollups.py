"""Roll-ups of sources, groups and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.keys import source_id
from claimloom.functions.text import nz
from claimloom.functions.urls import canonical_url, host, same_host

CONTENT_TYPES = ("text/html", "application/xhtml+xml", "text/plain")
_MISPLACED = ("unsupported_layout", "redirect_host_changed", "invalid_response_url")


def capture_outcome(max_bytes: int = 2_000_000) -> Column:
    """Why a capture isn't admitted, null where it is: failed fetch, status, content type, size, or a redirect to another host."""
    kind = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
    allowed = [kind.startswith(t) for t in CONTENT_TYPES]
    return (
        F.when(nz("fetch_error").isNotNull(), F.coalesce(nz("error_type"), F.col("fetch_error")))
        .when(F.col("http_status") >= 400, F.concat(F.lit("http_"), F.col("http_status").cast("string")))
        .when((kind != "") & ~(allowed[0] | allowed[1] | allowed[2]), "unsupported_content_type")
        .when(F.octet_length("body") > max_bytes, "response_too_large")
        .when(~same_host(F.coalesce("response_url", "requested_url"), F.col("requested_url")), "redirect_host_changed")
        .when(F.col("body").isNull(), "empty_body")
    )


def latest_captures(captures: DataFrame) -> DataFrame:
    """Of each source's page the capture fetched last, admitted ones first; of captures of one moment that of the smallest digest.

    One aggregation of structs that the bodies aren't compared in; a page captured again and again is a row per input partition.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(captures.columns))), 256)
    best = F.max_by(F.struct(*captures.columns), F.struct(capture_outcome().isNull().alias("ok"), F.col("fetched_at").alias("at"), F.translate(digest, "0123456789abcdef", "fedcba9876543210").alias("tie")))
    return captures.groupBy(F.col("source_id").alias("__s"), F.col("page_no").alias("__p")).agg(best.alias("c")).select("c.*")


def within_page_limit(captures: DataFrame, limit: int = 25) -> DataFrame:
    """The first ``limit`` pages of each source, with ``page_limit_reached`` where it has more; pages without number come first.

    Only distinct page numbers are ranked, a small table that the rows are then joined with.
    """
    w = Window.partitionBy("source_id")
    ranked = captures.select("source_id", "page_no").distinct().withColumn("__r", F.row_number().over(w.orderBy("page_no"))).withColumn("page_limit_reached", F.count("*").over(w) > limit)
    first = ranked.where(F.col("__r") <= limit).select(F.col("source_id").alias("__s"), F.col("page_no").alias("__p"), "page_limit_reached")
    return captures.join(first, captures["source_id"].eqNullSafe(first["__s"]) & captures["page_no"].eqNullSafe(first["__p"])).drop("__s", "__p")


def source_results(captures: DataFrame) -> DataFrame:
    """One row per source of its captures: status, first error, sorted kinds of error, pages, last status code.

    partial: some pages failed; unsupported: none worked, for reasons of layout only; offline: none worked; else ok.
    """
    c = captures.withColumn("__e", capture_outcome())
    g = c.groupBy("source_id").agg(
        F.max(host(F.col("requested_url"))).alias("source_host"), F.count("*").alias("pages_scanned"), F.count_if(F.col("__e").isNull()).alias("__ok"), F.count("__e").alias("__bad"),
        F.every(F.col("__e").isNull() | F.col("__e").isin(*_MISPLACED)).alias("__layout"), F.min(F.when(F.col("__e").isNotNull(), F.struct("page_no", "__e"))).alias("__first"),
        F.array_join(F.array_sort(F.collect_set("__e")), ",").alias("error_type"), F.max(F.struct("page_no", "fetched_at", "http_status"))["http_status"].alias("http_status"),
    )
    status = F.when(F.col("__bad") == 0, "ok").when(F.col("__ok") > 0, "partial").when(F.col("__layout"), "unsupported").otherwise("offline")
    error = F.when(status == "partial", "page_errors").when(status != "ok", F.col("__first.__e"))
    return g.select("source_id", "source_host", status.alias("status"), error.alias("error"), nz("error_type").alias("error_type"), "pages_scanned", F.col("__ok").alias("pages_ok"), "http_status")


def group_status(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per group: its status by those of its sources, and how many there are, are ok, were skipped."""
    s = sources.groupBy(F.lower("group_id").alias("__g")).agg(
        F.count("*").alias("sources_total"), F.count_if(F.col("status") == "ok").alias("sources_ok"), F.count_if(F.col("status").startswith("skipped_")).alias("sources_skipped"),
        F.count_distinct("status").alias("__k"), F.min("status").alias("__s"), F.max("checked_at").alias("checked_at"),
    )
    j = groups.join(s, F.lower(groups["group_id"]) == s["__g"], "left")
    alike = ("ok", "skipped_budget", "skipped_unscoped_catalog", "offline", "unsupported", "skipped_inactive")
    active = F.lower(F.coalesce(groups["status"], F.lit("unknown"))) == "active"
    status = F.when(~active, "skipped_inactive").when(F.col("sources_total").isNull(), "no_source").when((F.col("__k") == 1) & F.col("__s").isin(*alike), F.col("__s")).otherwise("partial")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(groups["group_id"], groups["name"], F.when(active, "active").otherwise("non_active").alias("eligibility"), status.alias("crawl_status"), "checked_at", zero("sources_total"), zero("sources_ok"), zero("sources_skipped"))


def shared_endpoints(groups: DataFrame) -> DataFrame:
    """(url, groups, source_ids): each canonical URL once, with the groups that publish on it and its ids as their source."""
    e = groups.select("group_id", F.explode("leak_sites").alias("s")).withColumn("url", canonical_url(F.col("s.url"))).where("url is not null")
    return e.groupBy("url").agg(F.array_sort(F.collect_set("group_id")).alias("groups"), F.array_sort(F.collect_set(source_id(F.col("s.url"), F.col("group_id")))).alias("source_ids"))


def planned_sources(groups: DataFrame) -> DataFrame:
    """What a crawl would do with every endpoint of the catalog: crawl it, or why not."""
    e = groups.select("group_id", "status", "leak_sites_scope", F.explode("leak_sites").alias("s")).withColumn("url", canonical_url(F.col("s.url")))
    plan = F.when(F.lower(F.coalesce("status", F.lit("unknown"))) != "active", "skipped_inactive").when(~F.col("leak_sites_scope").eqNullSafe("extortion_links"), "skipped_unscoped_catalog").when(F.col("url").isNull(), "invalid_url").otherwise("crawl")
    return e.select("group_id", F.col("s.kind").alias("kind"), F.col("s.url").alias("given_url"), "url", source_id(F.col("s.url"), F.col("group_id")).alias("source_id"), plan.alias("plan"))


def not_in_catalog(sources: DataFrame, groups: DataFrame) -> DataFrame:
    """Sources whose group or host is gone from the catalog, with their counts set to zero."""
    live = groups.select(F.lower("group_id").alias("g"), F.explode("leak_sites").alias("s")).select("g", host(F.col("s.url")).alias("h")).distinct()
    gone = sources.join(live, (F.lower(sources["group_id"]) == live["g"]) & (F.lower(sources["source_host"]) == live["h"]), "left_anti")
    return gone.select("source_id", "group_id", F.lit("not_in_catalog").alias("status"), F.lit(0).alias("pages_scanned"), F.lit(0).alias("victims_found"), F.lit(0).alias("posts_review"))


def carried_over(new: DataFrame, prior: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``new`` sources with the columns ``keep`` taken from their prior record where a source was skipped."""
    p = prior.select("source_id", *[F.col(c).alias(f"__{c}") for c in keep])
    skipped = F.col("status").startswith("skipped_")
    j = new.join(p, "source_id", "left")
    return j.select(*[F.when(skipped, F.coalesce(f"__{c}", c)).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in new.columns])


def carried_endpoints(new: DataFrame, previous: DataFrame) -> DataFrame:
    """Groups whose profile is offline keep the previous catalog's endpoints, if those were scoped."""
    p = previous.select("group_id", F.col("leak_sites").alias("__sites"), F.col("leak_sites_scope").alias("__scope"))
    use = (F.col("profile_status") == "offline") & F.col("__scope").eqNullSafe("extortion_links")
    return new.join(p, "group_id", "left").withColumn("leak_sites", F.when(use, F.col("__sites")).otherwise(F.col("leak_sites"))).drop("__sites", "__scope")


def source_counts(records: DataFrame) -> DataFrame:
    """Victims and posts to review of each source."""
    return records.groupBy("source_id").agg(F.count_if(F.col("post_type") == "victim").alias("victims_found"), F.count_if(F.col("post_type") == "review").alias("posts_review"))


def check_catalog(groups: DataFrame, pages: int, max_pages: int = 100) -> None:
    """Raises where a catalog mustn't replace the previous one: too many pages, no group, no endpoint of an active group."""
    n = groups.agg(F.count("*").alias("n"), F.sum(F.when(F.lower("status") == "active", F.size("leak_sites"))).alias("live")).first()
    for bad, why in ((pages > max_pages, "more pages than a tracker has"), (not n["n"], "no groups"), (not n["live"], "no endpoint of an active group")):
        if bad:
            raise ValueError(f"the catalog isn't replaced: {why}")


def needs_onion(groups: DataFrame) -> DataFrame:
    """One row: whether an active group publishes on an onion host."""
    e = groups.where(F.lower("status") == "active").select(F.explode("leak_sites").alias("s"))
    return e.agg(F.coalesce(F.bool_or(host(F.col("s.url")).endswith(".onion") | (F.col("s.kind") == "onion")), F.lit(False)).alias("needs_onion"))


def status_histogram(sources: DataFrame) -> DataFrame:
    """(status, sources, pages): how many sources are of each status, and the pages read of them."""
    return sources.groupBy("status").agg(F.count("*").alias("sources"), F.coalesce(F.sum("pages_scanned"), F.lit(0)).alias("pages"))


def endpoint_counts(groups: DataFrame) -> DataFrame:
    """(status, groups, endpoints): groups of each status and how many endpoints they have."""
    return groups.groupBy("status").agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.when(F.col("leak_sites").isNotNull(), F.size("leak_sites"))), F.lit(0)).cast("long").alias("endpoints"))


def groups_in_order(groups: DataFrame) -> DataFrame:
    """Groups by name, letter case aside; ties by id."""
    return groups.orderBy(F.lower(F.coalesce("name", "group_id")), "group_id")


def sources_in_order(sources: DataFrame) -> DataFrame:
    """Sources by group name, letter case aside, then by host; ties by id."""
    return sources.orderBy(F.lower(F.coalesce("group_name", F.lit(""))), F.coalesce("source_host", F.lit("")), "source_id")


def events(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """(event, line): a log line of key=value pairs for each row; nulls are left out, spaces in values become underscores."""
    pairs = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.translate(F.col(c).cast("string"), " ", "_"))) for c in columns]
    return rows.select(F.lit(name).alias("event"), F.concat_ws(" ", F.lit(name), *pairs).alias("line"))


def event_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with ``fields``, the map of a log line's pairs."""
    return lines.withColumn("fields", F.map_filter(F.str_to_map(line, F.lit(" "), F.lit("=")), lambda k, v: v.isNotNull()))
