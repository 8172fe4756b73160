"""Commands over tables: ``python -m claimloom {catalog,ingest,import,query,publish} ...``; import is a dry run without --apply."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from claimloom.functions.times import now_utc
from claimloom.operators import archive, cycle, html, rollups, view
from claimloom.session import build_session, cut
from claimloom.sources import files

_TABLES = {"catalog": ("captures", "profiles", "groups", "prefix"), "ingest": ("captures", "groups", "sources", "history"), "import": ("posts", "groups", "history"), "query": ("history",), "publish": ("history", "output")}


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="claimloom")
    sub = p.add_subparsers(dest="command", required=True)
    commands = {name: sub.add_parser(name) for name in _TABLES}
    for name, tables in _TABLES.items():
        for t in tables:
            commands[name].add_argument(f"--{t}", required=True)
    commands["ingest"].add_argument("--observed-at", help="the time of the run; now without it")
    commands["import"].add_argument("--imported-at", help="the time of the import; now without it")
    commands["import"].add_argument("--apply", action="store_true")
    commands["import"].add_argument("--aliases", help="a JSON object of labels and group ids; 'approved' for the built-in table")
    commands["query"].add_argument("--page", type=int, default=1)
    for a in ("search", "group", "country", "state"):
        commands["query"].add_argument(f"--{a}", default="")
    return p.parse_args(argv)


def _catalog(spark, a) -> None:
    """The groups of the captured catalog pages with the endpoints of their captured profiles, if they may replace the present ones."""
    pages, previous = spark.read.parquet(a.captures), spark.read.parquet(a.groups)
    if pages.where(rollups.capture_outcome().isNotNull()).head(1):
        raise ValueError("a page of the catalog couldn't be read")
    profiles = spark.read.parquet(a.profiles)
    found = html.catalog_rows(pages, a.prefix).join(html.group_endpoints(profiles), "group_id", "left").join(profiles.select("group_id", F.when(rollups.capture_outcome().isNull(), "ok").otherwise("offline").alias("profile_status")), "group_id", "left")
    fresh = found.withColumn("leak_sites", F.coalesce("leak_sites", F.array().cast(found.schema["leak_sites"].dataType))).withColumn("leak_sites_scope", F.lit("extortion_links"))
    groups = cut(rollups.carried_endpoints(fresh, previous))
    files.replace_table(rollups.groups_in_order(groups), a.groups, check=lambda t: rollups.check_catalog(t, pages.select("page_no").distinct().count()))


def _import(spark, a) -> None:
    posts = spark.read.parquet(a.posts) if a.posts.rstrip("/").endswith(".parquet") else files.read_posts(spark, a.posts)
    aliases = None
    if a.aliases:
        aliases = archive.APPROVED_ALIASES if a.aliases == "approved" else json.load(open(a.aliases, encoding="utf-8"))
    past = spark.read.parquet(a.history)
    judged = archive.judged_posts(posts, spark.read.parquet(a.groups), aliases)
    found = cut(archive.archive_candidates(judged))
    for k, v in archive.import_summary(judged, past, found).first().asDict().items():
        print(f"{k}={v}")
    if a.apply:
        files.replace_table(archive.import_archive(past, found, a.imported_at or spark.range(1).select(now_utc()).first()[0]), a.history)


def _ingest(spark, a) -> None:
    at = a.observed_at or spark.range(1).select(now_utc()).first()[0]
    done = cycle.run(spark.read.parquet(a.groups), spark.read.parquet(a.captures), spark.read.parquet(a.sources), spark.read.parquet(a.history), at)
    for r in rollups.events(done.run, "run_finished", *done.run.columns).collect():
        print(r["line"])
    files.replace_table(done.history, a.history)
    files.replace_table(rollups.sources_in_order(done.sources), a.sources)
    for name, table in (("status", rollups.groups_in_order(done.groups)), ("runs", done.run)):
        table.write.mode("append" if name == "runs" else "overwrite").parquet(f"{a.history.rstrip('/')}-{name}")


def main(argv: list[str] | None = None) -> int:
    a = _arguments(argv)
    spark = build_session()
    try:
        if a.command == "catalog":
            _catalog(spark, a)
        elif a.command == "ingest":
            _ingest(spark, a)
        elif a.command == "import":
            _import(spark, a)
        elif a.command == "query":
            view.rows(view.page(view.filtered(spark.read.parquet(a.history), a.search, a.group, a.country, a.state), a.page)).show(view.PAGE_SIZE, truncate=60)
        else:
            files.public(spark.read.parquet(a.history)).write.mode("overwrite").parquet(a.output)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
