"""The best representative of each group of duplicate records, field by field.

One aggregation by group and attribute takes the greatest composite struct (trust in the source, time, id, value; null without a
value) of all copies; the fields that all copies have are one row of that aggregation, each id and each open map key another, so
no list of columns is needed. Partial aggregation shrinks each input partition to one row per group and attribute before the
shuffle, and a group that holds a third of all rows arrives as a handful of rows per input partition. A second, small
aggregation brings the attributes of a group together under its smallest id. No window, no join, no list of a group's members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.timestamps import conventions, with_moments

# Texts that stand for "not known".
STAND_INS = (
    "n/a na n.a. none null nil nan unknown unspecified undisclosed undefined tbd tba tbc pending ? unbekannt inconnu desconocido неизвестно".split()
    + ["not disclosed", "not known", "not available", "not specified", "not stated", "no data", "no information", "to be announced", "to be determined", "k.a.", "non communiqué"]
)


def is_stand_in(c: Column) -> Column:
    """Whether a text is null, blank, without any letter or digit, or one of STAND_INS."""
    t = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return c.isNull() | (t == "") | ~t.rlike(r"[\p{L}\p{N}]") | t.isin(STAND_INS)


def survivors(records: DataFrame, source_conventions: DataFrame, trust: Column | None = None) -> DataFrame:
    """(survivor_id, field_name, field_value) for every set of two or more copies and each field that has a value.

    Copies share ``group_id`` and ``record_id``, letter case aside; rows where either is null have no copies. The survivor's
    name is the smallest id. ``first_seen_at``: the earliest moment; ``source_ids``: the sorted union; ``listing_state``:
    ``listed`` if any copy says so, else ``unknown``; ``claim_details.<key>``: of the copy last seen latest whose value isn't
    blank or a stand-in, ties going to the greater id. ``trust``, a whole number for a copy, goes before time: of copies that
    differ in it only the most trusted count for first_seen_at and details; without it all are trusted alike. Copies of
    one whole row count as copies. Null arrays, maps and structs add nothing; unreadable ``last_seen_at`` sorts before all
    others. More columns are ignored. An empty input gives an empty result.
    """
    hist = F.col("historical_import.matched_source_ids")
    strings = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    copies = (
        records.where(F.col("group_id").isNotNull() & F.col("record_id").isNotNull())
        .select(
            F.lower("group_id").alias("__g"), F.lower("record_id").alias("__r"), "id", F.lower(F.trim("source_id")).alias("__src"), "first_seen_at",
            F.concat(strings(F.col("source_ids")), F.array("source_id"), strings(hist)).alias("__ids"),
            (F.lower(F.trim("listing_state")) == "listed").alias("__listed"), "claim_details", F.unix_micros(F.try_to_timestamp("last_seen_at")).alias("__seen"),
            (F.lit(0) if trust is None else trust).cast("int").alias("__trust"),
        )
        .join(conventions(source_conventions), F.col("__src") == F.col("__sid"), "left")
    )
    copies = with_moments(copies, "first_seen_at", "__tz", "__order", "__first")

    # The composite whose maximum survives: trust, order in time, id, value; null where a copy has no value.
    def best(order: Column, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.col("__trust").alias("trust"), order.alias("order"), F.col("id").alias("tie"), value.alias("value")))

    # A row of the aggregation for each copy, of the fields that all have, and for each id and detail of it.
    def row(field: Column, item: Column, value: Column, listed: Column) -> Column:
        return F.struct(field.alias("field"), item.alias("item"), value.alias("best"), listed.alias("listed"))

    none, no_state = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    # The earlier the greater; a day goes before the moments in it.
    day_only = F.length("__first") == 10
    moment = F.unix_micros(F.try_to_timestamp(F.when(day_only, F.concat("__first", F.lit("T00:00:00Z"))).otherwise(F.col("__first")))) * 2 + (~day_only).cast("long")
    details = F.transform(
        F.filter(F.coalesce(F.map_entries("claim_details"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: ~is_stand_in(e["value"])),
        lambda e: row(F.concat(F.lit("claim_details."), e["key"]), none, best(F.col("__seen"), e["value"]), no_state),
    )
    ids = F.transform(F.array_distinct(F.filter("__ids", lambda x: F.trim(x) != "")), lambda x: row(F.lit("source_ids"), x, best(F.lit(None).cast("long"), none), no_state))
    own = F.array(row(F.lit(""), none, best(-moment, F.col("__first")), F.coalesce("__listed", F.lit(False))))
    a, whole = F.col("__a"), F.col("field") == ""
    attributes = (
        copies.select("__g", "__r", "id", F.explode(F.concat(own, ids, details)).alias("__a"))
        .groupBy("__g", "__r", a["field"].alias("field"), a["item"].alias("item"))
        .agg(F.count(a["listed"]).alias("n"), F.min(F.when(a["listed"].isNotNull(), F.col("id"))).alias("least"), F.max(a["best"]).alias("best"), F.max(a["listed"]).alias("listed"))
        .select("__g", "__r", "field", "item", "n", "least", "listed", F.col("best.value").alias("value"))
    )
    named = F.when(whole, "first_seen_at").when(F.col("field") != "source_ids", F.col("field"))
    groups = attributes.groupBy("__g", "__r").agg(
        F.max("n").alias("n"),
        F.max("least").alias("survivor_id"),
        F.max("listed").alias("listed"),
        F.array_sort(F.collect_list("item")).alias("ids"),
        F.collect_list(F.when(named.isNotNull() & F.col("value").isNotNull(), F.struct(named.alias("field"), "value"))).alias("fields"),
    )
    state = F.struct(F.lit("listing_state").alias("field"), F.when(F.col("listed"), "listed").otherwise("unknown").alias("value"))
    joined = F.struct(F.lit("source_ids").alias("field"), F.when(F.size("ids") > 0, F.array_join("ids", ",")).alias("value"))
    return (
        groups.where(F.col("n") >= 2)
        .select("survivor_id", F.explode(F.concat("fields", F.array(state, joined))).alias("f"))
        .where(F.col("f.value").isNotNull())
        .select("survivor_id", F.col("f.field").alias("field_name"), F.col("f.value").alias("field_value"))
    )
