"""Queries of the text operators over their whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm.confusables import cleaned_fields
from claimloom.llm.names import named_entities, variant_pairs
from claimloom.llm.packing import containers, fill
from claimloom.llm.repetition import measured, repetitive
from claimloom.llm.residue import with_residue, with_support
from claimloom.llm.survivorship import survivors
from claimloom.llm.tokenizer import encoded, token_counts
from claimloom.session import spread, table


def _victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "victims"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean form of every organisation and title that isn't in it."""
    return cleaned_fields(spread(table(spark, sf_dir, "victims").select("id", "organization", "post_title")), ("organization", "post_title"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving value of every field of every set of copies."""
    return survivors(_victims(spark, sf_dir), table(spark, sf_dir, "source_conventions"))


def p4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving values of all fields but the first sighting, whose many notations SQL doesn't read."""
    return p4_found(spark, sf_dir).where("field_name <> 'first_seen_at'")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with template residue or an error page's text."""
    return with_residue(_victims(spark, sf_dir)).select("id")


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each such row has in place of content, and how many rows its template or page has."""
    return with_support(_victims(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that name one organisation differently."""
    return variant_pairs(_victims(spark, sf_dir))


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The organisation that each row names, with its spellings and rows."""
    return named_entities(_victims(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encoded(_documents(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every document in one container of each window."""
    return containers(token_counts(_documents(spark, sf_dir)), table(spark, sf_dir, "context_windows"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers each window took, and how empty they are."""
    return fill(p8_containers(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that say the same over and over."""
    return repetitive(_documents(spark, sf_dir))


def p9_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band, compression ratio and share of repeated content of every document."""
    return measured(_documents(spark, sf_dir))


QUERIES = {
    "p3_found": p3_found, "p4_found": p4_found, "p4_fields": p4_fields, "p5_found": p5_found, "p5_kinds": p5_kinds, "p6_found": p6_found, "p6_entities": p6_entities, "p7_ids": p7_ids,
    "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_bands": p9_bands,
}
# Stand-ins for "not known", as the problem means them.
_STAND_INS = (
    "'n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'nan', 'unknown', 'unspecified', 'undisclosed', 'undefined', 'tbd', 'tba', 'tbc', 'pending', '?', 'unbekannt', 'inconnu', 'desconocido', 'неизвестно', 'not disclosed', 'not known', 'not available', "
    "'not specified', 'not stated', 'no data', 'no information', 'to be announced', 'to be determined', 'k.a.', 'non communiqué'"
)
_BARE = r"lower(regexp_replace(e.value, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"
ORACLES: dict[str, str] = {
    "p4_fields": rf"""WITH c AS (SELECT *, lower(group_id) AS g, lower(record_id) AS r, coalesce(CAST(last_seen_at AS TIMESTAMPTZ), TIMESTAMPTZ '0001-01-01 00:00:00+00') AS seen FROM victims WHERE group_id IS NOT NULL AND record_id IS NOT NULL),
    s AS (SELECT g, r, min(id) AS survivor_id, coalesce(bool_or(lower(trim(listing_state)) = 'listed'), false) AS listed FROM c GROUP BY g, r HAVING count(*) >= 2),
    i AS (SELECT g, r, array_to_string(list_sort(list(DISTINCT x)), ',') AS ids FROM (SELECT g, r, unnest(list_concat(list_concat(coalesce(source_ids, []), [source_id]), coalesce(historical_import.matched_source_ids, []))) AS x FROM c) WHERE trim(x) <> '' GROUP BY g, r),
    d AS (SELECT g, r, e.key AS k, arg_max(e.value, struct_pack(a := seen, b := id, c := e.value)) AS v FROM (SELECT g, r, id, seen, unnest(map_entries(claim_details)) AS e FROM c) WHERE {_BARE} <> '' AND regexp_matches({_BARE}, '[\p{{L}}\p{{N}}]') AND {_BARE} NOT IN ({_STAND_INS}) GROUP BY ALL)
    SELECT survivor_id, 'listing_state' AS field_name, CASE WHEN listed THEN 'listed' ELSE 'unknown' END AS field_value FROM s
    UNION ALL SELECT survivor_id, 'source_ids', ids FROM s JOIN i USING (g, r) UNION ALL SELECT survivor_id, 'claim_details.' || k, v FROM s JOIN d USING (g, r)"""
}
