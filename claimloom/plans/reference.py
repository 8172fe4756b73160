"""One query for each operator of the engine over the test tables, with SQL for those that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.functions import times, urls
from claimloom.functions.collections import known_sources, overlay
from claimloom.functions.keys import archive_id, sighting_id, source_id
from claimloom.operators import archive, cycle, history, html, records, rollups, view
from claimloom.sources.files import public
from claimloom.plans import sql
from claimloom.session import cut, spread, table
from claimloom.streaming.merge import windowed_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# SQL of the functions, as text around an expression.
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_squash(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def s_clean(x: str) -> str:
    x = f"coalesce({x}, '')"
    for bad, good in tx.MOJIBAKE:
        x = f"replace({x}, {_q(bad)}, {_q(good)})"
    return s_squash(x)


def s_bounded(x: str, n: int) -> str:
    return f"left(nullif({s_clean(x)}, ''), {n})"


def s_code(x: str) -> str:
    letter = lambda i: f"chr(unicode(substr({x}, {i}, 1)) - 127462 + 65)"
    return rf"CASE WHEN regexp_matches({x}, '^[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}') THEN {letter(1)} || {letter(2)} END"


_COUNTRY_ROWS = ", ".join(f"({_q(k)}, {_q(v)})" for k, v in tx.FLAG_COUNTRIES.items())
_TAGS = "|".join(r"[\W_]+".join(t.split()) for t in tx.STATUS_TAGS)
_PREFIXES = "|".join(sorted(tx.TITLE_PREFIXES, key=len, reverse=True))
_STARTS = "|".join(re.escape(s).replace("\\ ", " ") for s in tx.HEADLINE_STARTS)
_GENERIC = ", ".join(map(_q, tx.GENERIC_TITLES))
_HEAD_WORD = r"\b(?:article|interview|press release|announcement)\b"


def s_strip(x: str) -> str:
    ws = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
    return f"regexp_replace(coalesce({x}, ''), '^{ws}|{ws}$', '', 'g')"


def s_usable(x: str) -> str:
    bare = s_strip(rf"regexp_replace({x}, '[\[\]*_`~]', '', 'g')")
    return rf"(regexp_matches({bare}, '[\p{{L}}\p{{N}}]') AND NOT regexp_matches({bare}, '(?i)^(?:n/?a|unknown|unidentified|not available|none|null)$'))"


def s_view_type(p: str, o: str, t: str) -> str:
    bare = s_squash(rf"regexp_replace(lower(coalesce(nullif({t}, ''), {o}, '')), '[\[\]*_`~]', '', 'g')")
    return rf"""CASE WHEN {p} IN ('headline', 'review') THEN {p} WHEN {p} = 'victim' AND {s_usable(o)} THEN 'victim' WHEN {p} = 'victim' AND nullif({o}, '') IS NOT NULL THEN 'review'
        WHEN NOT {s_usable(bare)} THEN 'review' WHEN {bare} IN ({_GENERIC}) THEN 'headline' WHEN regexp_matches({bare}, '^announcement\s+(?:for|about)\b') THEN 'review'
        WHEN regexp_matches({bare}, '^(?:{_STARTS})') OR regexp_matches({bare}, '{_HEAD_WORD}') THEN 'headline' ELSE 'victim' END"""


def s_state(x: str) -> str:
    return f"CASE WHEN {x} IN ('listed', 'not_seen', 'unknown') THEN {x} ELSE 'unknown' END"


_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?(Z|[+-]\d{2}:?\d{2})?$"


def s_moment(x: str) -> str:
    """Also of basic and week dates, as far as the tables have them."""
    other = lambda shape, form: rf"WHEN regexp_matches(trim({x}), '{shape}') THEN try_strptime(trim({x}), '{form}') AT TIME ZONE 'UTC'"
    short = rf"regexp_replace({x}, '([.][0-9]{{6}})[0-9]+', '\1')"  # finer digits dropped
    return f"CASE WHEN regexp_matches(trim({short}), {_q(_ISO)}) THEN {s_plain_moment(short)} {other('^[0-9]{8}T[0-9]{6}Z$', '%Y%m%dT%H%M%SZ')} {other('^[0-9]{4}-W[0-9]{2}-[0-9]T[0-9:]{8}Z$', '%G-W%V-%uT%H:%M:%SZ')} END"


def s_plain_moment(x: str) -> str:
    part = lambda i: f"regexp_extract(trim({x}), {_q(_ISO)}, {i})"
    clock = f"CASE WHEN {part(2)} = '' THEN '00:00:00' WHEN length({part(2)}) = 5 THEN {part(2)} || ':00' ELSE {part(2)} END"
    zone = rf"CASE WHEN {part(3)} IN ('', 'Z') THEN '+00:00' ELSE regexp_replace({part(3)}, '^([+-]\d{{2}}):?(\d{{2}})$', '\1:\2') END"
    return f"CASE WHEN regexp_matches(trim({x}), {_q(_ISO)}) THEN try_cast({part(1)} || ' ' || {clock} || {zone} AS TIMESTAMPTZ) END"


_URL = urls._PARTS


def s_part(x: str, i: int) -> str:
    return f"regexp_extract({x}, {_q(_URL)}, {i})"


def s_host(x: str) -> str:
    return f"lower(coalesce({s_part(f'trim({x})', 3)}, ''))"


def s_canonical(u: str) -> str:
    """Of URLs that are valid as they stand, as those of the tables are."""
    path = rf"regexp_replace({s_part(u, 5)}, '/+$', '')"
    query_ = s_part(u, 6)
    return f"""lower({s_part(u, 1)}) || '://' || lower({s_part(u, 3)}) || CASE WHEN {s_part(u, 4)} <> '' THEN ':' || {s_part(u, 4)} ELSE '' END || coalesce(nullif({path}, ''), '/')
        || CASE WHEN {query_} <> '' THEN '?' || array_to_string(list_sort(string_split({query_}, '&')), '&') ELSE '' END"""


def s_source_id(u: str, g: str) -> str:
    return f"left(sha256(lower({g}) || chr(0) || {s_canonical(u)}), 20)"


_KNOWN = "list_sort(list_distinct(list_filter(list_concat(list_concat(coalesce(source_ids, []), [source_id]), coalesce(historical_import.matched_source_ids, [])), lambda x: x IS NOT NULL AND x <> '')))"


@query(
    rf"""WITH a AS (SELECT id, {s_clean('post_title')} AS t FROM victims), b AS (SELECT id, t, {s_code('t')} AS code FROM a),
    c AS (SELECT b.*, CASE WHEN code IS NULL THEN t ELSE {s_squash('substr(t, 3)')} END AS rest FROM b),
    d AS (SELECT *, left(trim(regexp_replace(trim(regexp_replace(rest, '(?i)(?:\s*\[[\W_]*(?:{_TAGS})[\W_]*\]\s*)+$', '')), '(?i)^(?:{_PREFIXES})\s*', '')), 240) AS clean FROM c),
    e AS (SELECT *, lower(clean) AS low, trim(regexp_replace(lower(clean), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS name FROM d)
    SELECT id, left(nullif(t, ''), 500) AS title, coalesce(k.country, code) AS flag_country, clean AS clean_title, CASE WHEN clean = '' OR name = '' THEN 'review' WHEN name IN ({_GENERIC}) OR regexp_matches(low, '^(?:{_STARTS})') THEN 'headline'
        WHEN regexp_matches(low, '^(?:important\s+)?announcement\b') THEN 'review' WHEN regexp_matches(low, '{_HEAD_WORD}') THEN 'headline' WHEN regexp_matches(low, '^welcome\s+(?:to|back)\b') THEN 'headline'
        WHEN regexp_matches(low, '^(?:response to|publication hold|press release|statement|article)\b') THEN 'headline' WHEN contains(clean, '?') OR length(clean) > 120 THEN 'review'
        WHEN regexp_matches(low, '{tx._SENTENCE}') THEN 'review' ELSE 'victim' END AS ingest_type,
        nullif(regexp_extract(clean, '(?i)^announcement\s+(?:for|about)\s+(?:the\s+)?(.+?)(?:\s+and\s+its\s+clients)?$', 1), '') AS announced
    FROM e LEFT JOIN (VALUES {_COUNTRY_ROWS}) k(cc, country) ON k.cc = e.code"""
)
def ref_titles(spark: SparkSession, d: str) -> DataFrame:
    """Clean titles: flags, tags, prefixes, type at ingest, announced name."""
    v = table(spark, d, "victims").select("id", tx.clean_text(F.col("post_title")).alias("t"))
    flag, _ = tx.country_from_flag(F.col("t"))
    v = v.select("id", tx.bounded(F.col("t"), 500).alias("title"), flag.alias("flag_country"), tx.clean_title(F.col("t")).alias("clean_title"))
    return v.select("*", tx.ingest_type(F.col("clean_title"), tx.plain_name(F.col("clean_title"))).alias("ingest_type"), tx.announced_name(F.col("clean_title")).alias("announced"))


@query(f"SELECT id, {s_view_type('post_type', 'organization', 'post_title')} AS view_type, CASE WHEN {s_usable('organization')} THEN {s_strip('organization')} WHEN {s_usable('post_title')} THEN {s_strip('post_title')} ELSE '' END AS shown, {s_state('listing_state')} AS state FROM victims")
def ref_view_types(spark: SparkSession, d: str) -> DataFrame:
    """Type, name and state as the view has them."""
    v = table(spark, d, "victims")
    return v.select("id", tx.view_type(F.col("post_type"), F.col("organization"), F.col("post_title")).alias("view_type"), tx.displayed_name(F.col("organization"), F.col("post_title")).alias("shown"), tx.state(F.col("listing_state")).alias("state"))


_VICTIMS = f"(SELECT * FROM victims WHERE {s_view_type('post_type', 'organization', 'post_title')} = 'victim')"


@query(f"SELECT (SELECT count(*) FROM {_VICTIMS}) AS total, (SELECT count(*) FROM {_VICTIMS} WHERE {s_state('listing_state')} = 'listed') AS listed, (SELECT count(*) FROM group_catalog) AS groups, (SELECT count(*) FROM sources) AS sources")
def ref_view_metrics(spark: SparkSession, d: str) -> DataFrame:
    return view.metrics(table(spark, d, "victims"), table(spark, d, "sources"), table(spark, d, "group_catalog"))


@query(
    f"""SELECT 'group' AS facet, group_id AS value, arg_max(group_name, struct_pack(a := last_seen_at, b := id)) AS label FROM {_VICTIMS} WHERE nullif(group_id, '') IS NOT NULL AND nullif(group_name, '') IS NOT NULL GROUP BY group_id
    UNION ALL SELECT DISTINCT 'country', country, country FROM {_VICTIMS} WHERE nullif(country, '') IS NOT NULL"""
)
def ref_view_facets(spark: SparkSession, d: str) -> DataFrame:
    return view.facets(table(spark, d, "victims"))


@query(
    f"""SELECT id, organization, country, listing_state FROM {_VICTIMS} WHERE contains(lower(concat_ws(' ', nullif(organization, ''), nullif(group_name, ''), nullif(country, ''), nullif(sector, ''), nullif(reported_date, ''))), 'energy') AND {s_state('listing_state')} = 'listed'"""
)
def ref_view_search(spark: SparkSession, d: str) -> DataFrame:
    return view.filtered(table(spark, d, "victims"), "energy", listing_state="listed").select("id", "organization", "country", "listing_state")


def s_day(x: str) -> str:
    a, b = r"(?i)^(\d{1,2})\s+([a-z]+)[,.]?\s+(\d{4})$", r"(?i)^([a-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
    month = lambda p, i: f"(SELECT m FROM months WHERE n = lower(regexp_extract(trim({x}), {_q(p)}, {i})))"
    named = lambda p, dd, mm: f"try_cast(regexp_extract(trim({x}), {_q(p)}, 3) || '-' || {month(p, mm)} || '-' || lpad(regexp_extract(trim({x}), {_q(p)}, {dd}), 2, '0') AS DATE)"
    return f"CASE WHEN regexp_matches(trim({x}), {_q(a)}) THEN {named(a, 1, 2)} WHEN regexp_matches(trim({x}), {_q(b)}) THEN {named(b, 2, 1)} ELSE CAST(({s_plain_moment(x)}) AT TIME ZONE 'UTC' AS DATE) END"


_MONTH_ROWS = ", ".join(f"({_q(k)}, '{v:02d}')" for k, v in times._MONTHS.items())


_SORT = lambda x: rf"icu_sort_key(lower(strip_accents(regexp_replace(regexp_replace(coalesce({x}, ''), '(\d+)', '000000000000\1', 'g'), '\d*(\d{{12}})(\D|$)', '\1\2', 'g'))), 'und')"
_SHOWN = f"CASE WHEN {s_usable('organization')} THEN {s_strip('organization')} WHEN {s_usable('post_title')} THEN {s_strip('post_title')} ELSE '' END"


@query(
    f"""WITH months(n, m) AS (VALUES {_MONTH_ROWS}), p AS (SELECT *, {_SHOWN} AS shown, coalesce({s_day('reported_date')}, {s_day('first_seen_at')}, DATE '1970-01-01') AS d FROM {_VICTIMS} WHERE country = 'Germany'),
    q AS (SELECT *, row_number() OVER (ORDER BY d DESC, {_SORT('shown')}, {_SORT('group_name')}, id) AS r, count(*) OVER () AS n FROM p)
    SELECT id, shown AS name, CASE WHEN {s_usable('post_title')} AND lower(trim(post_title)) <> lower(shown) THEN post_title END AS title, group_name, country, CASE WHEN country_basis = 'flag_inferred' THEN 'Inferred from flag' END AS country_note, sector, CAST(d AS VARCHAR) AS day,
    CASE listing_state WHEN 'listed' THEN 'Currently listed' WHEN 'not_seen' THEN 'No longer seen' ELSE 'Unknown / stale' END AS state FROM q WHERE (r - 1) // 100 = least(1, greatest((n - 1) // 100, 0))"""
)
def ref_view_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the victims of a country, as it is shown."""
    return view.rows(view.page(view.filtered(table(spark, d, "victims"), country="Germany"), 2)).withColumn("day", F.col("day").cast("string"))


@query("SELECT id, last_seen_at, group_name, organization FROM victims ORDER BY coalesce(last_seen_at, '') DESC, lower(coalesce(group_name, '')) DESC, lower(coalesce(organization, '')) DESC, id LIMIT 100 OFFSET 100")
def ref_latest_page(spark: SparkSession, d: str) -> DataFrame:
    """The second hundred of the sightings last seen."""
    return history.latest_first(table(spark, d, "victims")).select("id", "last_seen_at", "group_name", "organization").offset(100).limit(100)


@query(f"WITH months(n, m) AS (VALUES {_MONTH_ROWS}) SELECT id, coalesce({s_day('reported_date')}, {s_day('first_seen_at')}, DATE '1970-01-01') AS day FROM victims")
def ref_claim_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "victims").select("id", times.claim_day(F.col("reported_date"), F.col("first_seen_at")).alias("day"))


@query(f"SELECT id, array_to_string({_KNOWN}, ',') AS ids, len({_KNOWN}) AS n FROM victims")
def ref_known_sources(spark: SparkSession, d: str) -> DataFrame:
    ids = known_sources(F.col("source_ids"), F.col("source_id"), F.col("historical_import.matched_source_ids"))
    return table(spark, d, "victims").select("id", F.array_join(ids, ",").alias("ids"), F.size(ids).cast("long").alias("n"))


@query(
    """WITH e AS (SELECT lower(group_id) AS g, lower(record_id) AS r, id, unnest(map_entries(claim_details)) AS e FROM victims WHERE record_id IS NOT NULL)
    SELECT g, r, e.key AS k, arg_min(e.value, id) AS v FROM e WHERE nullif(e.value, '') IS NOT NULL GROUP BY ALL"""
)
def ref_details_fill_first(spark: SparkSession, d: str) -> DataFrame:
    """Of each listing's details the value of the first copy that has one."""
    v = table(spark, d, "victims").where("record_id is not null").select(F.lower("group_id").alias("g"), F.lower("record_id").alias("r"), "id", "claim_details")
    return records.detail_entries(v, ["g", "r"], "id").select("g", "r", F.explode("claim_details").alias("k", "v"))


@query(
    """WITH e AS (SELECT id, unnest(map_entries(claim_details)) AS e FROM victims), o AS (SELECT id, e.key AS k, e.value AS v FROM e),
    n AS (SELECT id, 'sector' AS k, sector AS v FROM victims UNION ALL SELECT id, 'deadline', reported_date FROM victims)
    SELECT coalesce(o.id, n.id) AS id, coalesce(o.k, n.k) AS k, coalesce(nullif(n.v, ''), o.v) AS v FROM o FULL JOIN n ON o.id = n.id AND o.k = n.k"""
)
def ref_details_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Details with newer values laid over them."""
    new = F.create_map(F.lit("sector"), F.col("sector"), F.lit("deadline"), F.col("reported_date"))
    return table(spark, d, "victims").select("id", F.explode(overlay(F.col("claim_details"), new)).alias("k", "v"))


_FILLED = [c for c in history.FILLED]
_Q_WAS = "spoken_type IS NOT NULL AND spoken_type = 'victim'"
_S_KEY = lambda x: f"struct_pack(a := ({s_moment(x)}) IS NOT NULL, b := coalesce({s_moment(x)}, TIMESTAMPTZ '1970-01-01 00:00:00+00'), c := CASE WHEN ({s_moment(x)}) IS NULL THEN {x} ELSE '' END)"


@query(
    f"""WITH v AS (SELECT *, lower(group_id) AS g, lower(record_id) AS r, {_KNOWN} AS known FROM victims WHERE record_id IS NOT NULL AND group_id IS NOT NULL),
    m AS (SELECT g, r, min(id) AS id, {', '.join(f"arg_min({c}, id) FILTER (WHERE nullif({c}, '') IS NOT NULL) AS {c}" for c in _FILLED)},
        arg_min(first_seen_at, {_S_KEY('first_seen_at')}) FILTER (WHERE nullif(first_seen_at, '') IS NOT NULL) AS first_seen_at, arg_max(last_seen_at, {_S_KEY('last_seen_at')}) FILTER (WHERE nullif(last_seen_at, '') IS NOT NULL) AS last_seen_at,
        list_sort(list_distinct(flatten(list(known)))) AS ids, arg_min(struct_pack(s := nullif(source_id, '')), id).s AS prim, CASE WHEN bool_or(listing_state = 'listed') THEN 'listed' ELSE 'unknown' END AS listing_state FROM v GROUP BY g, r)
    SELECT id, {', '.join(_FILLED)}, first_seen_at, last_seen_at, array_to_string(ids, ',') AS ids, coalesce(prim, ids[1]) AS source_id, listing_state FROM m"""
)
def ref_merge_copies(spark: SparkSession, d: str) -> DataFrame:
    """Copies of one listing merged into one row."""
    v = table(spark, d, "victims").where("record_id is not null and group_id is not null").withColumn("g", F.lower("group_id")).withColumn("r", F.lower("record_id"))
    return history.merge_copies(v, ["g", "r"]).select("id", *_FILLED, "first_seen_at", "last_seen_at", F.array_join("source_ids", ",").alias("ids"), "source_id", "listing_state")


_KEPT = "id, group_id, record_id, source_host, watchguard_profile_url, source_id, first_seen_at, last_seen_at, listing_state"
_PLAIN = "list_transform(map_entries(claim_details), lambda e: struct_pack(k := e.key, v := e.value))"


@query(
    f"""WITH {sql.fold()}, {sql.normalised('o', f"SELECT *, post_type AS spoken_type, {_KNOWN} AS known FROM victims WHERE post_type IS NULL OR post_type NOT IN ('headline', 'review')", f'{_KEPT}, known, ({_Q_WAS}) AS was')},
    {sql.folded('n', 'SELECT organization AS x FROM o')},
    v AS (SELECT o.* EXCLUDE (post_type), CASE WHEN was THEN 'victim' ELSE post_type END AS post_type, lower(group_id) AS g, coalesce(y, '') AS name FROM o LEFT JOIN n ON n.x = organization),
    named AS (SELECT * FROM v WHERE post_type = 'victim' AND nullif(g, '') IS NOT NULL AND name <> ''),
    m AS (SELECT g, name, min(id) AS id, arg_min(group_id, id) AS group_id, {', '.join(f"arg_min({c}, id) FILTER (WHERE nullif({c}, '') IS NOT NULL) AS {c}" for c in _FILLED)},
        arg_min(first_seen_at, {_S_KEY('first_seen_at')}) FILTER (WHERE nullif(first_seen_at, '') IS NOT NULL) AS first_seen_at, arg_max(last_seen_at, {_S_KEY('last_seen_at')}) FILTER (WHERE nullif(last_seen_at, '') IS NOT NULL) AS last_seen_at,
        list_sort(list_distinct(flatten(list(known)))) AS ids, arg_min(struct_pack(s := nullif(source_id, '')), id).s AS prim, CASE WHEN bool_or(listing_state = 'listed') THEN 'listed' ELSE 'unknown' END AS listing_state FROM named GROUP BY g, name),
    e AS (SELECT g, name, x.k AS k, arg_min(x.v, id) AS v FROM (SELECT g, name, id, unnest(details) AS x FROM named) WHERE nullif(x.v, '') IS NOT NULL GROUP BY ALL), t AS (SELECT g, name, array_to_string(list_sort(list(k || '=' || v)), '; ') AS details FROM e GROUP BY ALL)
    SELECT id, group_id, 'victim' AS post_type, {', '.join(_FILLED)}, first_seen_at, last_seen_at, array_to_string(ids, ',') AS ids, coalesce(prim, ids[1]) AS source_id, listing_state, details FROM m LEFT JOIN t USING (g, name)
    UNION ALL SELECT id, group_id, post_type, {', '.join(_FILLED)}, first_seen_at, last_seen_at, array_to_string(known, ',') AS ids, source_id, listing_state, {sql.details_text('details')} FROM v WHERE NOT (post_type = 'victim' AND nullif(g, '') IS NOT NULL AND name <> '')
    UNION ALL SELECT id, group_id, post_type, {', '.join(_FILLED)}, first_seen_at, last_seen_at, array_to_string(source_ids, ',') AS ids, source_id, listing_state, {sql.details_text(_PLAIN)} FROM victims WHERE post_type IN ('headline', 'review')"""
)
def ref_canonical(spark: SparkSession, d: str) -> DataFrame:
    """One row per group and victim."""
    c = history.canonical(spread(table(spark, d, "victims")))
    return c.select("id", "group_id", "post_type", *_FILLED, "first_seen_at", "last_seen_at", F.array_join("source_ids", ",").alias("ids"), "source_id", "listing_state", _flat())


_RECORD = ("organization", "post_title", "post_type", "reported_date", "country", "country_basis", "sector")


def _flat(details: str = "claim_details"):
    """A map of details as one text."""
    return nz_text(F.array_join(F.array_sort(F.transform(F.map_entries(details), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), "; ")).alias("details")


def nz_text(c):
    return F.nullif(c, F.lit(""))


_NORMALISED = f"WITH {sql.fold()}, {sql.normalised('r', 'SELECT * FROM listing_records', 'source_id, page_no, pos, record_id')}"


@query(f"{_NORMALISED} SELECT source_id, page_no, pos, record_id, {', '.join(_RECORD)}, {sql.details_text('details')} AS details FROM r")
def ref_normalized_records(spark: SparkSession, d: str) -> DataFrame:
    """All listing records in the public schema."""
    return records.normalize_records(spread(table(spark, d, "listing_records"))).select("source_id", "page_no", "pos", "record_id", *_RECORD, _flat())


_FIRST = lambda c, o: f"arg_min({c}, {o}) FILTER (WHERE nullif({c}, '') IS NOT NULL) AS {c}"
_DEDUPED = f"""{_NORMALISED}, {sql.folded('n', 'SELECT organization AS x FROM r UNION ALL SELECT post_title FROM r')},
    k AS (SELECT r.*, struct_pack(a := page_no, b := pos) AS o, CASE WHEN post_type = 'victim' AND coalesce(n1.y, '') <> '' THEN 'victim:' || n1.y WHEN {sql.clean('record_id')} <> '' THEN 'record:' || lower({sql.clean('record_id')})
        ELSE post_type || ':' || coalesce(nullif(n1.y, ''), n2.y, '') END AS key FROM r LEFT JOIN n n1 ON n1.x = organization LEFT JOIN n n2 ON n2.x = post_title),
    e AS (SELECT source_id, key, d.k AS dk, arg_min(d.v, o) AS dv FROM (SELECT source_id, key, o, unnest(details) AS d FROM k) WHERE nullif(d.v, '') IS NOT NULL GROUP BY ALL),
    t AS (SELECT source_id, key, array_to_string(list_sort(list(dk || '=' || dv)), '; ') AS details FROM e GROUP BY ALL),
    one AS (SELECT source_id, key, min(o).a AS page_no, min(o).b AS pos, arg_min(struct_pack(v := organization), o).v AS organization, arg_min(struct_pack(v := post_title), o).v AS post_title, arg_min(post_type, o) AS post_type,
        {', '.join(_FIRST(c, 'o') for c in ('record_id', 'reported_date', 'country', 'country_basis', 'sector'))} FROM k GROUP BY ALL)"""


@query(f"{_DEDUPED} SELECT one.source_id, page_no, pos, record_id, {', '.join(_RECORD)}, details FROM one LEFT JOIN t ON t.source_id IS NOT DISTINCT FROM one.source_id AND t.key = one.key")
def ref_deduped_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per listing of each source."""
    found = records.dedupe_records(records.normalize_records(spread(table(spark, d, "listing_records"))), ["source_id"], ["page_no", "pos"])
    return found.select("source_id", "page_no", "pos", "record_id", *_RECORD, _flat())


@query()
def ref_merge_observations(spark: SparkSession, d: str) -> DataFrame:
    """The history after all listing records, seen at one time, are merged into it."""
    known = table(spark, d, "sources").select("source_id", "group_id", "group_name", "source_host", "watchguard_profile_url")
    seen = records.dedupe_records(records.normalize_records(spread(table(spark, d, "listing_records"))), ["source_id"], ["page_no", "pos"]).join(known, "source_id").withColumn("observed_at", F.lit("2026-12-01T00:00:00Z"))
    seen = cut(seen)  # read twice
    return history.merge_observations(spread(table(spark, d, "victims")), seen)


@query(
    f"""WITH {sql.fold()}, {sql.folded('n', 'SELECT organization AS x FROM victims UNION ALL SELECT organization FROM listing_records')},
    l AS (SELECT DISTINCT lower(s.group_id) AS g, n.y FROM listing_records r JOIN sources s USING (source_id) JOIN n ON n.x = r.organization WHERE lower(s.group_id) IN (SELECT lower(group_id) FROM group_catalog WHERE lower(status) = 'active'))
    SELECT id, CASE WHEN post_type = 'victim' AND coalesce(n.y, '') <> '' AND nullif(group_id, '') IS NOT NULL THEN CASE WHEN l.y IS NOT NULL THEN 'listed' ELSE 'unknown' END ELSE listing_state END AS listing_state
    FROM victims v LEFT JOIN n ON n.x = v.organization LEFT JOIN l ON l.g = lower(v.group_id) AND l.y = n.y"""
)
def ref_aggregate_states(spark: SparkSession, d: str) -> DataFrame:
    """Victims' states by what sources of active groups list."""
    known = table(spark, d, "sources").select("source_id", "group_id")
    listed = table(spark, d, "listing_records").join(known, "source_id").select("group_id", tx.normalize_name(F.coalesce("organization", F.lit(""))).alias("name"))
    active = table(spark, d, "group_catalog").where("lower(status) = 'active'").select("group_id")
    return history.aggregate_states(table(spark, d, "victims"), active, listed).select("id", "listing_state")


@query("SELECT s.source_id, s.status, count(*) AS sightings, count(*) FILTER (WHERE v.listing_state = 'listed') AS listed FROM sources s JOIN (SELECT id, listing_state, unnest(" + _KNOWN + ") AS sid FROM victims) v ON v.sid = s.source_id GROUP BY ALL")
def ref_sightings_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources with the sightings that are known from them."""
    v = history.with_sources(table(spark, d, "victims")).select("listing_state", F.explode("source_ids").alias("source_id"))
    return table(spark, d, "sources").select("source_id", "status").join(v, "source_id").groupBy("source_id", "status").agg(F.count("*").alias("sightings"), F.count_if(F.col("listing_state") == "listed").alias("listed"))


_SITES = "(SELECT group_id, unnest(leak_sites).url AS u FROM group_catalog)"
_ALL_URLS = f"(SELECT DISTINCT u FROM (SELECT u FROM {_SITES} UNION ALL SELECT requested_url FROM page_captures UNION ALL SELECT response_url FROM page_captures) WHERE u IS NOT NULL)"


@query(
    f"""SELECT u AS given, lower({s_part('u', 1)}) || '://' || {s_part('u', 3)} || coalesce(nullif({s_part('u', 5)}, ''), '/') || CASE WHEN {s_part('u', 6)} <> '' THEN '?' || {s_part('u', 6)} ELSE '' END AS url, {s_canonical('u')} AS canonical, {s_host('u')} AS host,
    CASE WHEN regexp_extract({s_part('u', 5)}, '([^/]*)/*$', 1) NOT IN ('', 'index', 'home') THEN regexp_extract({s_part('u', 5)}, '([^/]*)/*$', 1) END AS slug, coalesce(nullif(regexp_extract({s_part('u', 6)}, '(?:^|&)page=([^&]*)', 1), ''), '0') AS page FROM {_ALL_URLS}"""
)
def ref_urls(spark: SparkSession, d: str) -> DataFrame:
    """Forms and parts of every URL in the tables."""
    c = table(spark, d, "page_captures").select(F.explode(F.array("requested_url", "response_url")).alias("given"))
    u = table(spark, d, "group_catalog").select(F.explode("leak_sites.url").alias("given")).unionByName(c).where("given is not null").distinct()
    g = F.col("given")
    return u.select("given", urls.normalize_url(g).alias("url"), urls.canonical_url(g).alias("canonical"), urls.host(g).alias("host"), urls.slug(g).alias("slug"), urls.query_value(g, "page", "0").alias("page"))


@query(f"SELECT {s_canonical('u')} AS url, array_to_string(list_sort(list_distinct(list(group_id))), ',') AS groups, array_to_string(list_sort(list_distinct(list({s_source_id('u', 'group_id')}))), ',') AS source_ids FROM {_SITES} GROUP BY 1")
def ref_shared_endpoints(spark: SparkSession, d: str) -> DataFrame:
    e = rollups.shared_endpoints(table(spark, d, "group_catalog"))
    return e.select("url", F.array_join("groups", ",").alias("groups"), F.array_join("source_ids", ",").alias("source_ids"))


@query(
    f"""SELECT group_id, s.kind AS kind, s.url AS given_url, {s_canonical('s.url')} AS url, {s_source_id('s.url', 'group_id')} AS source_id,
    CASE WHEN lower(coalesce(status, 'unknown')) <> 'active' THEN 'skipped_inactive' WHEN leak_sites_scope IS DISTINCT FROM 'extortion_links' THEN 'skipped_unscoped_catalog' ELSE 'crawl' END AS plan FROM (SELECT *, unnest(leak_sites) AS s FROM group_catalog)"""
)
def ref_planned_sources(spark: SparkSession, d: str) -> DataFrame:
    return rollups.planned_sources(table(spark, d, "group_catalog"))


_OUTCOME = f"""CASE WHEN nullif(fetch_error, '') IS NOT NULL THEN coalesce(nullif(error_type, ''), fetch_error) WHEN http_status >= 400 THEN 'http_' || http_status
    WHEN lower(trim(split_part(coalesce(content_type, ''), ';', 1))) <> '' AND NOT regexp_matches(lower(trim(split_part(coalesce(content_type, ''), ';', 1))), '^(?:text/html|application/xhtml\\+xml|text/plain)') THEN 'unsupported_content_type'
    WHEN octet_length(encode(body)) > 2000000 THEN 'response_too_large' WHEN {s_host('coalesce(response_url, requested_url)')} <> {s_host('requested_url')} THEN 'redirect_host_changed' WHEN body IS NULL THEN 'empty_body' END"""


@query(f"SELECT coalesce({_OUTCOME}, 'admitted') AS outcome, count(*) AS captures FROM page_captures GROUP BY 1")
def ref_capture_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_captures").groupBy(F.coalesce(rollups.capture_outcome(), F.lit("admitted")).alias("outcome")).agg(F.count("*").alias("captures"))


@query(
    f"""SELECT source_id, page_no, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id, page_no ORDER BY ({_OUTCOME}) IS NULL DESC, fetched_at DESC, response_url NULLS FIRST, body NULLS FIRST) AS r FROM page_captures) WHERE r = 1"""
)
def ref_latest_captures(spark: SparkSession, d: str) -> DataFrame:
    return rollups.latest_captures(table(spark, d, "page_captures")).select("source_id", "page_no", "fetched_at")


@query("SELECT source_id, page_no, m > 25 AS page_limit_reached FROM (SELECT *, max(r) OVER (PARTITION BY source_id) AS m FROM (SELECT source_id, page_no, dense_rank() OVER (PARTITION BY source_id ORDER BY page_no NULLS FIRST) AS r FROM listing_records)) WHERE r <= 25")
def ref_page_limit(spark: SparkSession, d: str) -> DataFrame:
    """Records on the first 25 pages of each source."""
    return rollups.within_page_limit(table(spark, d, "listing_records")).select("source_id", "page_no", "page_limit_reached")


@query(
    f"""WITH c AS (SELECT *, {_OUTCOME} AS e FROM page_captures), g AS (SELECT source_id, max({s_host('requested_url')}) AS source_host, count(*) AS pages_scanned, count(*) FILTER (WHERE e IS NULL) AS ok, count(e) AS bad,
        bool_and(e IS NULL OR e IN ('unsupported_layout', 'redirect_host_changed', 'invalid_response_url')) AS layout, min(struct_pack(p := page_no, e := e)) FILTER (WHERE e IS NOT NULL) AS f,
        nullif(array_to_string(list_sort(list_distinct(list(e) FILTER (WHERE e IS NOT NULL))), ','), '') AS error_type, arg_max(struct_pack(h := http_status), struct_pack(p := page_no, t := fetched_at)) AS h FROM c GROUP BY source_id),
    s AS (SELECT *, CASE WHEN bad = 0 THEN 'ok' WHEN ok > 0 THEN 'partial' WHEN layout THEN 'unsupported' ELSE 'offline' END AS status FROM g)
    SELECT source_id, source_host, status, CASE WHEN status = 'partial' THEN 'page_errors' WHEN status <> 'ok' THEN f.e END AS error, error_type, pages_scanned, ok AS pages_ok, CAST(h.h AS VARCHAR) AS http_status FROM s"""
)
def ref_source_results(spark: SparkSession, d: str) -> DataFrame:
    return rollups.source_results(table(spark, d, "page_captures")).withColumn("http_status", F.col("http_status").cast("string"))


@query(
    """WITH s AS (SELECT lower(group_id) AS g, count(*) AS t, count(*) FILTER (WHERE status = 'ok') AS o, count(*) FILTER (WHERE starts_with(status, 'skipped_')) AS k, count(DISTINCT status) AS n, min(status) AS m, max(checked_at) AS c FROM sources GROUP BY 1)
    SELECT g.group_id, g.name, CASE WHEN lower(coalesce(g.status, 'unknown')) = 'active' THEN 'active' ELSE 'non_active' END AS eligibility,
        CASE WHEN lower(coalesce(g.status, 'unknown')) <> 'active' THEN 'skipped_inactive' WHEN t IS NULL THEN 'no_source' WHEN n = 1 AND m IN ('ok', 'skipped_budget', 'skipped_unscoped_catalog', 'offline', 'unsupported', 'skipped_inactive') THEN m ELSE 'partial' END AS crawl_status,
        c AS checked_at, coalesce(t, 0) AS sources_total, coalesce(o, 0) AS sources_ok, coalesce(k, 0) AS sources_skipped FROM group_catalog g LEFT JOIN s ON lower(g.group_id) = s.g"""
)
def ref_group_status(spark: SparkSession, d: str) -> DataFrame:
    return rollups.group_status(table(spark, d, "group_catalog"), table(spark, d, "sources"))


@query("SELECT status, count(*) AS sources, coalesce(sum(pages_scanned), 0) AS pages FROM sources GROUP BY status")
def ref_status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rollups.status_histogram(table(spark, d, "sources"))


@query("SELECT status, count(*) AS groups, coalesce(sum(len(leak_sites)), 0) AS endpoints FROM group_catalog GROUP BY status")
def ref_endpoint_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollups.endpoint_counts(table(spark, d, "group_catalog"))


@query("SELECT source_id, count(*) FILTER (WHERE post_type = 'victim') AS victims_found, count(*) FILTER (WHERE post_type = 'review') AS posts_review FROM listing_records GROUP BY source_id")
def ref_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollups.source_counts(table(spark, d, "listing_records"))


@query(
    f"""SELECT source_id, group_id, 'not_in_catalog' AS status, 0 AS pages_scanned, 0 AS victims_found, 0 AS posts_review FROM sources s
    WHERE NOT EXISTS (SELECT 1 FROM {_SITES} c WHERE lower(c.group_id) = lower(s.group_id) AND {s_host('c.u')} = lower(s.source_host))"""
)
def ref_not_in_catalog(spark: SparkSession, d: str) -> DataFrame:
    return rollups.not_in_catalog(table(spark, d, "sources"), table(spark, d, "group_catalog"))


@query("SELECT coalesce(bool_or(s.kind = 'onion'), false) AS needs_onion FROM (SELECT unnest(leak_sites) AS s FROM group_catalog WHERE lower(status) = 'active')")
def ref_needs_onion(spark: SparkSession, d: str) -> DataFrame:
    return rollups.needs_onion(table(spark, d, "group_catalog"))


_COMPACT = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


@query(
    f"""WITH k AS (SELECT {_COMPACT('x')} AS key, group_id, coalesce(nullif(name, ''), group_id) AS n FROM (SELECT group_id, name, unnest([group_id, name]) AS x FROM group_catalog) WHERE x IS NOT NULL),
    u AS (SELECT key, min(group_id) AS group_id, min(n) AS group_name FROM k GROUP BY key HAVING count(DISTINCT group_id) = 1)
    SELECT p.group_name AS label, u.group_id, u.group_name, count(*) AS posts FROM archive_posts p LEFT JOIN u ON u.key = {_COMPACT('p.group_name')} GROUP BY ALL"""
)
def ref_archive_groups(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the archive with the group that each means."""
    p = table(spark, d, "archive_posts").select(F.col("group_name").alias("label")).withColumn("key", tx.compact_name(F.coalesce("label", F.lit(""))))
    return p.join(archive.group_keys(table(spark, d, "group_catalog")), "key", "left").groupBy("label", "group_id", "group_name").agg(F.count("*").alias("posts"))


@query(f"SELECT discovered, CASE WHEN ({s_moment('discovered')}) IS NOT NULL THEN regexp_replace(strftime(({s_moment('discovered')}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') || 'Z' END AS at, count(*) AS posts FROM archive_posts GROUP BY ALL")
def ref_archive_times(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "archive_posts").select("discovered", times.iso_utc(times.moment(F.col("discovered"))).alias("at"))
    return p.groupBy("discovered", "at").agg(F.count("*").alias("posts"))


_AT = f"CASE WHEN ({s_moment('discovered')}) IS NOT NULL THEN regexp_replace(strftime(({s_moment('discovered')}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') || 'Z' END"
_JUDGED = f"WITH {sql.fold()}, {sql.judged(_AT, _COMPACT)}"
_HISTORY = f"{_JUDGED}, {sql.CANDIDATES}, {sql.folded('vn', 'SELECT organization AS x FROM victims')}, v AS (SELECT victims.*, coalesce(y, '') AS name FROM victims LEFT JOIN vn ON vn.x = organization)"


@query(f"{_JUDGED}, {sql.CANDIDATES} SELECT * FROM c")
def ref_archive_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What the archive knows of each group's organisations."""
    return archive.archive_candidates(archive.judged_posts(spread(table(spark, d, "archive_posts")), table(spark, d, "group_catalog")))


@query(
    f"""{_HISTORY} SELECT coalesce(v.id, c.id) AS id, coalesce(v.group_id, c.group_id) AS group_id, CASE WHEN c.id IS NULL THEN v.organization ELSE coalesce(nullif(v.organization, ''), c.organization) END AS organization, CASE WHEN v.id IS NULL THEN c.post_title ELSE coalesce(v.post_title, CASE WHEN v.id IS NULL THEN c.post_title END) END AS post_title,
    CASE WHEN c.id IS NULL THEN v.post_type ELSE 'victim' END AS post_type, CASE WHEN c.id IS NULL THEN v.country ELSE coalesce(nullif(v.country, ''), c.country) END AS country, CASE WHEN c.id IS NULL OR nullif(v.country, '') IS NOT NULL THEN v.country_basis ELSE c.country_basis END AS country_basis,
    CASE WHEN c.id IS NULL THEN v.first_seen_at ELSE least(coalesce(nullif(v.first_seen_at, ''), c.first_seen_at), c.first_seen_at) END AS first_seen_at,
    CASE WHEN c.id IS NULL OR nullif(v.source_id, '') IS NOT NULL THEN v.last_seen_at ELSE greatest(coalesce(nullif(v.last_seen_at, ''), c.last_seen_at), c.last_seen_at) END AS last_seen_at,
    CASE WHEN v.id IS NULL THEN 'unknown' ELSE v.listing_state END AS listing_state, CASE WHEN v.id IS NULL THEN '' WHEN c.id IS NULL THEN array_to_string(v.source_ids, ',') ELSE array_to_string({_KNOWN.replace('source_ids, []), [source_id]', 'v.source_ids, []), [v.source_id]').replace('historical_import.', 'v.historical_import.')}, ',') END AS ids,
    CASE WHEN c.id IS NULL THEN v.historical_import.earliest_discovered ELSE c.first_seen_at END AS earliest, CAST(CASE WHEN c.id IS NULL THEN v.historical_import.archive_observations ELSE c.archive_observations END AS VARCHAR) AS observations, CASE WHEN c.id IS NULL THEN v.historical_import.imported_at ELSE coalesce(nullif(v.historical_import.imported_at, ''), '2026-12-01T00:00:00Z') END AS imported_at
    FROM v FULL JOIN c ON v.group_id = c.group_id AND v.name = c.name AND v.name <> '' AND v.group_id <> ''"""
)
def ref_import_archive(spark: SparkSession, d: str) -> DataFrame:
    """The history with the archive in it."""
    c = archive.archive_candidates(archive.judged_posts(spread(table(spark, d, "archive_posts")), table(spark, d, "group_catalog")))
    h, hist = archive.import_archive(table(spark, d, "victims"), c, "2026-12-01T00:00:00Z"), F.col("historical_import")
    return h.select("id", "group_id", "organization", "post_title", "post_type", "country", "country_basis", "first_seen_at", "last_seen_at", "listing_state", F.array_join("source_ids", ",").alias("ids"), hist["earliest_discovered"].alias("earliest"), hist["archive_observations"].cast("string").alias("observations"), hist["imported_at"].alias("imported_at"))


@query(
    f"""{_HISTORY}, hits AS (SELECT c.group_id, k.n FROM c LEFT JOIN (SELECT group_id, name, count(*) AS n FROM v WHERE name <> '' AND group_id <> '' GROUP BY ALL) k ON k.group_id = c.group_id AND k.name = c.name),
    a AS (SELECT count(*) AS archive_rows, count(*) FILTER (WHERE outcome = 'matched') AS matched_archive_rows, count(*) FILTER (WHERE outcome = 'excluded') AS excluded_headline_or_ambiguous, count(*) FILTER (WHERE outcome = 'unmatched_group') AS unmatched_group_rows,
        CAST(0 AS BIGINT) AS invalid_rows, count(*) FILTER (WHERE outcome = 'invalid_timestamp') AS invalid_timestamps FROM j),
    b AS (SELECT count(*) AS unique_group_organizations, count(*) FILTER (WHERE n IS NULL) AS new_sightings, CAST(coalesce(sum(n), 0) AS BIGINT) AS existing_sightings_updated, count(DISTINCT group_id) AS matched_groups FROM hits)
    SELECT *, (SELECT count(*) FROM victims) + new_sightings AS sighting_total FROM a, b"""
)
def ref_import_summary(spark: SparkSession, d: str) -> DataFrame:
    j = archive.judged_posts(spread(table(spark, d, "archive_posts")), table(spark, d, "group_catalog"))
    return archive.import_summary(j, table(spark, d, "victims"), archive.archive_candidates(j))


@query("SELECT group_id, organization, left(sha256('historical-posts' || chr(0) || group_id || chr(0) || organization), 24) AS archive_id FROM (SELECT DISTINCT group_id, organization FROM victims WHERE organization IS NOT NULL AND group_id IS NOT NULL)")
def ref_archive_ids(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "victims").where("organization is not null and group_id is not null").select("group_id", "organization").distinct()
    return v.select("*", archive_id(F.col("group_id"), F.col("organization")).alias("archive_id"))


@query()
def ref_page_records(spark: SparkSession, d: str) -> DataFrame:
    """Records on the captured pages, normalised."""
    c = table(spark, d, "page_captures").where(rollups.capture_outcome().isNull())
    return records.normalize_records(html.page_records(html.parsed_pages(c)))


@query(
    r"""SELECT source_id, page_no, CASE WHEN contains(body, '<table') THEN 'html-table' WHEN contains(body, 'victim-card') THEN 'html-cards' END AS parser, CASE WHEN contains(body, '<table') THEN len(regexp_extract_all(body, '<tr data-id')) END AS table_rows
    FROM page_captures WHERE fetch_error IS NULL AND body IS NOT NULL AND http_status < 400 AND contains(body, '<table')"""
)
def ref_table_pages(spark: SparkSession, d: str) -> DataFrame:
    """Captured pages that are tables, with the number of their rows."""
    p = html.parsed_pages(table(spark, d, "page_captures").where("fetch_error is null and body is not null and http_status < 400"))
    return p.where("parser = 'html-table'").select("source_id", "page_no", "parser", F.size("records").cast("long").alias("table_rows"))


@query()
def ref_page_walk(spark: SparkSession, d: str) -> DataFrame:
    """Captured pages of each source by their distance from its first page."""
    p = html.parsed_pages(table(spark, d, "page_captures").where(rollups.capture_outcome().isNull())).withColumn("key", urls.canonical_url(F.col("url")))
    links = p.select("source_id", F.col("key").alias("from_key"), F.explode("links").alias("l")).select("source_id", "from_key", urls.canonical_url(F.col("l.url")).alias("to_key"))
    first = p.groupBy("source_id").agg(F.min_by("key", "page_no").alias("key"))
    return html.reachable(first, links)


@query("SELECT id, group_id, group_name, source_host, map_keys(claim_details) IS NOT NULL AS has_details FROM victims")
def ref_public(spark: SparkSession, d: str) -> DataFrame:
    """What is published of the history."""
    p = public(table(spark, d, "victims"))
    assert "watchguard_profile_url" not in p.columns
    return p.select("id", "group_id", "group_name", "source_host", F.col("claim_details").isNotNull().alias("has_details"))


@query("SELECT n.source_id, n.status, CASE WHEN starts_with(n.status, 'skipped_') THEN coalesce(n.pages_scanned + 1, n.pages_scanned) ELSE n.pages_scanned END AS pages_scanned FROM sources n")
def ref_carried_over(spark: SparkSession, d: str) -> DataFrame:
    """Skipped sources keep the counts of their prior record."""
    s = table(spark, d, "sources").select("source_id", "status", "pages_scanned")
    return rollups.carried_over(s, s.withColumn("pages_scanned", F.col("pages_scanned") + 1), ("pages_scanned",))


@query("SELECT group_id, CASE WHEN profile_status = 'offline' AND leak_sites_scope = 'extortion_links' THEN len(leak_sites) ELSE 0 END AS endpoints FROM group_catalog")
def ref_carried_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Offline profiles keep the previous catalog's endpoints."""
    g = table(spark, d, "group_catalog")
    bare = g.withColumn("leak_sites", F.array().cast(g.schema["leak_sites"].dataType))
    return rollups.carried_endpoints(bare, g).select("group_id", F.size("leak_sites").cast("long").alias("endpoints"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ref_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    w = windowed_counts(table(spark, d, "events"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT s.source_id, s.group_id FROM sources s WHERE NOT EXISTS (SELECT 1 FROM victims v WHERE v.source_id = s.source_id)")
def ref_unseen_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that no sighting has as its first."""
    return table(spark, d, "sources").join(table(spark, d, "victims"), "source_id", "left_anti").select("source_id", "group_id")


@query(f"SELECT u AS given, {s_source_id('u', 'group_id')} AS source_id FROM {_SITES}")
def ref_source_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "group_catalog").select("group_id", F.explode("leak_sites.url").alias("given"))
    return e.select("given", source_id(F.col("given"), F.col("group_id")).alias("source_id"))


@query("SELECT 'source_result' AS event, concat_ws(' ', 'source_result', 'source_id=' || source_id, 'status=' || status, 'pages_scanned=' || pages_scanned, 'error_type=' || replace(error_type, ' ', '_')) AS line FROM sources")
def ref_events(spark: SparkSession, d: str) -> DataFrame:
    """A log line for what became of each source."""
    return rollups.events(table(spark, d, "sources"), "source_result", "source_id", "status", "pages_scanned", "error_type")


@query("SELECT source_id, row_number() OVER (ORDER BY lower(coalesce(group_name, '')), coalesce(source_host, ''), source_id) AS place FROM sources")
def ref_sources_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Sources with their places in the public order; a table of fixed size."""
    s = rollups.sources_in_order(table(spark, d, "sources")).select("source_id").coalesce(1)
    return s.select("source_id", (F.monotonically_increasing_id() + 1).alias("place"))


@query("SELECT group_id, row_number() OVER (ORDER BY lower(coalesce(name, group_id)), group_id) AS place FROM group_catalog")
def ref_groups_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Groups with their places in the public order; a table of fixed size."""
    g = rollups.groups_in_order(table(spark, d, "group_catalog")).select("group_id").coalesce(1)
    return g.select("group_id", (F.monotonically_increasing_id() + 1).alias("place"))


@query(f"SELECT u AS given, CASE WHEN regexp_matches({s_host('u')}, '(^|[.])tracker[.]example$') THEN NULL WHEN suffix({s_host('u')}, '.onion') THEN 'onion' ELSE 'website' END AS kind, contains({s_host('u')}, '.') AND NOT regexp_matches({s_host('u')}, '[.](localhost|local|internal|lan)$') AS public FROM {_ALL_URLS}")
def ref_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Every URL of the tables as an endpoint: its kind, and whether its host may be public."""
    c = table(spark, d, "page_captures").select(F.explode(F.array("requested_url", "response_url")).alias("given"))
    u = table(spark, d, "group_catalog").select(F.explode("leak_sites.url").alias("given")).unionByName(c).where("given is not null").distinct()
    return u.select("given", urls.endpoint(F.col("given"))["kind"].alias("kind"), urls.is_public_target(F.col("given")).alias("public"))


@query("SELECT DISTINCT group_name, coalesce(nullif(trim(regexp_replace(lower(group_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug FROM victims WHERE group_name IS NOT NULL")
def ref_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Names of groups as parts of URLs."""
    return table(spark, d, "victims").where("group_name is not null").select("group_name").distinct().select("group_name", tx.slugify("group_name").alias("slug"))


@query("SELECT id, e.key AS k, e.value AS v FROM (SELECT id, unnest(map_entries(claim_details)) AS e FROM victims) WHERE NOT regexp_matches(coalesce(trim(e.value), ''), '(?i)^(?:|[-–—]|n/?a|unknown)$')")
def ref_shown_details(spark: SparkSession, d: str) -> DataFrame:
    """The details that a view shows."""
    return table(spark, d, "victims").select("id", F.explode(tx.shown_details(F.col("claim_details"))).alias("k", "v"))


_SIGHTING = f"""left(sha256(lower(group_id) || chr(0) || CASE WHEN post_type = 'victim' AND org <> '' THEN 'victim:' || org ELSE source_id || chr(0) || CASE WHEN {sql.clean('record_id')} <> '' THEN 'record:' || lower({sql.clean('record_id')}) ELSE post_type || ':' || name END END), 24)"""


@query(
    f"""WITH {sql.fold()}, {sql.folded('n', 'SELECT organization AS x FROM victims UNION ALL SELECT post_title FROM victims')}, v AS (SELECT v.*, coalesce(n1.y, '') AS org, coalesce(nullif(n1.y, ''), n2.y, '') AS name FROM victims v LEFT JOIN n n1 ON n1.x = organization LEFT JOIN n n2 ON n2.x = post_title)
    SELECT id, {_SIGHTING} AS sighting_id FROM v WHERE post_type IN ('victim', 'headline', 'review') AND group_id IS NOT NULL AND source_id IS NOT NULL"""
)
def ref_sighting_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids that sightings would get today."""
    v = table(spark, d, "victims").where("post_type in ('victim', 'headline', 'review') and group_id is not null and source_id is not null")
    v = v.withColumn("org", tx.normalize_name(F.coalesce("organization", F.lit("")))).withColumn("name", F.coalesce(tx.nz("org"), tx.normalize_name(F.coalesce("post_title", F.lit("")))))
    return v.select("id", sighting_id(F.col("group_id"), F.col("source_id"), F.col("post_type"), F.col("org"), F.col("record_id"), F.col("name")).alias("sighting_id"))


@query()
def ref_run(spark: SparkSession, d: str) -> DataFrame:
    """Sources after a whole run over all captures."""
    return cycle.run(table(spark, d, "group_catalog"), table(spark, d, "page_captures"), table(spark, d, "sources"), table(spark, d, "victims"), "2026-12-01T00:00:00Z").sources
