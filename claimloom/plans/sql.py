"""SQL of the text rules, written out by itself: its constants are stated here, not taken from the engine that it checks."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# What UTF-8 read as a Western code page leaves, and what it stood for, in order.
_MOJIBAKE = (("â\x86\x92", "→"), ("â†’", "→"), ("â\x86\x90", "←"), ("â€™", "’"), ("â€œ", "“"), ("â€\x9d", "”"), ("â€“", "–"), ("â€”", "—"), ("Â ", " "))
# Patterns of tags, prefixes and beginnings, and generic titles.
_TAGS = r"all[\W_]+data[\W_]+published|all[\W_]+stolen[\W_]+data|announcement|data[\W_]+leak|data[\W_]+leaked|leaked|new|publication|published|released|sale|sold|victim"
_PREFIXES = r"organization:|new victim:|company:|victim:|leak:"
_GENERIC = (
    "'home', 'about', 'contact', 'news', 'blog', 'victims', 'victim list', 'recent victims', 'all victims', 'load more', 'read more', 'welcome', 'important announcement', "
    "'why it matters', 'what is stored', 'warning', 'press', 'notice', 'jurisdiction', 'cooperation reached'"
)
_STARTS = "view all|load more|read more|what time does|what time is|response to |publication hold|press release|statement:|article:|why it matters|what is stored|warning:|notice:|jurisdiction:|cooperation reached"
# Countries of flag codes.
_COUNTRIES = (
    "('AE', 'United Arab Emirates'), ('AR', 'Argentina'), ('AT', 'Austria'), ('AU', 'Australia'), ('BE', 'Belgium'), ('BR', 'Brazil'), ('CA', 'Canada'), ('CH', 'Switzerland'), ('CL', 'Chile'), ('CN', 'China'), ('CO', 'Colombia'), ('CR', 'Costa Rica'), "
    "('CZ', 'Czechia'), ('DE', 'Germany'), ('DK', 'Denmark'), ('ES', 'Spain'), ('FI', 'Finland'), ('FR', 'France'), ('GB', 'United Kingdom'), ('GR', 'Greece'), ('HK', 'Hong Kong'), ('HU', 'Hungary'), ('ID', 'Indonesia'), ('IE', 'Ireland'), "
    "('IL', 'Israel'), ('IN', 'India'), ('IT', 'Italy'), ('JP', 'Japan'), ('KR', 'South Korea'), ('LU', 'Luxembourg'), ('MX', 'Mexico'), ('MY', 'Malaysia'), ('NL', 'Netherlands'), ('NO', 'Norway'), ('NZ', 'New Zealand'), ('PH', 'Philippines'), "
    "('PL', 'Poland'), ('PT', 'Portugal'), ('RO', 'Romania'), ('RU', 'Russia'), ('SA', 'Saudi Arabia'), ('SE', 'Sweden'), ('SG', 'Singapore'), ('TH', 'Thailand'), ('TR', 'Turkey'), ('TW', 'Taiwan'), ('UA', 'Ukraine'), ('US', 'United States'), "
    "('VN', 'Vietnam'), ('ZA', 'South Africa')"
)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squash(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def clean(x: str) -> str:
    x = f"coalesce({x}, '')"
    for bad, good in _MOJIBAKE:
        x = f"replace({x}, {quoted(bad)}, {quoted(good)})"
    return squash(x)


def bounded(x: str, n: int) -> str:
    return f"left(nullif({clean(x)}, ''), {n})"


def code(x: str) -> str:
    """The two letters of a leading flag."""
    letter = lambda i: f"chr(unicode(substr({x}, {i}, 1)) - 127462 + 65)"
    return rf"CASE WHEN regexp_matches({x}, '^[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}') THEN {letter(1)} || {letter(2)} END"


def rest(x: str) -> str:
    return f"CASE WHEN ({code(x)}) IS NULL THEN {x} ELSE {squash(f'substr({x}, 3)')} END"


def title(x: str) -> str:
    """A clean text without flag, tags and prefix."""
    return rf"left(trim(regexp_replace(trim(regexp_replace({rest(x)}, '(?i)(?:\s*\[[\W_]*(?:{_TAGS})[\W_]*\]\s*)+$', '')), '(?i)^(?:{_PREFIXES})\s*', '')), 240)"


def kind(h: str, n: str) -> str:
    """The type of a title ``h`` whose normal form is ``n``."""
    low = f"lower({h})"
    return rf"""CASE WHEN {h} = '' OR {n} = '' THEN 'review' WHEN {n} IN ({_GENERIC}) OR regexp_matches({low}, '^(?:{_STARTS})') THEN 'headline' WHEN regexp_matches({low}, '^(?:important\s+)?announcement\b') THEN 'review'
        WHEN regexp_matches({low}, '\b(?:article|interview|press release|announcement)\b') OR regexp_matches({low}, '^welcome\s+(?:to|back)\b') OR regexp_matches({low}, '^(?:response to|publication hold|press release|statement|article)\b') THEN 'headline'
        WHEN contains({h}, '?') OR length({h}) > 120 OR regexp_matches({low}, '\b(?:has been|have been|was|were|will be|are being|we have|our company|announced that|reported that)\b') THEN 'review' ELSE 'victim' END"""


@lru_cache(maxsize=1)
def fold() -> str:
    """CTE (c, f): every character that isn't its own lower case after compatibility decomposition and case folding without marks.

    By the rule of the Unicode database; Hangul, of which each syllable stands for itself, is left out.
    """
    pairs = []
    for i in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000)]:
        f = "".join(x for x in unicodedata.normalize("NFKD", chr(i)).casefold() if not unicodedata.combining(x))
        if f != chr(i).lower():
            pairs.append((chr(i), f))
    split = lambda k: f"unnest(string_split({quoted(chr(1).join(p[k] for p in pairs))}, chr(1)))"
    return f"fold AS MATERIALIZED (SELECT {split(0)} AS c, {split(1)} AS f)"


def folded(name: str, texts: str) -> str:
    """CTEs ``name`` (x, y): each distinct text ``x`` of a query with its normal form; needs ``fold``."""
    return rf"""{name}_c AS (SELECT x, i, substr(x, i, 1) AS c FROM (SELECT x, unnest(range(1, length(x) + 1)) AS i FROM (SELECT DISTINCT x FROM ({texts}) WHERE x IS NOT NULL))),
    {name} AS (SELECT x, trim(regexp_replace(string_agg(coalesce(f, lower(c)), '' ORDER BY i), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS y FROM {name}_c LEFT JOIN fold USING (c) GROUP BY x)"""


def details(m: str) -> str:
    """A map of details, bounded, as text."""
    known = "'description', 'claimed_data_size', 'file_count', 'deadline', 'organization_website'"
    value = f"CASE WHEN e.key = 'description' THEN {bounded('e.value', 500)} WHEN e.key IN ({known}) THEN {bounded('e.value', 240)} ELSE e.value END"
    return f"list_filter(list_transform(map_entries({m}), lambda e: struct_pack(k := e.key, v := {value})), lambda e: e.v IS NOT NULL OR e.k NOT IN ({known}))"


def details_text(entries: str) -> str:
    return f"nullif(array_to_string(list_sort(list_transform({entries}, lambda e: e.k || '=' || coalesce(e.v, ''))), '; '), '')"


def normalised(name: str, source: str, keep: str) -> str:
    """CTEs that end in ``name``: rows of ``source`` in the public schema; ``keep``: further columns of it. Needs ``fold``."""
    raw, spoken = bounded("organization", 240), clean("coalesce(raw, title, '')")
    cand = f"nullif({clean('coalesce(nullif(org, %s), h)' % quoted(''))}, '')"
    return rf"""{name}_a AS (SELECT *, {bounded("coalesce(nullif(post_title, ''), organization)", 500)} AS title, {raw} AS raw, coalesce({bounded('country', 120)}, '') AS own FROM ({source})),
    {name}_b AS (SELECT *, {spoken} AS spoken FROM {name}_a),
    {name}_d AS (SELECT *, {title('spoken')} AS org, {code('spoken')} AS fcode, {code('own')} AS ocode, {rest('own')} AS otext FROM {name}_b),
    {name}_e AS (SELECT *, {title(clean('coalesce(title, org)'))} AS h FROM {name}_d),
    {folded(f'{name}_f', f'SELECT h AS x FROM {name}_e')},
    {name}_g AS (SELECT e.*, coalesce(y, '') AS n, coalesce(k1.country, ocode) AS oflag, coalesce(k2.country, fcode) AS fflag FROM {name}_e e LEFT JOIN {name}_f ON x = h LEFT JOIN (VALUES {_COUNTRIES}) k1(cc, country) ON k1.cc = ocode LEFT JOIN (VALUES {_COUNTRIES}) k2(cc, country) ON k2.cc = fcode),
    {name}_k AS (SELECT *, {kind('h', 'n')} AS t FROM {name}_g),
    {name} AS (SELECT {keep}, title AS post_title, t AS post_type, CASE WHEN h = '' OR n = '' OR t = 'headline' THEN NULL WHEN t = 'review' AND regexp_matches(lower(h), '^(?:important\s+)?announcement\b') THEN nullif(regexp_extract(h, '(?i)^announcement\s+(?:for|about)\s+(?:the\s+)?(.+?)(?:\s+and\s+its\s+clients)?$', 1), '')
        WHEN t = 'victim' AND raw IS NOT NULL THEN coalesce(nullif(org, ''), raw) ELSE {cand} END AS organization, {bounded('reported_date', 120)} AS reported_date, coalesce(nullif(otext, ''), oflag, fflag) AS country,
        CASE WHEN coalesce(nullif(otext, ''), oflag, fflag) IS NULL THEN NULL WHEN country_basis IN ('explicit', 'flag_inferred') THEN country_basis WHEN nullif(otext, '') IS NOT NULL THEN 'explicit' ELSE 'flag_inferred' END AS country_basis,
        {bounded('sector', 160)} AS sector, {details('claim_details')} AS details FROM {name}_k)"""


# What is stripped around a name, and the wordings that wrap one, in the order in which they are tried.
_EDGES = r"^[ \t\r\n|!?:;,-]+|[ \t\r\n|!?:;,-]+$"
_WRAPPERS = (
    r"leaks?\s+company\s+(.+?)\s*$",
    r"leakage\s+from\s+company\s+(.+?)\s*$",
    r"security\s+breach\s+of\s+(.+?)\s+network\s*[.!]*$",
    r"official\s+appeal\s+to\s+(.+?)\s*[.!]*$",
    r"leak\s+post\s+(.+?)\s*[.!]*$",
    r"new\s+files\s+for\s+leak\s+(.+?)\s+post\s*[.!]*$",
    r"full\s+data\s+leak\s+of\s+(.+?)\s*/+\s*$",
    r"full\s+data\s+leak\s+of\s+(.+?)\s*[.!]*$",
    r"leak\s+announcement\s*[-:–—]\s*(?:it\s+company\s+)?(.+?)\s*[.!]*$",
    r"(.+?)\s+[-–—]\s+announcement(?:\s+before\s+publishing\s+data)?\s*[.!]*$",
    r"announcement\s*:\s*(.+?)\s+(?:will\s+be|going\s+to\s+be)\s+(?:leaked|published).*$",
    r"(.+?)\s*(?:\|\s*|[-–—:]\s*)data\s+security\s+breach\s*[.!]*$",
    r"(.+?)\s+(?:big\s+|full\s+|confidential\s+)?data\s+leak\s*[.!]*$",
    r"(.+?)\s+data\s+breach\s*[.!]*$",
    r"(.+?)\s+security\s+breach\s*[.!]*$",
    r"(.+?)\s+breach\s*[.!]*$",
)


def looks(name: str, texts: str) -> str:
    """CTE ``name`` (x, ok): whether each distinct text ``x`` of a query reads as a name."""
    upper = "regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]')"
    return rf"""{name}_t AS (SELECT x, regexp_replace({clean('x')}, '{_EDGES}', '', 'g') AS t FROM (SELECT DISTINCT x FROM ({texts}) WHERE x IS NOT NULL)),
    {name}_w AS (SELECT *, regexp_extract_all(t, '[A-Za-z0-9]+(?:[''’&.-][A-Za-z0-9]+)*') AS ws FROM {name}_t),
    {name} AS (SELECT x, length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 2 AND (regexp_matches(t, '(?i)\b(?:incorporated|inc|llc|ltd|limited|corp|corporation|plc|gmbh|s\.?a\.?|s\.?r\.?l\.?|llp|pty)\b')
        OR regexp_matches(t, '\b[\w-]+\.[A-Za-z]{{2,}}\b') OR regexp_matches(regexp_replace(t, '[A-Za-z]', '', 'g'), '\p{{L}}') OR CASE WHEN len(ws) = 1 THEN list_contains(list_transform(ws, lambda w: ({upper}) OR (regexp_matches(w, '^[A-Z]') AND length(w) >= 3)), true)
        WHEN len(ws) > 1 THEN list_contains(list_transform(ws, lambda w: ({upper}) AND length(w) >= 2), true) OR len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Z]'))) >= 2 ELSE false END) AS ok FROM {name}_w)"""


def judged(moment: str, compact) -> str:
    """CTEs that end in ``j``: every archive post with its group, organisation, time and outcome. Needs ``fold``.

    ``moment``: SQL of the time of ``discovered`` as ISO text; ``compact``: SQL of a compact label.
    """
    wrap = ", ".join(f"regexp_replace({squash(f'regexp_extract(bare, {quoted('(?i)^' + w)}, 1)')}, '{_EDGES}', '', 'g')" for w in _WRAPPERS)
    return rf"""p0 AS (SELECT row_number() OVER () AS rn, group_name AS label, left({clean('post_title')}, 500) AS orig, {moment} AS ts FROM archive_posts),
    p1 AS (SELECT *, {squash(rf"regexp_replace({clean('orig')}, '^[\s*_`~]+|[\s*_`~]+$', '', 'g')")} AS bare FROM p0),
    w AS (SELECT bare, unnest(range(1, {len(_WRAPPERS) + 1})) AS i, unnest([{wrap}]) AS x FROM (SELECT DISTINCT bare FROM p1)),
    {looks('lw', 'SELECT x FROM w')},
    ww AS (SELECT bare, arg_min(w.x, i) AS wrapped FROM w JOIN lw ON lw.x = w.x WHERE w.x <> '' AND ok GROUP BY bare),
    {normalised('nr', "SELECT rn, label, orig, ts, bare, wrapped, bare AS post_title, coalesce(wrapped, bare) AS organization, NULL AS reported_date, NULL AS country, NULL AS country_basis, NULL AS sector, CAST(NULL AS MAP(VARCHAR, VARCHAR)) AS claim_details FROM p1 LEFT JOIN ww USING (bare)", 'rn, label, orig, ts, bare, wrapped')},
    {looks('lo', 'SELECT organization AS x FROM nr')},
    named AS (SELECT nr.*, CASE WHEN bare = '' OR regexp_matches(bare, '(?i)^new\s+data\s+leak\s+post\s+from\s+chemical\s+company\b') THEN NULL WHEN wrapped IS NOT NULL THEN wrapped
        WHEN NOT regexp_matches(bare, '(?i)\b(?:announce(?:s|d|ment)?|summary|evidence\s*&\s*debunking|debunking|reported\s+to\s+the\s+sec|following\s+a\s+breach)\b') AND post_type = 'victim' AND lo.ok THEN organization END AS org FROM nr LEFT JOIN lo ON lo.x = organization),
    {folded('jn', 'SELECT org AS x FROM named')},
    gk AS (SELECT {compact('x')} AS key, group_id, coalesce(nullif(name, ''), group_id) AS n FROM (SELECT group_id, name, unnest([group_id, name]) AS x FROM group_catalog) WHERE x IS NOT NULL),
    gu AS (SELECT key, min(group_id) AS group_id, min(n) AS group_name FROM gk GROUP BY key HAVING count(DISTINCT group_id) = 1),
    j AS (SELECT gu.group_id, gu.group_name, org AS organization, coalesce(y, '') AS name, ts, orig AS post_title, CASE WHEN org IS NOT NULL THEN country END AS country, CASE WHEN org IS NOT NULL THEN country_basis END AS country_basis,
        CASE WHEN gu.group_id IS NULL THEN 'unmatched_group' WHEN org IS NULL THEN 'excluded' WHEN ts IS NULL THEN 'invalid_timestamp' ELSE 'matched' END AS outcome FROM named LEFT JOIN gu ON gu.key = {compact('label')} LEFT JOIN jn ON jn.x = org)"""


#: CTE ``c``: one row per group and organisation of the matched posts of ``j``.
CANDIDATES = """m AS (SELECT * FROM j WHERE outcome = 'matched'), latest AS (SELECT group_id, name, arg_max(t, ts) AS post_title FROM (SELECT group_id, name, ts, min(post_title) AS t FROM m GROUP BY ALL) GROUP BY ALL),
    c AS (SELECT m.group_id, m.name, min(group_name) AS group_name, arg_min(organization, struct_pack(a := ts, b := m.post_title, c := organization)) AS organization, min(ts) AS first_seen_at, max(ts) AS last_seen_at, CAST(count(*) AS INTEGER) AS archive_observations,
        arg_min(country, struct_pack(a := ts, b := country)) FILTER (WHERE country IS NOT NULL) AS country, arg_min(country_basis, struct_pack(a := ts, b := country)) FILTER (WHERE country IS NOT NULL) AS country_basis, min(latest.post_title) AS post_title,
        left(sha256('historical-posts' || chr(0) || m.group_id || chr(0) || m.name), 24) AS id FROM m JOIN latest ON latest.group_id = m.group_id AND latest.name = m.name GROUP BY m.group_id, m.name)"""
