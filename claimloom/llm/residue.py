"""Template residue and error-page text in place of real content.

Titles are aligned by their template. Within a title, names, numbers and variables are slots; over the table, titles of one
template are counted, and a slot is one only if its contents vary. What a page or a template left behind shows in three ways:

* A slot keeps a variable in one of the common notations, a default that a failed lookup leaves, or nothing at all where other
  rows of the same template have a name.
* A whole page without a slot for a name is repeated. Pages of a site, "Contact" or "Welcome", are repeated too, and so are
  names; but each is always of one type. A template whose rows contradict each other, being here an organisation, there a
  headline, over several groups, isn't content: it is an error page, a notice or a filler that got into whatever was read.
* Such a whole page, found by its repetition, stands as a part of another title, in brackets or behind a dash.

Pages too rare to be repeated are known by a list of public wordings (``phrase``); nothing else depends on it.

Defined cases: null titles and types are no residue; an empty title is none either, but a template whose only slot is empty
is; texts of any length are searched whole; rows count once however often they repeat, each with its own id.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.confusables import Cleaner, letter_bigrams
from claimloom.session import cut

#: Rows of one whole wording from which contradictory types tell that it isn't content.
REPEATS = 3
_FIELD = r"(?:your|the|this|insert|enter|victim|company|organi[sz]ation|org|name|title|headline|target|post|type|status|state|sector|country|flag|prefix|tag|date|text|item|label|value|client|customer|site|firm|here|field)"
_NAME = r"[A-Za-z_][\w.]*"
# Notations of a variable in a template.
VARIABLE = re.compile(
    rf"\{{\{{.*?\}}\}}|[$#]\{{[^}}]*\}}|<%.*?%>|\{{%.*?%\}}|<\?(?:php\b|=).*?\?>|%{_NAME}%|@@\s*{_NAME}\s*@@|\[\[\s*{_NAME}\s*\]\]|(?<!\w)__{_NAME}?__(?!\w)|<<\s*{_NAME}\s*>>|\${_NAME}\$"
    rf"|\{{(?:[a-z_][a-z_0-9.]*|[A-Z_][A-Z_0-9.]*)\}}|(?i:<{_FIELD}(?:[ _.-]{_FIELD})*>)|(?i:\[{_FIELD}(?:[ _.-]{_FIELD})+\])|(?i:\b{_FIELD}(?:[ _-]{_FIELD})*[ _-]placeholder\b)|\b[A-Z]+_(?:PLACEHOLDER|HERE)\b"
)
_MAY_BE_VARIABLE = re.compile(r"[{}<>%$#@_\[]|laceholder|LACEHOLDER")
# What a failed lookup leaves. Case matters: a name may be Null or Undefined.
DEFAULT = re.compile(r"(?:^|(?<=[\s\[(:]))(?:undefined|null|NaN|nil|NULL|#REF!|#N/A|#VALUE!)(?=$|[\s\]).,;:])|\[object [A-Z]\w*\]")
# Wordings of fillers, of error pages and of notices about loading, scripts, cookies and access, without letter
# case, accents and punctuation, each run of digits as 9. Those that stand anywhere in a title, at its beginning, as the whole
# of it; and those that headlines may share, which count only where they are repeated.
ANYWHERE = """
lorem ipsum dolor|dolor sit amet|consectetur adipiscing|ut enim ad minim|sed ut perspiciatis|duis aute irure|excepteur sint|blah blah|asdf asdf|qwerty asdf|asdf qwerty|please ignore|test post|test entry|test page|test title|draft template|replace me
example company|sample post|sample title|sample text|sample page|goes here|title here|name here|text here|company here|titre ici|texte ici|nom ici|titel hier|text hier eingeben|name hier|titulo de ejemplo|texto de ejemplo
error code 9|uncaught exception|uncaught error|uncaught typeerror|stack trace|error establishing a database|conexion con la base de datos|verbindung zur datenbank|connexion a la base de donnees|page not found|page introuvable|page can t be found
page cannot be found|page does not exist|page doesn t exist|page is not available|page isn t available|seite nicht gefunden|seite wurde nicht gefunden|страница не наидена|pagina no encontrada|pagina non trovata|site can t be reached|site cannot be reached
nicht erreichbar|temporarily unavailable|temporarily unable|unable to service your request|connection timed out|connection refused|connection reset|timed out after 9|session has expired|log in again|rate limit exceeded|too many requests|queue position|please wait
checking your browser|verify you are human|verify that you are human|verify you are a human|human verification|complete the captcha|solve the captcha|enter the captcha|one more step|ddos protection|ray id|enable cookies|enable javascript|enable scripts
javascript is required|javascript is disabled|javascript is off|javascript must be enabled|javascript needs to be enabled|turn on javascript|turn on cookies|switch on javascript|requires javascript|requires scripts|require scripts|without javascript
activer javascript|activez javascript|javascript aktivieren|javascript einschalten|aktivieren sie javascript|aktivieren sie bitte javascript|aktivieren sie cookies|включите javascript|включите cookies|habilite javascript|habilitar javascript
abilitare javascript|abilita javascript|browser does not support|browser doesn t support|unsupported browser|noscript|we use cookies|accept all cookies|accept all to continue|accept cookies|cookies must be enabled|cookies are required|cookies are disabled
cookie consent|nous utilisons des cookies|wir verwenden cookies|usamos cookies|access to this page|access to this site|access to this resource
"""
BEGINNING = "access denied|access forbidden|fatal error|parse error|syntax error|database error|runtime error|server error|internal error|proxy error|traceback most recent|just a moment|attention required|untitled|todo victim|todo title|todo name|fixme|bitte warten|chargement|cargando|загрузка|insert title|insert name|insert text|insert company"
WHOLE = "loading|lorem ipsum|lorem ipsum 9|hello world|foo bar|foo bar baz|card title|card title 9|post title|post title 9|page title|page title 9|todo|not found|forbidden 9|bad request|bad gateway|gateway time out|gateway timeout|request timeout|request time out|internal server error|method not allowed|not implemented|unauthorized|unauthorised|service unavailable"
SHARED = "maintenance|under construction|coming soon|access required|sign in|login|log in|redirecting|processing|error|forbidden|unavailable"
#: The same in a script without spaces, as part of a word.
_UNSPACED = ("javascriptを有効", "ページが見つかりません", "ダミー", "テキストが入ります")
_STATUS = re.compile(
    r"(?:http )?(?:error )?[45]\d\d (?:error )?(?:error|bad request|unauthori[sz]ed|forbidden|not found|method not allowed|request time ?out|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time ?out)(?: nginx| apache| cloudflare| \d+)*"
    r"|(?:bad request|unauthori[sz]ed|forbidden|not found|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time ?out)(?: nginx| apache| cloudflare| \d+)*|(?:http )?error (?:code )?[45]?\d+"
)
_BEFORE = re.compile(r"(?:[\U0001f1e6-\U0001f1ff]{2}\s*)?(?:(?:new victim|victim|leak|company)\s*:\s*)?", re.IGNORECASE)
_AFTER = re.compile(r"\s*\[(?:new|released|sold|published|data leak|all stolen data|leaked)\]$", re.IGNORECASE)
_NAMED = re.compile(r"(?:\b[^\W\d_a-zß-öø-ÿ][\w.'’&/-]*[,)]*(?:\s+&(?=\s+[^\W\d_a-z]))?\s*)+")
_PART = re.compile(r"[(\[]([^()\[\]]+)[)\]]|\s[-–—|]\s+(.+)$")
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[\W_]+")


#: All combining marks but those that give kana their voicing.
_MARKS = re.compile("[" + "".join(chr(c) for c in [*range(0x300, 0xFE30), *range(0x101FD, 0x1E94B)] if unicodedata.combining(chr(c)) and c not in (0x3099, 0x309A)) + "]")
#: Lower case for letters in ASCII, spaces for all but letters and digits.
_PLAIN = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))


def normal(text: str) -> str:
    """A clean text with letter case, accents and punctuation set aside."""
    if text.isascii():
        return " ".join(text.encode().translate(_PLAIN).decode().split())
    x = _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))
    return " ".join(_SPLIT.sub(" ", unicodedata.normalize("NFC", x)).split())


def _by_first_word(phrases: str) -> dict[str, list[list[str]]]:
    out: dict[str, list[list[str]]] = {}
    for p in phrases.replace("\n", "|").split("|"):
        if p:
            words = p.split()
            out.setdefault(words[0], []).append(words)
    return out


_ANYWHERE, _BEGINNING = _by_first_word(ANYWHERE), _by_first_word(BEGINNING)
_WHOLE, _SHARED = frozenset(WHOLE.split("|")), frozenset(SHARED.split("|"))
_STATUS_WORDS = frozenset("http error bad unauthorized unauthorised forbidden not internal service gateway".split())


def wording(text: str) -> str:
    """A clean text as its template without slots for names: words in normal form, runs of digits as 9."""
    return _DIGITS.sub("9", normal(text))


def phrase(wording_: str) -> str:
    """``page`` for a wording that error pages and fillers use, ``shared`` for one that they share with headlines, else ""."""
    words = wording_.split()
    if not words:
        return ""
    if not _ANYWHERE.keys().isdisjoint(words):
        for i, w in enumerate(words):
            for p in _ANYWHERE.get(w, ()):
                if words[i : i + len(p)] == p:
                    return "page"
    for w in words:
        if w[0] == w[-1] and len(w) > 3 and w == w[0] * len(w) and w.isalpha() and (len(w) > 4 or words.count(w) > 1):
            return "page"
    if (words[0] in _BEGINNING and any(words[: len(p)] == p for p in _BEGINNING[words[0]])) or wording_ in _WHOLE:
        return "page"
    if (words[0] in _STATUS_WORDS or words[0] == "9") and _STATUS.fullmatch(wording_.replace("9", "500", 1) if words[0] == "9" or words[:2] in (["http", "9"], ["error", "9"]) else wording_):
        return "page"
    if not wording_.isascii() and any(u in wording_ for u in map(normal, _UNSPACED)):
        return "page"
    return "shared" if wording_ in _SHARED else ""


def bare(title: str) -> str:
    """A title without the flag, prefix and tag that decorate it."""
    title = title.strip()
    if m := _BEFORE.match(title):
        title = title[m.end() :]
    return _AFTER.sub("", title) if title.endswith("]") else title


def holds_variable(title: str) -> bool:
    """Whether a slot of the title keeps a variable or a default."""
    may_be_default = "undefined" in title or "null" in title or "NaN" in title or "nil" in title or "NULL" in title or "#" in title or "[object" in title
    return bool((_MAY_BE_VARIABLE.search(title) and VARIABLE.search(title)) or (may_be_default and DEFAULT.search(title)))


def aligned(title: str) -> tuple[str, list[str]]:
    """(template, contents of its slots) of a bare title: names and variables as one slot sign each, runs of digits as 9."""
    slots: list[str] = []

    def slot(m: re.Match) -> str:
        slots.append(m.group().strip())
        return "◊ "

    text = VARIABLE.sub("◊ ", title) if _MAY_BE_VARIABLE.search(title) else title
    return " ".join(_DIGITS.sub("9", _NAMED.sub(slot, text)).split()), slots


def is_sentence(template: str, words: int = 3) -> bool:
    """Whether plain words hold a template together: at least so many."""
    return sum(w.isalpha() and w.islower() for w in template.split()) >= words


def residue(title: str | None, post_type: str | None) -> tuple[str, str, str, str]:
    """(kind, template, slot contents, wording) of a clean title and its type by themselves.

    ``slot``: a variable or default stands in a slot of either, or the only slot is blank; ``page``: a listed wording;
    ``shared``: a listed wording that counts if repeated; "": only the table can tell. The wording is empty where a slot
    holds a variable, as such a title is no page.
    """
    kind = "slot" if _type_residue(post_type) else ""
    if title is None:
        return kind, "", "", ""
    stripped = bare(title)
    template, slots = aligned(stripped)
    if holds_variable(title) or (title.strip() and stripped.strip(" []():-") == ""):
        return "slot", template, " ".join(slots), ""
    said = wording(stripped)
    return kind or phrase(said), template, " ".join(slots), said


def _type_residue(value: str | None) -> str:
    """A type is a slot by itself: a variable, default, filler, status code or the field's own name in it is residue."""
    if value is None:
        return ""
    v = value.strip()
    if VARIABLE.search(v) or DEFAULT.search(v) or phrase(wording(v)) == "page" or re.fullmatch(r"(?i)[1-5]\d\d|lorem|ipsum|todo|tbd|fixme|none|placeholder|test|\w*_?type|nan|undefined|null|object", v):
        return "slot"
    return ""


def _part(title: str) -> str:
    """The wording of what stands in brackets or behind a dash, of three words or more; "" without one."""
    found = [wording(a or b) for a, b in _PART.findall(title)]
    return max((w for w in found if w.count(" ") >= 2), key=len, default="")


def _blank_forms(template: Column) -> Column:
    """The template with each of its slots left blank."""
    words = F.split(template, " ")
    slots = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.get(words, i - 1) == "◊")
    return F.transform(slots, lambda i: F.array_join(F.concat(F.slice(words, F.lit(1), i - 1), F.slice(words, i + 1, F.size(words))), " "))


def differ(column: str) -> Column:
    """Aggregate: whether a text column holds different values, nulls aside. By hashes, as texts would have to be sorted."""
    h = F.when(F.col(column).isNotNull(), F.xxhash64(column))
    return F.min(h) < F.max(h)


def repeated_pages(titles: DataFrame) -> DataFrame:
    """(wording, repeats) of the whole pages that their repetition shows to be no content.

    ``titles``: (wording, said, origin, shared): the wording of a title, its row's declared type and group, and whether
    headlines may share it. Rows of a wording contradict each other where they state different types; at least REPEATS rows
    of more than one group, if groups are known. Minima, maxima and counts only, so a wording of a third of all rows arrives as one
    row for each input partition.
    """
    told = titles.where("wording <> ''").groupBy("wording").agg(
        F.count("*").alias("repeats"), differ("said").alias("contradict"), (F.count("origin") == 0).alias("unknown"), differ("origin").alias("apart"), F.max("shared").alias("shared")
    )
    return told.where((F.col("contradict") & (F.col("repeats") >= REPEATS) & (F.col("unknown") | F.col("apart"))) | (F.col("shared") & (F.col("repeats") >= 2))).select("wording", "repeats")


def _judged(rows: DataFrame, key: str) -> DataFrame:
    model = letter_bigrams(rows, [c for c in ("organization", "post_title") if c in rows.columns])
    kind = rows.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cleaner = Cleaner(model)
        for b in batches:
            titles = [None if t is None else cleaner(t) for t in b["post_title"]]
            found = [residue(t, p) for t, p in zip(titles, b["post_type"], strict=True)]
            types = [None if p is None or _type_residue(p) else p.strip().lower() for p in b["post_type"]]
            parts = [_part(bare(t)) if w and ("(" in t or "[" in t or " - " in t or " – " in t or " | " in t) else "" for t, (_, _, _, w) in zip(titles, found, strict=True)]
            yield pd.DataFrame({key: b["__key"], "kind": [k for k, _, _, _ in found], "template": [s for _, s, _, _ in found], "slots": [x for _, _, x, _ in found], "wording": [w for _, _, _, w in found], "part": parts, "said": types, "origin": b["__origin"]})

    origin = F.col("group_id").cast("string") if "group_id" in rows.columns else F.lit(None).cast("string")
    return cut(rows.select(F.col(key).alias("__key"), "post_title", "post_type", origin.alias("__origin")).mapInPandas(judge, f"`{key}` {kind}, kind string, template string, slots string, wording string, part string, said string, origin string"))


def _marked(judged: DataFrame, key: str, phrases: bool) -> DataFrame:
    """(key, kind, template, repeats) of the rows of ``judged`` that are residue."""
    pages = cut(repeated_pages(judged.select("wording", "said", "origin", (F.col("kind") == "shared").alias("shared"))))  # written, its size is known before the joins
    # Sentences with a slot whose contents vary, each with the slot left out; rows of that wording have it blank.
    sentences = judged.where(F.col("template").contains("◊") & F.col("template").rlike(r"(?:(?:^| )\p{Ll}+\b.*){3}")).groupBy("template").agg(differ("slots").alias("varies"))
    blanks = sentences.where("varies").select(F.explode(_blank_forms(F.col("template"))).alias("template")).distinct().withColumn("blank", F.lit(True))
    told = judged.join(pages.withColumnRenamed("repeats", "as_whole"), "wording", "left").join(pages.select(F.col("wording").alias("part"), F.col("repeats").alias("as_part")), "part", "left").join(blanks, "template", "left")
    kind = (
        F.when(F.col("kind") == "slot", "slot").when(F.col("as_whole").isNotNull(), "page").when(F.col("as_part").isNotNull(), "part").when(F.col("blank"), "blank")
        .when((F.col("kind") == "page") & F.lit(phrases), "phrase")
    )
    return told.select(key, kind.alias("kind"), "template", F.coalesce("as_whole", "as_part").alias("repeats")).where("kind is not null")


def with_residue(rows: DataFrame, key: str = "id", phrases: bool = True) -> DataFrame:
    """(key, kind) of every row whose title or type is residue.

    ``rows``: (key, post_title, post_type), and ``group_id`` and ``organization`` if they are known. Kinds: ``slot`` (a variable
    or default, or the only slot blank), ``page`` (repeated whole), ``part`` (a repeated whole within a title), ``blank`` (a
    slot of a sentence left blank), ``phrase`` (a rare wording, by the list; not with ``phrases=False``).
    """
    return _marked(_judged(rows, key), key, phrases).select(key, "kind")


def with_support(rows: DataFrame, key: str = "id", phrases: bool = True) -> DataFrame:
    """(key, kind, template, support): also the number of rows of the template, or of the repeated page."""
    judged = _judged(rows, key)
    templates = judged.groupBy("template").agg(F.count("*").alias("n"))
    return _marked(judged, key, phrases).join(templates, "template", "left").select(key, "kind", "template", F.coalesce("repeats", "n").alias("support"))
