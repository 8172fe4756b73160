"""Variant spellings of the names of organisations, linked to the organisations they mean.

1. Each row's texts are brought to clean and normal form. What the table itself tells is counted over all of its rows: words of
   business (beside many different partners), headlines with a name in their gap (templates with a slot whose contents vary),
   and pages that aren't content (repeated whole under contradictory types).
2. A name (organisation, title, host of the website) is reduced to its distinctive part: no legal forms, given names and words
   of business, sounds spelt one way, other alphabets transliterated.
3. Metric-space partitioning of the distinct parts under Levenshtein distance. Pivots picked from the names themselves don't
   part random names: their distances to any pivot differ by one or two, so the triangle inequality would copy every name
   into nearly every cell. The pivots are therefore pairs of quarters of a name, of which two edits leave at least one pair
   intact and at most moved by two letters, and for short names the strings one or two deletions away: two names within the
   radius lie in the cell of a common pivot. Inside a cell the exact radius join runs with the true metric.
   Distinct parts of 5 to 7 letters link when equal, or within one edit (of four, too) if business, website or country agree; shorter
   ones, mostly acronyms, when they are equal and the business is; both give way to a longer name on the same row. A short website
   links its rows.
4. Links of that join, of the two names on one row, of one website and of copies of one listing make families, by connected
   components. A family is split where line of business, country and website all differ.

Only distinct names are joined, so an organisation that a third of all rows name is one name in a handful of cells. Names and
families go by their texts, not by hashes of them.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.confusables import Cleaner, letter_bigrams
from claimloom.llm.residue import _DIGITS, DEFAULT, VARIABLE, _type_residue, aligned, bare, differ, holds_variable, is_sentence, normal, phrase, repeated_pages, wording
from claimloom.session import cut

RADIUS, LEAST, SHORT, QUARTERED = 2, 8, 5, 10
#: A word of business has partners of at least so many kinds, by their initials, and stands in one of so many names at least.
PARTNERS, RATE = 8, 10_000
#: A headline with a gap has at least so many rows, and one in so many rows of all such headlines.
HEADLINES, HEADLINE_RATE = 3, 10_000
#: Rows of an organisation that meet in one task of the last step.
BLOCK = 2_000
#: Of the pivots, those that one task of the radius join holds are as many as so many names have; pairs that it makes at a time.
NAMES, PAIRS = 10_000, 1_000_000
# Legal forms and words that don't tell organisations apart.
LEGAL = set(
    "the of and a an s l v b c n p r z o e y co company companies corp corporation inc incorporated ltd limited llc llp lp plc gmbh mbh ag kg kgaa ohg gesellschaft aktiengesellschaft sa sas sarl srl spa ltda lda "
    "ab as aps oy oyj nv bv sp zoo kk pty pvt private cv de di du des la le el der und et group grp holding holdings sociedad anonima societe international intl int ко κο www example 株式会社 有限会社".split()
)
# Given names and their short forms, which organisations of one person put before the family name.
GIVEN = set(
    "robert rob bob bobby robbie bobbie william will bill billy willy wm elizabeth liz lizzie beth betty betsy bess eliza elsie lisa lottie eleanor ellie elie nora nell nellie lena johannes hans hannes jo theodore theodor ted theo teddy francisco paco pancho cisco fran frank franz "
    "edward ed eddie eddy ned alexander alex alec lex sasha sascha sandy james jim jimmy jamie jimmie jas katherine kathryn catherine kate kathy kathie kat kitty cathy patricia pat patty pattie patti trish tricia margaret maggie peggy meg marge margie rita maximilian max maxi giuseppe beppe peppe pino "
    "dorothy dot dottie dotty dolly dodie richard rick dick rich richie ricky dickie charles charlie chuck charley chas michael mike thomas tom john jack david dave susan sue maria anna peter paul joseph joe bert bertie".split()
)
# Common words of business, most of them English, known also in a table too small to learn them from.
BUSINESS = frozenset(
    "services architects dental transport council county academy water travel municipal department authority office law petroleum accounting attorneys capital electric practice management brewing associates catering freight resort college bakery construction shipping energy union credit "
    "school logistics cement financial hotels insurance supermarkets builders district solar power farms networks data furniture university dairy systems software brothers electronics pharmacy health stores precision tools trading foods technologies hospital industries manufacturing "
    "steel works plastics laboratory center medical engineering clinic winery завод больница".split()
)
# Common abbreviations too short to be read by their letters.
_BRIEF = {"sys": "systems", "med": "medical", "lab": "laboratory", "ins": "insurance", "fin": "financial", "ind": "industries", "eng": "engineering", "mfg": "manufacturing", "mgt": "management", "ctr": "center", "sch": "school", "mun": "municipal", "cap": "capital", "bro": "brothers"}
# Two-letter codes of countries.
_COUNTRIES = {
    "us": "united states", "de": "germany", "gb": "united kingdom", "uk": "united kingdom", "fr": "france", "it": "italy", "ca": "canada", "es": "spain", "br": "brazil", "in": "india", "au": "australia", "ar": "argentina",
    "nl": "netherlands", "at": "austria", "dk": "denmark", "ch": "switzerland", "jp": "japan", "se": "sweden", "no": "norway", "pl": "poland", "gr": "greece", "ua": "ukraine", "za": "south africa", "mx": "mexico", "ie": "ireland",
    "pt": "portugal", "nz": "new zealand", "be": "belgium", "fi": "finland", "cz": "czechia", "ru": "russia", "by": "belarus", "bg": "bulgaria", "rs": "serbia", "cn": "china", "kr": "south korea", "tr": "turkey", "il": "israel",
    "sg": "singapore", "cl": "chile", "co": "colombia",
}
_PLACES = frozenset(w for name in _COUNTRIES.values() for w in name.split())
_UNTOLD = LEGAL | GIVEN | _PLACES
_OTHER_ALPHABET = {"japan", "greece", "ukraine", "russia", "belarus", "bulgaria", "serbia", ""}
_HOST = re.compile(r"(?:www\.)?[a-z0-9-]+\.[a-z]+")
_BEFORE_HOST = re.compile(r"^(?:https?://)?(?:www\d?\.)?")
_BETWEEN_WORDS = re.compile(r"[^a-z0-9]+")
_DOUBLED = re.compile(r"(.)\1+")
_BRACKETED = re.compile(r"\s*[(\[]([^()\[\]]+)[)\]]\s*$")
_NOT_NAMED = re.compile(r"(?i)^(?:|n/?a|none|null|nil|unknown|undisclosed|not disclosed|tba|tbd|\?+|[-—–]+)$")
_GREEK = (("μπ", "b"), ("ντ", "d"), ("γκ", "g"), ("ου", "u"), ("ευ", "ev"), ("αυ", "av"), *zip("αβγδεζηθικλμνξοπρστυφχψω", "a v g d e z i th i k l m n x o p r s t i f h ps o".split(), strict=True), ("ς", "s"))
_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяіїєґё", "a b v g d e zh z i i k l m n o p r s t u f h ts ch sh sch - i - e yu ya i i e g e".replace("-", "").split(" "), strict=True))


def _latin(word: str) -> str:
    """A word of another alphabet in Latin letters; kana by the names of their letters."""
    if word.isascii():
        return word
    out = []
    for a, b in _GREEK:
        word = word.replace(a, b)
    for c in unicodedata.normalize("NFC", word):
        if c in _CYRILLIC:
            out.append(_CYRILLIC[c])
        elif "ァ" <= c <= "ヺ" or "ぁ" <= c <= "ゔ":
            name = unicodedata.name(c).split()
            out.append(name[-1].lower() if name[-2] != "SMALL" else "")
        else:
            out.append("ss" if c == "ß" else c)
    return "".join(out).translate(str.maketrans("łøđðþıæœ", "loddtiao"))


@lru_cache(maxsize=1 << 16)
def sounded(word: str) -> str:
    """One spelling for letters that sound alike, doubled letters once."""
    word = _DOUBLED.sub(r"\1", word.replace("ph", "f").replace("ck", "k"))
    word = word.replace("y", "i").replace("w", "v")
    return word if "ch" in word else word.replace("c", "k")


_KANA = str.maketrans("vlfc", "brhk")
_SYLLABLE = re.compile(r"([^aeiou]*)([aeiou])")


@lru_cache(maxsize=1 << 16)
def _spoken(word: str, kana: bool) -> str:
    out = []
    for onset, vowel in _SYLLABLE.findall(word):
        if kana:
            onset = onset.translate(_KANA)
            onset = "".join(c + ("o" if c in "td" else "u") for c in onset[:-1]) + onset[-1:]
        out.append(onset + vowel)
    return "".join(out)


def spoken(words: list[str], kana: bool) -> str:
    """What is left of Latin words when written in an alphabet of open syllables, or another one without final consonants."""
    return "".join(_spoken(w, kana) for w in words)


_VOWELS = set("aeiou")


def _shortens(short: str, word: str) -> bool:
    """Whether a word is an abbreviation of another: its beginning, or its first letter and consonants of it in their order."""
    stem = short[:-1] if short.endswith("s") and len(short) > 3 else short
    if short[:1] != word[:1] or len(short) >= len(word) or len(stem) < 3:
        return False
    if word.startswith(stem) or (word.startswith(stem[:-1]) and stem[-1] in word[len(stem) - 1 :] and len(stem) > 3):
        return True
    left = iter(word)
    return not set(short[1:]) & _VOWELS and all(c in left for c in short)


class Business:
    """Words of business, and the spellings that mean one of them: abbreviations, cognates, typing errors."""

    def __init__(self, partners: dict[str, int]):
        """``partners``: each word with the number of names it stands in; words of BUSINESS count as well."""
        self.words = {w: 0 for w in BUSINESS} | {w: n for w, n in partners.items() if w not in _UNTOLD}
        order = sorted(self.words, key=lambda w: (-self.words[w], w))
        self.main: dict[str, str] = {}
        alike: dict[str, list[str]] = {}
        for w in order:
            alike.setdefault(w[0], []).append(w)
        for w in order:
            # Of the words it may stand for, the most frequent one that isn't itself short for another.
            self.main[w] = next((self.main[x] for x in alike[w[0]] if x != w and self.words[x] >= self.words[w] and self.main.get(x) == x and (_shortens(w, x) or self._kin(w, x))), w)
        self.main.update(_BRIEF)
        self.full = [w for w in order if self.main[w] == w and len(w) > 4]
        #: Beginnings of one word only, and "" for those of several.
        self.beginnings: dict[str, str] = {}
        for w in self.full:
            for i in range(4, len(w) - 1):
                self.beginnings[w[:i]] = w if self.beginnings.get(w[:i], w) == w else ""
        self.shapes: dict[str, str] = {}
        for w in order:
            if len(w) >= 6:
                for i in range(len(w)):
                    self.shapes.setdefault(w[:i] + "?" + w[i + 1 :], w)
                    self.shapes.setdefault(w[:i] + "-" + w[i + 1 :], w)
        # One edit, or one exchange of neighbours, leaves the first or the last letters as they are: half of all but two at least.
        self.heads = {w[:i] for w in order if len(w) >= 6 for i in range(2, len(w))}
        self.tails = {w[i:] for w in order if len(w) >= 6 for i in range(1, len(w) - 1)}
        self.memo: dict[str, str | None] = {}

    @staticmethod
    def _kin(a: str, b: str) -> bool:
        """Words of one stem, as in several languages: most of the longer one from the beginning on."""
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return same >= 5 and same * 5 >= max(len(a), len(b)) * 3

    def __call__(self, word: str) -> str | None:
        """The word of business that a word means, "" for an abbreviation of several, None for any other word."""
        hit = self.main.get(word)
        if hit is None:
            if word not in self.memo:
                if len(self.memo) > 200_000:
                    self.memo.clear()
                self.memo[word] = self._read(word)
            hit = self.memo[word]
        return hit

    def _read(self, word: str) -> str | None:
        n = len(word)
        if (hit := self.beginnings.get(word)) is not None:
            return hit
        if 3 < n < 7 and not _VOWELS & set(word[1:]):
            meant = [w for w in self.full if _shortens(word, w)]
            return (meant[0] if len(meant) == 1 else "") if meant else None
        half = (n - 1) // 2
        if n < 6 or (word[:half] not in self.heads and word[-half:] not in self.tails):
            return None
        for i in range(n):
            head, tail = word[:i], word[i + 1 :]
            hit = self.shapes.get(head + "?" + tail) or (head + tail if n > 6 and head + tail in self.main else None) or self.shapes.get(head + "-" + word[i:])
            if not hit and i + 1 < n and head + word[i + 1] + word[i] + word[i + 2 :] in self.main:
                hit = head + word[i + 1] + word[i] + word[i + 2 :]
            if hit:
                return self.main[hit]
        return None


class Name:
    """The parts of one name: ``words`` that are distinctive, ``business`` words, and whether it was in another alphabet."""

    __slots__ = ("abbreviated", "business", "core", "foreign", "initial", "words")

    def __init__(self, text: str, known: Business):
        self.words: list[str] = []
        self.business: set[str] = set()
        self.foreign = False
        self.initial = ""
        if not text.isascii():
            text = re.sub(r"([぀-ヿ]+)", r" \1 ", text)
        for w in text.split():
            if w in _UNTOLD or len(w) < 2 or w.isdigit():
                if len(w) == 1 and not self.words and not self.initial:
                    self.initial = w
                continue
            if (b := known(w)) is not None:
                self.business.add(b)
                continue
            if not w.isascii():
                if re.search(r"[㐀-鿿]", w):
                    self.business.add(w.replace("株式会社", ""))
                    continue
                t = _latin(w)
                self.foreign |= not re.match(r"^[a-zß-öø-ÿłđœ]+$", w)
                w = t
            self.words.append(sounded(w))
        self.business.discard("")
        #: What a name of two words and one with the first of them cut down to its initial have in common, or "".
        self.abbreviated = ""
        if len(self.words) == 2:
            self.abbreviated = f"i{self.words[0][:1]} {self.words[1]} {' '.join(sorted(self.business))}"
        elif len(self.words) == 1 and self.initial and len(self.words[0]) >= 5:
            self.abbreviated = f"i{self.initial} {self.words[0]} {' '.join(sorted(self.business))}"
            self.words = [self.initial + self.words[0]]  # a family name alone would be anyone's
        self.core = "".join(self.words)


def _acronym_like(name: Name) -> bool:
    return len(name.core) < LEAST


def _site(url: str | None, known: Business) -> tuple[str, str]:
    """(distinctive part, word of business) of a website's host."""
    if not url or _NOT_NAMED.match(url.strip()):
        return "", ""
    host = _BEFORE_HOST.sub("", url.strip().lower()).split("/")[0]
    labels = host.split(".")
    words = [w for w in _BETWEEN_WORDS.split(labels[-2] if len(labels) > 1 else labels[0]) if w]
    generic = [w in _UNTOLD or known(w) is not None for w in words]
    business = [w for w, g in zip(words, generic, strict=True) if g]
    core = "".join(sounded(w) for w, g in zip(words, generic, strict=True) if not g)
    return (core, known(business[0]) or business[0] if business else "") if len(core) > 2 else ("", "")


def title_name(title: str, declared: str | None) -> str | None:
    """The name that a clean title is, without its decoration and slots that kept a variable or default; None for one that is none.

    Titles of headlines and reviews are none by themselves, only what stands in their gap is.
    """
    return _bare_name(bare(title), declared, None)


def _bare_name(text: str, declared: str | None, said: str | None) -> str | None:
    """``title_name`` of a title that is bare already; ``said``: its wording, if known."""
    if declared is not None and declared.strip().lower() in ("headline", "review"):
        return None
    if holds_variable(text):
        text, said = re.sub(r"\(\s*[^()]{0,3}\s*\)|\[\s*\]|\s-\s*$", " ", DEFAULT.sub(" ", VARIABLE.sub(" ", text))).strip(), None
    if ("(" in text or "[" in text) and (m := _BRACKETED.search(text)) and phrase(wording(m[1])) == "page":
        text, said = text[: m.start()], None
    if not text or phrase(wording(text) if said is None else said):
        return None
    return text


def uncollected(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` without Python's own search for reference cycles, which would go through all kept names again and again.

    What is made here has no cycles; the newest objects, which those of others would be among, are searched once a batch.
    """

    def calm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = gc.isenabled()
        gc.disable()
        try:
            for b in run(batches):
                yield b
                gc.collect(0)
        finally:
            if was:
                gc.enable()

    return calm


def _values(b: pa.RecordBatch, first: int, last: int) -> Iterator[tuple]:
    """The rows of the columns from one to another; texts by way of NumPy, which is faster than one by one."""
    return zip(*(x.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(x.type) else x.to_pylist() for x in b.columns[first : last + 1]), strict=True)


def _read(rows: DataFrame) -> DataFrame:
    """One narrow row for each row of the table: its texts in normal form, and what is counted over the table.

    ``norm``: the organisation in normal form; ``usable``: whether it may name one; ``ws``: those of its words that may tell
    something; ``title``: the name that the title is, if another one; ``sentence``: the bare title where plain words hold it together, as a headline may have a name in its gap.
    """
    model = letter_bigrams(rows, ("organization", "post_title"))
    kind = rows.schema["id"].dataType.simpleString()
    t_ = pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cleaner = Cleaner(model)
        types: dict[str | None, str | None] = {None: None}
        places: dict[str | None, str | None] = {None: None}
        for b in batches:
            out = []
            for o, t, p, c, url in _values(b, 1, 5):
                org = norm = title = ws = sentence = template = slots = page = None
                usable = False
                if p not in types:
                    if len(types) > 10_000:
                        types.clear()
                    types[p] = None if p is None or _type_residue(p) else p.strip().lower()
                said = types[p]
                if o is not None:
                    org = cleaner(o)
                    norm = normal(org)
                    usable = norm != "" and not _NOT_NAMED.match(org) and not holds_variable(org) and not phrase(_DIGITS.sub("9", norm))
                    if usable:
                        ws = " ".join([w for w in dict.fromkeys(norm.split()) if len(w) > 1 and w not in _UNTOLD and not w.isdigit()])
                if t is not None:
                    clean = org if t == o else cleaner(t)
                    text = bare(clean)
                    if text == org and usable:
                        page = _DIGITS.sub("9", norm)  # the title says the same as the organisation
                    else:
                        page = None if holds_variable(clean) else wording(text)
                        if (found := _bare_name(text, "victim" if usable or said is None else said, page)) is not None:
                            title = normal(found)
                            title = None if usable and title == norm else title
                    if len([w for w in text.split() if w.islower()]) >= 2:
                        template, slots = aligned(text)
                        if is_sentence(template, 2):
                            sentence = text
                        else:
                            template = slots = None
                if c not in places:
                    if len(places) > 10_000:
                        places.clear()
                    place = " ".join((c or "").casefold().split())
                    places[c] = _COUNTRIES.get(place, place) or None
                if not url or _NOT_NAMED.match(url.strip()):  # a host in place of a name says as much
                    url = next((x.strip() for x in (o, t) if x and "." in x and _HOST.fullmatch(x.strip())), None)
                out.append((norm, usable, title, ws, page or None, said, sentence, template, slots, places[c], url))
            kinds = (t_, pa.bool_(), t_, t_, t_, t_, t_, t_, pa.list_(t_), t_, t_)
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, b.column(6), b.column(7)], names=["id", "norm", "usable", "title", "ws", "wording", "said", "sentence", "template", "slots", "place", "url", "group_id", "record_id"])

    narrow = rows.select("id", "organization", "post_title", "post_type", "country", F.try_element_at("claim_details", F.lit("organization_website")).alias("site"), F.col("group_id").cast("string"), F.col("record_id").cast("string"))
    return narrow.mapInArrow(uncollected(run), f"id {kind}, norm string, usable boolean, title string, ws string, wording string, said string, sentence string, template string, slots array<string>, place string, url string, group_id string, record_id string")


def business_words(names: DataFrame) -> dict[str, int]:
    """{word: names} of the words of business, whatever the language: those that stand beside many different partners.

    ``names``: (ws), the distinct words of each name without legal forms and given names; a partner is what a name has beside a
    word. Misspelt partners of a family word begin alike, so the partners of a business word must be of PARTNERS kinds at
    least, by their initials, none with more than a third, and the word in one of RATE names. Partners are told apart only for
    words that as many rows hold, a few for each of RATE names, so what reaches the driver has a bound.
    """
    spelt = names.where("ws like '% %'").select(F.split("ws", " ").alias("ws"))
    frequent = cut(spelt.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= PARTNERS))
    total = spelt.count()
    words = F.sort_array("ws")
    initials = F.concat_ws("", F.transform(words, lambda x: F.substring(x, 1, 1)))
    each = spelt.select("ws", initials.alias("initials"), F.xxhash64(words).alias("name")).select("initials", "name", F.explode("ws").alias("w"))
    distinct = each.join(frequent.where(F.col("n") * RATE >= total).select("w"), "w").select("w", "initials", "name").distinct()
    spread = distinct.groupBy("w", "initials").count().groupBy("w").agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.count("*").alias("kinds"))
    told = spread.where((F.col("kinds") >= PARTNERS) & (F.col("most") * 3 <= F.col("n")) & (F.col("n") * RATE >= total))
    return {r["w"]: r["n"] for r in told.collect()}


def headline_gaps(sentences: DataFrame) -> dict[str, tuple[int, int]]:
    """{template: (first, last)}: headlines with names in a gap, and which slots the gap reaches from and to.

    ``sentences``: (template, slots). The same template with varying contents of a slot has a gap there; slots whose contents never
    vary are words of the headline. At least HEADLINES rows and one in HEADLINE_RATE of all sentences, so that many templates
    at most reach the driver.
    """
    each = sentences.where("template is not null").select("template", F.posexplode("slots").alias("pos", "slot"))
    told = each.groupBy("template", "pos").agg(F.count("*").alias("n"), differ("slot").alias("varies"), F.max(F.length("slot")).alias("longest"))
    total = sentences.where("template is not null").count()
    rows = told.where((F.col("n") >= HEADLINES) & (F.col("n") * HEADLINE_RATE >= total) & F.col("varies") & (F.col("longest") > 2)).groupBy("template").agg(F.min("pos"), F.max("pos")).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def gap(sentence: str, first: int, last: int) -> str:
    """What stands from one slot of a headline to another."""
    _, slots = aligned(sentence)
    at = 0
    begin = end = 0
    for k, s in enumerate(slots):
        at = sentence.index(s, at)
        if k == first:
            begin = at
        at += len(s)
        if k == last:
            end = at
    return sentence[begin:end]


def _described(rows: DataFrame) -> DataFrame:
    """One narrow row for each row that names an organisation: its name in normal form, distinctive parts, hints, profile.

    Hints are what several rows of one organisation may share beside its name: the listing they copy, a name cut down to an
    initial, the name as another alphabet has it.
    """
    read = cut(_read(rows))
    # Written, its size is known before the join.
    pages = cut(repeated_pages(read.select("wording", "said", F.col("group_id").alias("origin"), F.lit(False).alias("shared"))))
    known = Business(business_words(read.select("ws")))
    gaps = headline_gaps(read.select("template", "slots"))
    # A page in place of a title is one in place of the organisation, too, where the two are alike.
    real = F.col("page").isNull()
    name = F.when(F.col("usable") & (real | (F.regexp_replace("norm", r"\d+", "9") != F.col("wording"))), F.col("norm"))
    judged = read.join(pages.select("wording", F.lit(True).alias("page")), "wording", "left").where(real | F.col("usable"))
    clear = judged.select("id", "norm", name.alias("name"), *(F.when(real, F.col(c)).alias(c) for c in ("title", "sentence")), "template", "place", "url", "group_id", "record_id")
    kind = rows.schema["id"].dataType.simpleString()
    t_ = pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, Name] = {}
        sites: dict[str | None, tuple[str, str]] = {}

        def named(text: str) -> Name:
            n = memo.get(text)
            if n is None:
                if len(memo) > 100_000:
                    memo.clear()
                n = memo[text] = Name(text, known)
            return n

        for b in batches:
            out = []
            kept = []
            for at, (norm, name, title, sentence, template, c, url, g, r) in enumerate(_values(b, 1, 9)):
                head = named(name) if name is not None else None
                second = None
                if sentence is not None and template in gaps:
                    title = normal(gap(sentence, *gaps[template]))
                if title and (head is None or _acronym_like(head) or name not in title):  # a title that holds the name adds nothing
                    second = named(title)
                if head is None and second is None:
                    continue
                words, business, foreign = [], set(), False
                nodes: list[str] = []
                hints: list[str] = []
                short = []
                small = None
                for n in (head, second):
                    if n is not None and _acronym_like(n) and small is None and len(n.core) > 1 and not n.initial:
                        small = n
                    if n is not None and n.abbreviated:
                        short.append(n.abbreviated)
                    if n is None or _acronym_like(n) or (nodes and not _alike(nodes[0], n.core)):
                        continue
                    if not nodes:
                        words, foreign = n.words, n.foreign
                    business |= n.business
                    nodes.append(n.core)
                if not nodes and small is not None:  # an acronym says less than the name it stands beside
                    words, business, foreign = small.words, set(small.business), small.foreign
                    if len(small.core) >= SHORT or (business and len(small.core) == SHORT - 1):
                        nodes.append(small.core)
                    elif business:
                        short.append(f"c{small.core} {' '.join(sorted(business))}")
                place = c or ""
                if url not in sites:
                    if len(sites) > 100_000:
                        sites.clear()
                    sites[url] = _site(url, known)
                site, site_business = sites[url]
                if not business and site_business:
                    business = {site_business}
                if len(site) >= LEAST:
                    nodes.append(site)
                elif site:
                    hints.append(f"u{site}-{site_business}")
                if nodes and len(nodes[0]) >= LEAST and words and not foreign and place in _OTHER_ALPHABET:
                    hints += ["k" + spoken(words, k) for k in ((True, False) if place == "" else (place == "japan",))]
                elif nodes and words and foreign:
                    hints.append("k" + "".join(words))
                hints += dict.fromkeys(short)
                if g is not None and r is not None:
                    hints.append("r" + g.lower() + "\x00" + r.lower())
                if nodes or hints:
                    main = nodes[0] if nodes else ""
                    kept.append(at)
                    out.append((list(dict.fromkeys(nodes)), hints, " ".join(words) if words and "".join(words) == main else None, " ".join(sorted(business)) or None, (site + "-" + site_business) if site else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            made = [pa.array(c, k) for c, k in zip(columns, (pa.list_(t_), pa.list_(t_), t_, t_, t_), strict=True)]
            ids, norms, places = (b.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1, 6))
            yield pa.RecordBatch.from_arrays([ids, norms, *made[:4], places, made[4]], names=["id", "norm", "cores", "hints", "words", "business", "place", "site"])

    return clear.mapInArrow(uncollected(run), f"id {kind}, norm string, cores array<string>, hints array<string>, words string, business string, place string, site string")


def _alike(a: str, b: str) -> bool:
    """Whether two cores can be spellings of one name: most of their letter pairs are shared."""
    x, y = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
    return len(x & y) * 2 >= min(len(x), len(y))


#: Pairs of quarters of a name that two edits can leave intact: (quarters, the shifts of both in a name longer by so much).
#: Both edits in one quarter leave the other half whole; one edit in each of two quarters leaves the other two, each moved by
#: what was inserted before it.
_ONE = (-1, 0, 1)
_INTACT = {
    d: [((0, 1), 0, 0), ((2, 3), d, d), ((0, 3), 0, d)] + [x for y in _ONE if d - y in _ONE for x in (((0, 2), 0, y), ((1, 2), y, y), ((1, 3), y, d))]
    for d in range(-RADIUS, RADIUS + 1)
}


@lru_cache(maxsize=4096)
def _cuts(n: int, one_word: bool) -> tuple[list, list]:
    """(own cells, cells to look in) of a name of ``n`` letters: what tells a kind of cell apart, and the two spans of its text."""
    quarters = lambda k: [k * i // 4 for i in range(5)]
    q = quarters(n)
    own = [((n, i, j), q[i], q[i + 1], q[j], q[j + 1]) for (i, j) in dict.fromkeys(ij for ij, _, _ in _INTACT[0]) if n >= QUARTERED]
    other = []
    for d in range(-RADIUS if one_word else 0, RADIUS + 1):
        if n - d < QUARTERED:
            continue
        q = quarters(n - d)
        for (i, j), x, y in _INTACT[d]:
            if q[i] + x >= 0 and q[i + 1] + x <= n and q[j] + y >= 0 and q[j + 1] + y <= n:
                other.append(((n - d, i, j), q[i] + x, q[i + 1] + x, q[j] + y, q[j + 1] + y))
    return own, list(dict.fromkeys(other))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _letters(texts: list[str], n: int) -> np.ndarray:
    """Hashes of all beginnings of texts of ``n`` letters, a row for each text: polynomials in _BASE modulo 2 ** 64."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(texts), n).astype(np.uint64)
    out = np.zeros((len(texts), n + 1), dtype=np.uint64)
    for k in range(n):
        out[:, k + 1] = out[:, k] * _BASE + codes[:, k] + np.uint64(1)
    return out


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), k, 1 << 64))


def _mixed(x: np.ndarray, kind: tuple) -> np.ndarray:
    """Hashes of one kind of cell, spread over all bits."""
    x = (x ^ np.uint64(hash(kind) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _span(h: np.ndarray, a: int, b: int) -> np.ndarray:
    return h[:, b] - h[:, a] * _power(b - a)


def _pairs_of_quarters(h: np.ndarray, cuts: list) -> list[np.ndarray]:
    return [_mixed(_span(h, a, b) * _power(n + 1) + _span(h, c, d), (n, i, j)) for (n, i, j), a, b, c, d in cuts]


def _deletions(h: np.ndarray, n: int) -> list[np.ndarray]:
    """The hash of a text and of all texts one or two deletions away."""
    out = [_mixed(h[:, n], (0,))]
    for i in range(n):
        once = h[:, i] * _power(n - 1 - i) + _span(h, i + 1, n)
        out.append(_mixed(once, (0,)))
        for j in range(i + 1, n):
            out.append(_mixed((h[:, i] * _power(j - i - 1) + _span(h, i + 1, j)) * _power(n - 1 - j) + _span(h, j + 1, n), (0,)))
    return out


def pivots(names: list[str], looking: bool) -> list[np.ndarray]:
    """For each name the pivots in whose cells it lies or, if ``looking``, those where it meets others; 64-bit hashes.

    A name has cells of its own pairs of quarters, also with its words turned round, and meets others in the cells that a
    name of its length or up to two letters less would have there. A name of one word meets longer names, too, as it can't be
    turned itself. Short names, and those an edit or two longer, lie in the cells of all their deletions and meet others
    there. Two names within the radius share a pivot, whatever their words; a hash that two pivots share only adds pairs that
    the metric then rejects.
    """
    found = [np.empty(0, dtype=np.int64)] * len(names)
    groups: dict[tuple[int, bool], list[int]] = {}
    runs = [w.replace(" ", "") for w in names]
    for k, (w, r) in enumerate(zip(names, runs, strict=True)):
        groups.setdefault((len(r), " " not in w), []).append(k)
    for (n, one_word), members in groups.items():
        h = _letters([runs[k] for k in members], n)
        short = n < QUARTERED + RADIUS
        turned = h if one_word or (looking and not short) else _letters(["".join(reversed(names[k].split(" "))) for k in members], n)
        cells, looks = _cuts(n, one_word)
        cells = _pairs_of_quarters(h, looks) if looking else _pairs_of_quarters(h, cells) + ([] if one_word else _pairs_of_quarters(turned, cells))
        if cells:
            for k, row in zip(members, np.stack(cells, axis=1), strict=True):
                found[k] = row
        if short:
            both = _deletions(h, n) + ([] if one_word else _deletions(turned, n))
            for k, row in zip(members, np.stack(both, axis=1), strict=True):
                found[k] = np.concatenate((found[k], np.unique(row)))
    return found


def _laid_out(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each batch of names and each part of the pivots: the names with pivots there, and both sides' pivots, as arrays."""
    for b in batches:
        words = b.column(0).cast(pa.string())
        texts = words.to_pylist()
        sides = []
        for looking in (False, True) if texts else ():
            found = pivots(texts, looking)
            cells, at = np.concatenate(found), np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
            part = (cells.view(np.uint64) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)  # short ones are sorted in one go
            order = np.argsort(part, kind="stable")
            sides.append((cells[order], at[order], np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))))
        rows = []
        for k in range(parts) if texts else ():
            here = [(cells[e[k] : e[k + 1]], at[e[k] : e[k + 1]]) for cells, at, e in sides]
            held = np.zeros(len(texts), dtype=bool)
            for _, at in here:
                held[at] = True
            if held.any():
                number = (np.cumsum(held) - 1).astype(np.int32)
                some = words.take(pa.array(np.flatnonzero(held)))
                ends = np.frombuffer(some.buffers()[1], dtype=np.int32)[some.offset : some.offset + len(some) + 1]
                letters = some.buffers()[2]
                rows.append((k, letters.to_pybytes()[ends[0] : ends[-1]] if letters else b"", (ends - ends[0]).tobytes(), *(x for cells, at in here for x in (cells.tobytes(), number[at].tobytes()))))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int32(), *[pa.binary()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["part", "letters", "ends", "own", "own_at", "other", "other_at"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wa, wb, ra, rb): the names that lie in a cell with those that look into it, of all cells of one part, also without spaces.

    Pairs of several cells may come several times, those whose lengths alone keep them apart not at all.
    """
    texts, arrays = [], []
    total = 0
    for b in batches:
        for _, letters, ends, *sides in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own, own_at, other, other_at = (np.frombuffer(x, dtype=kind) for x, kind in zip(sides, (np.int64, np.int32) * 2, strict=True))
            arrays.append((own, own_at + np.int64(total), other, other_at + np.int64(total)))
            texts.append(pa.StringArray.from_buffers(len(ends) // 4 - 1, pa.py_buffer(ends), pa.py_buffer(letters)))
            total += len(texts[-1])
    if not texts:
        return
    words = pa.chunked_array(texts).combine_chunks()
    runs = pc.replace_substring(words, " ", "")
    lengths = pc.utf8_length(runs).to_numpy()
    own, own_at, other, other_at = map(np.concatenate, zip(*arrays, strict=True))
    order = np.argsort(own)
    own_at = own_at[order]
    cells, starts, sizes = np.unique(own[order], return_index=True, return_counts=True)
    if not len(cells):
        return
    cell = np.minimum(np.searchsorted(cells, other), len(cells) - 1)
    hit = cells[cell] == other
    first, many, looking = starts[cell[hit]], sizes[cell[hit]], other_at[hit]
    ends = np.cumsum(many)
    begin = 0
    while begin < len(many):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - many[begin] + PAIRS, "right")))
        n = many[begin:end]
        x, y = own_at[np.repeat(first[begin:end] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(looking[begin:end], n)
        may = (x != y) & (np.abs(lengths[x] - lengths[y]) <= RADIUS)
        x, y = (pa.array(k) for k in np.divmod(np.unique(x[may] * total + y[may]), total))
        yield pa.RecordBatch.from_arrays([words.take(x), words.take(y), runs.take(x), runs.take(y)], names=["wa", "wb", "ra", "rb"])
        begin = end


def radius_links(names: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of distinct names within ``radius`` of each other, or of the shorter with its words turned round.

    ``names``: (words), the words of a name joined by spaces; the results have them without. Turned are the words of the
    shorter of two names, of either if they are of one length, and of the longer if the shorter has one word only. Of each
    pivot the names that lie in its cell meet those that look into it. Millions of rows of one pivot and a few letters would
    cost more than the metric, so pivots travel as arrays, in as many parts as there are NAMES, and each task joins one part.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must lie between 0 and {RADIUS}")
    parts = 1 + names.count() // NAMES
    laid = names.select("words").mapInArrow(lambda batches: _laid_out(batches, parts), "part int, letters binary, ends binary, own binary, own_at binary, other binary, other_at binary")
    met = laid.repartitionById(parts, "part").mapInArrow(_met, "wa string, wb string, ra string, rb string")
    turned = lambda c: F.when(F.instr(c, " ") > 0, F.array_join(F.reverse(F.split(c, " ")), ""))
    # Cheap conditions first: lengths, which an edit changes by one at most.
    more = F.length("rb") - F.length("ra")
    may = (F.col("wa") != F.col("wb")) & (F.abs(more) <= radius)
    near = (
        (F.levenshtein("ra", "rb", radius) >= 0)
        | (((more >= 0) | (F.instr("wb", " ") == 0)) & (F.levenshtein(turned("wa"), F.col("rb"), radius) >= 0))
        | (((more <= 0) | (F.instr("wa", " ") == 0)) & (F.levenshtein(F.col("ra"), turned("wb"), radius) >= 0))
    )
    return met.where(F.when(may, near).otherwise(False)).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of a graph of (a, b): every node with the smallest one it is connected with.

    Alternating large and small stars, each a join and an aggregation over the edges, until every edge leads to a node that
    leads nowhere else. Nothing is collected but whether that is so. The edges are written to the checkpoint folder after each
    round, as each reads the last one several times.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        # A node that has an edge down, and another edge down or one from above: not a star yet.
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if not ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 and down > 0").head(1):
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _node(kind: str, *parts: Column) -> Column:
    """A node of a graph that isn't a name: a kind and texts, null where one of them is."""
    out = F.lit("\x01" + kind)
    for p in parts:
        out = F.concat(out, F.lit("\x01"), p)
    return out


def _parts_of_families(placed: DataFrame) -> DataFrame:
    """(fact, part): which organisation of its family a profile belongs to, by the first of its facts; only families of several lines of business.

    ``placed``: (family, fact, business, place, site). Profiles of one line of business belong together, as do those of one country or website.
    A group without business joins the only one that doesn't contradict it, or the largest where it states no country either.
    Joins and aggregations of distinct profiles only: no family comes together in one row.
    """
    several = cut(placed.groupBy("family").agg(differ("business").alias("several")).where("several").select("family"))
    profiles = cut(placed.join(several, "family", "left_semi").groupBy("family", "fact", "business", "place", "site").agg(F.count("*").alias("n")))
    stated = profiles.select("fact", F.explode(F.filter(F.array(_node("s", F.col("family"), F.col("site")), _node("p", F.col("family"), F.col("place"))), lambda x: x.isNotNull())).alias("b"))
    # A line of business that is part of another one: they share the former's first word.
    lines = profiles.where("business is not null").select("family", "fact", F.split("business", " ").alias("words")).distinct()
    within = lines.select("family", F.col("fact").alias("a"), F.col("words").alias("wa"), F.get("words", F.lit(0)).alias("w")).join(lines.select("family", F.col("fact").alias("b"), F.col("words").alias("wb"), F.explode("words").alias("w")), ["family", "w"])
    within = within.where((F.size("wa") < F.size("wb")) & (F.size(F.array_except("wa", "wb")) == 0)).select("a", "b")
    joined = components(stated.select(F.col("fact").alias("a"), "b").unionByName(within))
    grouped = cut(profiles.join(joined, F.col("fact") == F.col("node"), "left").select("family", "fact", F.coalesce("component", "fact").alias("part"), "business", "place", "n"))
    parts = grouped.groupBy("family", "part").agg(F.max(F.col("business").isNotNull()).alias("lined"), F.max(F.col("place").isNotNull()).alias("placed"), F.sum("n").alias("n"))
    lined = parts.where("lined").groupBy("family").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.sum((~F.col("placed")).cast("int")).alias("open"), F.min(F.when(~F.col("placed"), F.col("part"))).alias("only"))
    home = F.when(F.col("lined"), F.col("part")).when(~F.col("placed"), F.col("largest")).when(F.col("open") == 1, F.col("only")).otherwise(F.col("part"))
    resolved = parts.join(lined, "family").select("family", "part", home.alias("home"))
    return cut(grouped.select("family", "fact", "part").distinct().join(resolved, ["family", "part"]).select("fact", F.col("home").alias("part")))


def entities(rows: DataFrame) -> DataFrame:
    """(id, norm, entity) of every row that names an organisation; ``norm`` is its ``organization`` in normal form."""
    named = cut(_described(rows))
    # The words of the first core, where they are known, tell more than the core itself.
    spelt = F.when(F.col("words").isNull(), F.col("cores")).otherwise(F.concat(F.array("words"), F.slice("cores", F.lit(2), F.size("cores"))))
    names = named.select(F.explode(spelt).alias("words")).groupBy(F.translate("words", " ", "").alias("core")).agg(F.max_by("words", F.struct(F.size(F.split("words", " ")), F.col("words"))).alias("words"))
    near = cut(radius_links(cut(names.where(F.length("core") >= SHORT - 1).select("words"))))
    sure = near.where(F.least(F.length("a"), F.length("b")) >= LEAST)
    # Of short names one edit only, and only where rows of both say something else alike.
    hints = (("b", "business"), ("s", "site"), ("p", "place"))
    facts = named.select(F.explode("cores").alias("core"), *(c for _, c in hints)).where(F.length("core").between(SHORT - 1, LEAST)).select("core", F.explode(F.filter(F.array(*(F.concat(F.lit(k), F.col(c)) for k, c in hints)), lambda x: x.isNotNull())).alias("fact")).distinct()
    doubtful = near.where((F.least(F.length("a"), F.length("b")) < LEAST) & (F.greatest(F.length("a"), F.length("b")) >= SHORT) & (F.levenshtein("a", "b", 1) >= 0))
    confirmed = doubtful.join(facts.select(F.col("core").alias("a"), "fact"), "a").join(facts.select(F.col("core").alias("b"), "fact"), ["b", "fact"]).select("a", "b").distinct()
    head = F.coalesce(F.get("cores", F.lit(0)), _node("h", F.get("hints", F.lit(0))))
    rowed = named.where(F.size("cores") > 1).select(head.alias("a"), F.explode("cores").alias("b")).where("a <> b").distinct()
    # A hint that names share is a node that links them; most hints belong to one name only and link nothing.
    hinted = named.select(head.alias("a"), F.explode("hints").alias("h"))
    shared = cut(hinted.groupBy("h").agg(differ("a").alias("shared")).where("shared").select("h"))
    family = components(sure.unionByName(confirmed).unionByName(rowed).unionByName(hinted.join(shared, "h").select("a", _node("h", F.col("h")).alias("b"))))
    fact = F.coalesce(_node("b", F.col("family"), F.col("business")), _node("s", F.col("family"), F.col("site")), _node("p", F.col("family"), F.col("place")), _node("", F.col("family")))
    placed = named.select("id", "norm", head.alias("node"), "business", "place", "site").join(family, "node", "left").withColumn("family", F.coalesce("component", "node"))
    placed = cut(placed.select("id", "norm", "family", "business", "place", "site")).withColumn("fact", fact)
    return placed.join(_parts_of_families(placed.drop("id", "norm")), "fact", "left").select("id", "norm", F.coalesce("part", "family").alias("entity"))


def named_entities(rows: DataFrame) -> DataFrame:
    """(id, entity, spellings, rows): the organisation that each row names, how many ways it is spelt and how many rows name it.

    ``entity`` is a 128-bit digest. One row for each row that names an organisation; no pairs.
    """
    found = cut(entities(rows))
    counted = found.groupBy("entity").agg(F.count_distinct("norm").alias("spellings"), F.count("*").alias("rows"))
    return found.join(counted, "entity").select("id", F.md5(F.col("entity").cast("binary")).alias("entity"), "spellings", "rows")


def variant_pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows about one organisation whose ``organization`` differs in normal form; null differs from all.

    The rows of an organisation are spread over blocks of some ``block`` rows, and each two of its blocks meet in a task of
    their own, so that one with a third of all rows is as many tasks as its pairs take.
    """
    found = entities(rows)
    counted = found.groupBy("entity").agg(F.count("*").alias("n"), differ("norm").alias("differ"), F.count("norm").alias("k"))
    several = counted.where("n > 1 and (differ or k < n)").select("entity", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    many = found.join(several, "entity").select("entity", "id", "norm", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    a = many.select("entity", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("id").alias("ia"), F.col("norm").alias("na"))
    b = many.select("entity", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("id").alias("ib"), F.col("norm").alias("nb"))
    apart = F.col("na").isNull() | F.col("nb").isNull() | (F.col("na") != F.col("nb"))
    once = (F.col("ia") < F.col("ib")) | ((F.col("i") < F.col("j")) & (F.col("ia") != F.col("ib")))
    return a.join(b, ["entity", "i", "j"]).where(once & apart).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
