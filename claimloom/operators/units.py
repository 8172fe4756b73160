"""Quantities written in different units and scales to common units.

A grammar over tokens reads each text: numbers (digit groups, decimal marks, exponents, words, fractions), scale words
(thousand, Mio., lakh, 万, dozen ...), unit words with their prefixes, and clock notations. A unit is a vector of exponents
over the base dimensions (data, count, time), a scale, and an offset to the canonical unit (byte, item, second); a product of
parts adds vectors and multiplies scales, a rate subtracts and divides, so that 10 MB/s is no amount of data. Quantities of the wanted dimension that stand side by side add up.
Arithmetic is exact (``fractions.Fraction``), so no rounding happens before the last step, half up.

The texts are parsed in Arrow batches by ``mapInPandas``: the grammar is recursive and needs whole texts, which built-in
expressions can't do; only the texts and their conventions cross to Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.timestamps import conventions

DATA, COUNT, TIME, NONE = (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)
# Words that make a rate of two units.
_PER = ("/", "per", "pro", "par", "por", "al", "в", "毎")


@dataclass(frozen=True)
class Unit:
    """value_in_canonical = value * scale + offset; ``dim``: exponents of (data, count, time). Products and rates have no offset."""

    dim: tuple[int, int, int]
    scale: Fraction
    offset: Fraction = Fraction(0)

    def __mul__(self, other: Unit) -> Unit:
        return Unit(tuple(a + b for a, b in zip(self.dim, other.dim, strict=True)), self.scale * other.scale, other.offset if self.dim == NONE else Fraction(0))

    def __truediv__(self, other: Unit) -> Unit:
        return Unit(tuple(a - b for a, b in zip(self.dim, other.dim, strict=True)), self.scale / other.scale)


# Prefixes by power of 1000 (decimal) and of 1024 (binary), with their Cyrillic letters.
_DEC = {"k": 1, "m": 2, "g": 3, "t": 4, "p": 5, "e": 6, "к": 1, "м": 2, "г": 3, "т": 4, "п": 5}
_DEC_WORD = {"kilo": 1, "mega": 2, "giga": 3, "tera": 4, "peta": 5, "exa": 6, "кило": 1, "мега": 2, "гига": 3, "тера": 4, "пета": 5, "téra": 4, "péta": 5, "méga": 2}
_BIN_WORD = {"kibi": 1, "mebi": 2, "gibi": 3, "tebi": 4, "pebi": 5, "exbi": 6}
# Names of a byte, of a bit, of things that are counted, and of lengths of time in seconds.
_BYTE = ("byte", "bytes", "octet", "octets", "octeto", "octetos", "байт", "байта", "байтов", "バイト", "字节")
_BIT = ("bit", "bits", "бит", "бита", "битов", "ビット")
_THINGS = (
    "file files doc docs document documents record records item items folder folders object objects entry entries image images photo photos email emails mails "
    "datei dateien dokument dokumente datensatz datensätze fichier fichiers archivo archivos documento documentos registro registros elemento elementos "
    "file documenti ficheiro ficheiros arquivo arquivos bestand bestanden plik pliki plików файл файла файлов документ документов ファイル 件 個 文件 个"
).split()
_SECONDS = {
    1: "s sec secs second seconds sekunde sekunden seconde secondes segundo segundos secondi secondo секунда секунды секунд сек 秒",
    60: "m min mins minute minutes minuten minuto minutos minuti минута минуты минут мин 分 分間",
    3600: "h hr hrs hour hours stunde stunden std heure heures hora horas ora ore час часа часов ч 時間",
    86400: "d day days tag tage tagen jour jours día días dia dias giorno giorni день дня дней дн 日 日間",
    604800: "w wk wks week weeks woche wochen semaine semaines semana semanas settimana settimane неделя недели недель 週 週間",
}
# Scale words, and numbers as words (English, with the German and French articles).
_SCALES = {
    **dict.fromkeys("k thousand thousands tsd tausend mille mil тыс 千".split(), 1000),
    **dict.fromkeys("m mn mio mln million millions millionen millón millones milioni milhões млн".split(), 10**6),
    **dict.fromkeys("bn mrd bln billion billions milliarde milliarden milliard milliards млрд".split(), 10**9),
    "万": 10**4, "萬": 10**4, "億": 10**8, "亿": 10**8, "lakh": 10**5, "lakhs": 10**5, "lac": 10**5, "crore": 10**7, "crores": 10**7,
    "dozen": 12, "dozens": 12, "dutzend": 12, "hundred": 100, "hundreds": 100, "百": 100, "score": 20, "gross": 144,
}
_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {
    w: 10 * (i + 2) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())
}
_FRACTIONS = {"half": Fraction(1, 2), "quarter": Fraction(1, 4), "quarters": Fraction(1, 4), "third": Fraction(1, 3), "thirds": Fraction(1, 3)}
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")


def _units() -> tuple[dict[str, Unit], dict[str, Unit]]:
    """(any case, exact case) tables of unit words. KB, MB ... are powers of 1000 in any case; only the word bit means bits."""
    table: dict[str, Unit] = {}
    for size, names in ((Fraction(1), _BYTE), (Fraction(1, 8), _BIT)):
        for n in names:
            table[n] = Unit(DATA, size)
            for words, base in ((_DEC_WORD, 1000), (_BIN_WORD, 1024)):
                for w, k in words.items():
                    table[w + n] = Unit(DATA, size * base**k)
    for letter, k in _DEC.items():
        table |= {letter + x: Unit(DATA, Fraction(1000**k)) for x in ("b", "o", "б", "byte", "bytes")}
        table |= {letter + x: Unit(DATA, Fraction(1000**k, 8)) for x in ("bit", "bits", "бит")}
        table |= {letter + "i" + x: Unit(DATA, Fraction(1024**k)) for x in ("b", "o", "byte", "bytes")}
        table |= {letter + "ibit" + x: Unit(DATA, Fraction(1024**k, 8)) for x in ("", "s")}
    for w, k in (("kilos", 1), ("megas", 2), ("gigas", 3), ("teras", 4), ("megs", 2), ("meg", 2), ("gig", 3), ("gigs", 3), ("g", 3), ("t", 4), ("tera", 4), ("giga", 3), ("mega", 2)):
        table[w] = Unit(DATA, Fraction(1000**k))
    table |= {"b": Unit(DATA, Fraction(1)), "o": Unit(DATA, Fraction(1)), "б": Unit(DATA, Fraction(1))}
    table |= {w: Unit(COUNT, Fraction(1)) for w in _THINGS}
    time = {w: Unit(TIME, Fraction(s)) for s, words in _SECONDS.items() for w in words.split()}
    return table, time


UNITS, TIMES = _units()
_BY_DIM = {DATA: UNITS, COUNT: {k: v for k, v in UNITS.items() if v.dim == COUNT}, TIME: TIMES}

_TOKEN = re.compile(
    r"(?P<iso>\bP(?:\d+[.,]?\d*[WD])*(?:T(?:\d+[.,]?\d*[HMS])+)?(?![A-Za-z0-9]))"
    r"|(?P<clock>\d{1,3}:[0-5]\d(?::[0-5]\d)?(?![\d:]))"
    r"|(?P<num>\d+(?:[.,'’ ]\d+)*)"
    r"|(?P<cjk>[万萬億亿千百]|ファイル|バイト|ビット|時間|日間|分間|週間|字节|文件|[件個个秒分日週])"
    r"|(?P<word>[^\W\d_]+)"
    r"|(?P<sym>\S)"
)
_GROUPED = {m: re.compile(rf"\d{{1,3}}(?:[{re.escape(g)}'’ ]\d{{3}})+(?:{re.escape(m)}\d+)?$|\d+(?:{re.escape(m)}\d+)?$") for m, g in ((".", ","), (",", "."))}
_NUMBER_LIKE = re.compile(r"\d+(?:[.,]\d+)*(?:['’ ]\d{3}(?!\d))*(?:[.,]\d+)*")


def read_number(digits: str, mark: str) -> Fraction | None:
    """Digits under a decimal mark; the other mark, apostrophes and spaces can only group by threes, else there is no number."""
    if not _GROUPED[mark].match(digits):
        return None
    return Fraction(re.sub(rf"[^\d{re.escape(mark)}]", "", digits).replace(mark, "."))


def _tokens(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    at = 0
    while m := _TOKEN.search(text, at):
        kind, value = m.lastgroup, m.group()
        if kind == "num":  # spaces and apostrophes belong to a number only where three digits follow each
            value = _NUMBER_LIKE.match(value).group()
            out.append(("num", value))
            at = m.start() + len(value)
            continue
        if kind == "iso" and value in ("P", ""):
            kind = "word"
        out.append((kind, value))
        at = m.end()
    return out


class Parser:
    """One text under one source's conventions. ``bare``: the unit of a number without one, or None."""

    def __init__(self, text: str, mark: str, dim: tuple[int, int, int], bare: Unit | None):
        self.t, self.i, self.mark, self.dim, self.bare = _tokens(text), 0, mark, dim, bare
        self.table = _BY_DIM[dim]

    def word(self, k: int = 0) -> str:
        j = self.i + k
        return self.t[j][1].casefold() if j < len(self.t) and self.t[j][0] in ("word", "cjk") else ""

    def sym(self, k: int = 0) -> str:
        j = self.i + k
        return self.t[j][1] if j < len(self.t) and self.t[j][0] in ("sym", "word", "num") else ""

    def number(self) -> Fraction | None:
        """number := digits [exponent] | words; followed by any scale words."""
        start = self.i
        value = self.digits() if self.i < len(self.t) and self.t[self.i][0] == "num" else self.words()
        if value is None:
            self.i = start
            return None
        return value

    def digits(self) -> Fraction | None:
        value = read_number(self.t[self.i][1], self.mark)
        self.i += 1
        if value is None:
            return None
        if self.word() == "e" and self.t[self.i + 1 : self.i + 2] and self.t[self.i + 1][0] == "num" and self.t[self.i + 1][1].isdigit():
            value *= 10 ** min(int(self.t[self.i + 1][1]), 40)
            self.i += 2
        elif self.sym() in ("x", "X", "×", "*", "·") and self.sym(1) == "10":
            power = None
            if self.sym(2) == "^" and self.sym(3).isdigit():
                power, n = int(self.sym(3)), 4
            elif self.sym(2) and self.sym(2)[0] in "⁰¹²³⁴⁵⁶⁷⁸⁹":
                power, n = int(self.sym(2).translate(_SUPER)), 3
            if power is not None:
                value *= 10 ** min(power, 40)
                self.i += n
        return value

    def words(self) -> Fraction | None:
        """words := article? (cardinal | fraction "of"? article?) ("and" article? fraction)?"""
        w = self.word()
        if w in ("a", "an") and (self.word(1) in _SCALES or self.word(1) in _FRACTIONS):
            self.i += 1
            w = self.word()
            if w in _SCALES:
                return Fraction(1)
        if w in _FRACTIONS:
            value = _FRACTIONS[w]
            self.i += 1
            if self.word() == "of":
                self.i += 1
            if self.word() in ("a", "an"):
                self.i += 1
            return value
        if w in ("a", "an", "one") and self.word(1) in self.table and len(self.word(1)) > 1:
            self.i += 1
            return Fraction(1)
        total, seen = Fraction(0), False
        while (w := self.word()) in _WORDS or (seen and w == "hundred") or (seen and w == "and" and self.word(1) in _WORDS) or (seen and self.t[self.i : self.i + 1] and self.t[self.i][1] == "-" and self.word(1) in _WORDS):
            if w in _WORDS:
                total += _WORDS[w]
            elif w == "hundred":
                total *= 100
            seen = True
            self.i += 1
        if not seen:
            return None
        if self.word() == "and" and self.word(1) in ("a", "an") and self.word(2) in _FRACTIONS:
            total += _FRACTIONS[self.word(2)]
            self.i += 3
        elif self.word() in _FRACTIONS and self.word(1) in ("of", "a", "an"):
            total *= _FRACTIONS[self.word()]
            self.i += 1 + (self.word(1) == "of") + (self.word(2) in ("a", "an"))
        return total

    def unit(self) -> Unit | None:
        """unit := scale* name (per name)?; ``mega bytes`` and ``mega-bytes`` are one name. A rate has another dimension than what it is the rate of."""
        start, scale = self.i, Unit(NONE, Fraction(1))
        while True:
            w = self.word()
            joined = w + self.word(1)
            if w and self.word(1) and joined in self.table and len(w) > 1 and w not in ("min",):
                self.i += 2
                return self.rate(scale * self.table[joined])
            # "K" or "M" before a unit, or where things are counted, is a scale; "M" alone after a size is not a unit.
            if w in _SCALES and not (w in self.table and self.dim != COUNT and not (self.dim == DATA and w in ("m", "k") and self.word(1) in self.table)):
                scale *= Unit(NONE, Fraction(_SCALES[w]))
                self.i += 1
                if self.i < len(self.t) and self.t[self.i][1] == ".":
                    self.i += 1
                continue
            if w in self.table:
                self.i += 1
                return self.rate(scale * self.table[w])
            if scale.scale != 1:
                return scale
            self.i = start
            return None

    def rate(self, u: Unit) -> Unit:
        """``u``, or what it is per unit of time where one follows."""
        per = self.sym() or self.word()
        if per.casefold() in _PER and u.dim != TIME and self.word(1) in TIMES and len(self.word(1)) > (per != "/"):
            self.i += 2
            return u / TIMES[self.t[self.i - 1][1].casefold()]
        return u

    def quantities(self) -> list[tuple[Fraction, int, int, bool]]:
        """(value in the canonical unit, first token, token after, whether the unit was written)."""
        found: list[tuple[Fraction, int, int, bool]] = []
        while self.i < len(self.t):
            start, (kind, text) = self.i, self.t[self.i]
            if kind == "iso" and self.dim == TIME:
                self.i += 1
                found.append((_iso_duration(text), start, self.i, True))
                continue
            if kind == "clock":
                self.i += 1
                if self.dim == TIME:
                    h, m, s = (*map(int, text.split(":")), 0)[:3]
                    found.append((Fraction(h * 3600 + m * 60 + s), start, self.i, True))
                continue
            value = self.number()
            if value is None:
                self.i = max(self.i, start + 1) if self.i == start else self.i
                continue
            u = self.unit()
            if u is None or u.dim == NONE:
                bare = self.bare
                if bare is None:
                    continue
                found.append((value * (u.scale if u else 1) * bare.scale + bare.offset, start, self.i, False))
            elif u.dim == self.dim:
                found.append((value * u.scale + u.offset, start, self.i, True))
        return found

    def joins(self, a: int, b: int) -> bool:
        """Whether the tokens from a to b only connect two parts of one quantity."""
        return all(x[1].casefold() in (",", "+", "and", "und", "et", "y", "e", "&", "и", ".") for x in self.t[a:b])


def _iso_duration(text: str) -> Fraction:
    date, _, clock = text[1:].partition("T")
    total = Fraction(0)
    for part, scales in ((date, {"W": 604800, "D": 86400}), (clock, {"H": 3600, "M": 60, "S": 1})):
        for n, u in re.findall(r"(\d+(?:[.,]\d+)?)([A-Z])", part):
            total += Fraction(n.replace(",", ".")) * scales[u]
    return total


# Dates, which are no lengths of time.
_DATE = re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|(?i:\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}|\b\d{1,2}(?:st|nd|rd|th|\.)?\s+(?:de\s+)?[^\W\d_]{3,}\.?\s+(?:de\s+)?\d{4}\b)")
# Words of a sentence that says that data were taken, and of one about the equipment or trade of the firm.
_TAKEN = re.compile(
    r"(?i)\b(?:claims? to (?:hold|have)|hold(?:s|ing)?|stole[n]?|steal|taken|took|left the network|exfiltrat\w*|download\w*|copied|leak\w*|announced|published|obtained|grabbed|extract\w*|dump(?:ed)?|"
    r"volume|amount|in total|total|internal files|data\b.*\bpublished|robad[oa]s?|anuncian|sustra\w+|entwendet\w*|gestohlen\w*|kopiert\w*|volés?|dérob\w+|exfiltr\w+|copiés?|rubat[io]|roubad\w+|украден\w*|похищен\w*|скопирован\w*)"
    r"|盗|窃取|流出"
)
_OTHER = re.compile(r"(?i)\b(?:drives?|disks?|storage|array|mail ?boxes?|limited|lines?|sells?|sold|keeps?|servers? with|capacity|bandwidth|internet|plan|ram|memory|employs?|sites?|revenue|uploads? of up to|quota)\b")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+(?=\S)|\n+|(?<=[。！？])")
_ABBREVIATION = re.compile(r"(?i)(?:\b(?:ca|approx|tsd|mio|mrd|mln|bzw|inc|ltd|co|corp|no|nr|st|dr|vol)|\b[^\W\d_])\.$")


def sentences(text: str) -> list[str]:
    out: list[str] = []
    for s in _SENTENCE.split(text):
        if out and _ABBREVIATION.search(out[-1]):
            out[-1] += " " + s
        elif s:
            out.append(s)
    return out


def _rounded(x: Fraction) -> int | None:
    n = (x * 2 + 1).__floor__() // 2
    return n if n < 2**63 else None


def _clean(text: str) -> str:
    return unicodedata.normalize("NFKC", re.sub(r"([⁰¹²³⁴⁵⁶⁷⁸⁹]+)", lambda m: "^" + m.group(), text)).replace("\u2212", "-").strip()


def _combined(p: Parser) -> Fraction | None:
    """The first quantity and those that follow it side by side; quantities whose unit was written come before bare numbers."""
    q = p.quantities()
    if any(x[3] for x in q):
        q = [x for x in q if x[3]]
    if not q:
        return None
    total, end = q[0][0], q[0][2]
    for value, a, b, written in q[1:]:
        if not written or not p.joins(end, a):
            break
        total, end = total + value, b
    return total


def data_bytes(text: str, mark: str = ".", bare_unit: str | None = None) -> int | None:
    """Bytes stated by a size text; null where it states no number, or a bare one for a source of unknown unit."""
    u = UNITS.get((bare_unit or "").strip().casefold())
    value = _combined(Parser(_clean(text), mark, DATA, u if u and u.dim == DATA else None))
    return None if value is None else _rounded(value)


def file_count(text: str, mark: str = ".") -> int | None:
    value = _combined(Parser(_clean(text), mark, COUNT, Unit(COUNT, Fraction(1))))
    return None if value is None else _rounded(value)


def countdown_seconds(text: str, mark: str = ".") -> int | None:
    """Seconds of a length of time; null for dates and for numbers without a unit of time."""
    text = _clean(text)
    if _DATE.search(text):
        return None
    value = _combined(Parser(text, mark, TIME, None))
    return None if value is None else _rounded(value)


def described_bytes(text: str, mark: str = ".") -> int | None:
    """Bytes that a description says were taken: the first size in a sentence about data taken that isn't about equipment."""
    for s in sentences(_clean(text)):
        if _TAKEN.search(s) and not _OTHER.search(s):
            value = _combined(Parser(s, mark, DATA, None))
            if value is not None:
                return _rounded(value)
    return None


_READERS = {"file_count": file_count, "countdown_seconds": countdown_seconds, "described": described_bytes}


def read_quantities(details: DataFrame, conventions_table: DataFrame) -> DataFrame:
    """(id, quantity, amount): whole bytes, files and seconds stated in ``details.claim_details``, one row per row and quantity.

    ``details``: id, source_id, claim_details; more columns are ignored. Null maps, null, blank and stand-in values, and
    values without a number give no row; amounts beyond a long give none. Sources without conventions use ``.`` and have no
    unit for bare sizes. Repeated rows give repeated results; an empty input gives an empty result.
    """
    d = F.col("claim_details")
    keyed = F.map_contains_key(d, "claimed_data_size")
    texts = F.array(
        F.struct(F.lit("data_bytes").alias("q"), F.try_element_at(d, F.lit("claimed_data_size")).alias("t")),
        F.struct(F.lit("described").alias("q"), F.when(~keyed, F.try_element_at(d, F.lit("description"))).alias("t")),
        F.struct(F.lit("file_count").alias("q"), F.try_element_at(d, F.lit("file_count")).alias("t")),
        F.struct(F.lit("countdown_seconds").alias("q"), F.try_element_at(d, F.lit("deadline")).alias("t")),
    )
    long = (
        details.where(F.size(d) > 0)
        .select("id", F.lower(F.trim("source_id")).alias("__src"), F.explode(texts).alias("__e"))
        .select("id", "__src", F.col("__e.q").alias("quantity"), F.col("__e.t").alias("text"))
        .where(F.length(F.trim("text")) > 0)
        .join(conventions(conventions_table), F.col("__src") == F.col("__sid"), "left")
        .select("id", "quantity", "text", F.when(F.col("__mark") == ",", ",").otherwise(".").alias("mark"), F.col("__unit").alias("unit"))
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, int | None] = {}  # texts repeat, as copies of a listing do

        def amount(q: str, t: str, m: str, u: str | None) -> int | None:
            k = (q, t, m, u)
            if k not in known:
                if len(known) > 100_000:
                    known.clear()
                known[k] = data_bytes(t, m, u) if q == "data_bytes" else _READERS[q](t, m)
            return known[k]

        for b in batches:
            amounts = [amount(*k) for k in zip(b["quantity"], b["text"], b["mark"], b["unit"], strict=True)]
            keep = [i for i, a in enumerate(amounts) if a is not None]
            yield pd.DataFrame({"id": b["id"].iloc[keep], "quantity": b["quantity"].iloc[keep].replace("described", "data_bytes"), "amount": pd.array([amounts[i] for i in keep], dtype="int64")})

    return long.mapInPandas(parse, "id string, quantity string, amount long")
