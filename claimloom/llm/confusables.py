"""Visually identical texts to one clean form.

Each text is normalised for compatibility, freed of characters without a visible shape, and its white space made single
plain spaces. Then each word that mixes scripts, or consists of look-alikes only, becomes a lattice: at every character the
letters of any script that look like it. Viterbi finds the best path under character bigrams learned from the words of the
table that are written in one script, with a cost for each substitution and a larger one for each change of script, so the
letters that have no twin decide which script the word is in, and among several twins the likelier one is taken.

Defined cases: null gives null; a text of ignorable characters and spaces only becomes the empty string; texts of any length
are handled whole, word by word; equal texts give equal results; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that look like the Latin letter before the colon; from the scripts named, and phonetic letters.
LOOKALIKES = """
a: а α ɑ     c: с     d: ԁ     e: е     g: ɡ ց     h: һ հ     i: і ι ɩ     j: ј ϳ     k: κ к     l: ӏ     n: ո     o: о ο օ     p: р ρ
q: ԛ     s: ѕ     u: υ ս     v: ν ѵ     w: ԝ     x: х χ     y: у γ ү     t: τ     b: Ь
A: А Α Ꭺ     B: В Β Ᏼ     C: С Ꮯ     D: Ꭰ     E: Е Ε Ꭼ     G: Ԍ Ꮐ     H: Н Η Ꮋ     I: І Ι Ӏ     J: Ј Ꭻ     K: К Κ Ꮶ     L: Ꮮ     M: М Μ Ꮇ
N: Ν     O: О Ο Օ     P: Р Ρ Ꮲ     Q: Ԛ     R: Ꭱ     S: Ѕ Ꮪ Տ     T: Т Τ Ꭲ     U: Ս     V: Ѵ Ꮩ     W: Ԝ Ꮃ     X: Х Χ     Y: У Υ Ү     Z: Ζ Ꮓ
"""
#: Letters that are variants within their own script, replaced whatever the word.
PHONETIC = {"ɑ": "a", "ɡ": "g", "ɩ": "i"}
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE")
SUBSTITUTION, SWITCH, UNSEEN = 0.5, 40.0, -9.0


def _twins() -> dict[str, tuple[str, ...]]:
    """Each letter with all letters of its look-alike group, itself first."""
    out: dict[str, tuple[str, ...]] = {}
    for latin, others in re.findall(r"(\S): ((?:\S )*\S)(?=\s{2,}|\n)", LOOKALIKES + "\n"):
        group = [latin, *others.split()]
        for x in group:
            out[x] = tuple(dict.fromkeys([x, *group, *out.get(x, ())]))
    return out


@lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    """The script of a letter that the lattice knows, ``other`` for other letters, "" for what isn't a letter."""
    if unicodedata.category(ch)[0] != "L":
        return ""
    name = unicodedata.name(ch, "").split(" ", 1)[0]
    return name if name in SCRIPTS else "other"


TWINS = _twins()
_FILLERS = set("͏ᅟᅠ឴឵᠋᠌᠍᠎᠏⠀ㅤﾠ")


@lru_cache(maxsize=1 << 16)
def ignorable(ch: str) -> bool:
    """Whether a character has no visible shape and isn't white space."""
    cat = unicodedata.category(ch)
    return (cat in ("Cf", "Cc") and not ch.isspace() and ch not in "\x1c\x1d\x1e\x1f\x85") or ch in _FILLERS or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef"


def _any_ignorable() -> re.Pattern:
    """One search that tells whether a text holds an ignorable character, or one beyond the basic plane, which are looked at singly."""
    spots = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and ignorable(chr(c))]
    return re.compile("[" + "".join(re.escape(chr(c)) for c in spots) + "\U00010000-\U0010ffff]")


_IGNORABLE = _any_ignorable()


#: Phonetic letters, and the scripts beside Latin that the lattice knows; texts without one have nothing to replace.
_LATTICED = re.compile("[\u0250-\u02af\u0370-\u03ff\u0400-\u058f\u13a0-\u13ff\u1c80-\u1c8f\u1d00-\u1dbf\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f\uab30-\uabbf]")


def _visible(text: str) -> str:
    if not _IGNORABLE.search(text):
        return text
    out = []
    flag = False
    for ch in text:
        tag = "\U000e0020" <= ch <= "\U000e007f"  # the letters of a regional flag belong to it
        flag = ch == "\U0001f3f4" or (flag and tag)
        if (tag and flag) or not ignorable(ch):
            out.append(ch)
    return "".join(out)


def compatible(text: str) -> str:
    """Compatibility form, accents composed, ignorable characters deleted, single plain spaces between words."""
    if text.isascii() and text.isprintable():
        return " ".join(text.split())
    text = _visible(unicodedata.normalize("NFKC", _visible(text)))
    return " ".join(unicodedata.normalize("NFC", text).split())


class Cleaner:
    """The clean form under a bigram model: ``counts`` maps (previous letter or "^", letter) to its number of occurrences."""

    def __init__(self, counts: dict[tuple[str, str], int] | None = None):
        totals: dict[str, int] = {}
        for (a, _), n in (counts or {}).items():
            totals[a] = totals.get(a, 0) + n
        self.scores = {k: math.log((n + 0.1) / (totals[k[0]] + 50.0)) for k, n in (counts or {}).items()}
        self.cache: dict[tuple[str, str], str] = {}

    def __call__(self, text: str) -> str:
        text = compatible(text)
        if text.isascii() or not _LATTICED.search(text):
            return text
        words = text.split(" ")
        context = self._context(words)
        return " ".join(w if w.isascii() and context in ("", "LATIN") else self._word(w, context) for w in words)

    @staticmethod
    def _context(words: list[str]) -> str:
        """The script of most letters that have no twin elsewhere, or of most letters where all have one; "" without letters."""
        seen: dict[str, int] = {}
        any_: dict[str, int] = {}
        for w in words:
            for ch in unicodedata.normalize("NFD", w):
                s = script(ch)
                if s and s != "other":
                    any_[s] = any_.get(s, 0) + 1
                    if ch not in TWINS:
                        seen[s] = seen.get(s, 0) + 1
        seen = seen or any_
        return max(sorted(seen), key=seen.get) if seen else ""

    def _word(self, word: str, context: str) -> str:
        hit = self.cache.get((word, context))
        if hit is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            hit = self.cache[word, context] = self._search(word, context)
        return hit

    def _search(self, word: str, context: str) -> str:
        marked = unicodedata.normalize("NFD", word)
        if marked != word and unicodedata.normalize("NFC", marked) != word:
            marked = word
        chars = [PHONETIC.get(c, c) for c in marked]
        scripts = {s for c in chars if (s := script(c))} - {"other"}
        certain = {script(c) for c in chars if script(c) not in ("", "other") and c not in TWINS}
        if len(scripts) <= 1 and (certain or not scripts or context == "" or scripts == {context}):
            return unicodedata.normalize("NFC", "".join(chars))
        best = self._viterbi(chars, context if not certain else "")
        return unicodedata.normalize("NFC", "".join(best))

    def _viterbi(self, chars: list[str], context: str) -> list[str]:
        # A state is a letter and the script of the path so far; marks and other characters keep the path's letter.
        states: dict[tuple[str, str], tuple[float, tuple]] = {("^", ""): (0.0, ())}
        for ch in chars:
            own = script(ch)
            if not own or own == "other":
                states = {k: (v, (ch, path)) for k, (v, path) in states.items()} if unicodedata.category(ch)[0] == "M" or own == "other" else self._boundary(states, ch)
                continue
            new: dict[tuple[str, str], tuple[float, tuple]] = {}
            for c in TWINS.get(ch, (ch,)):
                if c in PHONETIC:
                    continue
                s = script(c)
                cost = 0.0 if c == ch else SUBSTITUTION
                if context:
                    cost += 0.0 if s == context else SWITCH / 4
                for (prev, ps), (v, path) in states.items():
                    w = v - cost - (SWITCH if ps and ps != s else 0.0) + (self.scores.get((prev, c.lower()), UNSEEN) if self.scores else 0.0)
                    key = (c.lower(), s)
                    if key not in new or w > new[key][0] or (w == new[key][0] and c == ch):
                        new[key] = (w, (c, path))
            states = new
        path = max(states.items(), key=lambda kv: (kv[1][0], kv[0]))[1][1]
        out: list[str] = []
        while path:
            out.append(path[0])
            path = path[1]
        return out[::-1]

    @staticmethod
    def _boundary(states: dict, ch: str) -> dict:
        """After a hyphen, digit or the like a new run of letters begins, in the same word and so in the same script."""
        new: dict[tuple[str, str], tuple[float, tuple]] = {}
        for (_, s), (v, path) in states.items():
            if ("^", s) not in new or v > new["^", s][0]:
                new["^", s] = (v, (ch, path))
        return new


def _pairs(text: str, scripts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous letters, letters, counts) of the words of a text that are in one alphabet; 94 stands for a word's start.

    ``scripts``: the script of each code point as a number, 0 for what isn't a letter and negative where it isn't known yet.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for c in np.unique(codes[scripts[codes] < 0]):
        s = script(chr(c))
        scripts[c] = SCRIPTS.index(s) + 1 if s in SCRIPTS else len(SCRIPTS) + 1 if s else 0
    kinds = scripts[codes]
    starts = np.flatnonzero((kinds > 0) & (np.concatenate(([0], kinds[:-1])) == 0))
    ends = np.flatnonzero((kinds > 0) & (np.concatenate((kinds[1:], [0])) == 0)) + 1
    if not len(starts):
        return np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.int64)
    bounds = np.stack((starts, ends), axis=1).ravel()
    bounds = bounds[:-1] if bounds[-1] == len(codes) else bounds
    least, most = np.minimum.reduceat(kinds, bounds)[::2], np.maximum.reduceat(kinds, bounds)[::2]
    good = (least == most) & (least <= len(SCRIPTS)) & (ends - starts >= 2)
    inside = np.zeros(len(codes) + 1, dtype=np.int32)
    inside[starts[good]] += 1
    inside[ends[good]] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    first = np.zeros(len(codes), dtype=bool)
    first[starts[good]] = True
    before = np.where(first[at], np.uint32(94), codes[at - 1])
    both, counts = np.unique(before.astype(np.uint64) << np.uint64(32) | codes[at], return_counts=True)
    return (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32), counts


def letter_bigrams(texts: DataFrame, columns: Iterable[str]) -> dict[tuple[str, str], int]:
    """Counts of letter bigrams, word starts included, over all words of the columns that are in one alphabet of SCRIPTS.

    Each batch of rows counts its own in arrays; their sums are what leaves it. What reaches the driver is bounded by the
    alphabets, not by the rows: letters of a script followed by letters of the same script.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scripts = np.full(0x110000, -1, dtype=np.int8)
        for b in batches:
            text = "\n".join(t for k in range(b.num_columns) for t in b.column(k).to_pylist() if t is not None).lower()
            first, second, n = _pairs(text, scripts)
            yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in first], pa.string()), pa.array([chr(c) for c in second], pa.string()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    counted = texts.select(*columns).mapInArrow(count, "a string, b string, n long")
    return {(r["a"], r["b"]): r["n"] for r in counted.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


def plain(c: Column) -> Column:
    """Whether a text is in clean form already, as ASCII words parted by single spaces; decided inside the JVM."""
    return c.rlike(r"^[!-~]+(?: [!-~]+)*$")


def cleaned_fields(rows: DataFrame, columns: tuple[str, ...], key: str = "id") -> DataFrame:
    """(key, field_name, clean_text) of every row and column whose text isn't in clean form."""
    cleaner_model = letter_bigrams(rows, columns)
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("t")) for c in columns]))
    long = rows.select(F.col(key).alias("__key"), entries.alias("__e")).select("__key", F.col("__e.f").alias("field_name"), F.col("__e.t").alias("text"))
    long = long.where(F.col("text").isNotNull() & ~plain(F.col("text")))
    kind = rows.schema[key].dataType.simpleString()

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cleaner = Cleaner(cleaner_model)
        for b in batches:
            out = b["text"].map(cleaner)
            changed = out != b["text"]
            yield pd.DataFrame({key: b["__key"][changed], "field_name": b["field_name"][changed], "clean_text": out[changed]})

    return long.mapInPandas(clean, f"`{key}` {kind}, field_name string, clean_text string")
