"""Repetition inside a single document.

Compression bands: a document, and each fixed chunk of it, is compressed by zstandard after case and spacing are set aside;
the ratio of its bytes to the compressed bytes is compared with limits for its length. What exceeds the repetitive limit of
its band in the whole or in a chunk is repetitive, text under the lower limit of its band is incompressible. No limit on the
ratio bounds the share: many short repeats compress little, and random letters with repeats less than plain text. So the bands
only describe a document, and the exact measure decides on every one.

The exact share: characters that lie in sentences, lines or runs of six or more words (eighteen characters in Japanese) that
already stood earlier in the same text, case and spacing aside, to all characters. The first occurrence is no repeat.

Defined cases: null and empty texts have share 0 and ratio 1; texts of any length are compressed and measured whole;
repeated rows and ids stay; more columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_WORDS, RUN_CHARS, LIMIT = 6, 18, 0.3
CHUNK = 4096
#: (up to so many bytes, incompressible below this ratio, repetitive from this ratio on). Of 20,000 documents with a measured
#: share, those over 0.3 have at least these ratios: 2.76 up to 1 KB, 2.93 up to 2 KB, 3.5 up to 8 KB, 17 beyond; texts with
#: scattered short repeats have less.
BANDS = ((64, 0.0, 0.0), (128, 0.6, 1.1), (256, 0.8, 1.3), (512, 0.95, 1.5), (1024, 1.1, 1.8), (2048, 1.3, 2.1), (8192, 1.4, 2.6), (1 << 62, 1.5, 2.9))

_SPACES = re.compile(r"\s+")
_WORD = re.compile(r"\S+")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿ｦ-ﾝ]")


def limits(size: int) -> tuple[float, float]:
    return next((low, high) for up, low, high in BANDS if size <= up)


def ratios(text: str, compressor: zstandard.ZstdCompressor) -> tuple[float, list[tuple[int, float]]]:
    """(ratio of the whole, (bytes, ratio) of each fixed chunk) of the text with case and spacing set aside."""
    raw = _SPACES.sub(" ", text).lower().encode("utf-8", "replace")
    if not raw:
        return 1.0, []
    whole = len(raw) / len(compressor.compress(raw))
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)] if len(raw) > CHUNK else []
    return whole, [(len(c), len(c) / len(compressor.compress(c))) for c in chunks]


def band(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple[str, float]:
    """(``repetitive``, ``incompressible`` or ``plain``, ratio of the whole)."""
    if not text:
        return "plain", 1.0
    whole, chunks = ratios(text, compressor)
    size = len(text.encode("utf-8", "replace"))
    low, high = limits(size)
    if whole >= high or any(r >= limits(n)[1] for n, r in chunks):
        return "repetitive", whole
    return ("incompressible" if whole < low else "plain"), whole


def _pieces(text: str) -> Iterator[tuple[str, int, int]]:
    """Sentences and lines with their places."""
    for m in re.finditer(r"[^\n]+", text):
        yield "line", m.start(), m.end()
    start = 0
    for m in re.finditer(r"[.!?]+[\"'”’)\]]*(?=\s|$)|[。！？]+[」』）]*|\n+", text):
        if m.end() > start:
            yield "sentence", start, m.end()
        start = m.end()
    if start < len(text):
        yield "sentence", start, len(text)


def _recurs(low: str, japanese: bool) -> bool:
    """Whether any sentence, line or run occurs twice; most texts have none, and need no places."""
    words = low.split()
    if japanese:
        packed = "".join(words)
        runs = len(packed) - RUN_CHARS + 1
        if runs > 0 and len({packed[i : i + RUN_CHARS] for i in range(runs)}) < runs:
            return True
    elif (runs := len(words) - RUN_WORDS + 1) > 0 and len(set(zip(*(words[i:] for i in range(RUN_WORDS)), strict=False))) < runs:
        return True
    keys = [(kind, k) for kind, a, b in _pieces(low) if (k := " ".join(low[a:b].split()))]
    return len(set(keys)) < len(keys)


def repeated_share(text: str | None) -> float:
    """Characters in repeats to all characters."""
    if not text:
        return 0.0
    n = len(text)
    low = text.lower() if len(text.lower()) == n else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    japanese = not text.isascii() and len(_CJK.findall(text)) * 2 > sum(1 for c in text if not c.isspace())
    if not _recurs(low, japanese):
        return 0.0
    delta = np.zeros(n + 1, dtype=np.int32)
    seen: set[tuple[str, str]] = set()
    for kind, a, b in _pieces(low):
        key = " ".join(low[a:b].split())
        if not key:
            continue
        if (kind, key) in seen:
            s = low[a:b]
            a += len(s) - len(s.lstrip())
            delta[a] += 1
            delta[b - (len(s) - len(s.rstrip()))] -= 1
        else:
            seen.add((kind, key))
    if japanese:
        spots = [i for i, c in enumerate(low) if not c.isspace()]
        packed = "".join(low[i] for i in spots)
        runs: set[str] = set()
        for i in range(len(packed) - RUN_CHARS + 1):
            run = packed[i : i + RUN_CHARS]
            if run in runs:
                delta[spots[i]] += 1
                delta[spots[i + RUN_CHARS - 1] + 1] -= 1
            else:
                runs.add(run)
    else:
        words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)]
        grams: set[tuple[str, ...]] = set()
        texts = [w for w, _, _ in words]
        for i in range(len(words) - RUN_WORDS + 1):
            g = tuple(texts[i : i + RUN_WORDS])
            if g in grams:
                delta[words[i][1]] += 1
                delta[words[i + RUN_WORDS - 1][2]] -= 1
            else:
                grams.add(g)
    covered = np.cumsum(delta[:-1]) > 0
    return float(covered.sum()) / n


def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)


def measured(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, band, ratio, share): share is measured on every document, whatever its band."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor()
        for b in batches:
            texts = b.column(1).to_pylist()
            bands = [band(t, compressor) for t in texts]
            shares = [repeated_share(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for k, _ in bands], pa.string()), pa.array([r for _, r in bands], pa.float64()), pa.array(shares, pa.float64())], names=[key, "band", "ratio", "share"])

    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, band string, ratio double, share double")


def repetitive(df: DataFrame, key: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """(key) of the documents whose repeated share exceeds ``limit``."""
    return measured(df, key, text).where(F.col("share") > limit).select(key)
