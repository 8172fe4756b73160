"""Shares of repeated content, and bands that lose none of the bad documents."""

import random

import pytest

from claimloom.llm.repetition import LIMIT, band, measured, repeated_share, repetitive
from claimloom.llm.repetition import _compressor as compressor

WORDS = "archive mirror group posts names files dates pages rows claims index notes search table source record entry state field value crawl probe desk paper office branch harbour reader window letter".split()


def sentence(rnd, n=9):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(1000)) for _ in range(n)).capitalize() + "."


def test_shares():
    rnd = random.Random(1)
    s = [sentence(rnd) for _ in range(10)]
    assert repeated_share(" ".join(s)) == 0
    assert repeated_share(" ".join([*s, s[0].upper(), s[1].replace(" ", "  ")])) == pytest.approx(2 / 12, abs=0.03)
    assert repeated_share("No. " * 50) > 0.7 and repeated_share("a\nb\n" * 20) > 0.4
    assert repeated_share("組織の記録が公開されたと主張しています今日も" * 4) > 0.7
    assert repeated_share(None) == repeated_share("") == 0 and repeated_share("   \n ") == 0
    assert repeated_share("İ" * 10) == 0


@pytest.mark.parametrize("length", [4, 8, 16, 40, 200])
def test_bands_lose_no_bad_document(length):
    c = compressor()
    rnd = random.Random(length)
    for part in (0.35, 0.5, 0.9):
        s = [sentence(rnd) for _ in range(length)]
        text = " ".join([*s, *s[: max(1, int(length * part / (1 - part)))] * 1][: length * 3])
        while repeated_share(text) <= LIMIT:
            text += " " + s[0]
        assert band(text, c)[0] == "repetitive"


def test_table(make):
    rnd = random.Random(5)
    fine = " ".join(sentence(rnd) for _ in range(30))
    d = make([(1, fine), (2, fine[:200] * 9), (3, None), (4, ""), (5, "spam and more spam again today " * 4000), (2, fine[:200] * 9)], "doc_id long, text string").selectExpr("*", "1 as share")
    assert sorted(r["doc_id"] for r in repetitive(d).collect()) == [2, 2, 5]
    assert {r["doc_id"]: r["band"] for r in measured(d).collect()} == {1: "plain", 2: "repetitive", 3: "plain", 4: "plain", 5: "repetitive"}
    assert repetitive(d.limit(0)).count() == 0


@pytest.mark.parametrize("size", [2000, 4000, 8000])
def test_scattered_short_repeats_just_over_the_limit(make, size):
    """Six or seven words of its own text at a time, too short to compress well: the bands pass some, the measure none."""
    rnd, docs = random.Random(size), []
    for i in range(40):
        words = sentence(rnd, 400).replace(".", "").split() if i % 2 else ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rnd.randrange(3, 9))) for _ in range(1200)]
        words = " ".join(words)[: int(size * 0.68)].split()
        out = [words[j : j + 20] for j in range(0, len(words), 20)]
        while repeated_share(text := " ".join(w for piece in out for w in piece)) <= LIMIT:
            j, n = rnd.randrange(len(words) - 7), rnd.choice((6, 7))
            out.insert(rnd.randrange(len(out) + 1), words[j : j + n])
        docs.append((i, text))
    c = compressor()
    assert any(band(t, c)[0] != "repetitive" for _, t in docs)
    assert {r["doc_id"] for r in repetitive(make(docs, "doc_id long, text string")).collect()} == set(range(40))
