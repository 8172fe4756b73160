"""Sizes, counts and lengths of time in many notations."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.operators.units import UNITS, Unit, countdown_seconds, data_bytes, described_bytes, file_count, read_quantities


@pytest.mark.parametrize(
    ("text", "mark", "unit", "want"),
    [
        ("147,1 GB", ",", None, 147_100_000_000), ("1.998 GB", ",", None, 1_998_000_000_000), ("1.998 GB", ".", None, 1_998_000_000), ("49,507 MB", ".", None, 49_507_000_000), ("31 318 696 976 B", ".", None, 31_318_696_976),
        ("85'577 MB", ".", None, 85_577_000_000), ("50,5 GiB", ",", None, 54_223_962_112), ("154.48 Gbit", ".", None, 19_310_000_000), ("16.4 Gb", ".", None, 16_400_000_000), ("ca. 16.4 Go", ".", None, 16_400_000_000), ("2,14 ГБ", ",", None, 2_140_000_000),
        ("13 million MB", ".", None, 13 * 10**12), ("29 Tsd. GB", ".", None, 29 * 10**12), ("26k GB", ".", None, 26 * 10**12), ("19M megabytes", ".", None, 19 * 10**12), ("3e8 bytes", ".", None, 3 * 10**8), ("4 x 10^10 bytes", ".", None, 4 * 10**10),
        ("1 TB 990 GB", ".", None, 1_990_000_000_000), ("3TB + 200GB", ".", None, 3_200_000_000_000), ("2 TiB and 480 GiB", ".", None, 2 * 2**40 + 480 * 2**30), ("one and a half terabytes", ".", None, 1_500_000_000_000), ("half a terabyte", ".", None, 5 * 10**11),
        ("a quarter of a terabyte", ".", None, 25 * 10**10), ("seven hundred megabytes", ".", None, 7 * 10**8), ("a dozen gigabytes", ".", None, 12 * 10**9), ("223 mega bytes", ".", None, 223_000_000), ("[316.9 Gb]", ".", None, 316_900_000_000),
        ("1,25 TB / 100% published", ",", None, 1_250_000_000_000), ("2224.4 GiB in 3 archives", ".", None, 2_388_431_313_306), ("42,3", ",", "GB", 42_300_000_000), ("207", ".", "MiB", 207 * 2**20), ("207", ".", None, None), ("N/A", ".", "GB", None), ("several archives", ".", "GB", None), ("", ".", "GB", None),
        ("１４７ ＧＢ", ".", None, 147_000_000_000), ("9" * 30 + " TB", ".", None, None),
    ],
)
def test_sizes(text, mark, unit, want):
    assert data_bytes(text, mark, unit) == want


@pytest.mark.parametrize(
    ("text", "mark", "want"),
    [("約18万ファイル", ".", 180_000), ("13 lakh files", ".", 1_300_000), ("25 lakhs", ".", 2_500_000), ("10万件", ".", 100_000), ("3.58 Mio. Dateien", ".", 3_580_000), ("7,76 mln", ",", 7_760_000), ("92 K", ".", 92_000), ("45,7 K", ",", 45_700),
     ("~346 in total", ".", 346), ("Files: 3 673", ".", 3673), ("count=1'437'665", ".", 1_437_665), ("3 dozen items", ".", 36), ("over 37 hundred documents", ".", 3700), ("8,887 fichiers", ".", 8887), ("2.62M files", ".", 2_620_000), ("tbd", ".", None), ("???", ".", None)],
)
def test_counts(text, mark, want):
    assert file_count(text, mark) == want


@pytest.mark.parametrize(
    ("text", "mark", "want"),
    [("9d14h34m", ".", 830_040), ("17d 17:54:38", ".", 17 * 86400 + 64478), ("7 days 6 hours", ".", 626_400), ("PT90H", ".", 324_000), ("P4DT2H", ".", 352_800), ("three days", ".", 259_200), ("19,5 days", ",", 1_684_800), ("6 semaines", ".", 6 * 604_800),
     ("noch 84 Stunden", ".", 302_400), ("T-minus 108 hours", ".", 388_800), ("22 дней", ".", 22 * 86400), ("6'480 minutes remaining", ".", 388_800), ("10,080 min", ".", 604_800), ("2023-02-02", ".", None), ("until Jan 10, 2023", ".", None), ("2 Feb 2023", ".", None), ("expired", ".", None)],
)
def test_lengths_of_time(text, mark, want):
    assert countdown_seconds(text, mark) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("The firm sells 512 GB drives. In total 360 GB were copied.", 360 * 10**9), ("Its archive room keeps a 40 TB storage array.", None), ("Mail boxes there are limited to 25 GB.", None), ("Entwendet wurden angeblich ca. 12 Tsd. GB.", 12 * 10**12), ("They say more than 127.5 GB left the network.", 127_500_000_000),
     ("It employs about 5631 people. The group claims to hold two terabytes.", 2 * 10**12), ("A firm with revenue of 152 million.", None), ("", None)],
)
def test_descriptions(text, want):
    assert described_bytes(text) == want


def test_units_are_vectors():
    speed = UNITS["gb"] * Unit((0, 0, -1), UNITS["b"].scale)
    assert speed.dim == (1, 0, -1) and speed.scale == 10**9


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_read(text):
    for f in (data_bytes, file_count, countdown_seconds, described_bytes):
        v = f(text)
        assert v is None or (isinstance(v, int) and v < 2**63)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([".", ","]))
def test_grouping_and_plain_digits_agree(n, mark):
    other = "," if mark == "." else "."
    assert data_bytes(f"{n:,}".replace(",", other) + " KB", mark) == data_bytes(f"{n} kB", mark) == n * 1000


def test_rows(make, conventions):
    rows = [("a", "S", {"claimed_data_size": "1,5 GB", "file_count": "1.000", "deadline": "3 days"}), ("b", None, {"claimed_data_size": "N/A", "description": "In total 3 GB were copied."}), ("c", "s", {"description": "In total 3 GB were copied."}), ("d", "s", None), ("e", "s", {}), ("f", "s", {"file_count": None}), ("c", "s", {"description": "In total 3 GB were copied."})]
    v = make(rows, "id string, source_id string, claim_details map<string,string>")
    got = sorted((r["id"], r["quantity"], r["amount"]) for r in read_quantities(v.selectExpr("*", "1 as text"), conventions(("s", "UTC", "dmy", ",", "GB"))).collect())
    assert got == [("a", "countdown_seconds", 259_200), ("a", "data_bytes", 1_500_000_000), ("a", "file_count", 1000), ("c", "data_bytes", 3 * 10**9), ("c", "data_bytes", 3 * 10**9)]
    assert read_quantities(v.limit(0), conventions()).count() == 0


def test_units_compose():
    from fractions import Fraction

    from claimloom.operators.units import DATA, NONE, TIMES, UNITS, Unit

    dozen = Unit(NONE, Fraction(12))
    assert (dozen * UNITS["mb"]).dim == DATA and (dozen * UNITS["mb"]).scale == 12 * 10**6
    speed = UNITS["mb"] / TIMES["s"]
    assert speed.dim == (1, 0, -1) and (speed * TIMES["h"]) == Unit(DATA, Fraction(3600 * 10**6))
    assert data_bytes("10 MB/s") is None and data_bytes("10 MB per second") is None and data_bytes("10 MB/s, 3 GB") == 3 * 10**9 and data_bytes("3 dozen MB") == 36 * 10**6
