"""Clean forms of look-alike texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm.confusables import TWINS, Cleaner, cleaned_fields, compatible, letter_bigrams, script

CLEAN = Cleaner({})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ａｌｐｈａ　Ｌｔｄ", "Alpha Ltd"), ("⁣Acme  Corp​ ", "Acme Corp"), ("Café", "Café"), ("e͏́", "é"), ("Futrastom ﬆo", "Futrastom sto"), ("𝗕𝗮𝗱 ⓒⓞⓓⓔ", "Bad code"),
        ("Аlіmеntación Таіhbіnd", "Alimentación Taihbind"), ("Cօllege", "College"), ("Ꮪervices", "Services"), ("Ρress", "Press"), ("Αcɑdemy", "Academy"), ("Bouwɡroep", "Bouwgroep"), ("ЅА Mikusen", "SA Mikusen"),
        ("Тopгoвый дом", "Торговый дом"), ("Κλιvική Ρεφεμo", "Κλινική Ρεφεμο"), ("Включите JavaScript", "Включите JavaScript"), ("ООО Ромашка", "ООО Ромашка"), ("ﾏネﾄギｽポ工業", "マネトギスポ工業"), ("🇺🇸 Acme", "🇺🇸 Acme"), ("Ｅ＆Ｙ，Ｉｎｃ．", "E&Y,Inc."),
        ("​　", ""), ("", ""), ("plain", "plain"), ("Tab\tand\nline", "Tab and line"), ("Îlе-dе-Frаnсе", "Île-de-France"), ("JavaScriptを有効に", "JavaScriptを有効に"),
    ],
)
def test_clean_forms(text, want):
    assert CLEAN(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_clean_forms_are_stable(text):
    once = CLEAN(text)
    assert CLEAN(once) == once and once == once.strip() and "  " not in once


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([c for c in TWINS if script(c) == "LATIN"]), min_size=3, max_size=8), st.randoms())
def test_swapped_letters_come_back(letters, rnd):
    word = "Zf" + "".join(letters)  # letters without a twin fix the script
    swapped = "Zf" + "".join(rnd.choice(TWINS[c]) for c in letters)
    assert CLEAN(swapped) in {word, CLEAN(word)} or CLEAN(swapped).lower().replace("l", "i") == word.lower().replace("l", "i")


def test_long_text_is_read_whole():
    assert CLEAN("Аcme " * 20_000) == "Acme " * 19_999 + "Acme"


def test_table(make):
    rows = [("a", "Ａcme", None), ("b", "Acme", "Lοndon"), ("c", None, ""), ("a", "Ａcme", None)]
    v = make(rows, "id string, organization string, post_title string")
    out = cleaned_fields(v.selectExpr("*", "1 as text", "2 as field_name"), ("organization", "post_title"))
    assert sorted(tuple(r) for r in out.collect()) == [("a", "organization", "Acme"), ("a", "organization", "Acme"), ("b", "post_title", "London")]
    assert cleaned_fields(v.limit(0), ("organization", "post_title")).count() == 0
    assert letter_bigrams(v, ["organization"])["^", "a"] == 1


def test_compatible_keeps_regional_flags():
    flag = "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f"
    assert compatible(flag + " x\U000e0041") == flag + " x"
