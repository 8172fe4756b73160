"""Variants of names, and names that are alike but not the same organisation's."""

import gc
import itertools
import random
import weakref

import pyarrow as pa

from claimloom.llm import names as module
from claimloom.llm.names import BUSINESS, LEGAL, Business, Name, business_words, components, headline_gaps, named_entities, normal, radius_links, spoken, title_name, uncollected, variant_pairs


def pairs(victims, *rows):
    return {(r["id_a"], r["id_b"]) for r in variant_pairs(victims(*rows)).collect()}


def all_pairs(ids):
    return set(itertools.combinations(sorted(ids), 2))


def test_spellings_of_one_organisation(victims):
    names = ["Mizudux Pikutrel Logistics Ltd", "Mizduux Pikutrel Logistics", "Mizudux-Picutrel Logistics", "Pikutrel & Mizudux Logistics", "Mizuduxpikutrel Logistics", "MIZUDUX PIKUTREL LOGISTICS", "The Mizudux Pikutrel Logistics (Canada)", "Mizudux Pikutrel", "Mizudux Piku​trel Logistics Holding", "mizudux-pikutrel.example"]
    rows = [{"id": f"{i}", "organization": n, "post_title": n, "post_type": "victim", "country": "Canada"} for i, n in enumerate(names)]
    assert pairs(victims, *rows) == all_pairs("0123456789")


def test_null_organisations_and_acronyms_go_by_the_title(victims):
    rows = [
        {"id": "a", "organization": None, "post_title": "Who speaks for Misukax Kistahi Architects GmbH?", "post_type": "review"}, {"id": "b", "organization": "MKA", "post_title": "🇦🇹 Misukax Kistahi Architects GmbH [LEAKED]", "post_type": "victim"},
        {"id": "c", "organization": "Misukax Kistahi Architects GmbH", "post_title": "Misukax Kistahi Architects GmbH", "post_type": "victim"}, {"id": "d", "organization": None, "post_title": "Files of Misukax Kistahi Architects will be opened next week", "post_type": "headline"},
        {"id": "e", "organization": "Misukax Kistahi Architects, GMBH", "post_title": "x", "post_type": "victim"}, {"id": "f", "organization": None, "post_title": "Press release 12", "post_type": "headline"}, {"id": "g", "organization": "HTTP 403 - Forbidden", "post_title": "HTTP 403 - Forbidden", "post_type": "victim"},
        *({"id": f"x{i}", "organization": None, "post_title": t.format(n), "post_type": "headline"} for i, n in enumerate(("Dobrax Ltd", "Vemulon Inc", "Tasuri AG")) for t in ("Who speaks for {}?", "Files of {} will be opened next week")),
        {"id": "h", "organization": "HTTP 404 - Not Found", "post_title": "HTTP 404 - Not Found", "post_type": "victim"}, {"id": "i", "organization": None, "post_title": None, "post_type": None},
    ]
    found = {p for p in pairs(victims, *rows) if not p[0].startswith("x")}
    assert found == all_pairs("abcde") - {("c", "e")}


def test_one_family_two_organisations(victims):
    rows = [
        {"id": "a", "organization": "Birerum Bitrogisk Data Systems", "country": "NL", "claim_details": {"organization_website": "birerumbitrogisk-data.example"}}, {"id": "b", "organization": "Birerum-Bitrogisk Data Sys.", "country": "Netherlands"},
        {"id": "c", "organization": "Birerum-Bitrogisk Farms, Limited", "country": "United Kingdom", "claim_details": {"organization_website": "https://birerum-bitrogisk.example/"}}, {"id": "d", "organization": "Birerum Bitrogisk", "country": "GB"},
    ]
    rows = [{**r, "post_title": r["organization"], "post_type": "victim"} for r in rows]
    assert pairs(victims, *rows) == {("a", "b"), ("c", "d")}


def test_other_alphabets(victims):
    rows = [{"id": "a", "organization": "デネブロメスツトリ病院", "country": "Japan"}, {"id": "b", "organization": "Denebro Mestutril", "country": "Japan"}, {"id": "c", "organization": "Завод Девума Вазодо", "country": "Ukraine"}, {"id": "d", "organization": "Devumal Vazodosk", "country": "Ukraine"}]
    rows = [{**r, "post_title": r["organization"], "post_type": "victim"} for r in rows]
    assert pairs(victims, *rows) == {("a", "b"), ("c", "d")}
    assert spoken(["denebro", "mestutril"], True) == Name(normal("デネブロメスツトリ病院"), Business({})).core


def test_empty_table(victims):
    assert variant_pairs(victims()).count() == 0


def test_title_names():
    assert title_name("🇺🇸 Acme Widgets Inc [SOLD]", "victim") == "Acme Widgets Inc" and title_name("Welcome", "headline") is None and title_name("Acme Widgets <%= state %>", "victim") == "Acme Widgets"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_radius_join_against_all_pairs(make):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("bdgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.choice((3, 4))))

    def edit(s):
        i = rnd.randrange(len(s))
        return rnd.choice((s[:i] + s[i + 1 :], s[:i] + rnd.choice("aeioust") + s[i:], s[:i] + rnd.choice("aeioust") + s[i + 1 :]))

    names = set()
    for _ in range(60):
        a, b = word(), word()
        names |= {f"{a} {b}", f"{edit(a)} {b}", f"{edit(a)} {edit(b)}", f"{a} {edit(edit(b))}"}
    names = {n for n in names if all(len(w) >= 4 for w in n.split())}
    run = lambda n: n.replace(" ", "")
    want = {tuple(sorted((run(x), run(y)))) for x, y in itertools.combinations(sorted(names), 2) if sum(map(distance, x.split(), y.split())) <= 2}
    got = {tuple(sorted((r["a"], r["b"]))) for r in radius_links(make([(n,) for n in names], "words string")).collect()}
    assert want <= got


def test_components_of_long_chains_and_hubs(make):
    edges = [(i, i + 1) for i in range(1, 40)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(make(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[1000 + i] for i in range(200)} == {1000}
    assert components(make([], "a long, b long")).count() == 0


def test_radius_join_of_one_word_run_together_and_short_names(make):
    rnd = random.Random(11)
    letters = "bdgklmnprstaeiou"

    def edit(s):
        i = rnd.randrange(len(s))
        return rnd.choice((s[:i] + s[i + 1 :], s[:i] + rnd.choice(letters) + s[i:], s[:i] + rnd.choice(letters) + s[i + 1 :]))

    names = {"sumozert", "sunosert", "stibrohund", "stibrahunt", "hegamandmarofisk", "hegumandmarofosk"}
    for n in [*range(5, 24), 40] * 3:
        w = "".join(rnd.choice(letters) for _ in range(n))
        i, j = sorted(rnd.sample(range(1, n), 2))
        for x in (w, edit(w), edit(edit(w)), edit(edit(w)), w[i:] + w[:i], edit(w[i:] + w[:i])):
            names |= {x, f"{x[:i]} {x[i:]}" if i < len(x) else x, f"{w[i:]} {w[:i]}", f"{edit(w[:i] + '-').replace('-', '')}x {w[i:]}", f"{w[:i]} {w[i:j]} {w[j:]}", f"{w[j:]} {w[i:j]} {w[:i]}"}
    names = sorted({n.replace(" ", ""): n for n in sorted(names) if all(n.split(" "))}.values())
    run = lambda n: n.replace(" ", "")
    turned = lambda n: "".join(reversed(n.split()))

    def near(x, y):
        x, y = sorted((x, y), key=lambda n: len(run(n)))
        if len(run(y)) - len(run(x)) > 2:
            return False
        either = len(run(x)) == len(run(y)) or " " not in x
        return distance(run(x), run(y)) <= 2 or distance(turned(x), run(y)) <= 2 or (either and distance(run(x), turned(y)) <= 2)

    want = {tuple(sorted((run(x), run(y)))) for x, y in itertools.combinations(names, 2) if near(x, y)}
    got = {tuple(sorted((r["a"], r["b"]))) for r in radius_links(make([(n,) for n in names], "words string")).collect()}
    assert {("sumozert", "sunosert"), ("stibrahunt", "stibrohund"), ("hegamandmarofisk", "hegumandmarofosk")} <= want
    assert want == got


def test_words_of_an_organisation_with_many_spellings_are_not_words_of_business(victims, make):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("bdgklmnprst") + rnd.choice("aeiou") for _ in range(4))
    spellings = [f"Gatibrind{a}Zosamuve{b}{c}" for a in (" ", "-", " & ", ", ", "  ") for b in (" ", ", ", " - ") for c in ("Ltd", "LTD.", "Limited", "Inc", "GmbH", "S.A.", "Winery", "")]
    spellings += [f"Gatibrind {'Zosamuve'[:i]}{x}{'Zosamuve'[i + 1 :]} Ltd" for i in range(1, 8) for x in "aeiou"]
    others = [f"{word()} Querfeldbau" for _ in range(150)] + [f"{word()} {word()} Ltd" for _ in range(150)]
    rows = [{"id": f"{i}", "organization": n, "post_title": "x", "post_type": "headline"} for i, n in enumerate(spellings + others)]
    assert set(business_words(make([(" ".join(sorted({w for w in normal(n).split()} - LEGAL)),) for n in spellings + others], "ws string"))) - BUSINESS == {"querfeldbau"}
    found = pairs(victims, *rows)
    assert all(("0", f"{i}") in found for i in range(1, len(spellings)) if normal(spellings[i]) != normal(spellings[0]))


def test_short_names(victims):
    rows = [("a", "Siemens AG", "DE"), ("b", "Simens AG", "Germany"), ("c", "Siemens", None), ("d", "Bosch Tools", None), ("e", "Bosh Tools", None), ("f", "Bosko Winery", "FR"), ("g", "BMW Tools", None), ("h", "BMW Tools GmbH", None), ("i", "BMB Tools", None), ("j", "BMW", None), ("k", "Sumens AG", "FR")]
    sites = [("x", "Abc", "https://www.quabo.example/"), ("y", "Defgh Kilomano Ltd", "quabo.example")]
    rows = [{"id": i, "organization": n, "country": c, "post_title": n, "post_type": "victim"} for i, n, c in rows] + [{"id": i, "organization": n, "post_title": n, "post_type": "victim", "claim_details": {"organization_website": u}} for i, n, u in sites]
    assert pairs(victims, *rows) == {("a", "b"), ("a", "c"), ("b", "c"), ("d", "e"), ("g", "h"), ("x", "y")}


def test_words_of_business_by_abbreviation_stem_and_typing_error():
    known = Business({"services": 90, "svcs": 9, "logistica": 50, "logistique": 20, "gmbh": 40, "robert": 30})
    assert [known(w) for w in ("svcs", "serivces", "logistique", "engrg", "acctg", "univ", "mfg")] == ["services", "services", "logistica", "engineering", "accounting", "university", "manufacturing"]
    assert known("gmbh") is None and known("robert") is None and known("fidopal") is None and known("elec") == ""


def test_headlines_with_gaps_are_learned_from_the_table(make):
    titles = [(f"◊ goes on about ◊ once more", ["It", n]) for n in ("Acme", "Bolt", "Corx")] + [("◊ to all of our readers", ["Welcome"])] * 5 + [("◊ was never seen before", [n]) for n in ("Acme", "Bolt")]
    assert headline_gaps(make(titles, "template string, slots array<string>")) == {"◊ goes on about ◊ once more": (1, 1)}


def test_pages_repeated_under_contradictory_types_name_nobody(victims):
    page = "Lantern service is dreaming of sheep"
    rows = [{"id": f"{i}", "group_id": f"g{i % 3}", "organization": page if i % 2 else None, "post_title": page, "post_type": ("victim", "headline", "review")[i % 3]} for i in range(9)]
    assert pairs(victims, *rows) == set()


def test_a_hot_organisation_meets_in_blocks(victims):
    rows = [{"id": f"{i:02}", "organization": n, "post_title": n, "post_type": "victim"} for i, n in enumerate(["Mizudux Pikutrel Logistics", "Mizudux Pikutrell Logistics", "Mizudux-Pikutrel"] * 8)]
    got = [(r["id_a"], r["id_b"]) for r in variant_pairs(victims(*rows, *rows[:2]), block=3).collect()]
    want = {(a["id"], b["id"]) for a, b in itertools.combinations(rows, 2) if normal(a["organization"]) != normal(b["organization"])}
    assert set(got) == want
    whole = {r["id"]: (r["entity"], r["spellings"], r["rows"]) for r in named_entities(victims(*rows)).collect()}
    assert len(whole) == 24 and len(set(whole.values())) == 1 and whole["00"][1:] == (3, 24)


def test_radius_join_of_names_of_one_to_three_words(make):
    rnd = random.Random(5)
    letters = "bdgklmnprstaeiou"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(3, 16)))

    def edit(s):
        i = rnd.randrange(len(s))
        return rnd.choice((s[:i] + s[i + 1 :], s[:i] + rnd.choice(letters) + s[i:], s[:i] + rnd.choice(letters) + s[i + 1 :])).strip() or "a"

    names = set()
    for k in range(240):
        n = " ".join(word() for _ in range(1 + k % 3))
        names |= {n, " ".join(edit(n).split()), " ".join(edit(edit(n)).split()), " ".join(edit(edit(edit(n))).split())}
    names = sorted({n.replace(" ", ""): n for n in sorted(names)}.values())
    run = lambda n: n.replace(" ", "")
    close = [(x, y) for x, y in itertools.combinations(names, 2) if abs(len(run(x)) - len(run(y))) <= 2 and distance(run(x), run(y)) <= 2]
    got = {tuple(sorted((r["a"], r["b"]))) for r in radius_links(make([(n,) for n in names], "words string")).collect()}
    assert len(close) > 400 and all(tuple(sorted((run(x), run(y)))) in got for x, y in close)


def test_kept_names_are_not_searched_for_cycles_while_rows_are_read():
    seen = []

    class Knot:
        def __init__(self):
            self.itself = self

    def run(batches):
        for b in batches:
            seen.append((gc.isenabled(), weakref.ref(Knot())))
            yield b

    for stop in (False, True):
        calm = uncollected(run)(iter(range(3)))
        assert [next(calm) for _ in range(2)] == [0, 1]
        calm.close() if stop else list(calm)
        assert gc.isenabled()
    assert not any(enabled for enabled, _ in seen) and seen[0][1]() is None


def test_words_of_business_with_one_typing_error():
    known = Business({})
    for w in ("accounting", "laboratory", "services", "foods"):
        for i in range(1, len(w) - 1):
            typed = {w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]}
            assert {known(x) for x in typed if len(x) > 6} <= {w}
    assert known("querfeldbau") is None and known("accxunxing") is None


def test_names_meet_in_any_number_of_parts_and_a_few_pairs_at_a_time(monkeypatch):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("bdgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 5)))
    spelt = sorted({f"{w[:i]}{x}{w[i + 1 :]}" for w in [f"{word()} {word()}" for _ in range(20)] + [word() for _ in range(20)] for i in range(3) for x in "aeß"})
    batches = [pa.RecordBatch.from_arrays([pa.array(spelt[k::3])], names=["words"]) for k in range(3)]

    def met(parts):
        laid = [r for b in module._laid_out(iter(batches), parts) for r in b.to_pylist()]
        kinds = pa.schema([("part", pa.int32()), *((k, pa.binary()) for k in ("letters", "ends", "own", "own_at", "other", "other_at"))])
        own = [[r for r in laid if r["part"] == k] for k in range(parts)]
        return {(r["wa"], r["wb"]) for rows in own for b in module._met(iter([pa.RecordBatch.from_pylist(rows, kinds)])) for r in b.to_pylist()}

    whole = met(1)
    assert len(whole) > 200 and met(7) == whole
    monkeypatch.setattr(module, "PAIRS", 5)
    assert met(3) == whole and met(1) == whole
    near = {(x, y) for x, y in itertools.combinations(spelt, 2) if abs(len(x) - len(y)) <= 2 and distance(x.replace(" ", ""), y.replace(" ", "")) <= 2}
    assert all((x, y) in whole or (y, x) in whole for x, y in near)
