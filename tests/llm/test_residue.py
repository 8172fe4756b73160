"""Template residue and error pages, and names that only use their words."""

import pytest

from claimloom.llm.residue import residue, with_residue, with_support

FOUND = [
    "{{company}}", "Leak: ${title} [LEAKED]", "Acme undefined", "Acme <%= state %>", "{{flag}} Acme", "Acme [%STATUS%]", "Acme (lorem ipsum dolor sit amet)", "Announcement for the <?php echo $org; ?> and its clients", "#{COMPANY_NAME}", "@@name@@", "[[victim.name]]", "__title__", "<<company>>", "$victim.name$",
    "{% block name %}", "{company}", "<company name>", "[Your Company Here]", "TITLE_PLACEHOLDER", "Company Name Placeholder", "NaN", "null", "[object Object]", "TODO: victim name", "INSERT TITLE HERE", "Your title goes here", "Votre titre ici", "Titel hier eingeben", "Título de ejemplo", "asdf asdf asdf",
    "aaaaaaa bbbbbbb", "XXXX Company XXXX", "blah blah company", "Hello world!", "Test post please ignore", "Untitled post (draft template)", "Foo Bar Baz", "Card title 3", "dolor sit amet Ltd", "Example Company Ltd - replace me", "Just a moment...", "404 Not Found", "502 Bad Gateway nginx", "HTTP 503 - Service Unavailable",
    "Gateway Time-out (504)", "Error 500", "Access denied | error code 1020", "Seite nicht gefunden", "Страница не найдена", "Page introuvable", "This site can't be reached", "Please enable JavaScript to continue", "Bitte aktivieren Sie JavaScript", "JavaScriptを有効にしてください", "Включите JavaScript", "We use cookies. Accept all to continue",
    "Loading...", "Queue position 12. Please wait", "Fatal error: Uncaught Exception in /srv/app/list.php:3", "Traceback (most recent call last)", "Connection timed out after 3000 ms", "Your session has expired. Please log in again.", "noscript: content hidden", "Leak:  [NEW]",
]
NAMES = [
    "Forbidden Valley Gatibrind Winery", "Tuno JavaScript Academy", "{Kezivask Zizosa} Salon", "Lemo 404 Studios", "Lorem & Ipsum Design Lepaka", "Bad Gateway Brewing Pebavan", "The Null Hulihind Gallery", "Undefined Fitness Nefokir", "Foo Bar Dikulex Bistro", "Gutivo Captcha Lab", "Kobrego Cookies & Bakery", "Salelex Error-Free Bookkeeping",
    "Vegosul Loading Dock Services", "Metili Placeholder Films", "Zenumeth Template Foundry", "Gateway Brihahor Timeout Coaching", "Our template for statements, version 3", "Maintenance of the blog, window 5", "Enable two-factor login, a reminder for tool makers", "Press release 3821", "Welcome", "Monthly summary, page 12", "9 reasons to read our blog, part 4", "",
]


@pytest.mark.parametrize("title", FOUND)
def test_residue(title):
    assert residue(title, "victim")[0] in ("slot", "page")


@pytest.mark.parametrize("title", NAMES)
def test_names(title):
    assert residue(title, "victim")[0] == ""


@pytest.mark.parametrize(("value", "found"), [("%TYPE%", 1), ("undefined", 1), ("lorem", 1), ("{{post_type}}", 1), ("502", 1), ("null", 1), ("todo", 1), ("<type>", 1), ("post_type", 1), ("TYPE_PLACEHOLDER", 1), ("${type}", 1), ("VICTIM ", 0), ("headline", 0), ("review", 0), (None, 0), ("", 0)])
def test_types(value, found):
    assert (residue("Acme Ltd", value)[0] == "slot") is bool(found)


def test_templates_of_the_table(make):
    rows = [(str(i), f"Files of Firm{chr(65 + i)} Ltd will be opened next week", "victim") for i in range(6)]
    rows += [("blank", "Files of will be opened next week", "victim"), ("m1", "Coming soon", "headline"), ("m2", "Coming soon", "headline"), ("one", "Redirecting...", "headline"), ("null", None, None), ("j", "Јust а mоment...", "victim"), ("j", "Јust а mоment...", "victim"), ("long", "x " * 50_000, "victim")]
    v = make(rows, "id string, post_title string, post_type string")
    assert sorted(r["id"] for r in with_residue(v.selectExpr("*", "1 as kind", "2 as skeleton")).collect()) == ["blank", "j", "j", "m1", "m2"]
    assert with_residue(v.limit(0)).count() == 0


def test_shared_wordings_are_counted_by_the_whole_title(make):
    rows = [("a", "Unavailable", "headline"), ("b", "Acme Widgets", "victim"), ("c", "LOGIN", "headline"), ("d", "Redirecting...", "headline"), ("e", "redirecting", "headline")]
    assert sorted(r["id"] for r in with_residue(make(rows, "id string, post_title string, post_type string")).collect()) == ["d", "e"]


def test_whole_pages_are_induced_from_contradictory_repetition(make):
    page = "The lantern of this service is out, ticket {}"
    rows = [(f"p{i}", page.format(i), ("victim", "headline", "review")[i % 3], f"g{i % 2}") for i in range(6)]
    rows += [("part", "Acme Widgets (the lantern of this service is out, ticket 9)", "victim", "g0")]
    rows += [(f"h{i}", "Rules for visitors", "headline", f"g{i % 4}") for i in range(9)] + [(f"n{i}", "Acme Widgets", "victim", f"g{i % 4}") for i in range(9)]
    rows += [(f"o{i}", "Only here and only twice", t, "g1") for i, t in enumerate(("victim", "headline"))] + [(f"s{i}", "One group only", t, "g1") for i, t in enumerate(("victim", "headline", "review"))]
    v = make(rows, "id string, post_title string, post_type string, group_id string")
    got = {r["id"]: (r["kind"], r["support"]) for r in with_support(v, phrases=False).collect()}
    assert got == {f"p{i}": ("page", 6) for i in range(6)} | {"part": ("part", 6)}


def test_kinds_and_support_of_slots(make):
    rows = [(f"{i}", f"Leak: {n} was read today by {m} and others", "victim") for i, (n, m) in enumerate((("Acme", "Bolt"), ("Corx", "Dune"), ("{{name}}", "Emil")))] + [("b", "was read today by Bolt and others", "victim"), ("t", "Acme", "{{type}}")]
    got = {r["id"]: (r["kind"], r["support"]) for r in with_support(make(rows, "id string, post_title string, post_type string")).collect()}
    assert got == {"2": ("slot", 3), "b": ("blank", 1), "t": ("slot", 1)}
