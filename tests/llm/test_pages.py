import pytest

from siltloom.functions.html import page_lines, parse
from siltloom.llm.main_content import densities, is_junk, main_body_lines, main_lines
from siltloom.llm.repeated_lines import repeated_lines, strip_repeated
from siltloom.llm.residue import clean_teasers, is_residue, lines_are_residue, residue_cases, title_is_residue

PAGES = "page_id bigint, url string, sp_source string, html string, fetched_at timestamp, day string, rows string"
NAMES = ("Alpha", "Beta-Ville")
PARAGRAPH = "Die Stadtverwaltung erläutert die Ausstellung im Foyer, nachdem der Rat mehrheitlich zugestimmt hat. Ein Faltblatt dazu liegt aus."


def pages(spark, *rows):
    return spark.createDataFrame([(i, f"u{i}", s, h, None, "clash", None) for i, (s, h) in enumerate(rows, 1)], PAGES)


@pytest.mark.parametrize(
    "title",
    ["{{ title }}", "${headline} | Alpha", "Beta-Ville – [[summary]]", "###NAME### [[ort]]", "%(page_title)s NaN", "<%= ort %> (###TITLE###)", "&#123;&#123;titel&#125;&#125;", "[%title[0]%]", "News: ?title?", "!!MISSING",
     "404 Not Found | Alpha", "Alpha: Access denied", "ZUGRIFF VERWEIGERT", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen!", "Lorem ipsum dolor sit amet 12", "Magna veniam consectetur elit!", "Blindtext Blindtext Blindtext 7",
     "TODO Titel einfügen", "Untitled document copy", "(null)", "undefined", "Traceback (most recent call last): File \"/srv/app/a.py\", line 3, in render KeyError: 'x'", "Votre titre ici", "Erreur 404 : page introuvable", "Wartungsarbeiten: Wir sind bald wieder da"],
)
def test_residue_titles(title):
    assert title_is_residue(title, NAMES)


@pytest.mark.parametrize(
    "title",
    ["", None, "   ", "Serienbriefe mit Platzhaltern wie {{name}} erstellen, Kurs 393", "How to use ${name} in a form letter, lesson 7", "Lorem ipsum und Co.: Vortrag Nr. 3 über Blindtexte", "Kurs Nr. 7: JavaScript für den Einstieg",
     "Fehler im Fahrplan: Alpha entschuldigt sich", "Access denied no more: Alpha opens 49 archive boxes", "Seite an Seite nicht gefunden? Suchhunde üben in Alpha", "Buslinie 503 wird in Alpha umgeleitet", "Exhibition “404” shows 4 finds from Alpha",
     "Wartungsarbeiten am Wasserwerk Alpha dauern 3 Tage", "Neues aus Alpha – Wochenmarkt", "Was wäre, wenn Alpha ..."],
)
def test_titles_with_content(title):
    assert not title_is_residue(title, NAMES)


def test_residue_lines():
    assert is_residue("Guten Tag [[name]], Ihr Antrag ##TITLE## wurde an <%= page_title %> gesendet.", (), whole=False)
    assert not is_residue("Leaflet 608 explains that fields such as {{ summary }} are replaced by Alpha before a letter is sent.", (), whole=False)
    assert not is_residue("Wer zuletzt die Meldung „Internal Server Error“ sah, kann die Seite seit dem 30. Tag wieder aufrufen.", (), whole=False)
    assert is_residue("test test test please ignore. test test test please ignore.", (), whole=False)


ARTICLE = f"<h1>Neues</h1><div class=meta>Stand: 05.11.2021</div><p><small>Von der Redaktion Alpha</small></p><p>{PARAGRAPH}</p><noscript>Bitte aktivieren Sie JavaScript</noscript><h3>Hintergrund</h3><ul><li><a href=/dok>Der Ortsbeirat tagt.</a></li></ul><blockquote>Zitat <b>fett</b>.</blockquote><p>Teilen Sie diesen Beitrag mit Freunden</p>"
RELATED = "<h3>Das könnte Sie auch interessieren</h3><p>Die Feuerwehr prüft das Orgelkonzert, da viele Helferinnen und Helfer ihre Zeit einbringen und alle kommen.</p>"
NAV = "<ul><li><a href=/a>Suche</a></li><li><a href=/b>Kontakt</a></li></ul>"
BODY = ["Neues", PARAGRAPH, "Hintergrund", "Der Ortsbeirat tagt.", "Zitat fett."]


@pytest.mark.parametrize(
    "page",
    [
        f"<title>Neues</title><body><header><nav>{NAV}</nav></header><main><article>{ARTICLE}</article><div class=comments><h4>Kommentare</h4><p>{PARAGRAPH} Toll.</p></div></main><aside>{RELATED}</aside><footer><div>© Alpha</div></footer>",
        f"<body>{NAV}{ARTICLE}<div>{RELATED}</div><div>Impressum | Datenschutz</div>",
        f"<table><tr><td>{NAV}</td><td>{ARTICLE}</td><td>{RELATED}</td></tr><tr><td colspan=3><p>© Stadt Alpha – Alle Rechte vorbehalten</p></td></tr></table>",
        f"<article class=card>{RELATED}</article><section role=main>{ARTICLE}</section><div role=contentinfo><div>x</div></div><div class=cookie-banner><p>Wir verwenden Cookies.</p><button>Alle akzeptieren</button></div>",
        f"<title>Neues</title><body><div class=x1>{NAV}</div><div class=x2><div class=x3>{ARTICLE.replace('<h1>', '<div>').replace('</h1>', '</div>')}</div><div class=x4>{RELATED}</div></div>",
    ],
)
def test_main_body(page):
    lines, _ = main_lines(page)
    assert [x.text for x in lines] == BODY and lines[0].headline
    assert not lines_are_residue(lines, [])


APART = "<title>Neues</title><body><nav>" + NAV + "</nav><div class=w>{}<div class=b2><p>" + PARAGRAPH + "</p><p>" + PARAGRAPH[:60] + "</p></div>{}</div><div class=f><div>© Alpha</div></div>"
TEASERS = "<div class=t9>" + "".join(f"<div><a href=/t{i}>Thema {i} der Woche</a></div>" for i in range(9)) + "</div>"


@pytest.mark.parametrize(
    ("head", "after", "expected"),
    [
        ("<header><h1>Neues</h1><p>Von der Redaktion Alpha</p></header>", "", ["Neues", PARAGRAPH, PARAGRAPH[:60]]),
        ("<header><h1>Neues</h1><p>Ein Vorspann zum Foyer</p></header>", "", ["Neues", "Ein Vorspann zum Foyer", PARAGRAPH, PARAGRAPH[:60]]),
        ("<div class=h><div>Neues</div><p>Ein Vorspann zum Foyer</p></div>", TEASERS, ["Neues", "Ein Vorspann zum Foyer", PARAGRAPH, PARAGRAPH[:60]]),
    ],
)
def test_densest_subtree_gives_the_lines(head, after, expected):
    lines, _ = main_lines(APART.format(head, after))
    assert [x.text for x in lines] == expected and [x.headline for x in lines] == [True] + [False] * (len(expected) - 1)


def test_lines_go_on_after_a_left_out_box():
    last = PARAGRAPH.replace("Foyer", "Saal")
    page = f"<body><nav>{NAV}</nav><article><h1>Neues</h1><p>{PARAGRAPH}</p>{{}}<p>{last}</p>{{}}<p>Kurz.</p><aside>{RELATED}</aside><p>Nicht mehr dabei, denn der Text endet vor diesem Kasten.</p></article>"
    share, consent = "<div class=share-bar><p>Senden Sie es weiter an alle.</p></div>", "<div class=cookie-banner><p>Wir zeigen hier nichts an.</p></div>"
    for a, b in ((share, "<aside>Ein Kasten am Rand</aside>"), ("<section class=newsletter><p>x</p></section>", consent)):
        assert [x.text for x in main_lines(page.format(a, b))[0]] == ["Neues", PARAGRAPH, last, "Kurz."]
    foot = f"<body><article><h1>Neues</h1><p>{PARAGRAPH}</p><aside>Ein Kasten</aside><div>Seite 1</div></article>"
    assert [x.text for x in main_lines(foot)[0]] == ["Neues", PARAGRAPH]


def test_listings_of_tutorials_are_no_residue():
    listing = "".join(f"<{{0}}>{{{{{{{{ field_{i} }}}}}}}} {{{{{{{{ value_{i} }}}}}}}}</{{0}}>" for i in range(30))
    page = "<body><article><h1>Briefe</h1><p>Der Brief wird in wenigen Schritten erstellt.</p>{}</article>"
    for tag in ("pre", "code", "kbd", "samp"):
        assert not lines_are_residue(*main_lines(page.format(listing.format(tag))))
    assert not lines_are_residue(*main_lines(page.format("<p>Der Text nennt die Platzhalter.</p><p>{{ vorname }} {{ nachname }} {{ strasse }} {{ hausnummer }} {{ plz }} {{ ort }}</p>")))
    assert lines_are_residue(*main_lines(page.format(listing.format("p"))))
    assert lines_are_residue(*main_lines("<body><article><h1>Kurs</h1><pre>Traceback (most recent call last): x</pre></article>"))
    assert lines_are_residue(*main_lines("<body><article><h1>Kurs für Anfänger</h1><p>{{ text }}</p></article>"))


def test_threshold_is_of_the_ancestors():
    heap = parse("<body><div class=heap>" + "<div>zehn Buchst</div>" * 100 + "</div><p>" + "Wort " * 60 + "</p></body>")
    body = next(x for x in heap.walk() if x.tag == "body")
    best, _ = densities(body)
    assert body.kids[0].stat[4] < body.stat[4] and body.kids[0].stat[5] > body.stat[5] and best is body
    page = parse(APART.format("<h1>Neues</h1>", TEASERS))
    body = next(x for x in page.walk() if x.tag == "body")
    best, threshold = densities(body)
    above = [best.parent]
    while above[-1] is not body:
        above.append(above[-1].parent)
    assert best.attrs.get("class") == "b2" and threshold == min(x.stat[4] for x in above) and best.stat[4] > threshold


def test_junk_lines():
    for x in ("Last updated: 01.02.2023", "Par la rédaction de Alpha", "Words and pictures: Alpha Council", "Abonnez-vous à la lettre d'information de Alpha chaque vendredi.", "Mairie de Alpha, 36 rue du Moulin, tél. 0000 50067", "Accept all"):
        assert is_junk(x)
    for x in ("Weitere Informationen", "Diese Veranstaltung gehört zur Reihe „Sommer in Alpha“.", PARAGRAPH, "Source of life: water, by the river that flows through the whole of the valley and further on to the lake, where it ends."):
        assert not is_junk(x)


def test_residue_and_main_body_of_pages(spark, sites):
    frame = lambda x: f"<title>t</title><body><nav>{NAV}</nav><main><article>{x}</article></main><aside>{RELATED}</aside>"
    df = pages(
        spark, ("s_a", frame(ARTICLE)), ("s_a", frame("<h1>{{title}}</h1><p>Am @@A_B | E@@ findet in {{node.label}} die Veranstaltung %(site_name)s statt.</p>")), ("s_a", frame("<noscript>You need to enable JavaScript to view this page</noscript><div id=app></div>")),
        ("s_a", None), ("s_a", ""), (None, frame("<h1>Interner Serverfehler</h1><p>Bitte prüfen Sie die Adresse.</p><p>Ref. abc</p>")), ("s_a", frame("")), ("s_a", "<p>" + "Ein Satz über die Stadt und ihre Brücke. " * 20_000), ("s_a", "\x00<<<>>>"),
    )
    t = spark.createDataFrame([(1, "404 Not Found | Alpha", "a"), (2, "Neues", "b"), (3, None, "c")], "teaser_id bigint, title string, is_residue string")
    assert sorted(tuple(r) for r in residue_cases(df, t, sites).collect()) == [("pages_in", 2), ("pages_in", 3), ("pages_in", 6), ("teasers_raw", 1)]
    assert clean_teasers(t, sites).count() == 2
    got = {}
    for r in main_body_lines(df, sites).collect():
        got.setdefault(r["page_id"], []).append(r["line_text"])
    assert sorted(got[1]) == sorted(BODY) and set(got) == {1, 8, 9} | ({9} & set(got)) - (set() if 9 in got else {9}) and len(got[8][0]) > 500_000
    empty = pages(spark)
    assert residue_cases(empty, t.limit(0), sites).count() == 0 and main_body_lines(empty, sites).count() == 0


def test_repeated_lines_against_brute_force(spark):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(400):
        s = rng.choice(["s_a", "s_a", "s_b", None])
        kind = rng.random()
        lines = ["Impressum", "Impressum"] + [f"Satz {rng.randrange(40)}" for _ in range(3)] + (["Selten"] if kind < 0.25 else ["Oft"])
        rows.append((s, rng.choice([None, ""]) if kind > 0.97 else "<div>" + "</div><div>".join(lines) + "</div>"))
    rows += [("s_c", "<p>nur vier</p>")] * 4 + [("s_d", "<p>fünf</p>")] * 5
    df = pages(spark, *rows).repartition(6)
    total, count = {}, {}
    for s, h in rows:
        total[s] = total.get(s, 0) + 1
        for x in set(page_lines(h)):
            count[s, x] = count.get((s, x), 0) + 1
    documents = {}
    for s, h in rows:
        for x in set(page_lines(h)):
            documents.setdefault((s, x), set()).add(tuple(page_lines(h)))
    expected = {k for k, n in count.items() if n >= 5 and n >= 0.3 * total[k[0]] and len(documents[k]) > 1}
    assert ("s_d", "fünf") not in expected  # one page five times
    got = repeated_lines(df).collect()
    assert {(r["sp_source"], r["line_text"]) for r in got} == expected and len(got) == len(expected)
    assert all(count[r["sp_source"], r["line_text"]] == r["n_rows"] and r["n_docs"] <= r["n_rows"] for r in got)
    stripped = {r["page_id"]: r["text"] for r in strip_repeated(df).collect()}
    assert len(stripped) == len(rows) and all("Impressum" not in x for x in stripped.values())
    assert repeated_lines(pages(spark)).count() == 0 and strip_repeated(pages(spark)).count() == 0


def test_republished_articles_keep_their_lines(spark):
    """An article on half of the rows is no boilerplate, whatever stands in its html beside the lines."""
    rows = [("s_a", f"<p>Impressum</p><p>Satz {i}</p>") for i in range(8)] + [("s_a", f"<style>.x{i}{{}}</style><p>Impressum</p><p>Der Artikel.</p>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in strip_repeated(pages(spark, *rows)).collect()}
    assert got == {i + 1: f"Satz {i}" if i < 8 else "Der Artikel." for i in range(16)}
    assert [r["line_text"] for r in repeated_lines(pages(spark, *rows)).collect()] == ["Impressum"]


def test_lines_that_stand_twice_stay(spark):
    rows = [("s_a", f"<p>Impressum</p><p>Satz {i}</p><p>Refrain {i}</p><p>Satz {i}</p><p>Impressum</p>") for i in range(6)]
    got = {r["page_id"]: (r["text"], r["n_removed"]) for r in strip_repeated(pages(spark, *rows)).collect()}
    assert got == {i + 1: (f"Satz {i}\nRefrain {i}\nSatz {i}", 2) for i in range(6)}
    assert [(r["line_text"], r["n_rows"]) for r in repeated_lines(pages(spark, *rows)).collect()] == [("Impressum", 6)]


def test_spellings_of_site_names(spark, sites):
    from siltloom.llm.residue import _registry_names

    more = spark.createDataFrame([("Muehlstaedtel",), (None,), ("Saltwick_Norrey",)], "site_key string")
    names = _registry_names(more)
    assert {"Mühlstädtel", "Muehlstaedtel", "Saltwick-Norrey"} <= set(names)
    assert title_is_residue("{{title}} | Mühlstädtel", names) and not title_is_residue("Mühlstädtel | Wochenmarkt", names)


def test_filler_without_its_best_known_words():
    from siltloom.llm.residue import title_is_residue

    for title in ("Dolore sit sit magna", "SED DOLOR DOLOR 2", "Magna sed magna! 2"):
        assert title_is_residue(title), title
    for title in ("Magna", "Sit in", "Magna Carta", "Non est", "Sed und Dolor"):
        assert not title_is_residue(title), title


def test_too_many_site_names_are_an_error(spark, monkeypatch):
    from siltloom.llm import residue, truncation

    more = spark.createDataFrame([("Alpha",), ("Beta",)], "site_key string")
    monkeypatch.setattr(residue, "MAX_NAMES", 1)
    with pytest.raises(ValueError):
        residue._registry_names(more)
    with pytest.raises(ValueError):
        truncation.truncated(spark.createDataFrame([], "teaser_id bigint, url string, title string, introtext string, sp_source string"), more)


def test_content_that_looks_like_a_notice():
    from siltloom.llm.main_content import is_junk

    for line in ("By the river", "Cookies backen mit Kindern in der Stadtbücherei", "La reproduction des tortues observée au zoo", "Teilen macht Freude im Kindergarten"):
        assert not is_junk(line), line
        page = f"<html><body><div><h1>Kopf</h1><p>{'Ein langer Satz über den Ort. ' * 9}</p><p>{line}</p></div></body></html>"
        assert line in [x.text for x in main_lines(page)[0]]
    for line in ("By Anna Smith", "Teilen & drucken", "Diese Seite verwendet Cookies.", "La reproduction des textes est interdite."):
        assert is_junk(line), line


def test_density_finds_the_body_without_names_or_headings(monkeypatch):
    """With the list of headings switched off the densest subtree still leaves out what stands around it."""
    import re

    from siltloom.llm import main_content

    monkeypatch.setattr(main_content, "_BLOCK_HEAD", re.compile(r"(?!)"))
    text = "".join(f"<p>{'Der Rat hat am Abend lange über die Brücke gesprochen. ' * 4}</p>" for _ in range(4))
    side = "".join(f'<li><a href="/{i}">Weitere Meldung {i}</a> kurz</li>' for i in range(8))
    page = f"<html><body><div class=x1><ul>{side}</ul></div><div class=x2><h2>Brücke</h2>{text}</div><div class=x3><h3>Mehr</h3><ul>{side}</ul></div></body></html>"
    lines = [x.text for x in main_lines(page)[0]]
    assert lines[0] == "Brücke" and len(lines) == 5
    monkeypatch.setattr(main_content, "densities", lambda body, title="", real=main_content.densities: (real(body, title) and body, 0.0))
    assert len(main_lines(page)[0]) > 5
