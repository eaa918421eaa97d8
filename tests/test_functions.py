import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltloom.functions.css import SelectorError, select
from siltloom.functions.html import page_lines, parse
from siltloom.functions.instants import UNLIKELY, readings
from siltloom.functions.robots import Rule, parse_robots, to_regex
from siltloom.functions.text import decode_entities, strip_tags
from siltloom.functions.urls import resolve, sanitise, strip_parameters
from siltloom.operators.timestamps import best_path


def test_page_lines():
    page = "<head><title>t</title></head><p>A <b>b</b>c&nbsp; d<br>e</p><script>x<y</script><noscript>n</noscript><!-- <p>c</p> --><div> </div><td>1 &lt; 2</td>"
    assert page_lines(page) == ["A bc d", "e", "1 < 2"]
    assert page_lines("") == page_lines(None) == []
    assert page_lines("plain < text") == ["plain < text"]
    assert page_lines("<p>open<p>tags") == ["open", "tags"]


@given(st.text(alphabet="<>/abp \"'=&;!-\n", max_size=80))
@settings(max_examples=200, deadline=None)
def test_html_never_raises(text):
    parse(text).text()
    page_lines(text)
    strip_tags(text)


def test_tree_repairs():
    root = parse("<ul><li>a<li>b</ul><p>x<div>y</div></i>z")
    assert [n.text() for n in root.walk() if n.tag == "li"] == ["a", "b"]
    assert [n.tag for n in root.kids if not isinstance(n, str)] == ["ul", "p", "div"]


def test_selectors():
    root = parse('<div id=content><h1 class="a b">T</h1><p>1</p><p class=c>2 <a href="https://x" rel="me you">l</a></p><ul><li>i<li>j</ul></div>')
    text = lambda s: [n.text() for n in select(root, s)]
    assert text("h1 + p") == ["1"] and text("#content > p.c") == ["2 l"] and text("a[href^='https'], h1.a.b") == ["T", "l"]
    assert text("p:not(.c)") == ["1"] and text("h1 ~ p") == ["1", "2 l"] and text("li:nth-child(2)") == text("li:last-child") == ["j"]
    assert text("[rel~=you]") == ["l"] and text("a[href*=x]") == ["l"] and text("a[href$=y]") == [] and text("div li:first-child") == ["i"]
    for bad in ("", "a >", "> a", "a:hover", "a[", "p::before", "a,,b"):
        with pytest.raises(SelectorError):
            list(select(root, bad))


def test_urls():
    assert sanitise("https://u:p@h:8080/a?x=1&b[]=2&b[]=3&x=4#f") == "https://h:8080/a?x=4&b%5B0%5D=2&b%5B1%5D=3#f"
    assert sanitise("https://h/a?#") == "https://h/a" and sanitise("//h/x") == "//h/x" and sanitise("x") == "x"
    assert strip_parameters("nonsense", ()) == "://nonsense"
    assert strip_parameters("https://h/?utm[a]=1&b=2", ("utm",)) == "https://h/?b=2"
    once = sanitise("https://h/p?a.b=1&c d=ü")
    assert sanitise(once) == once
    assert resolve("https://h/a/b?q#f", "") == "https://h/a/b?q#f" and resolve("https://h/a/b", "../c") == "https://h/c" and resolve("https://h/a", "?x=1") == "https://h/a?x=1"


def test_markup_and_entities():
    assert strip_tags("a<b title='>'>c</b><!-- x > -->d < e<f") == "acd < e"
    assert decode_entities("&uuml;&amp;&#65;&#x41;&copy &bogus; &#0;") == "ü&AA&copy &bogus; &#0;"


def test_robots():
    text = "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nDisallow:\nDisallow: /z # c"
    assert parse_robots(text, "B/1.0") == [Rule(False, "/x"), Rule(True, "/x/y")]
    assert parse_robots(text, "other") == [Rule(False, "/z")] and parse_robots("", "x") == []
    assert to_regex("/a*b$") == "^/a.*b$"


BERLIN = "Europe/Berlin"


@pytest.mark.parametrize(
    ("value", "utc"),
    [
        ("2024-05-30T08:21:35Z", 1717057295), ("2023-11-03T20:59:48", 1699041588), ("1589019627", 1589019627), ("1589019627123", 1589019627.123), ("1589019627123456", 1589019627.123456),
        ("02. Nov. 2021 01:40", 1635813600), ("31.08.2021, 22.43 Uhr", 1630442580), ("Wed, 30 Oct 2024 10:13:00 +0100", 1730279580), ("17 août 2019", 1565992800), ("20241213 0512", 1734063120),
        ("2020-03-20 22:46:26.707+01", 1584740786.707), ("09.08.2024 08:51:53 CEST", 1723186313), ("2021-05-30T19:25:54+02:00[Europe/Berlin]", 1622395554), ("7 mai 2023 à 18h07", 1683475620),
        ("Dec 13, 2024, 3:07:55 am", 1734055675), ("Sunday, August 25, 2024 at 9:28 p.m.", 1724614080), ("2.9.24", 1725228000), ("2023-05-08T06:44:14,669615000Z[UTC]", 1683528254.669615),
        ("\xa02022-03-15T19:23:12+01:00 ", 1647368592), ("2024-07-08t13:20:51z", 1720444851),
    ],
)
def test_readings(value, utc):
    found = [x for x in readings(value, BERLIN, "dmy") if x.cost < UNLIKELY]
    assert [x.utc_us for x in found] == [round(utc * 1e6)] and found[0].certain


@pytest.mark.parametrize("value", [None, "", "  ", "n/a", "vor 3 Tagen", "31.02.2024", "2024-13-05", "2025-06-10T25:61:00", "14:30 Uhr", "Q3/2024", "{{ datum }}", "2023-03-26 02:30", "heute, 14 Uhr", "0" * 500])
def test_no_readings(value):
    assert readings(value, BERLIN, "dmy") == []


def test_ambiguous_readings():
    both = readings("2023-10-29 02:30", BERLIN, "dmy")
    assert len(both) == 2 and not any(x.certain for x in both)
    assert len(readings("05/04/2020", "UTC", None)) == 2 and len(readings("05/05/2020", "UTC", None)) == 1
    known = readings("05/04/2020", "UTC", "mdy")  # the other order is a reading, too, but dearer than any path
    assert [(x.utc_us, x.cost) for x in known] == [(1588550400000000, 0.0), (1586044800000000, UNLIKELY)] and readings("25/04/2020", "UTC", "mdy") == []
    assert [(x.utc_us, x.cost) for x in readings("1589019627", "UTC", None)][0] == (1589019627000000, 0.0) and len(readings("1589019627", "UTC", None)) == 3
    assert {x.utc_us // 60_000_000 % 1440 for x in readings("2024-01-10 10:00 IST", "UTC", None)} == {270, 540, 480}
    assert [x.cost for x in readings("2024-01-10 10:00 IST", "Asia/Jerusalem", None)] == [UNLIKELY, UNLIKELY, 0.0]
    long = "Donnerstag, den 12. September 2024 um 10:00:00.123456789 Uhr GMT+02:00 [America/Argentina/ComodRivadavia]"
    assert len(long) > 80 and [x.utc_us for x in readings(long, "UTC", "dmy")] == [1726128000123456]
    assert readings("2020-01-01 10:00", None, "dmy") == []


def test_viterbi_against_brute_force():
    import itertools

    import numpy as np

    from siltloom.operators.timestamps import BACK, SWITCH, block_matrix, choose_ends

    rng = random.Random(5)
    for _ in range(200):
        steps = []
        for k in (rng.randint(1, 3) for _ in range(rng.randint(2, 6))):
            steps.append((np.array([rng.randrange(3) for _ in range(k)]), np.array([rng.randrange(50) for _ in range(k)]), np.array([rng.choice([0.0, 0.5, 4.0]) for _ in range(k)])))

        def cost(path, steps=steps):
            seq = [(f[k], t[k]) for (f, t, _), k in zip(steps, path)]
            return sum((a[0] != b[0]) + 0.5 * (b[1] < a[1]) for a, b in zip(seq, seq[1:])) + sum(c[k] for (_, _, c), k in zip(steps, path))

        every = list(itertools.product(*[range(len(x[0])) for x in steps]))
        best = min(map(cost, every))
        assert cost(best_path(steps)) == best
        ends = rng.choice(every)[0], rng.choice(every)[-1]
        assert cost(best_path(steps, *ends)) == min(cost(p) for p in every if (p[0], p[-1]) == ends)
        # blocks cut anywhere give a path of the same cost
        at = rng.randint(1, len(steps) - 1)
        parts = [steps[:at], steps[at:]]
        fixed = choose_ends([(*x[0][:2], *x[-1][:2], block_matrix(x)) for x in parts])
        assert cost([k for x, (i, j) in zip(parts, fixed) for k in best_path(x, i, j)]) == best
        # what is dearer than any path can gain is on no best path
        kept = [np.flatnonzero(c <= c.min() + 2 * (SWITCH + BACK)) for _, _, c in steps]
        assert min(cost([k[i] for k, i in zip(kept, p)]) for p in itertools.product(*[range(len(k)) for k in kept])) == best


def test_loose_dates():
    from siltloom.functions.loose_dates import parse_loose

    now = datetime(2026, 3, 4, 15, 30)
    at = lambda v: None if (us := parse_loose(v, now)) is None else (datetime(1970, 1, 1) + timedelta(microseconds=us)).isoformat(" ")
    cases = {
        "yesterday noon": "2026-03-03 12:00:00", "+1 week": "2026-03-11 15:30:00", "next monday": "2026-03-09 00:00:00", "first day of next month": "2026-04-01 15:30:00", "@86400": "1970-01-02 00:00:00",
        "January 5, 2024 3:04 pm": "2024-01-05 15:04:00", "10:15": "2026-03-04 10:15:00", "2024-02-31 10:00": "2024-03-02 10:00:00", "last day of february 2024": "2024-02-29 00:00:00",
        "2026-07-14 10:00 EST": "2026-07-14 15:00:00", "14.01.26": "2026-03-04 14:01:26", "14.01.78": "1978-01-14 00:00:00", "32.01.2026": None, "2026-13-01": None, "14 märz 2024": None, "x" * 9999: None, None: None,
    }
    assert {v: at(v) for v in cases} == cases
