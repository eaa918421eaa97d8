import os
import random
from collections import Counter

import numpy as np
import pytest

from siltloom.llm import tokenizer as tok
from siltloom.llm.packing import document_items, fill_containers, fill_report, pack
from siltloom.llm.text_quality import FUNCTION_WORDS, PROFILES, describe, distributions, divergence, fit_profiles, nearest, not_prose, text_statistics
from siltloom.llm.truncation import open_structure, shape, truncated, truncation_rates

needs_files = pytest.mark.skipif(not os.path.exists(f"{tok.FOLDER}/{tok.NAME}.tiktoken"), reason="no tokenizer files")
DOCS = "doc_id bigint, text string, lang string, ids string, n_tokens string, profile string"


def docs(spark, *texts, lang="de"):
    return spark.createDataFrame([(i, t, lang, "clash", None, None) for i, t in enumerate(texts)], DOCS)


NASTY = ["", None, " ", "a" * 5000, "ab" * 3000, "<|endoftext|>", "Grüße, Straße! 12345 don't  \n\n x", "👩‍👩‍👧 日本語  \xa0", "\x00\x7f", "\r\n \t", "word " * 50_000, "Donaudampfschifffahrtsgesellschaft"]


@needs_files
def test_ids_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tok.FOLDER}/{tok.NAME}.json")
    t.encode_special_tokens = True
    rng = random.Random(4)
    texts = NASTY + ["".join(rng.choice("ab cé日́ \n\t1٣²😀<|>\xa0ßÀ.,!’'sreßöTh") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    got = {r["doc_id"]: list(r["ids"]) for r in tok.encode(docs(spark, *texts)).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tok.encode(docs(spark, *texts), only_count=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tok.encode(docs(spark)).count() == 0


@needs_files
def test_stores_are_bounded(monkeypatch):
    monkeypatch.setattr(tok, "MAX_PAIRS", 50)
    monkeypatch.setattr(tok, "MAX_WORDS", 100)
    bpe, whole = tok.SpeculativeBpe(f"{tok.FOLDER}/{tok.NAME}.tiktoken"), tok.SpeculativeBpe(f"{tok.FOLDER}/{tok.NAME}.tiktoken")
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeinrst") for _ in range(rng.randint(2, 9))) for _ in range(30)) for _ in range(40)]
    expected = [whole.encode_batch([t])[0] for t in texts]
    assert [bpe.encode_batch([t])[0] for t in texts] == expected and len(bpe.pairs) < 50 + 400 and len(bpe.words) <= 100


@needs_files
def test_speculation_is_verified():
    b = tok.SpeculativeBpe(f"{tok.FOLDER}/{tok.NAME}.tiktoken")
    words = [" " + w for w in "Ausstellung Überarbeitung Wochenmarkt the bridge rénovation aaaaaaaa xyzzyx".split()]
    found = b.learn(words)
    assert all(found[w] == b.exact(w.encode()) for w in words)
    assert 0 < b.merged < len(words)  # some proposals hold, some don't
    assert all(b"".join(b.bytes_of[t] for t in ids).decode() == w for w, ids in found.items())
    old = tok.MAX_WORDS
    try:
        tok.MAX_WORDS = 3  # a full store starts anew, with the same results
        assert b.encode_batch(["a b c d e f", "g h a b"]) == [[*map(b.ranks.get, (b"a", b" b", b" c", b" d", b" e", b" f"))], [*map(b.ranks.get, (b"g", b" h", b" a", b" b"))]]
    finally:
        tok.MAX_WORDS = old


def _check(rows, items, capacity):
    boxes, parts = {}, {}
    for r in rows:
        boxes.setdefault(r["container_id"], []).append(r)
        parts.setdefault(r["doc_id"], []).append(r)
    assert all(sum(x["n_tokens"] for x in b) <= capacity for b in boxes.values())
    assert parts.keys() == items.keys()
    for d, p in parts.items():
        p.sort(key=lambda x: x["part_no"])
        assert sum(x["n_tokens"] for x in p) == items[d] and len(p) == max(1, -(-items[d] // capacity))
        assert [x["start_token"] for x in p] == [i * capacity for i in range(len(p))]
    return boxes


def test_containers(spark):
    rng = random.Random(9)
    sizes = {i: rng.choice([0, 1, 7, 64, 65, 300, rng.randrange(1, 60)]) for i in range(3000)}
    items = spark.createDataFrame([(i, n, n) for i, n in sizes.items()], "doc_id bigint, n_tokens bigint, n_loss bigint")
    kinds = spark.createDataFrame([("a", 64), ("b", 1000), ("none", 0), ("null", None)], "container_kind string, capacity_tokens int")
    out = fill_containers(items, kinds, shard_items=500).collect()
    assert {r["container_kind"] for r in out} == {"a", "b"}
    for kind, capacity in (("a", 64), ("b", 1000)):
        boxes = _check([r for r in out if r["container_kind"] == kind], sizes, capacity)
        parts = sorted((min(capacity, n - at) for n in sizes.values() for at in range(0, max(n, 1), capacity)), reverse=True)
        rooms = []  # first fit decreasing
        for n in parts:
            k = next((k for k, room in enumerate(rooms) if room >= n), None)
            if k is None:
                rooms.append(capacity - n)
            else:
                rooms[k] -= n
        assert len(boxes) <= 1.01 * len(rooms) + 1
    report = {r["container_kind"]: r for r in fill_report(fill_containers(items, kinds)).collect()}
    assert report["a"]["n_tokens"] == sum(sizes.values()) and report["a"]["n_containers"] >= report["a"]["least_containers"]
    assert fill_containers(items.limit(0), kinds).count() == 0 and fill_containers(items, kinds.limit(0)).count() == 0


def test_containers_with_several_limits(spark):
    rng = random.Random(10)
    items = spark.createDataFrame([(i, rng.randrange(1, 90), 0) for i in range(800)], "doc_id bigint, n_tokens bigint, n_loss bigint").selectExpr("doc_id", "n_tokens", "n_tokens div 2 as n_loss")
    kinds = spark.createDataFrame([("a", 100)], "container_kind string, capacity_tokens int")
    boxes = {}
    for r in fill_containers(items, kinds, max_segments=3, max_loss_share=0.5).collect():
        boxes.setdefault(r["container_id"], []).append(r)
    assert sum(map(len, boxes.values())) == 800
    assert all(len(b) <= 3 and sum(x["n_loss"] for x in b) <= 50 and sum(x["n_tokens"] for x in b) <= 100 for b in boxes.values())


def test_pack_against_lower_bound():
    sizes = np.array([51] * 20 + [49] * 20 + [0] * 3)
    box = pack(sizes, sizes, 100)
    assert box.max() + 1 == 20 and np.bincount(box, weights=sizes).max() <= 100


@needs_files
def test_documents_into_containers(spark):
    df = docs(spark, *NASTY)
    kinds = spark.createDataFrame([("small", 512)], "container_kind string, capacity_tokens int")
    items = {r["doc_id"]: r["n_tokens"] for r in document_items(df).collect()}
    _check(fill_containers(document_items(df), kinds).collect(), items, 512)


PROSE = [
    "Trotz mancher Bedenken verschiebt der Sportverein auch die Lesung mit Musik.",
    "“We are glad that so many local clubs have come,” said Ilkorn Ollanti\nof Tollgarth. The work will cost 4142 in total, of which the town of\nTollgarth is going to pay about half.",
    "– In der Stadthalle wird am 14. März wieder gesungen.\n– Bereits zum 80. Mal trägt der Ort gemeinsam mit der Nachbargemeinde ein solches Vorhaben.",
    "Le conseil soutient la rénovation du gymnase, pour que chacun puisse participer. L'accès est gratuit.\n- Le marché\n- La piste\nOn ne sait pas encore si le programme d'été aura lieu l'an prochain.",
    "Neues aus dem Rathaus\nDer Umweltausschuss plant den Umbau des Marktplatzes hinter dem Bahnhof, damit alle kommen können.",
    "﻿Das\xa0Angebot\xa0ist​ bis auf Weiteres geschlossen, sobald die Arbeiten am Kanal abgeschlossen sind.",
]
OTHER = [
    "Nr.;Raum;Linie\nSüdhang;6253;9484\nMusik;320,00 €;19:10\nTür;6719;x", "| Ort | Nr. |\n| --- | --- |\n| Garden | 9238 |\n| Club | 16:50 |", "Datum         Raum          Nr.\nRoofs         18:00         x\nClub          12:55         8867",
    "1. Den Wochenmarkt\n2. Die Erneuerung der Brücke\n3. Das Ferienlager", "My account »\nNews »\nSearch\nJobs", "qlzntrsjdvfd wmkjhwzckg ngtv xkljcctvmksrn zgplrqnsj zgqmrzmchcvb", "https://a.example/ca35r2?sid=ee14b33b\nhttps://a.example/8tuw70?sid=4a90fe6d",
    ".x { margin: 4px; color: #eedbd0; }\n.y { margin: 16px; color: #ce3ac5; }", "2025-08-24 07:25 [info] GET /19s9g 333 1698ms\n2025-09-15 13:35 [warn] GET /kz53 255 8320ms", "function f(a){return a&&a[1]!==94?null:{k:943};}", "#####_____.....~~~~~*****=====",
    "Hall\n25\nGym\n63\nRoom\n51", "wochenmarkt, foyer, orgelkonzert, ferienlager, suedhang, radweg, musik", "Orlulf Velderau, Zi. 237, 0000 23379\nWesorn Drusk, Zi. 324, 0000 57005", "67185364 296583 2050578 82551 450 3360787 1 757572",
    "QCPQtFOhBMoJtAWmpIQP/ZROh787DndWuUSFrhABhCaRXT6CuVdZY1oz2b6FQzqg==", "Tšo€Ÿ m€ŸcŸ¼¶¼B�denš¶nš�esÂ¼l¶eßt¼dŸ� GšeÂ¼hsÂe¼ŸuÂ¶¶steÂÃÂ¼auc� diŸ¼SpÂ€¼h",
    "Die Kosten liegen bei 4887 Euro.\nOrt\tRaum\tZeit\tPreis\nTür\t16.10.\t5212\t04.10.\nMusik\t12:20\t–\tx\nRadweg\t4181\t7365\t640,48 €\nFoyer\t7338\t19:05\t673,57 €",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert describe(text)["profile"].startswith("prose")


@pytest.mark.parametrize("text", OTHER)
def test_no_prose(text):
    assert not describe(text)["profile"].startswith("prose")


def test_statistics(spark):
    d = describe("The cat sat. The dog ran!\nNo stop", "en")
    assert (d["n_words"], round(d["mean_word_length"], 3), d["terminated_lines"], d["common_words"]) == (8, 3.0, 0.5, 3 / 8)
    assert describe(None)["profile"] == describe("")["profile"] == describe(" \n\t")["profile"] == "empty"
    assert describe("Der Rat hat die Brücke im Herbst eröffnet, weil das Wetter es zulässt und alle mit dabei sind.")["profile"] == "prose_de"
    assert len(text_statistics(docs(spark, *NASTY)).collect()) == len(NASTY)
    assert {r[0] for r in not_prose(docs(spark, *PROSE, *OTHER, None, "")).collect()} == set(range(len(PROSE), len(PROSE) + len(OTHER)))
    assert not_prose(docs(spark)).count() == 0


def test_profiles_are_distributions():
    assert all(abs(sum(x) - 1) < 1e-9 for parts in PROFILES.values() for x in parts)
    assert divergence((1.0, 0.0), (0.0, 1.0)) == 1.0 and divergence((0.5, 0.5), (0.5, 0.5)) == 0.0
    assert all(len(x) > 50 for x in FUNCTION_WORDS.values())
    fitted = fit_profiles([(x, "prose_de") for x in PROSE] + [(x, "list") for x in OTHER])
    assert set(fitted) == {"prose_de", "list"} and all(0.5 < sum(x) < 1 + 1e-9 for parts in fitted.values() for x in parts)
    with pytest.raises(ValueError):
        fit_profiles([("a", "list")] * 10_001)


def test_divergence_decides():
    """No distribution decides alone: texts turn over with any two of the words, the characters and the lines."""
    text = "Am Kanal wird am 3. Mai wieder gesungen, gelesen und gelacht."
    words, characters, shapes = distributions(text, [text], Counter(text.split()), Counter(text))
    assert nearest((words, characters, shapes))[0] == "prose_de"
    w, c, x = PROFILES["table"]
    strange = {k: w for k in words}
    for seen in ((strange, c, shapes), (strange, characters, x), (words, c, x)):
        assert nearest(seen)[0] == "table"
    for seen in ((strange, characters, shapes), (words, c, shapes), (words, characters, x)):
        assert nearest(seen)[1] > nearest((words, characters, shapes))[1]


def test_structure():
    assert open_structure("<p>a <b>b</b>") == (True, False) and open_structure("<p>a<br></p>") == (False, False)
    assert open_structure("„a (b") == (False, True) and open_structure("„a“ (b) «c»") == (False, False)
    for text in ("Das Bau<", "Some 87 wo&uu", "abgebr�", "abc<a hre", "text \\u00", "so 100%C3%A"):
        assert shape(text)["broken"], text
    for text in ("AT & T", "100 %", "a < b", "fertig.", "%%TITEL%%"):
        assert not shape(text)["broken"] or text == "100 %", text
    for text in ("Konzert mit R&B", "Mode von H&M", "A&O", "Salle &", "Ein b&b", "Müller & Söhne", "Q&A"):
        assert not shape(text)["broken"], text
    for text in ("Stra&szli", "f&uu", "nach &nb", "gro&", "Gr&uu", "x &#22"):
        assert shape(text)["broken"], text
    assert not shape("a" * 200_000 + "1")["broken"] and not shape("&" * 5000)["mark"]
    assert shape("Und dann ...")["mark"] and shape("Ende.“")["stop"] and not shape("am 14.")["stop"]


def test_sentence_ends():
    from siltloom.llm.truncation import name_set, tokens

    assert tokens("Inscription le 4.9., tél. 1069") == (["inscription", "le", "9", "9", "tél", "9"], [False] * 6)
    assert tokens("Ein Satz. Noch einer! „Und“ z. b. so")[1] == [False, True, False, True, False, False, False, False]
    names = name_set(("Beta-Ville", "Alpha"))
    assert tokens("In Beta-Ville und ALPHA, Alphabet", names)[0] == ["in", "@", "und", "@", "alphabet"]
    assert tokens("") == ([], []) and len(name_set(tuple(map(str, range(9000))))) == 9000


def test_keys_of_words_and_beginnings():
    """The arrays hold what a loop over the words finds."""
    from siltloom.llm.truncation import Words, _hash, _keys

    u = np.uint64
    everything = Words(frozenset(["beta"]), lambda q: np.ones(len(q), bool))
    t = everything.flat(["Ein Satz hier. Noch einer in Beta", "", "x 12", "Ein Satz dort"])
    assert t["text"].tolist() == [0] * 7 + [2] * 2 + [3] * 3 and np.flatnonzero(t["stop"]).tolist() == [2] and np.flatnonzero(t["last"]).tolist() == [6, 8, 11]
    assert t["first"].tolist() == [True] * 3 + [False] * 4 + [True] * 5
    assert t["h"][6] == _hash("@") and t["h"][8] == _hash("9") and t["c1"][0] == t["c2"][0] == t["c2"][1] == _hash("^") and t["c2"][2] == _hash("ein")
    assert t["start"][2] == t["start"][11] and t["start"][1] != t["start"][2] and t["start"][0] == t["start"][7] == 0
    assert everything.begun[t["w"][1]] == tuple(_hash(x) for x in ("s", "sa", "sat"))
    assert _keys(2, u(1), u(2)) != _keys(2, u(2), u(1)) != _keys(3, u(2), u(1))


TEASERS = "teaser_id bigint, url string, title string, introtext string, sp_source string, n string, cap string"


def test_truncation(spark, sites):
    rng = random.Random(6)
    who = ["Der Rat", "Das Bauamt", "Die Musikschule", "Der Verein"]
    what = ["die Ausstellung im Foyer", "den Wochenmarkt am Kanal", "das Orgelkonzert", "die Erneuerung der Brücke"]
    why = ["weil die Nachfrage gestiegen ist", "damit auch Berufstätige kommen können", "sobald die Arbeiten am Kanal abgeschlossen sind"]
    sentence = lambda: f"{rng.choice(who)} erläutert {rng.choice(what)}, {rng.choice(why)}."
    rows, cases = [], set()
    for i in range(1500):
        source = rng.choice(["s_a", "s_b"])
        intro, title = " ".join(sentence() for _ in range(rng.randint(1, 3))), f"{rng.choice(who)} eröffnet {rng.choice(what)}"
        x = rng.random()
        if x < 0.04 and source == "s_a" and len(intro) > 125:
            intro = intro[:120]
            cases.add((i, "introtext"))
        elif x < 0.08 and len(intro) > 125:
            intro = intro[:117] + "..."
            cases.add((i, "introtext"))
        elif x < 0.10:
            intro = intro[:40].rsplit(" ", 1)[0] + " Bau<"
            cases.add((i, "introtext"))
        elif x < 0.16:
            intro = rng.choice(["Eintritt frei, Parkplätze am Kurpark", f"Kosten: {rng.randrange(9999)} Euro", "Und dann war es still in Alpha...", f"<p>{intro}</p>"])
        elif x < 0.18:
            title = title[: rng.randint(12, len(title) - 3)].rstrip()
            if title.endswith(tuple("abcdefghijklmnoprstuvwxyzäöü")) and not any(title.endswith(w) for w in (*what, "Foyer", "Kanal", "Brücke", "Ausstellung", "Wochenmarkt", "Erneuerung")):
                cases.add((i, "title"))
            else:
                title = "Der Rat eröffnet das Orgelkonzert"
        rows.append((i, f"https://a.example/{i}", title, intro, source, "clash", None))
    rows += [(9000, None, None, None, None, None, None), (9001, "", " ", "", "gone", None, None), (9002, "u", "x" * 100_000, "y" * 100_000 + ".", "s_b", None, None)]
    df = spark.createDataFrame(rows, TEASERS)
    got = {tuple(r) for r in truncated(df, sites).collect() if r[0] < 9000}
    hit = len(got & cases)
    assert hit >= 0.9 * len(cases) and hit >= 0.9 * len(got), (len(cases), len(got), hit)
    rates = {(r["sp_source"], r["field_name"]): r["n_values"] for r in truncation_rates(df, sites).collect()}
    assert rates["s_a", "title"] + rates["s_b", "title"] == 1501
    assert truncated(df.limit(0), sites).count() == 0


def test_three_limits_over_all_documents(spark):
    from pyspark.sql import functions as F

    from siltloom.llm.packing import pack, prompted_items
    from siltloom.llm.queries import queries

    d = "/root/testdata/sf0.001"
    got = queries()["p9_limits"](spark, d)
    boxes = got.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t"), F.sum("n_loss").alias("l"), F.count("*").alias("n"), F.max("capacity").alias("c")).collect()
    assert boxes and all(b["t"] <= b["c"] and b["l"] <= b["c"] and b["n"] <= 8 for b in boxes) and any(b["n"] == 8 for b in boxes)
    items = prompted_items(spark.read.parquet(f"{d}/documents.parquet"))
    kinds = spark.read.parquet(f"{d}/container_sizes.parquet").count()
    assert got.agg(F.sum("n_tokens")).head()[0] == kinds * items.agg(F.sum("n_tokens")).head()[0]
    with pytest.raises(ValueError):
        pack(np.array([5]), np.array([5]), 8, None, 4)


def test_structure_decides_before_counts(spark, sites):
    """What the automaton or the terminators of the source decide is not asked of the corpus."""
    from siltloom.llm.truncation import judge_values

    good = [(i, f"u{i}", f"Der Verein {i} lädt ein", f"Im Saal {i} gibt es Kaffee. Es wird gesungen.", "a") for i in range(40)]
    bad = [(100, "v1", "Der Chor (mit Gästen", "Im Saal gibt es <b>Kaffee", "a"), (101, "v2", "Ein Lied f&uu", "Es wird gesungen. Im Saal gibt", "a"), (102, "v3", "„Wir kommen", None, "a")]
    df = spark.createDataFrame([(*x, None, None) for x in good + bad], TEASERS)
    got = {(r["teaser_id"], r["field"]): (r["is_cut"], r["step"]) for r in judge_values(df, sites).collect()}
    assert [got[k] for k in ((100, "title"), (100, "introtext"), (101, "title"), (102, "title"))] == [(True, "structure")] * 4
    assert got[101, "introtext"] == (True, "baseline") and got[0, "introtext"] == (False, "structure") and got[0, "title"] == (False, "contexts")


def test_patterns_are_linear():
    """Long runs of one sign take no longer than their length."""
    import time

    from siltloom.llm.residue import title_is_residue

    began = time.perf_counter()
    for text in ("a" * 50_000, "* " * 50_000 + "x", "!" * 50_000 + "x", "a" * 50_000 + "1", "x" + " " * 50_000 + "x", "\n" * 50_000 + "x"):
        describe(text), shape(text), title_is_residue(text)
    assert time.perf_counter() - began < 10
