from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltloom.config import FieldSpec, ScoreRule, Scoring, SiteConfig
from siltloom.operators import urls as U
from siltloom.operators.clean import clean_teasers
from siltloom.operators.discover import MissingPage, discover, explode_links
from siltloom.operators.extract import dom_pass, guard
from siltloom.operators.index import Index, documents
from siltloom.operators.score import relevant
from siltloom.plans.pipeline import extract_teasers, run_all, run_site, teasers_of
from siltloom.schemas import DOCUMENTS, TEASERS
from siltloom.sources.fetch import Response, RobotsTexts, Throttle, fetch_live, backoff_schedule, next_wait, request
from siltloom.sources.pages import fetch_pages, successful

B = "https://example.com"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def urls(spark, *us):
    return spark.createDataFrame(list(enumerate(us)), "ord bigint, url string")


def test_url_filters(spark):
    df = urls(spark, f"{B}/a.PDF?x", f"{B}/b", None, "javascript:x", f"{B}/b")
    assert rows(U.ordered_distinct(df.where("url is not null")), "ord") == [(0, f"{B}/a.PDF?x"), (1, f"{B}/b"), (3, "javascript:x")]
    assert [r[1] for r in rows(U.drop_endings(df, (".pdf",)), "ord")] == [f"{B}/b", None, "javascript:x", f"{B}/b"]
    assert U.keep_allowed(df, ()).count() == 5 and U.keep_allowed(df, (B,)).count() == 3 and U.drop_denied(df, ("java",)).count() == 3
    assert U.first_k(df, 0).count() == 0
    assert {r[1] for r in rows(U.with_forced(U.first_k(df, 1), ("f", "f")))} == {f"{B}/a.PDF?x", "f"}


def test_native_rewrite_equals_codec(spark):
    us = [f"{B}/p?a=1&b=2", f"{B}/p?a=1&a=2", f"{B}?x=1", f"{B}:80/p?b=&c=x.y#t", f"{B}/p#", f"{B}/p?", "nonsense", f"{B}/p?q", f"https://u@h/p?b=1", f"{B}/ü?b=1"]
    got = {o: u for o, u in rows(U.rewrite(urls(spark, *us), ("b",)))}
    from siltloom.functions.urls import sanitise, strip_parameters

    assert got == {i: strip_parameters(sanitise(u), ("b",)) for i, u in enumerate(us)}


def test_robots(spark):
    df = urls(spark, f"{B}/x/1", f"{B}/x/y/1", f"{B}/", f"{B}/x/1")
    text = "User-agent: *\nDisallow: /x\nAllow: /x/y"
    assert [r[1] for r in rows(U.robots_filter(df, text, "Crawler/1.0"), "ord")] == [f"{B}/x/y/1", f"{B}/"]
    assert U.robots_filter(df, None, "Crawler/1.0").count() == 3


def page(spark, *pairs):
    return spark.createDataFrame(list(pairs), "url string, html string")


def site(**k):
    return SiteConfig(id="s", **k)


def test_discovery(spark):
    config = site(start_urls=((f"{B}/", 0),), max_teaser=999, allow_prefixes=(B,))
    cases = {
        f'<div id="content"><a href="{B}/page1">1</a><a href="{B}/u/page2">2</a><a href="/relative">3</a></div>': ["/page1", "/u/page2", "/relative"],
        '<a href="javascript:void(0)">x</a>': [], "": [], '<div id=content><a href="/a"></a><a href="/a"></a></div>': ["/a", "/a"],
    }
    for html, expected in cases.items():
        assert [r[1] for r in rows(discover(page(spark, (f"{B}/", html)), config), "ord")] == [B + x for x in expected]
    assert discover(page(spark, (f"{B}/", "")), site()).count() == 0
    with pytest.raises(MissingPage):
        discover(page(spark, ("x", "")), config)
    assert discover(page(spark, ("x", "")), config, "skip").count() == 0
    assert explode_links(page(spark, ("u", None), ("v", "<a href=x>"), (f"{B}/", "<a href=x>")), "", "a[href]").count() == 1


def test_nothing_is_loaded_beyond_the_cap(spark):
    pages = page(spark, (f"{B}/", '<div id=content><a href="/a"></a><a href="/missing"></a></div>'), (f"{B}/a", '<div id=content><a href="/b"></a></div>'))
    found = lambda n: [r[1] for r in rows(discover(pages, site(start_urls=((f"{B}/", 1),), max_teaser=n)), "ord")]
    assert found(1) == [B + "/a"] and found(2) == [B + "/a", B + "/missing"] and found(3) == [B + "/a", B + "/missing", B + "/b"] and found(0) == []
    with pytest.raises(MissingPage):
        found(4)
    two = site(start_urls=((f"{B}/", 0), (f"{B}/", 1)), max_teaser=3)
    assert [r[1] for r in rows(discover(pages, two), "ord")] == [B + x for x in ("/a", "/missing", "/a", "/missing", "/b")]


def test_latest_page_is_taken(spark):
    at = lambda d: datetime(2024, 1, d)
    pages = spark.createDataFrame([(1, "u", "b", at(3)), (2, "u", "a", at(2)), (3, "v", "x", at(1)), (4, "v", None, at(1)), (5, None, "n", at(1))], "page_id bigint, url string, html string, fetched_at timestamp")
    assert sorted(tuple(r) for r in fetch_pages(urls(spark, "u", "v", "w"), pages).collect()) == [("u", "b"), ("v", None)]


def test_snapshots_are_versions(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index")
    index.replace(docs(spark, "r1", ("a", "A")), "s")
    old = index.read("s")
    index.replace(docs(spark, "r2", ("a", "B"), ("c", "C")), "s")
    assert rows(old.select("id", "title")) == [("a", "A")]  # a reader of the old snapshot goes on
    assert rows(index.read("s").select("id", "title")) == [("a", "B"), ("c", "C")] and index.status("s") == (2, 2, 0) and index.status("t") is None
    index.replace(docs(spark, "r3", ("d", "D")), "s")
    assert len([x for x in (tmp_path / "index" / "source=s").iterdir() if x.is_dir()]) == 2
    bad = spark.createDataFrame([("a",)], "id string").select("id", F.raise_error(F.lit("no")).alias("title"))
    with pytest.raises(Exception):
        index.replace(docs(spark, "r4", ("e", "E")).drop("title").join(bad, "id", "left"), "s")
    assert rows(index.read("s").select("id")) == [("d",)]


def test_two_starts_keep_their_order(spark):
    pages = page(spark, (f"{B}/1", '<div id=content><a href="/x"></a><a href="/y"></a></div>'), (f"{B}/2", '<div id=content><a href="/y"></a><a href="/z"></a></div>'))
    config = site(start_urls=((f"{B}/2", 0), (f"{B}/1", 0)), max_teaser=3)
    assert [r[1] for r in rows(U.final_urls(discover(pages, config), config), "ord")] == [B + "/y", B + "/z", B + "/x"]


EXTRACT = site(title=FieldSpec(True, opengraph=("og:title",), css=("h1", "#content h1", "h1.h1"), max_chars=200), intro=FieldSpec(True, css=(".introText",), max_chars=200))


def test_extract_cases(spark):
    head = '<meta property="og:title" content="Meta Title">'
    body = '<h1>Main Heading</h1><p class="introText">Intro</p>'
    got = extract_teasers(page(spark, ("1", head + body), ("2", body), ("3", "<p>x</p>"), ("4", ""), ("5", None), ("6", "0"), ("7", "x" * 2_000_001), ("8", "<h1>T</h1>")), EXTRACT)
    assert rows(got.select("url", "title", "introText")) == [("1", "Meta Title", "Intro"), ("2", "Main Heading", "Intro")]
    assert extract_teasers(page(spark), EXTRACT).count() == 0
    assert extract_teasers(page(spark, ("1", body)), EXTRACT.with_(title=FieldSpec(False))).count() == 0


def test_one_python_pass(spark):
    plan = teasers_of(page(spark, ("1", "")), EXTRACT)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("ArrowEvalPython") == 1
    config = site(allow_prefixes=(B,), deny_prefixes=("x",), deny_endings=(".pdf",))
    plan = U.normalise_urls(urls(spark, B), config)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_guard_is_below_the_pass(spark, data):
    plan = dom_pass(spark.read.parquet(f"{data}/pages_in.parquet"), EXTRACT)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(html)" in plan and "ReadSchema: struct<url:string,html:string>" in plan
    assert guard(page(spark, ("a", "0"), ("b", "ü" * 1_000_001))).count() == 0


def test_clean_cases(spark):
    raw = spark.createDataFrame(
        [("1", "<p>Hello <b>World</b></p>", "<p>Dies</p>"), ("2", "<script>a</script>Test", None), ("3", " &uuml;b ", ""), ("4", None, "x"), ("5", "  ", "x"), ("6", "a" * 200, "<i></i>"), ("7", "a\xa0 b\t\n c", "1 < 2")],
        "url string, title string, introText string",
    ).withColumn("datetime", F.lit(None).cast("timestamp"))
    assert [r[:3] for r in rows(clean_teasers(raw))] == [("1", "Hello World", "Dies"), ("2", "Test", None), ("3", "üb", None), ("6", "a" * 120 + "...", ""), ("7", "a\xa0 b c", "1 < 2")]
    assert clean_teasers(spark.createDataFrame([], TEASERS)).count() == 0


def test_relevance(spark):
    t = spark.createDataFrame([("u", "A  Needle", None, "body"), ("u#x", "needle", None, ""), ("f", "needle", None, ""), ("e", "x", None, "")], "url string, title string, introText string, body_text string")
    rules = Scoring(True, 3, (ScoreRule(5, ("a needle", "needle")),), (ScoreRule(-1, (), 3),))
    assert [r[0] for r in rows(relevant(t, rules, ("f",)))] == ["u", "u#x"]
    assert relevant(t, Scoring()).count() == 4
    blank = Scoring(True, 1, (ScoreRule(1, (" ",)),))
    assert relevant(t, blank).count() == 3  # white space is found anywhere, the fragment costs two


def test_fetch(spark):
    assert fetch_pages(urls(spark, "a", "a", "z"), page(spark, ("a", "2"), ("a", "1"), ("b", "x"))).collect() == [("a", "1")]
    r = spark.createDataFrame([("a", 200, None, "x", None), ("b", 404, None, "x", None), ("c", 200, None, None, "failed")], "url string, status int, retry_after string, body string, error string")
    assert successful(r).collect() == [("a", "x")]
    assert backoff_schedule(500, 4) == [500, 1000, 2000] and backoff_schedule(5, 0) == []
    assert next_wait({"retry-after": "2"}, 9) == 2000 and next_wait({"Retry-After": "soon"}, 9) == 9
    calls, waits = [], []

    def send(url):
        calls.append(url)
        if len(calls) == 1:
            raise OSError
        return Response(503, {"Retry-After": "1"}) if len(calls) == 2 else Response(200, {}, "ok")

    config = site(max_retry=3, delay_ms=100, retry_status_codes=(503,))
    assert request(send, "u", config, waits.append).body == "ok" and waits == [0.1, 1.0]
    assert request(send, "u", site(max_retry=0)) is None
    assert request(lambda u: Response(503, {}), "u", config, waits.append).status == 503
    now, slept = [0.0], []
    throttle = Throttle(500, lambda: now[0], slept.append)
    for u in ("https://a/1", "https://b/1", "https://a/2", "nohost"):
        throttle.wait(u)
    assert slept == [0.5]


def docs(spark, run, *pairs):
    t = spark.createDataFrame([(u, x, None, None) for u, x in pairs], "url string, title string, introText string, datetime timestamp")
    return documents(t, "s", run, True, True)


def test_index(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index")
    assert index.read("s").count() == 0
    assert index.replace(docs(spark, "r1", ("a", "A"), ("b", "B"), ("a", "A2")), "s") == (3, 3, 0)
    assert rows(index.read("s").select("id", "title")) == [("a", "A2"), ("b", "B")]
    failed = spark.createDataFrame([("c",)], "id string")
    assert index.replace(docs(spark, "r2", ("b", "B2"), ("c", "C")), "s", failed) == (2, 1, 1)
    assert rows(index.read("s").select("id", "title")) == [("a", "A2"), ("b", "B2")]
    index.replace(docs(spark, "r3"), "s", None, False)
    assert index.read("s").count() == 2
    index.replace(docs(spark, "r3"), "s")
    assert index.read("s").count() == 0
    assert documents(spark.createDataFrame([("u", "t", "0", "2020-01-02")], "url string, title string, introText string, date string"), "s", "r", True, True).select("sp_intro", "sp_date").first()[0] is None


def test_date_is_only_read_where_asked(spark):
    t = spark.createDataFrame([("u", "t", "i")], "url string, title string, introText string").withColumn("datetime", F.to_timestamp(F.lit("2020-01-02")))
    assert documents(t, "s", "r", True, True).first()["sp_date"] is None
    assert documents(t, "s", "r", True, True, "datetime").first()["sp_date"].year == 2020
    assert documents(t, "s", "r", True, True).schema.simpleString() == spark.createDataFrame([], DOCUMENTS).schema.simpleString()


def test_run_site_and_batch(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    pages = page(spark, (f"{B}/", '<div id=content><a href="/a">a</a></div>'), (f"{B}/a", "<h1>A</h1>"))
    config = site(start_urls=((f"{B}/", 0),), title=FieldSpec(True, css=("h1",)))
    assert run_site(spark, config, pages, index) == (1, 1, 0)
    # a failed discovery goes on with nothing, which wipes the source unless that is refused
    broken = config.with_(start_urls=((f"{B}/gone", 0),))
    assert run_site(spark, broken, pages, index, allow_empty_snapshot=False) == (0, 0, 0) and index.read("s").count() == 1
    assert run_site(spark, broken, pages, index) == (0, 0, 0) and index.read("s").count() == 0
    assert run_all(spark, {}, str(tmp_path), pages, index) == 0
    assert run_all(spark, {"sites": [{"siteKey": ""}]}, str(tmp_path), pages, index) == 1
    assert run_all(spark, {"sites": [{"siteKey": "none"}]}, str(tmp_path), pages, index) == 1


def test_a_run_leaves_no_work_folders(spark, tmp_path):
    from siltloom.session import _made

    before = list(_made(spark))
    pages = page(spark, (f"{B}/", '<div id=content><a href="/a">a</a></div>'), (f"{B}/a", "<h1>A</h1>"))
    index = Index(spark, f"file://{tmp_path}/w")
    run_site(spark, site(start_urls=((f"{B}/", 0),), title=FieldSpec(True, css=("h1",))), pages, index)
    assert _made(spark) == before and index.read("s").count() == 1


def test_batch_parses_pages_once_and_asks_robots(spark, tmp_path):
    for key, section in (("one", "#content"), ("two", "#content")):
        (tmp_path / f"{key}.yaml").write_text(
            f"parameters:\n  id: {key}\n  start_urls: ['{B}/']\n  title.css: [h1]\n  respect_robots_txt: {'true' if key == 'two' else 'false'}\n  robots_url: {B}/robots.txt\n  link_section: '{section}'\n"
        )
    asked = []

    def load(url):
        asked.append(url)
        return "User-agent: *\nDisallow: /x"

    pages = page(spark, (f"{B}/", '<div id=content><a href="/a">a</a><a href="/x/b">b</a></div>'), (f"{B}/a", "<h1>A</h1>"), (f"{B}/x/b", "<h1>B</h1>"))
    index = Index(spark, f"file://{tmp_path}/batch")
    assert run_all(spark, {"sites": [{"siteKey": "one"}, {"siteKey": "two"}]}, str(tmp_path), pages, index, load) == 0
    assert asked == [f"{B}/robots.txt"] and index.status("one").total == 2 and index.status("two").total == 1


def test_live_source_in_a_run(spark, tmp_path):
    def sender(agent):
        return lambda url: Response(200, {}, f"<h1>Live {url[-1]}</h1>") if url.endswith("a") else Response(404, {}, "no")

    pages = page(spark, (f"{B}/", '<div id=content><a href="/a">a</a><a href="/b">b</a></div>'))
    index = Index(spark, f"file://{tmp_path}/live")
    config = site(start_urls=((f"{B}/", 0),), title=FieldSpec(True, css=("h1",)))
    assert run_site(spark, config, pages, index, make_send=sender) == (1, 1, 0)
    assert [r["title"] for r in index.read("s").collect()] == ["Live a"]


def test_work_folder_needs_a_shared_one_on_a_cluster(spark):
    from types import SimpleNamespace

    from siltloom.session import work_folder

    conf = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        work_folder(fake, "x")


def test_robots_texts_are_kept():
    asked = []

    def load(url):
        asked.append(url)
        if "bad" in url:
            raise OSError
        return " User-agent: * "

    texts = RobotsTexts(load)
    assert [texts.get(u) for u in ("a", "a", "bad", "bad", None)] == ["User-agent: *"] * 2 + [None] * 3 and asked == ["a", "bad"]


def test_live_fetch_keeps_hosts_together(spark):
    def sender(agent):
        def send(url):
            if "boom" in url:
                raise ValueError(agent)
            return Response(200, {"Retry-After": "7"}, f"{agent} {url}")

        return send

    df = urls(spark, f"{B}/1", f"{B}/2", "https://other.example/1", f"{B}/boom", "nohost")
    got = {r["url"]: r for r in fetch_live(df, site(user_agent="me"), sender).collect()}
    assert len(got) == 5 and got[f"{B}/1"]["body"] == f"me {B}/1" and got[f"{B}/1"]["retry_after"] == "7"
    assert got[f"{B}/boom"]["status"] is None and got[f"{B}/boom"]["error"] == "me"
    assert successful(spark.createDataFrame(list(got.values()))).count() == 4


def test_robots_in_a_run(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/r")
    pages = page(spark, (f"{B}/", '<div id=content><a href="/a">a</a><a href="/x/b">b</a></div>'), (f"{B}/a", "<h1>A</h1>"), (f"{B}/x/b", "<h1>B</h1>"))
    config = site(start_urls=((f"{B}/", 0),), title=FieldSpec(True, css=("h1",)), respect_robots_txt=True, robots_url=f"{B}/robots.txt")
    assert run_site(spark, config, pages, index, "User-agent: *\nDisallow: /x") == (1, 1, 0)
    assert run_site(spark, config, pages, index, None) == (2, 2, 0)


def test_streaming_processes_each_page_once(spark, tmp_path):
    from siltloom.streaming.incremental import page_stream, stream_teasers

    config = site(title=FieldSpec(True, css=("h1",)))
    rows = spark.createDataFrame([(1, "u1", "s", "<h1>A</h1>", None)], "page_id bigint, url string, sp_source string, html string, fetched_at timestamp")
    rows.write.parquet(f"file://{tmp_path}/in", mode="append")
    for more in (False, True):
        if more:
            rows.withColumn("url", F.lit("u2")).write.parquet(f"file://{tmp_path}/in", mode="append")
        stream_teasers(page_stream(spark, f"file://{tmp_path}/in"), config, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["u1", "u2"]
