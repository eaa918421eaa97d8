"""The queries of the core, by name, with SQL for those that SQL can express.

Queries over tables read whole tables. Edge cases that the tables don't hold are small literal tables on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltloom.config import DateSpec, FieldSpec, Reader, ScoreRule, Scoring, SiteConfig, site_config
from siltloom.functions.text import collapse_ascii, trim, truncate_clean, truncate_field
from siltloom.operators import urls as U
from siltloom.operators.clean import clean_teasers
from siltloom.operators.discover import crawl, explode_links, link_graph
from siltloom.operators.extract import dom_pass, guard, parse_date, teaser_columns
from siltloom.operators.index import Index, documents
from siltloom.operators.score import relevant, score
from siltloom.operators.snapshots import snapshot_changes
from siltloom.operators.timestamps import normalise, timestamp_values
from siltloom.plans import page_sql
from siltloom.plans.pipeline import extract_teasers, run_site, teasers_of
from siltloom.pointer import Pointer
from siltloom.session import read_table, ship_package, work_folder
from siltloom.sources.fetch import Response, backoff_schedule, next_wait, request
from siltloom.sources.pages import chunked, fetch_pages, successful
from siltloom.streaming.incremental import page_stream, stream_teasers

#: The configuration of the flagship run over stored pages.
SITE = SiteConfig(
    id="all_sites",
    title=FieldSpec(True, opengraph=("og:title",), css=("h1", "h2", ".hl"), max_chars=120),
    intro=FieldSpec(True, css=(".introText", "article p", "#content p", "section p", "p"), max_chars=200),
    datetime=DateSpec(False, True, (), (".date",)),
)
RULES = Scoring(
    True, 4,
    (ScoreRule(6, ("Kaffee und Kuchen", "brass band")), ScoreRule(3, ("bridge", "Brücke", "passerelle")), ScoreRule(2, ("the",))),
    (ScoreRule(-3, ("vorerst gesperrt", "closed"), 350), ScoreRule(-1, ("http",))),
)
ALLOW, DENY, ENDINGS, STRIP = ("https://portal.", "https://stadt-", "https://www."), ("https://www.p", "https://portal.k"), (".PHP", "-lesung"), ("seite", "view")
ROBOTS = """
User-agent: *
Disallow: /presse/
Disallow: /kultur
Allow: /kultur/so-geht
Disallow: /*.php$

User-agent: other
Disallow: /
"""


def _ord_urls(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages_in").select(F.col("page_id").alias("ord"), "url")


def _literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    ship_package(spark)
    return spark.createDataFrame(rows, schema)


def url_scheme_filter(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "teasers_raw").where(F.startswith("url", F.lit("https://"))).select("teaser_id", "url")


def url_allow_prefix(spark: SparkSession, d: str) -> DataFrame:
    return U.keep_allowed(_ord_urls(spark, d), ALLOW)


def url_deny_prefix(spark: SparkSession, d: str) -> DataFrame:
    return U.drop_denied(_ord_urls(spark, d), DENY)


def url_deny_endings(spark: SparkSession, d: str) -> DataFrame:
    return U.drop_endings(_ord_urls(spark, d), ENDINGS)


def url_strip_params(spark: SparkSession, d: str) -> DataFrame:
    return U.rewrite(_ord_urls(spark, d), STRIP)


EDGE = [
    (1, "https://u:p@h.example:8080/a?x=1&b[]=2&b[]=3&x=4#f", "https://h.example:8080/a?b%5B0%5D=2&b%5B1%5D=3#f"),
    (2, "https://h.example/a?#", "https://h.example/a"),
    (3, "https://h.example/p?q", "https://h.example/p?q="),
    (4, "https://h.example/p?a.b=1&c d=2&x=9", "https://h.example/p?a_b=1&c_d=2"),
    (5, "https://h.example/p?m[k][n]=1&m[k][o]=2", "https://h.example/p?m%5Bk%5D%5Bn%5D=1&m%5Bk%5D%5Bo%5D=2"),
    (6, "https://h.example:99999/", "https://h.example:99999/"),
    (7, "https://h.example/p?s=a+b%20c&t=%C3%BC", "https://h.example/p?s=a+b+c&t=%C3%BC"),
    (8, "https://h.example/p?x=1&y=2#top", "https://h.example/p?y=2#top"),
    (9, "https://h.example", "https://h.example"),
]


def url_sanitize_edge(spark: SparkSession, d: str) -> DataFrame:
    return U.rewrite(_literal(spark, [(i, u) for i, u, _ in EDGE], "ord bigint, url string"), ("x",))


def url_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return U.ordered_distinct(_ord_urls(spark, d))


def url_topk(spark: SparkSession, d: str) -> DataFrame:
    return U.first_k(U.ordered_distinct(_ord_urls(spark, d)), 20)


FORCED = ("https://forced.example/one", "https://forced.example/two", "https://forced.example/one")


def url_forced_union(spark: SparkSession, d: str) -> DataFrame:
    return U.with_forced(U.first_k(U.ordered_distinct(_ord_urls(spark, d)), 50), FORCED).select("url")


def url_pipeline(spark: SparkSession, d: str) -> DataFrame:
    config = SITE.with_(allow_prefixes=ALLOW, deny_prefixes=DENY, deny_endings=ENDINGS, strip_query_params_active=True, strip_query_params=STRIP, max_teaser=300, forced_article_urls=FORCED)
    return U.final_urls(_ord_urls(spark, d), config).select("url")


def robots_filter(spark: SparkSession, d: str) -> DataFrame:
    return U.robots_filter(_ord_urls(spark, d), ROBOTS, "Crawler/1.0")


def robots_unavailable(spark: SparkSession, d: str) -> DataFrame:
    return U.robots_filter(_ord_urls(spark, d), None, "Crawler/1.0")


def links_all(spark: SparkSession, d: str) -> DataFrame:
    return explode_links(guard(read_table(spark, d, "pages_in")), "", "a[href]")


def links_distinct(spark: SparkSession, d: str) -> DataFrame:
    return links_all(spark, d).groupBy("dst_url").agg(F.count("*").alias("n_links"), F.countDistinct("src_url").alias("n_pages"))


_B = "https://g.example"
GRAPH = [
    (f"{_B}/", '<div id="content"><a href="/a">a</a><a href="b">b</a><a href="/a">again</a><a href="javascript:x()">js</a><a href="http://g.example/plain">no</a></div><a href="/out">out</a>'),
    (f"{_B}/a", '<div id="content"><a href="/c">c</a><a href="/">home</a><a href="/b#top">b</a><a href="/private/x">p</a></div>'),
    (f"{_B}/b", '<div id="content"><a href="?page=2">next</a><a href="/c">c</a></div><div id="content"><a href="/d">d</a></div>'),
    (f"{_B}/c", '<div id="content"><a href="/e">e</a></div>'),
    (f"{_B}/b#top", '<div id="content"></div>'),
    (f"{_B}/b?page=2", "no scope"),
    (f"{_B}/d", None),
    (f"{_B}/e", '<div id="content"><a href="/f">f</a></div>'),
    (f"{_B}/private/x", ""),
]
BFS = {
    "bfs_depth0": (0, 999, ["/a", "/b", "/a"]),
    "bfs_depth1": (1, 999, ["/a", "/b", "/a", "/c", "/", "/b#top", "/b?page=2", "/c", "/d"]),
    "bfs_depth2": (2, 999, ["/a", "/b", "/a", "/c", "/", "/b#top", "/b?page=2", "/c", "/d", "/e"]),
    "bfs_limit": (2, 5, ["/a", "/b", "/a", "/c", "/"]),
}


def _bfs(depth: int, limit: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        config = SITE.with_(start_urls=((f"{_B}/", depth),), max_teaser=limit, allow_prefixes=(_B,), deny_prefixes=(f"{_B}/private",))
        found = crawl(link_graph(_literal(spark, GRAPH, "url string, html string"), config.link_section, config.link_selector), _literal(spark, [(0, f"{_B}/", depth)], "start int, url string, max_depth int"), config)
        return found.select(F.row_number().over(Window.orderBy(F.size("path"), "path")).cast("bigint").alias("n"), "url")

    return run


def fetch_join(spark: SparkSession, d: str) -> DataFrame:
    return fetch_pages(read_table(spark, d, "teasers_raw"), read_table(spark, d, "pages_in")).select("url", F.octet_length("html").alias("n_bytes"))


RESPONSE_ROWS = [
    ("https://h.example/1", 200, None, "ok", None), ("https://h.example/2", 404, None, "no", None), ("https://h.example/3", 299, None, "edge", None),
    ("https://h.example/4", 300, None, "moved", None), ("https://h.example/5", 200, None, None, "body failed"), ("https://h.example/6", None, None, None, None),
]


def fetch_status_filter(spark: SparkSession, d: str) -> DataFrame:
    return successful(_literal(spark, RESPONSE_ROWS, "url string, status int, retry_after string, body string, error string"))


def fetch_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunked(_ord_urls(spark, d), 3)


def fetch_backoff(spark: SparkSession, d: str) -> DataFrame:
    rows = [(f"delay {a} x{n}", i, w) for a, n in ((500, 4), (0, 3), (100, 1), (100, 0)) for i, w in enumerate(backoff_schedule(a, n))]
    rows += [("retry-after", i, next_wait({"Retry-After": v}, 70)) for i, v in enumerate(("3", "", "Wed, 21 Oct 2015 07:28:00 GMT", "0"))]
    return _literal(spark, rows, "kind string, n int, wait_ms int")


def fetch_status_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages as responses of many a status, some with an error."""
    pages = read_table(spark, d, "pages_in")
    responses = pages.select("url", (F.lit(198) + F.col("page_id") % 110).cast("int").alias("status"), F.lit(None).cast("string").alias("retry_after"), F.col("html").alias("body"), F.when(F.col("page_id") % 13 == 0, "reset").alias("error"))
    return successful(responses).select("url", F.octet_length("html").alias("n_bytes"))


def fetch_retries(spark: SparkSession, d: str) -> DataFrame:
    """A request for every page, of which the first few fail: attempts, last status and time waited."""
    config = SITE.with_(max_retry=3, delay_ms=100, retry_status_codes=(503,))

    def run(batches):
        for pdf in batches:
            rows = []
            for key in pdf["page_id"].tolist():
                calls, waits = [], []

                def send(url, key=key, calls=calls):
                    calls.append(url)
                    if len(calls) > key % 5:
                        return Response(200, {}, "ok")
                    return Response(503, {"Retry-After": "2"} if key % 7 == 0 else {})

                last = request(send, str(key), config, waits.append)
                rows.append((key, len(calls), last.status, round(1000 * sum(waits))))
            yield pd.DataFrame(rows, columns=["page_id", "attempts", "status", "waited_ms"])

    return read_table(spark, d, "pages_in").select("page_id").mapInPandas(run, "page_id bigint, attempts int, status int, waited_ms int")


def page_guard(spark: SparkSession, d: str) -> DataFrame:
    return guard(read_table(spark, d, "pages_in")).select("page_id", F.octet_length("html").alias("n_bytes"))


def _moment(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    return extract_teasers(read_table(spark, d, "pages_in"), SITE).withColumn("datetime", _moment("datetime"))


CASCADE_CONFIG = SITE.with_(
    title=FieldSpec(True, False, "N: ", ("og:title",), ("h1", "#content h1", "h1.h1"), 20),
    intro=FieldSpec(True, True, "", (), (".introText", "p + p"), 200),
    datetime=DateSpec(True, True, ("article:published",), (".date", "time")),
)
CASCADE_PAGES = [
    ("u1", '<meta property="og:title" content="Meta Title"><h1>Other</h1><p class=introText> In  tro </p><p class="date">2026-01-14</p>'),
    ("u2", '<h1>Main Heading</h1><p class=introText>I</p><time datetime="2026-01-14T10:00:00+01:00">x</time>'),
    ("u3", "<p class=introText>only text</p><p class=date>2026-01-14</p>"),
    ("u4", ""),
    ("u5", '<meta property="og:title" content="  "><h1>A heading that is far too long</h1><p>a</p><p>second</p><p class="date" datetime="">2026-01-14</p><time>14.01.2026</time>'),
    ("u6", "<h1>No intro</h1><p class=date>2026-01-14</p>"),
    ("u7", "<h1>No date</h1><p class=introText>I</p>"),
    ("u8", "<h1>Bad date</h1><p class=introText>I</p><p class=date>soon</p>"),
    ("u9", '<meta name="og:title" content="name is no property"><h1>Named &amp; <b>bold</b></h1><p class=introText>I</p><p class=date>14.01.2026 08:30</p>'),
    ("u10", None),
]


def extract_cascade(spark: SparkSession, d: str) -> DataFrame:
    pages = _literal(spark, CASCADE_PAGES, "url string, html string")
    return extract_teasers(pages, CASCADE_CONFIG).select("url", "title", "introText", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("moment"))


#: Relative dates count from 2026-03-04 15:30.
DATES = [
    ("2026-01-14", "2026-01-14 00:00:00"), ("2026-01-14T10:00:00+01:00", "2026-01-14 09:00:00"), ("2026-01-14 10:00:00", "2026-01-14 10:00:00"),
    ("Wed, 14 Jan 2026 10:00:00 +0000", "2026-01-14 10:00:00"), ("14.01.2026", "2026-01-14 00:00:00"), ("tomorrow", "2026-03-05 00:00:00"), ("2026-02-30", "2026-03-02 00:00:00"), ("14. Januar 2026", None),
    ("3 days ago", "2026-03-01 15:30:00"), ("last friday", "2026-02-27 00:00:00"), ("2026-01-14 10:00 Europe/Berlin", "2026-01-14 09:00:00"), ("soon", None),
]


def extract_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = [(raw, parse_date(raw, now=datetime(2026, 3, 4, 15, 30))) for raw, _ in DATES]
    return _literal(spark, rows, "raw string, us bigint").select("raw", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("moment"))


def truncate_40(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", truncate_field(F.col("text"), 40).alias("short"))


def truncate_uncapped(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", truncate_field(F.col("text"), 0).alias("short"))


def clean_truncate(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "teasers_raw").select("teaser_id", truncate_clean(F.col("introtext")).alias("short"))


def clean_text_ws(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", trim(collapse_ascii(F.col("text"))).alias("cleaned"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", F.coalesce("url", F.lit("")).alias("url"), F.lit("News").alias("title"), F.lit(None).cast("string").alias("introText"), F.col("text").alias("body_text"))


def score_rules(spark: SparkSession, d: str) -> DataFrame:
    return score(_scored(spark, d), RULES).select("doc_id", "score")


def score_filter(spark: SparkSession, d: str) -> DataFrame:
    return relevant(_scored(spark, d), RULES).select("doc_id")


def score_reasons(spark: SparkSession, d: str) -> DataFrame:
    return score(_scored(spark, d), RULES).select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


def score_pages(spark: SparkSession, d: str) -> DataFrame:
    raw = teaser_columns(dom_pass(read_table(spark, d, "pages_in"), SITE), SITE)
    return score(raw, RULES).select("url", "score", F.array_join("reasons", "; ").alias("reasons"))


SCORE_EDGE = [("https://f.example/#x", "Brass  BAND", None, ""), ("https://f.example/forced", "brass band", "bridge", ""), ("https://f.example/s", "the", None, "short"), ("https://f.example/e", "x", None, "")]


def score_edge(spark: SparkSession, d: str) -> DataFrame:
    rows = _literal(spark, SCORE_EDGE, "url string, title string, introText string, body_text string")
    kept = relevant(rows, Scoring(True, -10, RULES.positive, RULES.negative), ("https://f.example/forced",))
    return score(kept, RULES).select("url", "score", F.array_join("reasons", "; ").alias("reasons"))


CLEAN_ROWS = [
    ("1", "<h2>Neues <i>aus</i> Grau</h2>", "<div>Im Saal wird <em>wieder</em> gesungen.</div>"), ("2", "<script>let a = 1 < 2</script>Markt", "<STYLE media=all>p{}</STYLE>Kurz gesagt"),
    ("3", "  &Ouml;ffnung ", "t&auml;glich, au&szlig;er  <b>montags</b>"), ("4", "", "ohne Titel"), ("5", "   ", "   "), ("6", "z" * 200, "y" * 300),
    ("7", '<a title="a > b" href=x>Link</a>', '<i lang="de">Ein <b>Wort</b> mehr</i>'), ("8", "3 < 4 &lt;i&gt; &reg y", ""), ("9", "<!-- weg -->U<img alt='>'>", "<u"),
]


def clean_html_golden(spark: SparkSession, d: str) -> DataFrame:
    rows = _literal(spark, CLEAN_ROWS, "url string, title string, introText string").withColumn("datetime", F.to_timestamp(F.lit("2012-10-12 00:00:00")))
    return clean_teasers(rows).select("url", "title", "introText", F.date_format("datetime", "yyyy-MM-dd").alias("day"))


def index_documents(spark: SparkSession, d: str) -> DataFrame:
    teasers = read_table(spark, d, "teasers_raw").select("url", "title", F.col("introtext").alias("introText"), F.col("harvested_at").alias("datetime"))
    return documents(teasers, "source_x", "run-1", True, True, "datetime").withColumns(
        {"sp_source": F.array_join("sp_source", ","), "sp_date": F.date_format("sp_date", "yyyy-MM-dd HH:mm:ss")}
    )


def index_no_date(spark: SparkSession, d: str) -> DataFrame:
    teasers = read_table(spark, d, "teasers_raw").select("url", "title", F.col("introtext").alias("introText"), F.col("harvested_at").alias("datetime"))
    return documents(teasers, "source_x", "run-1", False, True).select("id", "title", "sp_intro", F.date_format("sp_date", "yyyy").alias("sp_year"))


def _docs(spark: SparkSession, rows: list, run: str) -> DataFrame:
    teasers = _literal(spark, [(u, t, None, None) for u, t in rows], "url string, title string, introText string, datetime timestamp")
    return documents(teasers, "s", run, True, False)


def _snapshot(second: list, failed: list | None, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        index = Index(spark, work_folder(spark, "index"))
        index.replace(_docs(spark, [("a", "A1"), ("b", "B1"), ("c", "C1")], "r1"), "s")
        index.replace(_docs(spark, [("z", "other")], "r1"), "t")
        index.replace(_docs(spark, second, "r2"), "s", None if failed is None else _literal(spark, [(x,) for x in failed], "id string"), **options)
        return index.read("s").unionByName(index.read("t")).select("id", "title", "crawl_process_id")

    return run


SNAPSHOTS = {
    "index_snapshot_replace": (_snapshot([("b", "B2"), ("d", "D2")], None), [("b", "B2", "r2"), ("d", "D2", "r2"), ("z", "other", "r1")]),
    "index_empty_snapshot": (_snapshot([], None), [("z", "other", "r1")]),
    "index_empty_refused": (_snapshot([], None, allow_empty_snapshot=False), [("a", "A1", "r1"), ("b", "B1", "r1"), ("c", "C1", "r1"), ("z", "other", "r1")]),
    "index_partial_failure": (_snapshot([("b", "B2"), ("d", "D2")], ["d"]), [("a", "A1", "r1"), ("b", "B2", "r2"), ("c", "C1", "r1"), ("z", "other", "r1")]),
}

CONFIG_VALUES = {"i": 5, "is": "12", "neg": "-3", "b": True, "bs": "TRUE ", "bi": 1, "s": "x", "n": "  y ", "e": "   ", "li": [3, "1", 2.9, "x", 3], "ls": ["a", "", 1], "lm": ["", 0, "q"], "nil": None}
CONFIG_READS = [
    ("i", "int", "5"), ("is", "int", "12"), ("neg", "int", "7"), ("b", "int", "7"), ("nil", "int", "7"), ("b", "bool", "True"), ("bs", "bool", "True"), ("bi", "bool", "False"),
    ("s", "string", "x"), ("i", "string", "d"), ("n", "nullable", "y"), ("e", "nullable", "None"), ("li", "int_list", "(1, 2, 3)"), ("ls", "string_list", "('a',)"), ("lm", "mixed_list", "(0, 'q')"),
]


def config_readers(spark: SparkSession, d: str) -> DataFrame:
    r = Reader(CONFIG_VALUES)
    read = {
        "int": lambda k: r.int(k, 7), "bool": lambda k: r.bool(k, False), "string": lambda k: r.string(k, "d"), "nullable": r.nullable_string,
        "int_list": r.int_list, "string_list": r.string_list, "mixed_list": r.mixed_list,
    }
    return _literal(spark, [(k, kind, str(read[kind](k))) for k, kind, _ in CONFIG_READS], "key string, reader string, value string")


def config_sites(spark: SparkSession, d: str) -> DataFrame:
    """The registry's rows as untyped parameters, read into configurations."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key, name, base, lang, title, intro in pdf.itertuples(index=False, name=None):
                known = lambda x: None if pd.isna(x) else int(x)
                config, _ = site_config({
                    "id": key, "user_agent": name, "respect_robots_txt": "TRUE" if lang == "de" else 1, "robots_url": f"  {base}robots.txt ", "start_urls": [base, {"url": base, "extraction_depth": "2"}, {"url": 3}, 7],
                    "title.max_chars": known(title), "introText.max_chars": None if known(intro) is None else str(known(intro)), "deny_prefixes": ["", name, None], "max_teaser": "x",
                })
                rows.append((config.id, config.user_agent, config.respect_robots_txt, config.robots_url, len(config.start_urls), config.start_urls[1][1], config.title.max_chars, config.intro.max_chars, ",".join(config.deny_prefixes), config.max_teaser))
            yield pd.DataFrame(rows, columns=["id", "agent", "robots", "robots_url", "n_starts", "depth", "title_cap", "intro_cap", "denied", "max_teaser"])

    sites = read_table(spark, d, "sites").select("sp_source", "site_key", "base_url", "lang", "title_max_chars", "intro_max_chars")
    return sites.mapInPandas(run, "id string, agent string, robots boolean, robots_url string, n_starts int, depth int, title_cap int, intro_cap int, denied string, max_teaser int")


def clean_teasers_raw(spark: SparkSession, d: str) -> DataFrame:
    teasers = read_table(spark, d, "teasers_raw").select("url", "title", F.col("introtext").alias("introText"), F.col("harvested_at").alias("datetime"))
    return clean_teasers(teasers).select("url", "title", "introText")


def site_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Pages to index documents: guard, DOM pass, required fields, caps, cleaning, projection."""
    teasers = teasers_of(read_table(spark, d, "pages_in"), SITE)
    return documents(teasers, SITE.id, "run-1", True, False).withColumns({"sp_source": F.array_join("sp_source", ","), "sp_date": _moment("sp_date")})


def site_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole run over the literal graph: discovery, urls, fetch, teasers, snapshot."""
    pages = _literal(spark, [(u, None if h is None else f"<h1>Page {u}</h1>{h}") for u, h in GRAPH], "url string, html string")
    config = SITE.with_(id="g", start_urls=((f"{_B}/", 1),), max_teaser=9, intro=FieldSpec(False), title=FieldSpec(True, css=("h1",)))
    index = Index(spark, work_folder(spark, "index"))
    run_site(spark, config, pages, index)
    return index.read("g").select("id", "title")


#: Links of the whole page count, and no cap is set.
WHOLE = SITE.with_(link_section="", max_teaser=(1 << 31) - 1)


def _all_starts(spark: SparkSession, d: str, depth: int) -> DataFrame:
    """Every page's url as a start: no base url of a site is in the table, and few pages link to each other."""
    pages = read_table(spark, d, "pages_in")
    return pages.groupBy("url").agg(F.min("page_id").alias("start")).select("start", "url", F.lit(depth).alias("max_depth"))


def _crawled(spark: SparkSession, d: str, config: SiteConfig, depth: int) -> DataFrame:
    """Links found over the whole table, from every page, in the queue's order."""
    graph = link_graph(read_table(spark, d, "pages_in"), config.link_section, config.link_selector)
    found = crawl(graph, _all_starts(spark, d, depth), config, "skip")
    return found.select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("place"), "url")


def bfs_pages(spark: SparkSession, d: str) -> DataFrame:
    """From every page and the pages it links to, and those they link to."""
    return _crawled(spark, d, WHOLE, 2)


def bfs_pages_limit(spark: SparkSession, d: str) -> DataFrame:
    """As ``bfs_pages``, over prefixes, with a cap at which a start loads no more pages."""
    return _crawled(spark, d, WHOLE.with_(max_teaser=17, allow_prefixes=ALLOW, deny_prefixes=DENY), 2)


def site_run_pages(spark: SparkSession, d: str) -> DataFrame:
    """A whole run over the whole table: discovery, urls, fetch, teasers, snapshot."""
    index = Index(spark, work_folder(spark, "index"))
    run_site(spark, WHOLE, read_table(spark, d, "pages_in"), index, on_missing="skip", starts=_all_starts(spark, d, 1))
    return index.read(WHOLE.id).select("id", "title", "sp_intro")


def index_replace_docs(spark: SparkSession, d: str) -> DataFrame:
    """Index.replace over all documents: those of the runs without errors, then those of the others, which replace only what they hold.

    Of documents with one id the one indexed last holds.
    """
    docs = read_table(spark, d, "index_docs").withColumn("sp_date", F.lit(None).cast("timestamp"))
    runs = read_table(spark, d, "run_status").where("errors > 0").select("crawl_process_id")
    index, order = Index(spark, work_folder(spark, "index")), ["indexed_at", "entry_id"]
    index.replace(docs.join(runs, "crawl_process_id", "left_anti"), "all", order=order)
    late = docs.join(runs, "crawl_process_id", "left_semi")
    index.replace(late, "all", late.where("title is null or sp_intro is null").select("id").distinct(), order=order)
    return index.read("all").select("id", "title", "sp_intro")


def stream_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages as a stream from the table's own files that ends when all have been processed."""
    folder = work_folder(spark, "stream")
    table = f"{d.rstrip('/')}/pages_in.parquet"
    fs, path = Pointer(spark, d)._fs(table)
    pages = page_stream(spark, table) if fs.getFileStatus(path).isDirectory() else page_stream(spark, d, pattern="pages_in.parquet")
    stream_teasers(pages, SITE, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("url string, title string, introText string, datetime timestamp").parquet(f"{folder}/out").withColumn("datetime", _moment("datetime"))


def _instants(spark: SparkSession, d: str) -> DataFrame:
    values = timestamp_values(read_table(spark, d, "teasers_raw"), read_table(spark, d, "index_docs"))
    return normalise(values, read_table(spark, d, "sites"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).where("certain").select("origin", "record_key", "utc_us")


def p3_instants(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(read_table(spark, d, "index_docs"), read_table(spark, d, "run_status"))


LINKS_SQL = r"""
WITH hrefs AS (
  SELECT url AS src_url, replace(unnest(regexp_extract_all(html, '<a href="?([^">]*)"?>', 1)), '&amp;', '&') AS href
  FROM pages_in WHERE html IS NOT NULL AND html NOT IN ('', '0') AND strlen(html) <= 2000000
), links AS (
  SELECT src_url, CASE WHEN starts_with(href, '/') THEN regexp_extract(src_url, '^(https://[^/?#]+)', 1) || href ELSE href END AS dst_url FROM hrefs
)
SELECT dst_url, count(*) AS n_links, count(DISTINCT src_url) AS n_pages FROM links WHERE starts_with(dst_url, 'https://') GROUP BY dst_url
"""

P7_SQL = """
WITH runs AS (
  SELECT crawl_process_id, sp_source, row_number() OVER (PARTITION BY sp_source ORDER BY started_at, crawl_process_id) AS run_no
  FROM run_status WHERE errors = 0
), docs AS (
  SELECT r.sp_source, r.run_no, d.id, arg_max(struct_pack(a := d.title, b := d.sp_intro, c := d.sp_date, e := d.sp_objecttype), (d.indexed_at, d.entry_id)) AS body
  FROM index_docs d JOIN runs r ON r.crawl_process_id = d.crawl_process_id AND r.sp_source = d.sp_source[1]
  WHERE d.id IS NOT NULL GROUP BY 1, 2, 3
), pairs AS (
  SELECT coalesce(n.sp_source, o.sp_source) AS sp_source, coalesce(n.run_no, o.run_no + 1) AS run_no, coalesce(n.id, o.id) AS id,
    CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM docs o FULL OUTER JOIN docs n ON n.sp_source = o.sp_source AND n.run_no = o.run_no + 1 AND n.id = o.id
  WHERE o.id IS NULL OR n.id IS NULL OR o.body IS DISTINCT FROM n.body
)
SELECT p.sp_source, r.crawl_process_id, p.id, p.change_kind
FROM pairs p JOIN runs r ON r.sp_source = p.sp_source AND r.run_no = p.run_no WHERE p.run_no > 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        url_scheme_filter, url_allow_prefix, url_deny_prefix, url_deny_endings, url_strip_params, url_sanitize_edge, url_ordered_distinct, url_topk, url_forced_union, url_pipeline,
        robots_filter, robots_unavailable, links_all, links_distinct, fetch_join, fetch_status_filter, fetch_status_pages, fetch_retries, config_sites, clean_teasers_raw, fetch_chunks, fetch_backoff, page_guard, extract_pages, extract_cascade, extract_dates,
        truncate_40, truncate_uncapped, clean_truncate, clean_text_ws, score_rules, score_filter, score_reasons, score_pages, score_edge, clean_html_golden, index_documents, index_no_date,
        config_readers, site_pipeline, site_run, bfs_pages, bfs_pages_limit, site_run_pages, index_replace_docs, stream_pages, p3_found, p3_instants, p7_found,
    )
    return {f.__name__: f for f in plain} | {k: _bfs(n, limit) for k, (n, limit, _) in BFS.items()} | {k: f for k, (f, _) in SNAPSHOTS.items()}


def _values(columns: str, rows: list) -> str:
    """A literal table in SQL."""

    def one(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


def _starts(c: str, prefixes: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"starts_with({c}, '{p}')" for p in prefixes) + ")"


_PATH = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1))"
_NOT_ENDING = " AND ".join(f"NOT ends_with({_PATH}, '{e.lower()}')" for e in ENDINGS)
_STRIPPED = (
    r"regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN q = '' THEN '' ELSE '?' || q END || CASE WHEN f = '' THEN '' ELSE '#' || f END"
)
_QUERY = (
    r"ltrim(regexp_replace(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '(^|&)(seite|view)=[^&]*', '', 'g'), '&') AS q, "
    r"regexp_extract(url, '#(.+)$', 1) AS f"
)
_STRIP_SQL = f"SELECT page_id AS ord, {_STRIPPED} AS url FROM (SELECT page_id, url, {_QUERY} FROM pages_in)"
_SPACE = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TRIM = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11)"
_HAY = f"trim(regexp_replace(lower('News' || chr(10) || chr(10) || coalesce(text, '')), '{_SPACE}', ' ', 'g'), {_TRIM})"


def _rule_sql(rule: ScoreRule) -> str:
    parts = [f"contains(hay, '{n.lower()}')" for n in rule.match_any]
    if rule.body_text_length_lt is not None:
        parts.append(f"(n > 0 AND n < {rule.body_text_length_lt})")
    return "(" + " OR ".join(parts) + ")"


_RULES = (*RULES.positive, *RULES.negative)
_SCORE = " + ".join([f"CASE WHEN {_rule_sql(r)} THEN {r.score} ELSE 0 END" for r in _RULES] + ["CASE WHEN contains(url, '#') THEN -2 ELSE 0 END"])
_REASONS = ", ".join([f"CASE WHEN {_rule_sql(r)} THEN '{r.score:+d} \"{r.match_any[0]}\"' END" for r in _RULES] + ["CASE WHEN contains(url, '#') THEN '-2 \"Fragment-URL\"' END"])
_SCORED = f"(SELECT doc_id, coalesce(url, '') AS url, {_HAY} AS hay, length(trim(' ' || coalesce(text, ''), {_TRIM})) AS n FROM documents)"
_ROBOTS_RULES = """
  CASE WHEN starts_with(p, '/kultur/so-geht') THEN 15 ELSE -1 END >=
  greatest(CASE WHEN starts_with(p, '/presse/') THEN 8 ELSE -1 END, CASE WHEN starts_with(p, '/kultur') THEN 7 ELSE -1 END, CASE WHEN ends_with(p, '.php') THEN 7 ELSE -1 END)
"""


def oracle_sql() -> dict[str, str]:
    base = "SELECT page_id AS ord, url FROM pages_in"
    first = "SELECT min(page_id) AS ord, url FROM pages_in GROUP BY url"
    piped = (
        f"SELECT min(ord) AS ord, url FROM ({_STRIP_SQL}) WHERE {_starts('url', ALLOW)} AND NOT {_starts('url', DENY)} AND {_NOT_ENDING} GROUP BY url ORDER BY ord LIMIT 300"
    )
    forced = " UNION ".join(f"SELECT '{u}' AS url" for u in FORCED)
    trimmed = f"trim(text, {_TRIM})"
    out = {
        "url_scheme_filter": "SELECT teaser_id, url FROM teasers_raw WHERE starts_with(url, 'https://')",
        "url_allow_prefix": f"{base} WHERE {_starts('url', ALLOW)}",
        "url_deny_prefix": f"{base} WHERE NOT {_starts('url', DENY)}",
        "url_deny_endings": f"{base} WHERE {_NOT_ENDING}",
        "url_strip_params": _STRIP_SQL,
        "url_sanitize_edge": _values("ord, url", [(i, u) for i, _, u in EDGE]),
        "url_ordered_distinct": first,
        "url_topk": f"{first} ORDER BY ord LIMIT 20",
        "url_forced_union": f"SELECT url FROM ({first} ORDER BY ord LIMIT 50) UNION SELECT url FROM ({forced})",
        "url_pipeline": f"SELECT url FROM ({piped}) UNION SELECT url FROM ({forced})",
        "robots_filter": f"SELECT ord, url FROM (SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.]*://[^/?#]*([^#]*)', 1) AS p FROM ({first})) WHERE {_ROBOTS_RULES}",
        "robots_unavailable": first,
        "links_distinct": LINKS_SQL,
        "links_all": page_sql.LINKS,
        "fetch_join": page_sql.FETCHED,
        "fetch_status_pages": "SELECT url, strlen(html) AS n_bytes FROM pages_in WHERE 198 + page_id % 110 BETWEEN 200 AND 299 AND page_id % 13 <> 0 AND html IS NOT NULL",
        "fetch_retries": """SELECT page_id, least(page_id % 5 + 1, 3)::INT AS attempts, (CASE WHEN page_id % 5 < 3 THEN 200 ELSE 503 END)::INT AS status,
            (CASE WHEN page_id % 7 = 0 THEN 2000 * least(page_id % 5, 2) ELSE 100 * (pow(2, least(page_id % 5, 2)) - 1) END)::INT AS waited_ms FROM pages_in""",
        "config_sites": """SELECT sp_source AS id, site_key AS agent, lang = 'de' AS robots, base_url || 'robots.txt' AS robots_url, 2::INT AS n_starts, 2::INT AS depth,
            coalesce(title_max_chars, 120)::INT AS title_cap, coalesce(intro_max_chars, 120)::INT AS intro_cap, site_key AS denied, 100::INT AS max_teaser FROM sites""",
        "clean_teasers_raw": f"""SELECT * FROM (SELECT url, {page_sql.cleaned('title')} AS title, CASE WHEN introtext <> '' THEN {page_sql.cleaned('introtext')} END AS introText FROM teasers_raw)
            WHERE title <> ''""",
        "extract_pages": page_sql.EXTRACT,
        "score_pages": page_sql.scores(_SCORE, _REASONS, _SPACE),
        "site_pipeline": page_sql.DOCUMENTS,
        "stream_pages": page_sql.CLEAN,
        "bfs_pages": page_sql.crawled(2),
        "bfs_pages_limit": page_sql.crawled(2, 17, f"{_starts('h', ALLOW)} AND NOT {_starts('h', DENY)}"),
        "site_run_pages": page_sql.SITE_RUN,
        "index_replace_docs": page_sql.REPLACED,
        "fetch_status_filter": _values("url, html", [("https://h.example/1", "ok"), ("https://h.example/3", "edge")]),
        "fetch_chunks": "SELECT page_id AS ord, url, page_id // 3 AS chunk FROM pages_in",
        "fetch_backoff": _values(
            "kind, n, wait_ms",
            [("delay 500 x4", 0, 500), ("delay 500 x4", 1, 1000), ("delay 500 x4", 2, 2000), ("delay 0 x3", 0, 0), ("delay 0 x3", 1, 0), ("retry-after", 0, 3000), ("retry-after", 1, 70), ("retry-after", 2, 70), ("retry-after", 3, 0)],
        ),
        "page_guard": "SELECT page_id, strlen(html) AS n_bytes FROM pages_in WHERE html IS NOT NULL AND html NOT IN ('', '0') AND strlen(html) <= 2000000",
        "extract_cascade": _values(
            "url, title, introText, moment",
            [
                ("u1", "N: Meta Title", "In tro", "2026-01-14 00:00:00"), ("u2", "N: Main Heading", "I", "2026-01-14 09:00:00"), ("u5", "N: A heading that is...", "second", "2026-01-14 00:00:00"),
                ("u9", "N: Named & bold", "I", "2026-01-14 08:30:00"),
            ],
        ),
        "extract_dates": _values("raw, moment", DATES),
        "truncate_40": f"SELECT doc_id, CASE WHEN length({trimmed}) <= 40 THEN {trimmed} ELSE rtrim(substring({trimmed}, 1, 37), {_TRIM}) || '...' END AS short FROM documents",
        "truncate_uncapped": f"SELECT doc_id, {trimmed} AS short FROM documents",
        "clean_truncate": "SELECT teaser_id, CASE WHEN length(introtext) > 120 THEN substring(introtext, 1, 120) || '...' ELSE introtext END AS short FROM teasers_raw",
        "clean_text_ws": rf"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'), {_TRIM}) AS cleaned FROM documents",
        "score_rules": f"SELECT doc_id, ({_SCORE})::INT AS score FROM {_SCORED}",
        "score_filter": f"SELECT doc_id FROM {_SCORED} WHERE ({_SCORE}) >= {RULES.min_score}",
        "score_reasons": f"SELECT doc_id, concat_ws('; ', {_REASONS}) AS reasons FROM {_SCORED}",
        "score_edge": _values(
            "url, score, reasons",
            [("https://f.example/#x", 4, '+6 "Kaffee und Kuchen"; -2 "Fragment-URL"'), ("https://f.example/s", -1, '+2 "the"; -3 "vorerst gesperrt"'), ("https://f.example/e", 0, "")],
        ),
        "clean_html_golden": _values(
            "url, title, introText, day",
            [
                ("1", "Neues aus Grau", "Im Saal wird wieder gesungen.", "2012-10-12"), ("2", "Markt", "Kurz gesagt", "2012-10-12"), ("3", "Öffnung", "täglich, außer montags", "2012-10-12"),
                ("6", "z" * 120 + "...", "y" * 120 + "...", "2012-10-12"), ("7", "Link", "Ein Wort mehr", "2012-10-12"), ("8", "3 < 4 <i> &reg y", None, "2012-10-12"), ("9", "U", "", "2012-10-12"),
            ],
        ),
        "index_documents": """SELECT url AS id, title, CASE WHEN introtext NOT IN ('', '0') THEN introtext END AS sp_intro, strftime(harvested_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS sp_date, url,
            'source_x' AS sp_objecttype, 'run-1' AS crawl_process_id, 'source_x' AS sp_source FROM teasers_raw""",
        "index_no_date": "SELECT url AS id, title, NULL::VARCHAR AS sp_intro, NULL::VARCHAR AS sp_year FROM teasers_raw",
        "config_readers": _values("key, reader, value", CONFIG_READS),
        "site_run": _values("id, title", [(_B + u, f"Page {_B}{u}") for u in ("/a", "/b", "/c", "/", "/b#top", "/b?page=2")] + [(f"{_B}/private/x", f"Page {_B}/private/x")]),
        "p7_found": P7_SQL,
    }
    out |= {k: _values("n, url", [(i, _B + u) for i, u in enumerate(expected, 1)]) for k, (_, _, expected) in BFS.items()}
    return out | {k: _values("id, title, crawl_process_id", rows) for k, (_, rows) in SNAPSHOTS.items()}
