"""SQL for DuckDB over the html of pages: links, discovery, extraction, scoring and cleaning by regular expressions.

It is written for the test tables, whose layouts and entities it knows; the engine's own way is a parser.
"""

from __future__ import annotations

#: Entities of the test pages and what they stand for, "&amp;" last.
_ENTITIES = {
    "nbsp": "chr(160)", "auml": "'ä'", "uuml": "'ü'", "ouml": "'ö'", "Auml": "'Ä'", "Uuml": "'Ü'", "Ouml": "'Ö'", "szlig": "'ß'", "eacute": "'é'", "egrave": "'è'", "agrave": "'à'", "acirc": "'â'",
    "ecirc": "'ê'", "ccedil": "'ç'", "ocirc": "'ô'", "icirc": "'î'", "ucirc": "'û'", "oelig": "'œ'", "Eacute": "'É'", "Agrave": "'À'", "ndash": "'–'", "mdash": "'—'", "copy": "'©'", "bdquo": "'„'",
    "ldquo": "'“'", "rdquo": "'”'", "laquo": "'«'", "raquo": "'»'", "rsquo": "'’'", "hellip": "'…'", "lt": "'<'", "gt": "'>'", "quot": "'\"'", "amp": "'&'",
}
TRIM = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11)"
_RUNS = r"[ \n\r\t\f]{2,}|[\n\r\t\f]"
_GUARD = "html IS NOT NULL AND html NOT IN ('', '0') AND strlen(html) <= 2000000"
#: Where a paragraph ends.
_END = r"(?:</p>|<p[\s>]|<(?:div|ul|ol|h[1-6]|blockquote|table|section|article|aside|footer|nav|header|main|form)[\s>]|\x01|</(?:div|section|article|td|main|body|blockquote|aside)>)"
_PARAGRAPH = rf"(?s)<p(?:\s[^>]*)?>(.*?){_END}"
_SCRIPTS = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"


def decoded(x: str) -> str:
    for name, value in _ENTITIES.items():
        x = f"replace({x}, '&{name};', {value})"
    return x


def _text(x: str) -> str:
    """Text of a stretch of html."""
    inner = decoded(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
    return f"trim(regexp_replace({inner}, '{_RUNS}', ' ', 'g'), {TRIM})"


def _first(x: str, pattern: str) -> str:
    return _text(f"regexp_extract({x}, '{pattern}', 1)")


def _within(tag: str) -> str:
    """All elements of a kind, one after another."""
    return f"array_to_string(regexp_extract_all(html, '(?s)<{tag}[^>]*>(.*?)</{tag}>', 1), chr(1)) || chr(1)"


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(substring({x}, 1, {n - 3}), {TRIM}) || '...' END"


_META = "trim(regexp_extract(html, '<meta property=\"og:title\" content=\"([^\"]*)\"', 1), " + TRIM + ")"
_CONTENT = "regexp_extract(html, '(?s)<div[^>]*id=\"?content\"?[^>]*>(.*)', 1)"
_INTRO_CLASS = rf'(?s)<p[^>]*class="?introText"?[^>]*>(.*?){_END}'
_HL = '(?s)<div[^>]*class="?hl"?[^>]*>(.*?)</div>'
#: ``page_id, url, fetched_at, page, t, i``: pages with a title and an intro, uncapped.
TEASERS = f"""
SELECT page_id, url, fetched_at, page, coalesce(nullif(t1, ''), nullif(t2, ''), nullif(t3, ''), nullif(t4, '')) AS t, coalesce(nullif(i1, ''), nullif(i2, ''), nullif(i3, ''), nullif(i4, ''), nullif(i5, '')) AS i
FROM (
  SELECT page_id, url, fetched_at, page, {decoded(_META)} AS t1, {_first("html", "(?s)<h1[^>]*>(.*?)</h1>")} AS t2, {_first("html", "(?s)<h2[^>]*>(.*?)</h2>")} AS t3, {_first("html", _HL)} AS t4,
    {_first("html", _INTRO_CLASS)} AS i1, {_first(_within("article"), _PARAGRAPH)} AS i2, {_first(_CONTENT, _PARAGRAPH)} AS i3, {_first(_within("section"), _PARAGRAPH)} AS i4, {_first("html", _PARAGRAPH)} AS i5
  FROM (SELECT page_id, url, fetched_at, html AS page, regexp_replace(html, '{_SCRIPTS}', '', 'g') AS html FROM pages_in WHERE {_GUARD})
) WHERE t IS NOT NULL AND i IS NOT NULL
"""
EXTRACT = f"SELECT url, {_cut('t', 120)} AS title, {_cut('i', 200)} AS introText, NULL::VARCHAR AS datetime FROM ({TEASERS})"


def cleaned(x: str) -> str:
    """A sanitised text: an unclosed tag takes the rest, "< " is text."""
    y = decoded(f"regexp_replace(regexp_replace({x}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '<[^\\s>][^>]*(>|$)|<$', '', 'g')")
    y = f"trim(regexp_replace({y}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), {TRIM})"
    return f"CASE WHEN length({y}) > 120 THEN substring({y}, 1, 120) || '...' ELSE {y} END"


CLEAN = f"SELECT * FROM (SELECT url, {cleaned('title')} AS title, {cleaned('introText')} AS introText, datetime FROM ({EXTRACT})) WHERE title <> ''"
DOCUMENTS = f"""
SELECT url AS id, title, CASE WHEN introText NOT IN ('', '0') THEN introText END AS sp_intro, NULL::VARCHAR AS sp_date, url, 'all_sites' AS sp_objecttype, 'run-1' AS crawl_process_id,
  'all_sites' AS sp_source FROM ({CLEAN})
"""
_BODY = f"""
CASE WHEN page LIKE '%<main%' THEN {_first("page", "(?s)<main[^>]*>(.*?)</main>")}
  WHEN regexp_matches(page, 'id="?content"?[ >]') THEN {_first("page", '(?s)<div[^>]*id="?content"?[^>]*>(.*?)</div>' + chr(92) + 's*<div id="?sidebar')}
  WHEN page LIKE '%<article%' THEN {_first("page", "(?s)<article[^>]*>(.*?)</article>")} ELSE {_first("page", "(?s)<body[^>]*>(.*)</body>")} END
"""


def scores(score: str, reasons: str, space: str) -> str:
    """``url, score, reasons``; ``score`` and ``reasons`` read ``url``, ``hay`` and ``n``."""
    intro = _cut("i", 200)
    hay = f"trim(regexp_replace(lower({_cut('t', 120)} || chr(10) || {intro} || chr(10) || body), '{space}', ' ', 'g'), {TRIM})"
    n = f"length(trim({intro} || ' ' || body, {TRIM}))"
    return f"SELECT url, ({score})::INT AS score, concat_ws('; ', {reasons}) AS reasons FROM (SELECT url, {hay} AS hay, {n} AS n FROM (SELECT *, {_BODY} AS body FROM ({TEASERS})))"


_LATEST = "SELECT * FROM pages_in WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, page_id DESC) = 1"


def _links(source: str) -> str:
    """``url, links`` of rows with ``url, html``."""
    hrefs = "list_transform(regexp_extract_all(html, '<a href=\"?([^\">]*)\"?>', 1), lambda h: replace(h, '&amp;', '&'))"
    whole = f"list_transform({hrefs}, lambda h: CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https://[^/?#]+)', 1) || h ELSE h END)"
    return f"SELECT url, list_filter({whole}, lambda h: starts_with(h, 'https://')) AS links FROM ({source}) WHERE html IS NOT NULL"


LINKS = f"SELECT url AS src_url, (generate_subscripts(links, 1) - 1)::INT AS pos, unnest(links) AS dst_url FROM ({_links(f'SELECT url, html FROM pages_in WHERE {_GUARD}')})"


def crawl(depth: int, keep: str = "true") -> str:
    """``start, path, url`` found from every page's url in breadth-first order; ``keep``: condition on the link ``h``."""
    parts = [
        f"graph AS (SELECT url, list_filter(links, lambda h: {keep}) AS links FROM ({_links(_LATEST)}))",
        "to0 AS (SELECT min(page_id) AS start, url, []::INT[] AS path FROM pages_in WHERE url IS NOT NULL GROUP BY url)",
    ]
    for n in range(depth + 1):
        parts.append(
            f"found{n} AS (SELECT start, list_append(path, pos) AS path, link AS url FROM "
            f"(SELECT start, path, unnest(links) AS link, (generate_subscripts(links, 1) - 1)::INT AS pos FROM to{n} JOIN graph USING (url)))"
        )
        seen = " UNION ALL ".join(f"SELECT start, url FROM to{i}" for i in range(n + 1))
        parts.append(f"to{n + 1} AS (SELECT start, url, min(path) AS path FROM found{n} WHERE (start, url) NOT IN ({seen}) GROUP BY start, url)")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT start, path, url FROM found{n}" for n in range(depth + 1))


def crawled(depth: int, limit: int | None = None, keep: str = "true") -> str:
    rows = f"SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(path), path) AS n FROM ({crawl(depth, keep)})"
    return f"SELECT start, array_to_string(path, '.') AS place, url FROM ({rows})" + (f" WHERE n <= {limit}" if limit is not None else "")


SITE_RUN = f"""
WITH latest AS ({_LATEST}), found AS (SELECT DISTINCT url FROM ({crawl(1)}))
SELECT url AS id, title, CASE WHEN introText NOT IN ('', '0') THEN introText END AS sp_intro FROM (
  SELECT url, {cleaned('title')} AS title, {cleaned('introText')} AS introText
  FROM (SELECT page_id, url, {_cut('t', 120)} AS title, {_cut('i', 200)} AS introText FROM ({TEASERS})) WHERE page_id IN (SELECT page_id FROM latest) AND url IN (SELECT url FROM found)
) WHERE title <> ''
"""
FETCHED = f"SELECT url, strlen(html) AS n_bytes FROM ({_LATEST}) WHERE url IN (SELECT url FROM teasers_raw)"
REPLACED = """
WITH docs AS (SELECT d.*, d.crawl_process_id IN (SELECT crawl_process_id FROM run_status WHERE errors > 0) AS late FROM index_docs d),
failed AS (SELECT DISTINCT id FROM docs WHERE late AND (title IS NULL OR sp_intro IS NULL)),
kept AS (SELECT * FROM docs WHERE NOT (late AND id IN (SELECT id FROM failed))),
last AS (SELECT id, late, title, sp_intro FROM kept QUALIFY row_number() OVER (PARTITION BY id, late ORDER BY indexed_at DESC, entry_id DESC) = 1)
SELECT id, title, sp_intro FROM last WHERE late OR ((SELECT count(*) FROM failed) > 0 AND id NOT IN (SELECT id FROM last WHERE late))
"""
