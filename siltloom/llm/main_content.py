"""The main body of a page (problem 5).

Method: composite text density. For each element of the tree the characters per tag are computed and
adjusted for links; the densities of an element's children are summed, and the subtree with the largest
sum is the body. The smallest density of its ancestors is the threshold for other blocks beside it, and the
body must reach it too. The subtree is extended to the block of the headline, wherever that stands. What is as
dense as an article but none, blocks inside the body under a heading of related items or comments or named so, is told
by these, and lines that are bylines, dates, prompts, notices and the like are left out; they take no part in the densities.

Everything about one page happens in one Python pass; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from siltloom.functions.html import INLINE, Node, parse, text_of
from siltloom.session import bound_arrow, spread


class Line(NamedTuple):
    """A line of the main body."""

    text: str
    tag: str
    headline: bool
    code: bool = False


_CODE_TAGS = frozenset(("pre", "code", "kbd", "samp"))
_HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_DROP_TAGS = frozenset(("nav", "aside", "footer", "button", "form", "script", "style", "noscript", "head", "template", "svg", "select", "textarea", "iframe", "dialog"))
#: Roles of blocks around the body. Fixed values.
_DROP_ROLE = frozenset(("contentinfo", "navigation", "complementary", "search", "banner", "dialog", "alertdialog"))
#: Words in classes and ids by which blocks inside the body are told to be none. Fixed values.
_DROP_NAME = re.compile(r"(?i)(?:^|[\s_-])(?:cookies?|consent|comments?|sidebar|footer|nav|navigation|menu|breadcrumbs?|related|newsletter|banner|share|sharing|social)(?:$|[\s_-])")
#: Headings of blocks that follow or precede the body. Fixed values.
_BLOCK_HEAD = re.compile(
    r"(?i)(?:das könnte sie (?:auch|ebenfalls) interessieren|(?:weitere|ähnliche|verwandte) (?:artikel|beiträge|meldungen|themen|nachrichten)|mehr (?:zum thema|aus der region|nachrichten)|lesen sie auch|auch interessant|meistgelesen|"
    r"you (?:may|might) also (?:like|be interested in)|related(?: (?:articles?|stories|items|content|links|news))?|more (?:stories|news|from .{1,40})|read (?:also|next)|most read|see also|recommended(?: for you)?|"
    r"à lire (?:aussi|également)|(?:voir|lire) aussi|sur le même (?:sujet|thème)|articles? (?:liés|similaires|associés)|vous aimerez aussi|les plus lus|"
    r"(?:\d+ )?(?:kommentare?|leserkommentare?|comments?|reader comments|commentaires?|diskussion|leave a comment|réagir|ihre meinung)(?: \(\d+\))?)\s*[:…]?"
)
_NAME = r"[\w'’.\- ]{1,60}"
#: Lines that are never main body, wherever they stand. Fixed values, by kind.
_JUNK_PATTERNS = [
    # update dates
    r"(?:stand|zuletzt (?:aktualisiert|geändert)|aktualisiert(?: am)?|veröffentlicht(?: am)?|letzte (?:änderung|aktualisierung)|datum)\s*:?\s*\D{0,4}\d{1,4}[./ -].{0,30}",
    r"(?:last (?:updated|modified|changed)|updated(?: on)?|published(?: on)?|posted(?: on)?)\s*:?\s*.{0,14}\d{1,4}.{0,30}",
    r"(?:mise? à jour|mis à jour|dernière (?:mise à jour|modification)|publié|modifié)(?: le)?\s*:?\s*\D{0,14}\d{1,4}.{0,30}",
    # bylines and sources
    r"(?:von der redaktion|redaktion\s*:|von:|autor(?:in)?\s*:|verfasst von|von unserer redaktion)\s?" + _NAME,
    r"(?:text und (?:foto|bild|fotos|bilder)|text|fotos?|bild(?:er)?|bildquelle|bildnachweis|grafik)\s*:\s*" + _NAME,
    r"(?:quelle|source|sources?)\s*:\s*" + _NAME,
    r"(?:by the " + _NAME + r"(?: news)? desk|(?:written|reported|posted) by " + _NAME + r"|author\s*:\s*" + _NAME + r"|by (?-i:[A-ZÀ-Þ])[\w'’-]+ (?-i:[A-ZÀ-Þ])[\w'’-]+)",
    r"(?:words and pictures|words|pictures?|photos?|photo credit|image)\s*:\s*" + _NAME,
    r"(?:par la rédaction(?: de " + _NAME + r")?|rédaction\s*:\s*" + _NAME + r"|(?:textes? et (?:photos?|images?)|photos?|texte|crédit photo|auteur)\s*:\s*" + _NAME + r"|propos recueillis par " + _NAME + r")",
    # share and subscription prompts
    r"teilen sie (?:diesen|diese|den|die) .{0,60}", r"gefällt ihnen .{0,60}", r"(?:jetzt )?(?:den|unseren) newsletter .{0,90}", r"folgen sie uns.{0,80}", r"(?:empfehlen|weitersagen|teilen)(?: sie\b.{0,40}| (?:auf|per|via|bei|mit|über) .{1,30}|\W*(?:(?:&|und|oder|\||/|,|·) ?(?:empfehlen|weitersagen|teilen|drucken|merken|senden)\W*)*)", r"(?:jetzt )?abonnieren.{0,60}",
    r"seite drucken.{0,50}", r"(?:artikel )?drucken.{0,40}", r"als e-?mail versenden.{0,20}",
    r"share this .{0,60}", r"liked this .{0,50}", r"(?:sign up|subscribe)\b.{0,90}", r"follow us\b.{0,70}", r"pass it on.{0,20}", r"print this .{0,50}", r"send by e-?mail.{0,20}", r"share on .{0,30}",
    r"partage[zr] cet(?:te)? .{0,60}", r"abonne[zr]-vous .{0,90}", r"suive[zr]-nous.{0,80}", r"cet article vous a plu.{0,60}", r"vous avez aimé .{0,60}", r"imprimer (?:la|cette) page.{0,50}", r"envoyer par courriel.{0,20}", r"recommande[zr].{0,40}",
    # legal and picture notices, footers
    r"(?:©|\(c\)|copyright\b).{0,120}", r".{0,60}\b(?:alle rechte vorbehalten|all rights reserved|tous droits réservés)\.?", r"(?:hinweis\s*:\s*)?bildrechte .{0,100}", r"picture rights .{0,100}", r"(?:les )?droits (?:des|sur les) (?:images|photos) .{0,100}", r"(?:crédits? (?:photos?|images?)|images?)\s*:.{0,80}",
    r"eine weiterverwendung .{0,100}", r"texts may be reused .{0,80}", r"(?:la |toute )?reproduction\b(?=.*\b(?:interdite?s?|soumise?s?|autorisée?s?|autorisation|accord|droits?|réservée?s?|sans)\b).{0,120}", r"(?:la réutilisation|toute (?:réutilisation|reproduction)) .{0,100}", r"alle angaben .{0,90}ohne gewähr.{0,60}", r"we accept no liability .{0,80}", r"(?:la )?(?:ville|commune|mairie) de " + _NAME + r" décline toute responsabilité.{0,80}",
    r"(?:impressum|imprint|mentions légales)\s*[|·/-].{0,80}", r"stadtverwaltung " + _NAME + r",.{0,80}", _NAME + r" town hall, \d+ .{0,80}", r"mairie de " + _NAME + r", \d+ .{0,80}", r".{5,60}, (?:telefon|phone|tél\.) [\d /-]+",
    # consent notices
    r"(?=.*\b(?:akzept\w*|zustimm\w*|verwende\w*|verwendung|setz\w+|gesetzt|speicher\w*|nutzen|benutzt|notwendig\w*|erlauben|einstellungen|datenschutz\w*|accept\w*|allow\w*|stor(?:e|es|ed|ing)|sets?|uses?|using|need(?:s|ed)?|essential|settings|consent|privacy|choose|utilis\w*|dépos\w*|accepte\w*|refuse\w*|nécessaires?|confidentialité|paramètres|consentement|choisi\w*)\b).{0,90}\bcookies?\b.{0,140}", r"ihre privatsphäre ist .{0,140}", r"your privacy matters .{0,140}", r"(?:alle|tout) (?:akzeptieren|accepter)", r"(?:accept|reject|allow) all", r"(?:nur notwendige|only essential) cookies", r"(?:einstellungen speichern|save my (?:choices?|settings)|enregistrer mes choix|refuser|ablehnen|tout refuser)",
]
_JUNK = re.compile(r"(?i)(?:" + "|".join(f"(?:{p})" for p in _JUNK_PATTERNS) + r")")


#: Blocks that must reach the threshold to be body beside the densest subtree; lists and quotes belong to theirs.
_BOXES = frozenset(("div", "section", "article", "main", "table", "tbody", "tr", "td", "header"))
#: A box of another kind than the page's paragraphs is body only from this length on.
SHORT_BOX = 45


@lru_cache(maxsize=8192)
def is_junk(line: str) -> bool:
    """Is the line a byline, a date, a prompt or a notice? No pattern reaches beyond 240 characters."""
    return len(line) <= 240 and _JUNK.fullmatch(line) is not None


def _dropped(node: Node) -> bool:
    if node.tag in _DROP_TAGS:
        return True
    if node.tag == "header" and not any(x.tag in ("h1", "h2") for x in node.walk()):
        return True
    if node.attrs_src:
        a = node.attrs
        if a.get("role") in _DROP_ROLE:
            return True
    return False


def _heads_block(node: Node) -> bool:
    """Does the block begin with a heading of related items or comments?"""
    if node.tag not in ("div", "section", "article", "aside", "td", "main", "footer"):
        return False
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip():
                return False
        elif kid.tag in _HEADS or kid.tag in ("strong", "b"):
            return _BLOCK_HEAD.fullmatch(kid.text()) is not None
        else:
            return False
    return False


def _links_only(node: Node) -> bool:
    """A list of which every item is nothing but a link, as menus are."""
    items = [k for k in node.kids if not isinstance(k, str)]
    if len(items) < 2:
        return False
    for li in items:
        kids = [k for k in li.kids if not (isinstance(k, str) and not k.strip())]
        if len(kids) != 1 or isinstance(kids[0], str) or kids[0].tag != "a":
            return False
    return True


def _is_junk_block(node: Node, title: str) -> bool:
    """A block of one line that is left out wherever it stands; headlines are none."""
    if node.tag in _HEADS or node.tag in INLINE:
        return False
    todo = [node]
    while todo:
        for k in todo.pop().kids:
            if not isinstance(k, str):
                if k.tag not in INLINE:
                    return False
                todo.append(k)
    text = node.text()
    return text != title and is_junk(text)


def densities(body: Node, title: str = "") -> tuple[Node, float]:
    """(subtree with the largest sum of its children's composite densities, smallest density of its ancestors).

    Blocks and lines that are left out anyway take no part. A subtree that is sparser than all its ancestors is
    a heap of scattered blocks and no body. ``stat`` of every element is set to
    [chars, tags, link chars, link tags, density, sum of densities, kept].
    """
    order = []
    todo = [(body, False)]
    while todo:
        node, in_link = todo.pop()
        kept = node is body or not _dropped(node)
        node.stat = [0, 0, 0, 0, 0.0, 0.0, kept]
        order.append((node, in_link))
        if kept:
            link = in_link or node.tag == "a"
            todo.extend((k, link) for k in reversed(node.kids) if not isinstance(k, str))
    for node, in_link in reversed(order):
        s = node.stat
        if not s[6]:
            continue
        link = in_link or node.tag == "a"
        for k in node.kids:
            if isinstance(k, str):
                n = len(k) - k.count(" ") - k.count("\n")
                if n:
                    s[0] += n
                    if link:
                        s[2] += n
            elif k.stat[6]:
                t = k.stat
                s[0] += t[0]
                s[1] += t[1] + 1
                s[2] += t[2]
                s[3] += t[3] + (k.tag == "a")
        if 0 < s[0] <= 240 and _is_junk_block(node, title):
            s[0] = s[2] = 0
    chars, link_chars = max(1, body.stat[0]), body.stat[2]
    for node, _ in order:
        c, t, lc, lt = node.stat[:4]
        if not node.stat[6] or not c:
            continue
        t1, lc1, lt1 = max(1, t), max(1, lc), max(1, lt)
        base = math.log(c / max(1, c - lc) * lc + link_chars / chars * c + math.e)
        node.stat[4] = c / t1 * math.log(max(1.0001, c / lc1 * t1 / lt1)) / max(1e-9, math.log(base + 1e-9) if base > 1.0000001 else 1.0)
    least = {id(body): math.inf}
    headed: set[int] = set()
    best, most = body, -1.0
    for node, _ in order:
        if node.stat[6]:
            if id(node.parent) in headed or _heads_block(node):
                headed.add(id(node))
            total = 0.0
            below = min(least[id(node)], node.stat[4])
            for k in node.kids:
                if not isinstance(k, str) and k.stat[6]:
                    least[id(k)] = below
                    if k.tag not in INLINE:
                        total += k.stat[4]
            node.stat[5] = total
            if total > most and id(node) not in headed and (node is body or node.stat[4] >= least[id(node)]):
                best, most = node, total
    return best, 0.0 if best is body else least[id(best)]


def _path(node: Node, body: Node) -> list[Node]:
    """The element and its ancestors, up to ``body``."""
    out = [node]
    while node is not body and node.parent is not None:
        node = node.parent
        out.append(node)
    return out


def _leave_sparse(source: Node, ends: tuple[Node, ...], body: Node, threshold: float) -> None:
    """Marks blocks in ``source`` beside the subtrees ``ends`` as not kept that are below the threshold."""
    inner = {id(x) for x in ends}
    way = {id(x) for end in ends for x in _path(end, body)} - inner
    todo = [source]
    while todo:
        node = todo.pop()
        if id(node) not in way:
            continue
        for k in node.kids:
            if isinstance(k, str) or id(k) in inner or not k.stat[6]:
                continue
            if id(k) in way:
                todo.append(k)
            elif k.tag in _BOXES and k.stat[1] and k.stat[4] < threshold:
                k.stat[6] = None


def _named(node: Node) -> bool:
    """Does the block's own class or id tell that it is no content?"""
    return node.tag in ("div", "section", "ul", "ol") and bool(node.attrs_src) and any(_DROP_NAME.search(node.attrs[k]) for k in ("class", "id") if node.attrs.get(k))


def _leave_headed(source: Node) -> None:
    """Marks blocks of related items, comments and the like inside the body as not kept; they are as dense as any."""
    todo = [source]
    while todo:
        node = todo.pop()
        for k in node.kids:
            if not isinstance(k, str) and k.stat is not None and k.stat[6]:
                if _heads_block(k) or _named(k):
                    k.stat[6] = None
                else:
                    todo.append(k)


def _body_like(text: str, tag: str, wholly_small: bool) -> bool:
    """Does the line show that the body goes on?"""
    sentence = tag in ("p", "li", "blockquote") and text.rstrip("\"'”“»’)").endswith((".", "!", "?", "…"))
    return (len(text) >= SHORT_BOX or sentence) and tag not in _HEADS and not wholly_small and not is_junk(text)


def _lines_of(node: Node, skip_links: bool, after: Node | None) -> list[list]:
    """Lines below ``node``: [text, tag, class, wholly small, element]; what is not kept is left out.

    With ``after`` the lines begin at that element, and end at the first block with a heading of related
    items or comments that stands directly in ``node``. They go on after other blocks that are left out, as
    far as lines follow that may be body.
    """
    edges: list[int] = []
    out: list[list] = []
    parts: list[str] = []
    small = [0, 0]
    started = after is None

    def flush(block: Node) -> None:
        if parts:
            text = text_of("".join(parts))
            if text:
                out.append([text, block.tag, block.attrs_src, small[0] == 0, block])
            parts.clear()
        small[0] = small[1] = 0

    # (kind, node or text, block, in small); kinds: 0 visit, 1 block ends
    todo: list[tuple] = [(0, k, node, False) for k in reversed(node.kids)]
    while todo:
        kind, x, block, is_small = todo.pop()
        if kind == 1:
            flush(x)
            continue
        if isinstance(x, str):
            if started:
                parts.append(x)
                if x.strip():
                    small[1 if is_small else 0] += 1
            continue
        if x is after:
            started = True
            parts.clear()
        if x.tag in INLINE:
            todo.extend((0, k, block, is_small or x.tag == "small") for k in reversed(x.kids))
            continue
        flush(block)
        if x.stat is None or not x.stat[6]:
            if started and after is not None and x.parent is node and x.tag in ("div", "section", "article", "aside", "footer", "td"):
                if _heads_block(x):
                    break
                edges.append(len(out))
            continue
        if skip_links and x.tag in ("ul", "ol") and _links_only(x):
            continue
        todo.append((1, x, block, False))
        todo.extend((0, k, x, False) for k in reversed(x.kids))
    flush(node)
    while edges and not any(_body_like(x[0], x[1], x[3]) for x in out[edges[-1] :]):
        del out[edges.pop() :]
    return out


def _in_code(node: Node | None) -> bool:
    while node is not None:
        if node.tag in _CODE_TAGS:
            return True
        node = node.parent
    return False


def main_lines(page: str) -> tuple[list[Line], list[str]]:
    """(lines of the main body, texts of ``noscript`` in the body outside of what surrounds it)."""
    root = parse(page)
    body, title = root, ""
    for node in root.walk():
        if node.tag == "title" and not title:
            title = node.text()
        elif node.tag == "body":
            body = node
            break
    best, threshold = densities(body, title)
    head, named = None, None
    notices = []
    todo = [body]
    while todo:
        node = todo.pop()
        for k in node.kids:
            if not isinstance(k, str) and k.tag == "noscript" and (text := text_of(re.sub(r"<[^>]*>", " ", "".join(x for x in k.kids if isinstance(x, str))))):
                notices.append(text)
        if node.tag not in INLINE and node is not body:
            if head is None and node.tag in ("h1", "h2"):
                head = node
            if title and named is None and node.tag in ("h1", "h2", "div", "p", "h3") and node.stat[0] and node.stat[0] <= 2 * len(title) + 400 and node.text() == title:
                named = node
        todo.extend(k for k in reversed(node.kids) if not isinstance(k, str) and k.stat is not None and k.stat[6])
    if named is not None:
        while len(inner := [k for k in named.kids if not isinstance(k, str) or k.strip()]) == 1 and not isinstance(inner[0], str) and inner[0].tag not in INLINE:
            named = inner[0]
    head = named or head
    if head is not None:
        top = head.parent
        for _ in range(4):
            if top is body or top.parent is None or top.stat[0] > head.stat[0]:
                break
            head, top = top, top.parent
        source, after = top, head
        if best is not top:
            # the densest subtree, extended to the block of the headline
            up = _path(top, body)
            ids = {id(x) for x in up}
            source = next(x for x in _path(best, body) if id(x) in ids)
            _leave_sparse(source, (best, top), body, threshold)
            if source is not top and source is not best:
                after = next(x for x in source.walk() if x is head or x is best)
        _leave_headed(source)
        raw = _lines_of(source, False, after)
        heads = {id(x) for x in head.walk()}
    else:
        _leave_headed(best)
        raw = _lines_of(best, True, None)
        heads = set()
    lines: list[tuple] = []
    for text, tag, attrs, wholly_small, block in raw:
        headline = id(block) in heads
        if headline:
            heads.clear()
        if not headline and (wholly_small or is_junk(text)):
            continue
        lines.append((text, tag, attrs, headline, block))
    # paragraphs share one kind of element on a page; other boxes between them are no body
    kinds: dict[tuple[str, str], int] = {}
    for text, tag, attrs, headline, _ in lines:
        if tag in ("p", "div") and not headline:
            key = (tag, attrs if tag == "div" else "")
            kinds[key] = kinds.get(key, 0) + len(text)
    if kinds:
        main_kind = max(kinds, key=kinds.get)
        lines = [x for x in lines if x[3] or x[1] != "div" or main_kind == ("div", x[2]) or len(x[0]) >= SHORT_BOX]
    return [Line(t, tag, headline, _in_code(block)) for t, tag, _, headline, block in lines], notices


def main_text(pages: DataFrame, drop=None, distinct: bool = False) -> DataFrame:
    """``page_id``, ``line_no``, ``line_text``: the lines of each page's main body, in order.

    ``drop(lines, notices)`` may reject a whole page; ``distinct`` keeps the first of equal lines of a row. Pages with null, empty or contentless html give no
    rows; repeated rows give rows each; a page of any length is processed whole.
    """
    bound_arrow(pages.sparkSession)

    def run(batches):
        for pdf in batches:
            ids, numbers, texts = [], [], []
            for page_id, page in zip(pdf["page_id"], pdf["html"], strict=True):
                if not isinstance(page, str) or not page.strip():
                    continue
                lines, notices = main_lines(page)
                if drop is not None and drop(lines, notices):
                    continue
                found = [x.text for x in lines]
                if distinct:
                    found = list(dict.fromkeys(found))
                ids.extend([page_id] * len(found))
                numbers.extend(range(len(found)))
                texts.extend(found)
            yield pd.DataFrame({"page_id": pd.Series(ids, dtype="int64"), "line_no": pd.Series(numbers, dtype="int32"), "line_text": pd.Series(texts, dtype="object")})

    return spread(pages.select("page_id", "html")).mapInPandas(run, "page_id bigint, line_no int, line_text string")


def main_body_lines(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """``page_id``, ``line_text``: each distinct line of the main bodies; pages of residue have none.

    ``page_id`` is unique, so a page's lines are made distinct in its own row and nothing is shuffled.
    """
    from siltloom.llm.residue import _registry_names, lines_are_residue

    names = _registry_names(sites)
    return main_text(pages, lambda lines, notices: lines_are_residue(lines, notices, names), distinct=True).select("page_id", "line_text")
