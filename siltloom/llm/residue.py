"""Template residue, filler, error messages and script notices instead of content (problem 2).

Method: every delimiter of placeholders has its own grammar; a text is residue when placeholders make up
its words (density), while tutorials and explanations that only mention one are discounted by the words
around it, in the line and in the lines beside it, and listings of code count only where nothing else is.
Filler is told by the share of filler words; error messages and script notices by patterns that must cover
the text, so that a sentence that quotes a message is not one.

Plain Python on one text; the Spark operators are ``residue_teasers`` and ``residue_pages``.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.llm.main_content import Line, main_lines
from siltloom.session import bound_arrow, spread

_ID = r"[A-Za-z_][\w.\-]*(?:\[\w*\])?(?:\s*[|:]\s*[\w.\-]+)*"
#: Grammars of placeholders, one for each kind of delimiter. Fixed values.
GRAMMARS: dict[str, str] = {
    "double braces": r"\{\{\{?\s*[^{}]*\}?\}\}",
    "dollar braces": r"\$\{\s*" + _ID + r"\s*\}",
    "hash braces": r"#\{\s*" + _ID + r"\s*\}",
    "smarty": r"\{\$" + _ID + r"\}",
    "block tags": r"\{%[^{}%]*%\}",
    "angle percent": r"<%=?-?\s*[^<>%]*%>",
    "bracket percent": r"\[%-?\s*[^%]*%\]",
    "double brackets": r"\[\[\s*" + _ID + r"\s*\]\]",
    "percent dict": r"%\(" + _ID + r"\)[sdf]",
    "double percent": r"%%\s*" + _ID + r"\s*%%",
    "hash marks": r"#{2,3}\s*" + _ID + r"\s*#{2,3}",
    "at marks": r"@@\s*" + _ID + r"\s*@@",
    "underscores": r"(?<!\w)__[A-Za-z](?:(?!__)[\w.:|\[\] ])*__(?!\w)",
    "single braces": r"\{\s*" + _ID + r"\s*\}",
    "missing marks": r"!{2}\s?[A-Z][A-Z_. ]*(?:!{2})?|(?<!\w)\?[A-Za-z][A-Za-z_.]+\?(?!\w)",
    "empty values": r"\(null\)|\[object Object\]|(?<![\w.])(?:null|undefined|NaN)(?![\w.])",
}
_PLACE = re.compile("|".join(GRAMMARS.values()))
#: Without one of these no grammar matches.
_SIGNS = re.compile(r"[{%#@_\[]|!!|\?[A-Za-z]|null|undefined|NaN")
#: Words that announce an explanation of placeholders rather than an unfilled one.
_TUTORIAL = re.compile(
    r"(?i)\b(?:placeholders?|platzhaltern?|variablen?|variables?|serienbriefe?n?|form letters?|fields? such|felder wie|champs? comme|"
    r"modèles? de lettre|publipostage|lessons?|lektion|leçon|tutorial|tutoriel|anleitung|kurs|course|cours|how to|so geht|comment utiliser|"
    r"explains?|erklärt|explique|replaced by|ersetzt|remplac\w+|syntax\w*|beispielsweise|for example|par exemple)\b"
)
_FILLER_WORDS = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna
    aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
    reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui
    officia deserunt mollit anim id est laborum blindtext platzhaltertext mustertext mustertitel musterzeile dummytext fülltext""".split()
)
_STRONG_FILLER = frozenset("lorem ipsum amet consectetur adipiscing eiusmod incididunt nostrud veniam aliqua blindtext mustertext mustertitel musterzeile platzhaltertext dummytext labore tempor".split())
#: Filler words that are words of the sites' languages, too; a text of these alone is none. Fixed values.
_LIVING = frozenset("in do ex ad id non est sunt sit ea minim anim culpa fugiat ut et".split())
_END = r"[\s.!…?]*"
#: Messages that stand where content should be; each must cover the whole text. Fixed values.
_MESSAGES = [
    # filler phrases
    r"(?:hier steht (?:ihr|der|dein) )?(?:blind|platzhalter|muster|füll)text(?: (?:blind|platzhalter|muster|füll)text)*",
    r"(?:dies ist ein )?(?:platzhalter|muster|blind)text,? bitte ersetzen", r"(?:überschrift|titel|text) hier ein(?:geben|fügen)",
    r"(?:hier )?(?:titel|überschrift|text) ein(?:geben|fügen)", r"todo\b.{0,40}", r"tbd", r"(?:text|inhalt|titel)(?: folgt(?: in kürze)?)(?: (?:text|inhalt|titel) folgt(?: in kürze)?)*",
    r"x{3,}\W.{0,60}\Wx{3,}", r"testseite.{0,40}", r"(?:test\s*){2,}(?:please ignore|bitte ignorieren|à ignorer)?", r"test,? please ignore", r"unbenannt\w*(?: \w+)?", r"ohne titel", r"neue seite",
    r"sample (?:page|text|title|document).{0,40}", r"(?:placeholder(?: text)?[\s,]*)+(?:please replace)?", r"(?:your|insert|enter|add|type) (?:\w+ ){0,3}(?:headline|title|text|heading|content)(?: (?:text|goes))?(?: here)?",
    r"click (?:here )?to (?:edit|add)(?: this)? (?:heading|text|title|content)", r"untitled(?: (?:document|page|article))?(?: copy)?", r"new page", r"text coming soon",
    r"(?:votre|insérez? (?:le|votre)|saisir (?:le|votre)|entrez (?:le|votre)) (?:titre|texte)(?: ici)?", r"(?:texte|titre) d['’]exemple(?: à remplacer)?", r"titre (?:de la page )?sans nom", r"sans titre", r"texte à (?:venir|remplacer|compléter)", r"page de test.{0,40}",
    # http and application errors
    r"(?:error|fehler|erreur|http)?\s*[45]\d\d\s*[:–—-]?\s*(?:seite nicht gefunden|(?:page )?not found|page introuvable|forbidden|unauthorized|gone|bad (?:gateway|request)|service unavailable|gateway time-?out|internal server error|interner serverfehler|erreur interne du serveur|accès refusé|zugriff verweigert|the resource could not be located|error|fehler|erreur)?",
    r"(?:die )?(?:angeforderte |gewünschte )?(?:seite|inhalt\w*) (?:wurde )?(?:konnte )?(?:leider )?(?:nicht gefunden(?: werden)?|existiert nicht|ist nicht verfügbar)(?: \(fehler \d+\))?",
    r"(?:the )?(?:requested )?(?:page|resource|document) (?:was |could )?not (?:be )?(?:found|located)", r"(?:la )?page (?:demandée )?(?:est )?(?:introuvable|n['’]existe pas)",
    r"(?:error|fehler|erreur) \d{3}\s*[:–—-]\s*.{0,60}", r"internal server error", r"interner server-?fehler", r"erreur interne(?: du serveur)?", r"bad gateway", r"service unavailable", r"gateway time-?out", r"forbidden",
    r"(?:der dienst|dieser dienst|die seite) ist (?:vorübergehend|derzeit|momentan) nicht (?:erreichbar|verfügbar)", r"service (?:momentanément|temporairement) indisponible", r"(?:the |this )?service is (?:temporarily )?unavailable",
    r"access denied", r"permission denied", r"zugriff verweigert", r"accès (?:refusé|interdit)", r"keine berechtigung für diesen inhalt", r"(?:sie haben )?keine (?:zugriffs)?berechtigung.{0,40}", r"you do not have permission.{0,60}", r"vous n['’]avez pas (?:l['’]autorisation|accès).{0,60}",
    r"(?:your|the) session has expired.{0,40}", r"(?:ihre|die) sitzung ist abgelaufen.{0,50}", r"(?:votre|la) session a expiré.{0,50}", r"checking your browser.{0,40}", r"(?:ihr )?browser wird überprüft.{0,30}", r"vérification de votre navigateur.{0,30}",
    r"(?:down|closed) for maintenance", r"wartungsarbeiten(?: ?[:–-] ?| ?, ?)wir sind (?:bald|gleich) wieder da", r"(?:site|page) en maintenance", r"under (?:construction|maintenance)", r"(?:this site is )?(?:temporarily )?under maintenance",
    r"(?:beim laden (?:der inhalte|der seite) ist |es ist )ein (?:unerwarteter )?fehler aufgetreten", r"(?:oops[,!]? )?something went wrong(?: on our side)?", r"(?:an )?(?:unexpected )?error (?:has )?occurred.{0,40}", r"une erreur (?:inattendue )?(?:s['’]est produite|est survenue).{0,50}", r"content could not be loaded", r"too many requests",
    # traces
    r"traceback \(most recent call last\).*", r"(?:exception in thread .*|java(?:x)?\.[\w.]+(?:exception|error)\b.*)", r"(?:php )?(?:notice|warning|fatal error|parse error|deprecated): .*(?:\.ph\w+|\bon line\b|:\d+|argument|undefined|uncaught|array offset|null).*", r"fatal error.*", r"sqlstate\[.*", r"(?:uncaught )?(?:type|reference|syntax|key|value|attribute|name)error\b.*",
    r"undefined is not (?:an object|a function).*", r"cannot read propert.*", r"template error: .*", r"(?:twig|smarty|jinja2?)\b.*(?:error|exception).*", r"stack trace:?.*", r"undefined (?:variable|index|offset|array key).*", r"mysql.{0,10}error.*", r"ora-\d{5}.*",
    # script notices
    r"(?:bitte )?(?:aktivieren sie|schalten sie|erlauben sie) (?:bitte )?(?:javascript|skripte?)\b.{0,80}", r"für die nutzung muss (?:javascript|skripte?) .{0,60}", r"(?:diese|die) (?:anwendung|seite|app|website) (?:benötigt|erfordert|braucht) (?:javascript|skripte?)\b.{0,40}", r"ihr browser unterstützt (?:keine skripte|kein javascript)\b.{0,60}", r"(?:javascript|skripte?) (?:ist|sind) (?:in ihrem browser )?(?:deaktiviert|ausgeschaltet|erforderlich)\b.{0,40}",
    r"(?:you need to |please |to continue,? )?(?:enable|turn on|activate|allow) (?:java)?scripts?\b.{0,60}", r"(?:this|the) (?:app|application|page|site|website) (?:requires|needs) (?:java)?scripts?\b.{0,40}", r"(?:java)?script(?:ing)? (?:is|must be|has been) (?:disabled|enabled|required|turned off|turned on)\b.{0,80}", r"your browser does not support (?:java)?scripts?.{0,40}",
    r"(?:veuillez |merci d['’])?(?:activer|autoriser|activez) (?:javascript|les scripts)\b.{0,60}", r"(?:cette|l['’]) ?(?:application|page|site) (?:nécessite|requiert|a besoin de) (?:javascript|les scripts)\b.{0,40}", r"(?:javascript|les scripts) (?:est|sont) (?:désactivés?|requis|nécessaires?)\b.{0,60}", r"votre navigateur ne (?:prend pas en charge|supporte pas)\b.{0,60}",
]
_MESSAGE = re.compile(r"(?is)\W*(?:" + "|".join(f"(?:{m})" for m in _MESSAGES) + r")" + _END + r"(?:\s*\(?\d{1,6}\)?)?" + _END)
#: Help lines that go with an error message; alone they are no residue, nor are they content.
_HELP = re.compile(
    r"(?i)(?:ref\.? ?[:#]? ?\w+|(?:bitte )?(?:prüfen sie die adresse|versuchen sie es).*|(?:please )?(?:check the address|try again|go back|contact).*|(?:veuillez )?(?:vérifi\w+ l['’]adresse|réessayer).*|zurück zur .*|back to .*|request id.*|(?:incident|error) (?:id|code).*)"
)
_SEPARATED = re.compile(r"\s+[|–—·»-]\s+|\s*[|»·]\s*|:\s+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_WORD = re.compile(r"[^\W_]+")


def placeholder_share(text: str) -> tuple[int, int]:
    """(placeholders, words beside them)."""
    found = _PLACE.findall(text) if _SIGNS.search(text) else ()
    return len(found), len(_WORD.findall(_PLACE.sub(" ", text))) if found else len(_WORD.findall(text))


def is_residue(text: str, names: Iterable[str] = (), whole: bool = True) -> bool:
    """Is ``text`` residue as a whole? ``names``: site names that may stand beside it."""
    text = " ".join(text.split())
    if not text:
        return False
    if "&" in text:
        text = _html.unescape(text)
    if "&" in text:
        text = _html.unescape(text)
    if _MESSAGE.fullmatch(text):
        return True
    sentences = [x for x in _SENTENCE.split(text) if x]
    if len(sentences) > 1 and all(_MESSAGE.fullmatch(x) for x in set(sentences)):
        return True
    count, rest = placeholder_share(text) if _SIGNS.search(text) else (0, 0)
    if count:
        lower = text.lower()
        beside = rest
        for name in names:
            if name and name.lower() in lower:
                beside -= len(_WORD.findall(name))
        if beside <= 0 or rest == 0:
            return True
        if not _TUTORIAL.search(text):
            if beside <= 2 and _SEPARATED.search(text):
                return True
            if not whole and count / (count + rest) >= 0.15 and (count >= 2 or rest <= 4):
                return True
            if whole and count / (count + rest) >= 0.5:
                return True
    words = _WORD.findall(text.lower())
    plain = [w for w in words if not w.isdigit()]
    if len(plain) > 1 and _FILLER_WORDS.issuperset(plain) and not _LIVING.issuperset(plain):
        return True
    if not _STRONG_FILLER.isdisjoint(words):
        filler = sum(w in _FILLER_WORDS for w in words)
        numbers = sum(w.isdigit() for w in words)
        if filler >= 2 and filler >= 0.8 * (len(words) - numbers):
            return True
    return False


@lru_cache(maxsize=8)
def _lower(names: tuple[str, ...]) -> frozenset[str]:
    return frozenset(n.lower() for n in names if n)


def title_is_residue(title: str | None, names: Iterable[str] = ()) -> bool:
    """A title is residue wholly or beside a site name or a short label. None and blank titles are none."""
    if not title or not title.strip():
        return False
    names = tuple(names)
    title = " ".join(title.split())
    if is_residue(title, names):
        return True
    parts = [p for p in _SEPARATED.split(title) if p.strip()]
    if len(parts) < 2:
        return False
    known = _lower(names)
    # the label or site name is one end of the title, the residue all the rest
    for m in _SEPARATED.finditer(title):
        left, right = title[: m.start()].strip(), title[m.end() :].strip()
        for label, rest in ((left, right), (right, left)):
            if rest and (label.lower() in known or (label is left and m[0].startswith(":") and _label(label))) and is_residue(rest, names):
                return True
    return False


def _label(text: str) -> bool:
    words = text.split()
    return len(words) == 1 and text[:1].isalpha() and not _PLACE.search(text)


def lines_are_residue(lines: list[Line], aside: list[str] = (), names: Iterable[str] = ()) -> bool:
    """Has the main body of a page residue in place of content?

    ``lines``: the main body; ``aside``: notices of ``noscript`` in it, which count only where no body is.
    """
    body = [x for x in lines if not x.headline]
    heads = [x for x in lines if x.headline]
    if not lines:
        return any(is_residue(x, names, whole=False) for x in aside)
    bad = [is_residue(x.text, names, whole=False) for x in body]
    explains = [any(bad) and not b and not x.code and _TUTORIAL.search(x.text) is not None for b, x in zip(bad, body, strict=True)]
    # listings count only where nothing else is
    for listings in (False, True):
        share = [0, 0]
        for i, x in enumerate(body):
            if x.code is not listings or _HELP.fullmatch(x.text):
                continue
            if bad[i] and any(explains[max(0, i - 1) : i + 2]) and _PLACE.search(x.text):
                continue
            share[bad[i]] += len(x.text)
        if any(share):
            return share[1] > share[0]
    return any(title_is_residue(x.text, names) for x in heads)


def site_names(site_key: str | None) -> tuple[str, ...]:
    """Spellings of a site's name."""
    if not site_key:
        return ()
    return tuple(dict.fromkeys((site_key, site_key.replace("_", "-"), site_key.replace("_", " "))))


def residue_teasers(teasers: DataFrame, sites: DataFrame) -> DataFrame:
    """Teasers with ``is_residue`` (boolean) of ``title``.

    Needs ``teaser_id``, ``title``, ``sp_source``; other columns are dropped. A null or blank title is no
    residue. A title may name any site of the registry, not only its own, so the names (one short string a
    site) go along as a constant; a registry of more than ``MAX_NAMES`` sites is an error.
    """
    names = _registry_names(sites)

    def run(batches):
        all_names = names
        for pdf in batches:
            out = [title_is_residue(t, all_names) if isinstance(t, str) else False for t in pdf["title"]]
            yield pd.DataFrame({"teaser_id": pdf["teaser_id"], "is_residue": out})

    return spread(teasers.select("teaser_id", "title")).mapInPandas(run, "teaser_id bigint, is_residue boolean")


#: A registry beyond this number of sites is refused, as its names go along as a constant.
MAX_NAMES = 20_000


def _registry_names(sites: DataFrame) -> tuple[str, ...]:
    keys = [r[0] for r in sites.select("site_key").distinct().limit(MAX_NAMES + 1).collect()]
    if len(keys) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} sites; their names can't go along as a constant")
    out: dict[str, None] = {}
    for k in keys:
        for n in site_names(k):
            spellings = [n]
            for plain, dotted in (("ae", "ä"), ("oe", "ö"), ("ue", "ü")):
                spellings += [x.replace(plain, dotted) for x in spellings if plain in x]
            out.update(dict.fromkeys(spellings))
    return tuple(out)


def residue_pages(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages with ``is_residue`` of their main body; one Python pass, no shuffle.

    Needs ``page_id`` and ``html``. Null and empty html is no residue.
    """
    bound_arrow(pages.sparkSession)
    names = _registry_names(sites)

    def run(batches):
        for pdf in batches:
            out = []
            for page in pdf["html"]:
                if not isinstance(page, str) or not page.strip():
                    out.append(False)
                    continue
                lines, aside = main_lines(page)
                out.append(lines_are_residue(lines, aside, names))
            yield pd.DataFrame({"page_id": pdf["page_id"], "is_residue": out})

    return spread(pages.select("page_id", "html")).mapInPandas(run, "page_id bigint, is_residue boolean")


def residue_cases(pages: DataFrame, teasers: DataFrame, sites: DataFrame) -> DataFrame:
    """``origin``, ``record_key`` of all pages and teasers that are residue."""
    a = residue_pages(pages, sites).where("is_residue").select(F.lit("pages_in").alias("origin"), F.col("page_id").alias("record_key"))
    b = residue_teasers(teasers, sites).where("is_residue").select(F.lit("teasers_raw").alias("origin"), F.col("teaser_id").alias("record_key"))
    return a.unionByName(b)


def clean_teasers(teasers: DataFrame, sites: DataFrame) -> DataFrame:
    """Teasers whose title is not residue, with all their columns."""
    bad = residue_teasers(teasers, sites).where("is_residue").select("teaser_id")
    return teasers.join(bad, "teaser_id", "left_anti")
