"""Statistics of a document's text, and the structural profile nearest to it (problem 10).

Method: a text is described by three distributions: its words over the grammatical classes of a language's function
words and the rest, its characters over classes of characters, and its lines over shapes (how they begin, end and
are divided, whatever they say). Each is compared with those of profiles of prose in every language and of lists,
tables, code, word heaps and noise by Jensen-Shannon divergence; the nearest profile is assigned, alongside counts.
Nothing but the divergence decides.

One Python pass over whole texts, nothing shuffled, whatever repeats or however long a text is.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame

from siltloom.session import bound_arrow, spread

#: The commonest function words of the languages. Fixed values.
FUNCTION_WORDS = {
    "de": frozenset(
        """der die das den dem des ein eine einen einem einer eines und oder aber denn sondern auch noch nur schon sehr so wie als wenn weil dass ob
        damit obwohl bevor nachdem sobald da in im an am auf aus bei beim bis durch für gegen mit nach ohne seit über um unter von vom vor zu zum zur
        zwischen ist sind war waren wird werden wurde wurden hat haben hatte hatten kann können soll sollen muss müssen es er sie wir ihr ich man sich
        nicht kein keine hier dort dazu dabei davon dafür etwa rund fast mehr viele dieser diese dieses wer was""".split()
    ),
    "en": frozenset(
        """the a an and or but nor so if because although while after before until since when whether as than that which who whom whose this these
        those there here in on at by for from of to with without into onto over under about between through during is are was were be been being has
        have had do does did will would can could may might must shall should it its he she they we you i his her their our your my not no more most
        some any all each every one what how per next to""".split()
    ),
    "fr": frozenset(
        """le la les l un une des du de d et ou mais donc or ni car que qui quoi dont où si quand lorsque puisque parce pour par avec sans sous sur dans
        en à au aux chez entre vers depuis pendant avant après contre est sont était étaient sera seront a ont avait avaient il elle ils elles on nous
        vous je tu se s ce c cet cette ces son sa ses leur leurs notre nos votre vos ne n pas plus très bien y être même tout toute tous près""".split()
    ),
}
_ALL_FUNCTION = frozenset().union(*FUNCTION_WORDS.values())
_TOKEN = re.compile(r"[^\W_]\w*(?:['’\-]+\w+)*+|[^\w\s]|_")
_VOWEL = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ]", re.I)
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxzß]{6,}", re.I)
_INNER_CAPITAL = re.compile(r"[a-zà-ÿ][A-ZÀ-Þ]|[A-ZÀ-Þ]{2}[a-zà-ÿ]+[A-ZÀ-Þ]")
_GARBLED = re.compile(r"[�\u0080-\u009f]|[ÃÂ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|[¤¶¼€šŸ](?=[^\W\d_])|(?<=[^\W\d_])[¤¶¼€šŸ�]")
_SUSPECT = re.compile(r"[�\u0080-\u009fÃÂ¤¶¼€šŸ]")
_BULLET = re.compile(r"\s*(?:[-–—•*·▪◦‣»>]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+")
_STOP = re.compile(r"[.!?…:][\s\"”“»«’')\]]*\Z")
_INNER_STOP = re.compile(r"(?<![^\W\d_])[^\W\d_]{2,}+[.!?…][\"”“»’')\]]*\s+[\"“„«‚‘'(\[–—-]*\s?[^\W\d_]")
_CELLS = re.compile(r"\t|\s\|\s|^\||\|$| {2,}(?=\S)|;(?=\S)|(?<=\S)\s;\s")
_URL = re.compile(r"(?i)\b(?:https?|ftp)://\S+|\bwww\.\S+")
_BREAKS = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
_INVISIBLE = re.compile(r"[­​-‏⁠﻿]")

#: Signs that end a line as part of it; others after a space, as emoji, are a tail.
_KEPT = frozenset("_.!?…,;:()[]{}<>|/\\-–—\"'”“»«’")

#: Grammatical classes of the function words; those in none of them are "other". Fixed values.
GRAMMAR = {
    "article": "der die das den dem des ein eine einen einem einer eines kein keine the a an le la les l un une des du",
    "preposition": """in im an am auf aus bei beim bis durch für gegen mit nach ohne seit über um unter von vom vor zu zum zur zwischen at by for from
        of on to with without into onto over under about between through during per next de d par pour avec sans sous sur dans en à au aux chez entre
        vers depuis pendant avant après contre près""",
    "conjunction": """und oder aber denn sondern wenn weil dass ob damit obwohl bevor nachdem sobald da als wie and or but nor so if because although
        while after before until since when whether as than that et ou mais donc or ni car que quand lorsque puisque parce si comme""",
    "pronoun": """es er sie wir ihr ich man sich wer was dieser diese dieses which who whom whose what this these those it its he she they we you i his
        her their our your my qui quoi dont où il elle ils elles on nous vous je tu se s ce c cet cette ces son sa ses leur leurs notre nos votre vos""",
    "verb": """ist sind war waren wird werden wurde wurden hat haben hatte hatten kann können soll sollen muss müssen is are was were be been being has
        have had do does did will would can could may might must shall should est sont était étaient sera seront a ont avait avaient être""",
}
_GRAMMAR: dict[str, int] = {}
for _i, _words in enumerate(GRAMMAR.values()):
    for _w in _words.split():
        _GRAMMAR.setdefault(_w, _i)

WORDS = (*GRAMMAR, "other", "ordinary", "implausible", "number")
CHARACTERS = ("lower", "upper", "digit", "space", "stop", "comma", "dash", "sign", "garbled")
LINES = ("row", "item", "sentence", "short", "middling", "long", "signs")
#: How much the divergence of words, characters and lines counts.
WEIGHTS = (1.6, 2.0, 1.0)
#: Texts that profiles are fitted on at most.
SAMPLE = 10_000
#: Profiles: means of the distributions over ``WORDS``, ``CHARACTERS`` and ``LINES`` of the 10,000 texts of sf0.1 of each
#: kind (``fit_profiles``). Fixed values.
PROFILES = {
    "prose_de": ((0.123, 0.129, 0.059, 0.023, 0.057, 0.057, 0.51, 0.0, 0.042), (0.75, 0.059, 0.017, 0.15, 0.013, 0.01, 0.001, 0.0, 0.0), (0.0, 0.005, 0.994, 0.0, 0.001, 0.0, 0.0)),
    "prose_en": ((0.1, 0.142, 0.054, 0.031, 0.096, 0.036, 0.501, 0.0, 0.04), (0.747, 0.028, 0.02, 0.181, 0.011, 0.011, 0.002, 0.0, 0.0), (0.0, 0.006, 0.992, 0.001, 0.001, 0.0, 0.0)),
    "prose_fr": ((0.148, 0.146, 0.036, 0.028, 0.027, 0.05, 0.529, 0.0, 0.036), (0.741, 0.026, 0.018, 0.172, 0.012, 0.029, 0.002, 0.0, 0.0), (0.023, 0.006, 0.966, 0.001, 0.004, 0.0, 0.0)),
    "list": ((0.053, 0.025, 0.004, 0.004, 0.0, 0.001, 0.673, 0.0, 0.24), (0.66, 0.076, 0.069, 0.164, 0.004, 0.006, 0.018, 0.003, 0.0), (0.0, 0.59, 0.013, 0.38, 0.014, 0.003, 0.0)),
    "table": ((0.001, 0.001, 0.0, 0.0, 0.0, 0.0, 0.35, 0.007, 0.641), (0.272, 0.047, 0.31, 0.216, 0.03, 0.06, 0.02, 0.034, 0.011), (0.616, 0.0, 0.025, 0.078, 0.105, 0.125, 0.051)),
    "code": ((0.05, 0.002, 0.0, 0.002, 0.0, 0.001, 0.601, 0.162, 0.182), (0.367, 0.011, 0.102, 0.075, 0.049, 0.03, 0.08, 0.177, 0.109), (0.088, 0.0, 0.0, 0.031, 0.355, 0.023, 0.503)),
    "words": ((0.0, 0.004, 0.003, 0.001, 0.0, 0.0, 0.909, 0.032, 0.051), (0.705, 0.066, 0.024, 0.122, 0.003, 0.062, 0.0, 0.018, 0.0), (0.0, 0.0, 0.0, 0.275, 0.146, 0.579, 0.0)),
    "noise": ((0.002, 0.002, 0.0, 0.003, 0.0, 0.002, 0.156, 0.819, 0.016), (0.544, 0.155, 0.06, 0.055, 0.002, 0.002, 0.007, 0.009, 0.166), (0.0, 0.0, 0.0, 0.0, 0.011, 0.391, 0.598)),
}
PROSE = ("prose_de", "prose_en", "prose_fr")


def divergence(p: tuple[float, ...], q: tuple[float, ...]) -> float:
    """Jensen-Shannon divergence (bits) of two distributions."""
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        if a > 0:
            total += a * math.log2(a / m) / 2
        if b > 0:
            total += b * math.log2(b / m) / 2
    return max(0.0, total)


def _cells(line: str) -> int:
    """Borders between the cells of a row."""
    return len(_CELLS.findall(line)) if "\t" in line or "|" in line or ";" in line or "  " in line else 0


def _garbled(text: str) -> int:
    return len(_GARBLED.findall(text)) if not text.isascii() and _SUSPECT.search(text) else 0


def _word_kind(w: str) -> int | None:
    """Of ``WORDS``; a function word is "other" here, and signs are no words (None)."""
    if not w[0].isalnum():
        return None
    lower = w.lower()
    if lower in _ALL_FUNCTION:
        return 5
    if any(c.isdigit() for c in w):
        return 8 if sum(c.isdigit() for c in w) * 2 >= len(w) else 7
    if "'" in w or "’" in w or "-" in w:
        parts = re.split(r"['’\-]", lower)
        if parts[0] in _ALL_FUNCTION or any(len(x) > 2 for x in parts):
            w = max(parts, key=len)
    if len(w) > 30 or _GARBLED.search(w) or (len(w) > 3 and not w.isupper() and _INNER_CAPITAL.search(w)):
        return 7
    if any("a" <= c <= "z" for c in w.lower()):
        if len(w) > 2 and not _VOWEL.search(w):
            return 7
        if _CLUSTER.search(w):
            return 7
    return 6


#: Kinds of words met in this worker; beyond this number the store starts anew.
MAX_KNOWN = 200_000
_known: dict[str, int | None] = {}
_classes: dict[str, int] = {}


def word_distributions(tokens: Counter) -> dict[str, tuple[float, ...]]:
    """Words over ``WORDS`` as each language sees them: other languages' function words are ordinary."""
    base = [0] * len(WORDS)
    own = {lang: [0] * len(WORDS) for lang in FUNCTION_WORDS}
    for w, n in tokens.items():
        k = _known.get(w, -1)
        if k == -1:
            k = _word_kind(w)
            if len(w) <= 40:
                if len(_known) >= MAX_KNOWN:
                    _known.clear()
                _known[w] = k
        if k == 5:
            lower = w.lower()
            for lang, known in FUNCTION_WORDS.items():
                own[lang][_GRAMMAR.get(lower, 5) if lower in known else 6] += n
        elif k is not None:
            base[k] += n
    out = {}
    for lang, counts in own.items():
        total = max(1, sum(counts) + sum(base))
        out[lang] = tuple((a + b) / total for a, b in zip(counts, base))
    return out


def _class(c: str) -> int:
    """Of ``CHARACTERS``."""
    if c.isdigit():
        return 2
    if c.isalpha():
        return 8 if c in "šÃÂ" else 1 if c.isupper() else 0
    if c.isspace() and c != "\x85":
        return 3
    if c in ".!?…":
        return 4
    if c in ",;:'\"“”„‚‘’«»":
        return 5
    if c in "-–—•*·▪◦‣()/":
        return 6
    return 8 if c in "�¤¶¼€" or "\x7f" <= c <= "\x9f" else 7


def character_distribution(characters: Counter, garbled: int) -> tuple[float, ...]:
    """Characters over ``CHARACTERS``; ``garbled`` sequences count as two more garbled ones each."""
    counts = [0] * len(CHARACTERS)
    for c, n in characters.items():
        k = _classes.get(c)
        if k is None:
            k = _classes[c] = _class(c)
        counts[k] += n
    counts[8] += 2 * garbled
    total = max(1, sum(counts))
    return tuple(n / total for n in counts)


def _paragraphs(text: str) -> list[str]:
    """Lines, with hard-wrapped ones put together again. Looks at the last line of a paragraph only, so it is linear."""
    out: list[list[str]] = []
    size, joinable = 0, False  # of the open paragraph: characters, and whether its last line may go on
    for line in _BREAKS.split(text):
        bare = line.strip()
        if not bare:
            joinable = False
            continue
        rows = _cells(bare) > 0
        if (
            joinable and size >= 30 and not rows and not _BULLET.match(line) and not _URL.match(bare)
            and (bare[0].islower() or bare[0].isdigit() or (len(out[-1][-1]) >= 45 and " " in out[-1][-1]))
        ):
            out[-1].append(bare)
            size += len(bare) + 1
        else:
            out.append([bare if not bare.startswith("\t") else line])
            size = len(bare)
        joinable = not rows and _STOP.search(bare) is None
    return ["\n".join(x) for x in out]


def _without_tail(flat: str) -> str:
    """The line without signs at its end that stand apart; looks at no character twice."""
    end = len(flat)
    if not end or flat[-1].isalnum() or flat[-1] in _KEPT:
        return flat
    while True:
        i = end
        while i and not (flat[i - 1].isalnum() or flat[i - 1].isspace() or flat[i - 1] in _KEPT):
            i -= 1
        if i in (0, end) or not flat[i - 1].isspace():
            return flat[:end]
        while i and flat[i - 1].isspace():
            i -= 1
        end = i


def _shape(line: str) -> int:
    """Of ``LINES``, by how the (unwrapped) line begins, ends and is divided."""
    flat = _without_tail(line.replace("\n", " ").strip())
    if _cells(line) >= 2:
        return 0
    garbled = _garbled(flat)
    if not any(c.isalnum() for c in flat) or (garbled >= 3 and garbled > 0.03 * len(flat)):
        return 6
    ends = (_STOP.search(flat) is not None and not flat.endswith(":")) or _INNER_STOP.search(flat) is not None
    if not ends and _BULLET.match(flat):
        return 1
    if " " not in flat and len(flat) > 20:
        return 6
    return 2 if ends else 3 if len(flat) < 35 else 4 if len(flat) < 90 else 5


def line_distribution(lines: list[str]) -> tuple[float, ...]:
    """Characters of the lines over ``LINES``."""
    counts = [0] * len(LINES)
    for line in lines:
        counts[_shape(line)] += len(line)
    total = max(1, sum(counts))
    return tuple(n / total for n in counts)


def distributions(text: str, lines: list[str], tokens: Counter, characters: Counter) -> tuple[dict[str, tuple], tuple, tuple]:
    """The words' (by language), characters' and lines' distributions."""
    return word_distributions(tokens), character_distribution(characters, _garbled(text)), line_distribution(lines)


def _words_for(name: str, words: dict[str, tuple]) -> tuple[float, ...]:
    """The words as the profile's language sees them; profiles of no language see the mean."""
    return words[name[-2:]] if name in PROSE else tuple(sum(x) / len(x) for x in zip(*words.values()))


def nearest(seen: tuple[dict[str, tuple], tuple, tuple], profiles: dict | None = None) -> tuple[str, float]:
    """(nearest profile, its weighted divergence)."""
    words, characters, lines = seen
    best, distance = "noise", math.inf
    for name, (a, b, c) in (PROFILES if profiles is None else profiles).items():
        d = WEIGHTS[0] * divergence(_words_for(name, words), a) + WEIGHTS[1] * divergence(characters, b) + WEIGHTS[2] * divergence(lines, c)
        if d < distance:
            best, distance = name, d
    return best, distance


def _whole(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", _INVISIBLE.sub("", text))


def fit_profiles(sample: list[tuple[str, str]]) -> dict[str, tuple[tuple[float, ...], ...]]:
    """Profiles from at most ``SAMPLE`` pairs of text and kind (a key of ``PROFILES``): the means of each kind's distributions."""
    if len(sample) > SAMPLE:
        raise ValueError(f"more than {SAMPLE} texts; profiles are fitted on a bounded sample")
    sums: dict[str, list] = {}
    for text, kind in sample:
        text = _whole(text)
        lines = _paragraphs(text)
        if lines:
            words, characters, shapes = distributions(text, lines, Counter(_TOKEN.findall(text)), Counter(text))
            sums.setdefault(kind, []).append((_words_for(kind, words), characters, shapes))
    return {kind: tuple(tuple(sum(x) / len(rows) for x in zip(*part)) for part in zip(*rows)) for kind, rows in sums.items()}


def describe(text: str | None, lang: str | None = None) -> dict:
    """Statistics of one text. Null, empty and blank texts have zero counts and the profile ``empty``."""
    zero = {
        "n_words": 0, "mean_word_length": 0.0, "symbol_ratio": 0.0, "terminated_lines": 0.0, "common_words": 0.0, "digit_ratio": 0.0,
        "distinct_words": 0.0, "profile": "empty", "distance": 0.0,
    }
    if not text or not text.strip():
        return zero
    text = _whole(text)
    lines = _paragraphs(text)
    if not lines:
        return zero
    tokens, characters = Counter(_TOKEN.findall(text)), Counter(text)
    best, distance = nearest(distributions(text, lines, tokens, characters))
    words: Counter = Counter()
    for w, n in tokens.items():
        if w[0].isalpha():
            words[w.lower()] += n
    n_words = words.total()
    known = FUNCTION_WORDS.get((lang or "").lower(), _ALL_FUNCTION)
    characters = Counter({c: n for c, n in characters.items() if not c.isspace()})
    n_characters = max(1, characters.total())
    raw = [x for x in _BREAKS.split(text) if x.strip()]
    return {
        "n_words": n_words,
        "mean_word_length": sum(len(w) * n for w, n in words.items()) / n_words if n_words else 0.0,
        "symbol_ratio": sum(n for c, n in characters.items() if not c.isalnum()) / n_characters,
        "terminated_lines": sum(_STOP.search(x.strip()) is not None for x in raw) / max(1, len(raw)),
        "common_words": sum(n for w, n in words.items() if w in known) / n_words if n_words else 0.0,
        "digit_ratio": sum(n for c, n in characters.items() if c.isdigit()) / n_characters,
        "distinct_words": len(words) / n_words if n_words else 0.0,
        "profile": best,
        "distance": distance,
    }


SCHEMA = (
    "doc_id bigint, n_words bigint, mean_word_length double, symbol_ratio double, terminated_lines double, common_words double, digit_ratio double, distinct_words double, "
    "profile string, distance double"
)


def text_statistics(documents: DataFrame) -> DataFrame:
    """One row of statistics a document (``doc_id``, ``text``, ``lang``); see ``describe``. Repeated rows give rows each."""
    bound_arrow(documents.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = [describe(t if isinstance(t, str) else None, x if isinstance(x, str) else None) for t, x in zip(pdf["text"], pdf["lang"])]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")[1:]])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return spread(documents.select("doc_id", "text", "lang")).mapInPandas(run, SCHEMA)


def not_prose(documents: DataFrame) -> DataFrame:
    """``doc_id`` of documents that are mainly a list, a table or junk; empty ones are no cases."""
    return text_statistics(documents).where("profile not like 'prose%' and profile <> 'empty'").select("doc_id")
