"""Text cut off by field limits or in transfer (problem 6).

Method: a structural completeness check decides first: a stack automaton finds markup, entities, escapes and multibyte
sequences that were broken off, and brackets and quotes left open. Then missing terminators decide against the baseline
of the source: how its texts end, and its own cap (given, or told by the heap of lengths at it). Only what is still
undecided, mostly titles, which have no terminators, is held against the corpus: how often the last words go on
elsewhere, how often a longer word stands in their place, and how often a text ends with them.

Plan: every row is judged where it is read, so most never move. Words in their contexts are 64-bit keys; a bitmap of
the keys that are asked for goes to the tasks, which count only these, in arrays, before anything is shuffled. Rows that
ask the same share one answer, and are joined with it by a join from which hot answers are taken out.
"""

from __future__ import annotations

import hashlib
import re
from html.entities import name2codepoint

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltloom.functions.skew import join_counted
from siltloom.llm.format_duplicates import canonical, canonical_url
from siltloom.llm.residue import _registry_names
from siltloom.session import bound_arrow, cut, small_side, spread

FIELDS = ("title", "introtext")
_TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|\d+")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*?(/?)>")
#: Ends that are broken in themselves: a tag, escape or multibyte sequence begun and not ended; an entity only if it begins as one does.
_BROKEN = re.compile(r"(?:<(?:[a-zA-Z/!][^<>]*)?|&#[xX]?[0-9a-fA-F]{0,6}|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|(?:%[0-9A-Fa-f]{2})+%[0-9A-Fa-f]?|�+|[\ud800-\udfff]|[ÂÃ])\Z")
_ENTITY = re.compile(r"(?P<before>\w*)&(?P<name>[a-zA-Z]{0,8})\Z")
_MARK = re.compile(r"(?:\.\s?\.\s?\.|…|\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\))[\s\"”“»')\]]*\Z")
_STOP = re.compile(r"[.!?。][\s\"”“»«’')\]]*\Z")
_AFTER_STOP = re.compile(r"[.!?](?:[\s\"”“»«’')\]]|\Z)")
#: An end that closes a structure.
_CLOSERS = frozenset("})]%#@“”»\"_>")
_FORMAT = re.compile(r"%\([^()]*\)[sdf]\Z")
_ORDINAL = re.compile(r"\d\.\W*\Z")
_OPENED = re.compile(r"[.!?]\s+[«„“(\[]\s*\Z")
#: Lengths over which values cut at a word's end heap up below a cap.
SPREAD = 16
#: A text of several sentences needs a terminator where at least this share of its source's have one (the rest are cut ones).
STOPPED = 0.05
_VOID = frozenset(("br", "hr", "img", "input", "wbr"))
_PAIRS = {")": "(", "]": "[", "}": "{", "“": "„", "»": "«", "”": "“"}
_BRACKETS = re.compile(r"[()\[\]{}„«“»”]")
#: Bits of the bitmap of asked keys: at least, at most (16 MB), and for each key.
MIN_BITS, MAX_BITS, BITS_A_KEY = 1 << 20, 1 << 27, 16
#: Distinct words a worker keeps; beyond this number its store starts anew.
MAX_KNOWN = 200_000
#: A heap of lengths is a cap when it has this share of the values, and this many times the lengths around it.
_HEAP_SHARE, _HEAP_TIMES = 0.02, 4.0


def open_structure(text: str) -> tuple[bool, bool]:
    """(markup left open, quotes or brackets left open), by a stack over the text."""
    tags: list[str] = []
    plain = text
    if "<" in text:
        for m in _TAG.finditer(text):
            name = m[2].lower()
            if m[1]:
                if name in tags:
                    while tags.pop() != name:
                        pass
            elif not m[3] and name not in _VOID:
                tags.append(name)
        plain = _TAG.sub("", text)
    stack: list[str] = []
    for c in _BRACKETS.findall(plain):
        if c in "([{„«":
            stack.append(c)
        elif c in "“":
            if stack and stack[-1] == "„":
                stack.pop()
            else:
                stack.append(c)
        elif stack and stack[-1] == _PAIRS[c]:
            stack.pop()
    return bool(tags), bool(stack)


def broken_end(bare: str) -> int | None:
    """Where an end that is broken in itself begins; None for a whole end.

    Letters after "&" are a begun entity only if one begins so, and if the sign stands in a word ("gr&uu") or two letters
    follow ("&nb"); names as "R&B", "H&M" or "b&b" and a lone "&" between words are whole.
    """
    if m := _BROKEN.search(bare):
        return m.start()
    tail = bare[-40:]
    if "&" in tail[-9:] and (m := _ENTITY.search(tail)):
        before, name = m["before"], m["name"]
        inside = before[-1:].islower() and len(before) + len(name) > 2
        if (inside or (len(name) > 1 and not before)) and (not name or any(e.startswith(name) for e in name2codepoint)):
            return len(bare) - len(tail) + m.end("before")
    return None


def name_set(names: tuple[str, ...]) -> frozenset[str]:
    """Site names as words, so that texts that differ in the name alone are one witness of their form."""
    return frozenset(n.casefold() for n in names)


def tokens(text: str, names: frozenset[str] = frozenset()) -> tuple[list[str], list[bool]]:
    """Lower-case words, numbers (each is "9") and site names (each is "@"), and whether a sentence ends after each."""
    raw = _TOKEN.findall(text)
    words = ["9" if w[0].isdigit() else w.casefold() for w in raw]
    stops = [False] * len(raw)
    for i in _stops(text, raw):
        stops[i] = True
    return ["@" if w in names else w for w in words], stops


def _stops(text: str, raw: list[str]) -> list[int]:
    """The words after which a sentence ends; not before lower case or numbers, as after abbreviations, nor after numbers."""
    gaps = _TOKEN.split(text)
    return [
        i - 1
        for i in range(1, len(raw))
        if len(gaps[i]) > 1 and not raw[i - 1][0].isdigit() and not raw[i][0].isdigit() and not raw[i][0].islower() and _AFTER_STOP.search(gaps[i])
    ]


def _without_end(text: str) -> tuple[str, bool, bool, bool, str]:
    """(the text that is counted, marked, stopped, broken, the same before marks were taken out): markup, broken ends and marks of omission are out."""
    bare = _TAG.sub(" ", text).strip() if "<" in text else text.strip()
    at = broken_end(bare)
    if at is not None:
        bare = bare[:at]
    marked = _MARK.search(bare) is not None
    stopped = not marked and _STOP.search(bare) is not None
    return (_MARK.sub("", bare) if marked else bare), marked, stopped, at is not None or _OPENED.search(bare) is not None, bare


def shape(text: str) -> dict:
    """What is judged of one value."""
    return dict(zip(_SHAPE, _shape(text)))


_SHAPE = ("broken", "mark", "stop", "tag_open", "closed", "quote_open", "w", "body")


def _shape(text: str) -> tuple:
    body, mark, stop, broken, bare = _without_end(text)
    tag_open, quote_open = open_structure(text)
    raw = _TOKEN.findall(body)
    number = bool(raw) and raw[-1][0].isdigit()
    if stop and number and _ORDINAL.search(body):
        stop = False  # an ordinal number, not the end of a sentence
    closed = not mark and not quote_open and bare != "" and (bare[-1] in _CLOSERS or _FORMAT.search(bare) is not None)
    return broken, mark, stop, tag_open, closed, quote_open, "" if not raw else "9" if number else raw[-1].casefold(), body


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


_U = np.uint64
_BEFORE = _U(_hash("^"))
_POWER = _U(0x9E3779B97F4A7C15)


def _keys(level: int, w, c1=_U(0), c2=_U(0)):
    """64-bit keys of words in contexts; arrays of word hashes."""
    with np.errstate(over="ignore"):
        x = w * _U(0xC2B2AE3D27D4EB4F) + (c1 * _U(0x165667B19E3779F9) ^ (c2 * _U(0x27D4EB2F165667C5) + _U(level + 1) * _POWER))
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(29))


class Words:
    """Hashes and kinds of the distinct words met in a worker, by number."""

    def __init__(self, names: frozenset[str], wanted=None):
        self.names, self.wanted = names, wanted
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.hashes: list[int] = []
        self.endings: list[int] = []  # hash of the last four letters, 0 for short words
        self.own: list[int] = []  # hash of a site name itself, 0 for others
        self.begun: list[tuple[int, ...]] = []  # hashes of the word's beginnings that are asked for

    def number(self, raw: str) -> int:
        n = self.numbers.get(raw)
        if n is None:
            w = "9" if raw[0].isdigit() else raw.casefold()
            name = w in self.names
            n = self.numbers[raw] = len(self.hashes)
            self.hashes.append(_hash("@" if name else w))
            self.own.append(_hash(w) if name else 0)
            self.endings.append(_hash(w[-4:]) if len(w) > 4 and not name else 0)
            begun: tuple[int, ...] = ()
            if self.wanted is not None and len(w) > 1:
                h, heads = hashlib.blake2b(digest_size=8), []
                for c in w[:-1]:
                    h.update(c.encode("utf-8", "surrogatepass"))
                    heads.append(int.from_bytes(h.copy().digest(), "little"))
                heads = np.array(heads, _U)
                begun = tuple(heads[self.wanted(_keys(1, heads))].tolist())
            self.begun.append(begun)
        return n

    def flat(self, texts: list[str]) -> dict[str, np.ndarray]:
        """All words of ``texts`` in one row: ``w`` (number), ``text``, ``h``, ``c1``, ``c2``, ``start`` (hash of all words before), ``stop``, ``first`` (in the first sentence), ``last``."""
        if len(self.numbers) > MAX_KNOWN:
            self.clear()
        known, numbers, sizes, stops = self.numbers, [], [], []
        for text in texts:
            raw = _TOKEN.findall(text)
            at = len(numbers)
            numbers += [n if (n := known.get(r)) is not None else self.number(r) for r in raw]
            stops += [at + i for i in _stops(text, raw)]
            sizes.append(len(raw))
        sizes = np.array(sizes, np.int64)
        w = np.array(numbers, np.int64)
        h = np.array(self.hashes, _U)[w] if len(w) else np.zeros(0, _U)
        begins = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(w)) - begins[text] if len(w) else w
        c1, c2 = np.full(len(w), _BEFORE), np.full(len(w), _BEFORE)
        c1[1:] = np.where(place[1:] > 0, h[:-1], _BEFORE)
        c2[2:] = np.where(place[2:] > 1, h[:-2], _BEFORE)
        stop = np.zeros(len(w), bool)
        stop[stops] = True
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(sizes.max()) if len(sizes) else 0, _POWER))
            terms = h * powers[place] if len(w) else h
            sums = np.cumsum(terms, dtype=_U) - terms
            start = sums - sums[begins[text]] if len(w) else h
        ended = np.cumsum(stop) - stop
        first = ended == ended[begins[text]] if len(w) else stop
        last = place == sizes[text] - 1 if len(w) else stop
        return {"w": w, "text": text, "h": h, "c1": c1, "c2": c2, "start": start, "stop": stop, "first": first, "last": last}


def _asked_bits(asked: DataFrame) -> tuple[bytes, int]:
    """(bitmap, bits) of the keys ``q``. It never misses one and has at most ``MAX_BITS`` bits.

    Tasks pass over keys of which nobody wants to know; where more are asked for than the bitmap can tell apart,
    more is counted, and the result is the same.
    """
    n, bits = asked.count(), MIN_BITS
    while bits < MAX_BITS and bits < BITS_A_KEY * n:
        bits *= 2
    bit = F.col("q").bitwiseAND(F.lit(bits - 1)) + 1  # numbered from 1, as the functions do
    parts = asked.select(bit.alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bytes"))
    out = bytearray(bits // 8)
    for part, chunk in parts.collect():  # at most MAX_BITS / 8 bytes in all
        out[(part - 1) * 4096 : (part - 1) * 4096 + len(chunk)] = chunk
    return bytes(out), bits


def _summed(q: list, counts: list[list]) -> pd.DataFrame:
    """One row a key."""
    q = np.concatenate(q)
    keys, at = np.unique(q, return_inverse=True)
    out = {"q": keys.view(np.int64)}
    for name, parts in zip(("mid", "eos", "end", "pre"), counts):
        out[name] = np.bincount(at, np.concatenate(parts), len(keys)).astype(np.int64)
    return pd.DataFrame(out)


def _counter(names: tuple[str, ...], shared, bits: int):
    """Counts asked words in their contexts (levels: 4: all words before, 3, 2, 1: two, one, none; 0: endings of words)."""

    def run(batches):
        asked = np.frombuffer(shared.value, np.uint8)

        def wanted(q):
            b = q & _U(bits - 1)
            return asked[b >> _U(3)] >> (b & _U(7)).astype(np.uint8) & 1 == 1

        known = Words(name_set(names), wanted)
        nine = _U(_hash("9"))
        for pdf in batches:
            ends = [_without_end(x) for x in pdf["value"]]
            stopped = np.array([x[2] for x in ends], bool)
            records = pdf["records"].to_numpy().astype(float)
            t = known.flat([x[0] for x in ends])
            text, h, c1, c2, start, first = (t[k] for k in ("text", "h", "c1", "c2", "start", "first"))
            eos = np.where(t["last"], stopped[text] & (h != nine), t["stop"])
            end = t["last"] & ~eos
            mid = ~eos & ~end
            keys, counts = [], [[], [], [], []]

            def add(q, n_mid, n_eos, n_end, n_pre):
                hit = wanted(q)
                if hit.any():
                    keys.append(q[hit])
                    for into, n in zip(counts, (n_mid, n_eos, n_end, n_pre)):
                        into.append(np.broadcast_to(n, len(q))[hit].astype(float))

            one = np.ones(len(h))
            add(_keys(1, h), mid, eos, end, 0)
            add(_keys(2, h, c1), mid, eos, end, 0)
            add(_keys(3, h, c1, c2), mid, eos, end, 0)
            add(_keys(4, h[first], start[first]), mid[first], eos[first], end[first] * records[text[first]], 0)
            endings, own = np.array(known.endings, _U)[t["w"]], np.array(known.own, _U)[t["w"]]
            add(_keys(0, endings[(endings > 0) & ~end]), one[(endings > 0) & ~end], 0, 0, 0)
            add(_keys(1, own[own > 0]), one[own > 0], 0, 0, 0)
            # the beginnings of each word that are asked for, in the word's contexts
            many = np.array([len(x) for x in known.begun], np.int64)[t["w"]]
            many[end & (own == 0)] = 0  # a site name stands for all names in its contexts, and for itself without one
            if many.sum():
                heads = np.array([x for i in t["w"][many > 0] for x in known.begun[i]], _U)
                at = np.repeat(np.flatnonzero(many), many[many > 0])
                add(_keys(1, heads), 0, 0, 0, 1)
                heads, at = heads[own[at] == 0], at[own[at] == 0]
                add(_keys(2, heads, c1[at]), 0, 0, 0, 1)
                add(_keys(3, heads, c1[at], c2[at]), 0, 0, 0, 1)
                add(_keys(4, heads[first[at]], start[at][first[at]]), 0, 0, 0, 1)
            if keys:
                yield _summed(keys, counts)

    return run


def key_counts(values: DataFrame, asked: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """``q, mid, eos, end, pre`` of the keys in ``asked`` (``q``, distinct) over distinct values (``value``, and ``records`` that have it).

    ``mid``: the text goes on, ``eos``: a sentence ends, ``end``: the value ends without a stop, ``pre``: a longer
    word that begins with the word stands in its place.
    """
    bitmap, bits = _asked_bits(asked)
    shared = values.sparkSession.sparkContext.broadcast(bitmap)
    counted = spread(values.select("value", "records")).mapInPandas(_counter(names, shared, bits), "q bigint, mid bigint, eos bigint, end bigint, pre bigint")
    return counted.groupBy("q").agg(*[F.sum(c).alias(c) for c in ("mid", "eos", "end", "pre")])


def caps(values: DataFrame, sites: DataFrame) -> DataFrame:
    """``sp_source, field, cap``: the configured cap, else the length at which a source's unfinished values heap up."""
    given = sites.select(
        "sp_source", F.explode(F.map_from_arrays(F.array(F.lit("title"), F.lit("introtext")), F.array("title_max_chars", "intro_max_chars"))).alias("field", "given")
    ).dropDuplicates(["sp_source", "field"])
    end = F.substring("value", -64, 64)  # how a value ends is seen in its last signs
    lengths = values.groupBy("sp_source", "field", F.length("value").alias("len")).agg(F.count("*").alias("n"), F.count_if(~end.rlike(r"[.!?]\W*$") | end.rlike(r"(\.\.\.|…)\W*$")).alias("open"))
    group = Window.partitionBy("sp_source", "field")
    near = group.orderBy("len").rangeBetween(-6, 6)
    below = group.orderBy("len").rangeBetween(-SPREAD, 0)
    heaps = (
        lengths.where("len >= 60")
        .withColumns({"around": (F.sum("open").over(near) - F.col("open")) / 12.0, "all": F.sum("n").over(group), "all_open": F.sum("open").over(group), "spread": F.sum("open").over(below)})
        .groupBy("sp_source", "field")
        .agg(
            F.max_by(F.when((F.col("open") >= 5) & (F.col("open") >= _HEAP_SHARE * F.col("all")) & (F.col("open") >= _HEAP_TIMES * F.col("around")), F.col("len")), "open").alias("sharp"),
            F.max_by(F.when((F.col("spread") >= 10) & (F.col("spread") >= 0.3 * F.col("all_open")), F.col("len")), F.struct("spread", -F.col("len"))).alias("wide"),
        )
    )
    known = given.join(heaps, ["sp_source", "field"], "full_outer").select("sp_source", "field", F.coalesce("given", "sharp", "wide").alias("cap"))
    return known


def baselines(shaped: DataFrame) -> DataFrame:
    """``sp_source, field, stopped``: the share of values with a sentence's end in them that end with a terminator or mark."""
    sentences = shaped.where("(stop or mark or not one_sentence) and w <> ''")
    return sentences.groupBy("sp_source", "field").agg(F.avg((F.col("stop") | F.col("mark")).cast("double")).alias("stopped"))


_SHAPED = (
    "teaser_id bigint, sp_source string, field string, k bigint, broken boolean, mark boolean, stop boolean, tag_open boolean, closed boolean, quote_open boolean, w string, "
    "one_sentence boolean, q0 bigint, q1 bigint, q2 bigint, q3 bigint, q4 bigint, len int"
)


def _shaper(names: tuple[str, ...]):
    def run(batches):
        known = Words(name_set(names))
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            shapes = pd.DataFrame([_shape(v) for v in pdf["value"]], columns=_SHAPE)
            # words only of those that a terminator does not settle
            open_ = np.flatnonzero(~shapes["stop"].to_numpy(bool) & (shapes["w"] != "").to_numpy(bool))
            t = known.flat(shapes.pop("body").iloc[open_].tolist())
            last = np.flatnonzero(t["last"])
            at = open_[t["text"][last]]
            h, c1, c2, start, first = (t[k][last] for k in ("h", "c1", "c2", "start", "first"))
            shapes["one_sentence"] = True
            shapes.loc[at, "one_sentence"] = first
            ending = np.array([_hash(w[-4:]) for w in shapes["w"][at]], _U)
            for i, q in enumerate((_keys(0, ending), _keys(1, h), _keys(2, h, c1), _keys(3, h, c1, c2), _keys(4, h, start))):
                column = np.zeros(len(pdf), np.int64)
                column[at] = q.view(np.int64)
                shapes[f"q{i}"] = column
            yield pd.concat([pdf[["teaser_id", "sp_source", "field", "k"]], shapes, pdf["value"].str.len().astype("int32").rename("len")], axis=1)

    return run


def judge_values(teasers: DataFrame, sites: DataFrame) -> DataFrame:
    """``teaser_id, sp_source, field, is_cut, step`` of every value that is neither null nor blank; ``step``: what decided."""
    bound_arrow(teasers.sparkSession, 5000)
    names = _registry_names(sites)
    fields = F.explode(F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*FIELDS))).alias("field", "value")
    record = F.pmod(F.xxhash64(canonical_url(F.col("url"))), F.lit(64)).cast("int").alias("record")
    long = teasers.select("teaser_id", "sp_source", record, fields).where("trim(value) <> ''").withColumn("k", F.xxhash64("field", canonical(F.regexp_replace("value", "<[^<>]*>", " "))))
    long = cut(long, "p6-values")
    shaped = cut(spread(long.select("teaser_id", "sp_source", "field", "k", "value")).mapInPandas(_shaper(names), _SHAPED), "p6-shapes")
    limit = small_side(caps(long, sites).join(baselines(shaped), ["sp_source", "field"], "full_outer"), "p6-caps")
    first = cut(shaped.join(limit, ["sp_source", "field"], "left").withColumn("early", _by_structure_and_baseline()), "p6-first")
    undecided = first.where("early is null").withColumn("sig", F.xxhash64("k", "one_sentence", *[f"q{lv}" for lv in range(5)]))
    asking = cut(undecided.groupBy("sig").agg(F.count("*").alias("n"), F.first("k").alias("k"), F.first("one_sentence").alias("one_sentence"), *[F.first(f"q{lv}").alias(f"q{lv}") for lv in range(5)]), "p6-asking")
    each = [F.struct(F.lit(lv).alias("level"), F.col(f"q{lv}").alias("q")) for lv in range(4)] + [F.when(F.col("one_sentence"), F.struct(F.lit(4).alias("level"), F.col("q4").alias("q")))]
    asked = asking.select("sig", F.explode(F.array_compact(F.array(*each))).alias("x")).select("sig", "x.level", "x.q")
    keys = cut(asked.groupBy("q").agg(F.count("*").alias("asked")), "p6-keys")
    # formatting variants of one value are one witness; records that have it are counted by the bits they set among 64: enough to know one from several
    bits = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("record"))))
    records = F.greatest(F.lit(1), F.round(-64 * F.log(1 - F.least(bits, F.lit(63)) / 64)))
    witnesses = long.groupBy("k").agg(F.first("value").alias("value"), records.cast("bigint").alias("records"))
    answers = cut(keys.join(key_counts(witnesses, keys.select("q"), names), "q"), "p6-answers")
    answered = join_counted(asked, answers, ["q"], "asked", 5 * asking.count())
    per = {lv: F.max(F.when(F.col("level") == lv, F.struct("mid", "eos", "end", "pre"))).alias(f"l{lv}") for lv in range(5)}
    # texts that have a stop in another row are whole
    whole = shaped.where("stop").select("k").distinct().withColumn("whole", F.lit(True))
    evidence = asking.select("sig", "k", "n").join(answered.groupBy("sig").agg(*per.values()), "sig", "left").join(whole, "k", "left").drop("k")
    evidence = cut(evidence, "p6-evidence")
    total = evidence.agg(F.sum("n")).first()[0] or 0
    late = join_counted(undecided, evidence, ["sig"], "n", total).select("teaser_id", "sp_source", "field", _by_contexts().alias("is_cut"), F.lit("contexts").alias("step"))
    early = first.where("early is not null").select("teaser_id", "sp_source", "field", "early.is_cut", "early.step")
    return early.unionByName(late)


#: A text ends naturally where the ends seen elsewhere are at least this share of the places where it goes on.
#: A cut may fall anywhere, so of a form that goes on n times, far fewer than this share are cut just there.
NATURAL = 0.03
#: Characters from which on a text is expected to be a sentence.
LONG = 60
#: Continuations from which on rare ends in a context say something; below it a shorter context is asked.
SURE = 100


def _near_cap():
    return F.coalesce((F.col("len") >= F.col("cap") - 20) & (F.col("len") <= F.col("cap") + 3), F.lit(False))


def _at_cap():
    return F.coalesce(F.col("len") == F.col("cap"), F.lit(False))


def _by_structure_and_baseline():
    """``is_cut, step`` of what the automaton's end state or the terminators and cap of the source decide, else null."""
    said = lambda cut_, step: F.struct(F.lit(cut_).alias("is_cut"), F.lit(step).alias("step"))
    intro = F.col("field") == "introtext"
    return (
        F.when(F.col("broken") | F.col("tag_open") | (F.col("quote_open") & ~F.col("stop")), said(True, "structure"))
        .when(F.col("mark") & _near_cap(), said(True, "baseline"))
        .when(~F.col("mark") & (F.col("stop") | F.col("closed") | (F.col("w") == "")), said(False, "structure"))
        # where texts end with a stop, one of several sentences or of just the cap's length that has none was cut
        .when(~F.col("mark") & intro & (F.col("stopped") >= STOPPED) & (~F.col("one_sentence") | (_at_cap() & (F.col("len") >= LONG))), said(True, "baseline"))
    )


def _by_contexts():
    """The decision about the rest, as one expression over the evidence and the cap."""
    zero = F.lit(0)

    def level(n: int, least: int):
        """How natural an end is here (ends for each continuation), or null where too little was seen."""
        g = lambda c: F.coalesce(F.col(f"l{n}.{c}"), zero)
        ends, on = g("eos") + g("end") - 1, g("mid") + g("pre")  # the value itself is one of the ends
        return F.when((ends >= 2) | (on >= least) | ((ends >= 1) & (on == 0)), ends / F.greatest(on, F.lit(0.01)))

    ending = F.coalesce(F.col("l0.mid"), zero)
    novel = F.when(ending >= 3, 1.0).otherwise(0.0)  # a word hardly seen: does it end as words do?
    natural = F.coalesce(level(4, SURE), level(3, SURE), level(2, SURE), level(1, SURE), novel)
    g1 = lambda c: F.coalesce(F.col(f"l1.{c}"), zero)
    begun = (F.length("w") > 1) & (F.col("w") != "9") & (g1("mid") + g1("eos") <= 2 + 0.001 * g1("pre")) & (g1("pre") >= 10 + 3 * g1("end"))  # hardly a word itself
    g4 = lambda c: F.coalesce(F.col(f"l4.{c}"), zero)
    alone = (g4("end") + g4("eos") > 3) & (g4("mid") + g4("pre") == 0)  # a text found again and again, and never longer
    natural = F.when(begun & ~alone, 0.0).otherwise(natural)
    needed = F.when((_near_cap() & (F.col("field") == "introtext")) | _at_cap(), 10 * NATURAL).otherwise(NATURAL)
    return F.when(~F.col("mark") & (F.col("whole").isNotNull()), False).when(F.col("w") == "", False).otherwise(natural < needed)


def truncated(teasers: DataFrame, sites: DataFrame) -> DataFrame:
    """``teaser_id, field_name``: the values of ``title`` and ``introtext`` of which the end is missing.

    Null and blank values are no cases; repeated rows are judged alike and give rows each; an unknown source
    has no cap. An empty table gives no rows.
    """
    return judge_values(teasers, sites).where("is_cut").select("teaser_id", F.col("field").alias("field_name"))


def truncation_rates(teasers: DataFrame, sites: DataFrame) -> DataFrame:
    """``sp_source, field_name, n_values, n_cut, rate``: how often each source cuts each field's values."""
    return (
        judge_values(teasers, sites)
        .groupBy("sp_source", F.col("field").alias("field_name"))
        .agg(F.count("*").alias("n_values"), F.count_if("is_cut").alias("n_cut"))
        .withColumn("rate", F.col("n_cut") / F.col("n_values"))
    )
