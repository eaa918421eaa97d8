"""Relevance scores: weighted keyword and length rules, unrolled into native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltloom.config import ScoreRule, Scoring
from siltloom.functions.text import normalise, normalise_text, trim

FRAGMENT_PENALTY = -2


def haystack(title: Column, intro: Column, body: Column) -> Column:
    """Normalised title, intro and body; neither url nor markup."""
    empty = F.lit("")
    return normalise(F.concat(F.coalesce(title, empty), F.lit("\n"), F.coalesce(intro, empty), F.lit("\n"), F.coalesce(body, empty)))


def _hit(hay: Column, needle: str) -> Column:
    """Whitespace alone is always found; an empty needle never is (they are dropped from the configuration)."""
    return F.lit(False) if needle == "" else F.contains(hay, F.lit(normalise_text(needle)))


def _matches(hay: Column, length: Column, rule: ScoreRule) -> Column:
    out = F.lit(False)
    for needle in rule.match_any:
        out = out | _hit(hay, needle)
    if rule.body_text_length_lt is not None:
        out = out | ((length > 0) & (length < rule.body_text_length_lt))
    return out


def _reason(hay: Column, rule: ScoreRule) -> Column:
    name = F.lit("rule")
    for needle in reversed(rule.match_any[:1]):
        name = F.lit(needle)
    return F.concat(F.lit(f"{rule.score:+d} \""), name, F.lit('"'))


def score_columns(rules: Scoring, url: Column, title: Column, intro: Column, body: Column, hay: Column | None = None) -> tuple[Column, Column]:
    """(score, reasons). Each matching rule counts once; the sign is the configuration's; a fragment costs two."""
    hay = haystack(title, intro, body) if hay is None else hay
    length = F.char_length(trim(F.concat(F.coalesce(intro, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))))
    score, reasons = F.lit(0), []
    for rule in (*rules.positive, *rules.negative):
        hit = _matches(hay, length, rule)
        score = score + F.when(hit, rule.score).otherwise(0)
        reasons.append(F.when(hit, _reason(hay, rule)))
    fragment = F.contains(url, F.lit("#"))
    score = score + F.when(fragment, FRAGMENT_PENALTY).otherwise(0)
    reasons.append(F.when(fragment, F.lit(f'{FRAGMENT_PENALTY} "Fragment-URL"')))
    return score, F.array_compact(F.array(*reasons))


def score(teasers: DataFrame, rules: Scoring) -> DataFrame:
    """``teasers`` (``url, title, introText, body_text``) with ``score`` and ``reasons``; the haystack is built once a row."""
    hay = teasers.withColumn("_hay", haystack(F.col("title"), F.col("introText"), F.col("body_text")))
    points, reasons = score_columns(rules, F.col("url"), F.col("title"), F.col("introText"), F.col("body_text"), F.col("_hay"))
    return hay.withColumns({"score": points, "reasons": reasons}).drop("_hay")


def relevant(teasers: DataFrame, rules: Scoring, forced: tuple[str, ...] = ()) -> DataFrame:
    """Teasers of at least ``min_score``, forced urls left out; all of them where scoring is off."""
    if not rules.active:
        return teasers
    if forced:
        teasers = teasers.where(~F.col("url").isin(list(forced)))
    return score(teasers, rules).where(F.col("score") >= rules.min_score).drop("score", "reasons")
