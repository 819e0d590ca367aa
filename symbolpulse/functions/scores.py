"""Sentiment scores, weights and small numeric rules."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col
from .fixed_values import (
    EXTRA_KEYWORD_SCORES,
    INTENSITY_WEIGHTS,
    KEYWORD_SCORES,
    NEGATION_MARKERS,
    UPVOTE_CAP,
    WORD_BOOST_LIMIT,
    WORD_BOOSTS,
)
from .text import normal_form, token_text


def normal_word(word: str, keep) -> str:
    if word in keep or len(word) <= 4:
        return word
    for ending, cut in (("st", 2), ("t", 1)):
        if word.endswith(ending):
            return word[:-cut] + "en"
    return word + "n" if word.endswith("e") else word


def merge_keywords(base: Mapping[str, int], extra: Mapping[str, int], markers=()) -> dict[str, int]:
    """``base`` plus the normal forms of ``extra``; the first definition wins (SRC8)."""
    merged = dict(base)
    for word, score in extra.items():
        key = normal_word(str(word).lower(), merged.keys() | set(markers))
        merged.setdefault(key, int(score))
    return merged


@dataclass(frozen=True)
class Lexicon:
    """Word scores and markers; a small configuration that travels in the plan."""

    keywords: Mapping[str, float] = field(
        default_factory=lambda: merge_keywords(KEYWORD_SCORES, EXTRA_KEYWORD_SCORES, NEGATION_MARKERS)
    )
    intensities: Mapping[str, float] = field(default_factory=lambda: dict(INTENSITY_WEIGHTS))
    markers: frozenset[str] = frozenset(NEGATION_MARKERS)

    def configured(self, intensities: Mapping[str, float] | None = None, markers=()) -> Lexicon:
        """Intensities override, markers extend (SRC9)."""
        weights = {**self.intensities, **{k.lower(): v for k, v in (intensities or {}).items()}}
        return Lexicon(self.keywords, weights, self.markers | {m.lower() for m in markers})

    @property
    def kept_words(self) -> frozenset[str]:
        return frozenset(self.keywords) | self.markers


DEFAULT_LEXICON = Lexicon()


@dataclass(frozen=True)
class _Class:
    """Words that act alike: same score, multiplier and marker role."""

    sign: str
    marker: bool
    score: float | None
    plain: float | None
    weight: float | None
    words: tuple[str, ...]


OTHER = "."


def _classes(lexicon: Lexicon) -> list[_Class]:
    roles: dict[tuple, list[str]] = {}
    for word in {*lexicon.markers, *lexicon.keywords, *lexicon.intensities}:
        score = lexicon.keywords.get(word)
        role = (word in lexicon.markers, score, score, lexicon.intensities.get(word))
        roles.setdefault(role, []).append(word)
    # A literal ``not_word`` in a text counts as the negated keyword already.
    for word, score in lexicon.keywords.items():
        if f"not_{word}" not in lexicon.keywords:
            roles.setdefault((False, -score, None, None), []).append(f"not_{word}")
    # One character of the private-use area stands for each role.
    return [
        _Class(chr(0xE000 + i), *role, tuple(sorted(words)))
        for i, (role, words) in enumerate(sorted(roles.items(), key=str))
    ]


def _sign_of(token: Column, classes: list[_Class]) -> Column:
    every = [w for c in classes for w in c.words]
    sign = F.lit(OTHER)
    for c in classes:
        sign = F.when(token.isin(*c.words), c.sign).otherwise(sign)
    # One hash-set test settles the many words without a role.
    return F.when(token.isin(*every), sign).otherwise(OTHER)


def _by_sign(sign: Column, classes: list[_Class], value) -> Column:
    result = F.lit(None).cast("double")
    for c in classes:
        if value(c) is not None:
            result = F.when(sign == c.sign, float(value(c))).otherwise(result)
    return result


def lexicon_score(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Sum of keyword scores with negation and intensity, NULL without a hit (SCR1, SCR2).

    Words become one sign each by their role, and long runs of words without a role
    shrink to three, beyond which nothing reaches.  The rest is one left-to-right
    fold.  ``reach`` says how far a negation marker reaches: 0 not at all, 1 a
    filler token follows the marker, 2 the marker is the last token, 3 the last two
    tokens are markers (the second one then stands between marker and target, and
    uses up a waiting intensity).
    """
    classes = _classes(lexicon)
    words = F.split(token_text(text), " ")
    kept = lexicon.kept_words
    signs = F.array_join(F.transform(words, lambda t: _sign_of(normal_form(t, kept), classes)), "")
    short = F.regexp_replace(signs, r"\.{4,}", OTHER * 3)
    facts = F.transform(
        F.split(short, ""),
        lambda s: F.struct(
            s.isin(*[c.sign for c in classes if c.marker] or [""]).alias("marker"),
            _by_sign(s, classes, lambda c: c.score).alias("score"),
            _by_sign(s, classes, lambda c: c.plain).alias("plain"),
            _by_sign(s, classes, lambda c: c.weight).alias("weight"),
        ),
    )
    none = F.lit(None).cast("double")
    start = F.struct(
        F.lit(0.0).alias("total"),
        F.lit(False).alias("hit"),
        none.alias("pending"),
        F.lit(0).alias("reach"),
    )

    def step(state, tok):
        target = tok["score"].isNotNull() | tok["weight"].isNotNull()
        negated = target & (state["reach"] > 0)
        waiting = F.when(target & (state["reach"] == 3), none).otherwise(state["pending"])
        value = F.coalesce(F.when(negated, -tok["plain"]).otherwise(tok["score"]), F.lit(0.0))
        starts = waiting.isNull() & tok["weight"].isNotNull() & ~negated
        counts = ~starts & (value != 0)
        return F.when(
            tok["marker"],
            F.struct(
                state["total"].alias("total"),
                state["hit"].alias("hit"),
                state["pending"].alias("pending"),
                F.when(state["reach"] >= 2, 3).otherwise(2).alias("reach"),
            ),
        ).otherwise(
            F.struct(
                F.when(counts, state["total"] + value * F.coalesce(waiting, F.lit(1.0)))
                .otherwise(state["total"])
                .alias("total"),
                (state["hit"] | counts).alias("hit"),
                F.when(starts, tok["weight"]).otherwise(none).alias("pending"),
                F.when(~target & (state["reach"] >= 2), 1).otherwise(0).alias("reach"),
            )
        )

    # A text ending in an intensity leaves it pending, where it has no effect.
    return F.aggregate(facts, start, step, lambda s: F.when(s["hit"], s["total"]))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def scaled_boost(score: Column | str) -> Column:
    """Lexicon score as a small correction of a model score (SCR3)."""
    return clamp(F.coalesce(as_col(score), F.lit(0.0)) / 4.0, -0.6, 0.6)


def word_boost(cleaned: Column | str) -> Column:
    """Fixed boosts for single words of a cleaned text (SCR4)."""
    text = F.coalesce(as_col(cleaned), F.lit(""))
    total = F.lit(0.0)
    for word, boost in WORD_BOOSTS.items():
        total = total + F.when(text.rlike(rf"(?U)\b{word}\b"), boost).otherwise(0.0)
    return clamp(total, -WORD_BOOST_LIMIT, WORD_BOOST_LIMIT)


def label_scalar(entries: Column | str) -> Column:
    """``array<struct<label,score>>`` to [-1, 1]; the best score per label counts (SCR5)."""
    def best(label):
        named = F.filter(as_col(entries), lambda e: F.lower(F.trim(e["label"])) == label)
        top = F.array_max(F.transform(named, lambda e: F.coalesce(e["score"], F.lit(0.0))))
        return F.nullif(top, F.lit(0.0))

    positive = F.coalesce(best("positive"), best("bullish"), F.lit(0.0))
    negative = F.coalesce(best("negative"), best("bearish"), F.lit(0.0))
    return clamp(positive - negative, -1, 1)


def label_scalar_last(entries: Column | str) -> Column:
    """Variant of :func:`label_scalar`: the last entry of a label counts, two labels only."""
    def last(label):
        named = F.filter(as_col(entries), lambda e: F.lower(e["label"]) == label)
        return F.coalesce(F.get(F.reverse(named), F.lit(0))["score"], F.lit(0.0))

    return clamp(last("positive") - last("negative"), -1, 1)


def blend(model: Column | str, secondary: Column | str, lexicon: Column | str) -> Column:
    """Unsure model scores lean on a second scorer; the lexicon corrects both (SCR6)."""
    first, second = as_col(model), F.coalesce(as_col(secondary), F.lit(0.0))
    mixed = F.when((F.abs(first) < 0.2) & (second != 0), 0.6 * first + 0.4 * second).otherwise(first)
    return clamp(mixed + scaled_boost(lexicon), -1, 1)


def first_score(text, model=None, secondary=None, lexicon=None) -> Column:
    """First usable score: a non-zero model, a second scorer, the lexicon, 0 (SCR8)."""
    candidates = []
    if model is not None:
        candidates.append(F.nullif(as_col(model), F.lit(0.0)))
    if secondary is not None:
        candidates.append(as_col(secondary))
    if lexicon is not None:
        candidates.append(as_col(lexicon))
    blank = F.trim(F.coalesce(as_col(text), F.lit(""))) == ""
    return F.when(blank, 0.0).otherwise(F.coalesce(*candidates, F.lit(0.0)))


def fill_score(score: Column | str, text: Column | str, fresh: Column | str) -> Column:
    """Keep finite scores; score the rest unless the text is blank (SCR9)."""
    old = finite(score)
    blank = F.trim(F.coalesce(as_col(text), F.lit(""))) == ""
    return F.when(old.isNotNull(), old).when(~blank, as_col(fresh))


def finite(value: Column | str) -> Column:
    """The number as double, NULL if it is missing, no number or not finite."""
    number = as_col(value).try_cast("double")
    bad = F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(~bad, number)


def recommendation(score: Column | str) -> Column:
    """Buy, Sell or Hold by the sign (SCR10)."""
    return F.when(as_col(score) > 0, "Buy").when(as_col(score) < 0, "Sell").otherwise("Hold")


def _count(value: Column | str) -> Column:
    return F.greatest(F.coalesce(finite(value), F.lit(0.0)), F.lit(0.0))


def post_weight(upvotes: Column | str, comments: Column | str) -> Column:
    """Weight of a post by votes and comments (WGT1)."""
    return 1 + F.log10(1 + _count(upvotes)) + 0.2 * F.log10(1 + _count(comments))


def vote_weight(upvotes: Column | str) -> Column:
    """Weight of a post by votes only (WGT2)."""
    return 1 + F.log10(1 + as_col(upvotes))


def clean_votes(raw: Column | str, cap: int = UPVOTE_CAP) -> Column:
    """Votes as int between 0 and ``cap``, 0 if unreadable (VAL3)."""
    number = F.coalesce(as_col(raw).try_cast("bigint"), F.lit(0))
    return F.least(F.greatest(number, F.lit(0)), F.lit(cap)).cast("int")


def hotness_level(hotness: Column | str) -> Column:
    """0 to 3 by steps of 500 (FLT3)."""
    heat = as_col(hotness)
    return F.when(heat > 0, F.least(F.floor(heat / 500), F.lit(3))).otherwise(0).cast("int")


def price_test(op: Column | str, price: Column | str, threshold: Column | str) -> Column:
    """``price op threshold``; NULL for an unknown operator (FLT2)."""
    name, left, right = as_col(op), as_col(price), as_col(threshold)
    return (
        F.when(name == "<", left < right)
        .when(name == ">", left > right)
        .when(name == "<=", left <= right)
        .when(name == ">=", left >= right)
    )
