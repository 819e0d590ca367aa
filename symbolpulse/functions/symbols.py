"""Symbols in text, their normal forms, and names derived from companies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col
from .fixed_values import (
    CORPORATE_SUFFIXES,
    FREE_CASHTAG,
    MASTER_SUFFIXES,
    PLAIN_SYMBOL,
    PREFIX_CASHTAG,
    SYMBOL_STOPWORDS,
)


# Trimmed at the ends of a symbol: signs, and white space.
EDGES, BLANKS = "$#.,:;!?", " \t\n\x0b\f\r"


def strict_symbol(raw: Column | str) -> Column:
    """Upper-case symbol of detection, NULL if it is none (SYM4)."""
    bare = F.btrim(F.upper(F.trim(as_col(raw))), F.lit(EDGES))
    valid = (
        (F.length(bare) <= 10)
        & bare.rlike(r"^[A-Z0-9]+(\.[A-Z0-9]+)?$")
        & bare.rlike("[A-Z]")
        & ~bare.isin(*SYMBOL_STOPWORDS)
    )
    return F.when(valid, bare)


def loose_symbol(raw: Column | str) -> Column:
    """Upper-case symbol of the trend scan, NULL if it is none (SYM5)."""
    bare = F.regexp_replace(F.btrim(F.upper(as_col(raw)), F.lit(EDGES + BLANKS)), r"\s+", "")
    valid = (
        (F.length(bare) <= 12)
        & bare.rlike(r"^[A-Z0-9]+([.\-][A-Z0-9]+)*$")
        & bare.rlike("[A-Z]")
        & ~bare.isin(*SYMBOL_STOPWORDS)
    )
    return F.when(valid, bare)


def _hits(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit(pattern), F.lit(1))


def _normal(hits: Column, normal) -> Column:
    # Distinct before the normal form, which is the dear part, and after it.
    return F.array_compact(F.array_distinct(F.transform(F.array_distinct(hits), normal)))


def has_sign(text: Column | str) -> Column:
    """Does the text hold a tag sign?"""
    return as_col(text).contains("$") | as_col(text).contains("#")


def _tagged(text: Column | str, pattern: str) -> Column:
    # Few texts hold a sign; the others are not searched by the pattern, which looks behind at each place.
    return F.when(has_sign(text), _hits(text, pattern)).otherwise(F.array().cast("array<string>"))


def raw_cashtags(text: Column | str) -> Column:
    """What stands behind the signs of :func:`free_cashtags`, each time and as it is written."""
    return _tagged(text, FREE_CASHTAG)


def free_cashtags(text: Column | str) -> Column:
    """Distinct symbols tagged ``$X`` or ``#X`` as whole words (SYM1)."""
    return _normal(raw_cashtags(text), loose_symbol)


def cashtags(text: Column | str) -> Column:
    """Distinct tagged symbols of detection; long words give their prefix (SYM2)."""
    return _normal(_tagged(text, PREFIX_CASHTAG), strict_symbol)


def upper_symbols(text: Column | str) -> Column:
    """Distinct upper-case words that look like symbols."""
    return _normal(_hits(text, PLAIN_SYMBOL), strict_symbol)


def plain_symbols(text: Column | str) -> Column:
    """Distinct upper-case words that look like symbols, and all cashtags (SYM3)."""
    return F.array_union(upper_symbols(text), cashtags(text))


def symbol_variants(symbol: Column | str) -> Column:
    """The symbol and its forms without an exchange suffix (SYM6)."""
    upper = F.upper(as_col(symbol))
    return F.array_distinct(
        F.array(upper, *[F.substring_index(upper, sep, 1) for sep in (".", "-", ":")])
    )


def name_variants(name: Column | str) -> Column:
    """Alias candidates of a company name, suffixes taken off one by one (SYM7)."""
    spaced = F.regexp_replace(F.lower(F.coalesce(as_col(name), F.lit(""))), r"[^a-z0-9& ]+", " ")
    simple = F.trim(F.regexp_replace(spaced, " +", " "))
    words = F.split(simple, " ")
    # Length of the run of suffix words at the end.
    run = F.aggregate(
        words,
        F.lit(0),
        lambda n, word: F.when(word.isin(*CORPORATE_SUFFIXES), n + 1).otherwise(0),
    )
    shorter = F.when(
        run > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(run, F.lit(1))),
            lambda k: F.array_join(F.slice(words, F.lit(1), F.size(words) - k), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))
    spelled = F.when(simple.contains("&"), F.replace(simple, F.lit("&"), F.lit("and")))
    all_forms = F.concat(F.array_compact(F.array(simple, spelled)), shorter)
    return F.array_distinct(F.filter(all_forms, lambda v: F.length(v) >= 3))


def master_aliases(name: Column | str) -> Column:
    """Sorted aliases of a security-master name (SYM8)."""
    base = F.lower(F.trim(as_col(name)))
    cleaned = F.trim(F.regexp_replace(base, "[^a-z0-9]+", " "))
    words = F.filter(
        F.split(cleaned, " "), lambda w: (w != "") & ~w.isin(*MASTER_SUFFIXES)
    )
    forms = F.array(base, cleaned, F.array_join(words, " "), F.coalesce(F.get(words, F.lit(0)), F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda v: v != "")))
