"""Text cleaning and tokens."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col

MODEL_NOISE = r"(?U)(https?://\S+)|(@[\p{L}\p{N}_]+)|[#*`>|]|(&amp;)|\s+"
URL = r"(?U)https?://\S+"
NOT_TOKEN = r"[^\p{L}\p{N}_$#🚀]+"


def clean_for_model(text: Column | str) -> Column:
    """Links, handles and markup to spaces, trimmed and lower-cased (TXT1)."""
    spaced = F.regexp_replace(F.coalesce(as_col(text), F.lit("")), MODEL_NOISE, " ")
    return F.lower(F.trim(spaced))


def token_text(text: Column | str) -> Column:
    """Lower-case text in which only token characters and blanks are left."""
    lowered = F.lower(F.coalesce(as_col(text), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, URL, " "), NOT_TOKEN, " "))


def normal_form(token: Column, keep: Iterable[str]) -> Column:
    """Suffix rule that maps inflected forms together (TXT3)."""
    return (
        # Most words are short; the set is asked only for longer ones.
        F.when((F.length(token) <= 4) | token.isin(*sorted(keep)), token)
        .when(token.endswith("st"), F.concat(_drop(token, 2), F.lit("en")))
        .when(token.endswith("t"), F.concat(_drop(token, 1), F.lit("en")))
        .when(token.endswith("e"), F.concat(token, F.lit("n")))
        .otherwise(token)
    )


def _drop(token: Column, n: int) -> Column:
    return F.substring(token, F.lit(1), F.length(token) - n)


def lexicon_tokens(text: Column | str, keep: Iterable[str]) -> Column:
    """Normalised tokens of a text, in order (TXT2)."""
    keep = tuple(keep)
    words = F.filter(F.split(token_text(text), " "), lambda t: t != "")
    return F.transform(words, lambda t: normal_form(t, keep))


def combined_text(title: Column | str, body: Column | str, sep: str = " ") -> Column:
    """Title and body with NULL as empty (TXT4)."""
    empty = F.lit("")
    return F.concat(F.coalesce(as_col(title), empty), F.lit(sep), F.coalesce(as_col(body), empty))
