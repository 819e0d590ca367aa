"""Scoring posts with user models, and the enriched post table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import as_col
from ..functions.scores import (
    DEFAULT_LEXICON,
    clamp,
    label_scalar_last,
    lexicon_score,
    vote_weight,
    word_boost,
)
from ..functions.text import clean_for_model
from .tables import clean_posts, first_per_key

LabelModel = Callable[[list[str]], list[list[dict]]]
ScoreModel = Callable[[list[str]], list[float]]

LABELS = "array<struct<label:string,score:double>>"


def _on_present(texts: pd.Series, call: Callable, batch: int, skip_errors: bool) -> pd.Series:
    """Run ``call`` over the non-null texts; with ``skip_errors`` a failing batch stays NULL."""
    out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
    present = texts.dropna()
    for start in range(0, len(present), batch):
        part = present.iloc[start : start + batch]
        try:
            results = call(part.tolist())
        except Exception:
            if not skip_errors:
                raise
            continue
        for index, result in zip(part.index, results):
            out.at[index] = result
    return out


def label_scorer(model: LabelModel, batch: int = 32, skip_errors: bool = False) -> Callable[[Column], Column]:
    """A model that returns label scores per text, as a column function."""

    @pandas_udf(LABELS)
    def score(texts: pd.Series) -> pd.Series:
        return _on_present(texts, model, batch, skip_errors)

    return score


def number_scorer(model: ScoreModel, batch: int = 1024, skip_errors: bool = False) -> Callable[[Column], Column]:
    """A model that returns one number per text, as a column function."""

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return _on_present(texts, model, batch, skip_errors).astype("float64")

    return score


def score_texts(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    english: LabelModel | None = None,
    other: LabelModel | None = None,
    fallback: ScoreModel | None = None,
    skip_errors: bool = False,
) -> DataFrame:
    """Add ``score`` and ``method``: model by language, then fallback, then word rules (SCR7).

    A missing model hands its language to the other one.  Each model sees only the
    texts routed to it.  A model that raises fails the job; with ``skip_errors`` its batch
    goes to the next scorer, and counting ``method`` tells how often.
    """
    cleaned = df.withColumn("_clean", clean_for_model(text)).withColumn("_boost", word_boost("_clean"))
    filled = F.col("_clean") != ""
    is_english = F.coalesce(as_col(lang), F.lit("en")) == "en"
    columns = {}
    if english is not None and other is not None:
        columns["_english"] = label_scorer(english, skip_errors=skip_errors)(F.when(filled & is_english, F.col("_clean")))
        columns["_other"] = label_scorer(other, skip_errors=skip_errors)(F.when(filled & ~is_english, F.col("_clean")))
    elif english is not None:
        columns["_english"] = label_scorer(english, skip_errors=skip_errors)(F.when(filled, F.col("_clean")))
    elif other is not None:
        columns["_other"] = label_scorer(other, skip_errors=skip_errors)(F.when(filled, F.col("_clean")))
    scored = cleaned.withColumns(columns) if columns else cleaned

    value, method = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name in columns:
        got = F.col(name).isNotNull()
        value = F.when(got, label_scalar_last(name)).otherwise(value)
        method = F.when(got, F.lit(f"model:{name[1:]}")).otherwise(method)
    scored = scored.withColumn("_value", value).withColumn("method", method)
    if fallback is not None:
        # Only texts no model has scored reach the fallback.
        open_text = F.when(filled & F.col("_value").isNull(), F.col("_clean"))
        scored = scored.withColumn("_second", number_scorer(fallback, skip_errors=skip_errors)(open_text))
        scored = scored.withColumn(
            "method", F.when(F.col("_second").isNotNull(), "fallback").otherwise(F.col("method"))
        ).withColumn("_value", F.coalesce("_value", "_second"))
    return scored.select(
        *df.columns,
        F.when(~filled, 0.0)
        .when(F.col("_value").isNull(), F.col("_boost"))
        .otherwise(clamp(F.col("_value") + F.col("_boost"), -1, 1))
        .alias("score"),
        F.when(~filled, "empty").otherwise(F.coalesce("method", F.lit("rule-only"))).alias("method"),
    )


def enrich_posts(
    posts: DataFrame,
    score: Callable[[str], Column] | None = None,
    id_columns: Sequence[str] = ("id", "name", "link_id"),
    text_chars: int | None = None,
) -> DataFrame:
    """Cleaned, scored and weighted post rows, one per (id, ticker) (ENR1).

    Whole texts are scored; ``text_chars`` cuts them as in :func:`clean_posts`.

    Upsert the result into the enriched table by (id, ticker).
    """
    scorer = score or (lambda text: lexicon_score(text, DEFAULT_LEXICON))
    empty = F.lit(None).cast("double")
    rows = (
        clean_posts(posts, id_columns, text_chars)
        .select("id", F.upper("ticker").alias("ticker"), "created_utc", "text", "upvotes")
        .withColumn("sentiment_dict", scorer("text").cast("double"))
        .withColumn("sentiment_weighted", F.col("sentiment_dict") * vote_weight("upvotes"))
        .withColumns({c: empty for c in ("sentiment_ml", "return_1d", "return_3d", "return_7d")})
    )
    return first_per_key(rows, ["id", "ticker"], F.col("created_utc"), F.col("upvotes").desc(), F.col("text"))
