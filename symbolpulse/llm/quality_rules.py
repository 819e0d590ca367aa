"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one "
    "der die das und ist von zu mit den des auf für im nicht ein eine sich dem es als auch an werden aus er hat dass sie "
    "de la le et les des en un du une que est pour qui dans au par il sur pas plus ne se son avec ce "
    "el los y del las por con no su para como más o pero sus le ya fue este ha sí porque"
).split()
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A metric must lie between ``low`` and ``high``; None leaves a side open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Thresholds of a document that is kept.  All metrics are ratios, so that they hold at any length.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.10),
    Rule("upper_share", None, 0.50),
    Rule("stop_word_share", 0.01, None),
    Rule("dup_line_share", None, 0.50),
)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_upper", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeated_words(hashes: Column) -> tuple[Column, Column]:
    """Sorted (hash, place) pairs, and the number of words in windows whose hash occurs again."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size(hashes) - 1

    def same(at: Column, other: Column) -> Column:
        return F.get(F.col("_pairs"), at)["h"] == F.get(F.col("_pairs"), other)["h"]

    places = F.filter(
        F.transform(
            F.col("_pairs"),
            lambda p, k: F.when(((k > 0) & same(k, k - 1)) | ((k < last) & same(k, k + 1)), p["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))
    return pairs, F.size(F.array_distinct(covered)).cast("long")


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts that the rules start from, all of whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    w, n = F.col("_words"), F.size("_words")
    hashes = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    )
    pairs, repeated = _repeated_words(F.col("_hashes"))
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    first = docs.withColumns({"_words": words, "_lines": lines, "_symbols": F.size(F.regexp_extract_all(text, F.lit(SYMBOLS), F.lit(0)))})
    second = first.withColumns(
        {
            "_hashes": hashes,
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.col("_symbols").cast("long"),
            "n_upper": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    third = second.withColumn("_pairs", F.when(again, pairs))
    fourth = third.withColumn("n_repeat_words", F.when(F.col("_pairs").isNotNull(), repeated).otherwise(F.lit(0).cast("long")))
    return fourth.drop("_words", "_lines", "_symbols", "_hashes", "_pairs")


def metrics() -> dict[str, Column]:
    """The ratios that rules may name."""

    def per(top: str, below: str) -> Column:
        return F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(F.lit(0.0))

    return {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "stop_word_share": per("n_stop_words", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
    }


def compile_rules(rules: Sequence[Rule]) -> Column:
    """Names of the rules that a document breaks, in the order of the table."""
    known = metrics()
    broken = []
    for rule in rules:
        value = known[rule.metric]
        sides = [value < rule.low] if rule.low is not None else []
        sides += [value > rule.high] if rule.high is not None else []
        if sides:
            broken.append(F.when(sides[0] | sides[-1], F.lit(rule.metric)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``broken_rules`` and ``kept``.

    A document fails the base rule with fewer than ``least_words`` words or with more than
    ``most_repeated`` percent of them in repeated three-word windows; it is kept if neither the
    base rule nor a rule of the table fails.  Null and empty texts have no words and fail.
    Rows are independent; columns of ``docs`` with a name of a result are replaced.
    """
    results = [*COUNTS, "base_failed", "broken_rules", "kept"]
    # Everything else travels as one column, so that no name can clash.
    counted = with_counts(docs.select(F.struct(*docs.columns).alias("_doc"), "text"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = counted.withColumns({"base_failed": failed, "broken_rules": compile_rules(rules)})
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    return judged.select(*(F.col(f"_doc.`{c}`") for c in docs.columns if c not in results), *results)
