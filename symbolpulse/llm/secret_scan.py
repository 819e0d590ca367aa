"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a path is addressed by the hash of its text.  A scan takes only pairs of a
blob and a rule version that the ledger does not hold, one text for each blob; findings
stay in the ledger and are joined back to all paths that hold the blob.
Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<start:long,rank:int,end:long,kind:string,version:int>"
LEDGER = f"blob string, rules array<struct<kind:string,version:int>>, spans array<{SPAN}>"
#: Copies of each blob's findings, so that paths of one blob spread over as many tasks.
SALTS = 32


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


# The patterns of the scan, in the order in which kinds are listed.
RULES = (
    Rule(
        "assign", 1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")


def spans_of(text: Column, rule: Rule, rank: int = 0) -> Column:
    """Places (code points, end exclusive) of the rule's matches.

    The texts between the matches and the matches themselves alternate, so running sums of
    their lengths are the places.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.arrays_zip(F.split(text, rule.pattern, -1).alias("b"), found.alias("f"), group.alias("g"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["b"])
        end = begin + F.coalesce(F.length(x["f"]), F.lit(0))
        span = F.struct(
            begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version")
        )
        counted = F.length(x["g"]) >= max(1, rule.least)
        return F.struct(end.alias("at"), F.when(counted, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(steps, first, step, lambda state: state["out"])).otherwise(none)


def addressed(versions: DataFrame) -> DataFrame:
    """``path, blob, text`` of all versions; null texts are empty, null paths the path ''."""
    text = F.coalesce("text", F.lit(""))
    return versions.select(F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def pending(blobs: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``path, blob, kinds``: one path for each blob with the rule versions it has not met."""
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    met = ledger.select(F.col("blob"), F.explode("rules").alias("rule"))
    pairs = (
        blobs.groupBy("blob")
        .agg(F.min("path").alias("path"))
        .select("blob", "path", F.explode(wanted).alias("rule"))
        .join(met, ["blob", "rule"], "left_anti")
    )
    return pairs.groupBy("path", "blob").agg(F.collect_set("rule.kind").alias("kinds"))


def scan_increment(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger rows that ``versions`` (``path, text``) add: append them to the ledger.

    One row for each blob with a rule version it had not met: ``rules`` lists those, ``spans``
    all their matches, also if there are none.  A path may stand in several rows; other
    columns are not used.  Repeated rows and repeated texts are scanned once.
    """
    todo = pending(addressed(versions).select("path", "blob"), ledger, rules)
    texts = addressed(versions).join(todo.hint("shuffle_hash"), ["path", "blob"])
    due = [F.array_contains("kinds", r.kind) for r in rules]
    none = F.array().cast(f"array<{SPAN}>")
    scanned = F.array(*[F.when(d, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))) for d, r in zip(due, rules, strict=True)])
    spans = [F.when(d, spans_of(F.col("text"), r, i)).otherwise(none) for i, (d, r) in enumerate(zip(due, rules, strict=True))]
    rows = texts.select("blob", F.filter(scanned, lambda x: x.isNotNull()).alias("rules"), F.concat(*spans).alias("spans"))
    return rows.dropDuplicates(["blob"])


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``path, spans`` for every row of ``versions``; spans of the current rule versions in text order."""
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    own = F.filter("spans", lambda s: F.array_contains(current, F.struct(s["kind"].alias("kind"), s["version"].alias("version"))))
    found = ledger.select("blob", own.alias("spans")).where(F.size("spans") > 0)
    # A blob has a row for each scan; its findings are few, its paths may be many.
    by_blob = found.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    copies = by_blob.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("path", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    paths = addressed(versions).select("path", "blob").withColumn("_salt", salt)
    none = F.array().cast(f"array<{SPAN}>")
    return paths.join(copies, ["blob", "_salt"], "left").select("path", F.coalesce("spans", none).alias("spans"))
