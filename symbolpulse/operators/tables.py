"""Table maintenance: upserts, deletes, increments, row checks.

An operator returns the *new state* of a table; writing it is the caller's step
(see ``sources.writers``).  Nothing here reads and overwrites the same files.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_col
from ..functions.scores import clean_votes
from ..functions.times import last_trading_date


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column, n: int = 1) -> DataFrame:
    """First ``n`` rows per key in ``order`` (DST2, RNK2).

    The rank filter becomes a map-side group limit, so a key that owns a third of
    the rows sends ``n`` rows per input partition into the shuffle, not all.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") <= n).drop("_rn")


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Replace rows of ``target`` by key and add new ones (UPS1).

    Of several changes to a key the first in ``order`` counts, by default the last in the
    order of all other columns.
    """
    rest = [F.col(c).desc() for c in target.columns if c not in keys]
    single = first_per_key(changes, keys, *(order or rest or [F.lit(1)]))
    kept = target.join(single.select(*keys), list(keys), "left_anti")
    return kept.unionByName(single.select(*target.columns))


def insert_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Rows whose key ``target`` lacks, one per key; append them (UPS3)."""
    fresh = rows.join(target.select(*keys), list(keys), "left_anti")
    return first_per_key(fresh, keys, *(order or [F.col(c) for c in rows.columns]))


def merge_candidates(target: DataFrame, scan: DataFrame, now: datetime) -> DataFrame:
    """Latest-candidates table: measures from the scan, first sighting kept (UPS2)."""
    measures = ["mentions_24h", "baseline_rate_per_h", "lift", "trend"]
    moment = F.lit(now).cast("timestamp")
    t, s = target.alias("t"), scan.alias("s")
    seen = F.col("s.symbol").isNotNull()
    return t.join(s, F.col("t.symbol") == F.col("s.symbol"), "full").select(
        F.coalesce("t.symbol", "s.symbol").alias("symbol"),
        *[F.when(seen, F.col(f"s.{m}")).otherwise(F.col(f"t.{m}")).alias(m) for m in measures],
        F.when(F.col("t.symbol").isNotNull(), F.col("t.first_seen")).otherwise(moment).alias("first_seen"),
        F.when(seen, moment).otherwise(F.col("t.last_seen")).alias("last_seen"),
    )


def prediction_rows(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Predictions fit for the table: no blank ticker or signal, defaults filled (UPS4)."""
    filled = (F.coalesce("ticker", F.lit("")) != "") & (F.coalesce("signal", F.lit("")) != "")
    return rows.where(filled).select(
        F.coalesce("as_of", F.lit(as_of).cast("timestamp")).alias("as_of"),
        "ticker",
        F.coalesce("horizon_days", F.lit(1)).alias("horizon_days"),
        "signal",
        "confidence",
        "expected_return",
        F.coalesce(F.nullif("version", F.lit("")), F.lit("ml-v2")).alias("version"),
    )


def purge(df: DataFrame, column: str, as_of: date | datetime, days: int = 180) -> DataFrame:
    """Drop rows older than the retention time; partitions before it are not read (DEL1)."""
    cutoff = F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    kind = df.schema[column].dataType
    return df.where(F.col(column) >= cutoff.cast(kind))


def delete_keys(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Remaining rows, and a one-row table ``removed`` (DEL2)."""
    doomed = doomed.select(*keys)
    remaining = target.join(doomed, list(keys), "left_anti")
    removed = target.join(doomed, list(keys), "left_semi").agg(F.count(F.lit(1)).alias("removed"))
    return remaining, removed


def next_start(prices: DataFrame, symbols: DataFrame, start: date | None = None) -> DataFrame:
    """First day to load per requested symbol, NULL for a full load (INC1)."""
    last = prices.groupBy("ticker").agg(F.max("date").alias("last_date"))
    begin = F.date_add("last_date", 1) if start is None else F.lit(start).cast("date")
    return symbols.select("ticker").distinct().join(last, "ticker", "left").select(
        "ticker", "last_date", begin.alias("start_date")
    )


def due_symbols(starts: DataFrame, today: date) -> DataFrame:
    """Symbols whose next start is not after the last trading day (INC3)."""
    limit = F.lit(last_trading_date(today))
    return starts.where(F.col("start_date").isNull() | (F.col("start_date") <= limit))


def new_rows(loaded: DataFrame, starts: DataFrame, today: date, refresh_same_day: bool = True) -> DataFrame:
    """Loaded rows after the high-water mark, and the current day again (INC2)."""
    current = F.lit(last_trading_date(today))
    fresh = F.col("last_date").isNull() | (F.col("date") > F.col("last_date"))
    if refresh_same_day:
        fresh = fresh | ((F.col("last_date") == current) & (F.col("date") == current))
    marks = starts.select("ticker", "last_date")
    return loaded.join(marks, "ticker", "left").where(fresh).select(*loaded.columns)


def merge_sources(*sources: DataFrame) -> DataFrame:
    """Rows of the first source that knows a symbol, in order of preference (INC4)."""
    merged, known = sources[0], sources[0].select("ticker").distinct()
    for source in sources[1:]:
        merged = merged.unionByName(source.join(known, "ticker", "left_anti"))
        known = known.unionByName(source.select("ticker").distinct()).distinct()
    return merged


def coerce_prices(df: DataFrame) -> DataFrame:
    """Text columns to price types, unreadable values to NULL (VAL2)."""
    measures = ["open", "high", "low", "close", "adj_close", "volume"]
    return df.select(
        F.col("date").try_cast("date").alias("date"),
        F.col("ticker").cast("string").alias("ticker"),
        *[F.col(m).try_cast("double").alias(m) for m in measures],
    )


def coerce_posts(df: DataFrame) -> DataFrame:
    """Text columns to post types, missing counts to 0 (VAL2)."""
    count = lambda name: F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)).cast("bigint").alias(name)
    return df.select(
        F.col("id").cast("string").alias("id"),
        F.try_to_timestamp(F.col("created_utc").cast("string")).alias("created_utc"),
        F.col("title").cast("string").alias("title"),
        F.col("text").cast("string").alias("text"),
        count("upvotes"),
        count("num_comments"),
    )


def clean_posts(
    df: DataFrame, id_columns: Sequence[str] = ("id", "name", "link_id"), text_chars: int | None = None
) -> DataFrame:
    """Rows with an id and a time, votes clamped (VAL3).

    Texts stay whole unless ``text_chars`` is given, the length of a table's column.
    """
    present = [c for c in id_columns if c in df.columns]
    # The first non-empty raw value is taken, then trimmed.
    raw = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in present])
    text = F.coalesce("text", F.lit(""))
    return (
        df.withColumn("_id", F.nullif(F.trim(raw), F.lit("")))
        .withColumn("created_utc", F.try_to_timestamp(F.col("created_utc").cast("string")))
        .where(F.col("_id").isNotNull() & F.col("created_utc").isNotNull())
        .withColumn("upvotes", clean_votes("upvotes"))
        .withColumn("text", text if text_chars is None else F.substring(text, 1, text_chars))
        .withColumn("id", F.col("_id"))
        .drop("_id")
    )


def merge_posts(existing: DataFrame, extra: DataFrame) -> DataFrame:
    """Union without ids already present; rows without id always stay (SET2)."""
    fresh = extra.join(existing.select("id"), "id", "left_anti")
    order = [F.col(c) for c in extra.columns if c != "id"]
    named = first_per_key(fresh.where(F.col("id").isNotNull()), ["id"], *order)
    return existing.unionByName(named).unionByName(fresh.where(F.col("id").isNull()))


def in_symbols(df: DataFrame, symbols: DataFrame | Sequence[str], column: str = "ticker") -> DataFrame:
    """Rows of the given symbols, compared in upper case (FLT1)."""
    if isinstance(symbols, DataFrame):
        wanted = symbols.select(F.upper(as_col(symbols.columns[0])).alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    return df.where(F.col(column).isin(*sorted({s.upper() for s in symbols})))


def gathered(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """``keys`` and ``measures`` (numbers, flags and days, as doubles on the way) of all rows, dealt by ``keys`` once.

    The rows of a key meet in one row, so they must be few, such as the days of a ticker.  What then goes by key, each
    aggregate, window or join on exactly these keys, is no shuffle.  A row is an array of numbers, of which no reader can leave
    a part out, nor filter it earlier; so all readers share the one shuffle.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in measures}
    told = [F.unix_date(c) if kinds[c] == "date" else F.col(c) for c in measures]
    row = F.array(*[c.cast("double") for c in told])
    groups = df.groupBy(*keys).agg(F.collect_list(row).alias("_rows")).select(*keys, F.explode("_rows").alias("_row"))

    def read(i: int, name: str) -> Column:
        value = F.get("_row", F.lit(i))
        return (F.date_from_unix_date(value.cast("int")) if kinds[name] == "date" else value.cast(kinds[name])).alias(name)

    return groups.select(*keys, *[read(i, c) for i, c in enumerate(measures)])


def number_rows(df: DataFrame, order: str, start: Column | int = 1, out: str = "number") -> DataFrame:
    """Consecutive numbers in the order of a unique bigint column.

    The values form a tree of blocks with 65,536 children each.  Rows are counted for every
    block, counts are summed over the blocks before it inside its parent, and rows are
    numbered inside their block: no window is larger, however the values are spread.
    """
    levels = ["_block1", "_block2", "_block3"]
    numbered = df.withColumns({name: F.shiftright(F.col(order), 16 * (i + 1)) for i, name in enumerate(levels)})
    sizes = numbered.groupBy(*levels).agg(F.count(F.lit(1)).alias("_n"))
    offsets, counts = None, sizes
    for i, name in enumerate(levels):
        parents = levels[i + 1 :]
        counts = counts.groupBy(name, *parents).agg(F.sum("_n").alias("_n"))
        # The highest level has 65,536 blocks at most and no parent.
        before = Window.partitionBy(*parents).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        own = counts.select(name, *parents, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_before{i}"))
        offsets = own if offsets is None else offsets.join(own, [name, *parents])
    offset = sum(F.col(f"_before{i}") for i in range(len(levels)))
    within = F.row_number().over(Window.partitionBy(*levels).orderBy(order))
    base = F.lit(start) if isinstance(start, int) else start
    return (
        numbered.join(offsets.select(*levels, offset.alias("_offset")), levels)
        .withColumn(out, (base - 1 + F.col("_offset") + within).cast("bigint"))
        .drop(*levels, "_offset")
    )
