"""Which post mentions which symbol.

Aliases are found by an equi join on all their words.  Bitsets of their first words and of all their words come
first: places where no name stands leave the array of a text before rows are made of it, so what is joined or
shuffled grows with the hits and not with the texts, the number of aliases or those that begin alike.

Arrays are exploded with the outer form on purpose: the plain form adds a
filter on the array's size, which evaluates the regular expressions a second time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_col
from ..functions.scores import DEFAULT_LEXICON, lexicon_score
from ..functions.symbols import (
    cashtags,
    free_cashtags,
    has_sign,
    loose_symbol,
    master_aliases,
    name_variants,
    raw_cashtags,
    symbol_variants,
    upper_symbols,
)
from ..functions.text import combined_text
from .storage import stored
from .tables import first_per_key

# Names up to this size in all are broadcast; beyond it, words and names meet by a shuffle.
BROADCAST_BYTES = 8 << 20
# The same for tags, which are short; the words of all texts would meet more of them by a shuffle.
TAG_BYTES = 64 << 20
# Bits for each first word, and for all of them; more words than bits let more words pass, never fewer.
BITS_PER_WORD, MOST_BITS = 64, 1 << 21
# Copies of the names, so that frequent words do not gather in one task.
SALTS = 16
# Characters that make up a word, per matching rule.
WORD_CHARS = {"bucket": "A-Za-z0-9", "trend": r"\p{L}\p{N}_"}


def alias_patterns(aliases: DataFrame, rule: str) -> DataFrame:
    """Alias rows ``(symbol, alias)`` prepared for :func:`alias_matches`.

    ``core`` reaches from the first word to the last one, ``words`` of them; ``lead`` and ``trail`` are what
    stands before and after it.  An alias without any word character cannot match.
    """
    word = WORD_CHARS[rule]
    name = F.lower(F.trim("alias"))
    parts = aliases.select("symbol", name.alias("_name")).distinct().select(
        "symbol",
        F.regexp_extract("_name", f"^[^{word}]*", 0).alias("lead"),
        F.regexp_extract("_name", f"[^{word}]*$", 0).alias("trail"),
        F.regexp_extract("_name", f"[{word}]+", 0).alias("first"),
        F.regexp_extract_all("_name", F.lit(f"[{word}]+"), F.lit(0)).alias("_words"),
        "_name",
    )
    length = F.length("_name") - F.length("lead") - F.length("trail")
    core = F.substring("_name", F.length("lead") + 1, length)
    return parts.where(F.col("first") != "").select(
        "symbol", "lead", "trail", core.alias("core"), "first", F.get("_words", F.lit(1)).alias("second"), F.size("_words").alias("words")
    )


def _boundary(rule: str) -> Column:
    """Do the characters around ``core`` allow a match?  They are the columns of :func:`_places`."""
    lead, trail, before, after = (F.col(c) for c in ("lead", "trail", "before", "after"))
    word_after = F.col("more") & (after == trail)
    extra = F.length(before) - F.length(lead)
    if rule == "bucket":
        fits = before.endswith(lead) & ((lead == "") | (extra > 0) | F.col("start")) & ~word_after
    else:
        # A word boundary on both sides, or a tag sign before and no word around.
        left = (lead == "") | ((before == lead) & ~F.col("start"))
        plain = left & F.when(trail == "", ~word_after).otherwise(word_after)
        signed = F.concat(F.lit("$"), lead), F.concat(F.lit("#"), lead)
        tagged = (before.endswith(signed[0]) | before.endswith(signed[1])) & ((extra > 1) | F.col("start"))
        fits = plain | (tagged & ~word_after)
    return after.startswith(trail) & fits


class _Names:
    """Patterns of :func:`alias_patterns`, stored, with what is known of their size, words and cores."""

    def __init__(self, patterns: DataFrame):
        plain = (F.col("lead") == "") & (F.col("trail") == "") & (F.col("words") == 1)
        self.rows = stored(patterns.withColumn("plain", plain), "names")
        size = F.sum(F.length("core") + F.length("lead") + F.length("trail") + F.lit(64))
        lengths = F.collect_set(F.when(~F.col("plain"), F.col("words")))
        counts = (F.count(F.lit(1)), size, F.max(F.length("lead")), F.max(F.length("trail")), lengths)
        self.count, size, lead, trail, lengths = self.rows.agg(*counts).first()
        self.small = (size or 0) <= BROADCAST_BYTES
        self.lengths = sorted(lengths)
        # So much of a gap tells whether a lead or trail fits and whether more follows.
        self.before, self.after = (lead or 0) + 2, (trail or 0) + 1
        # A core of whole words fits wherever it stands, if nothing is to stand before or after it.
        self.bare = not lead and not trail
        self.bits = min(MOST_BITS, 1 << max(12, math.ceil(math.log2(max(1, self.count) * BITS_PER_WORD))))
        long = self.rows.where("NOT plain")
        self.begins = self._test(self.rows.where("words = 1"), "first")
        self.begins_more = self._test(long.where("words > 1"), "first", "second")
        self.is_core = self._test(long, "core")

    def _slot(self, *parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(self.bits))

    def _test(self, rows: DataFrame, *columns: str) -> Callable[..., Column]:
        slot = self._slot(*[F.col(c) for c in columns])
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))
        found = rows.groupBy(F.floor(slot / 64).cast("int").alias("cell")).agg(F.bit_or(bit).alias("all")).collect()
        cells = {r["cell"]: r["all"] for r in found}
        # One literal: the text of all cells becomes an array once, when the plan is made.
        text = ",".join(str(cells.get(i, 0)) for i in range(self.bits // 64))
        array = F.split(F.lit(text), ",").cast("array<bigint>")

        def test(*parts: Column) -> Column:
            slot = self._slot(*parts)
            return F.getbit(F.get(array, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1

        return test


def _pieces(word: str, gaps: bool) -> Column:
    """Words of a text; with ``gaps`` also what stands between them, the words at odd places behind one more blank."""
    text = F.lower("text")
    return F.regexp_extract_all(F.concat(F.lit(" "), text) if gaps else text, F.lit(f"[{word}]+|[^{word}]+" if gaps else f"[{word}]+"), F.lit(0))


def _is_tag() -> Column:
    return F.col("at_") >= F.size("pieces_")


def _core() -> Column:
    """The ``n_`` words from a place on, with the gaps between them; 0 stands for the word itself as a plain name."""
    return F.when(F.col("n_") <= 1, F.col("word_")).otherwise(F.array_join(F.slice("pieces_", F.col("at_") + 1, 2 * F.col("n_") - 1), ""))


def _candidates(posts: DataFrame, names: _Names, rule: str, keep: Sequence[str], tags: Column | None = None) -> DataFrame:
    """``keep``, and where a name may stand: the word ``word_`` at ``at_`` of ``pieces_`` of the text, and a number ``n_`` of words.

    ``tags`` of a text follow its pieces as they are.  Pieces become rows that compiled code tests as they are made; functions of
    arrays would call a closure for each word.  No such function may come before the last use of ``pieces_``: it would
    copy the whole text for each of its candidates.
    """
    at, n, word = F.col("at_"), F.col("n_"), F.col("word_")
    some = [] if tags is None else [tags.alias("tags_")]
    rows = posts.select(*keep, _pieces(WORD_CHARS[rule], bool(names.lengths)).alias("pieces_"), *some)
    items = F.col("pieces_") if tags is None else F.concat("pieces_", "tags_")
    rows = rows.select(*keep, "pieces_", F.posexplode_outer(items).alias("at_", "word_")).where(word.isNotNull())
    tagged = F.lit(False) if tags is None else _is_tag()
    if not names.lengths:
        return rows.where(tagged | names.begins(word)).withColumn("n_", F.lit(0))
    begins_more = names.begins_more(word, F.get("pieces_", at + 2))
    rows = rows.where(tagged | ((at % 2 == 1) & (names.begins(word) | begins_more)))
    rows = rows.select("*", F.explode_outer(F.array(*[F.lit(k) for k in [0, *names.lengths]])).alias("n_"))
    longer = ((n == 1) | begins_more) & (at + 2 * n - 2 < F.size("pieces_")) & names.is_core(_core())
    return rows.where(F.when(tagged, n == 0).when(n == 0, names.begins(word)).otherwise(longer))


def _places(names: _Names) -> Column:
    """The place of a row of :func:`_candidates`, with what is around, in an array: ``core, before, after, start, more, plain``."""
    at, plain = F.col("at_"), F.col("n_") == 0
    if names.bare:
        before = after = F.lit(None).cast("string")
        start = more = F.lit(None).cast("boolean")
    else:
        first, end = at == 1, at + 2 * F.col("n_") - 1
        gap = F.get("pieces_", at - 1)
        # The first gap has one blank more than the text.
        before = F.right(F.when(first, F.substring(gap, 2, 1 << 30)).otherwise(gap), F.lit(names.before))
        after = F.coalesce(F.left(F.get("pieces_", end), F.lit(names.after)), F.lit(""))
        start, more = first, end + 1 < F.size("pieces_")
        before, after, start, more = (F.when(~plain, c) for c in (before, after, start, more))
    return F.array(F.struct(_core().alias("core"), before.alias("before"), after.alias("after"), start.alias("start"), more.alias("more"), plain.alias("plain")))


def _matched(places: DataFrame, names: _Names, rule: str, keep: Sequence[str]) -> DataFrame:
    """``keep, symbol`` of rows with the columns of :func:`_places` that a name fits.

    The key is the name from its first word to its last, so a frequent first word meets no names that do not stand there.
    """
    if names.small:
        found = places.join(F.broadcast(names.rows), ["core", "plain"])
    else:
        # A word of every text meets its names in as many tasks as there are copies of them.
        copies = names.rows.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # A name may stand in a text many times; one row of each kind is sent.
        # Dealt as the join wants them, so that rows are made distinct where they meet the names.
        salted = places.withColumn("salt_", F.pmod(F.hash(*keep), F.lit(SALTS))).repartition("core", "plain", "salt_")
        found = salted.distinct().join(copies.hint("shuffle_hash"), ["core", "plain", "salt_"])
    return (found if names.bare else found.where(F.col("plain") | _boundary(rule))).select(*keep, "symbol")


def alias_matches(posts: DataFrame, aliases: DataFrame, rule: str, keep: Sequence[str]) -> DataFrame:
    """Distinct ``keep`` columns and symbol of posts that contain an alias (JON3, JON4).

    ``posts`` has a ``text`` column; ``keep`` names the narrow columns to carry and
    must identify a post.  ``aliases`` has ``symbol`` and ``alias``.  The names are stored and measured
    first, which runs jobs over them.
    """
    names = _Names(alias_patterns(aliases, rule))
    rows = _candidates(posts, names, rule, keep).select(*keep, F.explode_outer(_places(names)).alias("place"))
    return _matched(rows.select(*keep, "place.*"), names, rule, keep).distinct()


def alias_table(aliases: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Names per symbol: aliases, their synonyms, and the symbol itself (JON5).

    ``$SYMBOL`` needs no row of its own: wherever it matches, the symbol does.
    """
    named = aliases.select(F.col("ticker").alias("symbol"), "alias")
    own = named.select("symbol", F.col("symbol").alias("alias"))
    parts = named.where(F.coalesce("alias", F.lit("")) != "").unionByName(own)
    if synonyms is not None:
        word = synonyms.select(F.lower("word").alias("_word"), "synonym")
        similar = named.join(word, F.lower("alias") == F.col("_word")).where(
            F.lower("synonym") != F.col("_word")
        )
        parts = parts.unionByName(similar.select("symbol", F.col("synonym").alias("alias")))
    return parts.distinct()


def exchange_aliases(aliases: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names of the tracked symbols: own, and those of their exchange forms (JON3, SYM6)."""
    wanted = symbols.select(F.upper(F.trim("ticker")).alias("symbol")).where("symbol != ''").distinct()
    named = aliases.select(F.explode(symbol_variants("ticker")).alias("symbol"), F.lower("alias").alias("alias"))
    own = wanted.select("symbol", F.col("symbol").alias("alias"))
    return named.join(wanted, "symbol", "left_semi").unionByName(own).distinct()


def known_symbols(aliases: DataFrame, *others: tuple[DataFrame, str]) -> DataFrame:
    """Distinct symbols of the alias table and of other tables, normalised (JON6)."""
    known = aliases.select(F.col("ticker").alias("symbol"))
    for table, column in others:
        # Distinct before the normal form: few values instead of every row.
        raw = table.select(as_col(column).alias("_raw")).distinct()
        known = known.unionByName(raw.select(loose_symbol("_raw").alias("symbol")))
    return known.where(F.col("symbol").isNotNull()).distinct()


def candidate_symbols(posts: DataFrame) -> DataFrame:
    """Posts per symbol-like word, and posts with it as a cashtag (AGG10)."""
    marked = lambda found, tag: F.transform(
        found, lambda s: F.struct(s.alias("symbol"), F.lit(tag).alias("tagged"))
    )
    # The tags are found once and stand for plain words too.
    found = posts.select(upper_symbols("text").alias("plain"), cashtags("text").alias("tags"))
    hits = F.concat(marked(F.array_union("plain", "tags"), False), marked(F.col("tags"), True))
    rows = found.select(F.explode_outer(hits).alias("hit")).select("hit.*")
    return rows.where(F.col("symbol").isNotNull()).groupBy("symbol").agg(
        F.count_if(~F.col("tagged")).alias("total"), F.count_if(F.col("tagged")).alias("cashtag")
    )


def discover_symbols(stats: DataFrame, known: DataFrame, min_plain: int = 2) -> DataFrame:
    """Unknown symbols tagged once or written often enough (AGG11)."""
    seen = known.select(F.upper("symbol").alias("symbol"))
    return stats.join(seen, "symbol", "left_anti").where(
        (F.col("cashtag") > 0) | (F.col("total") >= min_plain)
    )


def validate_symbols(discovered: DataFrame, master: DataFrame) -> DataFrame:
    """Discovered symbols that the security master lists, with name aliases (JON7).

    ``master``: symbol, name.
    """
    listed = master.select(F.upper("symbol").alias("symbol"), "name")
    return discovered.join(listed, "symbol").groupBy("symbol").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(name_variants("name"))))).alias("aliases")
    )


def master_alias_rows(master: DataFrame) -> DataFrame:
    """Alias rows of a security master (SYM8, SRC11)."""
    return master.select(
        F.upper(F.trim("symbol")).alias("ticker"), F.explode(master_aliases("name")).alias("alias")
    ).distinct()


def postings(posts: DataFrame, names: DataFrame, keep: Sequence[str]) -> DataFrame:
    """What a trend scan needs of texts, made in one pass over them: ``keep, kind, symbol``.

    ``kind`` is ``tag`` for a cashtag (its symbol) and ``name`` for a match of ``names`` (its symbol), once for each place
    where it stands.  Names beyond a broadcast are matched by a shuffle of the places where one may stand.
    """
    prepared = _Names(alias_patterns(names, "trend"))
    rows = _candidates(posts, prepared, "trend", keep, raw_cashtags("text"))
    place = F.explode_outer(F.when(~_is_tag(), _places(prepared))).alias("place")
    rows = rows.select(*keep, F.when(_is_tag(), loose_symbol("word_")).alias("tag"), place).select(*keep, "tag", "place.*")
    kind = F.when(F.col("tag").isNull(), "name").otherwise("tag").alias("kind")
    if prepared.small:
        named = F.broadcast(prepared.rows.select("core", "plain", "symbol", "lead", "trail"))
        around = F.lit(True) if prepared.bare else F.col("plain") | _boundary("trend")
        fits = F.col("tag").isNotNull() | (F.col("symbol").isNotNull() & around)
        return rows.join(named, ["core", "plain"], "left").where(fits).select(*keep, kind, F.coalesce("tag", "symbol").alias("symbol"))
    rows = stored(rows, "posting-items")
    named = _matched(rows.where("tag IS NULL").drop("tag"), prepared, "trend", keep)
    tagged = rows.where("tag IS NOT NULL").select(*keep, kind, F.col("tag").alias("symbol"))
    return tagged.unionByName(named.select(*keep, F.lit("name").alias("kind"), "symbol"))


def tag_words(posts: DataFrame, tags: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep, symbol, tagged_at`` of posts that hold one of ``tags(symbol, tagged_at)`` as a word, once for each post.

    ``tags`` have no sign inside.  Tags that the post writes with their sign are left out.
    """
    size = tags.agg(F.sum(F.length("symbol") + F.lit(64)).alias("size")).first()["size"] or 0
    names = tags.select(F.lower("symbol").alias("word"), "symbol", "tagged_at")
    own = F.transform(free_cashtags("text"), F.lower).alias("own_")
    rows = posts.select(*keep, F.array_distinct(_pieces(WORD_CHARS["trend"], False)).alias("words_"), own)
    words = F.when(F.size("own_") > 0, F.array_except("words_", "own_")).otherwise(F.col("words_"))
    rows = rows.select(*keep, F.explode_outer(words).alias("word"))
    if size <= TAG_BYTES:
        return rows.join(F.broadcast(names), "word").select(*keep, "symbol", "tagged_at")
    copies = names.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt_", F.pmod(F.hash(*keep), F.lit(SALTS)))
    return salted.join(copies.hint("shuffle_hash"), ["word", "salt_"]).select(*keep, "symbol", "tagged_at")


def symbol_mentions(posts: DataFrame, names: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row per post and symbol under the trend rules (JON4).

    ``posts``: id, created_utc, text.  Cashtags found anywhere in ``posts`` are
    looked for as plain words too; ``tagged_at`` is the last time the tag was seen
    for hits that rest on this only, and NULL for all others.  Tags are gathered first, from the texts
    that hold a sign, and stored.  Most words of a text may be tags of others: they are made distinct
    inside the text, and rows of posts and symbols are shuffled only where posts repeat.
    """
    base = posts.withColumn("weight", F.lit(1.0) if weight is None else weight)
    keep = ["id", "created_utc", "weight"]
    found = base.where(has_sign("text")).select("created_utc", F.explode_outer(free_cashtags("text")).alias("symbol"))
    tags = found.where(F.col("symbol").isNotNull()).groupBy("symbol").agg(F.max("created_utc").alias("tagged_at"))
    extra = stored(tags.join(names.select("symbol").distinct(), "symbol", "left_anti"), "tags")
    # Tags with a sign inside need what stands between words.
    signed = F.col("symbol").rlike(r"[.\-]")
    dotted = extra.where(signed)

    # Hits on tag words count only while the tag itself is inside the look-back.
    hits = postings(base, names.select("symbol", "alias").unionByName(dotted.select("symbol", F.col("symbol").alias("alias"))), keep)
    named = hits.join(dotted, "symbol", "left").select(*keep, "symbol", F.when(F.col("kind") == "name", F.col("tagged_at")).alias("tagged_at"))
    words = tag_words(base, extra.where(~signed), keep)

    def merged(rows: DataFrame) -> DataFrame:
        last = F.when(F.count_if(F.col("tagged_at").isNull()) == 0, F.max("tagged_at"))
        return rows.groupBy(*keep, "symbol").agg(last.alias("tagged_at"))

    repeated = base.groupBy(*keep).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return words.unionByName(merged(named))
    return merged(words.unionByName(named))


def bucket_posts(
    posts: DataFrame,
    symbols: DataFrame,
    aliases: DataFrame,
    master: DataFrame | None = None,
    per_symbol: int | None = None,
    text_chars: int | None = None,
    score=None,
) -> DataFrame:
    """Posts per requested or discovered symbol, scored (BKT1).

    ``per_symbol`` keeps the newest ones only, ``text_chars`` cuts their texts; by default
    all posts stay and whole texts are scored.

    ``posts``: id, created_utc, title, text, upvotes, num_comments.  ``score`` maps
    the text column to a score; the lexicon is the default.
    """
    whole = posts.withColumn("text", combined_text("title", "text", "\n")).drop("title")
    tracked, names = symbols.select(F.upper(F.trim("ticker")).alias("ticker")), aliases
    if master is not None:
        known = tracked.withColumnRenamed("ticker", "symbol")
        # Stored: the symbols and the names below would each read all texts for it again.
        found = stored(validate_symbols(discover_symbols(candidate_symbols(whole), known), master), "listed")
        tracked = tracked.unionByName(found.select(F.col("symbol").alias("ticker"))).distinct()
        names = names.select("ticker", "alias").unionByName(
            found.select(F.col("symbol").alias("ticker"), F.explode("aliases").alias("alias"))
        )
    hits = alias_matches(whole, exchange_aliases(names, tracked), "bucket", ["id", "created_utc"])
    newest = hits
    if per_symbol is not None:
        newest = first_per_key(hits, ["symbol"], F.col("created_utc").desc(), F.col("id"), n=per_symbol)
    # Texts come back only for the posts that are kept.
    texts = whole if text_chars is None else whole.withColumn("text", F.substring("text", 1, text_chars))
    scorer = score or (lambda text: F.coalesce(lexicon_score(text, DEFAULT_LEXICON), F.lit(0.0)))
    # A post is scored once, however many symbols it mentions.
    found = newest.groupBy("id").agg(F.collect_list("symbol").alias("symbols_"))
    scored = found.join(texts, "id").withColumn("sentiment", scorer("text"))
    return scored.select(F.explode("symbols_").alias("ticker"), "id", *[c for c in texts.columns if c != "id"], "sentiment")
