"""Text cleaning, lexicon scores, symbols and mentions over whole documents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import symbols as Y
from ..functions import text as X
from ..functions.fixed_values import BUCKET_POSTS, CORPORATE_SUFFIXES, MASTER_SUFFIXES, SYMBOL_STOPWORDS
from ..operators import mentions, scoring, trends
from . import views as V
from .registry import query
from .rounding import rounded


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


# Common words of the corpus as a lexicon, so that most documents score.
CORPUS_LEXICON = S.Lexicon(
    {"that": 1, "with": 1, "from": -1, "this": -2, "die": 1, "les": -1, "la": 2, "was": -1, "for": 1, "el": -1},
    {"and": 2, "of": 3, "des": 2, "und": 3},
    frozenset({"to", "in", "is", "de", "der", "le"}),
)


def docs(spark, sf):
    return V.documents(spark, sf).select("doc_id", "text", "source", "lang")


CLEAN = (
    "lower(trim(regexp_replace(text, "
    "'(https?://\\S+)|(@[\\pL\\pN_]+)|[#*`>|]|(&amp;)|\\s+', ' ', 'g')))"
)
TOKEN_TEXT = (
    "trim(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '[^\\pL\\pN_$#🚀]+', ' ', 'g'))"
)


def _normal(token: str, keep) -> str:
    return f"""CASE WHEN {token} IN ({quoted(keep)}) OR length({token}) <= 4 THEN {token}
        WHEN {token} LIKE '%st' THEN left({token}, length({token}) - 2) || 'en'
        WHEN {token} LIKE '%t' THEN left({token}, length({token}) - 1) || 'en'
        WHEN {token} LIKE '%e' THEN {token} || 'n' ELSE {token} END"""


def _tokens(lexicon) -> str:
    return f"""
    words AS (SELECT doc_id, string_split({TOKEN_TEXT}, ' ') AS w FROM documents),
    tokens AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, {_normal('t', lexicon.kept_words)} AS t
        FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM words) WHERE t <> '')"""


def _cases(mapping, column: str) -> str:
    rows = " ".join(f"WHEN '{w}' THEN {float(v)!r}" for w, v in mapping.items())
    return f"CASE {column} {rows} END"


def _score_sql(lexicon) -> str:
    """Lexicon score by neighbour rules instead of a fold."""
    return f"""
    WITH {_tokens(lexicon)},
    facts AS (
        SELECT doc_id, i, t IN ({quoted(lexicon.markers)}) AS m, {_cases(lexicon.keywords, 't')} AS plain,
               coalesce({_cases(lexicon.keywords, 't')}, -({_cases({'not_' + w: v for w, v in lexicon.keywords.items()}, 't')})) AS kw,
               {_cases(lexicon.intensities, 't')} AS weight FROM tokens),
    near AS (
        SELECT *, (kw IS NOT NULL OR weight IS NOT NULL) AS target,
               lag(m, 1, FALSE) OVER w AS m1, lag(m, 2, FALSE) OVER w AS m2,
               coalesce(lag(kw IS NOT NULL OR weight IS NOT NULL) OVER w, FALSE) AS t1,
               coalesce(lead(kw IS NOT NULL OR weight IS NOT NULL) OVER w, FALSE) AS next_target
        FROM facts WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    emitted AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
               CASE WHEN target AND (m1 OR (m2 AND NOT t1)) THEN -plain ELSE kw END AS val,
               CASE WHEN target AND (m1 OR (m2 AND NOT t1)) THEN NULL ELSE weight END AS weight
        FROM near WHERE NOT m OR (m1 AND next_target)),
    runs AS (
        SELECT *, lag(weight) OVER w AS weight_before,
               k - 1 - coalesce(max(CASE WHEN weight IS NULL THEN k END)
                   OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
        FROM emitted WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    score AS (
        SELECT doc_id, CAST(sum(val * CASE WHEN run % 2 = 1 THEN weight_before ELSE 1 END) AS DOUBLE) AS score
        FROM runs WHERE val IS NOT NULL AND val <> 0 GROUP BY 1)
    SELECT doc_id, score FROM documents LEFT JOIN score USING (doc_id)"""


@query("txt1", f"SELECT doc_id, md5({CLEAN}) AS clean, length({CLEAN}) AS chars FROM documents")
def txt1(spark, sf):
    clean = docs(spark, sf).select("doc_id", X.clean_for_model("text").alias("t"))
    return clean.select("doc_id", F.md5("t").alias("clean"), F.length("t").alias("chars"))


@query(
    "txt2",
    f"""
    WITH {_tokens(S.DEFAULT_LEXICON)}
    SELECT doc_id, md5(coalesce(string_agg(t, ' ' ORDER BY i), '')) AS tokens, count(t) AS n
    FROM documents LEFT JOIN tokens USING (doc_id) GROUP BY 1""",
)
def txt2(spark, sf):
    words = docs(spark, sf).select("doc_id", X.lexicon_tokens("text", S.DEFAULT_LEXICON.kept_words).alias("t"))
    return words.select("doc_id", F.md5(F.array_join("t", " ")).alias("tokens"), F.size("t").cast("bigint").alias("n"))


@query("txt3", f"WITH {_tokens(S.DEFAULT_LEXICON)} SELECT t AS token, count(*) AS n FROM tokens GROUP BY 1")
def txt3(spark, sf):
    words = docs(spark, sf).select(F.explode(X.lexicon_tokens("text", S.DEFAULT_LEXICON.kept_words)).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "txt4",
    """
    SELECT doc_id, md5(coalesce(nullif(source, 'web'), '') || ' ' || text) AS scanned,
           md5(coalesce(nullif(source, 'web'), '') || chr(10) || text) AS bucketed FROM documents""",
)
def txt4(spark, sf):
    rows = docs(spark, sf).withColumn("source", F.nullif("source", F.lit("web")))
    return rows.select(
        "doc_id",
        F.md5(X.combined_text("source", "text")).alias("scanned"),
        F.md5(X.combined_text("source", "text", "\n")).alias("bucketed"),
    )


@query("scr1", _score_sql(CORPUS_LEXICON))
def scr1(spark, sf):
    return docs(spark, sf).select("doc_id", S.lexicon_score("text", CORPUS_LEXICON).alias("score"))


@query("scr2", _score_sql(S.DEFAULT_LEXICON))
def scr2(spark, sf):
    return docs(spark, sf).select("doc_id", S.lexicon_score("text").alias("score"))


def _boost_sql() -> str:
    test = lambda w: f"regexp_matches({CLEAN}, '(^|[^\\pL\\pN_]){w}([^\\pL\\pN_]|$)')"
    total = " + ".join(f"CASE WHEN {test(w)} THEN {b} ELSE 0 END" for w, b in S.WORD_BOOSTS.items())
    return f"greatest(-0.4, least(0.4, {total}))"


@query("scr4", f"SELECT doc_id, CAST(round({_boost_sql()}, 6) AS DOUBLE) AS boost FROM documents")
def scr4(spark, sf):
    return rounded(docs(spark, sf).select("doc_id", S.word_boost(X.clean_for_model("text")).alias("boost")))


def letter_model(texts: list[str]) -> list[list[dict]]:
    """Stand-in for a classifier: label scores from the length of a text."""
    return [
        [{"label": "Positive", "score": len(t) % 7 / 10}, {"label": "negative", "score": len(t) % 5 / 10}]
        for t in texts
    ]


def failing_model(texts: list[str]) -> list[list[dict]]:
    raise RuntimeError("model not available")


def length_score(texts: list[str]) -> list[float]:
    return [len(t) % 3 / 4 for t in texts]


@query(
    "scr7",
    f"""
    WITH c AS (SELECT doc_id, lang, length({CLEAN}) AS n, {_boost_sql()} AS boost FROM documents)
    SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN lang = 'en' THEN 'model:english' ELSE 'fallback' END AS method,
           CAST(round(CASE WHEN n = 0 THEN 0 ELSE greatest(-1, least(1, boost + CASE WHEN lang = 'en'
                THEN (n % 7) / CAST(10 AS DOUBLE) - (n % 5) / CAST(10 AS DOUBLE)
                ELSE (n % 3) / CAST(4 AS DOUBLE) END)) END, 6) AS DOUBLE) AS score FROM c""",
)
def scr7(spark, sf):
    scored = scoring.score_texts(
        docs(spark, sf), english=letter_model, other=failing_model, fallback=length_score, skip_errors=True
    )
    return rounded(scored.select("doc_id", "method", "score"))


# --- symbols ------------------------------------------------------------------

STOP = quoted(SYMBOL_STOPWORDS)


def _strict(raw: str) -> str:
    # Sharp s becomes SS in upper case.
    bare = f"trim(upper(replace(trim({raw}), 'ß', 'ss')), '$#.,:;!?')"
    return f"""CASE WHEN length({bare}) <= 10 AND regexp_full_match({bare}, '[A-Z0-9]+(\\.[A-Z0-9]+)?')
        AND regexp_matches({bare}, '[A-Z]') AND {bare} NOT IN ({STOP}) THEN {bare} END"""


def _loose(raw: str) -> str:
    bare = f"regexp_replace(trim(upper(replace({raw}, 'ß', 'ss')), '$# ' || chr(9) || chr(10) || chr(13) || '.,:;!?'), '\\s+', '', 'g')"
    return f"""CASE WHEN length({bare}) <= 12 AND regexp_full_match({bare}, '[A-Z0-9]+([.\\-][A-Z0-9]+)*')
        AND regexp_matches({bare}, '[A-Z]') AND {bare} NOT IN ({STOP}) THEN {bare} END"""


# Text after each tag sign, with what stands before the sign.
PIECES = """
    split AS (SELECT {id} AS id, string_split_regex({text}, '[#$]') AS p FROM {table}),
    pieces AS (
        SELECT id, unnest(p[2:]) AS piece, unnest(p[:-2]) AS before FROM split WHERE len(p) > 1)"""
FREE_TAGS = """
    SELECT id, {norm} AS symbol FROM (
        SELECT id, regexp_extract(piece, '^\\s*([A-Za-z][A-Za-z0-9.\\-]{{0,9}})([^A-Za-z0-9]|$)', 1) AS raw
        FROM pieces WHERE NOT regexp_matches(before, '[A-Za-z0-9]$')) WHERE raw <> ''"""
PREFIX_TAGS = """
    SELECT id, {norm} AS symbol FROM (
        SELECT id, regexp_extract(piece, '^\\s*([A-Za-z][A-Za-z0-9.\\-]{{0,9}})', 1) AS raw
        FROM pieces WHERE NOT regexp_matches(before, '[A-Za-z0-9]$')) WHERE raw <> ''"""
# Separators are doubled, so that one match can end and the next begin at the same one.
PLAIN = """
    SELECT id, {norm} AS symbol FROM (
        SELECT {id} AS id, replace(unnest(regexp_extract_all(regexp_replace({text}, '([^A-Za-z0-9])', '\\1\\1', 'g'),
            '(^|[^A-Za-z0-9])([A-Z][A-Z0-9]{{1,4}}(\\.\\.[A-Z0-9]{{1,3}})?)([^A-Za-z0-9]|$)', 2)), '..', '.') AS raw FROM {table})"""


def _pieces(table="documents", ident="doc_id", text="text") -> str:
    return PIECES.format(table=table, id=ident, text=text)


def _joined(rows: str) -> str:
    return f"""
    SELECT doc_id, coalesce(symbols, '') AS symbols FROM documents LEFT JOIN (
        SELECT id AS doc_id, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols
        FROM ({rows}) WHERE symbol IS NOT NULL GROUP BY 1) USING (doc_id)"""


def _listed(spark, sf, extract):
    return docs(spark, sf).select("doc_id", F.array_join(F.array_sort(extract("text")), ",").alias("symbols"))


@query("sym1", f"WITH {_pieces()} {_joined(FREE_TAGS.format(norm=_loose('raw')))}")
def sym1(spark, sf):
    return _listed(spark, sf, Y.free_cashtags)


@query("sym2", f"WITH {_pieces()} {_joined(PREFIX_TAGS.format(norm=_strict('raw')))}")
def sym2(spark, sf):
    return _listed(spark, sf, Y.cashtags)


_STRICT_TAGS = PREFIX_TAGS.format(norm=_strict("raw"))
_PLAIN_DOCS = PLAIN.format(norm=_strict("raw"), id="doc_id", text="text", table="documents")


@query("sym3", f"WITH {_pieces()} {_joined(_STRICT_TAGS + ' UNION ALL ' + _PLAIN_DOCS)}")
def sym3(spark, sf):
    return _listed(spark, sf, Y.plain_symbols)


def _word_counts(norm: str) -> str:
    return f"""
    SELECT {norm} AS symbol, count(*) AS n
    FROM (SELECT unnest(string_split(text, ' ')) AS raw FROM documents) GROUP BY 1 HAVING symbol IS NOT NULL"""


def _normal_words(spark, sf, norm):
    words = docs(spark, sf).select(F.explode_outer(F.split("text", " ")).alias("raw"))
    # A filter on the symbol would move to the words and make the normal form once for each of its parts.
    counts = words.select(norm("raw").alias("symbol")).groupBy("symbol").agg(F.count("symbol").alias("n"))
    return counts.where("n > 0")


# Words hold line breaks, which the strict form keeps out and trims at the edges.
_STRICT_WORD = _strict("regexp_replace(raw, '^\\s+|\\s+$', '', 'g')")


@query("sym4", _word_counts(_STRICT_WORD))
def sym4(spark, sf):
    return _normal_words(spark, sf, lambda w: Y.strict_symbol(F.btrim(w, F.lit(Y.BLANKS))))


@query("sym5", _word_counts(_loose("raw")))
def sym5(spark, sf):
    return _normal_words(spark, sf, Y.loose_symbol)


@query(
    "sym6",
    """
    SELECT symbol, array_to_string(list_sort(list_distinct([s, split_part(s, '.', 1), split_part(s, '-', 1), split_part(s, ':', 1)])), ',') AS variants
    FROM (SELECT symbol, upper(symbol) || '-' || p_size || ':' || p_type AS s FROM companies)""",
    "companies",
)
def sym6(spark, sf):
    whole = F.concat("symbol", F.lit("-"), "p_size", F.lit(":"), "p_type")
    return V.companies(spark, sf).select(
        "symbol", F.array_join(F.array_sort(Y.symbol_variants(whole)), ",").alias("variants")
    )


@query(
    "sym7",
    f"""
    WITH s AS (SELECT symbol, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9& ]+', ' ', 'g'), ' +', ' ', 'g')) AS n FROM companies),
    t AS (SELECT symbol, n, string_split(n, ' ') AS w FROM s),
    k AS (SELECT symbol, n, w, unnest(range(1, len(w) + 1)) AS cut FROM t),
    v AS (SELECT symbol, n AS v FROM s UNION SELECT symbol, replace(n, '&', 'and') FROM s WHERE contains(n, '&')
          UNION SELECT symbol, array_to_string(w[:len(w) - cut], ' ') FROM k
          WHERE len(list_filter(w[len(w) - cut + 1:], lambda x: x NOT IN ({quoted(CORPORATE_SUFFIXES)}))) = 0)
    SELECT symbol, string_agg(v, '|' ORDER BY v) AS variants FROM v WHERE length(v) >= 3 GROUP BY 1""",
    "companies",
)
def sym7(spark, sf):
    return V.companies(spark, sf).select(
        "symbol", F.array_join(F.array_sort(Y.name_variants("name")), "|").alias("variants")
    )


_MASTER_ALIASES = f"""
    WITH b AS (SELECT symbol, lower(trim(name)) AS base, trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', ' ', 'g')) AS clean FROM companies),
    t AS (SELECT symbol, base, clean, list_filter(string_split(clean, ' '), lambda x: x <> '' AND x NOT IN ({quoted(MASTER_SUFFIXES)})) AS w FROM b),
    v AS (SELECT symbol, base AS v FROM t UNION SELECT symbol, clean FROM t
          UNION SELECT symbol, array_to_string(w, ' ') FROM t UNION SELECT symbol, w[1] FROM t)"""


@query(
    "sym8",
    f"{_MASTER_ALIASES} SELECT upper(symbol) AS ticker, v AS alias FROM v WHERE v <> ''",
    "companies",
)
def sym8(spark, sf):
    return mentions.master_alias_rows(V.companies(spark, sf))


# --- mentions -----------------------------------------------------------------

def _escaped(column: str) -> str:
    return f"regexp_replace(lower({column}), '([^a-z0-9 ])', '\\\\\\1', 'g')"


_NAMES = "SELECT ticker AS symbol, alias FROM aliases UNION SELECT ticker, ticker FROM aliases"
# Exchange forms share their names; every symbol is its own name.
_BUCKET_NAMES = """
    SELECT DISTINCT symbol, lower(alias) AS alias FROM (
        SELECT ticker AS symbol, alias FROM aliases UNION ALL SELECT split_part(ticker, '.', 1), alias FROM aliases
        UNION ALL SELECT split_part(ticker, '-', 1), alias FROM aliases)
    WHERE symbol IN (SELECT symbol FROM asked) UNION SELECT symbol, lower(symbol) FROM asked"""
_ASKED = "SELECT DISTINCT unnest([ticker, split_part(ticker, '.', 1)]) AS symbol FROM aliases"


@query(
    "jon3",
    f"""
    WITH asked AS ({_ASKED}), names AS ({_BUCKET_NAMES})
    SELECT DISTINCT id, symbol FROM text_posts, names
    WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || {_escaped('alias')} || '([^a-z0-9]|$)')""",
    "text_posts aliases",
)
def jon3(spark, sf):
    table = V.aliases(spark)
    asked = table.select(F.explode(Y.symbol_variants("ticker")).alias("ticker"))
    names = mentions.exchange_aliases(table, asked)
    return mentions.alias_matches(V.text_posts(spark, sf), names, "bucket", ["id"])


# Two names of every document, its first two and its first three words of plain letters.
_DOC_NAMES = """
    SELECT DISTINCT 'D' || doc_id AS symbol, alias FROM (
        SELECT doc_id, unnest([regexp_extract(lower(text), '[a-z]+ [a-z]+'), regexp_extract(lower(text), '[a-z]+ [a-z]+ [a-z]+')]) AS alias
        FROM documents) WHERE alias <> ''"""


@query(
    "jon3_many",
    f"""
    WITH names AS ({_DOC_NAMES}),
    marked AS (SELECT doc_id, chr(1) || regexp_replace(lower(text), '([^a-z0-9])', chr(1) || '\\1' || chr(1), 'g') || chr(1) AS m FROM documents),
    spelled AS (SELECT DISTINCT alias, chr(1) || replace(alias, ' ', chr(1) || ' ' || chr(1)) || chr(1) AS n FROM names),
    hits AS (SELECT doc_id, alias FROM marked JOIN spelled ON contains(m, n))
    SELECT alias, count(DISTINCT doc_id) AS documents, count(DISTINCT symbol) AS symbols FROM hits JOIN names USING (alias) GROUP BY 1""",
)
def jon3_many(spark, sf):
    rows = docs(spark, sf)
    found = F.array(*[F.regexp_extract(F.lower("text"), p, 0) for p in ("[a-z]+ [a-z]+", "[a-z]+ [a-z]+ [a-z]+")])
    names = rows.select(F.concat(F.lit("D"), "doc_id").alias("symbol"), F.explode(found).alias("alias")).where("alias <> ''").distinct()
    # Documents that share a name are one symbol each; matches are counted by name.
    single = names.select(F.col("alias").alias("symbol"), "alias").distinct()
    hits = mentions.alias_matches(rows, single, "bucket", ["doc_id"]).withColumnRenamed("symbol", "alias")
    counts = hits.groupBy("alias").agg(F.count(F.lit(1)).alias("documents"))
    return counts.join(names.groupBy("alias").agg(F.countDistinct("symbol").alias("symbols")), "alias")


def _trend_hits(table: str, text: str) -> str:
    """Hits of the fixed names under the trend rules, one constant pattern per name."""
    word, none = "[\\pL\\pN_]", "[^\\pL\\pN_]"
    names = {(t, a.lower()) for t, a in V.ALIASES} | {(t, t.lower()) for t, _ in V.ALIASES}
    rows = []
    for symbol, name in sorted(names):
        esc = re.sub(r"([^a-z0-9 ])", r"\\\1", name)
        right = f"({none}|$)" if name[-1].isalnum() else word
        rows.append(
            f"SELECT id, '{symbol}' AS symbol FROM {table} WHERE"
            f" regexp_matches(lower({text}), '(^|{none}){esc}{right}|(^|{none})[$#]{esc}({none}|$)')"
        )
    return " UNION ALL ".join(rows)


def _marked(text: str) -> str:
    """Text with every separator between marks, so that whole words can be found by contains."""
    return f"chr(1) || regexp_replace(lower({text}), '([^\\pL\\pN_])', chr(1) || '\\1' || chr(1), 'g') || chr(1)"


@query(
    "jon4",
    f"""
    WITH names AS ({_NAMES}), {_pieces('text_posts', 'id')},
    hits AS ({_trend_hits('text_posts', 'text')} UNION {FREE_TAGS.format(norm=_loose('raw'))})
    SELECT DISTINCT id, symbol FROM hits WHERE symbol IS NOT NULL""",
    "text_posts aliases",
)
def jon4(spark, sf):
    rows = V.text_posts(spark, sf)
    named = mentions.alias_matches(rows, mentions.alias_table(V.aliases(spark)), "trend", ["id"])
    tagged = rows.select("id", F.explode(Y.free_cashtags("text")).alias("symbol"))
    return named.unionByName(tagged).distinct()


_SYNONYMS = [("thing", "object"), ("and", "plus"), ("small", "little"), ("ring", "band"), ("ring", "Ring")]


@query(
    "jon5",
    f"""
    WITH named AS (SELECT symbol, split_part(lower(name), ' ', 1) AS alias FROM companies),
    syn AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _SYNONYMS)}) AS v(word, synonym))
    SELECT symbol, alias FROM named UNION SELECT symbol, symbol FROM named
    UNION SELECT symbol, synonym FROM named JOIN syn ON lower(alias) = lower(word) AND lower(synonym) <> lower(word)""",
    "companies",
)
def jon5(spark, sf):
    named = V.companies(spark, sf).select(
        F.col("symbol").alias("ticker"), F.substring_index(F.lower("name"), " ", 1).alias("alias")
    )
    return mentions.alias_table(named, spark.createDataFrame(_SYNONYMS, "word string, synonym string"))


@query(
    "jon6",
    f"""
    SELECT ticker AS symbol FROM aliases UNION SELECT {_loose('symbol')} FROM watchlist
    UNION SELECT {_loose('ticker')} FROM prices UNION SELECT {_loose('chat_id')} FROM watchlist WHERE {_loose('chat_id')} IS NOT NULL""",
    "aliases watchlist prices",
)
def jon6(spark, sf):
    watched = V.watchlist(spark, sf)
    others = (watched, "symbol"), (V.prices(spark, sf), "ticker"), (watched, "chat_id")
    return mentions.known_symbols(V.aliases(spark), *others)


_STATS = f"""
    {_pieces()},
    tagged AS (SELECT DISTINCT id, symbol FROM ({_STRICT_TAGS}) WHERE symbol IS NOT NULL),
    plain AS (SELECT id, symbol FROM ({_PLAIN_DOCS}) WHERE symbol IS NOT NULL UNION SELECT id, symbol FROM tagged),
    stats AS (SELECT symbol, count(*) AS total, count(t.id) AS cashtag
              FROM plain LEFT JOIN tagged t USING (id, symbol) GROUP BY 1)"""


@query("agg10", f"WITH {_STATS} SELECT * FROM stats")
def agg10(spark, sf):
    return mentions.candidate_symbols(docs(spark, sf))


@query(
    "agg11",
    f"""WITH {_STATS} SELECT * FROM stats WHERE (cashtag > 0 OR total >= 2)
    AND symbol NOT IN (SELECT upper(symbol) FROM master WHERE symbol < 'EM')""",
    "master",
)
def agg11(spark, sf):
    known = V.master(spark).where("symbol < 'EM'").select(F.lower("symbol").alias("symbol"))
    return mentions.discover_symbols(mentions.candidate_symbols(docs(spark, sf)), known)


@query(
    "jon7",
    f"""WITH {_STATS} SELECT symbol, total, cashtag FROM stats WHERE (cashtag > 0 OR total >= 2)
    AND symbol IN (SELECT symbol FROM master)""",
    "master",
)
def jon7(spark, sf):
    stats = mentions.candidate_symbols(docs(spark, sf))
    nothing = V.master(spark).where("symbol IS NULL")
    found = mentions.discover_symbols(stats, nothing)
    valid = mentions.validate_symbols(found, V.master(spark))
    return found.join(valid.select("symbol"), "symbol").select("symbol", "total", "cashtag")


_BUCKET = f"""
    asked AS (SELECT ticker AS symbol FROM aliases), names AS ({_BUCKET_NAMES}),
    whole AS (SELECT id, created_utc, coalesce(title, '') || chr(10) || text AS text FROM text_posts),
    hits AS (SELECT DISTINCT id, created_utc, symbol FROM whole, names
             WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || {_escaped('alias')} || '([^a-z0-9]|$)')),
    best AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY created_utc DESC, id) AS rn FROM hits)"""


@query(
    "bkt1",
    f"""
    WITH {_BUCKET}
    SELECT symbol AS ticker, id, md5(text) AS text FROM best JOIN whole USING (id) WHERE rn <= 100""",
    "text_posts aliases",
)
def bkt1(spark, sf):
    table = V.aliases(spark)
    rows = mentions.bucket_posts(V.text_posts(spark, sf), table.select("ticker").distinct(), table, per_symbol=BUCKET_POSTS)
    return rows.select("ticker", "id", F.md5("text").alias("text"))


@query("bkt1_scored")
def bkt1_scored(spark, sf):
    table = V.aliases(spark)
    rows = mentions.bucket_posts(
        V.text_posts(spark, sf), table.select("ticker").distinct(), table, master=V.master(spark)
    )
    return rows.select("ticker", "id", "sentiment")


# --- trend scan ---------------------------------------------------------------

DOC_WEIGHT = "(1 + log10(1 + upvotes) + 0.2 * log10(1 + num_comments))"


def _mentions_sql(weight: str = "1") -> str:
    """Every mention in the week before the scan, with the time its tag was last seen."""
    return f"""
    names AS ({_NAMES}),
    scan AS (SELECT *, coalesce(title, '') || ' ' || text AS whole, CAST({weight} AS DOUBLE) AS weight FROM text_posts
             WHERE created_utc >= TIMESTAMP '2024-01-01' AND created_utc <= TIMESTAMP '2024-01-08'),
    {_pieces('scan', 'id', 'whole')},
    tagged AS (SELECT DISTINCT id, symbol FROM ({FREE_TAGS.format(norm=_loose('raw'))}) WHERE symbol IS NOT NULL),
    tags AS (SELECT symbol, max(created_utc) AS tagged_at FROM tagged JOIN scan USING (id)
             WHERE symbol NOT IN (SELECT symbol FROM names) GROUP BY 1),
    marked AS (SELECT id, {_marked('whole')} AS m FROM scan),
    words AS (SELECT s.id, t.symbol, tagged_at FROM marked s JOIN (SELECT *, {_marked('symbol')} AS n FROM tags) t ON contains(s.m, t.n)),
    found AS (SELECT id, symbol, NULL AS tagged_at FROM ({_trend_hits('scan', 'whole')})
              UNION ALL SELECT id, symbol, NULL FROM tagged UNION ALL SELECT * FROM words),
    hits AS (SELECT id, symbol, created_utc, weight,
                    CASE WHEN count(*) FILTER (tagged_at IS NULL) = 0 THEN max(tagged_at) END AS tagged_at
             FROM found JOIN scan USING (id) GROUP BY 1, 2, 3, 4)"""


def _cell_sql(lookback: int, window: int, number: int) -> str:
    split = f"TIMESTAMP '2024-01-08' - INTERVAL {window} HOUR"
    start = f"TIMESTAMP '2024-01-08' - INTERVAL {lookback * 24} HOUR"
    ok = f"(tagged_at IS NULL OR tagged_at >= least({start}, {split}))"
    return f"""
    SELECT symbol, {number} AS grid_no, {lookback} AS lookback_days, {window} AS window_hours,
           sum(weight) FILTER ({ok} AND created_utc >= {split} AND created_utc <= TIMESTAMP '2024-01-08') AS recent,
           coalesce(sum(weight) FILTER ({ok} AND created_utc >= {start} AND created_utc < {split}), 0) AS base
    FROM hits GROUP BY 1"""


_GRID = [(3, 12), (3, 24), (7, 12), (7, 24)]
_CELLS = " UNION ALL ".join(_cell_sql(lb, w, i) for i, (lb, w) in enumerate(_GRID))
_RATED = """
    rated AS (SELECT *, greatest(1, lookback_days * 24 - window_hours) AS base_hours,
                     (base + 0.5) / (greatest(1, lookback_days * 24 - window_hours) + 0.5) AS rate FROM cells),
    scored AS (SELECT *, CAST(round_even(recent, 0) AS BIGINT) AS mentions,
                      round_even(recent, 0) / greatest(1e-6, rate * window_hours) AS lift FROM rated WHERE recent IS NOT NULL),
    trended AS (SELECT *, lift * ln(1 + mentions) AS trend FROM scored)"""
_SCAN_COLUMNS = """symbol, mentions, round(rate, 6) AS baseline_rate_per_h, round(lift, 6) AS lift, round(trend, 6) AS trend,
    symbol IN (SELECT symbol FROM names) AS is_known"""


def _mentions(spark, sf, weight=None):
    recent = trends.recent_posts(V.text_posts(spark, sf), V.DOCS_AS_OF, 7, 24)
    whole = recent.withColumn("text", X.combined_text("title", "text"))
    return mentions.symbol_mentions(whole, mentions.alias_table(V.aliases(spark)), weight)


def _known(spark):
    return mentions.known_symbols(V.aliases(spark))


@query(
    "agg12",
    f"WITH {_mentions_sql(DOC_WEIGHT)} SELECT symbol, round(recent, 6) AS recent, round(base, 6) AS base FROM ({_cell_sql(7, 24, 0)})",
    "text_posts aliases",
)
def agg12(spark, sf):
    weighted = _mentions(spark, sf, S.post_weight("upvotes", "num_comments"))
    counts = trends.mention_counts(weighted, V.DOCS_AS_OF, [(7, 24)])
    return rounded(counts.select("symbol", "recent", "base"))


@query(
    "trd1",
    f"""WITH {_mentions_sql()}, cells AS ({_cell_sql(7, 24, 0)}), {_RATED}
    SELECT {_SCAN_COLUMNS} FROM trended WHERE mentions >= 3 AND lift >= 1.0""",
    "text_posts aliases",
)
def trd1(spark, sf):
    found = trends.trend_scan(
        _mentions(spark, sf), _known(spark), V.DOCS_AS_OF, min_mentions=3, min_lift=1.0
    )
    return rounded(found)


_SCAN = f"WITH {_mentions_sql()}, cells AS ({_cell_sql(7, 24, 0)}), {_RATED}, s AS (SELECT * FROM trended WHERE mentions >= 3 AND lift >= 1.0)"


def _scanned(spark, sf):
    """A scan written back to a table that knows the aliases' symbols."""
    found = trends.trend_scan(_mentions(spark, sf), _known(spark), V.DOCS_AS_OF, min_mentions=3, min_lift=1.0)
    seen = F.lit("2024-01-01 00:00:00").cast("timestamp")
    target = V.aliases(spark).select(F.col("ticker").alias("symbol")).distinct().select(
        "symbol", F.lit(1).cast("bigint").alias("mentions_24h"), F.lit(0.5).alias("baseline_rate_per_h"), F.lit(2.0).alias("lift"),
        F.lit(3.0).alias("trend"), seen.alias("first_seen"), seen.alias("last_seen"),
    )
    return trends.scan_tables(found, target, V.DOCS_AS_OF)


@query(
    "scan_tables",
    f"""{_SCAN}, t AS (SELECT DISTINCT ticker AS symbol FROM aliases)
    SELECT coalesce(t.symbol, s.symbol) AS symbol, coalesce(mentions, 1) AS mentions_24h, round(coalesce(rate, 0.5), 6) AS baseline_rate_per_h,
           round(coalesce(lift, 2.0), 6) AS lift, round(coalesce(trend, 3.0), 6) AS trend,
           CASE WHEN t.symbol IS NULL THEN TIMESTAMP '2024-01-08' ELSE TIMESTAMP '2024-01-01' END AS first_seen,
           CASE WHEN s.symbol IS NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-08' END AS last_seen
    FROM t FULL JOIN s ON t.symbol = s.symbol""",
    "text_posts aliases",
    stamps="first_seen last_seen",
)
def scan_tables(spark, sf):
    return rounded(_scanned(spark, sf)[1])


@query(
    "scan_history",
    f"{_SCAN} SELECT symbol, mentions AS mentions_24h, round(lift, 6) AS lift, TIMESTAMP '2024-01-08' AS ts FROM s",
    "text_posts aliases",
    stamps="ts",
)
def scan_history(spark, sf):
    return rounded(_scanned(spark, sf)[0].select("symbol", "mentions_24h", "lift", "ts"))


@query(
    "trd1_weighted",
    f"""WITH {_mentions_sql(DOC_WEIGHT)}, cells AS ({_cell_sql(7, 24, 0)}), {_RATED}
    SELECT {_SCAN_COLUMNS} FROM trended WHERE mentions >= 5 AND lift >= 1.0""",
    "text_posts aliases",
)
def trd1_weighted(spark, sf):
    weighted = _mentions(spark, sf, S.post_weight("upvotes", "num_comments"))
    return rounded(trends.trend_scan(weighted, _known(spark), V.DOCS_AS_OF, min_mentions=5, min_lift=1.0))


@query(
    "trd3",
    f"""WITH {_mentions_sql()}, cells AS ({_cell_sql(7, 24, 0)}), {_RATED},
    floor_ AS (SELECT CASE WHEN q < 1 THEN greatest(1.5, 2.0 * greatest(q, 0.1))
                      ELSE greatest(2.0, 2.0 * q / greatest(1, 144 / 24)) END AS least_lift
               FROM (SELECT quantile_cont(rate, 0.9) AS q FROM rated))
    SELECT {_SCAN_COLUMNS} FROM trended WHERE mentions >= 3 AND lift >= (SELECT least_lift FROM floor_)""",
    "text_posts aliases",
)
def trd3(spark, sf):
    found = trends.trend_scan(
        _mentions(spark, sf), _known(spark), V.DOCS_AS_OF, min_mentions=3, min_lift=2.0, lift_quantile=0.9
    )
    return rounded(found)


_BEST = f"""
    cells AS ({_CELLS}), {_RATED},
    best AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(trend, 9) DESC, grid_no) AS rn
             FROM trended WHERE mentions >= 3 AND lift >= 1.0)"""


@query(
    "trd4",
    f"""WITH {_mentions_sql()}, {_BEST}
    SELECT {_SCAN_COLUMNS}, lookback_days, window_hours FROM best WHERE rn = 1""",
    "text_posts aliases",
)
def trd4(spark, sf):
    best = trends.trend_grid(_mentions(spark, sf), _known(spark), V.DOCS_AS_OF, min_mentions=3, min_lift=1.0)
    return rounded(best.drop("grid_no"))


@query(
    "rnk3",
    f"""WITH {_mentions_sql()}, {_BEST} SELECT symbol, grid_no FROM best WHERE rn = 1""",
    "text_posts aliases",
)
def rnk3(spark, sf):
    best = trends.trend_grid(_mentions(spark, sf), _known(spark), V.DOCS_AS_OF, min_mentions=3, min_lift=1.0)
    return best.select("symbol", "grid_no")


@query(
    "top4",
    f"""WITH {_mentions_sql()}, cells AS ({_cell_sql(7, 24, 0)}), {_RATED}
    SELECT symbol, row_number() OVER (ORDER BY symbol IN (SELECT symbol FROM names) DESC, round(trend, 6) DESC,
           round(lift, 6) DESC, mentions DESC, symbol) AS place
    FROM trended WHERE mentions >= 3 AND lift >= 1.0 ORDER BY place LIMIT 20""",
    "text_posts aliases",
)
def top4(spark, sf):
    found = trends.trend_scan(_mentions(spark, sf), _known(spark), V.DOCS_AS_OF, min_mentions=3, min_lift=1.0)
    best = rounded(found).orderBy(*trends.candidate_order()).limit(20)
    place = F.row_number().over(trends.Window.orderBy(*trends.candidate_order()))
    return best.select("symbol", place.cast("bigint").alias("place"))
