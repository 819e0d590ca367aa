"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import new_folder
from . import (
    conversation_repair, embedding_join, html_text, line_dedup, minhash_dedup, quality_rules, secret_scan, sentence_pieces, source_mix, suffix_dedup,
    toxicity, vector_codes, warc,
)
from .common import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def piece_model() -> str:
    """Where the public SentencePiece model lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    folder = new_folder(spark, "secret-ledger")
    secret_scan.scan_increment(versions, secret_scan.empty_ledger(spark)).write.mode("append").parquet(folder)
    found = secret_scan.findings_by_path(versions, spark.read.schema(secret_scan.LEDGER).parquet(folder))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("path").cast("long").alias("doc_id"), *(count(k) for k in secret_scan.BASE), sha(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def _spans_sql(rule: secret_scan.Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return rf"""
      SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, e - length(f) AS s, e FROM (
        SELECT doc_id, f, g, sum(length(b) + length(f)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
          SELECT doc_id, unnest(string_split_regex(t, '{pattern}')) AS b,
            unnest(list_append(regexp_extract_all(t, '{pattern}'), '')) AS f,
            unnest(list_append(regexp_extract_all(t, '{pattern}', {rule.group}), '')) AS g,
            unnest(range(len(string_split_regex(t, '{pattern}')))) AS i
          FROM d WHERE regexp_matches(t, '{pattern}')))
      WHERE length(g) >= {max(1, rule.least)}"""


ORACLES["op1_secret_scan"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans_sql(r, i) for i, r in enumerate(secret_scan.RULES))}),
n AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (doc_id)"""


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", sha(F.col("text")).alias("kept_sha256"))


ORACLES["op2_line_dedup"] = rf"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {LOWER_SQL.format("trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))")} AS key FROM d),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id"""


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _rules_sql() -> str:
    """The threshold table as a condition."""
    metric = {
        "mean_word_chars": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
        "upper_share": ("n_upper", "word_chars"), "stop_word_share": ("n_stop", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    }
    parts = []
    for rule in quality_rules.RULES:
        top, below = metric[rule.metric]
        value = f"(CASE WHEN {below} > 0 THEN {top}::DOUBLE / {below} ELSE 0.0 END)"
        parts += [f"{value} >= {rule.low}"] * (rule.low is not None) + [f"{value} <= {rule.high}"] * (rule.high is not None)
    return " AND ".join(parts)


ORACLES["op3_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS three
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM f, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
  len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(quality_rules.STOP_WORDS))}))) AS n_stop FROM d),
a AS (SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_upper, n_stop,
  len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM m JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_rules_sql()} AS kept FROM b"""


@query
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op4_repeated_passages"] = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS start, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
h AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, start, doc_id = first AS is_first FROM g JOIN h USING (g)),
n AS (SELECT *, coalesce(start > lag(start) OVER w + 50, TRUE) AS new FROM m WINDOW w AS (PARTITION BY doc_id, is_first ORDER BY start)),
k AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, is_first ORDER BY start) AS k FROM n)
SELECT doc_id, min(start)::INTEGER AS start_word, (max(start) + 50)::INTEGER AS end_word, (max(start) + 50 - min(start))::INTEGER AS n_words, is_first
FROM k GROUP BY doc_id, is_first, k"""


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sizes(table(spark, sf_dir, "documents"))


@query
def op6_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_embeddings(table(spark, sf_dir, "embeddings"))


ORACLES["op6_embedding_join"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 ELSE FALSE END),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a AS vec_id, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_dedup.near_duplicates(docs, width=4, percent=80)


ORACLES["op8_minhash_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(c, doc_id)) AS kept
FROM documents LEFT JOIN z USING (doc_id) LEFT JOIN c USING (doc_id)"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentence_pieces.encode(docs, piece_model(), decoded="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join("ids", ",")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256")
    )



@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = warc.write_warc(pages, new_folder(spark, "warc"))
    found = warc.read_warc(manifest, ["key", "record_type", "payload_bytes", "payload_digest", "refers_to"])
    return found.select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


ORACLES["op11_warc"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS m FROM p WHERE b >= {warc.LEAST_REVISIT} GROUP BY d)
SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to FROM p LEFT JOIN k USING (d)"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.sha2(F.lit(numbers), 256).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """Rounds of assignment ``a`` and codebooks ``b``, one pair for each round."""
    parts, entries, rounds = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    far = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, e[part * len(e) // {parts} + 1:(part + 1) * len(e) // {parts}] AS x FROM v, range({parts}) AS r(part))",
        f"""b0 AS MATERIALIZED (SELECT part, k, x AS y FROM p
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY k < {entries}) USING (vec_id))""",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, label, part, x, min({{'d': {far}, 'k': k}}) AS m FROM p JOIN b{i} USING (part) GROUP BY ALL)")
        if i < rounds:
            steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT part, k, coalesce(mean, y) AS y FROM b{i} LEFT JOIN (
  SELECT part, k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS mean FROM (
    SELECT part, m.k AS k, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS j FROM a{i}) GROUP BY ALL)
  GROUP BY ALL) USING (part, k))""")
    return ",\n".join(steps) + f""",
c AS (SELECT vec_id, label, string_agg(printf('%02x', m.k::INTEGER), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, k)) FROM b{rounds}) AS codebooks_sha256 FROM c"""


ORACLES["op12_vector_codes"] = f"WITH {_codes_sql()}"


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.digests(conversation_repair.repair(conversation_repair.damage(rows)))
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    found = every.join(found.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in conversation_repair.COUNTS]
    return found.select(
        F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", sha(F.lit(None))).alias("repaired_sha256")
    )
