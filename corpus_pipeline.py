"""A training corpus from raw documents: five stages, each of one operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet
and read again as the documents of the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolpulse.llm import line_dedup, minhash_dedup, sentence_pieces, source_mix, toxicity
from symbolpulse.llm.common import spare, table
from symbolpulse.llm.queries import piece_model
from symbolpulse.operators.storage import stored


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of one half or more go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["text"]).where("score < 0.5").select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the last of them only."""
    return _counted(line_dedup.dedup_lines(docs).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id.

    A row goes by its id and text, so another text under the same id keeps its own verdict.
    """
    address = spare(docs, "_address")
    named = docs.withColumn(address, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    found = minhash_dedup.near_duplicates(named.select("doc_id", "text", address), keep=[address])
    gone = found.where("not kept").select("doc_id", address).distinct()
    return named.join(gone.hint("shuffle_hash"), ["doc_id", address], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document; documents it takes nothing of go."""
    return source_mix.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` and ``decoded``, the text that the ids stand for."""
    both = sentence_pieces.encode(docs.select("doc_id", "lang", "source", "text"), piece_model(), decoded="decoded")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("sentence_pieces", tokenize),
]

#: SQL cannot say compression, tokenization and seeded draws; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
