"""Corpus pipeline over ``documents``: language, boilerplate lines, near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages 1 to 4 return the columns of ``documents``. Between stages the
rows are written as Parquet and read again.

Defined results for hard rows: null and letterless texts go in stage 1, and only these if there is no label to learn a language from; later stages keep what their operators state. ``n_chars`` follows
the text. Rows that share a doc_id are told apart by their content in stage 3; of equal rows one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import covering, decontaminate, language, pieces, site_lines
from strataline.llm.common import documents_like, prepare, table
from strataline.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL: the language model, the fingerprints and the pieces cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; null texts and texts without letters go."""
    prepare(spark)
    docs = documents_like(docs, COLUMNS)
    return language.keep_known(docs, *language.learn(docs.select("doc_id", "text", "lang")))


def site_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in more than the boilerplate share of a source's different texts are taken out of the texts."""
    prepare(spark)
    out = site_lines.drop_boilerplate(documents_like(docs, COLUMNS), "source", distinct_texts=True)
    return documents_like(out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars"))), COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each component of near copies (3-word shingles, 3 bits)."""
    prepare(spark)
    return covering.keep_one(documents_like(docs, COLUMNS))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    prepare(spark)
    return decontaminate.keep_clean(documents_like(docs, COLUMNS), decontaminate.one_text(table(spark, sf_dir, "benchmark", "item_id", "text")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text and the digest of the text decoded from them."""
    prepare(spark)
    return pieces.with_digests(docs)


STAGES = [
    ("language", known_language),
    ("site_lines", site_boilerplate),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else materialise(docs), sf_dir)
    return docs
