"""A corpus pipeline over `documents`: language, lines, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents; n_chars follows the text.

Defined results:
- empty tables pass through every stage
- rows with a null id keep their lines, stay in the near-copy stage, and are packed
- texts that are null or without letters, and those whose two best languages are as good as tied, go with the first stage
- rows that share an id are one document to the second stage; of rows with equal ids and texts the third keeps one
- of a group of near copies the smallest id stays; of rows with that id and fingerprint the text of the smallest hash
- a text of any length is one row until the last stage cuts its tokens
- columns beyond those of documents are dropped by the first stage
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, linededup, packing, pii, simhash
from weftline.llm.common import held_out, read_table, shared_folder
from weftline.llm.queries import PII_KEY, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; the others go."""
    model = langid.train(docs, ~held_out("doc_id"))
    return langid.identify(docs, model).filter("not rejected").select(*COLUMNS)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first of them."""
    others = [c for c in COLUMNS if c not in ("text", "n_chars")]
    return linededup.dedup_lines(docs, keep=others).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates."""
    return pii.replace(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, as few as can be found."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_shared_lines),
    ("simhash_near_dedup", without_near_copies),
    ("pii_surrogates", without_personal_data),
    ("best_fit_packing", packed),
]

#: Compression, fingerprints' components, keyed surrogates and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each earlier stage written to the shared folder and read again."""
    docs, place = read_table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
