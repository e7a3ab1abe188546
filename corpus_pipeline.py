"""The corpus pipeline: quality rules, near-duplicates, decontamination, surrogates, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
back as the next stage's ``docs``. All but the last return the columns of ``documents``.

For every stage: other columns of ``docs``, whatever their names, are left out; an empty table gives no rows; a
text of any length is one row's work. A null or empty text has no words, so the first stage rejects it; the
others keep such a row as it is (encoded: no ids).

The stages with Python workers let Spark hand rows over in small batches; this holds for the session from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, decontaminate, near_dup, pii, quality
from strandline.llm.lean import small_batches
from strandline.llm.queries import secret, table, tokenizer
from strandline.llm.store import few, store
from strandline.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and don't diverge from their language's reference, if it has one.

    A null language is judged by the nearest reference. Repeated rows are judged alike; a distance that equals
    its limit passes.
    """
    return quality.passing(docs, COLUMNS, nearest=False)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows without an id can't be compared and stay; repeated rows of a kept id stay as they are.
    """
    small_batches(spark)
    gone = store(near_dup.near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "near-duplicates")
    return docs.join(few(gone), "doc_id", "left_anti").select(COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: less than 75 percent of the shingles of each.

    Rows without an id stay. Of an id with several texts all rows go if they hold an item together.
    """
    small_batches(spark)
    leaks = store(decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(few(leaks), "doc_id", "left_anti").select(COLUMNS)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; ``n_chars`` follows the new text.

    The key is the one in ``STRANDLINE_PII_KEY``, else new for each run. Repeated rows stay equal.
    """
    small_batches(spark)
    out = pii.pseudonymised(docs.select(COLUMNS), secret())
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left; repeated rows give repeated ids."""
    small_batches(spark)
    path = tokenizer("byte_bpe_50k.json")
    return bpe.encode(docs, path, keep=["doc_id", "source", "lang"]).select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", deduplicate),
    ("decontamination", remove_benchmark),
    ("surrogates", pseudonymise),
    ("encoding", encode),
]

#: MinHash, keyed surrogates and byte-pair merges can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on what the one before has written."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, f"stage{k}")
    return docs
