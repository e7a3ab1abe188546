"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage here: a table written as Parquet survives the loss of any
executor, and later reads never recompute what came before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import delete, own_tables, written

#: Most ids that are sent to every task instead of shuffling the rows they select (8 bytes each).
MOST_IDS = 1 << 22


class Tables:
    """The tables of one run of an operator: written under a folder of their own, dropped when a successor is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.n = spark, f"{own_tables(spark)}/{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads it back."""
        self.n += 1
        path = f"{self.at}/{self.n}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = back, path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that nothing reads any more."""
        for table in tables:
            delete(self.spark, self.paths.pop(id(table))[1])


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back."""
    return written(df, name)


def few(ids: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """A stored table of ids, marked for broadcast if it has at most ``most`` rows; larger ones are left to a shuffled join."""
    return F.broadcast(ids) if ids.count() <= most else ids


def whole_texts(docs: DataFrame, taken: DataFrame, most: int) -> DataFrame:
    """The ``text`` of the rows of ``taken`` (``doc_id``, ``place`` and more; a sample of bounded rows), at most ``most`` characters in all.

    Rows come in the order of ``place``; one that doesn't fit any more is left out whole, so no text is cut and
    the caller may collect what is left. Of an id's texts the first by order counts; a null text is empty.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = text.join(F.broadcast(taken.select("doc_id", "place")), "doc_id").groupBy("doc_id", "place").agg(F.max(F.length("text")).alias("n"))
    left, fit = most, []
    for r in sorted(sizes.collect(), key=lambda r: (r["place"], r["doc_id"])):
        if r["n"] <= left:
            left -= r["n"]
            fit.append(r["doc_id"])
    chosen = taken.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in fit], "doc_id long")), "doc_id")
    kept = [c for c in taken.columns if c != "place"]
    return text.join(F.broadcast(chosen), "doc_id").groupBy(*kept).agg(F.min("text").alias("text"))


def crc_mod(column, modulus: int):
    """``crc32`` of a value's text form, modulo ``modulus``: the fold of a row."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
