"""Importance resampling of a corpus towards a target, by hashed n-grams of a table of word positions.

Every word is a row with its place; for longer features the words behind it come from ``lead`` windows. Features are
hashed to buckets, both corpora are counted by bucket, and a document's weight is the sum of its features' gains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.store import Tables
from strandline.operators.series import blocked, ranked, unmargined

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Gains of so many buckets at most are sent to every task; more are joined by a shuffle.
MOST_BUCKETS = 1 << 20


def words(text: Column) -> Column:
    """The words of a text: letters, digits and all beyond ASCII, A to Z in small letters; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def positions(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, idx, word``: one row per word; a text without words has one row with nulls."""
    return texts.select(*keys, F.posexplode_outer(words(F.col("text"))).alias("idx", "word"))


def features(texts: DataFrame, keys: list[str], longest: int = 1, block: int = 65536) -> DataFrame:
    """``keys, idx, feature``: all runs of 1 to ``longest`` words, joined by one space; a text without words has one null.

    ``idx`` is null or the place of the first word. Beyond single words, words are windowed over blocks of a text with
    the first words of the next block behind them, so no text is one task's work; ``keys`` must then be unique.
    """
    placed = positions(texts, keys)
    if longest == 1:
        return placed.withColumnRenamed("word", "feature")
    own = blocked(placed.filter("idx is not null"), longest - 1, block)
    ahead = Window.partitionBy(*keys, "block").orderBy("idx")
    rows = own.select(*keys, "block", "idx", *[F.lead("word", k).over(ahead).alias(f"w{k}") for k in range(longest)])
    runs = [F.when(F.col(f"w{n}").isNotNull(), F.concat_ws(" ", *[f"w{k}" for k in range(n + 1)])) for n in range(longest)]
    found = unmargined(rows, block).select(*keys, "idx", F.explode(F.array_compact(F.array(*runs))).alias("feature"))
    return found.unionByName(placed.filter("idx is null").withColumnRenamed("word", "feature"))


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, longest: int, buckets: int, name: str) -> DataFrame:
    """``bucket`` and how many features fall into it; counted in each task before the shuffle."""
    if longest > 1:
        texts = _once(texts.select(F.lit(0).alias("doc_id"), "text"))
        found = features(texts, ["doc_id", "print", "copies"], longest).filter("feature is not null")
        return found.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.sum("copies").alias(name))
    found = features(texts.select("text"), [], 1).filter("feature is not null")
    return found.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias(name))


def _once(docs: DataFrame) -> DataFrame:
    """Equal rows as one, with their number: ``doc_id, print, copies, text``."""
    own = docs.select("doc_id", F.xxhash64("text").alias("print"), "text")
    return own.groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))


def gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10000) -> DataFrame:
    """``bucket, gain`` of every bucket: a thousand times the log ratio of its smoothed shares in target and corpus, floored."""
    own, other = bucket_counts(docs, longest, buckets, "s"), bucket_counts(target, longest, buckets, "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    both = every.unionByName(own, allowMissingColumns=True).unionByName(other, allowMissingColumns=True)
    counts = both.groupBy("bucket").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t"))
    counts = Tables(docs.sparkSession).write(counts, "counts")  # read twice, with the corpus behind it
    totals = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return counts.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.ln(ratio) * 1000).alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, longest: int = 1, buckets: int = 10000) -> DataFrame:
    """``doc_id, n_features, weight, n_words`` of every row of ``docs``.

    Gains meet the words where these are split, and are summed there, so only one row per document is shuffled. Equal
    rows meet in one group, whose sums are parted again among them.
    """
    if longest > 1:
        keyed = _once(docs).withColumn("rows", F.col("copies"))
        found = features(keyed, ["doc_id", "print", "rows"], longest)
    else:
        found = features(docs.select("doc_id", F.xxhash64("text").alias("print"), "text"), ["doc_id", "print"])
    hashed = found.withColumn("bucket", bucket(F.col("feature"), buckets))
    met = hashed.join(F.broadcast(gain) if buckets <= MOST_BUCKETS else gain, "bucket", "left")
    sums = [F.count("feature").alias("n"), F.sum("gain").alias("w"), F.count_if(~F.col("feature").contains(" ")).alias("k")]
    if longest > 1:
        own = met.groupBy("doc_id", "print", "rows").agg(*sums).withColumn("part", F.lit(1).cast("long"))
    else:
        own = met.groupBy("doc_id", "print").agg(*sums, F.count_if(F.coalesce(F.col("idx"), F.lit(0)) == 0).alias("rows")).withColumn("part", F.col("rows"))
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return own.select("doc_id", *[F.expr(e) for e in ("n div part n_features", "coalesce(w, 0) div part weight", "k div part n_words")])


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, longest: int = 1, buckets: int = 10000) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; the drawn ones have a rank from 1.

    The score is the weight and a Gumbel draw from the seed and the id, so the highest scores are a sample without
    replacement by weight. Of the documents with ``least_words`` words or more, ``percent`` in a hundred (floored) are
    drawn; ties go to the smaller id. A null text has no features and weight 0. A row without an id counts among
    the features, has no score and isn't drawn. Repeated rows are documents of their own with one score. Other columns are
    left out, whatever their names; an empty table gives no rows. Scores are ranked over ranges, not in one task.
    """
    own = weights(docs, gains(docs, target, longest, buckets), longest, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.ln(-F.ln((h + 0.5) / 4294967296.0)) * -1000)
    rest = F.coalesce((F.col("n_words") < least_words) | F.col("score").isNull(), F.lit(True))
    tables = Tables(docs.sparkSession)
    scored = tables.write(own.withColumn("score", F.col("weight") + noise).withColumn("rest", rest), "scores")
    drawn = F.expr(f"{percent} * n div 100")
    count = scored.agg(F.count_if(~F.col("rest")).alias("n"))  # one row
    placed = ranked(scored, [], [F.col("rest"), -F.col("score"), F.col("doc_id")], "place").crossJoin(F.broadcast(count))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(~F.col("rest") & (F.col("place") < drawn), F.col("place") + 1).alias("rank"))
