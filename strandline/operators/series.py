"""Series of observations: positions, blocks, slices, back-fill and regrouping.

A series may hold a third of all rows, so nothing here needs a whole series in one task: positions come from
counts by block, and windows of bounded reach run on blocks with a margin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import written

BLOCK = 65536


def positions(df: DataFrame, key: str, order: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``idx``, the position of each row in its series (``order``: an integer, unique in a series).

    Rows are numbered inside blocks of ``order`` values; the blocks' sizes are summed up before them.
    """
    df = df.withColumn("_block", F.expr(f"{order} div {block}"))
    sizes = df.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(key, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(key, "_block").orderBy(order))
    numbered = df.withColumn("_row", inner).join(sizes, [key, "_block"])
    return numbered.withColumn("idx", (F.col("_before") + F.col("_row") - 1).cast("int")).drop("_block", "_before", "_n", "_row")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "idx") -> DataFrame:
    """``df`` with ``name``, the position (long, from 0) of each row in its series by any order, strings too.

    Rows are dealt by ranges of key and order, sorted there and written, so that places stay as they are; only the
    counts of a range's series are summed up before it. No series is one task's work. Without ``keys`` the
    table is one series. Rows that are equal in ``order`` take places next to each other; rows with a null key are left out.
    """
    wanted = [F.col(k) for k in keys]
    sortable = df.withColumns({f"_o{i}": c for i, c in enumerate(order)}) if order else df
    by = [*wanted, *[F.col(f"_o{i}") for i in range(len(order))]]
    dealt = sortable.dropna(subset=keys).repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()  # the range's number and the place in it
    dealt = written(dealt.select(*df.columns, at.alias("_at")), "ranges").withColumn("_range", F.shiftright("_at", 33))
    pieces = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(*keys, "_range", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = dealt.join(pieces if keys else F.broadcast(pieces), [*keys, "_range"])  # without keys one row a range
    return placed.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))


def blocked(series: DataFrame, reach: int, block: int) -> DataFrame:
    """Rows with their ``block``, each block followed by the first ``reach`` rows of the next one as a margin."""
    if reach > block:
        raise ValueError("a window reaches beyond the next block")
    own = F.expr(f"idx div {block}").cast("long")
    copies = F.when((F.col("idx") % block < reach) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return series.withColumn("block", F.explode(copies))


def unmargined(df: DataFrame, block: int) -> DataFrame:
    return df.filter(F.expr(f"idx div {block} = block"))


def with_previous(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Rows of ``keys + block, idx`` with ``previous``, the value of the row before in the same series, over block ends."""
    last = df.groupBy(*keys, "block").agg(F.max_by(F.struct(F.col(value).alias("v")), "idx").alias("last"))
    carried = last.select(*keys, "block", F.lag("last").over(Window.partitionBy(*keys).orderBy("block")).alias("carried"))
    inner = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*keys, "block").orderBy("idx"))
    return df.withColumn("inner", inner).join(carried, [*keys, "block"]).withColumn("previous", F.coalesce("inner", "carried")["v"]).drop("inner", "carried")


def collected(observations: DataFrame, columns: list[str], key: str = "track_id") -> DataFrame:
    """Wide form: one row per series with an array of structs in order of ``idx``. For series that fit a row."""
    return observations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", *columns))).alias("series"))


def sliced(observations: DataFrame, start: int, end: int) -> DataFrame:
    """The observations from position ``start`` to ``end``, both included."""
    return observations.filter(F.col("idx").between(start, end))


def sliced_array(series: Column, start: int, end: int) -> Column:
    return F.slice(series, start + 1, end - start + 1)


def back_filled(observations: DataFrame, predictions: DataFrame) -> DataFrame:
    """All positions with the predictions of some: null number, confidence 0 and entropy 1 where there is none."""
    filled = observations.join(predictions, ["track_id", "idx"], "left")
    return filled.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "entropy": F.coalesce("entropy", F.lit(1.0))})


def regrouped(observations: DataFrame, columns: list[str], frame: str = "frame_idx") -> DataFrame:
    """One row per frame with its observations in order of track and position."""
    return observations.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct("track_id", "idx", *columns))).alias("objects"))


def sampled(df: DataFrame, key: str, most: int = 10) -> DataFrame:
    """A systematic sample of each series: every ``n div most``-th position from the first, ``most`` at most."""
    sizes = df.groupBy(key).agg((F.max("idx") + 1).alias("_n"))
    step = F.greatest(F.lit(1), F.expr(f"_n div {most}"))
    out = df.join(sizes, key).withColumn("_step", step.cast("int"))
    return out.filter((F.col("idx") % F.col("_step") == 0) & (F.expr("idx div _step") < most)).drop("_n", "_step")
