"""Splitting series at persistent changes of an attribute, with new identifiers for the pieces.

A value is persistent where it is frequent, and no other value more frequent, in the window that begins with
it. Changes between successive persistent values cut the series; a cut may be moved back to a jump of the
box. Windows run on blocks of a series with a margin, so a series of any length is shared between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import SplitConfig
from strandline.operators.series import blocked, unmargined, with_previous
from strandline.session import written

#: Tracks whose fragments one task numbers together.
ID_BLOCK = 4096
TRACK = ["seq", "track_id"]


def _most_frequent(window: Column, value: Column) -> tuple[Column, Column]:
    """How often ``value`` occurs in an array, and the largest number of occurrences of any value."""

    def count(x):
        return F.size(F.filter(window, lambda y: y == x))

    return count(value), F.coalesce(F.array_max(F.transform(F.array_distinct(window), count)), F.lit(0))


def number_persistence(series: DataFrame, config: SplitConfig = SplitConfig(), keys: list[str] = TRACK[1:]) -> DataFrame:
    """``keys, idx, block, jersey`` of rows whose number persists.

    The row's number must be sure (entropy at most ``entropy_threshold``). In mode 'next' the next row's entropy
    decides whether the window's numbers count at all (after the last row nothing does), in mode 'own' each
    row's own. Ties are won by the row's number.
    """
    rows = blocked(series.select(*keys, "idx", "jersey", "entropy"), max(1, config.number_lookahead - 1), config.block)
    w = Window.partitionBy(*keys, "block").orderBy("idx")
    sure = F.col("entropy") <= config.entropy_threshold
    entry = F.col("jersey") if config.entropy_mode == "next" else F.when(sure, F.col("jersey"))
    gate = F.lead("entropy").over(w) <= config.entropy_threshold if config.entropy_mode == "next" else F.lit(True)
    rows = rows.withColumn("window", F.collect_list(entry).over(w.rowsBetween(0, config.number_lookahead - 1))).withColumn("gate", gate)
    own, most = _most_frequent(F.col("window"), F.col("jersey"))
    persistent = F.col("jersey").isNotNull() & sure & F.col("gate") & (own >= config.number_min_persistence) & (own >= most)
    return unmargined(rows.filter(persistent), config.block).select(*keys, "idx", "block", "jersey")


def team_persistence(series: DataFrame, config: SplitConfig = SplitConfig(), keys: list[str] = TRACK[1:]) -> DataFrame:
    """``keys, idx, block, team`` of rows whose team persists; with ``null_is_category`` missing teams are a rival."""
    rows = blocked(series.select(*keys, "idx", "team"), config.team_lookahead - 1, config.block)
    frame = Window.partitionBy(*keys, "block").orderBy("idx").rowsBetween(0, config.team_lookahead - 1)
    rows = rows.withColumn("window", F.collect_list("team").over(frame)).withColumn("rows", F.count(F.lit(1)).over(frame))
    own, most = _most_frequent(F.col("window"), F.col("team"))
    missing = F.col("rows") - F.size("window") if config.null_is_category else F.lit(0)
    persistent = F.col("team").isNotNull() & (own >= config.team_min_persistence) & (own >= most) & (own >= missing)
    return unmargined(rows.filter(persistent), config.block).select(*keys, "idx", "block", "team")


def switches(persistent: DataFrame, value: str, keys: list[str] = TRACK[1:]) -> DataFrame:
    """Rows whose value differs from that of the persistent row before them: ``keys, idx, before, after``."""
    rows = with_previous(persistent, value, keys)
    return rows.filter(F.col("previous") != F.col(value)).select(*keys, "idx", F.col("previous").alias("before"), F.col(value).alias("after"))


def refined_switches(series: DataFrame, found: DataFrame, config: SplitConfig = SplitConfig(), keys: list[str] = TRACK[1:]) -> DataFrame:
    """``keys, idx, refined_idx``: a switch moves to the fastest step in its lookback if that is an earlier outlier.

    The look-back of ``lookback`` rows covers at most two buckets of as many rows, so the range join is an
    equi-join on series and bucket. The point that is followed is the first corner plus half the second one.
    """
    width = config.lookback + 1
    bucket = F.expr(f"idx div {width}")
    points = series.select(*keys, F.col("idx").alias("at"), (F.col("x1") + F.col("x2") / 2).alias("cx"), (F.col("y1") + F.col("y2") / 2).alias("cy"), bucket.alias("bucket"))
    spans = found.select(*keys, "idx", F.explode(F.array_distinct(F.array(bucket, F.expr(f"greatest(idx - {config.lookback}, 0) div {width}")))).alias("bucket"))
    inside = spans.join(points, [*keys, "bucket"]).filter(F.col("at").between(F.col("idx") - config.lookback, F.col("idx")))
    w = Window.partitionBy(*keys, "idx").orderBy("at")
    dx, dy = (F.col(c) - F.lag(c).over(w) for c in ("cx", "cy"))
    steps = inside.withColumn("v", F.sqrt(dx * dx + dy * dy))
    peak = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("v")).alias("neg"), F.col("at").alias("at")))).alias("peak")
    stats = steps.groupBy(*keys, "idx").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), peak)
    fastest = -F.col("peak.neg")
    moved = (F.col("n") >= 4) & (fastest > F.col("mean") + F.col("std") * 2.5) & (fastest > config.min_pixel_jump) & (F.col("peak.at") < F.col("idx"))
    return stats.select(*keys, "idx", F.when(moved, F.col("peak.at")).otherwise(F.col("idx")).alias("refined_idx"))


def lengths(series: DataFrame, keys: list[str] = TRACK[1:]) -> DataFrame:
    """``keys, cut``: where each series ends."""
    return series.groupBy(*keys).agg((F.max("idx") + 1).alias("cut"))


def pieces(ends: DataFrame, cuts: DataFrame, least: int, keys: list[str] = TRACK[1:]) -> DataFrame:
    """``keys, frag_no, start_idx, end_idx`` of series that fall into two pieces or more of at least ``least`` rows, from their ``lengths``.

    ``cuts`` has ``idx`` (order) and ``cut`` (where). Moved cuts aren't sorted again: what they make of negative
    length goes, and pieces may overlap.
    """
    ends = ends.join(cuts.select(*keys).distinct(), keys, "left_semi")
    bounds = (
        cuts.select(*keys, F.col("idx").cast("long").alias("place"), F.col("cut").cast("int"))
        .unionByName(ends.select(*keys, F.lit(-1).cast("long").alias("place"), F.lit(0).alias("cut")))
        .unionByName(ends.select(*keys, F.lit(1 << 62).alias("place"), F.col("cut").cast("int")))
    )
    w = Window.partitionBy(*keys).orderBy("place")
    every = bounds.select(*keys, (F.row_number().over(w) - 1).alias("frag_no"), F.col("cut").alias("start_idx"), (F.lead("cut").over(w) - 1).alias("end_idx"))
    kept = every.filter(F.col("end_idx") - F.col("start_idx") + 1 >= least)
    return kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("n >= 2").drop("n")


def numbered(fragments: DataFrame, order: list[str], base: DataFrame, within: list[str] = [], block: int = ID_BLOCK) -> DataFrame:
    """Fragments with ``new_track_id``: gap-free after the largest id, in the order of ``order``.

    ``base`` has the largest id of each group of ``within``, or of all in one row. The first order column is an integer;
    fragments are numbered inside blocks of it, after the sizes of the blocks before. Only the table of block sizes of a
    group is ordered as a whole.
    """
    rows = fragments.withColumn("_block", F.expr(f"{order[0]} div {block}"))
    sizes = rows.groupBy(*within, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*within, "_block", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*within, "_block").orderBy(*order))
    rows = rows.withColumn("_row", inner).join(sizes, [*within, "_block"])
    rows = rows.join(base, within) if within else rows.crossJoin(F.broadcast(base))
    return rows.withColumn("new_track_id", (F.col("base") + F.col("_before") + F.col("_row")).cast("long")).drop("_block", "_n", "_before", "_row", "base")


def split(series: DataFrame, cuts: DataFrame, least: int, within: list[str] = []) -> DataFrame:
    """Series of the next stage: the pieces under new ids, series without two pieces as they were.

    ``series`` has ``seq`` (an array: its place in the order of series), ``track_id``, ``parent_id`` and ``idx``. New ids
    follow the largest of the same group of ``within`` (columns that don't change in a series), or of all.
    """
    cuts = written(cuts, "cuts")  # a few rows, read three times
    order = ["root", "seq"]
    keys = [*within, *TRACK]
    ends = written(lengths(series, keys), "lengths")  # one row a series, read three times
    parts = pieces(ends, cuts.join(ends.drop("cut"), TRACK) if within else cuts, least, keys)
    parts = written(parts.withColumn("root", F.col("seq")[0]), "pieces")
    largest = F.coalesce(F.max("track_id"), F.lit(0)).alias("base")
    base = ends.groupBy(*within).agg(largest) if within else ends.agg(largest)
    parts = numbered(parts, [*order, "frag_no"], base, within).drop("root", *within)
    columns = [c for c in series.columns if c not in ("seq", "track_id", "idx")]
    rows = series.join(parts, TRACK, "left").filter(F.col("new_track_id").isNull() | F.col("idx").between(F.col("start_idx"), F.col("end_idx")))
    piece = F.coalesce(F.col("frag_no").cast("long"), F.lit(-1).cast("long"))
    return rows.select(F.concat("seq", F.array(piece)).alias("seq"), F.coalesce("new_track_id", "track_id").alias("track_id"), (F.col("idx") - F.coalesce("start_idx", F.lit(0))).cast("int").alias("idx"), *columns)


def as_series(observations: DataFrame, order: str = "track_id") -> DataFrame:
    """Observations as the first stage's series, each its own parent, in the order of ``order``: an integer of its own for each series."""
    return observations.select(F.array(F.col(order).cast("long")).alias("seq"), "track_id", F.col("track_id").alias("parent_id"), *[c for c in observations.columns if c not in ("track_id", "parent_id", order)])


def number_cuts(series: DataFrame, config: SplitConfig = SplitConfig(), keys: list[str] = TRACK) -> DataFrame:
    found = switches(written(number_persistence(series, config, keys), "persistent"), "jersey", keys)
    return refined_switches(series, found, config, keys).withColumnRenamed("refined_idx", "cut")


def team_cuts(series: DataFrame, config: SplitConfig = SplitConfig(), keys: list[str] = TRACK) -> DataFrame:
    return switches(written(team_persistence(series, config, keys), "persistent"), "team", keys).select(*keys, "idx", F.col("idx").alias("cut"))


def split_by_number(series: DataFrame, config: SplitConfig = SplitConfig(), within: list[str] = []) -> DataFrame:
    return split(series, number_cuts(series, config), config.number_min_fragment, within)


def split_by_team(series: DataFrame, config: SplitConfig = SplitConfig(), within: list[str] = []) -> DataFrame:
    return split(series, team_cuts(series, config), config.team_min_fragment, within)


def split_two_stage(observations: DataFrame, config: SplitConfig = SplitConfig(), order: str = "track_id", within: list[str] = []) -> DataFrame:
    """Observations under the ids of the number split and then of the team split.

    An empty table gives no rows. An observation can be in two overlapping pieces; one in a piece that is too
    short is dropped, unless its series isn't split. What a stage reads several times is written once. ``order`` is an
    integer of its own for each series, where ``track_id`` is one only in its group of ``within``; then ids are given by group.
    """
    series = written(as_series(observations, order), "series")
    return split_by_team(written(split_by_number(series, config, within), "series"), config, within)


def split_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """``tracks, tracks_split, tracks_after`` of a split: counts of the parents and of what became of them."""
    own = after.groupBy("parent_id").agg(F.countDistinct("track_id").alias("n"))
    tracks = before.agg(F.countDistinct("track_id").alias("tracks"))
    return own.agg(F.count_if(F.col("n") > 1).alias("tracks_split"), F.coalesce(F.sum("n"), F.lit(0)).alias("tracks_after")).crossJoin(tracks).select("tracks", "tracks_split", "tracks_after")
