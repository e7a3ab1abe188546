"""Teams: two clusters of looks within each sequence, for all sequences at once.

Sequences are groups of rows, never of tasks: every round is one pass over all points and an aggregate by sequence,
start and centre, combined in each task before the shuffle. Between rounds only centres exist, a few rows per
sequence, in tables; nothing is fitted on the driver, and a sequence with a third of all rows is shared between tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.vectors import dot, total
from strandline.session import written

#: Passes that turn a basis towards the principal components, and that move centres.
TURNS, ROUNDS = 4, 20


def _facts(points: DataFrame, facts: DataFrame) -> DataFrame:
    """Points with what is known of their group; the skew rule may split the points of a large one."""
    return points.join(facts, "group")


def _mean(values: Column) -> Column:
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    return Summarizer.mean(array_to_vector(values))


def _array(vector: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(vector)


def _unit_bases(bases: pd.Series) -> pd.Series:
    """The vectors of each basis, each without what the ones before have of it, at length 1; a null vector stays 0."""
    import numpy as np

    def own(basis):
        out: list = []
        for v in map(np.asarray, basis):
            size = np.linalg.norm(v)
            for u in out:
                v = v - (v @ u) * u
            left = np.linalg.norm(v)
            out.append(v / left if left > 1e-9 * max(size, 1e-300) else np.zeros(len(v)))
        return [u.tolist() for u in out]

    return bases.map(own)


def _orthonormal(bases: Column | str) -> Column:
    return F.pandas_udf(_unit_bases, "array<array<double>>")(bases)


def reduced(points: DataFrame, components: int = 3, turns: int = TURNS) -> DataFrame:
    """``group, id, v``: vectors of each group on its own principal components, from the group's mean.

    The basis starts as a keyed draw and is turned by the covariance, once for each pass: what a pass sums up is as
    long as a vector, for each group and component. A group that varies in fewer directions has zeros.
    """
    def drawn(c: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("mean")), lambda i: F.xxhash64(i, F.lit(c)).cast("double") / float(1 << 63))

    def weighed(c: int) -> Column:
        return _array(_mean(F.transform("v", lambda x: x * F.col(f"y{c}"))))

    means = points.groupBy("group").agg(_array(_mean(F.col("v"))).alias("mean"))
    basis = written(means.withColumn("basis", _orthonormal(F.array(*map(drawn, range(components))))), "basis")
    for _ in range(turns):
        from_mean = _facts(points, basis).withColumn("v", F.zip_with("v", "mean", lambda a, b: a - b)).select("group", "v", "basis")
        rows = from_mean.withColumns({f"y{c}": dot(F.col("v"), F.col("basis")[c]) for c in range(components)})
        turned = rows.groupBy("group").agg(F.array(*map(weighed, range(components))).alias("turned"))
        basis = written(turned.join(basis.select("group", "mean"), "group").select("group", "mean", _orthonormal("turned").alias("basis")), "basis")
    out = _facts(points, basis).withColumn("v", F.zip_with("v", "mean", lambda a, b: a - b))
    return out.withColumn("v", F.transform("basis", lambda u: dot(F.col("v"), u))).drop("mean", "basis")


def squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def seeded(points: DataFrame, k: int = 2, starts: int = 10, seed: int = 42) -> DataFrame:
    """``group, start, centres``: the first centres of each group and start, ``id`` being unique in a group.

    The first centre is a keyed draw, each next one a draw with odds by the squared distance from those before:
    the least of -ln(u) over that, u from the hash of seed, start and id. A draw is one aggregate. A group of
    fewer different points than ``k`` has fewer centres.
    """
    def u(*parts: Column) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    every = F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start")
    own = points.select("group", "id", "v", every)
    centres = own.groupBy("group", "start").agg(F.array(F.min_by("v", F.struct(u(F.col("start"), F.col("id")), F.col("id")))).alias("centres"))
    centres = written(centres, "centres")
    for n in range(1, k):
        far = _facts(own, centres.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("start", "centres"))).alias("all")))
        far = far.withColumn("far", F.array_min(F.transform(F.element_at("all", F.col("start")), lambda c: squared(F.col("v"), c)))).filter("far > 0")
        drawn = far.groupBy("group", "start").agg(F.min_by("v", F.struct(-F.ln(u(F.col("start"), F.col("id"), F.lit(n))) / F.col("far"), F.col("id"))).alias("next"))
        more = F.when(F.col("next").isNull(), F.col("centres")).otherwise(F.concat("centres", F.array("next")))
        centres = written(centres.join(drawn, ["group", "start"], "left").select("group", "start", more.alias("centres")), "centres")
    return centres


def nearest(v: Column, centres: Column) -> Column:
    """Struct ``d, c``: the squared distance of the nearest of an array of centres and its place, the first of equals."""
    return F.array_min(F.transform(centres, lambda m, i: F.struct(squared(v, m).alias("d"), i.alias("c"))))


def moved(points: DataFrame, centres: DataFrame) -> DataFrame:
    """One round for all groups and starts: ``group, start, centres, cost, shift``.

    A centre goes to the mean of the points that are nearest to it, or stays without any. ``cost`` is the sum of
    squared distances from the centres before, ``shift`` the largest square of a step.
    """
    packed = centres.groupBy("group").agg(F.collect_list(F.struct("start", "centres")).alias("all"))  # starts of a group: a few
    rows = _facts(points, packed).select("group", "v", F.explode("all").alias("s")).select("group", "v", "s.start", nearest(F.col("v"), F.col("s.centres")).alias("n"))
    sums = rows.groupBy("group", "start", F.col("n.c").alias("c")).agg(_array(_mean(F.col("v"))).alias("m"), F.sum("n.d").alias("d"))
    own = sums.groupBy("group", "start").agg(F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("means"), F.sum("d").alias("cost"))
    after = F.transform("centres", lambda m, i: F.coalesce(F.element_at("means", i), m))
    steps = F.array_max(F.zip_with("centres", "after", squared))
    return centres.select("group", "start", "centres").join(own, ["group", "start"]).withColumn("after", after).select("group", "start", F.col("after").alias("centres"), "cost", steps.alias("shift"))


def grouped_means(points: DataFrame, centres: DataFrame, rounds: int = ROUNDS, least: float = 1e-8) -> DataFrame:
    """``group, start, centres, cost`` after ``rounds`` rounds from given centres, or when no centre moves more.

    ``cost`` is that of the returned centres. Groups are independent of each other but share the rounds.
    """
    for _ in range(rounds):
        centres = written(moved(points, centres), "centres")
        if not centres.filter(F.col("shift") > least).limit(1).count():
            break
    return centres.select("group", "start", "centres").join(moved(points, centres).select("group", "start", "cost"), ["group", "start"])


def team_clusters(series: DataFrame, components: int = 3, teams: int = 2, starts: int = 10, seed: int = 42, reduce: str = "principal") -> DataFrame:
    """``sequence_id, track_id, idx, team``: k-means on reduced embeddings of each sequence, fitted on players, given to players.

    All rows of a sequence are reduced together: to ``principal`` components, or by their ``neighbours`` (see there; dearer,
    for looks that aren't blobs). Of ``starts`` fits the one of least cost is kept. With fewer than two players in a sequence they are team 0; other roles have no team, nor has a row
    without an embedding. An empty table gives no rows. ``track_id, idx`` must be unique in a sequence.
    """
    from strandline.operators.neighbours import embedded

    if reduce not in ("principal", "neighbours"):
        raise ValueError(f"there is no reduction {reduce}")
    players = F.col("role") == "player"
    keys = ["sequence_id", "track_id", "idx"]
    base = series.filter("embedding is not null").select(F.col("sequence_id").alias("group"), F.struct("track_id", "idx").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "role")
    base = written(base, "looks")
    flat = (reduced if reduce == "principal" else embedded)(base.select("group", "id", "v"), components)
    own = written(flat.join(base.filter(players).select("group", "id"), ["group", "id"], "left_semi"), "reduced")
    fitted = written(grouped_means(own, seeded(own, teams, starts, seed)), "teams")
    best = fitted.groupBy("group").agg(F.min_by("centres", F.struct("cost", "start")).alias("centres"))
    found = _facts(own, best).select(F.col("group").alias("sequence_id"), "id.track_id", "id.idx", nearest(F.col("v"), F.col("centres"))["c"].alias("team"))
    return series.select(*keys).join(found, keys, "left")


def teams_from(series: DataFrame, centres: DataFrame, rounds: int) -> DataFrame:
    """``sequence_id, track_id, idx, team`` of players after so many rounds from given ``sequence_id, centres``."""
    own = series.filter(F.col("role") == "player").select(F.col("sequence_id").alias("group"), F.struct("track_id", "idx").alias("id"), F.col("embedding").alias("v"))
    given = centres.select(F.col("sequence_id").alias("group"), F.lit(0).alias("start"), "centres")
    best = grouped_means(own, given, rounds, -1.0).select("group", "centres")
    return _facts(own, best).select(F.col("group").alias("sequence_id"), "id.track_id", "id.idx", nearest(F.col("v"), F.col("centres"))["c"].alias("team"))
