"""Neighbourhood embedding of the vectors of many groups at once: a graph of near vectors, laid out by its slow modes.

Near vectors are looked for in blocks: signs of random projections order the vectors of a group, again and again under
other projections, and each block of that order is compared within itself. Then every vector's neighbours are compared
with each other, as neighbours of one vector tend to be neighbours. No group is gathered: a block and a list of
neighbours are bounded, whatever a group or a place of the order holds. The layout is a power iteration over the edges,
sped up by Chebyshev polynomials, with all groups in the same joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.vectors import normalized
from strandline.operators.series import ranked
from strandline.operators.teams import reduced
from strandline.session import written

#: Signs of projections that order a table, and vectors that are compared with each other.
BITS, BLOCK = 24, 256

#: Start vectors of the layout, rounds, rounds between two tables, and where slow modes begin.
STARTS, ROUNDS, TOGETHER, SLOW = 8, 30, 3, 0.99


def numbered(points: DataFrame) -> DataFrame:
    """``group, n, id, v``: points as unit vectors with a number of their own, written so that numbers stay."""
    unit = F.transform(normalized(F.col("v")), lambda x: F.coalesce(x, F.lit(0.0)))  # a zero vector stays 0
    return written(points.select("group", F.monotonically_increasing_id().alias("n"), "id", unit.alias("v")), "points")


def _codes(tables: int, seed: int):
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        out: list = [None] * len(vectors)
        lengths = vectors.map(len).to_numpy()
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            planes = np.random.default_rng([seed, int(d)]).standard_normal((int(d), tables * BITS))
            signs = (np.stack(vectors.iloc[at].to_list()) @ planes > 0).reshape(len(at), tables, BITS)
            codes = signs @ (1 << np.arange(BITS)[::-1])
            for i, row in zip(at, codes):
                out[i] = row
        return pd.Series(out)

    return F.pandas_udf(run, "array<long>")


_FOUND = "group {kind}, n long, other long, d double"


def _nearest(numbers: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None):
    """Row, column and cosine distance of each vector's ``k`` nearest others, those below ``least`` if it is given."""
    d = 1 - vectors @ vectors.T
    np.fill_diagonal(d, np.inf)
    d[numbers[:, None] == numbers[None]] = np.inf
    k = min(k, len(numbers) - 1)
    if k <= 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    columns = np.argpartition(d, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(numbers)), k)
    columns = columns.ravel()
    value = d[rows, columns]
    good = value < (np.inf if least is None else least[rows])
    return rows[good], columns[good], np.maximum(value[good], 0.0).round(9)


def _within_blocks(k: int):
    def run(block: pa.Table) -> pa.Table:
        numbers = block["n"].to_numpy()
        vectors = np.stack(block["v"].to_pylist()) if len(numbers) else np.zeros((0, 1))
        rows, columns, d = _nearest(numbers, vectors, k)
        group = block["group"].combine_chunks().take(pa.array(rows))
        return pa.table({"group": group, "n": numbers[rows], "other": numbers[columns], "d": d})

    return run


def _within_lists(k: int):
    def run(batches):
        for batch in batches:
            taken, n, other, distance = [], [], [], []
            for i, members in enumerate(batch.column(1).to_pylist()):
                numbers = np.array([m["n"] for m in members])
                rows, columns, d = _nearest(numbers, np.array([m["v"] for m in members]), k, np.array([m["far"] for m in members]))
                taken.append(np.full(len(rows), i))
                n.append(numbers[rows])
                other.append(numbers[columns])
                distance.append(d)
            if taken:
                group = batch.column(0).take(pa.array(np.concatenate(taken)))
                yield pa.RecordBatch.from_arrays([group, *[pa.array(np.concatenate(x)) for x in (n, other, distance)]], names=["group", "n", "other", "d"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """``group, n, near``: each point's ``k`` nearest of what was found, as an array of ``d, other``; from a few lists of ``k``."""
    once = found.groupBy("group", "n", "other").agg(F.min("d").alias("d"))
    lists = once.groupBy("group", "n").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("near"))
    return lists.withColumn("near", F.slice("near", 1, k))


def neighbours(points: DataFrame, k: int = 15, tables: int = 6, refinements: int = 1, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """``group, n, near`` of the points of ``numbered``: about the ``k`` nearest of each within its group, by cosine distance.

    A group of up to ``block`` points is compared as a whole. In larger ones a table finds what its blocks hold, and each
    refinement what neighbours have in common. A point has fewer where its group has fewer others.
    """
    kind = points.schema["group"].dataType.simpleString()
    schema = _FOUND.format(kind=kind)
    sizes = points.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    codes = points.join(sizes, "group").select("group", "n", "v", "size", F.posexplode(_codes(tables, seed)(F.col("v"))).alias("table", "code"))
    codes = codes.filter((F.col("size") > block) | (F.col("table") == 0)).drop("size")
    placed = ranked(codes, ["group", "table"], [F.col("code"), F.col("n")], "place").withColumn("block", F.expr(f"place div {block}"))
    found = placed.select("group", "table", "block", "n", "v").groupBy("group", "table", "block").applyInArrow(_within_blocks(k), schema)
    best = written(_best(found, k), "near")
    for _ in range(refinements):
        far = F.when(F.size("near") < k, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["d"])
        known = points.select("group", "n", "v").join(best.select("group", "n", far.alias("far")), ["group", "n"])
        listed = best.select("group", F.col("n").alias("of"), F.explode(F.concat(F.array("n"), F.transform("near", lambda x: x["other"]))).alias("n"))
        lists = listed.join(known, ["group", "n"]).groupBy("group", "of").agg(F.collect_list(F.struct("n", "v", "far")).alias("members"))
        more = lists.select("group", "members").mapInArrow(_within_lists(k), schema)
        before = best.select("group", "n", F.inline("near")).select("group", "n", "other", "d")
        best = written(_best(before.unionByName(more), k), "near")
    return best


def _start(c: int) -> Column:
    return F.xxhash64("n", F.lit(c)).cast("double") / float(1 << 63)


def layout(points: DataFrame, near: DataFrame, components: int = 3, rounds: int = ROUNDS) -> DataFrame:
    """``group, id, v``: points at places that neighbours share, from the modes of the graph that fade the slowest.

    Edges count in both directions, alike. Start vectors are keyed draws; each round spreads them over the edges, scaled by
    the roots of the degrees, and the polynomial keeps down what fades faster than ``SLOW``. Then the even share of each
    group goes and what is left is turned to its principal components. A group without edges is at one place.
    """
    pairs = near.select("group", "n", F.explode("near").alias("x")).select("group", "n", F.col("x.other").alias("other"))
    edges = pairs.unionByName(pairs.select("group", F.col("other").alias("n"), F.col("n").alias("other"))).distinct()
    degrees = written(edges.groupBy("group", "n").agg(F.sqrt(F.count(F.lit(1))).alias("root")), "degrees")
    ends = degrees.select("group", F.col("n").alias("other"), F.col("root").alias("far_root"))
    edges = written(edges.join(degrees, ["group", "n"]).join(ends, ["group", "other"]).select("group", "n", "other", (1 / (F.col("root") * F.col("far_root"))).alias("w")), "edges")
    ys, ps = [f"y{c}" for c in range(STARTS)], [f"p{c}" for c in range(STARTS)]
    state = written(degrees.select("group", "n", "root", *[_start(c).alias(y) for c, y in enumerate(ys)], *[F.lit(0.0).alias(p) for p in ps]), "modes")
    for at in range(0, rounds, TOGETHER):
        for r in range(at, min(at + TOGETHER, rounds)):
            sent = edges.join(state.select("group", F.col("n").alias("other"), *ys), ["group", "other"])
            came = sent.groupBy("group", "n").agg(*[F.sum(F.col(y) * F.col("w")).alias(f"s_{y}") for y in ys])
            factor = 1.0 if r == 0 else 2.0
            new = [(((1 - SLOW) * F.col(y) + F.col(f"s_{y}")) / SLOW * factor - F.col(p)).alias(y) for y, p in zip(ys, ps)]
            state = state.join(came, ["group", "n"]).select("group", "n", "root", *new, *[F.col(y).alias(p) for y, p in zip(ys, ps)])
        state = written(state, "modes")
    even = state.groupBy("group").agg(F.sum(F.col("root") * F.col("root")).alias("all"), *[F.sum(F.col("root") * F.col(y)).alias(f"e_{y}") for y in ys], *[F.sqrt(F.sum(F.col(y) * F.col(y))).alias(f"z_{y}") for y in ys])
    left = state.join(even, "group")
    value = F.array(*[F.coalesce(F.try_divide(F.col(y) / F.col("root") - F.col(f"e_{y}") / F.col("all"), F.col(f"z_{y}")), F.lit(0.0)) for y in ys])
    spread = points.select("group", "n", "id").join(left.select("group", "n", value.alias("v")), ["group", "n"], "left")
    zeros = F.array(*[F.lit(0.0)] * STARTS)
    return reduced(written(spread.select("group", "id", F.coalesce("v", zeros).alias("v")), "layout"), components)


def embedded(points: DataFrame, components: int = 3, k: int = 15) -> DataFrame:
    """``group, id, v`` of points ``group, id, v``: the neighbourhood embedding of each group. Other columns are left out."""
    own = numbered(points)
    return layout(own, neighbours(own, k), components)
