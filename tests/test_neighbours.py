"""The neighbour graph against brute force, and clusters that principal components can't part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import neighbours, teams


def table(spark, groups, parts=5):
    rows = [(g, i, [float(x) for x in v]) for g, own in groups.items() for i, v in enumerate(own)]
    return spark.createDataFrame(rows, "group string, id long, v array<double>").repartition(parts)


def test_the_graph_recalls_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (40, 24))
    groups = {"large": centres[rng.integers(0, 40, 2500)] + rng.normal(0, 0.5, (2500, 24)), "small": rng.normal(0, 1, (90, 24)), "two": rng.normal(0, 1, (2, 24)), "one": rng.normal(0, 1, (1, 24)), "copies": np.ones((600, 24))}
    own = neighbours.numbered(table(spark, groups))
    ids = {r["n"]: (r["group"], r["id"]) for r in own.select("n", "group", "id").collect()}
    got = {}
    for r in neighbours.neighbours(own, 10).collect():
        got[ids[r["n"]]] = [(x["d"], ids[x["other"]][1]) for x in r["near"]]
        assert all(ids[x["other"]][0] == r["group"] for x in r["near"]) and ids[r["n"]][1] not in {i for _, i in got[ids[r["n"]]]}
    for g, least in (("large", 0.9), ("small", 1.0), ("two", 1.0)):
        v = groups[g] / np.linalg.norm(groups[g], axis=1)[:, None]
        d = 1 - v @ v.T
        np.fill_diagonal(d, np.inf)
        k = min(10, len(v) - 1)
        hits = [len(set(np.argsort(d[i])[:k]) & {j for _, j in got[g, i]}) / k for i in range(len(v))]
        assert np.mean(hits) >= least, (g, np.mean(hits))
        assert all(np.isclose(dist, d[i, j], atol=1e-6) for i in range(0, len(v), 7) for dist, j in got[g, i])
    assert ("one", 0) not in got and all(len(got["copies", i]) == 10 for i in range(600))


def rings(rng, n=150):
    """Two rings, each through the other, on a sphere's worth of dimensions, so that cosine tells places apart."""
    t = rng.uniform(0, 2 * np.pi, n)
    one = np.stack([np.cos(t), np.sin(t), 0 * t], 1)
    other = np.stack([1 + np.cos(t), 0 * t, np.sin(t)], 1)
    both = np.concatenate([one, other]) + rng.normal(0, 0.02, (2 * n, 3))
    return np.concatenate([both, np.full((2 * n, 1), 1.0)], axis=1), np.repeat([0, 1], n)


def agreement(found, truth):
    same = np.mean(np.asarray(found) == truth)
    return max(same, 1 - same)


def test_interleaved_rings_are_parted(spark):
    rng = np.random.default_rng(6)
    groups, truth = {}, {}
    for g in ("a", "b"):
        groups[g], truth[g] = rings(rng)
    df = table(spark, {g: v - [0.5, 0, 0, 0] for g, v in groups.items()})
    looks = df.select(F.col("group").alias("sequence_id"), F.lit(1).cast("long").alias("track_id"), F.col("id").cast("int").alias("idx"), F.lit("player").alias("role"), F.col("v").alias("embedding"))
    for reduce, least, most in (("neighbours", 0.99, 1.0), ("principal", 0.0, 0.9)):
        got = {(r["sequence_id"], r["idx"]): r["team"] for r in teams.team_clusters(looks, reduce=reduce).collect()}
        for g in groups:
            assert least <= agreement([got[g, i] for i in range(300)], truth[g]) <= most, (reduce, g)
    none = teams.team_clusters(looks.limit(0), reduce="neighbours")
    assert none.count() == 0
    with pytest.raises(ValueError):
        teams.team_clusters(looks, reduce="other")
