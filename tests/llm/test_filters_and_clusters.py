import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import queries, resample, sort_means, url_filter

SF = "/root/testdata/sf0.001"


def plain_verdict(url, rules, listed):
    """The rules and the list, one url at a time."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for says, text in rules:
        own, start = text.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(text) > len(best[1])):
            best = says, text
    labels = host.split(".")
    known = {host, host + path, *(".".join(labels[-n:]) for n in range(1, 6))} if host else set()
    return host, path, best and best[1], best[0] if best else "block" if known & listed else "allow"


URLS = [
    None, "", "no scheme", "http://", "https:///x", "http://net/", "http://a.net", "http://a.net?q=/", "HTTP://WWW.Example.NET/en/1", "http://xexample.net/en/", "http://example.net/EN/",
    "http://example.com/de/x?y#z", "http://m.example.com/de", "ftp://a.org/fr/1", "http://a.org/de/1", "http://bad.example.com", "http://x.bad.example.com/p", "http://notbad.example.com/",
    "http://ok.com/one/page?x=1", "http://ok.com/one/page/", "http://İ.com/ünder#x", "a://b://c/d", "http://a.b.c.d.e.f.g/h", "http://x.a.b.c.d.e.f.g/h", "http://" + "l." * 5000 + "bad.example.com/" + "p" * 70000,
]
LIST = {"bad.example.com", "ok.com/one/page", "a.b.c.d.e.f.g", "absent.com"}


@pytest.mark.parametrize("most_words", [url_filter.MOST_WORDS, 0])
def test_urls_are_judged_as_one_by_one(spark, most_words):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(3, "http://bad.example.com", "x", "y"), (None, "http://bad.example.com", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    listed = spark.createDataFrame([(k,) for k in [*LIST, None, "bad.example.com"]], "key string")
    got = url_filter.judged(pages, queries.RULES, listed, most_words).collect()
    want = [(i, *plain_verdict(u, queries.RULES, LIST)) for i, u, *_ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_pages_and_lists(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    assert [r["verdict"] for r in url_filter.judged(pages, [], none).collect()] == ["allow"]
    assert url_filter.judged(pages.limit(0), queries.RULES, none).count() == 0


def test_the_cascade_is_exact_over_its_universe(spark):
    """Several levels, each over what the one before let pass wrongly; answers equal the list for every key."""
    universe = spark.range(60000).select(F.concat(F.lit("k"), "id").alias("key"))
    wanted = F.crc32("key") % 11 == 3
    built = url_filter.cascade(universe.unionByName(universe.limit(100)), universe.filter(wanted))
    assert len(built.levels) > 2 and sum(level.size for level in built.levels) * 64 < 16 * 60000
    assert universe.filter(built.listed(F.col("key")) != wanted).count() == 0
    plan = universe.filter(built.listed(F.col("key")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Exchange" not in plan


def test_judging_is_native(spark):
    plan = queries.QUERIES["op11_url_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Exchange" not in plan and "ReadSchema: struct<page_id:bigint,url:string>" in plan


def plain_resampled(docs, target, percent=10, least=20, longest=1, buckets=10000):
    def features(text):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for k, text in docs:
        w, f = features(text)
        weight = sum(gain[bucket(x)] for x in f)
        score = None
        if k is not None:
            h = int(hashlib.sha256(f"2024:{k}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([k, len(f), weight, score, None, len(w) >= least and k is not None])
    order = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0]))
    for n, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = n + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_a_plain_version(spark, longest):
    rng = random.Random(longest)
    vocabulary = ["Ape", "bee", "cät", "dog9", "İx", "日本", "elk", "fox", "gnu", "hen"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, " .,;\n"), (None, "bee " * 30), (503, "x" * 100000 + " ape" * 200000), *docs[:5], (7, "another text of this id " * 9), docs[0]]
    target = ["ape bee ape gnu", None, "hen hen, HEN", "zebra"]
    table = spark.createDataFrame([(k, t, 1, "w") for k, t in docs], "doc_id long, text string, bucket int, word string")
    out = resample.resampled(table, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest)
    got, want = sorted(map(tuple, out.collect()), key=repr), plain_resampled(docs, target, longest=longest)
    assert got == sorted(want, key=repr)
    assert sum(r[4] is not None for r in got) > 5
    assert resample.resampled(table.limit(0), spark.createDataFrame([], "text string"), longest=longest).count() == 0


def test_features_over_block_ends(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {(r["idx"], r["feature"]) for r in resample.features(docs, ["doc_id"], 3, block=7).collect()}
    w = text.split()
    assert got == {(i, " ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(50 - n + 1)}


def plain_means(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for n in range(len(centroids)):
            members = [v for (_, v), (_, c) in zip(kept, own) if c == n]
            if members:
                centroids[n] = [sum(x) // len(members) for x in zip(*members)]
    own = assign()
    inertia = [sum(d for d, c in own if c == n) for n in range(len(centroids))]
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia), prints[c]) for (i, _), (d, c) in zip(kept, own)]


def test_sort_means_equals_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(64)]) for i in range(300)]
    rows += [(900 + i, [float(i % 2)] * 64) for i in range(20)]  # ties and copies
    rows += [(950, None), (951, [0.0] * 63), (952, [None] + [0.0] * 63), (953, [math.nan] * 64), (954, [math.inf] + [0.0] * 63), (None, [1.0] * 64), rows[0], rows[0]]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(5)
    got = sort_means.sort_means(table).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_means(rows), key=repr)
    few = sort_means.sort_means(table.filter("vec_id < 3")).collect()
    assert sorted(map(tuple, few), key=repr) == sorted(plain_means([r for r in rows if r[0] is not None and r[0] < 3]), key=repr)
    assert sort_means.sort_means(table.limit(0)).count() == 0 and sort_means.sort_means(table.filter("vec_id is null")).count() == 0


def test_components_up_to_the_largest_are_exact(spark):
    """Vectors at both ends of the range, where squares are largest; beyond it a vector isn't kept."""
    end = float(sort_means.LARGEST // 64)
    rows = [(i, [end if (i >> (k % 5)) & 1 else -end for k in range(64)]) for i in range(40)] + [(99, [end * 2] + [0.0] * 63), (98, [1e300] * 64)]
    got = sort_means.sort_means(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(plain_means(rows[:40]))


def test_sorted_scan_finds_the_nearest_with_ties():
    rng = np.random.default_rng(5)
    centroids, vectors = rng.integers(-3, 4, (12, 3)), rng.integers(-4, 5, (4000, 3))
    best, least = sort_means.nearest(vectors, rng.integers(0, 12, 4000), centroids)
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_resample", "op13_sort_means"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    r = con.execute(queries.ORACLE[name])
    names = [x[0] for x in r.description]
    want = sorted((tuple(row[names.index(c)] for c in df.columns) for row in r.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want
