"""URL filter: literal rules first, then exact membership of a list by a cascade of Bloom filters.

The cascade's first level encodes the listed keys, the second those other keys of the universe that pass the
first, the third the listed keys that pass the second, and so on until nothing passes wrongly. Over that universe,
here every key of the corpus, the answer is exact, and judging a page needs the levels' words alone: no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.store import Tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A list may name a host itself, or a domain of so many labels at most, with all its subdomains.
LABELS = 5

#: Wrong passes of the levels behind the first: one key in so many.
RATE = 64

#: 64-bit words of one level at most (64 MB, held once by each executor). A longer list is joined instead.
MOST_WORDS = 1 << 23


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, in small letters A to Z, and the path; both empty without ``://`` or url."""
    rest = F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + 3)).otherwise("")

    def until(text: Column, ends: str) -> Column:
        for end in ends:
            text = F.substring_index(text, end, 1)
        return text

    host = until(rest, "/?#")
    path = until(F.substr(rest, F.length(host) + 1), "?#")
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` that fits, and its verdict; null if none fits.

    A rule is ``(verdict, "host/path")``. It fits its host and all subdomains if the path starts with the rule's.
    Of two rules of one length that with the longer host wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"))):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def domains(host: Column) -> list[Column]:
    """A host, and the domains of its last 1 to ``LABELS`` labels; these are the host again if it has fewer."""
    return [host, *[F.substring_index(host, ".", -n) for n in range(1, LABELS + 1)]]


def keys(host: Column, path: Column) -> list[Column]:
    """What a list may name of a page: its host, the domains above it, and the host with the whole path."""
    return [*domains(host), F.concat(host, path)]


@dataclass(frozen=True)
class Level:
    """A Bloom filter as one row, an array of 64-bit words. A key sets three bits in each of its ``probes`` words."""

    size: int
    probes: int
    words: DataFrame

    @staticmethod
    def planned(n: int, rate: float) -> tuple[int, int]:
        """Words and probes for ``n`` keys, so that about one of ``rate`` others passes."""
        probes = max(1, math.ceil(math.log2(rate) / 3))
        return max(1, math.ceil(n * probes * 3 / math.log(2) / 64)), probes

    def holds(self, key: Column, number: int) -> Column:
        words = self.words.select("words").scalar()
        return reduce(and_, [F.get(words, at).bitwiseAND(mask) == mask for at, mask in _probes(key, number, self.size, self.probes)])


def _probes(key: Column, number: int, size: int, probes: int) -> list[tuple[Column, Column]]:
    """The words of a key in level ``number``, each with a mask of three bits; all from hashes of the key."""
    out = []
    for k in range(probes):
        h = F.xxhash64(key, F.lit(number), F.lit(k))
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, s).bitwiseAND(F.lit(63)).cast("int")) for s in (0, 6, 12)]
        out.append((F.pmod(F.shiftright(h, 18), F.lit(size)).cast("int"), reduce(lambda a, b: a.bitwiseOR(b), bits)))
    return out


@dataclass(frozen=True)
class Cascade:
    """Levels of filters; ``listed`` is exact for every key of the universe that they were built over."""

    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        known = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            inside = self.levels[k - 1].holds(key, k)
            known = inside & known if k % 2 else ~inside | known
        return known


def _level(tables: Tables, encoded: DataFrame, number: int, size: int, probes: int) -> Level:
    """Keys as a dense array of words: masks are united by word, then laid out in order, ``size`` in all."""
    places = F.array(*[F.struct(at.alias("w"), mask.alias("b")) for at, mask in _probes(F.col("key"), number, size, probes)])
    set_bits = encoded.select(F.inline(places)).groupBy("w").agg(F.bit_or("b").alias("b"))
    empty = encoded.sparkSession.range(size).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    words = set_bits.unionByName(empty).groupBy("w").agg(F.bit_or("b").alias("b"))
    row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda s: s["b"]).alias("words"))
    return Level(size, probes, tables.write(row, f"level{number}"))


def cascade(universe: DataFrame, listed: DataFrame, most_words: int = MOST_WORDS) -> Cascade | None:
    """A cascade of the ``listed`` keys over all keys of ``universe`` (columns ``key``); None if a level needs more than ``most_words``.

    Null keys are left out, repeated ones count once, listed keys outside of the universe aren't encoded. An empty
    list or universe gives a cascade without levels, which lists nothing. The first level lets so few others pass
    that the second is no larger; each level behind it takes one in ``RATE`` of what is left, so a few levels end it.
    """
    tables = Tables(universe.sparkSession)
    both = universe.select("key", F.lit(True).alias("here"), F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(False).alias("here"), F.lit(True).alias("listed")))
    known = tables.write(both.dropna(subset=["key"]).groupBy("key").agg(F.max("here").alias("here"), F.max("listed").alias("listed")).filter("here").drop("here"), "universe")
    counts = {r["listed"]: r["n"] for r in known.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    encoded, others = known.filter("listed"), known.filter("not listed")
    n = counts.get(True, 0)
    rate = max(2.0, counts.get(False, 0) / max(1, n))
    levels: list[Level] = []
    while n:
        number = len(levels) + 1
        size, probes = Level.planned(n, rate)
        if size > most_words:
            return None
        level = _level(tables, encoded, number, size, probes)
        levels.append(level)
        passed = tables.write(others.filter(level.holds(F.col("key"), number)).select("key"), f"passed{number}")
        encoded, others, n, rate = passed, encoded, passed.count(), RATE
    return Cascade(tuple(levels))


def judged(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page: the longest rule's verdict, else ``block`` if a key is listed.

    ``listed`` has keys as of ``keys``. A null url, or one without ``://``, has an empty host and path, no rule and is
    allowed. Repeated rows are judged alike, a null ``page_id`` stays null, other columns are left out, an empty table gives
    no rows. A url of any length is one row's work. If the list is too long for the filters, the distinct hosts and
    paths are joined with it instead; answers are the same.
    """
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    cut = cut.withColumns({"rule": rule, "says": says})
    own = keys(F.col("host"), F.col("path"))
    named = cut.filter("host <> ''").withColumn("key", F.explode(F.array(*own)))
    built = cascade(named, listed, most_words)
    if built is not None:
        blocked = (F.col("host") != "") & reduce(or_, [built.listed(k) for k in own])
        return cut.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(blocked, "block").otherwise("allow")).alias("verdict"))
    hits = named.select("host", "path", "key").distinct().join(listed.select("key"), "key", "left_semi").select("host", "path", F.lit("block").alias("hit")).distinct()
    return cut.join(hits, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("says", "hit", F.lit("allow")).alias("verdict"))


def named_hosts(pages: DataFrame, words: list[str]) -> DataFrame:
    """Keys of a list by name: the hosts and domains of the pages whose first label, parted at hyphens, has one of ``words``."""
    host, _ = host_and_path(F.col("url"))
    own = pages.select(host.alias("host")).distinct().select(F.explode(F.array(*domains(F.col("host")))).alias("key")).distinct()
    label = F.split(F.substring_index("key", ".", 1), "-")
    return own.filter(F.arrays_overlap(label, F.array(*[F.lit(w) for w in words])))
