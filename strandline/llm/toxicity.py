"""Toxicity scores of texts restored from obfuscation by a noisy-channel Viterbi decoder.

Channel: an observed token is a lattice of what its characters may stand for. A letter stands for itself;
a digit or symbol of ``LEET`` for one of its letters or for nothing; any other symbol between letters for
nothing; a letter written three times or more for one or two of it; the gap between single spaced-out
characters for nothing or a space. The decoder takes the path with the best sum of channel costs and of a
character trigram model. A token with one reading, nearly all of them, needs no search.

Scoring: restored words are matched against stems (whole words and prefixes) whose document frequency in
toxic training rows lies above that in clean ones by more than chance; near copies of one label count once. A logistic
regression over a document's strongest stems gives the score. Word, trigram and stem counts, the choice among copies
and every Newton step of the regression are Spark aggregates over all labelled rows; only the model comes to the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.near_dup import near_duplicates
from strandline.llm.shingles import buffers, slices
from strandline.llm.store import crc_mod, few, store

THRESHOLD = 0.3
REMEMBERED = 500_000
#: A word is known, and a stem may count, from one in so many labelled (toxic) documents on: what a model holds has a bound.
RARE = 2000
#: Distinct keys that a task counts before it passes them on.
COUNTED = 200_000
#: Bytes of text whose distinct tokens are looked at together; a longer text stands alone.
SLICE_BYTES = 8 << 20
#: Least weight of a stem in a score, and how sure its frequency has to be (normal quantile).
STRONG, SURE = 0.8, 1.64
#: Smallest shingle hashes by which ``families`` looks for copies.
SKETCH = 16

#: Letters that a digit or symbol may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e", "*": "aeiou", "#": "aeiou"}
SUBSTITUTED, DROPPED, REPEATED, JOINED, PARTED = 1.0, 9.0, 0.5, 0.3, 1.5

_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")
_RUN = re.compile(r"(.)\1{2,}", re.DOTALL)
#: Punctuation cut from a token's start and end; before a word some of it may stand for a letter.
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’–—…¿¡€"
_OPENING = "".join(c for c in _PUNCTUATION if c not in "@$€*")
#: What no letter is written with: cut from the edges even where symbols may be letters.
_UNMAPPED = "".join(c for c in _PUNCTUATION if c not in LEET)
#: The commonest of them behind a word.
_ENDS = ".,;:?"


class CharModel:
    """Trigram model of lower-case words between ``^`` marks, with additive smoothing."""

    def __init__(self, words: Counter, known: frozenset[str] = frozenset()):
        three = Counter()
        for word, n in words.items():
            padded = f"^^{word}^"
            for i in range(len(padded) - 2):
                three[padded[i : i + 3]] += n
        self._set(three, known)

    @classmethod
    def from_trigrams(cls, three: dict[str, int], known: frozenset[str]) -> CharModel:
        """The model of the words whose padded trigrams were counted."""
        model = cls.__new__(cls)
        model._set(three, known)
        return model

    def _set(self, three, known):
        self.known = known
        two = Counter()
        for k, n in three.items():
            two[k[:2]] += n
        size = len({k[2] for k in three} - {"^"}) + 1
        self.two = {k: math.log(n + 0.1 * size) for k, n in two.items()}
        self.three = {k: math.log(n + 0.1) for k, n in three.items()}
        self.none, self.unseen = math.log(0.1 * size) if size else 0.0, math.log(0.1)

    def cost(self, a: str, b: str, c: str) -> float:
        return self.two.get(a + b, self.none) - self.three.get(a + b + c, self.unseen)


def lattice(token: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """For each position the readings and their channel costs."""
    steps: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        run = 1
        while i + run < len(token) and token[i + run] == c:
            run += 1
        if c.isspace():
            steps.append([("", JOINED), (" ", PARTED)])
            i += run
        elif c.isalpha():
            if run > 2:
                steps.append([(c, REPEATED), (c + c, REPEATED)])
            else:
                steps += [[(c, 0.0)]] * run
            i += run
        else:
            options = [("", DROPPED if c in LEET and run == 1 else 0.0)]
            steps.append(options + [(x, SUBSTITUTED) for x in LEET.get(c, "")])
            if run > 1 and c in LEET:
                steps.append([("", 0.0)] + [(x, SUBSTITUTED) for x in LEET[c]])
            i += run
    return steps


def decode(token: str, model: CharModel, spaced: bool = False) -> list[str]:
    """The restored words of one obfuscated token or spaced-out run."""
    return reading(token, model, spaced)[1]


def reading(token: str, model: CharModel, spaced: bool = False) -> tuple[float, list[str]]:
    """The cost and the words of the best path."""
    two, three, none, unseen = model.two.get, model.three.get, model.none, model.unseen
    paths: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", "^"): (0.0, None)}
    for options in lattice(token, spaced):
        new: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (total, back) in paths.items():
            for text, price in options:
                x, y, cost = a, b, total + price
                for c in text:
                    if c == " ":
                        cost += model.cost(x, y, "^") if y != "^" else 0.0
                        x = y = "^"
                    else:
                        cost += two(x + y, none) - three(x + y + c, unseen)
                        x, y = y, c
                key = x, y
                if key not in new or cost < new[key][0]:
                    new[key] = (cost, (back, text) if text else back)
        paths = new
    price, _, best = min(((cost + (model.cost(a, b, "^") if b != "^" else 0.0), k, back) for k, ((a, b), (cost, back)) in enumerate(paths.items())), default=(0.0, 0, None))
    parts = []
    while best:
        best, text = best
        parts.append(text)
    return price, "".join(reversed(parts)).split()


def bare(token: str) -> str:
    return token.lstrip(_OPENING).rstrip(_PUNCTUATION)


def plain(token: str) -> str | None:
    """The word of a token with one reading; None if it needs the decoder."""
    word = token.lower()
    if not word.isalpha():
        word = bare(word)
    if word.isalpha():
        return None if _RUN.search(word) else word
    if not any(c.isalpha() for c in word):
        return ""
    return None


def edged(token: str, core: str) -> list[str]:
    """The forms of a token that keep the symbols cut from its start, its end or both as letters."""
    wide = token.strip(_UNMAPPED)
    at = wide.find(core)
    head, tail = wide[:at], wide[at + len(core) :]
    return [h + core + t for h, t in ((head, ""), ("", tail), (head, tail)) if h or t]


def restore(token: str, model: CharModel) -> list[str]:
    """The words of a token; symbols at its edges are letters where only that makes a known word."""
    if token.isalpha() and not _RUN.search(token.lower()):
        return [token.lower()]
    word, core = plain(token), bare(token.lower())
    if word is None:
        words = decode(core, model)
    else:
        words = [word] if word else []
    if words and not all(len(w) > 1 and w in model.known for w in words):
        found = [reading(form, model) for form in edged(token.lower(), core)]
        found = [r for r in found if r[1] and model.known.issuperset(r[1])]
        words = min(found)[1] if found else words
    return words


def spaced_runs(text: str, model: CharModel) -> list[str]:
    """Words restored from runs of three or more single characters."""
    if list(map(len, text.split())).count(1) < 3:
        return []
    return [w for m in _SPACED.finditer(text) for w in decode(m.group().lower(), model, spaced=True)]


def stems(word: str) -> list[str]:
    """What a word is matched by: itself and its prefixes of 4 to 8 letters."""
    return ["=" + word, *(word[:k] for k in range(4, min(len(word), 8) + 1))] if len(word) > 2 else []


def shingle_hashes(text: str) -> frozenset[int]:
    """Hashes of a text's runs of five words; of its words together if it has fewer."""
    w = text.lower().split()
    return frozenset(zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))) if w else frozenset()


def families(rows: list[tuple[int, frozenset[int]]]) -> list[int]:
    """The rows that stay of (label, shingle hashes) when copies go: each that is no near copy of an earlier one that stays.

    A near copy has the same label and three quarters of both rows' shingles, by an exact count on all of them. Candidates
    share one of the ``SKETCH`` smallest hashes. Rows without words are copies of each other. A plain version for few
    rows, which tests compare with; a table's copies are found by ``without_copies``.
    """
    held: dict[tuple[int, int], list[int]] = {}
    empty: set[int] = set()
    stay = []
    for i, (label, own) in enumerate(rows):
        if not own:
            if label not in empty:
                empty.add(label)
                stay.append(i)
            continue
        keys = [(label, h) for h in sorted(own)[:SKETCH]]
        near = {j for k in keys for j in held.get(k, ())}
        if any(4 * len(own & rows[j][1]) >= 3 * len(own | rows[j][1]) for j in near):
            continue
        stay.append(i)
        for k in keys:
            held.setdefault(k, []).append(i)
    return stay


def by_token(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """``(first row, distinct tokens, the token at each place, where rows begin (n + 1))`` for slices of a text column (null: empty).

    Tokens are parted as ``str.split`` does; white space at a text's edge gives an empty one there.
    """
    column = column.cast(pa.large_string()).fill_null("")
    for first, last in slices(buffers(column)[1], SLICE_BYTES):
        lists = pc.utf8_split_whitespace(column.slice(first, last - first))
        coded = lists.flatten().cast(pa.string()).dictionary_encode()
        yield first, coded.dictionary, coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])


def ordinary(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which tokens are ASCII letters, none three times running, and maybe ``_ENDS`` behind them; and the tokens without these in small letters.

    That is then the token's word, for ``plain`` as for ``restore``.
    """
    low = pc.ascii_lower(pc.ascii_rtrim(tokens, _ENDS))
    raw, offsets = buffers(low)
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    thrice = np.flatnonzero((raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:]))
    own = pc.ascii_is_alpha(low).to_numpy(zero_copy_only=False).copy()
    own[np.searchsorted(offsets, thrice, side="right") - 1] = False
    return own, low


def heads(stems) -> set[str]:
    """The first four letters of stems; most words fail already at them."""
    return {s.lstrip("=")[:4] for s in stems}


def candidates(tokens: pa.Array, begin: set[str]) -> np.ndarray:
    """The tokens that may have a stem with a head of ``begin``: all but ordinary ones whose word begins otherwise."""
    own, low = ordinary(tokens)
    return np.flatnonzero(~own | pc.is_in(pc.utf8_slice_codeunits(low, 0, 4), value_set=pa.array(sorted(begin), pa.string())).to_numpy(zero_copy_only=False))


def once(some: np.ndarray, index: np.ndarray, edges: np.ndarray) -> tuple[list[int], list[int]]:
    """The rows and the tokens of all places whose token is one of ``some`` (a mask), each token once a row."""
    place = np.flatnonzero(some[index])
    pairs = np.unique((np.searchsorted(edges, place, side="right") - 1) * len(some) + index[place])
    return (pairs // max(1, len(some))).tolist(), (pairs % max(1, len(some))).tolist()


def spaced_rows(tokens: pa.Array, index: np.ndarray, edges: np.ndarray) -> list[int]:
    """The rows with three tokens of one character running, without which ``spaced_runs`` finds nothing."""
    one = pc.equal(pc.utf8_length(tokens), 1).to_numpy(zero_copy_only=False)[index]
    place = np.flatnonzero(one[:-2] & one[1:-1] & one[2:])
    row = np.searchsorted(edges, place, side="right") - 1
    return np.unique(row[place + 2 < edges[row + 1]]).tolist()


class Scorer:
    """Stem weights and a logistic regression over a document's strongest stems."""

    def __init__(self, lm: CharModel, weights: dict[str, float], coefficients: np.ndarray):
        self.lm, self.weights, self.coefficients = lm, weights, coefficients
        self.heads = heads(weights)
        self.known: dict[str, float] = {}

    @staticmethod
    def _best(word: str, weights: dict[str, float]) -> float:
        return max((weights.get(s, 0.0) for s in stems(word)), default=0.0)

    @staticmethod
    def _features(values: list[float]) -> list[float]:
        top = sorted((v for v in values if v > STRONG), reverse=True)
        return [1.0, top[0] if top else 0.0, top[1] if len(top) > 1 else 0.0, math.log1p(len(top))]

    def word(self, word: str) -> float:
        return self._best(word, self.weights) if word[:4] in self.heads else 0.0

    def token(self, token: str) -> float:
        value = max(map(self.word, restore(token, self.lm)), default=0.0)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[token] = value
        return value

    def rows(self, column: pa.Array) -> Iterator[list[float]]:
        """What the regression sees of each text: 1, the two strongest stems' weights, and how many are strong."""
        none = self._features([])
        for first, tokens, index, edges in by_token(column):
            at = candidates(tokens, self.heads)
            values = np.zeros(len(tokens))
            get = self.known.get
            for k, token in zip(at.tolist(), tokens.take(pa.array(at)).to_pylist()):
                value = get(token)
                values[k] = self.token(token) if value is None else value
            own: dict[int, list[float]] = {}
            for row, k in zip(*once(values > STRONG, index, edges)):
                own.setdefault(row, []).append(float(values[k]))
            for row in spaced_rows(tokens, index, edges):
                own.setdefault(row, []).extend(map(self.word, spaced_runs(column[first + row].as_py(), self.lm)))
            for row in range(len(edges) - 1):
                yield self._features(own[row]) if row in own else none

    def features(self, text: str) -> list[float]:
        return next(self.rows(pa.array([text])))

    def chance(self, features: list[float]) -> float:
        z = float(np.dot(self.coefficients, features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str) -> float:
        return self.chance(self.features(text))

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def _counted(keys_of, schema: pa.Schema):
    """Tasks that count the keys ``keys_of`` gives for the rows of a batch, and pass counts on before they hold too many."""

    def run(batches):
        counts: Counter = Counter()

        def passed():
            columns = [*zip(*counts), list(counts.values())]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for keys in keys_of(batch):
                counts.update(keys)
                if len(counts) >= COUNTED:
                    yield passed()
                    counts.clear()
        if counts:
            yield passed()

    return run


def _words(batches):
    """The plain words of texts, each with whether it stands there without a symbol at its edges, and in how many texts of a slice."""
    for batch in batches:
        halves = batch.column(1).to_numpy().astype(np.int64)
        for first, tokens, index, edges in by_token(batch.column(0)):
            own, low = ordinary(tokens)
            other = np.flatnonzero(~own)
            odd = tokens.take(pa.array(other)).to_pylist()
            cut = pa.array([t.lower().strip(_UNMAPPED) for t in odd], pa.string())
            coded = pa.concat_arrays([low.take(pa.array(np.flatnonzero(own))), pa.array([plain(t) or "" for t in odd], pa.string()), cut]).dictionary_encode()
            words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            word, solid = np.empty(len(tokens), np.int64), np.empty(len(tokens), np.int64)
            n_own = len(tokens) - len(other)
            word[own] = solid[own] = ids[:n_own]
            word[other], solid[other] = np.split(ids[n_own:], 2)
            row = np.repeat(np.arange(len(edges) - 1), np.diff(edges)) * len(words)
            have = np.unique(row + word[index])
            # A word stands whole in a row if it is what is left of any token there; of ordinary tokens it always is.
            whole = np.isin(have, np.unique(row + solid[index]), assume_unique=True)
            keys, n = np.unique((have % max(1, len(words)) * 2 + whole) * 2 + halves[first + have // max(1, len(words))], return_counts=True)
            out = pa.RecordBatch.from_arrays([words.take(pa.array(keys >> 2)), pa.array(keys >> 1 & 1).cast(pa.bool_()), pa.array(keys & 1, pa.int32()), pa.array(n, pa.int64())], names=["word", "whole", "half", "n"])
            yield out.filter(pc.not_equal(out.column(0), ""))


def by_half(counts: DataFrame, *keys: str) -> DataFrame:
    """``keys, n0, n1``: the counts of rows with ``half`` 0 and 1."""
    return counts.groupBy(*keys).agg(*[F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)])


def without_copies(rows: DataFrame) -> DataFrame:
    """Of near copies with one ``toxic`` the row with the smallest id; rows without words are copies of each other.

    Copies are what links of at least three quarters of the five-word shingles connect (``near_duplicates``).
    """
    own = near_duplicates(rows).join(rows.select("doc_id", "toxic"), "doc_id")
    family = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    stay = store(own.groupBy("toxic", family).agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "families")
    return rows.join(few(stay), "doc_id", "left_semi")


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, whole, n0, n1``: in how many rows of each half a word stands, with (not ``whole``) and without a symbol at its edges."""
    counts = rows.select("text", "half").mapInArrow(_words, "word string, whole boolean, half int, n long")
    return store(by_half(counts, "word", "whole"), "words")


def language_model(words: DataFrame, n: int) -> CharModel:
    """Trigrams and known words of ``n`` texts, each word counted once a document."""
    counts = words.groupBy("word").agg(F.sum(F.col("n0") + F.col("n1")).alias("n"), F.max("whole").alias("whole"))
    padded = F.concat(F.lit("^^"), "word", F.lit("^"))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(3)))
    three = counts.select(F.explode(grams).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))
    # Known are words that stood without a symbol at their edges, so nothing that was cut counts.
    known = counts.filter(F.col("whole") & (F.col("n") * RARE >= n)).select("word")
    return CharModel.from_trigrams({r["gram"]: r["n"] for r in three.collect()}, frozenset(known.toArrow().column(0).to_pylist()))


def _stems(shipped):
    """The stems of documents' restored words, only those ``wanted`` if there are any such."""

    def stems_of(batch):
        lm, wanted = shipped.value
        begin = None if wanted is None else heads(wanted)
        column, halves = batch.column(0), batch.column(1).to_pylist()
        for first, tokens, index, edges in by_token(column):
            at = np.arange(len(tokens)) if wanted is None else candidates(tokens, begin)
            have = {}
            for k, token in zip(at.tolist(), tokens.take(pa.array(at)).to_pylist()):
                found = seen.get(token)
                if found is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    found = seen[token] = tuple({s for w in restore(token, lm) for s in own(w, wanted, begin)})
                if found:
                    have[k] = found
            some = np.zeros(len(tokens), dtype=bool)
            some[list(have)] = True
            spaced, last, stems_here = set(spaced_rows(tokens, index, edges)), -1, set()
            for row, k in zip(*once(some, index, edges)):
                if row != last:
                    yield [(s, halves[first + last]) for s in stems_here]
                    last, stems_here = row, set()
                    if row in spaced:
                        spaced.remove(row)
                        stems_here.update(s for w in spaced_runs(column[first + row].as_py(), lm) for s in own(w, wanted, begin))
                stems_here.update(have[k])
            yield [(s, halves[first + last]) for s in stems_here]
            for row in spaced:
                yield {(s, halves[first + row]) for w in spaced_runs(column[first + row].as_py(), lm) for s in own(w, wanted, begin)}

    def own(word, wanted, begin):
        if wanted is None:
            return stems(word)
        return [s for s in stems(word) if s in wanted] if word[:4] in begin else ()

    seen: dict[str, tuple[str, ...]] = {}
    return stems_of


def stem_counts(rows: DataFrame, lm: CharModel, wanted: frozenset[str] | None = None) -> DataFrame:
    """``stem, n0, n1``: in how many rows of each half a stem occurs."""
    shipped = rows.sparkSession.sparkContext.broadcast((lm, wanted))
    kinds = pa.schema([("stem", pa.string()), ("half", pa.int32()), ("n", pa.int64())])
    return by_half(rows.select("text", "half").mapInArrow(_counted(_stems(shipped), kinds), "stem string, half int, n long"), "stem")


def stem_weight(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Log ratio of a stem's frequencies in toxic and clean documents, the toxic one lowered by what chance explains; null for none."""
    sure = toxic - SURE * F.sqrt(toxic)
    return F.when(sure > 0, F.ln(sure / max(1, n_toxic)) - F.ln((clean + 0.5) / max(1, n_clean)))


def stem_weights(rows: DataFrame, lm: CharModel, words: DataFrame) -> list[dict[str, float]]:
    """The strong stems of all rows, of those with ``half`` 0 and of those with ``half`` 1, with their weights.

    Clean rows are counted for those stems alone that toxic ones have often enough. A word that stands whole in so many rows
    gives its stems a least count; those that can't be strong with it aren't counted either.
    """
    sizes = {(r["toxic"], r["half"]): r["count"] for r in rows.groupBy("toxic", "half").count().collect()}
    n = [[sizes.get((y, h), 0) for h in (0, 1)] for y in (0, 1)]

    def strong(counts: DataFrame) -> DataFrame:
        """``stem, w0, w1, w2`` by counts ``t0, t1`` of toxic and ``c0, c1`` of clean rows; a weight that isn't strong is null."""
        weights = []
        for halves in ((0, 1), (0,), (1,)):
            t, c = (sum((F.col(f"{x}{h}") for h in halves), F.lit(0)).cast("double") for x in "tc")
            weights.append(stem_weight(t, c, *(sum(n[y][h] for h in halves) for y in (1, 0))))
        out = counts.select("*", *[F.when(w > STRONG, w).alias(f"w{k}") for k, w in enumerate(weights)])
        return out.filter("coalesce(w0, w1, w2) is not null")

    toxic = stem_counts(rows.filter("toxic = 1"), lm).filter((F.col("n0") + F.col("n1")) * RARE >= sum(n[1]))
    toxic = toxic.withColumnsRenamed({"n0": "t0", "n1": "t1"})
    prefixes = F.transform(F.filter(F.sequence(F.lit(4), F.lit(8)), lambda k: k <= F.length("word")), lambda k: F.substring("word", F.lit(1), k))
    own = words.filter("whole and n0 + n1 > 2 and length(word) > 2").select("n0", "n1", F.explode(F.array_append(prefixes, F.concat(F.lit("="), "word"))).alias("stem"))
    least = own.groupBy("stem").agg(F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    sure = [F.greatest(F.lit(0), F.coalesce(F.col(f"n{h}"), F.lit(0)) - F.col(f"t{h}")).alias(f"c{h}") for h in (0, 1)]
    maybe = store(strong(toxic.join(least, "stem", "left").select("stem", "t0", "t1", *sure)).select("stem", "t0", "t1"), "stems")
    clean = stem_counts(rows.filter("toxic = 0"), lm, frozenset(maybe.select("stem").toArrow().column(0).to_pylist()))
    clean = clean.withColumnsRenamed({"n0": "c0", "n1": "c1"})
    found = strong(maybe.join(clean, "stem", "left").fillna(0, ["c0", "c1"])).collect()
    return [{r["stem"]: r[k] for r in found if r[k] is not None} for k in ("w0", "w1", "w2")]


def _featured(shipped):
    def run(batches):
        scorers = shipped.value
        for batch in batches:
            both = [s.rows(batch.column(0)) for s in scorers]
            rows = [found[1 - half][1:] for half, *found in zip(batch.column(2).to_pylist(), *both)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, pa.float64()) for c in (zip(*rows) if rows else [[]] * 3))], names=["toxic", "x1", "x2", "x3"])

    return run


def regression(rows: DataFrame) -> np.ndarray:
    """Newton steps with a ridge over ``toxic, x1, x2, x3``; the classes count alike. A step's sums are one aggregate over all rows."""
    rows = store(rows.groupBy("toxic", "x1", "x2", "x3").agg(F.count(F.lit(1)).alias("n")), "features")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return np.array([-5.0, 0.0, 0.0, 0.0])
    weight = {1: 1 / max(sizes.get(1, 0), 1), 0: 4 / max(sizes.get(0, 0), 1)}
    scale = sum(sizes.values()) / sum(weight[y] * n for y, n in sizes.items())
    own = F.col("n") * F.when(F.col("toxic") == 1, weight[1] * scale).otherwise(weight[0] * scale)
    x = [F.lit(1.0), *map(F.col, ("x1", "x2", "x3"))]
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    beta, ridge = np.zeros(4), np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(25):
        z = sum((x[k] * float(beta[k]) for k in range(4)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        bend, miss = own * F.greatest(p * (1 - p), F.lit(1e-6)), own * (F.col("toxic") - p)
        sums = rows.agg(*[F.sum(bend * x[i] * x[j]) for i, j in pairs], *[F.sum(miss * c) for c in x]).first()
        h = np.zeros((4, 4))
        for (i, j), v in zip(pairs, sums):
            h[i, j] = h[j, i] = v
        step = np.linalg.solve(h + ridge, np.array(sums[len(pairs) :]) - ridge @ beta)
        beta = beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on all labelled rows whose id has crc32 modulo 4 other than 2, on whole texts.

    Near copies with one label count once. Features of the regression come from the stem weights of
    the other half of the rows, dealt by a hash of the id. An id with several labels is toxic if one says so; of its
    texts the first in order counts. Other columns are ignored. Without labelled rows every score is near 0.
    """
    rows = labels.filter((crc_mod(F.col("doc_id"), 4) != 2) & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long")).agg(F.max("toxic").cast("int").alias("toxic"))
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(few(store(rows, "labelled")), "doc_id")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    taken = store(text.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "toxic", half, "text"), "training")
    chosen = without_copies(taken)
    words = word_counts(chosen)
    lm = language_model(words, chosen.count())
    weights, *halves = stem_weights(chosen, lm, words)
    shipped = docs.sparkSession.sparkContext.broadcast([Scorer(lm, w, np.zeros(4)) for w in halves])
    rows = chosen.select("text", "toxic", "half").mapInArrow(_featured(shipped), "toxic int, x1 double, x2 double, x3 double")
    return Scorer(lm, weights, regression(rows))


def _score(shipped):
    def run(batches):
        scorer = shipped.value
        for batch in batches:
            values = [scorer.chance(f) for f in scorer.rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, score, predicted`` of every row's whole text (null: empty); labels and other columns aren't read.

    A score of exactly ``THRESHOLD`` is predicted toxic. Of equally good readings of a token the first found is
    taken. A text of any length is scored as a whole in one task; repeated rows give repeated results; an empty
    table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(shipped), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
