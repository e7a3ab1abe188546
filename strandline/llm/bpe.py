"""Byte-level BPE encoding and decoding with a memory-mapped transducer of the corpus's frequent words.

Texts are cut at single spaces between other characters: no pre-token crosses such a space but as its first
character, so each chunk behind one is encoded once and remembered.

The corpus is counted once; pre-tokens that occur at least once in every ``1 / LEXICON`` of its characters
are compiled into a minimal acyclic automaton with shared suffixes. As every occurrence takes up its
characters, these words have at most ``LEXICON`` characters together, whatever the corpus: that bounds the
driver's share without a sort. Arcs carry the number of words that sort before them, so a walk over a word's bytes yields its rank, and the rank its
ids. The automaton is one flat file that Spark ships to every executor, where the Python workers map it
into memory. A word that isn't in the lexicon is merged exactly, pair by pair in rank order.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import uuid
from bisect import bisect_left
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.lean import lean
from strandline.llm.recent import Recent
from strandline.llm.shingles import buffers, gathered, slices
from strandline.session import own_folder

LEXICON = 1 << 21
#: Chunks that a Python worker remembers between lookups, and their longest.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64
#: Bytes of text whose distinct chunks are encoded together; a longer text stands alone.
SLICE_BYTES = 4 << 20
#: Ids whose bytes are gathered together, unless one row has more.
GATHERED = 1 << 17
#: Distinct chunks that a counting task holds before it passes their words on.
COUNTED = 400_000

#: The published split pattern of byte-level BPE (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WHITE = r"[\t-\r \x85\xa0  -     　]"
_SPLIT = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:(?!{_WHITE})[^\p{{L}}\p{{N}}])").replace(r"(?!\S)", rf"(?={_WHITE}|\Z)").replace(r"\s", _WHITE))
#: A space that can't be parted from its neighbours, and one that can.
_AWKWARD, _PARTING = re.compile(rf" {_WHITE}|{_WHITE} "), re.compile(rf"(?<!{_WHITE}) (?!{_WHITE})")

_NONE = 1 << 62


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        byte_of = {c: b for b, c in byte_letters().items()}

        def raw(token):
            return bytes(byte_of[c] for c in token)

        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = raw(token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        id_of = {b: i for i, b in enumerate(self.bytes_of)}
        self.byte_ids = [id_of[bytes([b])] for b in range(256)]
        # A pair of ids is one integer, and so are the rank and the id of what it becomes.
        self.merges = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
        self._hash(np.array([*self.merges], dtype=np.int64), np.array([*self.merges.values()], dtype=np.int64))
        self.piece_size = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_table = np.array(self.byte_ids, dtype=np.int64)
        self.spaced_specials = any(" " in t for t in self.special)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: always the pair of lowest rank, leftmost first."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.merges.get
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best & 0xFFFFFFFF]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], _NONE)
        return tuple(ids)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many words at once, a round at a time: every word's own best pair, leftmost first; ids as bytes."""
        out: list[bytes] = [b""] * len(words)
        lengths, low = np.array([len(w) for w in words], dtype=np.int64), 0
        for width in (5, 8, 11, 14, 18, 24, 32):
            rows, low = np.flatnonzero((lengths > low) & (lengths <= width)), width
            for k in range(0, len(rows), 8192):
                self._merge_block([words[i] for i in rows[k : k + 8192]], rows[k : k + 8192], width, out)
        for i in np.flatnonzero(lengths > 32):
            out[i] = np.array(self.merge(words[i]), dtype=np.int32).tobytes()
        return out

    def _merge_block(self, words: list[bytes], rows: np.ndarray, width: int, out: list) -> None:
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.array([len(w) for w in words])
        ids = self.byte_table[raw]
        pairs = np.full((n, width), _NONE, dtype=np.int64)  # a pair's rank and what it becomes; the last column stays empty
        pairs[:, :-1] = self._ranked(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        pairs[np.arange(width)[None, :] >= (size - 1)[:, None]] = _NONE
        active, place = np.arange(n), np.arange(width)
        while len(active):
            own = pairs[active]
            at = own.argmin(axis=1)
            best = own[np.arange(len(active)), at]
            go = best < _NONE
            active, at, best, own = active[go], at[go], best[go], own[go]
            if not len(active):
                break
            # What stands behind the merged pair moves one place to the left.
            take = np.minimum(place[None, :] + (place[None, :] > at[:, None]), width - 1)
            line = np.arange(len(active))
            now = np.take_along_axis(ids[active], take, axis=1)
            own = np.take_along_axis(own, take, axis=1)
            own[:, -1] = _NONE
            now[line, at] = best & 0xFFFFFFFF
            size[active] -= 1
            right = at + 1 < size[active]
            own[line[right], at[right]] = self._ranked(now[line[right], at[right]], now[line[right], at[right] + 1])
            own[line[~right], at[~right]] = _NONE
            left = at > 0
            own[line[left], at[left] - 1] = self._ranked(now[line[left], at[left] - 1], now[line[left], at[left]])
            ids[active], pairs[active] = now, own
        flat, start = ids.astype(np.int32).tobytes(), np.arange(n) * 4 * width
        for i, a, b in zip(rows.tolist(), start.tolist(), (start + 4 * size).tolist()):
            out[i] = flat[a:b]

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Pairs in an open table, at the first free place from their hash on."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.pair_keys, self.pair_values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, _NONE, dtype=np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.pair_keys[slot] == -1)
            at, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.pair_keys[at], self.pair_values[at] = keys[placed], values[placed]
            rest = np.ones(len(keys), dtype=bool)
            rest[placed] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        found, out = self.pair_keys[slot], self.pair_values[slot]
        left = np.flatnonzero((found != key) & (found != -1))
        out[found != key] = _NONE
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.pair_keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.pair_values[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap and links, for words of any length."""
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (new := get(ids[left] << 32 | ids[after[left]])) is not None:
                    heapq.heappush(heap, (new, left, ids[left], ids[after[left]]))
        return tuple(i for i in ids if i >= 0)


def pieces(text: str, vocabulary: Vocabulary) -> list[str]:
    """Pre-tokens of a text; special tokens stand alone."""
    if vocabulary.specials is None or not vocabulary.specials.search(text):
        return _SPLIT.findall(text)
    parts = vocabulary.specials.split(text)
    return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else _SPLIT.findall(part))]


def chunks(text: str, vocabulary: Vocabulary) -> list[str]:
    """The parts of a text between its parting spaces: all but the first stand behind a space of their own."""
    if vocabulary.spaced_specials:
        return [text]
    return _PARTING.split(text) if _AWKWARD.search(text) else text.split(" ")


def cut(column: pa.Array, vocabulary: Vocabulary) -> tuple[pa.Array, np.ndarray, np.ndarray | None]:
    """The chunks of all rows, where those of each row start (n + 1), and the rows' order (None: as they stand)."""
    column = column.cast(pa.string()).fill_null("")
    hard = np.full(len(column), vocabulary.spaced_specials)
    hard |= pc.match_substring_regex(column, _AWKWARD.pattern).to_numpy(zero_copy_only=False)
    order = np.argsort(hard, kind="stable") if hard.any() else None
    lists = [pc.split_pattern(column.filter(pa.array(~hard)), " ")]
    if order is not None:
        lists.append(pa.array([chunks(t, vocabulary) for t in column.filter(pa.array(hard)).to_pylist()], pa.list_(pa.string())))
    edges = np.cumsum(np.concatenate([[0], *(x.value_lengths().to_numpy(zero_copy_only=False) for x in lists)])).astype(np.int64)
    return pa.concat_arrays([x.flatten() for x in lists]), edges, order


def spaced_pieces(chunk: str, vocabulary: Vocabulary) -> list[str]:
    """Pre-tokens of a chunk behind its space."""
    return [" " + chunk] if chunk.isalpha() else pieces(" " + chunk, vocabulary)


class Transducer:
    """A minimal acyclic automaton over bytes that maps each of its words to a tuple of ids."""

    FIELDS = (("first", np.int32), ("final", np.uint8), ("label", np.uint8), ("target", np.int32), ("skip", np.int32), ("start", np.int32), ("ids", np.int32))

    @classmethod
    def compile(cls, entries: dict[bytes, tuple[int, ...]], path: str) -> None:
        """Write the automaton of ``entries`` to ``path``: words are added in order, suffixes are shared as they close."""
        words = sorted(entries)
        register: dict[tuple, int] = {}
        closed: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path_states: list[list] = [[False, []]]  # open states along the last word: [is final, closed arcs]

        def close(state) -> int:
            key = (state[0], tuple(state[1]))
            if key not in register:
                register[key] = len(closed)
                closed.append(key)
            return register[key]

        last = b""
        for word in words:
            common = len(os.path.commonprefix([last, word]))
            while len(path_states) > common + 1:
                child = close(path_states.pop())
                path_states[-1][1].append((last[len(path_states) - 1], child))
            path_states += [[False, []] for _ in word[common:]]
            path_states[-1][0] = True
            last = word
        while len(path_states) > 1:
            child = close(path_states.pop())
            path_states[-1][1].append((last[len(path_states) - 1], child))
        root = close(path_states[0])
        count = [0] * len(closed)
        first, final, label, target, skip = [], [], [], [], []
        for i, (is_final, arcs) in enumerate(closed):  # children close before their parents
            first.append(len(label))
            final.append(is_final)
            seen = int(is_final)
            for byte, child in arcs:
                label.append(byte)
                target.append(child)
                skip.append(seen)
                seen += count[child]
            count[i] = seen
        first.append(len(label))
        lengths = [len(entries[w]) for w in words]
        arrays = dict(first=first, final=final, label=label, target=target, skip=skip, start=np.concatenate([[0], np.cumsum(lengths)]), ids=list(chain.from_iterable(entries[w] for w in words)))
        blobs = [np.asarray(arrays[name], dtype=kind).tobytes() for name, kind in cls.FIELDS]
        with open(path, "wb") as f:
            f.write(np.array([root, *map(len, blobs)], dtype=np.int64).tobytes())
            for blob in blobs:
                f.write(blob + b"\0" * (-len(blob) % 8))

    def __init__(self, path: str):
        self.arcs = None
        with open(path, "rb") as f:
            whole = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        head = whole[: 8 * (1 + len(self.FIELDS))].cast("q")
        self.root, at = head[0], len(head) * 8
        for (name, kind), length in zip(self.FIELDS, head[1:]):
            setattr(self, name, whole[at : at + length].cast("i" if kind is np.int32 else "B"))
            at += length + -length % 8

    def get(self, word: bytes) -> tuple[int, ...] | None:
        state, rank, first, label = self.root, 0, self.first, self.label
        for byte in word:
            stop = first[state + 1]
            arc = bisect_left(label, byte, first[state], stop)
            if arc == stop or label[arc] != byte:
                return None
            rank += self.skip[arc]
            state = self.target[arc]
        if not self.final[state]:
            return None
        return tuple(self.ids[self.start[rank] : self.start[rank + 1]])

    def get_all(self, words: list[bytes]) -> list[bytes | None]:
        """``get`` of many words, ids as bytes: all of them walk the arcs together, byte by byte."""
        first, label = np.frombuffer(self.first, np.int32), np.frombuffer(self.label, np.uint8)
        target, skip, final = (np.frombuffer(x, kind) for x, kind in ((self.target, np.int32), (self.skip, np.int32), (self.final, np.uint8)))
        if self.arcs is None:  # arcs stand in order of their state and byte
            self.arcs = np.repeat(np.arange(len(final), dtype=np.int64), np.diff(first)) << 8 | label
        size = np.array([len(w) for w in words], dtype=np.int64)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        state, rank, alive = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), np.ones(len(words), bool)
        for k in range(int(size.max(initial=0))):
            on = np.flatnonzero(alive & (size > k))
            if not len(on):
                break
            key = state[on] << 8 | data[start[on] + k]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(on), bool)
            alive[on[~hit]] = False
            on, arc = on[hit], arc[hit]
            rank[on] += skip[arc]
            state[on] = target[arc]
        alive &= final[state] > 0
        return [self.ids[self.start[r] : self.start[r + 1]].tobytes() if ok else None for r, ok in zip(rank.tolist(), alive.tolist())]


def _summed(words: pa.Array, counts: pa.Array) -> tuple[pa.Array, pa.Array]:
    both = pa.table({"w": words, "n": counts}).group_by("w").aggregate([("n", "sum")]).combine_chunks()
    return tuple(both[c].combine_chunks() if isinstance(both[c], pa.ChunkedArray) else both[c] for c in ("w", "n_sum"))


def _count_words(vocabulary_path):
    """Words and their counts; distinct chunks are summed first, and only those with other characters than letters are cut."""

    def run(batches):
        vocabulary, heads, held = _vocabulary(vocabulary_path), Counter(), []

        def out():
            seen, counts = _summed(pa.concat_arrays([v for v, _ in held]), pa.concat_arrays([n for _, n in held]))
            plain = pc.utf8_is_alpha(seen)
            words = [pc.binary_join_element_wise(" ", seen.filter(plain), "")]
            ns = [counts.filter(plain).to_numpy()]
            other = pc.invert(plain)
            rows = [pieces(" " + c, vocabulary) for c in seen.filter(other).to_pylist()] + [pieces(h, vocabulary) for h in heads]
            each = np.concatenate([counts.filter(other).to_numpy(), np.array([*heads.values()], dtype=np.int64)])
            words.append(pa.array([*chain.from_iterable(rows)], pa.string()))
            ns.append(np.repeat(each, [len(r) for r in rows]))
            held.clear()
            heads.clear()
            return pa.RecordBatch.from_arrays([*_summed(pa.concat_arrays(words), pa.array(np.concatenate(ns), pa.int64()))], names=["word", "n"])

        for batch in batches:
            _, offsets = buffers(batch.column(0))
            for a, b in slices(offsets, SLICE_BYTES):
                values, edges, _ = cut(batch.column(0).slice(a, b - a), vocabulary)
                body = np.ones(len(values), dtype=bool)
                body[edges[:-1]] = False
                heads.update(values.take(pa.array(edges[:-1])).to_pylist())
                seen = values.filter(pa.array(body)).value_counts()
                held.append((seen.field("values"), seen.field("counts")))
                if sum(len(v) for v, _ in held) > COUNTED:
                    yield out()
        if held:
            yield out()

    return run


_VOCABULARIES: dict[str, Vocabulary] = {}
_WORDS: dict[str, tuple[Transducer, Recent]] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def build_lexicon(docs: DataFrame, vocabulary_path: str, size: int = LEXICON) -> str:
    """Count all words of ``docs.text``, compile those with at least one occurrence in ``1 / size`` of all characters, ship the file; its name."""
    spark = docs.sparkSession
    vocabulary = _vocabulary(vocabulary_path)
    frequent: list[str] = []
    if size:
        least = max(2, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // size))
        counts = docs.select("text").mapInArrow(lean(_count_words(vocabulary_path)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        frequent = [r["word"] for r in counts.filter(F.col("n") >= least).select("word").collect()]
    entries = {w.encode(): (vocabulary.special[w],) if w in vocabulary.special else vocabulary.merge(w.encode()) for w in frequent}
    name = f"lexicon-{uuid.uuid4().hex}"
    path = os.path.join(own_folder(), name)
    Transducer.compile(entries, path)
    spark.sparkContext.addFile(path)
    return name


class Encoder:
    """Ids of texts in one Python worker, as the bytes of 32-bit integers."""

    def __init__(self, vocabulary_path: str, lexicon: str):
        self.vocabulary = _vocabulary(vocabulary_path)
        if lexicon not in _WORDS:
            _WORDS.clear()
            _WORDS[lexicon] = (Transducer(SparkFiles.get(lexicon)), Recent(REMEMBERED))
        self.transducer, self.behind = _WORDS[lexicon]  # what is known of chunks behind a space

    def words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words: from the lexicon, else merged exactly."""
        raw = [w.encode() for w in words]
        found = self.transducer.get_all(raw)
        unseen = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(unseen, self.vocabulary.merge_all([raw[i] for i in unseen])):
            special = self.vocabulary.special.get(words[i])
            found[i] = ids if special is None else np.int32(special).tobytes()
        return dict(zip(words, found))

    def learn(self, heads: set[str], behind: set[str]) -> dict[str, bytes]:
        """The ids of chunks at the start of a text, by chunk; those of chunks behind a space are then in ``self.behind.new``."""
        new = self.behind.missing(behind)
        split = [c for c in new if not c.isalpha()]
        rows = [pieces(" " + c, self.vocabulary) for c in split]
        starts = {h: pieces(h, self.vocabulary) for h in heads}
        every = set(chain.from_iterable(rows)).union(*starts.values())
        spaced = {w[1:] for w in every if w[0] == " "} - {""}
        bare = [w for w in every if w[0] != " " or w == " "]
        single = new.difference(split) | self.behind.missing(spaced - new, turn=False) | spaced & new
        known, one = self.behind.new, self.words(bare)
        single = list(single)
        known.update(zip(single, self.words([" " + c for c in single]).values()))
        one.update((" " + c, known[c]) for c in spaced)
        known.update((c, one[r[0]] if len(r) == 1 else b"".join([one[w] for w in r])) for c, r in zip(split, rows))
        return {h: b"".join([one[w] for w in r]) for h, r in starts.items()}

    def encode(self, column: pa.Array) -> pa.ListArray:
        """The ids of every row of a text column."""
        values, edges, order = cut(column, self.vocabulary)
        coded = values.dictionary_encode()
        index, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        body = np.ones(len(index), dtype=bool)
        body[edges[:-1]] = False
        used = np.zeros(len(distinct), dtype=bool)
        used[index[body]] = True
        heads = [distinct[i] for i in index[edges[:-1]].tolist()]
        start = self.learn(set(heads), {distinct[i] for i in np.flatnonzero(used).tolist()})
        known, place = self.behind.new, {h: len(distinct) + k for k, h in enumerate(start)}
        index[edges[:-1]] = [place[h] for h in heads]
        flat, ends = gathered(index, [*(known[c] if u else b"" for c, u in zip(distinct, used.tolist())), *start.values()])
        for c in distinct:
            if len(c) > LONGEST_REMEMBERED:
                known.pop(c, None)
        out = pa.ListArray.from_arrays(pa.array(ends[edges].astype(np.int32)), pa.array(flat))
        return out if order is None else out.take(pa.array(np.argsort(order)))


def _encode(vocabulary_path, lexicon, at, keep, both):
    def run(batches):
        encoder = Encoder(vocabulary_path, lexicon)
        for batch in batches:
            _, offsets = buffers(batch.column(at))
            for first, last in slices(offsets, SLICE_BYTES):
                part = batch.slice(first, last - first)
                ids = encoder.encode(part.column(at))
                columns = {c: part.column(c) for c in keep} | {"ids": ids}
                if both:
                    columns["decoded"] = pa.array(decoded(ids.flatten().to_numpy(), ids.offsets.to_numpy().astype(np.int64), encoder.vocabulary), pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def decoded(ids: np.ndarray, edges: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """Texts of rows of ids, given flat with the rows' edges: one gather of the bytes of many rows at a time."""
    out, first = [], 0
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + GATHERED, side="right")) - 1)
        own, cuts = ids[edges[first] : edges[last]], edges[first : last + 1] - edges[first]
        size = vocabulary.piece_size[own]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(ends[-1]) + np.repeat(vocabulary.piece_start[own] - ends[:-1], size)
        raw, cuts = vocabulary.piece_bytes[place].tobytes(), ends[cuts].tolist()
        out += [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        first = last
    return out


def _decode(vocabulary_path, at):
    def run(batches):
        vocabulary = _vocabulary(vocabulary_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                column = part.column(at)
                edges = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = decoded(column.flatten().to_numpy(zero_copy_only=False), edges, vocabulary)
                known = column.is_valid().to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t if ok else None for t, ok in zip(texts, known)], pa.string())], names=[*part.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, vocabulary_path: str, size: int = LEXICON, keep: list[str] | None = None, both: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them) with ``ids array<int>``, the token ids of its whole texts (null
    or empty: no ids); with ``both`` also ``decoded``, the text of these ids.

    Special tokens written in a text are encoded as such, none are added. Pairs of equal rank don't exist,
    and of equal pairs the leftmost merges first. A text of any length is encoded as a whole in one task; a run
    without a parting space is merged in time n log n. All other columns pass through untouched, whatever
    their names (an input column ``ids``, or ``decoded`` with ``both``, is replaced); repeated rows give repeated results; an empty table
    gives no rows.
    """
    lexicon, made = build_lexicon(docs, vocabulary_path, size), ["ids", "decoded"] if both else ["ids"]
    docs = docs.drop(*made)
    keep = [c for c in docs.columns if keep is None or c in keep]
    docs = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = T.StructType([docs.schema[c] for c in keep]).add("ids", T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(lean(_encode(vocabulary_path, lexicon, docs.columns.index("text"), keep, both)), schema.add("decoded", T.StringType()) if both else schema)


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``encoded`` with ``decoded string``, the text of its ``ids`` (null: null; bytes that are no UTF-8: U+FFFD).

    Other columns pass through (an input column ``decoded`` is replaced); repeated rows give repeated
    results; an empty table gives no rows; a row of any length is decoded as a whole.
    """
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(lean(_decode(vocabulary_path, encoded.columns.index("ids"))), schema)
