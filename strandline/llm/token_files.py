"""Token-id files compressed by Re-Pair grammars, with random access.

Documents are dealt by ranges of ``doc_id`` and sorted, so shard after shard holds ascending ids. Each
shard is cut into blocks of whole documents with about ``BLOCK`` ids. In a block the frequent pairs of
neighbouring ids are replaced by new symbols, round after round, until no pair pays for its rule. A block
stores its rules, the expanded length of each symbol, the remaining sequence and the documents' lengths,
so any document can be expanded without the others.

In one round many pairs are replaced at once, always the most frequent among them: a symbol may open pairs
or close pairs, never both, so chosen occurrences can't overlap and the order of replacement doesn't matter.
When a pair of equal symbols is the most frequent, all such pairs are replaced, at every second place of a run.

Block layout (little endian): ``RPR1``, five uint32 (documents, ids, rules, symbols, alphabet), then as
uint32 the documents' lengths, the rules' left and right symbols, the rules' lengths, the sequence.
Blocks are rows of a Parquet table, so every store that Spark reads can hold them.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shingles import _IS_SPACE, _LOWER, buffers, slices, spread
from strandline.llm.store import few, store

BLOCK = 1 << 17
#: A rule takes three numbers, so it pays if it shortens the sequence by four.
LEAST_COUNT = 4
#: Runs that a Python worker remembers, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 1_000_000, 64
#: Bytes of text whose distinct runs are encoded together; a longer text stands alone.
SLICE_BYTES = 12 << 20
JOINED, TEXTS = 256, 64
#: How the tokenizer's file splits words, and the same for ASCII and letters that no normalisation makes anything else
#: (``LETTERS``).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "À-ÖØ-öø-įı-ɏΑ-ΡΣ-ώЀ-ҁҊ-ԣ"
PLAIN = f"^[\\x00-\\x7F{LETTERS}]*$"
PLAIN_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^\sa-z0-9{LETTERS}]+"
#: ASCII letters and digits, and the other ASCII characters that aren't white space: behind one of the former, one of the latter begins a word.
_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_SIGN = ~(_ALNUM | _IS_SPACE) & (np.arange(256) < 128)
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
END_ID = 1


def compress(ids: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(left, right, sequence)``: rule ``k`` rewrites symbol ``alphabet + k`` to its left and right symbols."""
    seq = ids.astype(np.uint32)
    lefts, rights, top = [], [], alphabet
    # A pair that is rare stays rare, so only places where a pair was frequent or is new are looked at.
    at = np.arange(len(seq) - 1) if len(seq) > 1 else np.zeros(0, np.int64)
    while True:
        codes = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        bits = len(at).bit_length() + 1
        some = (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
        some = np.bincount(some, minlength=1 << bits)[some] >= LEAST_COUNT
        at, codes = at[some], codes[some]
        coded = pa.array(codes).dictionary_encode()
        pairs, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        counts = np.bincount(which)
        often = counts >= LEAST_COUNT
        if not often.any():
            break
        order = np.flatnonzero(often)
        order = order[np.argsort(-counts[order], kind="stable")]
        a, b = ((pairs[order] >> np.uint64(shift)).astype(np.int64) & 0xFFFFFFFF for shift in (32, 0))
        twins = a[0] == b[0]
        if twins:
            chosen = order[a == b]
        elif len(order) > 1500:
            # Most of a symbol's frequent pairs decide whether it opens or closes; the most frequent pair always goes.
            opens = np.bincount(a, counts[order], minlength=top) - np.bincount(b, counts[order], minlength=top)
            opens[a[0]], opens[b[0]] = np.inf, -np.inf
            chosen = order[(opens[a] > 0) & (opens[b] <= 0)]
        else:
            role: dict[int, int] = {}
            chosen = order[[x != y and role.setdefault(x, 1) == 1 and role.setdefault(y, 2) == 2 for x, y in zip(a.tolist(), b.tolist())]]
        chosen = np.sort(chosen)
        rule = np.full(len(pairs), -1)
        rule[chosen] = np.arange(len(chosen))
        rule = rule[which]
        hit = rule >= 0
        if twins:
            # The k-th place of a run of one pair with itself is taken if k is even.
            place = np.flatnonzero(hit)
            fresh = np.ones(len(place), dtype=bool)
            fresh[1:] = np.diff(at[place]) != 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
            hit[place[(np.arange(len(place)) - run) % 2 == 1]] = False
        first = at[hit]
        look = np.zeros(len(seq), dtype=bool)
        look[at[often[which]]] = True
        look[first] = True
        look[np.maximum(first - 1, 0)] = look[np.maximum(first - 2, 0)] = True  # one of them stays as the place before
        seq[first] = top + rule[hit]
        keep = np.ones(len(seq), dtype=bool)
        keep[first + 1] = False
        seq, look = seq[keep], look[keep]
        at = np.flatnonzero(look[:-1])
        lefts.append((pairs[chosen] >> np.uint64(32)).astype(np.uint32))
        rights.append((pairs[chosen] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        top += len(chosen)
    none = np.zeros(0, np.uint32)
    return np.concatenate([none, *lefts]), np.concatenate([none, *rights]), seq


def pack(documents: list[np.ndarray], alphabet: int) -> bytes:
    ids = np.concatenate([np.zeros(0, np.uint32), *documents])
    left, right, seq = compress(ids, alphabet)
    size = [1] * alphabet
    for x, y in zip(left.tolist(), right.tolist()):
        size.append(size[x] + size[y])
    head = np.array([len(documents), len(ids), len(left), len(seq), alphabet], dtype="<u4")
    body = [np.array([len(d) for d in documents]), left, right, size[alphabet:], seq]
    return b"RPR1" + head.tobytes() + b"".join(np.asarray(x).astype("<u4").tobytes() for x in body)


class Block:
    """A packed block; ``document(k)`` expands one document."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPR1":
            raise ValueError("not a token block")
        n_docs, self.n_ids, n_rules, n_seq, self.alphabet = (int(x) for x in np.frombuffer(data, "<u4", 5, 4))
        at, parts = 24, []
        for n in (n_docs, n_rules, n_rules, n_rules, n_seq):
            parts.append(np.frombuffer(data, "<u4", n, at))
            at += 4 * n
        self.lengths, self.left, self.right, self.sizes, self.seq = parts
        self.edges = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        self.ends = np.cumsum(self._size(self.seq))
        self._rules()

    def _size(self, symbols):
        out = np.ones(len(symbols), dtype=np.int64)
        rule = symbols >= self.alphabet
        out[rule] = self.sizes[symbols[rule] - self.alphabet]
        return out

    def _rules(self):
        """The ids of every rule, one after the other: each is half as long as its occurrences at least, so all fit in memory."""
        sides = [x.astype(np.int64) - self.alphabet for x in (self.left, self.right)]
        depth: list[int] = []
        for x, y in zip(*(x.tolist() for x in sides)):
            depth.append(1 + max(depth[x] if x >= 0 else 0, depth[y] if y >= 0 else 0))
        depth = np.array(depth, dtype=np.int64)
        self.start = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.flat = np.zeros(int(self.sizes.sum(dtype=np.int64)), dtype=np.uint32)
        for level in range(1, int(depth.max(initial=0)) + 1):
            own = np.flatnonzero(depth == level)
            left_size = self._size(self.left[own])
            for symbols, at in ((self.left[own], self.start[own]), (self.right[own], self.start[own] + left_size)):
                size = self._size(symbols)
                to = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
                self.flat[to] = self._expand(symbols)

    def _expand(self, symbols):
        rule = symbols >= self.alphabet
        if not rule.any():
            return symbols
        size = self._size(symbols)
        first = np.zeros(len(symbols), dtype=np.int64)
        first[rule] = self.start[symbols[rule] - self.alphabet]
        inside = np.repeat(rule, size)
        out = np.repeat(symbols, size)
        place = np.arange(len(out)) - np.repeat(np.cumsum(size) - size - first, size)
        out[inside] = self.flat[place[inside]]
        return out

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the block, expanding only the symbols that cover them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.ends, start, side="right"))
        last = int(np.searchsorted(self.ends, stop, side="left"))
        begin = int(self.ends[first - 1]) if first else 0
        return self._expand(self.seq[first : last + 1])[start - begin : stop - begin]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.edges[k]), int(self.edges[k + 1]))

    def documents(self):
        every = self._expand(self.seq)
        return [every[a:b] for a, b in zip(self.edges[:-1], self.edges[1:])]


_TOKENIZERS: dict[str, tuple] = {}


def _closing(tokenizer) -> np.ndarray | None:
    """Which ids end a word, of a tokenizer that lower-cases and splits words by ``WORDS``; None of others."""
    file = json.loads(tokenizer.to_str())
    model, steps = file["model"], (file["pre_tokenizer"] or {}).get("pretokenizers", [])
    suffix, vocabulary = model.get("end_of_word_suffix"), model.get("vocab")
    split = [s["type"] for s in steps] == ["Split", "ByteLevel"] and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": WORDS}, "Removed", True)
    bytewise = split and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
    normal = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    plain = suffix and not model["unk_token"] and not model["continuing_subword_prefix"] and not file["post_processor"]
    if not (bytewise and normal and plain and all(chr(c) in vocabulary and chr(c) + suffix in vocabulary for c in range(33, 127))):
        return None
    closing = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
    closing[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
    return closing


class Runs:
    """Runs of characters with their ids, in Arrow and numpy; of more than ``size`` those that were asked for lately stay."""

    def __init__(self, size: int):
        self.size, self.now = size, 0
        self.runs, self.used = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def places(self, runs: pa.Array) -> np.ndarray:
        """Where ``runs`` are, -1 for those that aren't there; places hold until the next call."""
        if len(self.runs) > self.size:
            keep = self.used > np.median(self.used)
            self.ids = self.ids[np.repeat(keep, self.sizes)]
            self.runs, self.sizes, self.used = self.runs.filter(pa.array(keep)), self.sizes[keep], self.used[keep]
        at = pc.fill_null(pc.index_in(runs, value_set=self.runs), -1).to_numpy().astype(np.int64)
        self.now += 1
        self.used[at[at >= 0]] = self.now
        return at

    def add(self, runs: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.runs, self.used = pa.concat_arrays([self.runs, runs]), np.concatenate([self.used, np.full(len(runs), self.now)])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])


def lowered(column: pa.Array, part: bool) -> pa.Array:
    """Texts with A-Z in small letters, if ``part`` with a space between an ASCII letter or digit and an ASCII sign behind it.

    Capitals stay before what may be a mark (U+0300, which is 0xCC 0x80, and above): normalisation joins marks first, and to J or I others than
    to j or i.
    """
    raw, offsets = buffers(column)
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    low = _LOWER[raw]
    marked = np.flatnonzero(_CAPITAL[raw[:-1]] & (raw[1:] >= 0xCC))
    low[marked] = raw[marked]
    if part:
        begins = np.flatnonzero(_ALNUM[low[:-1]] & _SIGN[low[1:]]) + 1
        # Between two texts a space does no harm, so their edges needn't be known.
        offsets, low = offsets + np.searchsorted(begins, offsets), np.insert(low, begins, np.uint8(32))
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(low))


class ChunkEncoder:
    """Ids of texts by the tokenizers library, which sees each distinct run of other characters than white space once.

    The tokenizer file lower-cases and maps white space to a separator that no token crosses, so a text's
    ids are those of its runs in order, whatever the case of A-Z. New runs go to the library ``JOINED`` at a
    time, parted by spaces. If the file splits words by ``WORDS``, a run ends before an ASCII sign behind an ASCII letter or digit
    too, unless there are special tokens. Then each word's last token, and no other, ends in the suffix of the file's model: in
    runs of ASCII characters and ``LETTERS`` words are counted, so the library needn't follow offsets. In other runs,
    with special tokens or with other files, the offsets of the tokens tell the runs apart.
    """

    def __init__(self, path: str):
        if path not in _TOKENIZERS:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _TOKENIZERS[path] = (tokenizer, Runs(REMEMBERED), _closing(tokenizer))
        self.tokenizer, self.known, self.closing = _TOKENIZERS[path]
        self.alphabet = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a text column, each row closed by ``END_ID``, and where each row starts (n + 1)."""
        column = column.cast(pa.large_string()).fill_null("")
        special = pc.any(pc.match_substring(column, "<|")).as_py()  # special tokens are told by their case
        if not special:
            column = lowered(column, self.closing is not None)
        lists = pc.ascii_split_whitespace(column)
        coded = lists.flatten().cast(pa.string()).dictionary_encode()
        runs, index = coded.dictionary, coded.indices.to_numpy()
        at, known = self.known.places(runs), len(self.known.runs)
        new = runs.filter(pa.array(at < 0))
        plain = np.zeros(len(new), dtype=bool)
        if self.closing is not None:
            plain = pc.match_substring_regex(new, PLAIN).to_numpy(zero_copy_only=False)
            if special:
                plain &= ~pc.match_substring(new, "<|").to_numpy(zero_copy_only=False)
        # Long runs come last: they aren't remembered.
        long = pc.greater(pc.binary_length(new), LONGEST_REMEMBERED).to_numpy(zero_copy_only=False)
        order, sizes, ids = [], [self.known.sizes], [self.known.ids]
        for some, learn in ((plain & ~long, self._learn_plain), (~plain & ~long, self._learn), (plain & long, self._learn_plain), (~plain & long, self._learn)):
            order.append(np.flatnonzero(some))
            for own in (sizes, ids):
                own.append(np.zeros(0, own[0].dtype))
            if some.any():
                sizes[-1], ids[-1] = learn(new.take(pa.array(order[-1])))
        place = np.empty(len(new), np.int64)
        place[np.concatenate(order)] = known + np.arange(len(new))
        at[at < 0] = place
        flat, ends = spread(at[index], np.concatenate(sizes), np.concatenate(ids))
        self.known.add(new.take(pa.array(np.concatenate(order[:2]))), np.concatenate(sizes[1:3]), np.concatenate(ids[1:3]))
        edges = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        return np.insert(flat, edges[1:], np.uint32(END_ID)), edges + np.arange(len(edges))

    def _learn_plain(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some runs has, and the ids: of runs of ASCII characters and ``LETTERS`` without special tokens.

        Each has as many closing tokens as words.
        """
        from tokenizers import normalizers

        words = np.cumsum(pc.count_substring_regex(pc.ascii_lower(runs), PLAIN_WORDS).to_numpy())
        runs = pc.utf8_lower(runs)  # which is all that the file's normalisation does to them
        sizes, ids = [], []
        normal, self.tokenizer.normalizer = self.tokenizer.normalizer, normalizers.Sequence([])
        try:
            for first in range(0, len(runs), TEXTS * JOINED):
                for found in self.tokenizer.encode_batch_fast(_joined(runs.slice(first, TEXTS * JOINED)), add_special_tokens=False):
                    ids.append(np.array(found.ids, dtype=np.uint32))
                    sizes.append(len(ids[-1]))
        finally:
            self.tokenizer.normalizer = normal
        ids = np.concatenate(ids)
        stops = np.flatnonzero(self.closing[ids]) + 1
        texts = np.minimum(np.arange(1, len(sizes) + 1) * JOINED, len(runs)) - 1
        if len(stops) != words[-1] or not np.array_equal(np.concatenate([[0], stops])[words[texts]], np.cumsum(sizes)):
            raise ValueError("the tokenizer splits words otherwise than its file says")
        return np.diff(np.concatenate([[0], stops])[words], prepend=0), ids

    def _learn(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of any runs."""
        sizes, ids = [], []
        for k, text in zip(range(0, len(runs), JOINED), _joined(runs)):
            found = self.tokenizer.encode(text, add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in runs.slice(k, JOINED).to_pylist()])
            sizes.append(np.diff(np.searchsorted(np.array([a for a, _ in found.offsets], dtype=np.int64), starts)))
            ids.append(np.array(found.ids, dtype=np.uint32))
        return np.concatenate(sizes), np.concatenate(ids)


def _joined(runs: pa.Array) -> list[str]:
    """Texts of ``JOINED`` runs each, parted by spaces."""
    edges = np.minimum(np.arange(0, len(runs) + JOINED, JOINED), len(runs)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), runs), " ").to_pylist()


def _blocks(path):
    def run(batches):
        encoder, shard, before, number = ChunkEncoder(path), TaskContext.get().partitionId(), 0, 0
        ids, documents, held = [], [], 0

        def out():
            nonlocal before, number, ids, documents, held
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(documents, encoder.alphabet)], pa.binary())],
                names=["shard", "block", "before", "n_ids", "doc_ids", "data"],
            )
            before, number, ids, documents, held = before + held, number + 1, [], [], 0
            return row

        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES):
                flat, edges = encoder.encode(batch.column(1).slice(a, b - a))
                for doc_id, start, stop in zip(batch.column(0).slice(a, b - a).to_pylist(), edges[:-1].tolist(), edges[1:].tolist()):
                    if held and held + stop - start > BLOCK:
                        yield out()
                    ids.append(doc_id)
                    documents.append(flat[start:stop])
                    held += stop - start
        if documents:
            yield out()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode whole texts, append ``END_ID`` to each, write the block table and return it as read back.

    A null or empty text is just the end id. Rows with equal or null ids are kept, nulls first, equal ids
    in any order. Other columns are ignored; an empty table gives no blocks. A text of any length is encoded as a
    whole, one at a time, and is a block of its own if it fills one.
    """
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return store(dealt.mapInArrow(_blocks(tokenizer_path), "shard int, block int, before long, n_ids long, doc_ids array<long>, data binary"), "tokens")


def _read(batches):
    for batch in batches:
        for first, doc_ids, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            block = Block(data)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(first + block.edges[:-1], pa.int64()),
                    pa.array(block.lengths.astype(np.int64)),
                    pa.array([zlib.crc32(ids.astype("<u4", copy=False).tobytes()) for ids in block.documents()], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a block table.

    ``start`` counts the ids of all documents before it; shard totals (one row per shard) are summed in order. Null and
    repeated ids come back as often as they were written, each with its own place; a document of any length is
    expanded alone. No blocks give no rows.
    """
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    placed = blocks.join(few(store(starts, "starts")), "shard").select((F.col("base") + F.col("before")).alias("first"), "doc_ids", "data")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
