"""Language-model scores by context-tree weighting over bytes, with a unigram word score beside it.

Model: the lower-cased bytes of a text and one closing zero byte, each byte decomposed into eight binary
decisions. For every context of 0 to ``DEPTH`` preceding bytes and every decision the training counts of
zeros and ones give a Krichevsky-Trofimov estimate; a node's weighted probability is half its own
estimate and half the product of its children's, and predictions mix all depths by these weights.

Spark's part: texts are cut into blocks of ``BLOCK_BYTES``. A block counts its distinct words (by 64-bit
hash) and its distinct (context, byte) grams once, and sends each bucket of keys as one packed row. A bucket
sums the words over all blocks, and looks up the values of the grams; it answers each block in the order of
the keys that were sent, so keys travel once. There are as many buckets as half the blocks, so a bucket's
share doesn't grow with the corpus, and a key occurs at most once per block. Gram counts are summed by key;
the tree is built bottom-up over distinct grams dealt by their two most recent context bytes, below which
subtrees are independent; only depths 0 and 1 (at most 256 x 255 nodes) are put together on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shingles import _LOWER, buffers, mix, slices, word_hashes
from strandline.llm.store import Tables, crc_mod

DEPTH = 4
BLOCK_BYTES = 16 << 20
LEAST_BUCKETS = 16
#: Grams whose trees a task builds at once, unless those of one group of two context bytes are more.
GATHERED = 1 << 18
LOG_HALF = np.log(0.5)


def gram_keys(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed (four preceding bytes, latest first, and byte) of every position and each row's first position (n + 1)."""
    n = len(offsets) - 1
    base = offsets - offsets[0]
    lengths = np.diff(offsets)
    edges = base + np.arange(n + 1)  # one closing byte per row
    data = np.zeros(edges[-1], dtype=np.int64)
    body = np.ones(edges[-1], dtype=bool)
    body[edges[1:] - 1] = False
    data[body] = _LOWER[raw[offsets[0] : offsets[-1]]]
    key = data.copy()
    place = np.arange(edges[-1]) - np.repeat(edges[:-1], lengths + 1)
    for back in range(1, DEPTH + 1):
        own = np.zeros_like(data)
        own[back:] = data[:-back]
        own[place < back] = 0
        key |= own << (8 * (DEPTH + 1 - back))
    return key, edges


def _deal(batches):
    """Give consecutive rows of a partition the same block until it holds BLOCK_BYTES, and number them in it."""
    block, held, place = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        _, offsets = buffers(batch.column(1))
        for first, last in slices(offsets, BLOCK_BYTES // 4):
            size = int(offsets[last] - offsets[first])
            if held and held + size > BLOCK_BYTES:
                block, held, place = block + 1, 0, 0
            part, numbers = batch.slice(first, last - first), np.arange(place, place + last - first)
            held, place = held + size, place + last - first
            yield pa.RecordBatch.from_arrays([pa.array(np.full(last - first, block)), pa.array(numbers), *part.columns], names=["block", "place", "doc_id", "text", "held_out"])


def packed(values: np.ndarray) -> bytes:
    """Numbers by planes of bytes, which compress well: the first bytes of all, the second bytes of all, ..."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def differences(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of each word hash or gram; grams with the same three context bytes stay together."""
    return (keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)


class BlockKeys:
    """Distinct words and grams of a block of texts, with their counts in training rows."""

    def __init__(self):
        self.parts: tuple[list, list] = ([], [])

    def add(self, raw, offsets, train) -> None:
        for first, last in slices(offsets):
            words, bounds = word_hashes(raw, offsets[first : last + 1])
            grams, starts = gram_keys(raw, offsets[first : last + 1])
            for own, keys, cuts in zip(self.parts, (words, grams.view(np.uint64)), (bounds, starts)):
                weight = np.repeat(train[first:last], np.diff(cuts))
                for use in (True, False):
                    if len(chosen := keys[weight == use]):
                        found, counts = np.unique(chosen, return_counts=True)
                        own.append((found, counts * use))
            if len(self.parts[0]) > 40:
                self.parts = tuple([x] if len((x := self._summed(own))[0]) else [] for own in self.parts)

    @staticmethod
    def _summed(parts):
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)])
        counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
        keys, inverse = np.unique(keys, return_inverse=True)
        return keys, np.bincount(inverse, counts, minlength=len(keys)).astype(np.int64)

    def sorted(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys in order and their counts, of the words and of the grams."""
        return [self._summed(own) for own in self.parts]


def in_buckets(keys: np.ndarray, n_buckets: int, grams: bool) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by bucket, and where each bucket starts (n + 1)."""
    bucket = bucket_of(mix(keys >> np.uint64(16)) if grams else keys, n_buckets).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.cumsum(np.concatenate([[0], np.bincount(bucket, minlength=n_buckets)]))


def _blocks(batches):
    """Runs of rows with one block: its number, and the rows of each batch."""
    number, parts = None, []
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                if number is not None and number != blocks[a]:
                    yield number, parts
                    parts = []
                number = int(blocks[a])
                parts.append(batch.slice(a, b - a))
    if number is not None:
        yield number, parts


#: ``first`` and ``last`` are the places of the rows that were counted: all of a block's, unless two tasks read it.
SENT = "block long, bucket long, first long, last long, words binary, word_counts binary, grams binary, gram_counts binary"


def _statistics(n_buckets: int):
    """One row for each block and bucket: keys as packed differences and their training counts."""

    def run(batches):
        for number, parts in _blocks(batches):
            keys = BlockKeys()
            for part in parts:
                keys.add(*buffers(part.column(3)), ~part.column(4).to_numpy(zero_copy_only=False).astype(bool))
            columns = []
            for (own, counts), grams in zip(keys.sorted(), (False, True)):
                order, cuts = in_buckets(own, n_buckets, grams)
                own, counts = own[order], counts[order].astype(np.uint32)
                columns.append([packed(differences(own[a:b])) for a, b in zip(cuts, cuts[1:])])
                columns.append([packed(counts[a:b]) for a, b in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n_buckets, number)), pa.array(np.arange(n_buckets)), pa.array(np.full(n_buckets, parts[0].column(1)[0].as_py())), pa.array(np.full(n_buckets, parts[-1].column(1)[-1].as_py())),
                    *(pa.array(c, pa.binary()) for c in columns),
                ],
                names=["block", "bucket", "first", "last", "words", "word_counts", "grams", "gram_counts"],
            )

    return run


def _gram_counts(batches):
    """key, n of the grams of a batch of packed rows."""
    for batch in batches:
        keys = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64).view(np.int64) for x in batch.column(0).to_pylist()]
        counts = [unpacked(x, np.uint32).astype(np.int64) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (keys, counts)], names=["key", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of at least 1/2: Stirling's series after eight steps of the recurrence."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    return series - np.log(product)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a binary sequence under the Krichevsky-Trofimov estimator."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def subtrees(keys: np.ndarray, counts: np.ndarray, top: int):
    """Context trees of the grams from DEPTH up to depth ``top``.

    Returns the nodes at ``top`` (context and decision, zeros, ones, log weighted probability) and for each
    gram and decision the mixed probability of the bit that the gram takes there, seen from depth ``top``.
    """
    byte = keys & 255
    level = np.arange(8)[:, None]
    node = (1 << level) | (byte[None, :] >> (8 - level))
    bit = (byte[None, :] >> (7 - level)) & 1
    full = ((keys >> 8)[None, :] << 8 | node).ravel()  # (context, decision)
    bits = bit.ravel().astype(bool)
    ids, at = np.unique(full, return_inverse=True)
    weight = np.tile(counts, 8).astype(float)
    ones = np.bincount(at, weight * bits, minlength=len(ids))
    zeros = np.bincount(at, weight * ~bits, minlength=len(ids))
    below = None
    mixed = None
    for depth in range(DEPTH, top - 1, -1):
        if depth < DEPTH:
            parent = ids >> 16 << 8 | ids & 255
            ids, up = np.unique(parent, return_inverse=True)
            zeros, ones, below = (np.bincount(up, v, minlength=len(ids)) for v in (zeros, ones, weighted))
            at = up[at]
        own = kt_log(zeros, ones)
        here = (np.where(bits, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1.0)
        if depth == DEPTH:
            weighted, mixed = own, here
        else:
            weighted = np.logaddexp(LOG_HALF + own, LOG_HALF + below)
            share = np.exp(LOG_HALF + own - weighted)[at]
            mixed = share * here + (1 - share) * mixed
    return (ids, zeros, ones, weighted), mixed.reshape(8, -1)


def _gathered(batches):
    """Keys and counts of a partition, in parts that hold whole groups of two context bytes: the rows come sorted."""
    held: list = []
    for batch in batches:
        keys, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(keys >> 8 * (DEPTH - 1))) + 1
        if len(cuts) and sum(len(k) for k, _ in held) + len(keys) > GATHERED:
            held.append((keys[: cuts[-1]], counts[: cuts[-1]]))
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, keys, counts = [], keys[cuts[-1] :], counts[cuts[-1] :]
        held.append((keys, counts))
    if any(len(k) for k, _ in held):
        yield tuple(np.concatenate(x) for x in zip(*held))


def _top_nodes(batches):
    for keys, counts in _gathered(batches):
        (ids, zeros, ones, weighted), _ = subtrees(keys, counts, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(zeros), pa.array(ones), pa.array(weighted)], names=["node", "zeros", "ones", "weighted"])


class Root:
    """Depths 0 and 1: estimates of a one and the share of the node's own estimate, by context and decision."""

    def __init__(self, rows):
        zeros, ones, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for node, a, b, w in rows:
            zeros[node >> 8, node & 255], ones[node >> 8, node & 255], below[node >> 8, node & 255] = a, b, w
        self.one1, self.share1, weighted = self._mix(zeros, ones, below)
        self.one0, self.share0, _ = self._mix(zeros.sum(axis=0), ones.sum(axis=0), weighted.sum(axis=0))

    @staticmethod
    def _mix(zeros, ones, below):
        own = kt_log(zeros, ones)
        weighted = np.logaddexp(LOG_HALF + own, LOG_HALF + below)
        return (ones + 0.5) / (zeros + ones + 1.0), np.exp(LOG_HALF + own - weighted), weighted

    def log10(self, keys: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's byte, from its mixtures at depth 2."""
        byte, latest = keys & 255, keys >> (8 * DEPTH)
        total = np.zeros(len(keys))
        for j in range(8):
            node, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j) & 1).astype(bool)
            p = mixed[j]
            for one, share in ((self.one1[latest, node], self.share1[latest, node]), (self.one0[node], self.share0[node])):
                p = share * np.where(bit, one, 1 - one) + (1 - share) * p
            total += np.log10(p)
        return total


def _gram_values(root, n_buckets: int):
    def run(batches):
        for keys, counts in _gathered(batches):
            _, mixed = subtrees(keys, counts, 2)
            bucket = bucket_of(mix(keys.view(np.uint64) >> np.uint64(16)), n_buckets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(keys), pa.array(root.value.log10(keys, mixed))], names=["bucket", "key", "value"])

    return run


ANSWERED = "block long, bucket long, first long, last long, word_counts binary, gram_values binary, tokens long, distinct long"


def _answer(sent: pa.Table, values: pa.Table) -> pa.Table:
    """A bucket's answers to its blocks, and one row (block null) with its training tokens and distinct words."""
    words = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in sent["words"].to_pylist()]
    counts = [unpacked(x, np.uint32) for x in sent["word_counts"].to_pylist()]
    grams = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in sent["grams"].to_pylist()]
    keys, which = np.unique(np.concatenate(words), return_inverse=True)
    totals = np.bincount(which, np.concatenate(counts), minlength=len(keys)).astype(np.int64)
    each, cuts = totals[which], np.cumsum([0, *map(len, words)])
    known, value = values["key"].to_numpy().view(np.uint64), values["value"].to_numpy()
    order = np.argsort(known)
    known, value = known[order], value[order]
    n = len(words)
    return pa.table(
        {
            "block": pa.array([*sent["block"].to_pylist(), None], pa.int64()),
            **{c: pa.array([*sent[c].to_pylist(), None], pa.int64()) for c in ("bucket", "first", "last")},
            "word_counts": pa.array([packed(each[a:b]) for a, b in zip(cuts, cuts[1:])] + [None], pa.binary()),
            "gram_values": pa.array([packed(value[np.searchsorted(known, g)]) for g in grams] + [None], pa.binary()),
            "tokens": pa.array([None] * n + [int(totals.sum())], pa.int64()),
            "distinct": pa.array([None] * n + [int((totals > 0).sum())], pa.int64()),
        }
    )


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, n_bytes long"


def _score(n_buckets: int):
    """Scores of a block's texts from the answers of all buckets; ends and the corpus's size are left out here."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts, answers = texts.sort_by("place"), answers.sort_by([("first", "ascending"), ("bucket", "ascending")])
        spans = sorted(set(zip(answers["first"].to_pylist(), answers["last"].to_pylist())))
        return pa.concat_tables([part(texts.filter((pc.field("place") >= a) & (pc.field("place") <= b)), answers.filter(pc.field("first") == a)) for a, b in spans])

    def part(texts: pa.Table, answers: pa.Table) -> pa.Table:
        column = texts["text"].combine_chunks()
        raw, offsets = buffers(column)
        own = BlockKeys()
        own.add(raw, offsets, np.zeros(len(column), dtype=bool))
        tables = []
        for (keys, _), name, kind in zip(own.sorted(), ("word_counts", "gram_values"), (np.int64, np.float64)):
            order, _ = in_buckets(keys, n_buckets, name == "gram_values")
            values = np.empty(len(keys), kind)
            values[order] = np.concatenate([np.zeros(0, kind), *(unpacked(x, kind) for x in answers[name].to_pylist())])
            tables.append((keys, values))
        n = len(column)
        n_tokens, n_known, logs, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)

        def sums(x, cuts):
            total = np.concatenate([[0.0], np.cumsum(x)])
            return total[cuts[1:]] - total[cuts[:-1]]

        for first, last in slices(offsets):
            words, bounds = word_hashes(raw, offsets[first : last + 1])
            count = tables[0][1][np.searchsorted(tables[0][0], words)]
            n_tokens[first:last] = np.diff(bounds) + 1
            n_known[first:last] = np.rint(sums(count > 0, bounds))
            logs[first:last] = sums(np.log10(count + 1), bounds)
            grams, starts = gram_keys(raw, offsets[first : last + 1])
            score[first:last] = sums(tables[1][1][np.searchsorted(tables[1][0], grams.view(np.uint64))], starts)
        return pa.table(
            {"doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": n_tokens, "n_known": n_known, "log_counts": logs, "score": score, "n_bytes": np.diff(offsets).astype(np.int64)}
        )

    return run


def score(docs: DataFrame) -> DataFrame:
    """Word and byte-model scores of every row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte``.

    Learns from rows whose id has crc32 modulo 7 other than 2. A null text counts as empty: one token, the
    end, and one coded byte. Null ids are scored and never learnt from (``held_out`` is true). A text of any
    length is one row of one block. Repeated rows count repeatedly and have equal scores; other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    texts = tables.write(rows.mapInArrow(_deal, "block long, place long, doc_id long, text string, held_out boolean"), "texts")
    n_blocks, ends = texts.agg(F.count_distinct("block"), F.count_if(~F.col("held_out"))).first()
    n_buckets = max(LEAST_BUCKETS, n_blocks // 2)
    sent = tables.write(texts.mapInArrow(_statistics(n_buckets), SENT), "statistics")

    counts = sent.select("grams", "gram_counts").mapInArrow(_gram_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("c"))
    totals = tables.write(counts, "grams")
    grams = totals.repartition(F.shiftright("key", 8 * (DEPTH - 1))).sortWithinPartitions("key")
    nodes = grams.mapInArrow(_top_nodes, "node long, zeros double, ones double, weighted double")
    depth1 = nodes.groupBy(F.expr("(node div 65536) * 256 + node % 256").alias("node")).agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted"))
    root = spark.sparkContext.broadcast(Root([tuple(r) for r in depth1.collect()]))
    values = grams.mapInArrow(_gram_values(root, n_buckets), "bucket long, key long, value double")
    answers = tables.write(sent.drop("gram_counts").groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(_answer, ANSWERED), "answers")
    tables.drop(sent, totals)

    tokens, distinct = answers.filter("block is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    train_tokens, distinct = tokens + ends, distinct + (ends > 0)
    own = answers.filter("block is not null").drop("tokens", "distinct")
    scored = tables.write(texts.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_score(n_buckets), SCORED), "scored")
    tables.drop(texts, answers)
    base = F.col("log_counts") + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(train_tokens + distinct + 1))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
