"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

Sketch
    One hash of each five-word shingle picks one of ``REGISTERS`` buckets; the bucket keeps the
    smallest second hash, compressed to its leading-zero count and ten mantissa bits. Empty buckets
    borrow from another bucket along a fixed probe order, so short texts sketch like long ones.
Candidates
    Bands of ``ROWS`` registers are hashed to keys. Texts with equal shingle sets are folded to one
    representative before that, so a group of copies costs one row. In a band bucket every member is
    paired with the bucket's smallest member; what is still in another component afterwards is paired
    with a second centre. Members still in different components are then compared in blocks of bounded
    size, which return only the links found. No pair of different texts in a bucket is left out unless
    both are known to be connected.
Verification
    A pair with a centre needs a collision-corrected Jaccard estimate of at least ``SCREEN`` (far below
    the threshold) and is then confirmed on the full shingle sets: ``100 * both >= 75 * either``. Blocks
    hold the full sets and are counted exactly; shingles that no other text of a block has bound what a
    text can share, which spares most texts the count.

With 72 bands of 6 registers a pair at exactly 0.75 is missed with probability below 1e-6.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.llm.lean import lean
from strandline.llm.shingles import mix, shingle_rows
from strandline.llm.store import Tables, few

BANDS, ROWS = 72, 6
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
SCREEN = 0.5
PERCENT = 75
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 17, 512

_STEP = (np.random.default_rng(7).permutation(REGISTERS - 1) + 1).tolist() + [1]
_STEP = np.array([s if np.gcd(s, REGISTERS) == 1 else next(t % REGISTERS for t in range(s + 1, 3 * REGISTERS) if np.gcd(t, REGISTERS) == 1) for s in _STEP])
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def registers(shingles: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (rows x REGISTERS, uint16) of rows of shingle hashes; 0 marks an empty row."""
    n = len(edges) - 1
    row = np.repeat(np.arange(n), np.diff(edges))
    bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    low = np.full(n * REGISTERS, _EMPTY, dtype=np.uint64)
    np.minimum.at(low, row * REGISTERS + bucket, mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1))
    low = low.reshape(n, REGISTERS)
    empty = low == _EMPTY
    r, c = np.nonzero(empty & ~empty.all(axis=1)[:, None])
    source, fixed = low, low.copy()
    probe = c
    while len(r):
        probe = (probe + _STEP[c]) % REGISTERS
        value = source[r, probe]
        hit = value != _EMPTY
        fixed[r[hit], c[hit]] = mix(value[hit] + c[hit].astype(np.uint64)) >> np.uint64(1)
        r, c, probe = r[~hit], c[~hit], probe[~hit]
    # Leading zeros and the mantissa after the leading one are the exponent and fraction of a float.
    bits = fixed.astype(np.float64).view(np.uint64)
    zeros = np.uint64(1087) - (bits >> np.uint64(52))
    code = (zeros.clip(0, 62) + np.uint64(1)) << np.uint64(MANTISSA_BITS) | (bits >> np.uint64(52 - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)
    code[empty.all(axis=1)] = 0
    return code.astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band (rows x BANDS)."""
    wide = regs.astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + wide[:, :, k])
    return key


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard from equal registers, corrected for registers that agree by chance.

    Two unrelated minima share a leading-zero count with probability about 1/3 and then a mantissa
    with probability 2^-MANTISSA_BITS.
    """
    chance = 1 / (3 * (1 << MANTISSA_BITS))
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def _sketch(batches):
    """doc_id, n_shingles, digest of the shingle set, band keys."""
    for batch in batches:
        for first, last, shingles, edges in shingle_rows(batch.column(1)):
            keys = band_keys(registers(shingles, edges)).view(np.int64)
            sets = [np.unique(shingles[edges[i] : edges[i + 1]]) for i in range(last - first)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())),
                ],
                names=["doc_id", "n_shingles", "digest", "keys"],
            )


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(batches):
    """id, size and digest of the shingle set, the set itself, registers."""
    for batch in batches:
        for first, last, shingles, edges in shingle_rows(batch.column(1)):
            regs = registers(shingles, edges)
            sets = [np.unique(shingles[edges[i] : edges[i + 1]]) for i in range(last - first)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                    pa.array([x.tobytes() for x in regs], pa.binary()),
                ],
                names=["id", "n", "digest", "shingles", "regs"],
            )


def _screen(batches):
    """The pairs of a batch (a, b, registers of both) whose estimate reaches SCREEN."""
    for batch in batches:
        a, b = (np.array([np.frombuffer(x, np.uint16) for x in batch.column(k).to_pylist()]).reshape(-1, REGISTERS) for k in (2, 3))
        yield batch.select([0, 1]).filter(pa.array(estimate(a, b) >= SCREEN))


def _confirm(batches):
    """The pairs of a batch (a, b, full sets of both) that reach the threshold."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _links_in_block(block: pa.Table) -> pa.Table:
    """Links between rows with different labels: of one part, or between two parts, of a bucket."""
    ids, labels, parts = (block.column(k).to_numpy() for k in ("id", "label", "part"))
    sets = [np.frombuffer(x, np.uint64) for x in block.column("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.add.reduceat(counts[codes] > 1, edges[:-1], dtype=np.int64)
    one_part, place = parts.min() == parts.max(), np.arange(len(ids))
    marked = np.zeros(len(counts), dtype=bool)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero((parts == parts.min()) & (100 * shared >= PERCENT * sizes)):
        least = np.minimum(shared, shared[i])
        able = (labels != labels[i]) & (100 * least >= PERCENT * (sizes + sizes[i] - least)) & ((place > i) if one_part else (parts != parts[i]))
        if able.any():
            own = codes[edges[i] : edges[i + 1]]
            marked[own] = True
            both = np.add.reduceat(marked[codes], edges[:-1], dtype=np.int64)
            marked[own] = False
            hit = ids[able & (100 * both >= PERCENT * (sizes + sizes[i] - both))]
            a.append(np.full(len(hit), ids[i]))
            b.append(hit)
    return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Null texts and texts without words have an empty set, are linked with nothing and are kept. Rows
    with the same id and equal text count as one document and give a row each; an id with several texts
    is linked by each of them, and all its rows carry its component. Of equal similarities none is
    preferred: all links count. Ids must be 64-bit integers; rows with a null id are ignored. A text of
    any length is hashed as a whole, in one task. Other columns of ``docs``, whatever their names, are not
    read. An empty table gives no rows. ``block_shingles`` bounds a part of a bucket that is compared as a
    whole; it doesn't change results.
    """
    tables = Tables(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    sketch = tables.write(docs.mapInArrow(lean(_sketch), "doc_id long, n_shingles long, digest binary, keys array<long>"), "sketch")

    # One representative, the smallest id, for each shingle set; sets of one row need no join.
    sets = sketch.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("keys").alias("keys"))
    reps = tables.write(sets, "representatives")
    copied = reps.filter("copies > 1").select("digest", F.col("id").alias("rep"))
    member = sketch.select("doc_id", "n_shingles", "digest").join(copied, "digest", "left")
    member = tables.write(member.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
    tables.drop(sketch)

    # Buckets of two texts or more, each with its smallest member.
    rows = reps.select("id", F.explode("keys").alias("key"))
    bucket = rows.groupBy("key").agg(F.min("id").alias("c"), F.max("id").alias("last")).filter("c < last").select("key", "c")
    bucket = tables.write(bucket, "centres")
    inside = tables.write(rows.join(bucket, "key"), "buckets")
    tables.drop(reps, bucket)

    involved = tables.write(inside.select(F.col("id").alias("doc_id")).distinct(), "involved")
    texts = docs.join(few(involved), "doc_id", "left_semi")
    full = texts.mapInArrow(lean(_sets), "id long, n long, digest binary, shingles binary, regs binary").filter("n > 0").dropDuplicates(["id", "digest"])
    full = tables.write(full.drop("digest"), "sets")
    tables.drop(involved)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Screened by registers and confirmed on the full sets; sizes that can't reach the threshold are left out first."""

        def both(pairs, *columns):
            for x in ("a", "b"):
                pairs = pairs.join(full.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), x)
            return pairs

        able = both(pairs, "n", "regs").filter(f"100 * n_a >= {PERCENT} * n_b and 100 * n_b >= {PERCENT} * n_a")
        close = able.select("a", "b", "regs_a", "regs_b").mapInArrow(lean(_screen), "a long, b long").distinct()
        return both(close, "shingles").select("a", "b", "shingles_a", "shingles_b").mapInArrow(lean(_confirm), "a long, b long").distinct()

    def labelled(edges: DataFrame) -> DataFrame:
        label = components(edges)
        return tables.write(inside.join(label, "id", "left").select("key", "id", "c", F.coalesce("component_id", "id").alias("label")), "labelled")

    first = tables.write(confirmed(inside.filter("id <> c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()), "edges")

    # A second centre for what the first one left in other components.
    now = labelled(first)
    left = now.join(now.filter("id = c").select("key", F.col("label").alias("label1")), "key").filter("label <> label1")
    second = left.groupBy("key").agg(F.min(F.struct("id", "label")).alias("s"))
    pairs = left.join(second, "key").filter((F.col("id") != F.col("s.id")) & (F.col("label") != F.col("s.label")))
    edges = tables.write(first.union(confirmed(pairs.select(F.col("s.id").alias("a"), F.col("id").alias("b")).distinct())), "edges")
    tables.drop(now, first)

    # What is in one bucket but still in different components, in parts of bounded size: each row goes to
    # the comparison of its part with every part of the bucket.
    now = labelled(edges)
    rest = now.filter("id <> c")
    parted = F.greatest(F.ceil(F.sum("n") / block_shingles), F.ceil(F.count("n") / BLOCK_ROWS)).alias("n_parts")
    mixed = rest.join(full.select("id", "n"), "id").groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed"), parted)
    mixed = tables.write(mixed.filter("mixed").select("key", "n_parts"), "mixed")
    rest = rest.join(mixed, "key").join(full.select("id", "shingles"), "id")
    rest = rest.select("key", "id", "label", "shingles", "n_parts", F.expr("pmod(xxhash64(id), n_parts)").alias("part"))
    rest = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("other"))
    blocks = rest.groupBy("key", F.least("part", "other"), F.greatest("part", "other"))
    more = blocks.applyInArrow(_links_in_block, "a long, b long").distinct()
    # An id whose texts have different representatives is linked with each of them.
    several = member.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("doc_id")
    own = member.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    linked = tables.write(edges.union(more).union(own), "edges")
    tables.drop(now, mixed, edges, full, inside)

    label = components(linked)
    tables.drop(linked)
    component = F.coalesce("component_id", "rep")
    return member.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
