"""Benchmark passages inside documents: size-partitioned MinHash containment, verified exactly.

Short test items hide in documents a thousand times their size, where a symmetric similarity is close to
zero. So containment ``|item and document| / |item|`` is searched directly.

Partitions
    Items are partitioned by the size ``n`` of their shingle set, a power of two at a time. Each partition has
    its own sketch size, the number of smallest hashes that stand for an item (``sketch_size``), and its own
    threshold, the number of them that a document must hold (``least_hits``). Where a sketch holds more than a
    quarter of an item's shingles, up to 127, the threshold is what an item that is held by 75 percent can't
    miss, so nothing is lost; above that it is far below what such an item misses by chance (below 1e-9).
Search
    Documents are read once. A bit table of fixed size in front leaves only hashes that may be in a sketch;
    these are joined with the sketches and counted by document and item.
Verification
    Candidate documents are read again, and their shingles counted against the full sets of their candidate
    items: ``100 * shared >= 75 * n``.

Everything but the bit table, ``FILTER_BITS`` for a benchmark of any size, is a join of tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.lean import lean
from strandline.llm.shingles import mix, shingle_rows
from strandline.llm.store import MOST_IDS, Tables, few

PERCENT = 75
LARGEST_SKETCH = 64
LARGEST_PARTITION = 40
#: Share of a sketch that must be found where chance decides.
SCREEN = 0.4
FILTER_BITS = 24


def sketch_size(partition: int) -> int:
    """Hashes in the sketch of an item with ``2^partition`` shingles or more, but less than twice as many."""
    return 1 << partition if partition <= 3 else min(LARGEST_SKETCH, 3 << partition >> 2)


def least_hits(partition: int) -> int:
    """Hashes of a sketch that a document must hold."""
    missing = (2 << partition) - 1 - -(-PERCENT * ((2 << partition) - 1) // 100)
    sure = sketch_size(partition) - missing
    return sure if partition < 7 else int(np.ceil(SCREEN * sketch_size(partition)))


def _shingles(batches):
    """id, hash for the distinct shingles of every row."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, shingles, edges in shingle_rows(batch.column(1)):
            sets = [np.unique(shingles[edges[i] : edges[i + 1]]) for i in range(last - first)]
            flat = np.concatenate([np.zeros(0, np.uint64), *sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[first:last], [len(x) for x in sets])), pa.array(flat.view(np.int64))], names=["id", "hash"])


def _place(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _places(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_place(batch.column(0).to_numpy().view(np.uint64))))], names=["place"])


def _probe(shipped):
    """doc_id, hash for the distinct shingles of every document that may be in a sketch."""

    def run(batches):
        table = shipped.value  # eight places a byte
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, shingles, edges in shingle_rows(batch.column(1)):
                place = _place(shingles)
                maybe = np.flatnonzero(table[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                row = np.searchsorted(edges, maybe, side="right") - 1
                own, hashes = ids[first:last][row], shingles[maybe].view(np.int64)
                order = np.lexsort((hashes, own))
                own, hashes = own[order], hashes[order]
                fresh = np.ones(len(own), dtype=bool)
                fresh[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(own[fresh]), pa.array(hashes[fresh])], names=["doc_id", "hash"])

    return run


def _by_partition(value, partition: Column) -> Column:
    return F.element_at(F.array(*[F.lit(value(p)) for p in range(LARGEST_PARTITION)]), partition + 1)


def contaminated(docs: DataFrame, benchmark: DataFrame, most_ids: int = MOST_IDS) -> DataFrame:
    """Pairs ``doc_id, item_id, n_item_shingles, n_shared, containment`` of a document and a test item of which
    it holds at least 75 percent of the shingles.

    Null or empty texts on either side match nothing; an item or document with one to four words has its whole
    sequence as its one shingle. Rows with a null id are ignored. Repeated rows of a document or item count as
    one; an id with several texts has the shingles of all. A containment of exactly 75 percent counts; items with
    equal texts all match. Texts of any length are hashed as a whole, in one task. Other columns, whatever their
    names, are ignored. Empty tables give no rows. Ids of candidate documents are sent to every task if they are
    ``most_ids`` at most, else the documents are joined by a shuffle.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text")).filter("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text")).filter("id is not null")
    full = tables.write(items.mapInArrow(lean(_shingles), "id long, hash long").distinct().select(F.col("id").alias("item_id"), "hash"), "items")
    sizes = full.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = tables.write(sizes.withColumn("partition", F.floor(F.log2("n") + 1e-9).cast("int")), "sizes")
    ranked = full.join(sizes, "item_id").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("hash")))
    sketch = ranked.filter(F.col("rank") <= _by_partition(sketch_size, F.col("partition"))).select("item_id", "hash", _by_partition(least_hits, F.col("partition")).alias("least"))
    sketch = tables.write(sketch, "sketches")

    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    for row in sketch.select("hash").mapInArrow(lean(_places), "place long").groupBy(F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).toLocalIterator():
        bits[row["word"] * 64 : row["word"] * 64 + 64] = np.unpackbits(np.array([row["bits"]], np.int64).view(np.uint8), bitorder="little")
    probes = docs.mapInArrow(lean(_probe(spark.sparkContext.broadcast(np.packbits(bits, bitorder="little")))), "doc_id long, hash long")
    hits = probes.join(sketch, "hash").groupBy("doc_id", "item_id").agg(F.count_distinct("hash").alias("hits"), F.min("least").alias("least"))
    screened = tables.write(hits.filter("hits >= least").select("doc_id", "item_id"), "candidates")
    tables.drop(sketch)

    found = tables.write(screened.select("doc_id").distinct(), "documents")
    own = docs.join(few(found, most_ids), "doc_id", "left_semi").mapInArrow(lean(_shingles), "doc_id long, hash long").distinct()
    wanted = screened.join(full, "item_id")
    shared = own.join(wanted, ["doc_id", "hash"]).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    pairs = shared.join(sizes, "item_id").filter(f"100 * n_shared >= {PERCENT} * n")
    return pairs.select("doc_id", "item_id", F.col("n").alias("n_item_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))
