"""Benchmark items inside documents: MinHash containment search by size, verified exactly.

An item's shingles are few and a document's many, so the Jaccard likeness of
the two says little. Items are partitioned by their number of shingles; for the
partition with sizes up to u, documents are cut into overlapping windows of 2u
shingles, a new one every u. An item that a document contains lies in one
window, whose likeness to it then has a lower bound of about a fifth. A window
is a candidate for an item if any of its one-permutation MinHash values equals
the item's; candidates are verified by exact containment of shingles.

Items and documents meet in joins on (partition, value). A bitmap of the items'
values, of bounded size, keeps other values of the documents out of the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.shingles import STEP, SYMBOLS, U64, mix, shingle_hashes, slices, word_hashes
from tapewright.llm.storage import materialize, unused

BINS = 64
EMPTY = np.iinfo(np.uint64).max
#: The bitmap has this many bits for each value, as a power of two, up to the greatest size (16 MB); beyond it more values pass, and the joins settle them.
BITS_EACH, MOST_BITS = 8, 27
#: Bits of one row of the bitmap's table, as Spark's bitmap functions deal them.
BUCKET = 32_768


def _bins(h: np.ndarray) -> np.ndarray:
    return (h % U64(BINS)).astype(np.int64)


def size_partition(places: np.ndarray) -> np.ndarray:
    """The least power of two that is no less than a number of shingles as they stand in a text."""
    return 1 << np.ceil(np.log2(np.maximum(places, 1))).astype(np.int64)


def keyed(values: np.ndarray, partition: int) -> np.ndarray:
    """Values told apart by size partition (a number of shingles) or, below zero, by the width of a short run."""
    return mix(values + U64(partition * int(STEP) % (1 << 64)))


def lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([np.zeros(0, U64), *values])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def indexed_items(items: DataFrame, n: int) -> DataFrame:
    """``item_id, partition, shingles, keys`` of ``item_id, text`` rows that have words.

    ``shingles``: the distinct ones; ``keys``: the MinHash values of an item
    of ``n`` words and more, the one run of a shorter item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, words = word_hashes(pc.utf8_lower(part.column("text")), SYMBOLS)
                counts = np.bincount(rows, minlength=part.num_rows)
                full = np.flatnonzero(counts)
                partitions, shingles, keys = [], [], []
                for i in full:
                    own = words[np.searchsorted(rows, i, "left") : np.searchsorted(rows, i, "right")]
                    width = min(len(own), n)
                    h = np.unique(shingle_hashes(np.zeros(len(own), np.int64), own, width, whole_short=False)[1])
                    partition = int(size_partition(np.array([len(own) - n + 1]))[0]) if width == n else -width
                    least = np.full(BINS, EMPTY, U64)
                    np.minimum.at(least, _bins(h), h)
                    partitions.append(partition)
                    shingles.append(h)
                    keys.append(keyed(least[least != EMPTY], partition))
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(pa.array(full)), pa.array(partitions, pa.int64()), lists(shingles), lists(keys)], names=["item_id", "partition", "shingles", "keys"]
                )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, partition long, shingles array<bigint>, keys array<bigint>")


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """The bits of ``key`` modulo a power of two, which follows the number of keys up to a bound; as bytes."""
    bits = min(MOST_BITS, max(15, int(keys.count()).bit_length() + BITS_EACH))
    place = F.pmod("key", F.lit(1 << bits))
    # Spark numbers buckets and bits of positive numbers from 1 and 0.
    bucket = F.call_function("bitmap_bucket_number", place + 1)
    rows = keys.groupBy(bucket.alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", place + 1)).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for bucket, part in rows.collect():  # 16 MB at most
        part = np.frombuffer(bytes(part), np.uint8)
        out[(bucket - 1) * BUCKET // 8 :][: len(part)] = part[: len(out)]
    return out


def met(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the keys' bits are set."""
    place = (keys & U64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def window_minima(rows: np.ndarray, h: np.ndarray, u: int) -> np.ndarray:
    """All MinHash values of windows of 2u shingles, one every u, as (row, value) pairs without repeats."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    within = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    block_starts = within % u == 0
    block = np.cumsum(block_starts) - 1
    least = np.full((block[-1] + 1, BINS), EMPTY, U64)
    np.minimum.at(least.reshape(-1), block * BINS + _bins(h), h)
    block_row = rows[block_starts]
    joined = np.full_like(least, EMPTY)
    same = np.flatnonzero(block_row[1:] == block_row[:-1])
    joined[same] = np.minimum(least[same], least[same + 1])
    alone = np.setdiff1d(np.arange(len(least)), same, assume_unique=True)  # the last block of a row is a window too
    joined[alone] = least[alone]
    at, _ = np.nonzero(joined != EMPTY)
    return np.stack([block_row[at].astype(U64), joined[joined != EMPTY]])


def document_keys(docs: DataFrame, partitions: list[int], bitmap: np.ndarray, n: int) -> DataFrame:
    """``doc_id, hit_text, key``: the documents' values of all partitions that the bitmap lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast((sorted(partitions), bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partitions, bitmap = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows, words = word_hashes(pc.utf8_lower(part.column("text")), SYMBOLS)
                found = [np.zeros((2, 0), U64)]
                wide_rows, wide = shingle_hashes(rows, words, n, whole_short=False)
                for p in partitions:
                    owner, values = shingle_hashes(rows, words, -p, whole_short=False) if p < 0 else window_minima(wide_rows, wide, p) if len(wide) else found[0]
                    keys = keyed(values, p)
                    passed = met(bitmap, keys)
                    found.append(np.stack([owner[passed].astype(U64), keys[passed]]))
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                at = pa.array(pairs[0].astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("hit_text").take(at), pa.array(pairs[1].view(np.int64))], names=["doc_id", "hit_text", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "hit_text", "text").mapInArrow(run, f"doc_id {kind}, hit_text long, key long")


def document_shingles(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, hit_text, shingle``, distinct in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, h = shingle_hashes(*word_hashes(pc.utf8_lower(part.column("text")), SYMBOLS), n, whole_short=False)
                order = np.lexsort((h, rows))
                rows, h = rows[order], h[order]
                first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])][: len(h)])
                at = pa.array(rows[first])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("hit_text").take(at), pa.array(h[first].view(np.int64))], names=["doc_id", "hit_text", "shingle"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "hit_text", "text").mapInArrow(run, f"doc_id {kind}, hit_text long, shingle long")


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["hit_text"] == b["hit_text"])


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, hit_text, item_id, shared, item_shingles, containment`` of every item found in a document; ``hit_text`` is the text's hash.

    ``docs``: doc_id, text; ``items``: item_id, text. Case and punctuation are
    ignored. Null and empty texts contain nothing and, as items, are found
    nowhere. Equal items are each reported; documents equal in id and text are
    reported once, null ids as nulls.
    """
    docs = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("hit_text"))
    index = materialize(indexed_items(items, n))
    keys = index.select("item_id", "partition", F.explode("keys").alias("key"))
    partitions = [r[0] for r in index.select("partition").distinct().collect()]  # powers of two and widths below n: some fifty at most
    found = document_keys(docs, partitions, bitmap_of(keys.select("key").distinct()), n)
    candidates = materialize(found.join(keys, "key").select("doc_id", "hit_text", "item_id", "partition").distinct())
    sized = index.select("item_id", "partition", F.size("shingles").cast("long").alias("item_shingles"))
    # The one run of a short item is its key; the others are counted shingle by shingle.
    short = candidates.where("partition < 0").select("doc_id", "hit_text", "item_id", F.lit(1).cast("long").alias("shared"), F.lit(1).cast("long").alias("item_shingles"))
    long = candidates.where("partition > 0").select("doc_id", "hit_text", "item_id")
    wanted = long.select("doc_id", "hit_text").distinct()
    own = document_shingles(docs.join(wanted, same_document(docs, wanted), "left_semi"), n).distinct()
    asked = long.join(index.where("partition > 0").select("item_id", F.explode("shingles").alias("shingle")).distinct(), "item_id")
    counted = asked.join(own, same_document(asked, own) & (asked["shingle"] == own["shingle"]), "left_semi").groupBy("doc_id", "hit_text", "item_id").agg(F.count("*").alias("shared"))
    settled = counted.join(sized.where("partition > 0").drop("partition").distinct(), "item_id").where(F.col("shared") >= threshold * F.col("item_shingles"))
    columns = ["doc_id", "hit_text", "item_id", "shared", "item_shingles"]
    return short.select(columns).unionByName(settled.select(columns)).withColumn("containment", F.col("shared") / F.col("item_shingles"))


def op10_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contained_items(docs.select("doc_id", "text"), items.select("item_id", "text")).drop("hit_text")


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with a doc_id and text) in which no item is found, with all their columns."""
    hits = materialize(contained_items(docs.select("doc_id", "text"), items.select("item_id", "text")).select("doc_id", "hit_text").distinct())
    hit_id, hit_text = unused(docs, "hit_id", "hit_text")
    hits = hits.toDF(hit_id, hit_text)
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64("text") == F.col(hit_text)), "left_anti")
