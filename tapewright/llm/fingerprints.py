"""Fingerprints that add up: homomorphic multiset hashes of a text's paragraphs.

A paragraph (a line; the empty text has none) hashes to a wide vector of two
parts, and a text's fingerprint is the sum of its paragraphs' vectors, each
lane modulo a power of two. The order of paragraphs doesn't matter, and a
paragraph is inserted or deleted by adding or subtracting its vector.

* 16 lanes modulo 2**32 of the paragraph's BLAKE2b digest tell texts apart;
* 256 lanes modulo 2**32 count the paragraph's three-word runs with random
  signs, so that the squared length of a difference of two fingerprints
  estimates how many runs differ: the likeness of two texts. No text is long
  enough to carry a lane past its sign; sums of over 2**31 runs may.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.shingles import U64, shingle_hashes, word_hashes

EXACT_LANES, LIKE_LANES, RUN = 16, 256, 3
CHUNK_CHARS = 1 << 20
NO_ID = -(1 << 63)


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of bytes for each text."""
    parts = [t.split("\n") if t else [] for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    flat = [p for own in parts for p in own]
    owner = np.repeat(np.arange(len(texts)), counts)
    exact = np.zeros((len(texts), EXACT_LANES), np.uint32)
    like = np.zeros(len(texts) * LIKE_LANES, np.int64)
    if flat:
        digests = b"".join([blake2b(p.encode(), digest_size=4 * EXACT_LANES).digest() for p in flat])
        lanes = np.frombuffer(digests, "<u4").reshape(-1, EXACT_LANES)
        full = np.flatnonzero(counts)
        exact[full] = np.add.reduceat(lanes, np.r_[0, np.cumsum(counts)[:-1]][full], axis=0, dtype=np.uint32)
        rows, words = word_hashes(pa.array(flat, pa.large_string()))
        rows, runs = shingle_hashes(rows, words, RUN)
        lane = owner[rows] * LIKE_LANES + (runs % U64(LIKE_LANES)).astype(np.int64)
        sign = 1.0 - 2.0 * ((runs >> U64(40)) & U64(1)).astype(np.float64)
        like = np.rint(np.bincount(lane, sign, len(like))).astype(np.int64)
    like = like.reshape(-1, LIKE_LANES).astype(np.uint32)  # modulo 2**32
    return np.concatenate([exact.astype("<u4").view(np.uint8), like.astype("<u4").view(np.uint8)], axis=1)


def _lanes(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prints = np.ascontiguousarray(np.atleast_2d(prints))
    return np.ascontiguousarray(prints[:, : 4 * EXACT_LANES]).view("<u4"), np.ascontiguousarray(prints[:, 4 * EXACT_LANES :]).view("<u4")


def combined(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprints of the paragraphs of both; ``sign`` -1: of ``a`` without the paragraphs of ``b``."""
    (ea, la), (eb, lb) = _lanes(a), _lanes(b)
    exact, like = (ea + eb, la + lb) if sign > 0 else (ea - eb, la - lb)
    return np.concatenate([exact.astype("<u4").view(np.uint8), like.astype("<u4").view(np.uint8)], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 row by row: the estimated share of three-word runs in common; 1 for equal fingerprints."""
    (_, la), (_, lb) = _lanes(a), _lanes(b)
    signed = lambda x: x.astype(np.int32).astype(np.float64)
    apart = (signed(la - lb) ** 2).sum(axis=1)
    size = (signed(la) ** 2).sum(axis=1) + (signed(lb) ** 2).sum(axis=1)
    near = np.clip(1 - apart / np.maximum(size, 1), 0, 1)
    return np.where((np.atleast_2d(a) == np.atleast_2d(b)).all(axis=1), 1.0, np.where(size == 0, 0.0, near))


def printed(prints: np.ndarray) -> list[str]:
    return [base64.b64encode(p.tobytes()).decode() for p in prints]


def next_in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """``key`` (the doc_id, a null one as ``NO_ID``), ``text, is_guest`` with one range of ids a partition, sorted, followed by the first row of the next range.

    Nothing but the range limits (``buckets`` numbers) and each range's first
    id passes through the driver.
    """
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("key"))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted({int(x) for x in docs.approxQuantile("key", shares, 1 / (8 * buckets))}) if shares else []
    bucket = _bucket(F.col("key"), cuts)
    firsts = {r["bucket"]: r["first"] for r in docs.groupBy(bucket.alias("bucket")).agg(F.min("key").alias("first")).collect()}
    full = sorted(firsts)
    previous = F.array(*[F.lit(max([b for b in full if b < i], default=full[-1] if full else 0)) for i in range(len(cuts) + 1)])
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("is_guest"))
    guest = F.struct(F.element_at(previous, bucket + 1).alias("bucket"), F.lit(True).alias("is_guest"))
    places = F.when(F.col("key").isin(list(firsts.values())), F.array(own, guest)).otherwise(F.array(own))
    return (
        docs.withColumn("place", F.explode(places))
        .select("text", "key", "place.*")
        .repartitionById(len(cuts) + 1, F.col("bucket"))
        .sortWithinPartitions("is_guest", "key", F.xxhash64("text"), "text")
    )


def _bucket(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the key; looks at about two square roots of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = F.array(*[F.lit(c) for c in cuts[step - 1 :: step]]), F.array(*[F.lit(c) for c in cuts])
    skipped = F.size(F.filter(coarse, lambda c: c <= key)) * step
    return skipped + F.size(F.filter(F.slice(fine, skipped + 1, step), lambda c: c <= key))


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    """The last quarter of the text, rounded down, replaced by as much of the following text's start."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _compared(ids: list, texts: list[str], following: str) -> pd.DataFrame:
    after = [*texts[1:], following]
    changed = [edited(t, n) for t, n in zip(texts, after, strict=True)]
    own, of_changed = fingerprints([*texts, following]), fingerprints(changed)
    return pd.DataFrame(
        {
            "doc_id": pd.array([None if i == NO_ID else i for i in ids], dtype="Int64"),
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": printed(own[:-1]),
            "edited_fingerprint": printed(of_changed),
            "near_edited": likeness(own[:-1], of_changed),
            "near_next": likeness(own[:-1], own[1:]),
        }
    )


def compared_with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text of ``doc_id, text`` and of its edited text, and their likenesses.

    Null texts are empty, an empty text's fingerprint is all zeros. Order:
    doc_id, nulls first, then the text's hash; the last row's next is the
    first. A single row is its own next. Extra columns are ignored.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        texts: list[str] = []
        guest, chars = None, 0
        for batch in batches:
            for doc_id, text, is_guest in zip(batch["key"], batch["text"], batch["is_guest"], strict=True):
                if is_guest:
                    guest = text if guest is None else guest
                    continue
                if chars > CHUNK_CHARS:
                    yield _compared(ids, texts, text)
                    ids, texts, chars = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                chars += len(text)
        if texts:
            yield _compared(ids, texts, texts[0] if guest is None else guest)

    return next_in_order(docs.select("doc_id", "text"), buckets).select("key", "text", "is_guest").mapInPandas(run, SCHEMA)


def op2_fingerprints(docs: DataFrame) -> DataFrame:
    return compared_with_next(docs)
