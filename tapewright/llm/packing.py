"""Packing by powers of two: no training sequence holds two documents.

A document's token ids are cut into pieces whose lengths are the powers of two
of its length's binary form, longest first, with the longest length allowed as
often as it fits. Pieces of one length form a bucket; each piece is a sequence
of exactly that length, so nothing is padded.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.shingles import release_memory, slices, spans_of_words, text_bytes
from tapewright.llm.storage import materialize

#: Different chunks of text whose ids a Python worker remembers, at about 150 bytes each.
REMEMBERED_CHUNKS = 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
BREAKS = np.isin(np.arange(256), list(b" \n"))


class WordIds:
    """Token ids of whole texts, a slice of rows at a time.

    The vocabulary's tokens never span white space, so a text's ids are the
    joined ids of its chunks between spaces and newlines. The distinct chunks
    of a slice are told apart by their bytes and remembered. A new chunk of
    printable ASCII and composed Latin letters is lowered and split by the
    tokenizer's own pattern, and its words go to the tokenizer's BPE model; any
    other goes whole through the tokenizer, which alone knows about normal
    forms, controls and its version of Unicode.
    """

    def __init__(self, tokenizer_path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        # Fixed values of the vocabulary file: its word pattern, as far as these letters go, and its printable names of bytes.
        self.words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^\sa-z\u00df-\u00f6\u00f8-\u017f0-9]+").findall
        self.plain = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        self.names = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes, self.pool = array("q"), array("i"), array("I")

    def of_chunk(self, chunk: bytes) -> list[int]:
        text = chunk.decode()
        if not self.plain(text) or "<|" in text:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        text = text.lower()
        words = [text] if text.isalpha() else self.words(text)
        named = words if text.isascii() else ["".join(map(self.names.get, word.encode())) for word in words]
        return [t.id for word in named for t in self.model.tokenize(word)]

    def places(self, chunks: list[bytes]) -> np.ndarray:
        """Numbers of distinct chunks among those known; new ones are added."""
        if len(self.known) > REMEMBERED_CHUNKS:
            self.forget()
        known, out = self.known, []
        for chunk in chunks:
            at = known.get(chunk)
            if at is None:
                ids = self.of_chunk(chunk)
                at = known[chunk] = len(self.starts)
                self.starts.append(len(self.pool))
                self.sizes.append(len(ids))
                self.pool.extend(ids)
            out.append(at)
        return np.array(out, np.int64)

    def of_rows(self, column: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each row's text; null texts have none."""
        data, offsets = text_bytes(column)
        begin, end = spans_of_words(data, offsets, BREAKS)
        ids, cuts = np.zeros(0, "<u4"), np.zeros(len(column) + 1, np.int64)
        if len(begin):
            ends = np.cumsum(end - begin)
            chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.r_[0, ends]), pa.py_buffer(data[~BREAKS[data]])]).dictionary_encode()
            inverse = chunks.indices.to_numpy()
            at = self.places(chunks.dictionary.to_pylist())
            # Copies, as arrays that lend their memory can't grow.
            starts, sizes = np.array(self.starts)[at], np.array(self.sizes)[at]
            counts = sizes[inverse].astype(np.int64)
            before = np.cumsum(counts) - counts
            where = np.repeat(starts[inverse] - before, counts) + np.arange(counts.sum())
            ids = np.frombuffer(self.pool, np.uint32)[where].astype("<u4") if len(where) else ids
            rows = np.searchsorted(offsets, begin, "right") - 1
            cuts[1:] = np.cumsum(np.bincount(rows, counts, len(column))).astype(np.int64)
        return [ids[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]

    def of_text(self, text: str) -> bytes:
        return self.of_rows(pa.array([text], pa.large_string()))[0]


@lru_cache(maxsize=2)
def _word_ids(tokenizer_path: str) -> WordIds:
    """One for each Python worker."""
    return WordIds(tokenizer_path)


def binary_lengths(total: int, longest: int) -> list[int]:
    """Lengths that add up to ``total``: ``longest`` as often as it fits, then the powers of two of what is left."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = 4096) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece of ``doc_id, text`` rows.

    A null text counts as empty: its one piece is the end id. Rows that repeat
    a doc_id are packed each on its own.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                owner, starts, lengths, sums, totals = [], [], [], [], []
                for row, own in enumerate(words.of_rows(part.column("text"))):
                    ids = own + end
                    start, total = 0, len(ids) // 4
                    for length in binary_lengths(total, longest):
                        owner.append(row)
                        starts.append(start)
                        lengths.append(length)
                        sums.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                        totals.append(total)
                        start += length
                numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), *numbers], names=[c.split()[0] for c in PIECES.split(", ")])
        # The worker lives on beside other stages' work.
        words.forget()
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def bucketed_sequences(pieces: DataFrame) -> DataFrame:
    """Add ``sequence_id`` (gapless from 0, equal lengths side by side, longest first) and ``offset`` (0).

    Pieces are range-partitioned by length, doc_id and start; a piece's number
    is its place in its partition after the rows of all partitions before it.
    """
    order = [F.col("length").desc(), F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    placed = materialize(
        materialize(pieces)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
    )
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        placed.groupBy(part.alias("part"))
        .agg(F.count("*").alias("rows"))
        .select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    )
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(totals), "part")  # one row for each partition
        .withColumn("sequence_id", F.col("rows_before") + F.col("place").bitwiseAND((1 << 33) - 1))
        .withColumn("offset", F.lit(0).cast("long"))
    )


def op4_packing(docs: DataFrame, tokenizer_path: str, end_id: int = 2, longest: int = 4096) -> DataFrame:
    """One row per piece; ``bucket`` is the sequence's length."""
    return bucketed_sequences(token_pieces(docs, tokenizer_path, end_id, longest)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.col("sequence_id").cast("long").alias("sequence_id"), "offset", F.col("length").alias("bucket"),
    )
