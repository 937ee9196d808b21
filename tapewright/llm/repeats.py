"""Removal of long byte strings that occur more than once, by sparse enhanced suffix arrays.

Every string of ``passage`` bytes has an anchor: the least hash among its runs
of ``ANCHOR`` bytes, leftmost first. Equal strings have equal anchors at equal
places, and so have longer strings, by their first ``passage`` bytes; so
occurrences are grouped by their anchor's hash. With an anchor goes its
context: as many bytes on both sides as a string that has it can reach. Where a
group holds different contexts, the suffixes that start at the anchors are
sorted with their common prefixes (an enhanced suffix array of those places), a
stack scan gives the tree of common-prefix intervals, and in each interval the
texts left of the anchors are compared: occurrences that extend left
differently but far enough are one maximal repeat, found with all its
occurrences. Contexts that agree in both 64-bit hashes, of anchor and whole,
are one entry of the array with a count.

Two lengths are judged at once: strings of ``length`` bytes that start anywhere
else, which are removed, and passages that stand in another document too, which
are reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.shingles import U64, hash_spans, mix, powers, slices, text_bytes
from tapewright.llm.storage import materialize

ANCHOR = 64
#: A passage of some fifty words, in bytes.
PASSAGE = 256
#: Groups of more different contexts are settled string by string through an aggregation, with the same result, so that no task holds a large group.
CROWDED = 20_000
#: Places that are looked at at once; they share a 64-bit number with a hash's upper bits.
PLACES = 1 << 27


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(v)
    padded = np.concatenate([v, np.full(-n % w, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def least_places(runs: np.ndarray, w: int) -> np.ndarray:
    """For each ``w`` consecutive hashes the place of the least, leftmost first."""
    mask = U64(2 * PLACES - 1)
    found = []
    for low in range(0, len(runs) - w + 1, PLACES):
        part = runs[low : low + PLACES + w - 1]
        found.append((sliding_least((part & ~mask) | np.arange(len(part), dtype=U64), w) & mask).astype(np.int64) + low)
    return np.concatenate(found)


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, passage: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, context hash, start, left, size) of every context; start counts from the row's first byte.

    ``left`` bytes of the context stand before its anchor.
    """
    rows = np.flatnonzero(np.diff(offsets) >= passage)
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none.astype(U64), none.astype(U64), none, none, none
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    runs = mix((sums[anchor:] - sums[:-anchor]) * down[: len(data) - anchor + 1])
    # A string's place is its start; only strings inside one row count.
    valid = np.zeros(len(data) + 1, np.int64)
    np.add.at(valid, offsets[rows], 1)
    np.add.at(valid, offsets[rows + 1] - passage + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid))
    at = least_places(runs, passage - anchor + 1)[starts]
    at = at[np.flatnonzero(np.r_[True, at[1:] != at[:-1]])]
    owner = np.searchsorted(offsets, at, "right") - 1
    begin = np.maximum(at - (passage - anchor), offsets[owner])
    end = np.minimum(at + length, offsets[owner + 1])
    whole = mix(mix((sums[end] - sums[begin]) * down[begin]) + (at - begin).astype(U64))
    return owner, runs[at], whole, begin - offsets[owner], at - begin, end - begin


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("node"))


CONTEXT = "key long, ctx long, node long, start int, left int, size int"


def anchored_contexts(docs: DataFrame, length: int, passage: int, anchor: int) -> DataFrame:
    """``key, ctx, node, start, left, size`` of ``node, text`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, key, ctx, start, left, size = contexts(*text_bytes(part.column("text")), length, passage, anchor)
                numbers = [pa.array(x.astype(np.int32)) for x in (start, left, size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), part.column("node").take(pa.array(row)), *numbers], names=["key", "ctx", "node", "start", "left", "size"]
                )

    return docs.select("node", "text").mapInArrow(run, CONTEXT)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # equal up to low, unequal up to high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of every interval of the common-prefix tree; ``lcp[i]`` is of entries i and i+1."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            height, first = stack.pop()
            yield height, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


@dataclass
class Occurrence:
    """A context's bytes from its anchor on, those before it reversed, how often it stands and in which documents (the least and the greatest)."""

    right: bytes
    left: bytes
    copies: int
    documents: tuple[int, int]

    def alone(self, other: Occurrence) -> bool:
        """Whether both stand in one and the same document only."""
        return self.documents == other.documents and self.documents[0] == self.documents[1]


def neighbours(members: list[Occurrence], shared: list[int]) -> list[tuple[int, int]]:
    """Of entries sorted by their left bytes, how many of these each shares with any other, and with any of another document (below zero: there is none)."""
    n, none = len(members), -(1 << 40)
    found = [(max(shared[i - 1] if i else 0, shared[i] if i < n - 1 else 0), none) for i in range(n)]
    for order in (range(1, n), range(n - 2, -1, -1)):
        before = order.step
        best = [none] * n
        for i in order:
            common = shared[i - 1] if before > 0 else shared[i]
            best[i] = min(best[i - before], common) if members[i].alone(members[i - before]) else common
            found[i] = found[i][0], max(found[i][1], best[i])
    return found


def repeated_extents(entries: list[Occurrence], length: int, passage: int) -> list[tuple[int, int, int, int]]:
    """How far left and right of each entry's anchor strings of ``length`` bytes repeat, and passages of another document; zeros: nowhere."""
    extents = []
    for e in entries:
        size = len(e.left) + len(e.right)
        own = (len(e.left), len(e.right))
        extents.append([*(own if e.copies > 1 and size >= length else (0, 0)), *(own if e.documents[0] != e.documents[1] and size >= passage else (0, 0))])
    order = sorted(range(len(entries)), key=lambda i: entries[i].right)
    lcp = [common_prefix(entries[a].right, entries[b].right) for a, b in zip(order, order[1:], strict=False)]
    for right, first, last in prefix_intervals(lcp):
        members = sorted(order[first : last + 1], key=lambda i: entries[i].left)
        shared = [common_prefix(entries[a].left, entries[b].left) for a, b in zip(members, members[1:], strict=False)]
        for member, lefts in zip(members, neighbours([entries[i] for i in members], shared), strict=True):
            was = extents[member]
            for at, left, least in ((0, lefts[0], length), (2, lefts[1], passage)):
                if left + right >= least:
                    was[at], was[at + 1] = max(was[at], left), max(was[at + 1], right)
    return [tuple(e) for e in extents]


PARTS = "key long, ctx long, first int, last int, p_first int, p_last int"
BODIES = "key long, ctx long, n long, low long, high long, left int, crowded boolean, body binary"


def _resolved(bodies: DataFrame, length: int, passage: int) -> DataFrame:
    """The repeated part of each context (``first`` to ``last``) and its part in passages, from rows of ``BODIES``."""
    names = [c.split()[0] for c in PARTS.split(", ")]

    def settle(rows: list[tuple]) -> list[tuple]:
        extents = repeated_extents([Occurrence(b[left:], b[:left][::-1], n, (low, high)) for _, _, n, low, high, left, b in rows], length, passage)
        return [(r[0], r[1], r[5] - a, r[5] + z, r[5] - pa_, r[5] + pz) for r, (a, z, pa_, pz) in zip(rows, extents, strict=True) if z or pz]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*[batch[c] for c in ("key", "ctx", "n", "low", "high", "left", "body")], strict=True):
                if group and group[-1][0] != row[0]:
                    out += settle(group)
                    group = []
                group.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(settle(group) if group else [], columns=names)

    return bodies.repartition("key").sortWithinPartitions("key", "ctx").mapInPandas(run, PARTS)


def _resolved_crowded(bodies: DataFrame, length: int, passage: int, anchor: int) -> DataFrame:
    """As ``_resolved``, by counting the hashes of the strings that hold the anchor: no group meets in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, ctx, n, low, high, left, body in zip(*[batch[c] for c in ("key", "ctx", "n", "low", "high", "left", "body")], strict=True):
                for size in (length, passage):
                    at = np.arange(max(0, left + anchor - size), min(left, len(body) - size) + 1)
                    if len(at):
                        h = hash_spans(np.frombuffer(body, np.uint8), at, at + size).view(np.int64)
                        yield pd.DataFrame({"key": key, "ctx": ctx, "size": size, "at": at, "h": h, "n": n, "low": low, "high": high})

    strings = bodies.mapInPandas(run, "key long, ctx long, size int, at int, h long, n long, low long, high long")
    counted = strings.groupBy("key", "size", "h").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    twice = counted.where(((F.col("size") == length) & (F.col("n") > 1)) | ((F.col("size") == passage) & (F.col("low") < F.col("high")))).select("key", "size", "h")
    hit = strings.select("key", "ctx", "size", "at", "h").join(twice, ["key", "size", "h"], "left_semi")
    of = lambda size, c: F.when(F.col("size") == size, c)
    ends = [(size, F.min(of(size, F.col("at"))), F.max(of(size, F.col("at"))) + size) for size in (length, passage)]
    found = hit.groupBy("key", "ctx").agg(*[F.coalesce(c, F.lit(0)).cast("int").alias(n) for (_, lo, hi), names in zip(ends, (("first", "last"), ("p_first", "p_last")), strict=True) for c, n in zip((lo, hi), names, strict=True)])
    return found


def _with_bodies(contexts: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``BODIES``, whose bytes come from the text of the context's ``node``."""
    names = [c.split()[0] for c in BODIES.split(", ")][:-1]
    wanted = contexts.groupBy("node").agg(F.collect_list(F.struct(*names, "start", "size")).alias("wanted"))  # bounded by the text's length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                raw = text.encode()
                rows += [(*[w[c] for c in names], raw[w["start"] : w["start"] + w["size"]]) for w in wanted]
            yield pd.DataFrame(rows, columns=[*names, "body"])

    return docs.join(wanted, "node").select("text", "wanted").mapInPandas(run, BODIES)


def repeated_spans(docs: DataFrame, length: int = 400, passage: int = PASSAGE, anchor: int = ANCHOR, crowded: int = CROWDED) -> DataFrame:
    """``node, first, last, p_first, p_last``: byte ranges covered by strings that start elsewhere too, and by passages of other documents; ranges may overlap or be empty.

    ``docs``: node, text. Rows that repeat a node count as further occurrences in one document.
    """
    if passage > length:
        raise ValueError("a passage is no longer than a string to be removed")
    rows = materialize(anchored_contexts(docs, length, passage, anchor))
    distinct = rows.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.max("node").alias("high"), F.min(F.struct("node", "start", "left", "size")).alias("at"))
    groups = distinct.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1").select("key", "kinds")
    known = materialize(distinct.join(groups, "key").select("key", "ctx", "n", "high", "kinds", "at.*").withColumn("low", F.col("node")))
    bodies = materialize(_with_bodies(known.where("kinds > 1").withColumn("crowded", F.col("kinds") > crowded), docs))
    # All of a group's contexts are equal: they repeat as far as they reach.
    reach = lambda meets, least: F.when(meets & (F.col("size") >= least), F.col("size")).otherwise(0)
    alike = known.where("kinds = 1").select(
        "key", "ctx", F.lit(0).alias("first"), reach(F.lit(True), length).alias("last"), F.lit(0).alias("p_first"), reach(F.col("low") < F.col("high"), passage).alias("p_last")
    )
    partly = _resolved(bodies.where("not crowded"), length, passage).unionByName(_resolved_crowded(bodies.where("crowded"), length, passage, anchor))
    parts = alike.unionByName(partly).where("last > first or p_last > p_first")
    return rows.join(parts, ["key", "ctx"]).select("node", *[(F.col("start") + F.col(c)).alias(c) for c in ("first", "last", "p_first", "p_last")])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, touching ranges joined, empty ones left out."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if first == last:
            continue
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def without_repeats(docs: DataFrame, length: int = 400, passage: int = PASSAGE) -> DataFrame:
    """``doc_id, n_bytes, removed, shared (arrays of ranges), kept (binary)`` of every row of ``doc_id, text``.

    ``removed`` is covered by repeated strings of ``length`` bytes, ``shared``
    by passages that another document holds too. Null texts are empty. Texts
    shorter than ``passage`` bytes keep everything. All occurrences go, the
    first too; strings are judged on the input. Rows equal in id and text
    repeat each other but are one document.
    """
    docs = _keyed(docs)
    spans = repeated_spans(docs.select("node", "text"), length, passage)
    per_node = spans.groupBy("node").agg(F.collect_set(F.struct("first", "last", "p_first", "p_last")).alias("spans"))  # bounded by the text's length
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ranges = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, shared, kept = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                cut = merged([(s["first"], s["last"]) for s in spans or []])
                ends = [0, *[x for pair in cut for x in pair], len(raw)]
                n_bytes.append(len(raw))
                removed.append([{"first": a, "last": b} for a, b in cut])
                shared.append([{"first": a, "last": b} for a, b in merged([(s["p_first"], s["p_last"]) for s in spans or []])])
                kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, ranges), pa.array(shared, ranges), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "shared", "kept"],
            )

    joined = docs.join(per_node, "node", "left").select("doc_id", "text", "spans")
    listed = "array<struct<first:bigint,last:bigint>>"
    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, removed {listed}, shared {listed}, kept binary")


def op8_repeated_strings(docs: DataFrame) -> DataFrame:
    """Digest of every document without its repeated strings; ``n_shared`` counts the bytes in passages of ``PASSAGE`` bytes and more that another document holds too."""
    total = lambda ranges: F.aggregate(ranges, F.lit(0).cast("bigint"), lambda acc, r: acc + r["last"] - r["first"])
    return without_repeats(docs).select(
        "doc_id", "n_bytes", total("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), total("shared").alias("n_shared")
    )
