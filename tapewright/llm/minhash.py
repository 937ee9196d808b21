"""Near-duplicate documents by DartMinHash signatures and a banded join.

A document is a weighted set: its five-word shingles, weighted by how often
they occur. It is also a plain set of them, with a signature of its own where
a shingle repeats; the larger of both likenesses counts. Every shingle owns a region of weight by rank into which darts fall
at random, one for each unit of area, the same ones in every document. A
document is hit by the darts below its weights, up to the rank at which enough
have hit it; each dart belongs to one coordinate by its hash, and the earliest
dart of each coordinate is the signature. Two documents agree in a coordinate
with the probability of their weighted Jaccard likeness.

Documents that agree in all coordinates of a band meet in a bucket. Those that
agree in two bands in a row are compared with the first of these by a hash, then
those of buckets that still hold several classes with their bucket's first and
last, so groups of copies cost pairs by their documents and not by their
square. In buckets that hold several classes after that, all texts of
different classes are compared, in blocks, by signatures and then by their
shingles. Where the signatures of other pairs leave a doubt about the
threshold, the shingles decide too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.components import components
from tapewright.llm.shingles import STEP, U64, mix, shingle_hashes, slices, word_hashes
from tapewright.llm.storage import materialize, unused

BANDS, ROWS = 24, 5
#: Estimates nearer to the threshold than this are settled by the shingles: over three standard errors of 120 coordinates.
DOUBT = 0.12
#: Parts into which the copies of a text are dealt where they are joined.
SALTS = 8
#: Texts that share a token and are joined with each other in one part.
BLOCK = 1024
TURN, PLACE = U64(0xA24BAED4963EE407), U64(0x5851F42D4C957F2D)


def _uniform(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((h >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n by k) of n weighted sets given as (owner, element hash, weight) triples without repeats.

    The region of an element is cut into cells one unit of weight wide. In a
    cell darts come as a Poisson process along the rank; their hashes depend on
    the element, the cell and their turn alone. A set of total weight W is
    thrown up to rank T/W, T a little over k ln k, and further by doubling while
    a coordinate is empty. Sets without weight have zeros.
    """
    signature = np.zeros((n, k), U64)
    whole = np.ceil(weight).astype(np.int64)
    cell_owner = np.repeat(owner, whole)
    cell_at = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    cell = mix(np.repeat(element, whole) + cell_at.astype(U64) * STEP)
    cell_width = np.minimum(np.repeat(weight, whole) - cell_at, 1.0)
    total = np.bincount(owner, weight, n)
    bound = np.where(total > 0, (k * (np.log(k) + 2)) / np.maximum(total, 1e-300), 0.0)
    best = np.full(n * k, np.inf)
    value = signature.reshape(-1)
    dart, rank, turn = np.zeros(len(cell), U64), np.zeros(len(cell)), np.zeros(len(cell), np.int64)

    def throw(cells: np.ndarray) -> None:
        """The next dart of each cell."""
        turn[cells] += 1
        dart[cells] = mix(cell[cells] + turn[cells].astype(U64) * TURN)
        rank[cells] -= np.log(_uniform(dart[cells]))

    def near(cells: np.ndarray) -> np.ndarray:
        return cells[rank[cells] <= bound[cell_owner[cells]]]

    cells = np.arange(len(cell))
    throw(cells)
    while len(cells):
        live = near(cells)
        while len(live):
            thrown = mix(dart[live] ^ PLACE)
            hit = live[(cell_width[live] >= 1.0) | (_uniform(mix(thrown + STEP)) <= cell_width[live])]
            thrown = thrown if len(hit) == len(live) else mix(dart[hit] ^ PLACE)
            slot = cell_owner[hit] * k + (thrown % U64(k)).astype(np.int64)
            np.minimum.at(best, slot, rank[hit])
            first = rank[hit] == best[slot]
            value[slot[first]] = thrown[first]
            throw(live)
            live = near(live)
        unfilled = np.isinf(best.reshape(n, k)).any(axis=1) & (total > 0)
        bound[unfilled] *= 2
        cells = cells[unfilled[cell_owner[cells]]]
    return signature


def weighted_shingles(column: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count), sorted by row and hash."""
    rows, h = shingle_hashes(*word_hashes(column), n)
    if not len(h):
        return rows, h, np.zeros(0)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])])
    return rows[first], h[first], np.diff(np.r_[first, len(h)]).astype(np.float64)


def text_key(text: Column) -> Column:
    """The MD5 digest by which equal texts are one node; no bytes for a null text."""
    return F.when(text.isNull(), F.lit(b"")).otherwise(F.unhex(F.md5(text.cast("binary"))))


def signed_texts(docs: DataFrame, n: int, k: int) -> DataFrame:
    """``doc_id, text_key, plain, counted`` of ``doc_id, text`` rows whose text isn't null; no signatures for texts without words.

    ``plain`` is of the shingles with weight 1, ``counted`` of their counts; the latter is null where no shingle repeats, as both are equal then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, h, count = weighted_shingles(part.column("text"), n)
                full = np.isin(np.arange(part.num_rows), rows)
                repeats = np.isin(np.arange(part.num_rows), rows[count > 1])
                again = repeats[rows]
                plain = dart_signatures(rows, h, np.ones(len(rows)), part.num_rows, k).astype("<u4")
                counted = dart_signatures(rows[again], h[again], count[again], part.num_rows, k).astype("<u4")
                out = [pa.array([x.tobytes() if f else None for x, f in zip(s, some, strict=True)], pa.binary()) for s, some in ((plain, full), (counted, repeats))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), *out], names=["doc_id", "text_key", "plain", "counted"]
                )

    keyed = docs.where("text is not null").select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return keyed.mapInArrow(run, "doc_id long, text_key binary, plain binary, counted binary")


def bucketed(signatures: DataFrame, bands: int, rows: int) -> DataFrame:
    """``node, band, bucket, finer``: each signature's bands, and each band with the one that follows; of both signatures, in the same buckets."""
    width = 4 * rows

    def made(signature):
        def band(i):
            return F.substring(signature, i * width + 1, F.lit(width))

        return F.transform(
            F.sequence(F.lit(0), F.lit(bands - 1)),
            lambda i: F.struct(i.alias("band"), F.xxhash64(i, band(i)).alias("bucket"), F.xxhash64(i, band(i), band((i + 1) % bands)).alias("finer")),
        )

    both = F.when(F.col("counted").isNull(), made("plain")).otherwise(F.array_union(made("plain"), made("counted")))
    return signatures.select("node", F.explode(both).alias("b")).select("node", "b.band", "b.bucket", "b.finer")


def star_pairs(buckets: DataFrame, key: str, seed: int, ends: tuple[str, ...] = ("low", "high")) -> DataFrame:
    """Each node of a bucket with the bucket's first and last by a hash of the node, or one of these."""
    order = F.xxhash64(F.lit(seed), "node")
    known = (
        buckets.groupBy(key)
        .agg(F.min(F.struct(order.alias("o"), "node"))["node"].alias("low"), F.max(F.struct(order.alias("o"), "node"))["node"].alias("high"))
        .where("low <> high")
    )
    met = buckets.select(key, "node").join(known, key)
    other = F.explode(F.array(*ends)) if len(ends) > 1 else F.col(ends[0])
    return met.select("node", other.alias("other")).where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def set_tokens(shingles: DataFrame, open_nodes: DataFrame) -> DataFrame:
    """``node, component, token, again, distinct, whole``: every shingle, and every further turn of one, with both sizes of its text."""

    def marked(column: str, again: bool) -> Column:
        return F.transform(column, lambda h: F.struct(h.alias("token"), F.lit(again).alias("again")))

    sized = shingles.join(open_nodes, "node").select(
        "node", "component", F.size("first").alias("distinct"), (F.size("first") + F.size("again")).alias("whole"), F.concat(marked("first", False), marked("again", True)).alias("tokens")
    )
    return sized.select("node", "component", "distinct", "whole", F.inline("tokens"))


def prefix_marks(tokens: DataFrame, threshold: float) -> DataFrame:
    """``kind, token, at, size, node, component, repeats``: the tokens by which a text can meet one of another class.

    Kind 0 are the shingles, kind 1 these and their further turns. Tokens that
    one class alone holds can't be shared across classes: they come first in the
    order and give no rows. The others go from rare to common. Of ``size`` tokens
    in that order, the first ``size - ceil(threshold * size) + 1`` hold one that
    is shared with any set of the wanted likeness.
    """
    shared = tokens.groupBy("token").agg(F.count("*").alias("held"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token", "held")
    lists = tokens.join(shared, "token").groupBy("node", "component", "distinct", "whole").agg(F.sort_array(F.collect_list(F.struct("held", "token", "again"))).alias("live"))

    def rows(kind: int, live: Column, size: str) -> Column:
        own = F.col(size) - F.size(live)  # tokens of its class alone
        most = F.col(size) - F.ceil(threshold * F.col(size) - 1e-9) + 1 - own
        chosen = F.slice(live, F.lit(1), F.greatest(most, F.lit(0)).cast("int"))
        return F.transform(chosen, lambda t, i: F.struct(F.lit(kind).alias("kind"), t["token"].alias("token"), (own + i).alias("at"), F.col(size).alias("size")))

    both = F.concat(rows(0, F.filter("live", lambda t: ~t["again"]), "distinct"), rows(1, F.col("live"), "whole"))
    return lists.select("node", "component", (F.col("distinct") < F.col("whole")).alias("repeats"), F.inline(both))


def prefix_pairs(open_nodes: DataFrame, shingles: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``a, b, class_a, class_b, met``: pairs of different classes that may reach the threshold, and in how many tokens they met.

    ``open_nodes``: node, component, without repeats; ``shingles``: as of
    ``counted_shingles``. An exact set-similarity join with prefix, length and
    positional filters, once for plain and once for weighted likeness; no pair
    that reaches the threshold is missed. A token that many texts hold is dealt
    to parts of about ``block`` of them; only numbers are copied.
    """
    marks = materialize(prefix_marks(set_tokens(shingles, open_nodes), threshold))
    crowd = marks.groupBy("kind", "token").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"), F.max("repeats").alias("any"))
    # Without repeats on either side both likenesses are the same.
    useful = crowd.where("x <> y AND (kind = 0 OR any)").select("kind", "token", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = marks.join(useful, ["kind", "token"])

    def side(name: str, part: Column) -> DataFrame:
        return dealt.select("kind", "token", part.alias("part"), *[F.col(c).alias(f"{c}_{name}") for c in ("node", "component", "at", "size", "repeats")])

    left = side("a", F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts")).cast("int"))
    right = side("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # From the first shared token on, what is left of both lists must reach the least overlap.
    least = threshold / (1 + threshold) * (F.col("size_a") + F.col("size_b")) - 1e-9
    left_over = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    near_size = F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9
    met = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & ((F.col("kind") == 0) | F.col("repeats_a") | F.col("repeats_b"))
    pairs = left.join(right, ["kind", "token", "part"]).where(met & near_size & (left_over >= least))
    return pairs.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("component_a").alias("class_a"), F.col("component_b").alias("class_b")).agg(F.count("*").alias("met"))


def settled(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose likeness, plain or weighted, reaches the threshold by their shingles."""
    known_a, known_b = (shingles.select(F.col("node").alias(s), F.col("first").alias(f"first_{s}"), F.col("again").alias(f"again_{s}")) for s in "ab")
    return pairs.select("a", "b").join(known_a, "a").join(known_b, "b").where(F.greatest(*shared_sizes()) >= threshold).select("a", "b")


def links_across(open_nodes: DataFrame, shingles: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``a, b``: links that join all open texts of a likeness of at least ``threshold`` into the same classes.

    Of every two classes the pair that met most often is settled first. What
    that joins needs no other link, so only the pairs of classes that are still
    apart are settled after it, all of them.
    """
    pairs = materialize(prefix_pairs(open_nodes, shingles, threshold, block))
    best = pairs.groupBy(F.least("class_a", "class_b").alias("x"), F.greatest("class_a", "class_b").alias("y")).agg(F.max(F.struct("met", "a", "b", "class_a", "class_b")).alias("p")).select("p.*")
    tried = materialize(best)
    found = materialize(settled(tried, shingles, threshold))
    joined = components(tried.join(found, ["a", "b"]).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    now = materialize(joined)
    of_a, of_b = (now.select(F.col("node").alias(f"class_{s}"), F.col("component").alias(f"now_{s}")) for s in "ab")
    rest = pairs.join(of_a, "class_a", "left").join(of_b, "class_b", "left").where(F.coalesce("now_a", "class_a") != F.coalesce("now_b", "class_b"))
    untried = rest.select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti")
    return found.unionByName(materialize(settled(untried, shingles, threshold)))


@F.pandas_udf(T.DoubleType())
def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
    """The share of coordinates in which two signatures agree."""
    a = np.frombuffer(b"".join(x), "<u4").reshape(len(x), -1)
    b = np.frombuffer(b"".join(y), "<u4").reshape(len(y), -1)
    return pd.Series((a == b).mean(axis=1))


def shared_sizes() -> tuple[Column, Column]:
    """Of joined shingle lists of both sides: the plain and the weighted Jaccard likeness."""
    first = F.size(F.array_intersect("first_a", "first_b"))
    again = F.size(F.array_intersect("again_a", "again_b"))
    distinct, repeats = F.size("first_a") + F.size("first_b"), F.size("again_a") + F.size("again_b")
    return first / (distinct - first), (first + again) / (distinct + repeats - first - again)


def counted_shingles(docs: DataFrame, n: int) -> DataFrame:
    """``node, first, again``: the distinct shingles, and a hash of shingle and turn for every further occurrence.

    The two lists together are a set whose plain likeness is the weighted one.
    """

    def lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, h, count = weighted_shingles(part.column("text"), n)
                more = count.astype(np.int64) - 1
                turn = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                again = mix(np.repeat(h, more) + (turn + 2).astype(U64) * STEP)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), lists(h, rows, part.num_rows), lists(again, np.repeat(rows, more), part.num_rows)], names=["node", "first", "again"]
                )

    return docs.mapInArrow(run, "node long, first array<bigint>, again array<bigint>")


def node_shingles(nodes: DataFrame, signatures: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """``counted_shingles`` of some nodes: of each by one text, that with the least id, and of copies of one id any."""
    wanted = signatures.select("node", "least_id", F.col("text_key").alias("key")).join(nodes, "node")
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("text_key") == F.col("key"))).dropDuplicates(["node"]).select("node", "text")
    return counted_shingles(texts, n)


def verified_links(pairs: DataFrame, signatures: DataFrame, docs: DataFrame, threshold: float, n: int) -> DataFrame:
    """The pairs whose likeness reaches the threshold: by their signatures where these leave no doubt, else by their shingles."""

    def sides(df: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
        return tuple(df.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols]) for side in "ab")

    of_a, of_b = sides(signatures, "plain", "counted")
    plain = agreement("plain_a", "plain_b")
    counted = agreement(F.coalesce("counted_a", "plain_a"), F.coalesce("counted_b", "plain_b"))
    repeats = F.col("counted_a").isNotNull() | F.col("counted_b").isNotNull()
    estimated = materialize(
        pairs.join(of_a, "a").join(of_b, "b").select("a", "b", F.when(repeats, F.greatest(plain, counted)).otherwise(plain).alias("near")).where(F.col("near") >= threshold - DOUBT)
    )
    sure = estimated.where(F.col("near") >= threshold + DOUBT).select("a", "b")
    doubtful = estimated.where(F.col("near") < threshold + DOUBT).select("a", "b")
    nodes = doubtful.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return materialize(sure.unionByName(settled(doubtful, materialize(node_shingles(nodes, signatures, docs, n)), threshold)))


def still_open(buckets: DataFrame, classes: DataFrame, compared: int) -> DataFrame:
    """``node, band, bucket, finer, component`` of the buckets with several classes and more than ``compared`` nodes."""
    classed = buckets.join(classes, buckets["node"] == classes["of"], "left").select("node", "band", "bucket", "finer", F.coalesce("component", "node").alias("component"))
    several = classed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"))
    # All pairs of up to three nodes were compared with their bucket's first and last.
    return classed.join(several.where("x <> y").where(F.col("size") > compared).select("bucket"), "bucket", "left_semi")


def near_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, rounds: int = 2) -> DataFrame:
    """``doc_id, text_key, class_id, kept`` of every row of ``doc_id`` (cast to long), ``text``.

    A class is a connected component of texts linked by a likeness of at least
    ``threshold``. Equal texts are one node, whatever their ids, so copies cost
    no pairs. ``class_id`` is the class's least doc_id, null where none of its
    rows has an id; ``kept`` marks the rows with that id and one text of the
    class. Null texts are alone in their class; empty texts are equal texts,
    and texts without words link to none but their equals. Rows that repeat an
    id are classed by their own texts. After the rounds of firsts and lasts, two
    at least, the texts of buckets that still hold several classes are joined
    exactly, whichever buckets they share. Very long texts are read whole; an
    empty table has no rows; columns other than ``doc_id`` and ``text`` are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(signed_texts(docs, n, bands * rows))
    # Distinct texts get short numbers, which hold once they are written down.
    nodes = materialize(
        signed.groupBy("text_key")
        .agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("plain").alias("plain"), F.first("counted").alias("counted"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    signatures = nodes.where("plain is not null")
    buckets = bucketed(signatures, bands, rows)
    links: DataFrame | None = None
    classes: DataFrame | None = None
    for turn in range(rounds + 1):
        if turn < rounds:
            open_buckets = buckets if classes is None else materialize(still_open(buckets, classes, 0))
            # Close copies first, each with one other a band, so that large groups of them are one class before looser buckets are looked at.
            pairs = star_pairs(open_buckets, "finer", turn, ("low",)) if turn == 0 else star_pairs(open_buckets, "bucket", turn)
            if classes is not None:
                known_a, known_b = (classes.select(F.col("of").alias(s), F.col("component").alias(f"class_{s}")) for s in "ab")
                joined = pairs.join(known_a, "a", "left").join(known_b, "b", "left")
                pairs = joined.where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b")
            found = verified_links(pairs, signatures, docs, threshold, n)
        else:
            open_nodes = materialize(still_open(buckets, classes, 3).select("node", "component").distinct())
            shingles = materialize(node_shingles(open_nodes.select("node"), signatures, docs, n))
            found = links_across(open_nodes, shingles, threshold)
        links = found if links is None else links.unionByName(found)
        classes = materialize(components(links).withColumnRenamed("node", "of"))
    # Texts with neither copies nor links are their own class and need no join.
    joined = nodes.select("node", "text_key", "least_id", "copies").join(classes, F.col("node") == F.col("of"), "left").where("copies > 1 or component is not null")
    joined = joined.withColumn("component", F.coalesce("component", "node"))
    first = F.struct(F.col("least_id").isNull().alias("none"), "least_id", "node")
    leaders = joined.groupBy("component").agg(F.min(first).alias("first")).select("component", F.col("first.least_id").alias("class_id"), F.col("first.node").alias("leader"))
    # A text with very many copies meets its class in several tasks.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    known = joined.join(leaders, "component").select("text_key", F.lit(True).alias("known"), "class_id", (F.col("node") == F.col("leader")).alias("leads"), salts.alias("salt"))
    members = signed.select("doc_id", "text_key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    kept = F.when(F.col("known"), F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("leads")).otherwise(True)
    found = members.join(known, ["text_key", "salt"], "left").select("doc_id", "text_key", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), kept.alias("kept"))
    alone = docs.where("text is null").select("doc_id", text_key(F.col("text")).alias("text_key"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies, with all columns of ``docs``; rows equal in id and text are one document."""
    kept = near_classes(docs.select("doc_id", "text")).where("kept").select("doc_id", "text_key").distinct()
    key, kept_id, kept_key = unused(docs, "text_key", "kept_id", "kept_key")
    chosen = kept.select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key))
    met = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key))
    return docs.withColumn(key, text_key(F.col("text"))).join(chosen, met, "left_semi").dropDuplicates(["doc_id", key]).drop(key)


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, class_id, kept`` of every row; see ``near_classes``."""
    return near_classes(docs, n, threshold).select("doc_id", "class_id", "kept")


def op6_near_duplicates(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
