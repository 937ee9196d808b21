"""Hard negatives: for each anchor and positive, the best rows of other labels that score just under the positive.

A score is the inner product of integer vectors. Anchors are dealt into blocks
and each block is a tree, the least spanning tree of the anchors' distances.
Along an edge of length ``d`` a candidate's score changes by at most ``d`` times
the candidate's norm, so what is known of it at the parent, give or take that,
bounds it at the child. Only candidates whose bounds meet the child's window
are scored there exactly; the others pass their wider bounds on. The results
are those of scoring every pair.

Candidates are dealt into salts and every (block, salt) is one partition: the
block's anchors first, then the candidates, which stream past in slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.storage import materialize

SCALE = 256
#: Anchors of a block, about; candidates of a salt, at least and at most, about; candidates that are scored at once.
BLOCK_ANCHORS, LEAST_SALT, MOST_SALT, SLICE = 4096, 4096, 1 << 17, 2048
#: Sums of products under this are exact as doubles.
EXACT = 2.0**53
FAR = (1 << 63) - 1


def usable(embeddings: DataFrame) -> DataFrame:
    """``uid, vec_id, label, vector`` of the rows that take part, written down: label, vector and its components are known and finite."""
    known = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & known)
    return materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector")))


def matrix(vectors: pa.Array, dim: int, wide: bool) -> np.ndarray:
    """One row of floor(256 x) for each list, ended with zeros: doubles, or whole numbers of any size if ``wide``."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = values
    if not wide:
        return np.floor(out * SCALE)
    whole = np.empty(out.shape, object)
    whole.flat = [int(v) * SCALE if abs(v) > EXACT else int(np.floor(v * SCALE)) for v in out.flat]
    return whole


def spanning_forest(points: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A least spanning tree of each group, by Prim: order (parents before children, a child's subtree follows it), the parent's row or -1, the edge's length."""
    n = len(points)
    parent, edge = np.full(n, -1), np.zeros(n)
    order: list[int] = []
    square = (points * points).sum(axis=1)
    for group in pd.unique(groups):
        rows = np.flatnonzero(groups == group)
        own, norms = points[rows], square[rows]
        near, by, free = np.full(len(rows), np.inf), np.full(len(rows), -1), np.ones(len(rows), bool)
        at, children = 0, [[] for _ in rows]
        for _ in range(len(rows) - 1):
            free[at] = False
            apart = np.maximum(norms + norms[at] - 2 * (own @ own[at]), 0)
            closer = free & (apart < near)
            near[closer], by[closer] = apart[closer], at
            at = int(np.where(free, near, np.inf).argmin()) if np.isfinite(near[free]).any() else int(np.flatnonzero(free)[0])
            by[at] = max(by[at], 0)
            children[by[at]].append(at)
            parent[rows[at]], edge[rows[at]] = rows[by[at]], np.linalg.norm(own[at] - own[by[at]])
        stack = [0]
        while stack:
            k = stack.pop()
            order.append(int(rows[k]))
            stack.extend(reversed(children[k]))
    return np.array(order, np.int64), parent, edge


def scored(candidates: np.ndarray, anchors: np.ndarray, parents: np.ndarray, edges: np.ndarray, window: Callable[[int], tuple[float, float]], fits: Callable[[int], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor, in the order of its tree: the candidates that fit and can lie in its window, and their exact scores.

    ``parents`` are places in the order, -1 for roots. Of what is known at an anchor only the path to it is held.
    """
    norms = np.sqrt((candidates * candidates).sum(axis=1))
    path: list[tuple[int, np.ndarray, np.ndarray]] = []
    for k, anchor in enumerate(anchors):
        if parents[k] < 0:
            path = []
            middle, spread = candidates @ anchor, np.zeros(len(candidates))
            met = np.flatnonzero(fits(k))
        else:
            while path[-1][0] != parents[k]:
                path.pop()
            _, middle, spread = path[-1]
            # A little more than the bound makes up for rounding.
            middle, spread = middle.copy(), spread + edges[k] * norms * (1 + 1e-9) + 1e-3
            low, high = window(k)
            met = np.flatnonzero(fits(k) & (middle + spread >= low) & (middle - spread <= high))
            middle[met], spread[met] = candidates[met] @ anchor, 0
        path.append((k, middle, spread))
        yield k, met, middle[met]


def every_score(candidates: np.ndarray, anchors: np.ndarray, fits: Callable[[int], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same without bounds, for whole numbers of any size."""
    for k, anchor in enumerate(anchors):
        met = np.flatnonzero(fits(k))
        yield k, met, candidates[met] @ anchor


class Best:
    """The ``most`` best (score, id, uid) so far: higher scores first, then known and smaller ids, then smaller uids."""

    def __init__(self, most: int):
        self.most, self.rows = most, []

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray, uids: np.ndarray) -> None:
        if len(scores) > self.most:
            # Those under the last of the best scores can't be among the best.
            least = np.partition(scores, len(scores) - self.most)[len(scores) - self.most] if scores.dtype != object else sorted(scores)[-self.most]
            keep = scores >= least
            scores, ids, known, uids = scores[keep], ids[keep], known[keep], uids[keep]
        new = [(-int(s), not k, int(i), int(u)) for s, i, k, u in zip(scores, ids, known, uids, strict=True)]
        self.rows = sorted(self.rows + new)[: self.most]

    def least(self) -> float:
        """Scores under this can't be among the best."""
        return -self.rows[-1][0] if len(self.rows) == self.most else -np.inf


class Block:
    """The anchors of a partition, in their tree's order, and the slices of candidates that pass by."""

    def __init__(self, rows: list[pa.RecordBatch], dim: int, wide: bool):
        t = pa.Table.from_batches(rows).combine_chunks()
        self.uids, self.labels = t["uid"].to_numpy(), t["label"].to_numpy()
        self.points = matrix(t["vector"].combine_chunks(), dim, wide)
        self.parents, self.edges = t["parent"].to_numpy(), t["edge"].to_numpy()
        self.positives = t["positives"].to_pylist()
        self.wide = wide

    def passing(self, batch: pa.RecordBatch, dim: int, same: bool, window: Callable[[int], tuple[float, float]]) -> Iterator[tuple]:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            points = matrix(part.column("vector"), dim, self.wide)
            labels, uids = part.column("label").to_numpy(), part.column("uid").to_numpy()
            ids, known = part.column("vec_id").fill_null(0).to_numpy(), part.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            masks = {label: (labels == label) if same else (labels != label) for label in np.unique(self.labels)}
            fits = lambda k: masks[self.labels[k]] & (uids != self.uids[k])  # noqa: B023, E731
            found = every_score(points, self.points, fits) if self.wide else scored(points, self.points, self.parents, self.edges, window, fits)
            for k, met, scores in found:
                yield k, scores, ids[met], known[met], uids[met]


FOUND = pa.schema([("anchor", pa.int64()), ("positive", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("uid", pa.int64())])
FOUND_DDL = "anchor long, positive int, score long, vec_id long, uid long"


def _rows(best: Iterator[tuple[int, int, Best]]) -> pa.RecordBatch:
    rows = [(a, p, min(max(-s, -FAR), FAR), None if unknown else i, u) for a, p, b in best for s, unknown, i, u in b.rows]
    columns = list(zip(*rows, strict=True)) or [[]] * len(FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def _streamed(batches: Iterator[pa.RecordBatch], dim: int, wide: bool) -> Iterator[Block | pa.RecordBatch]:
    """A partition's block of anchors, then batches of its candidates; nothing if it has no anchors."""
    held: list[pa.RecordBatch] = []
    block = None
    for batch in batches:
        mine = batch.column("at").is_valid().to_numpy(zero_copy_only=False).sum()  # anchors come first
        if mine:
            held.append(batch.slice(0, mine))
        if mine < batch.num_rows and held:
            if block is None:
                block = Block(held, dim, wide)
                yield block
            yield batch.slice(mine)


def best_of_label(most: int, dim: int, wide: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each anchor's best candidates of its own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, []
        for item in _streamed(batches, dim, wide):
            if isinstance(item, Block):
                block, best = item, [Best(most) for _ in item.uids]
                continue
            for k, *columns in block.passing(item, dim, True, lambda k: (best[k].least(), np.inf)):
                best[k].add(*columns)
        if block is not None:
            yield _rows((int(u), 0, b) for u, b in zip(block.uids, best, strict=True))

    return run


def best_below(most: int, low: int, high: int, dim: int, wide: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each anchor's best candidates of other labels in the window of each of its positives: ``low`` to ``high`` percent of the positive's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, []

        def window(k: int) -> tuple[float, float]:
            # A positive's best so far raise its window's lower end.
            lows = [max(low * p / 100 - 1, b.least()) for p, b in best[k].items()]
            return min(lows, default=np.inf), max((high * p / 100 + 1 for p in best[k]), default=-np.inf)

        for item in _streamed(batches, dim, wide):
            if isinstance(item, Block):
                block = item
                # Of a negative positive the window is empty if its lower end is the higher.
                best = [{p: Best(most) for p in set(own) if low * p <= high * p} for own in block.positives]
                continue
            for k, scores, *columns in block.passing(item, dim, False, window):
                for p, b in best[k].items():
                    inside = (100 * scores >= low * p) & (100 * scores <= high * p)
                    inside = np.asarray(inside, bool)
                    b.add(scores[inside], *[c[inside] for c in columns])
        if block is not None:
            yield _rows((int(u), i, best[k][p]) for k, u in enumerate(block.uids) for i, p in enumerate(block.positives[k], 1) if p in best[k])

    return run


TREE = "uid long, vec_id long, label long, at int, parent int, edge double"


def with_trees(anchors: DataFrame, dim: int, by_label: bool) -> DataFrame:
    """The anchors of each block (``block``), placed in their trees: one for each label, or one for all."""

    def run(held: pd.DataFrame) -> pd.DataFrame:
        points = np.zeros((len(held), dim))
        for i, v in enumerate(held["vector"]):
            points[i, : len(v)] = np.floor(np.asarray(v, np.float64) * SCALE)
        order, parent, edge = spanning_forest(points, held["label"].to_numpy() if by_label else np.zeros(len(held)))
        place = np.empty(len(held), np.int64)
        place[order] = np.arange(len(held))
        out = held.drop(columns="vector").assign(at=place, parent=np.where(parent < 0, -1, place[parent]), edge=edge)
        return out[["block", *[c.split()[0] for c in TREE.split(", ")]]]

    placed = anchors.select("block", "uid", "vec_id", "label", "vector").groupBy("block").applyInPandas(run, f"block int, {TREE}")
    return anchors.select("uid", "vector").join(placed, "uid")


def dealt(candidates: DataFrame, anchors: DataFrame, blocks: int, salts: int) -> DataFrame:
    """One partition for each block and salt: the block's anchors in their trees' order, then the salt's candidates."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    salt = F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    theirs = candidates.select("uid", "vec_id", "label", "vector", none("at", "int"), none("parent", "int"), none("edge", "double"), none("positives", "array<long>"), salt.alias("salt"), every.alias("block"))
    ours = anchors.select("uid", "vec_id", "label", "vector", "at", "parent", "edge", "positives", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "block")
    place = (F.col("block") * salts + F.col("salt")).alias("place")
    rows = ours.unionByName(theirs).select("*", place).repartitionById(blocks * salts, F.col("place"))
    return rows.sortWithinPartitions(F.col("at").asc_nulls_last(), "uid").drop("salt", "block", "place")


def mined(embeddings: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of ``vec_id, embedding, label`` rows: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a null label or vector, or a null or non-finite component, take no part; null ids do, are never anchors and
    come last of a tie. Repeated rows are rows of their own, so an anchor's copy is one of its positives. Shorter vectors are ended
    with zeros. An empty table, and one without anchors, has no result. Scores that need more than 64 bits are compared
    whole and printed as the greatest number. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    size = rows.agg(
        F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), F.count(F.when(anchor, 1)).alias("anchors"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))).alias("most"),
    ).first()
    dim, wide = max(size["dim"] or 0, 1), max(size["dim"] or 0, 1) * (SCALE * (size["most"] or 0.0) + 1) ** 2 >= EXACT
    blocks = max(1, -(-size["anchors"] // BLOCK_ANCHORS))
    wanted = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    salts = max(1, min(wanted, -(-size["n"] // LEAST_SALT)), -(-size["n"] // MOST_SALT))
    anchors = rows.where(anchor).withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    best = Window.partitionBy("anchor", "positive").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")

    own = with_trees(anchors, dim, True).withColumn("positives", F.lit(None).cast("array<long>"))
    first = dealt(rows, own, blocks, salts).mapInArrow(best_of_label(positives, dim, wide), FOUND_DDL)
    chosen = materialize(first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives).select("anchor", F.col("rank").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    scores = chosen.groupBy(F.col("anchor").alias("uid")).agg(F.sort_array(F.collect_list(F.struct("positive", "positive_score"))).alias("own"))
    of_all = with_trees(anchors, dim, False).join(scores.select("uid", F.col("own.positive_score").alias("positives")), "uid", "left").withColumn("positives", F.coalesce("positives", F.array().cast("array<long>")))
    second = dealt(rows, of_all, blocks, salts).mapInArrow(best_below(negatives, low, high, dim, wide), FOUND_DDL)
    ranked = second.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    ids = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(chosen, ["anchor", "positive"]).join(ids, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The digest of the registered query: labels of ids divisible by 7 are moved on by one, anchors are the ids divisible by 100."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mined(embeddings.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


#: Every anchor against every row.
OP11_SQL = """WITH e AS (SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.u AS a, a.vec_id AS anchor_id, b.u, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.u <> b.u),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, u) AS positive FROM s WHERE same QUALIFY positive <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.positive ORDER BY s.score DESC, s.vec_id, s.u) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n"""
