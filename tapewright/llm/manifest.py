"""A Merkle manifest of a dataset: one tree a language, a root over the trees, a witness for each row.

A node is the SHA-256, as lowercase hex text, of its children's hex texts; a
run of two at each level, the last run may be of one. A row's witness lists its
siblings from the leaf to the root; with the leaf it gives the root again, so
a changed row is found by its witness alone.

Witnesses grow as nodes are appended: an append opens a subtree of one node.
Two open subtrees of one height complete each other: each one's node extends
the witnesses of all rows in the other. The tree is cut into aligned blocks of
leaves. The blocks' roots are appended to trees of their own in the same way,
and what a block root gathers there extends the witnesses of the block's rows.
So no task holds more than a block, and what is left to the next round is a
2**bits-th of the round before.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tapewright.llm.storage import materialize

#: Leaves of a block: two to this power.
BLOCK_BITS = 12
#: A level at which a node stands alone.
ALONE = "."


def node_of(*children: str) -> str:
    return sha256("".join(children).encode()).hexdigest()


class Witnesses:
    """Aligned appends with partial witnesses: ``paths[i]`` holds the siblings of the i-th node so far, as ``L`` or ``R`` and the node."""

    def __init__(self) -> None:
        self.paths: list[list[str]] = []
        #: Open subtrees, left to right: height, node, first and end of its appended nodes.
        self.open: list[tuple[int, str, int, int]] = []

    def append(self, node: str) -> None:
        at = len(self.paths)
        self.paths.append([])
        self.open.append((0, node, at, at + 1))
        self._complete()

    def _complete(self) -> None:
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            (height, right, cut, end), (_, left, first, _) = self.open.pop(), self.open.pop()
            for path in self.paths[first:cut]:
                path.append(f"R{right}")
            for path in self.paths[cut:end]:
                path.append(f"L{left}")
            self.open.append((height + 1, node_of(left, right), first, end))

    def finished(self, height: int | None = None) -> str:
        """Close the tree, up to a height if one is given, and return its root."""
        while len(self.open) > 1 or (height is not None and self.open[0][0] < height):
            low, node, first, end = self.open.pop()
            for path in self.paths[first:end]:
                path.append(ALONE)
            self.open.append((low + 1, node_of(node), first, end))
            self._complete()
        return self.open[0][1]


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its witness give."""

    def step(node: Column, sibling: Column) -> Column:
        other = F.substring(sibling, 2, 64)
        children = F.when(sibling == ALONE, node).when(F.startswith(sibling, F.lit("L")), F.concat(other, node))
        return F.sha2(children.otherwise(F.concat(node, other)).cast("binary"), 256)

    return F.aggregate(siblings, leaf, step)


def proof_text(siblings: Column) -> Column:
    """The siblings' hex texts, joined from leaf to root."""
    return F.array_join(F.transform(F.filter(siblings, lambda s: s != ALONE), lambda s: F.substring(s, 2, 64)), "")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[tuple], list[str], list[str]]]:
    """Block by block: tree, block, the tree's count of nodes, its (rank, node, payload) in order, and the block root's own siblings and tops."""
    names = ("tree", "block", "count", "rank", "node", "payload", "siblings", "tops")
    key, count, nodes, above, tops = None, 0, [], [], []
    for batch in batches:
        for tree, block, n, rank, node, payload, siblings, over in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if (tree, block) != key:
                if nodes:
                    yield *key, count, nodes, above, tops
                key, nodes, above, tops = (tree, block), [], [], []
            if node is None:
                above, tops = siblings, over
            else:
                count = n
                nodes.append((rank, node, payload))
    if nodes:
        yield *key, count, nodes, above, tops


def _tree_of(nodes: list[tuple], count: int, bits: int) -> tuple[str, list[list[str]]]:
    grown = Witnesses()
    for _, node, _ in nodes:
        grown.append(node)
    return grown.finished(bits if count > 1 << bits else None), grown.paths


def _by_block(nodes: DataFrame, bits: int, above: DataFrame | None = None) -> DataFrame:
    """A block's rows together and in order; the row that tells what is above the block comes first."""
    texts = F.lit(None).cast("array<string>")
    rows = nodes.select("tree", F.shiftright("rank", bits).alias("block"), "count", "rank", "node", "payload", texts.alias("siblings"), texts.alias("tops"))
    if above is not None:
        absent = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("count", "rank", "node", "payload")]
        rows = rows.unionByName(above.select("tree", F.col("rank").alias("block"), *absent, "siblings", "tops"))
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("node").isNotNull(), "rank")


def block_roots(nodes: DataFrame, bits: int) -> DataFrame:
    """The roots of a table's blocks, as nodes of the round above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, count, held, _, _ in _streamed(batches):
            root, _ = _tree_of(held, count, bits)
            values = (tree, block, -(-count >> bits), root, None)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["tree", "rank", "count", "node", "payload"])

    return _by_block(nodes, bits).mapInArrow(run, "tree string, rank long, count long, node string, payload int")


def extended(nodes: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """``tree, rank, payload, siblings, tops``: each node's witness in its block, extended by what its block root has gathered above."""
    payload = nodes.schema["payload"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, _, count, held, over, tops in _streamed(batches):
            _, paths = _tree_of(held, count, bits)
            texts = pa.list_(pa.string())
            ranks, _, payloads = zip(*held, strict=True)
            columns = [pa.array([tree] * len(held)), pa.array(ranks, pa.int64()), pa.array(payloads, to_arrow_type(payload))]
            columns += [pa.array([path + over for path in paths], texts), pa.array([tops] * len(held), texts)]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "rank", "payload", "siblings", "tops"])

    schema = f"tree string, rank long, payload {payload.simpleString()}, siblings array<string>, tops array<string>"
    return _by_block(nodes, bits, above).mapInArrow(run, schema)


def raised(nodes: DataFrame, most: int, bits: int) -> list[DataFrame]:
    """The nodes (``tree, rank, count, node, payload``) and the block roots of each round, up to one root a tree; ``most`` is
    the greatest count of a tree's nodes. Ranks are gapless from 0 in a tree of ``count`` nodes."""
    tables = [nodes, materialize(block_roots(nodes, bits))]
    while most > 1 << bits:
        most = -(-most >> bits)
        tables.append(materialize(block_roots(tables[-1], bits)))
    return tables


def lowered(tables: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """The witnesses of the first table's nodes; ``above`` (``tree, rank, siblings, tops``) has those of the last one's."""
    for nodes in reversed(tables[:-1]):
        above = extended(nodes, above, bits)
    return above


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows of ``tree`` and others, written down with ``rank``, gapless from 0 by ``order`` in each tree, and ``count``, the tree's rows.

    Rows are dealt to ranges of (tree, order); rows that are equal in it come as they are read and may lie in
    several ranges. One row for each tree in a range is combined over the table.
    """
    by = [F.col("tree"), *order]
    spread = rows.withColumn("read_at", F.monotonically_increasing_id())
    placed = spread.repartitionByRange(*by, F.col("read_at")).sortWithinPartitions(*by, "read_at")
    placed = materialize(placed.drop("read_at").withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)))
    own = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("held"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("held").over(earlier), F.lit(0))
    starts = own.select("tree", "part", "first", before.alias("before"), F.sum("held").over(Window.partitionBy("tree")).alias("count"))
    rank = F.col("place") - F.col("first") + F.col("before")
    return placed.join(starts, ["tree", "part"]).withColumn("rank", rank).drop("place", "part", "first", "before")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    """The hash of a row's fields; each is ``-`` if null, else its UTF-8 bytes' number, a colon and the value."""
    return F.sha2(F.concat(*[_field(f) for f in fields]).cast("binary"), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """``doc_id, lang, leaf, changed_leaf, siblings, subroot, root`` for every row of ``doc_id, source, lang, n_chars, text``.

    Trees are of one language each, null is one of them; leaves ascend by doc_id, nulls first, rows of one id by their
    hash. ``changed_leaf`` has ``n_chars`` as ``tampered`` gives it. Nulls in any field are values of their own; empty and
    very long texts are hashed whole; equal rows are leaves of their own; an empty table has no rows; other columns are
    ignored. ``siblings`` runs from the leaf over the language's root to the dataset's.
    """
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    hashed = lambda n: leaf_of(*[n if f == "n_chars" else F.col(f) for f in fields])
    # The null language's name is empty, others follow by their bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree")
    changed = F.col("n_chars") if tampered is None else tampered
    leaves = docs.select("doc_id", "lang", tree, hashed(F.col("n_chars")).alias("leaf"), hashed(changed).alias("changed_leaf"))
    numbered = materialize(ranked(leaves, F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("changed_leaf")))
    most = numbered.agg(F.max("count")).first()[0] or 0
    rows = numbered.select("tree", "rank", "count", F.col("leaf").alias("node"), F.struct("doc_id", "lang", "leaf", "changed_leaf").alias("payload"))
    trees = raised(rows, most, bits)
    subroots = ranked(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), F.col("name"))
    over = raised(materialize(subroots.select("tree", "rank", "count", "node", F.struct("name", "node").alias("payload"))), trees[-1].count(), bits)
    top = over[-1].select("tree", "rank", F.array().cast("array<string>").alias("siblings"), F.array("node").alias("tops"))
    of_subroots = materialize(lowered(over, top, bits))
    above = of_subroots.select(F.col("payload.name").alias("tree"), F.lit(0).cast("long").alias("rank"), "siblings", F.concat(F.array("payload.node"), "tops").alias("tops"))
    return lowered(trees, above, bits).select("payload.*", "siblings", F.col("tops")[0].alias("subroot"), F.col("tops")[1].alias("root"))


def op13_merkle_manifest(docs: DataFrame) -> DataFrame:
    """Every row's leaf, roots and proof, and the root folded from its tampered copy: 1 is added to ``n_chars`` where 7 divides the id's CRC-32."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(hit, F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))
    rows = manifest(docs, tampered).withColumn("folded_root", folded(F.col("changed_leaf"), F.col("siblings")))
    proof = F.sha2(proof_text(F.col("siblings")).cast("binary"), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
