"""The Merkle manifest against trees built level by level."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tapewright.llm import manifest as mf

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, add=0):
    doc_id, text, lang, source, n_chars = row
    return h(*map(field, (doc_id, source, lang, n_chars if n_chars is None else n_chars + add, text)))


def tree(nodes):
    """The root, and each leaf's run at every level as (siblings before, siblings after)."""
    level, at, paths = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 2 * 2 : p // 2 * 2 + 2]
            paths[i].append((run[: p % 2], run[p % 2 + 1 :]))
        level = [h(*level[j : j + 2]) for j in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], paths


def expected(data):
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    langs = sorted({r[2] for r in data}, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: sorted((r for r in data if r[2] == lang), key=order) for lang in langs}
    trees = {lang: tree([leaf(r) for r in rows]) for lang, rows in built.items()}
    root, over = tree([trees[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for r, path in zip(built[lang], trees[lang][1], strict=True):
            whole = path + over[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1 if hit else 0)
            for before, after in whole:
                node = h(*before, node, *after)
            proof = h(*[x for before, after in whole for x in (*before, *after)])
            out.append((r[0], leaf(r), trees[lang][0], root, proof, node, node == root))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def made(rows, seed=1):
    draw = random.Random(seed)
    return [(i * 3 - 50, "".join(draw.choices("añ漢 \n", k=draw.randrange(40))), draw.choice(["en", "de", "é", None, ""]), draw.choice(["s", None]), draw.choice([i, None])) for i in range(rows)]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = mf.op13_merkle_manifest(docs)
    assert found(got) == expected(data)
    counts = {r["verified"]: r["count"] for r in got.groupBy("verified").count().collect()}
    assert counts[False] == sum(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in data)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_rounds_of_small_blocks(spark, bits):
    """Trees over several rounds of blocks equal trees built level by level."""
    data = made(75)
    rows = mf.manifest(spark.createDataFrame(data, DOCS), bits=bits)
    proved = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(mf.proof_text(F.col("siblings")).cast("binary"), 256).alias("p"), mf.folded(F.col("leaf"), F.col("siblings")).alias("f"))
    want = {tuple(eval(r))[:5] for r in expected(data)}
    got = proved.collect()
    assert {(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["p"]) for r in got} == want
    assert all(r["f"] == r["root"] for r in got) and len(got) == len(data)


def test_appends_extend_open_witnesses():
    grown = mf.Witnesses()
    for node in "abc":
        grown.append(node)
    assert [[s[0] for s in p] for p in grown.paths] == [["R"], ["L"], []]
    grown.append("d")
    assert [[s[0] for s in p] for p in grown.paths] == [["R", "R"], ["L", "R"], ["R", "L"], ["L", "L"]]
    assert grown.finished() == h(h("a", "b"), h("c", "d"))
    lone = mf.Witnesses()
    lone.append("x")
    assert lone.finished(2) == h(h("x")) and lone.paths == [[".", "."]]


def test_odd_rows(spark):
    data = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "x", "", "a", 1), (3, "x", "", "a", 1), (3, "y", "", "a", 1), (None, "x", "en", "a", 1), (None, None, None, None, None),
        (-(1 << 63), "low", "en", "b", 3), ((1 << 63) - 1, "word " * 100_000, "en", "b", 500_000), (7, "c", "zz", None, -1),
    ]
    docs = spark.createDataFrame(data, DOCS)
    clashing = docs.select("*", *[F.lit("x").alias(c) for c in ("tree", "rank", "node", "leaf", "root", "count", "block", "payload", "siblings", "place")])
    assert found(mf.op13_merkle_manifest(clashing)) == expected(data)


def test_one_row_and_none(spark):
    data = [(5, "only", "en", "a", 4)]
    assert found(mf.op13_merkle_manifest(spark.createDataFrame(data, DOCS))) == expected(data)
    assert mf.op13_merkle_manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_equal_rows_over_ranges(spark):
    """One id on most rows: its copies are dealt to several ranges and each has a leaf of its own."""
    data = [(9, "same", "en", "a", 4)] * 400 + made(30)
    assert found(mf.op13_merkle_manifest(spark.createDataFrame(data, DOCS).repartition(6))) == expected(data)
