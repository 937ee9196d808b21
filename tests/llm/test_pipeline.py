"""The corpus pipeline against brute force, stage by stage and as a whole."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapewright.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def by_lines(texts, sites, least=10):
    """Texts without the lines of ``least`` sites; texts that stand as a whole on so many stay."""
    where, wholes = defaultdict(set), defaultdict(set)
    for d, t in texts.items():
        wholes[t].add(sites[d])
        for line in t.split("\n"):
            if line.strip(" "):
                where[line].add(sites[d])
    out = {}
    for d, t in texts.items():
        cut = len(wholes[t]) < least
        out[d] = "\n".join(x for x in t.split("\n") if not (cut and x.strip(" ") and len(where[x]) >= least))
    return out


def by_likeness(texts):
    """The least id of each class of texts whose five-word sets are alike to 0.8."""
    sets = {}
    for d, t in texts.items():
        w = [x for x in re.split(r"[ \t\n\r\x0b\x0c]+", t) if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    holders = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            holders[g].add(d)
    shared = Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)
    least = {d: d for d in texts}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            x, y = sorted((find(a), find(b)))
            least[y] = x
    same = defaultdict(list)
    for d, t in texts.items():
        same[t].append(d)
    for ids in same.values():
        for d in ids:
            x, y = sorted((find(ids[0]), find(d)))
            least[y] = x
    return {d for d in texts if find(d) == d}


def holds_item(text, items):
    def runs(t):
        w = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", t.lower()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    own = runs(text)
    return any(len(own & r) >= 0.8 * len(r) for r in map(runs, items) if r)


def test_whole_pipeline(spark, sf_dir, rows):
    from tokenizers import Tokenizer

    texts = {d: r["text"] for d, r in rows.items() if re.search(r"[^\W\d_]", r["text"] or "")}
    texts = by_lines(texts, {d: r["source"] for d, r in rows.items()})
    kept = by_likeness(texts)
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {d for d in kept if not holds_item(texts[d], items)}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == kept
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokens = {d: len(tokenizer.encode(texts[d], add_special_tokens=False).ids) + 1 for d in kept}
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == tokens
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert total == tokens


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_stages_on_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "!!! 123", "en", "a", 7), (4, "word", "en", "b", 4), (5, "some words in a text of mine", "en", "b", 28), (6, "some words in a text of mine", None, "c", 28)]
    docs = spark.createDataFrame(odd, schema)
    for name, stage in corpus_pipeline.STAGES:
        got = {r["doc_id"] for r in stage(spark, docs, sf_dir).collect()}
        want = {"language_id": {4, 5, 6}, "line_dedup": {1, 2, 3, 4, 5, 6}, "near_dedup": {1, 2, 3, 4, 5}, "decontamination": {1, 2, 3, 4, 5, 6}, "packing": {1, 2, 3, 4, 5, 6}}[name]
        assert got == want, name
        empty = stage(spark, spark.createDataFrame([], schema), sf_dir)
        assert empty.collect() == []


def test_stages_on_repeated_and_null_ids_and_clashing_columns(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    own = lambda i: " ".join(f"word{i}x{j} und the of and" for j in range(40))
    data = [(1, f"{own(1)}\nshared banner", "en", "s1", 0)] * 3 + [(None, f"{own(2)}\nshared banner", "en", "s2", 0), (None, f"{own(3)}\nshared banner", "en", "s3", 0), (1, f"{own(4)}\nshared banner", "en", "s4", 0)]
    data += [(10 + i, f"{own(10 + i)}\nshared banner", "en", f"t{i}", 0) for i in range(10)]
    clashing = "score lang_pred verdict kept_text found_lines found_id text_key kept_id hit_text node component item_id"
    docs = spark.createDataFrame(data, schema).select("*", *[F.lit("x").alias(c) for c in clashing.split()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        assert rows.columns == docs.columns
        got = Counter((r["doc_id"], r["text"].split("\n")[0]) for r in rows.collect())
        want = Counter((r[0], r[1].split("\n")[0]) for r in data)
        assert got == (Counter(set(want)) if name == "near_dedup" else want), name
        if name == "line_dedup":
            assert all("banner" not in r["text"] for r in rows.collect())
    packed = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    assert len({r["doc_id"] for r in packed}) == 12


def test_benchmark_passages_are_found_in_the_middle(spark, sf_dir):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(8).collect()]
    rng = np.random.default_rng(1)
    filler = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 10**6, n))
    docs = [(i, f"{filler(1000 * i)} {t} {filler(300)}", "en", "s", 0) for i, t in enumerate(items)] + [(100, filler(5000), "en", "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.decontaminated(spark, df, sf_dir).collect()} == {100}
