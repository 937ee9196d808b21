"""A training corpus from raw documents, stage by stage.

Each stage takes what its predecessor kept; all but the last return the columns
of ``documents``. Between stages the rows are written as Parquet and read back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import decontaminate, language_id, line_dedup, minhash, packing
from tapewright.llm.queries import tokenizer_path
from tapewright.llm.storage import drop, settle

#: Documents whose language is less sure than this are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.5
#: Of less than so many words, the language is likely at best: these are rejected under a score of their own.
FEW_WORDS, FEW_WORDS_SCORE = 5, 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language; ``lang`` stays as given."""
    return language_id.in_known_language(docs, language_id.trained_on_rest(docs), LEAST_LANGUAGE_SCORE, FEW_WORDS, FEW_WORDS_SCORE)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that many sources share out of the texts; ``n_chars`` follows where lines go. Documents stay."""
    rows, found, kept = line_dedup.cleaned(docs)
    length = F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast("long"))
    return rows.select(*[F.col(kept).alias("text") if c == "text" else length.alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies, that with the least doc_id."""
    return minhash.without_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths."""
    return packing.op4_packing(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", remove_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("packing", pack),
]

#: Language models, signatures and token ids can't be put into SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's input and what it wrote on its way go once its result is committed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    inputs: list[str] = []
    for _, stage in before:
        docs, path = settle(spark, partial(stage, spark, docs, sf_dir))
        drop(spark, *inputs)
        inputs = [path]
    return last(spark, docs, sf_dir)
