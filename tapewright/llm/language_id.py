"""Language identification by words first, character n-grams for unseen words.

A known word scores its log frequency in each language. A word the model
doesn't know is scored by its character n-grams of the longest order of which
any is known, then by shorter ones, down to single characters. A text's score
is the mean over its words; the languages' posterior is a softmax of it.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.shingles import hash_spans, release_memory, spans_of_words, text_bytes, text_slices
from tapewright.llm.storage import materialize, unused

UNKNOWN = "und"
#: Letters of any script, in runs; for Java's and Python's patterns alike.
JAVA_WORD = r"\p{L}+"
ORDERS = (4, 3, 2, 1)
ASCII_LETTERS = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
NO_LETTERS = ~(ASCII_LETTERS | (np.arange(256) >= 128))
#: What a whole text's evidence counts for at most, in words: keeps the posterior short of certainty.
EVIDENCE_WORDS = 20
#: Words whose scores a Python task remembers.
REMEMBERED_WORDS = 300_000


@dataclass
class LanguageModel:
    """``table`` holds log frequencies, a row a piece and a column a language; the dictionaries give a piece's row."""

    languages: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    table: np.ndarray


def training_sample(docs: DataFrame, max_docs: int) -> DataFrame:
    """``lang, text`` of about ``max_docs`` rows a language, chosen by the hash of the id."""
    labelled = docs.where("lang is not null and text is not null")
    # Written down, so that its size is known: a row a language doesn't make the texts move.
    counts = materialize(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    share = F.least(F.lit(1.0), F.lit(float(max_docs)) / F.col("n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    return labelled.join(counts, "lang").where(place < share).select("lang", "text")


def train(docs: DataFrame, max_docs: int = 500) -> LanguageModel:
    """Fit the model on ``doc_id, text, lang`` rows.

    The one bound, a parameter, is on labelled rows: the documents read a
    language. Every language, word and n-gram of these is kept. No labelled
    text gives a model without languages.
    """
    words = (
        training_sample(docs, max_docs)
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(JAVA_WORD), F.lit(0))).alias("piece"))
        .groupBy("lang", "piece")
        .agg(F.count("*").alias("n"))
    )
    found = words.toArrow()  # bounded by the documents read
    return _model(list(zip(*[found.column(c).to_pylist() for c in ("lang", "piece", "n")], strict=True)))


def grams_of(word: str, size: int) -> list[str]:
    """A word's n-grams, within blanks but for single characters."""
    padded = f" {word} " if size > 1 else word
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def _model(rows: list[tuple[str, str, int]]) -> LanguageModel:
    """From (language, word, count) triples."""
    languages = sorted({lang for lang, _, _ in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    table: list[np.ndarray] = [np.zeros((0, len(languages)))]
    rows_of: dict[int, dict[str, int]] = {}
    before = 0
    for size in (0, *ORDERS):
        row_of: dict[str, int] = {}
        at, column, counts = array("q"), array("q"), array("q")
        for lang, word, n in rows:
            for piece in (word,) if size == 0 else grams_of(word, size):
                at.append(row_of.setdefault(piece, len(row_of)))
                column.append(place[lang])
                counts.append(n)
        found = np.zeros((len(row_of), len(languages)))
        np.add.at(found, (np.array(at), np.array(column)), np.array(counts))
        total = found.sum(axis=0)
        table.append(np.where(found > 0, np.log(np.maximum(found, 1) / np.maximum(total, 1)), np.log(0.5 / (1 + total))))
        rows_of[size] = {piece: before + i for piece, i in row_of.items()}
        before += len(row_of)
    return LanguageModel(languages, rows_of[0], [rows_of[size] for size in ORDERS], np.concatenate(table).astype(np.float32))


class WordScores:
    """Scores of words by language; remembers what it has worked out, up to a bound."""

    def __init__(self, model: LanguageModel):
        import regex

        self.model, self.pieces_of, self.letter = model, regex.compile(r"\p{L}+").findall, regex.compile(r"\p{L}").search
        self.known: dict[int, int] = {}
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def verdicts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text."""
        languages = np.array([*self.model.languages, UNKNOWN], object)
        data, offsets = text_bytes(pc.utf8_lower(texts))
        starts, ends = spans_of_words(data, offsets, NO_LETTERS)
        n, k = len(texts), len(languages) - 1
        best, sure = np.full(n, k), np.zeros(n)
        if len(starts) and k:
            rows = np.searchsorted(offsets, starts, "right") - 1
            distinct, first, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
            at = self.rows(distinct, lambda i: data[starts[first[i]] : ends[first[i]]].tobytes().decode())
            by_word = self.table[at[inverse]]
            words = np.bincount(rows, minlength=n)
            mean = np.stack([np.bincount(rows, by_word[:, j], n) for j in range(k)], axis=1) / np.maximum(words, 1)[:, None]
            top = mean.argmax(axis=1)
            weight = np.minimum(words, EVIDENCE_WORDS)
            odds = 1 / np.exp((mean - mean.max(axis=1, keepdims=True)) * weight[:, None]).sum(axis=1)
            # Bytes of other scripts needn't be letters: rows without an ASCII letter are looked at.
            plain = np.zeros(n, bool)
            plain[np.searchsorted(offsets, np.flatnonzero(ASCII_LETTERS[data]), "right") - 1] = True
            for i in np.flatnonzero((words > 0) & ~plain):
                words[i] *= self.letter(texts[i].as_py()) is not None
            best, sure = np.where(words > 0, top, k), np.where(words > 0, odds, 0.0)
        return languages[best], sure

    def rows(self, hashes: np.ndarray, word_at) -> np.ndarray:
        """Rows of ``table`` for distinct word hashes; ``word_at(i)`` gives the i-th word."""
        if len(self.known) > REMEMBERED_WORDS:
            self.known, self.table = {}, self.table[:0]
        rows = np.array([self.known.get(h, -1) for h in hashes.tolist()], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = len(self.known) + np.arange(len(new))
            self.table = np.concatenate([self.table, self.fresh([word_at(i) for i in new])])
            self.known.update(zip(hashes[new].tolist(), rows[new].tolist(), strict=True))
        return rows

    def fresh(self, words: list[str]) -> np.ndarray:
        """Known words as they are; the others by their n-grams of the longest order of which any is known."""
        flat: list[int] = []
        counts = []
        for word in words:
            hits: list[int] = []
            for piece in [word] if word.isalpha() else self.pieces_of(word):
                hits += self.hits(piece)
            counts.append(len(hits))
            flat += hits
        sums = np.zeros((len(words), self.table.shape[1]), np.float32)
        counted = np.array(counts)
        full = np.flatnonzero(counted)
        if len(full):
            sums[full] = np.add.reduceat(self.model.table[flat], (np.cumsum(counted) - counted)[full], axis=0) / counted[full, None]
        return sums

    def hits(self, word: str) -> list[int]:
        if (row := self.model.words.get(word)) is not None:
            return [row]
        for size, grams in zip(ORDERS, self.model.grams, strict=True):
            if hits := [g for piece in grams_of(word, size) if (g := grams.get(piece)) is not None]:
                return hits
        return []


def detected(model: LanguageModel, spark: SparkSession) -> Callable[[Column], Column]:
    """A function from a text column to a struct of ``lang_pred`` and ``score``; only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the parameter of train()

    @F.arrow_udf("lang_pred string, score double")
    def verdicts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = WordScores(shared.value)
        for texts in columns:
            parts = [scores.verdicts(part) for part in text_slices(texts)]
            found, sure = [np.concatenate(x) if parts else np.zeros(0) for x in (list(zip(*parts, strict=True)) or ((), ()))]
            release_memory()
            yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(sure, pa.float64())], ["lang_pred", "score"])

    # Not to be worked out again where a filter on it is pushed below other columns.
    return verdicts.asNondeterministic()


def predict(docs: DataFrame, model: LanguageModel, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``score``, from the whole text alone.

    ``und`` with score 0: a null text, one without a letter, or a model without
    languages. Ties go to the language first in the alphabet. Rows that repeat
    an id are predicted each on its own.
    """
    found = unused(docs, "verdict")
    return docs.select(*keep, detected(model, docs.sparkSession)(F.col(text_col)).alias(found)).select(*keep, f"{found}.lang_pred", f"{found}.score")


def in_known_language(docs: DataFrame, model: LanguageModel, least_score: float, few_words: int = 0, few_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least this score, with their own columns only.

    A text of less than ``few_words`` words can't make its language sure: it needs ``few_score`` only.
    """
    found = unused(docs, "verdict")
    judged = docs.withColumn(found, detected(model, docs.sparkSession)(F.col("text")))
    # The split ends after as many parts.
    few = F.size(F.split(F.trim("text"), r"\s+", few_words)) < few_words if few_words > 0 else F.lit(False)
    least = F.when(few, few_score).otherwise(least_score)
    return judged.where((F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= least)).drop(found)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained_on_rest(docs: DataFrame) -> LanguageModel:
    return train(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))


def op1_language_id(docs: DataFrame) -> DataFrame:
    """Every document's language by a model fitted on the documents that aren't held out."""
    return predict(docs, trained_on_rest(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
