"""Boilerplate lines: lines found on many distinct sites.

HyperLogLog sketches of the site, one per line hash, merge by aggregation.
Lines whose estimate is too close to the threshold for the sketch's error get
an exact distinct count. Occurrences of the lines that reach the threshold are
removed everywhere. A whole text counts as one more line: where it is itself
found on so many sites, it is a copied document and not a page around
boilerplate; it stays as it is, for near-duplicate removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.storage import unused

#: Place and hash seed of a whole text among its lines.
WHOLE = -1
#: Parts into which the occurrences of each line are dealt where they are joined.
SALTS = 16


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.lit(WHOLE), text)


def line_occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, site, pos, line_hash`` of every line that isn't blank, and of the whole text (``pos`` -1); ``docs``: doc_id, text, site."""
    split = F.split("text", "\n", -1)
    own = F.struct(F.lit(WHOLE).alias("pos"), _text_hash(F.col("text")).alias("line_hash"), F.lit(True).alias("full"))
    lines = F.transform(split, lambda line, i: F.struct(i.alias("pos"), F.xxhash64(line).alias("line_hash"), (F.length(F.trim(line)) > 0).alias("full")))
    return (
        docs.where("text is not null")
        .select("doc_id", "site", _text_hash(F.col("text")).alias("text_hash"), F.explode(F.concat(F.array(own), lines)).alias("l"))
        .where("l.full")
        .select("doc_id", "text_hash", "site", "l.pos", "l.line_hash")
    )


def widespread_lines(lines: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """``line_hash`` of the lines that occur on at least ``min_sites`` distinct sites. A null site is none."""
    error = 4 * 1.04 / 2 ** (lg_k / 2)  # four standard errors of the sketch
    sketched = lines.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    low, high = max(1, int(min_sites * (1 - error))), int(min_sites * (1 + error)) + 1
    sure = sketched.where(F.col("sites") > high).select("line_hash")
    near = sketched.where(F.col("sites").between(low, high)).select("line_hash")
    # Distinct pairs first: a line's occurrences on one site are one row before they meet.
    exact = (
        occurring(lines, near)
        .select("line_hash", "site")
        .distinct()
        .groupBy("line_hash")
        .agg(F.count("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("line_hash")
    )
    return sure.unionByName(exact)


def occurring(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose hash is among ``wanted``; a very common line's rows meet it in several tasks."""
    dealt = wanted.select("line_hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")).join(dealt, ["line_hash", "salt"], "left_semi").drop("salt")


def cleaned(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id", min_sites: int = 10) -> tuple[DataFrame, str, str]:
    """All columns of every row and two more, and the names of these: positions of removed lines (null for none) and the text without them.

    Rows are told apart by id and text, so rows that repeat an id lose their
    own lines each. Null texts stay null.
    """
    found, kept, key_id, key_text = unused(docs, "found_lines", "kept_text", "found_id", "found_text")
    lines = line_occurrences(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(site).alias("site")))
    removed = (
        occurring(lines, widespread_lines(lines, min_sites))
        .groupBy(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_text))
        .agg(F.collect_set("pos").alias(found))  # bounded by the text's lines
        .where(~F.array_contains(found, WHOLE))
    )
    joined = docs.join(removed, F.col(doc_id).eqNullSafe(F.col(key_id)) & (_text_hash(F.col(text)) == F.col(key_text)), "left").drop(key_id, key_text)
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(found, i)), "\n")
    return joined.withColumn(kept, F.when(F.col(found).isNull(), F.col(text)).otherwise(rest)), found, kept


def without_boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id", min_sites: int = 10) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_text`` of every row.

    Lines are separated by newlines; blank ones are neither counted nor
    removed. A text that stands as a whole on ``min_sites`` sites keeps all.
    Null text: no lines, kept_text null. Rows with equal id and text lose the
    same lines.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(site_col).alias("site"))
    rows, found, kept = cleaned(docs, "text", "site", "doc_id", min_sites)
    full = F.filter(F.split("text", "\n", -1), lambda line: F.length(F.trim(line)) > 0)
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(full)).cast("long").alias("n_lines"),
        F.when(F.col(found).isNull(), 0).otherwise(F.size(found)).cast("long").alias("n_removed"),
        F.col(kept).alias("kept_text"),
    )


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    """Digest of the deduplicated text of every document."""
    return without_boilerplate(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
copied AS (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT source) >= 10),
wide AS (SELECT line FROM lines WHERE length(trim(line, ' ')) > 0 GROUP BY line HAVING count(DISTINCT source) >= 10),
marked AS (
  SELECT l.doc_id, l.pos, l.line, length(trim(l.line, ' ')) > 0 AS is_full, w.line IS NOT NULL AND c.text IS NULL AS goes
  FROM lines l LEFT JOIN wide w ON l.line = w.line LEFT JOIN copied c ON l.text = c.text),
per_doc AS (
  SELECT doc_id, count(*) FILTER (is_full) AS n_lines, count(*) FILTER (goes) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.n_lines, 0) AS n_lines, coalesce(p.n_removed, 0) AS n_removed, sha256(coalesce(p.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""
