"""Line dedup by distinct-site spread.

A line is known by the hash of its text, lower-cased, with white space trimmed and runs of it made one blank. Lines
shorter than `least_chars` (so normalised) are never boilerplate; the default exempts lines of up to three characters. One
pass over the texts writes the hashes of every document's lines. One HyperLogLog sketch of its sites for each line is
then made by aggregation: tasks sketch their own rows first, and only sketches are shuffled and merged, so a line that
stands in a third of all documents is one small row for each task. A line whose estimate is clearly under or over
`sites` (beyond `margin`, a share; over six standard errors of a sketch) is decided by it. Only lines near the
threshold get an exact count of distinct sites. Lines on at least `sites` sites are boilerplate and go from every
document.

Bounds: a set of lines is broadcast if it has at most BROADCAST rows; above that it is joined by merge, dealt by line and
one of SALTS salts, so that one very common line is not one task's.

Cases: a null site counts as one site of its own; a null text stays null with 0 lines; an empty text has one empty
line; a document may lose all lines (empty text); a line twice in a document counts once for its site; rows with
equal doc_id and text are alike, rows without doc_id are told by their text; very long texts are split whole; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colguard.llm.common import Scratch

#: log2 of a sketch's buckets: a relative error of about 1.6 %, and exact for small counts in practice
SKETCH = 12
BROADCAST, SALTS = 500_000, 32
LEAST_CHARS = 4

#: Runs of white space within a line that are not one blank
_RUN = r"\x20*[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20{2,}"


def _line_hashes(text: Column, least_chars: int) -> Column:
    """Hashes of a text's lines in order, null where a line is too short."""
    lines = F.split(F.regexp_replace(F.lower(text), _RUN, " "), "\n", -1)
    return F.transform(F.transform(lines, lambda x: F.trim(x)), lambda k: F.when(F.length(k) >= least_chars, F.xxhash64(k)))


def _row_key() -> list[Column]:
    """What tells a row (doc_id, text): 128 bits of hash, never null."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("k2")]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def hashed(docs: DataFrame, scratch: Scratch, site: str = "source", least_chars: int = LEAST_CHARS) -> DataFrame:
    """k1, k2 (the row's key), site, lines (hashes in order): the one pass over all texts."""
    where = F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n")).alias("site")  # a sketch passes over empty strings
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), where).where("text IS NOT NULL")
    return scratch.put(rows.select(*_row_key(), "site", _line_hashes(F.col("text"), least_chars).alias("lines")), "hashed")


def _only(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows (k1, k2, line) whose line is among `lines` (distinct)."""
    if lines.count() <= BROADCAST:
        return rows.join(F.broadcast(lines.select("line")), "line", "left_semi")
    salted = lines.select("line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(salted.hint("merge"), ["line", "salt"], "left_semi").drop("salt")


def boilerplate(table: DataFrame, scratch: Scratch, sites: int = 10, margin: float = 0.1) -> DataFrame:
    """line (hash), n_sites: the lines of hashed() on at least `sites` sites."""
    rows = table.select("k1", "k2", "site", F.explode(F.array_distinct("lines")).alias("line")).where("line IS NOT NULL")
    spread = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH))).alias("guess"))
    spread = scratch.put(spread.where(F.col("guess") >= sites * (1 - margin)), "spread")
    sure = F.col("guess") > sites * (1 + margin)
    near = spread.where(~sure).select("line")
    exact = _only(rows, near).groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("n_sites"))
    return scratch.put(spread.where(sure).select("line", F.col("guess").alias("n_sites")).union(exact.where(F.col("n_sites") >= sites)), "boilerplate")


def without_boilerplate(docs: DataFrame, table: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_lines, n_removed, text (without the lines)."""
    held = _only(table.select("k1", "k2", F.posexplode("lines").alias("pos", "line")).where("line IS NOT NULL"), lines)
    gone = held.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("pos")).alias("__gone"))  # places in one text
    rows = _rows(docs).withColumns(dict(zip(("k1", "k2"), _row_key(), strict=True)))
    # a merge join at every size: the number of documents with boilerplate has no bound
    out = rows.join(scratch.put(gone, "gone").hint("merge"), ["k1", "k2"], "left")
    n = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    # what stands between two places that go, once for each of them: s.l and s.b are made once
    both = F.array(F.struct(F.split("text", "\n", -1).alias("l"), F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(n)).alias("b")))
    between = lambda s: F.transform(F.sequence(F.lit(0), F.size(s["b"]) - 2), lambda i: F.slice(s["l"], F.get(s["b"], i) + 2, F.get(s["b"], i + 1) - F.get(s["b"], i) - 1))
    kept = F.get(F.transform(both, lambda s: F.array_join(F.flatten(between(s)), "\n")), F.lit(0))
    return out.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )


def clean(docs: DataFrame, scratch: Scratch, site: str = "source", sites: int = 10, least_chars: int = LEAST_CHARS, margin: float = 0.1) -> DataFrame:
    """doc_id, n_lines, n_removed, text of docs without the lines on at least `sites` sites."""
    table = hashed(docs, scratch, site, least_chars)
    return without_boilerplate(docs, table, boilerplate(table, scratch, sites, margin), scratch)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "lines"))


ORACLE_OP8 = r"""
WITH l AS (
  SELECT doc_id, source, pos, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS k
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)
), b AS (
  SELECT k FROM l WHERE length(k) >= 4 GROUP BY k HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= 10
), m AS (SELECT l.*, b.k IS NOT NULL AS bad FROM l LEFT JOIN b ON l.k = b.k)
SELECT d.doc_id, coalesce(count(m.pos), 0) AS n_lines, coalesce(sum(CASE WHEN bad THEN 1 ELSE 0 END), 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(CASE WHEN NOT bad THEN m.line END, chr(10) ORDER BY pos), '') END AS text
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.text
"""
