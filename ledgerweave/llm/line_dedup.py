"""Line dedup over overlapping three-line windows.

The text is cut at line feeds. Every window of three consecutive lines gets a 128-bit hash; a
window that occurs more than once in the table keeps its first occurrence, by document id and
then position, and all lines covered by later occurrences are removed. Windows meet in one
partially aggregated shuffle (a hot window shrinks to one row a task); only windows that
repeat are joined back, and texts move once, to be joined with their covered positions.

Cases: a null text stays null with 0 lines; a text of fewer than three lines has no window and
stays whole; an empty text has one line; windows without a word are not compared, so blank
stretches stay; rows repeated with the same id and text are one document and keep or lose the same
lines; rows with one id (or none) and different texts are different documents, the first occurrence is that of the lower hash
of the text; a null id orders last; extra columns pass through whatever their names, those named like an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.quality_rules import WORD

LINES = 3


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), pos (0-based first line), k1, k2: one row per window that has a word."""
    lines = F.split("text", "\n")
    n = F.size("lines")
    cut = docs.select("doc_id", F.xxhash64("text").alias("mark"), lines.alias("lines")).where(F.size("lines") >= LINES)
    row = F.transform(
        F.slice("lines", F.lit(1), n - (LINES - 1)),
        lambda x, i: F.struct(
            i.alias("pos"),
            F.xxhash64(x, F.get("lines", i + 1), F.get("lines", i + 2)).alias("k1"),
            F.xxhash64(F.lit(LINES), F.get("lines", i + 2), F.get("lines", i + 1), x).alias("k2"),
            (x.rlike(WORD) | F.get("lines", i + 1).rlike(WORD) | F.get("lines", i + 2).rlike(WORD)).alias("has"),
        ),
    )
    return cut.select("doc_id", "mark", F.inline(row)).where("has").drop("has")


def covered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark, starts: first lines of the windows to remove."""
    at = windows(docs).withColumn("at", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "pos"))
    repeated = at.groupBy("k1", "k2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = at.join(repeated, ["k1", "k2"]).where(F.col("at") != F.col("first"))
    return later.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines, plus n_lines and n_removed."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # The row travels as one column, so that no name of the caller's meets one of these.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    gone = covered_lines(docs.select("doc_id", "text"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("mark"))
    df = rows.join(gone, same, "left").select("row", "starts")
    # A line number is gone if a window starting there or one or two lines before is.
    spread = F.sort_array(F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (LINES - 1))))))
    df = df.withColumn("spread", spread)
    # One 0 or 1 per line up to the last one gone, zipped with the lines: linear in both.
    before = lambda i: F.coalesce(F.get("spread", i - 1), F.lit(-1))
    bits = F.array_join(F.transform("spread", lambda p, i: F.concat(F.repeat(F.lit("0"), p - before(i) - 1), F.lit("1"))), "")
    text = F.col("row.text")
    zipped = F.arrays_zip(F.split(text, "\n").alias("line"), F.split(bits, "").alias("gone"))
    rest = F.filter(zipped, lambda x: x["line"].isNotNull() & (F.coalesce(x["gone"], F.lit("0")) != "1"))
    kept = F.array_join(F.transform(rest, lambda x: x["line"]), "\n")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n")))
    reduced = F.when(F.col("starts").isNull(), text).otherwise(kept)
    return df.select(
        *[(reduced if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in names],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("spread"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
w AS (
  SELECT doc_id, unnest(range(0, len(lines) - 2)) AS pos, lines FROM l WHERE len(lines) >= 3),
x AS (
  SELECT doc_id, pos, lines[pos + 1] AS a, lines[pos + 2] AS b, lines[pos + 3] AS c FROM w),
r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS LAST, pos) AS k FROM x
  WHERE regexp_matches(a || ' ' || b || ' ' || c, '[^\x20\x09-\x0D]')),
g AS (
  SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS p FROM r WHERE k > 1),
e AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS p FROM l),
k AS (
  SELECT e.doc_id, count(*) AS n_lines, count(g.p) AS n_removed,
         string_agg(e.line, chr(10) ORDER BY e.p) FILTER (WHERE g.p IS NULL) AS kept
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT l.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text
FROM l LEFT JOIN k ON l.doc_id = k.doc_id
"""


def op8_query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
