"""Mixing sources to target weights by hash-threshold histograms (native expressions only).

Every source gets a token budget. A row's hash is a fixed function of its id, refined by one of its text where rows with
one id lie on the boundary, and by one of its place where these have one text too (such rows are interchangeable), so rows with hashes up to a threshold form nested subsets: a larger budget keeps all that a smaller one
keeps. Sizes are summed by source and the hash's leading bits; a cumulative sum over at
most ``2**BITS`` sums a source finds the boundary bucket, and only that bucket is refined by
the next bits. Rows are then filtered by comparing hashes; nothing sorts rows.

Cases: null text has size 0; a null source is a source of its own, ordered last; a source
without tokens has target 0 and its rows are not taken; rows with one id and different texts are told apart by
their texts, and of rows with the same id and text as many are taken as fit; a null id hashes like an empty one; an empty table gives an
empty result; extra columns are not carried unless named in ``keep``, where a name of the result's own means that one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.quality_rules import WORD
from ledgerweave.session import durable

#: Fixed by the contract: source weights in code point order, repeating; share of all tokens; cap per source.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CAP = 2
#: A hash has LEVELS * BITS = 60 bits, read from an MD5 so that any SQL engine can repeat it.
BITS, LEVELS = 12, 5


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def text60(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - BITS * LEVELS)


def source_targets(sized: DataFrame) -> DataFrame:
    """One row a source: source_size, weight, target. ``sized``: source, size.

    Water filling in closed form: sources in order of cap over weight are capped as long as
    an even share by weight of what is left would exceed their cap; the rest share the remainder. The window
    runs over one row per source, already summed.
    """
    totals = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(rank) - 1) % len(WEIGHTS) + 1).cast("int"))
    t = totals.withColumn("weight", weight.cast("double"))
    all_rows = Window.partitionBy()
    by_fill = Window.orderBy(CAP * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns(
        {
            "_left": F.sum("source_size").over(all_rows) * F.lit(SHARE_PERCENT / 100)
            - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "_weights": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    cap = (CAP * F.col("source_size")).cast("double")
    t = t.withColumn("_capped", cap * F.col("_weights") <= F.col("_left") * F.col("weight"))
    t = t.withColumn("_open", F.struct(F.max(F.when(~F.col("_capped"), F.col("_left"))).over(all_rows).alias("l"), F.max(F.when(~F.col("_capped"), F.col("_weights"))).over(all_rows).alias("w")))
    share = F.col("_open.l") * F.col("weight") / F.col("_open.w")
    return t.select("source", "source_size", F.when(F.col("_capped"), cap).otherwise(share).alias("target"))


def plan_mix(sized: DataFrame) -> DataFrame:
    """One row a source: source, source_size, target, whole (copies of every row), threshold of the extra copy.

    Rows of the id hash ``edge`` get the extra copy up to ``edge_threshold`` of their text's hash, those of the text hash ``text_edge`` among them
    up to ``row_threshold`` of their place's.
    """
    targets = source_targets(sized)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = durable(
        targets.withColumn("whole", whole).withColumn("budget", F.floor(F.col("target") - F.col("whole") * F.col("source_size")))
    )
    found = durable(thresholds(sized.select("source", "size", "_h"), plan.select("source", "budget")))
    edge = found.where("edge is not null").select(F.col("source").alias("_s"), F.col("edge").alias("_e"), F.col("budget").alias("left"))
    at_edge = durable(sized.select("source", "size", "_h", "_g", "_r").join(edge, sized["source"].eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_e"))))
    several = durable(at_edge.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("budget")).where("n > 1").select("source", "budget"))
    none = F.lit(None).cast("long")
    found = found.select("source", "threshold", "edge", none.alias("edge_threshold"), none.alias("text_edge"), none.alias("row_threshold"))
    if not several.isEmpty():
        inner = durable(thresholds(at_edge.select("source", "size", F.col("_g").alias("_h")), several))
        same = inner.where("edge is not null").select(F.col("source").alias("_s2"), F.col("edge").alias("_e2"), "budget")
        copies = at_edge.join(same, at_edge["source"].eqNullSafe(F.col("_s2")) & (F.col("_g") == F.col("_e2"))).select("source", "size", F.col("_r").alias("_h"))
        rows = thresholds(durable(copies), same.select(F.col("_s2").alias("source"), "budget")).select(F.col("source").alias("_s3"), F.col("threshold").alias("_t3"))
        inner = inner.select(F.col("source").alias("_s"), F.col("threshold").alias("_t"), F.col("edge").alias("_e2"))
        inner = inner.join(rows, F.col("_s").eqNullSafe(F.col("_s3")), "left")
        found = found.join(inner, found["source"].eqNullSafe(inner["_s"]), "left").select(
            "source", "threshold", "edge", F.col("_t").alias("edge_threshold"), F.col("_e2").alias("text_edge"), F.col("_t3").alias("row_threshold")
        )
    joined = plan.join(found, plan["source"].eqNullSafe(found["source"]), "left").drop(found["source"])
    marks = ("threshold", "edge", "edge_threshold", "text_edge", "row_threshold")
    return durable(joined.select(F.col("source").alias("_source"), "source_size", "target", "whole", *marks))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken and ``keep``.

    A budget over its source's size takes every row once and draws the excess as second
    copies, so no row is taken more than twice. ``taken`` is size times copies. Histograms are made from a table
    of ids, sources, sizes and hashes; with ``keep`` the rows themselves are read once more to be joined with the plan. Equal rows are then told apart by
    their place in ``docs``, so of those on the boundary exactly as many as fit are taken from a table, and about as many from rows whose places change.
    """
    keep = tuple(c for c in keep if c not in ("doc_id", "source", "size", "source_size", "target", "copies", "taken"))
    facts = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"),
        hash60(F.col(doc_id)).alias("_h"), text60(F.col(text)).alias("_g"), text60(F.monotonically_increasing_id()).alias("_r"), F.struct(*keep).alias("_keep") if keep else F.lit(None).alias("_keep"),
    )
    rows, sized = facts, durable(facts.drop("_keep"))
    plan = plan_mix(sized)
    base = rows if keep else sized
    out = base.join(plan, base["source"].eqNullSafe(plan["_source"]))
    last = (F.col("_g") == F.col("text_edge")) & (F.col("_r") <= F.col("row_threshold"))
    drawn = (F.col("_h") <= F.col("threshold")) | ((F.col("_h") == F.col("edge")) & ((F.col("_g") <= F.col("edge_threshold")) | last))
    copies = F.when(F.col("source_size") == 0, 0).otherwise(F.col("whole") + F.coalesce(drawn, F.lit(False)).cast("int"))
    out = out.withColumn("copies", F.least(copies, F.lit(CAP))).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *[F.col(f"_keep.{c}") for c in keep])


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold, edge, budget: the largest hash up to which the sizes sum to at most the budget, -1 if none.

    ``edge`` is the next hash, whose rows no longer fit together, and ``budget`` what is left for them.

    Each level sums a source's open bucket by the next BITS of the hash. The bucket where the sum
    passes the budget stays open for the next level; a source none of whose buckets passes
    its budget is settled with all of that bucket.
    """
    state = budgets.withColumns({"_prefix": F.lit(0).cast("long"), "threshold": F.lit(-1).cast("long")})
    done = None
    open_rows = rows
    for level in range(LEVELS):
        low = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright(F.col("_h"), low)
        sums = open_rows.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("tokens"))
        walk = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("_upto", F.sum("tokens").over(walk))
        s = state.select(F.col("source").alias("_s"), "budget", F.col("threshold").alias("_t"))
        joined = s.join(sums, s["_s"].eqNullSafe(sums["source"]), "left")
        fits = F.coalesce(F.col("_upto") <= F.col("budget"), F.lit(True))
        step = joined.groupBy(F.col("_s").alias("source")).agg(
            F.first("budget").alias("_budget"),
            F.first("_t").alias("_t"),
            F.coalesce(F.max(F.when(fits, F.col("_upto"))), F.lit(0)).alias("_used"),
            F.max(F.when(fits, F.col("_bucket"))).alias("_fit"),
            F.min(F.when(~fits, F.col("_bucket"))).alias("_prefix"),
        )
        upper = F.shiftleft(F.col("_fit") + 1, low) - 1
        step = durable(
            step.select(
                "source",
                (F.col("_budget") - F.col("_used")).alias("budget"),
                "_prefix",
                F.greatest("_t", F.coalesce(upper, F.col("_t"))).alias("threshold"),
            )
        )
        settled = step.where(F.col("_prefix").isNull() if level < LEVELS - 1 else F.lit(True)).select("source", "threshold", F.col("_prefix").alias("edge"), "budget")
        done = settled if done is None else done.unionByName(settled)
        state = step.where(F.col("_prefix").isNotNull())
        edge = state.select(F.col("source").alias("_s"), F.col("_prefix").alias("_p"))
        open_rows = open_rows.join(
            edge, open_rows["source"].eqNullSafe(edge["_s"]) & (F.shiftright(open_rows["_h"], low) == edge["_p"]), "left_semi"
        )
        if level < LEVELS - 1:
            open_rows = durable(open_rows)
    return done


def op3_query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 15) AS BIGINT) AS h FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM totals),
filled AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - 2 * coalesce(sum(source_size) OVER b, 0) AS remain,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights
  FROM weighted WINDOW b AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (2 * source_size)::DOUBLE * weights <= remain * weight AS is_capped FROM filled),
targets AS (
  SELECT source, source_size, CASE WHEN is_capped THEN (2 * source_size)::DOUBLE
    ELSE max(CASE WHEN NOT is_capped THEN remain END) OVER () * weight / max(CASE WHEN NOT is_capped THEN weights END) OVER () END AS target
  FROM capped),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
drawn AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           <= floor(p.target - p.whole * p.source_size) AS extra
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (whole + CAST(extra AS INT)) * size END AS BIGINT) AS taken
FROM drawn
"""
