"""Matching by place and by similar text, per document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.functions.text import compare_key


def overlap_area(a: str, b: str) -> Column:
    """Area shared by boxes with columns <a>x0, <a>y0, <a>x1, <a>y1 and the same for b."""
    w = F.least(F.col(a + "x1"), F.col(b + "x1")) - F.greatest(F.col(a + "x0"), F.col(b + "x0"))
    h = F.least(F.col(a + "y1"), F.col(b + "y1")) - F.greatest(F.col(a + "y0"), F.col(b + "y0"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def area(a: str) -> Column:
    return (F.col(a + "x1") - F.col(a + "x0")) * (F.col(a + "y1") - F.col(a + "y0"))


def iou(a: str, b: str) -> Column:
    both = overlap_area(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def new_lines(found: DataFrame, known: DataFrame, least: int = 4) -> DataFrame:
    """Recognised lines (doc_id, text) a document's text layer does not have yet.

    A line goes if its key equals a known one, or, from ``least`` characters on, if one contains the other. Equal keys go in
    an equi-join; the rest are compared with the few known lines of their own document only.
    """
    a = found.withColumn("_key", compare_key(F.col("text")))
    b = known.select("doc_id", compare_key(F.col("text")).alias("_key")).distinct()
    rest = a.join(b, ["doc_id", "_key"], "left_anti")
    lists = b.where(F.length("_key") >= least).groupBy("doc_id").agg(F.collect_list("_key").alias("_known"))
    rest = rest.join(lists, "doc_id", "left")
    inside = F.exists("_known", lambda k: F.contains(k, F.col("_key")) | F.contains(F.col("_key"), k))
    gone = (F.length("_key") >= least) & F.coalesce(inside, F.lit(False))
    return rest.where(~gone).drop("_key", "_known")


def nearest_value(labels: DataFrame, values: DataFrame, reach: float = 300.0, anchors: tuple[str, ...] = ()) -> DataFrame:
    """Per label (doc_id, label, lx, ly) the best value (doc_id, value, vx, vy) within ``reach``; texts that hold an anchor are no values.

    Score: 0.6 closeness plus 0.4 direction: 0.5 for more than 10 to the right, 0.3 for 10 above to 40 below, 0.2 further below.
    Ties go to the nearer value, then to the smaller text. A join by document and an aggregation.
    """
    free = ~F.exists(F.array(*[F.lit(a) for a in anchors]).cast("array<string>"), lambda a: F.contains(F.col("value"), a))
    pair = labels.join(values.where(free), "doc_id")
    dx, dy = F.col("vx") - F.col("lx"), F.col("vy") - F.col("ly")
    far = F.sqrt(dx * dx + dy * dy)
    way = F.when(dx > 10, 0.5).otherwise(0.0) + F.when(dy.between(-10, 40), 0.3).when(dy > 0, 0.2).otherwise(0.0)
    scored = pair.select("doc_id", "label", "value", far.alias("far"), (0.6 * (1 - far / reach) + 0.4 * way).alias("score")).where(F.col("far") <= reach)
    best = F.min_by(F.struct("value", "score"), F.struct((-F.col("score")).alias("s"), "far", "value"))
    return scored.groupBy("doc_id", "label").agg(best.alias("b")).select("doc_id", "label", "b.value", "b.score")


def owner_scores(fields: DataFrame, anchors: DataFrame, reach: float = 100.0, overlap: float = 0.5) -> DataFrame:
    """Per field (doc_id, field, x0, y0, x1, y1) the owner (doc_id, owner, x0, y0, x1, y1) with the best score, null if none is over 0.

    Score: 0.4 times the vertical closeness within ``reach`` plus 0.3 where the boxes share over ``overlap`` of the narrower width.
    Of equal scores the first owner by name stays.
    """
    marks = anchors.select("doc_id", "owner", *[F.col(c).alias("a" + c) for c in ("x0", "y0", "x1", "y1")])
    down = F.abs((F.col("y0") + F.col("y1")) / 2 - (F.col("ay0") + F.col("ay1")) / 2)
    shared = F.least("x1", "ax1") - F.greatest("x0", "ax0")
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("ax1") - F.col("ax0"))
    near = F.when(down < reach, 0.4 * (1 - down / reach)).otherwise(0.0)
    beside = F.when((shared > 0) & (narrow > 0) & (shared > overlap * narrow), 0.3).otherwise(0.0)
    scored = fields.join(marks, "doc_id", "left").withColumn("score", F.coalesce(near + beside, F.lit(0.0)))
    scored = scored.withColumn("_order", F.struct((-F.col("score")).alias("s"), "owner"))
    best = F.min_by(F.struct(F.when(F.col("score") > 0, F.col("owner")).alias("owner"), "score"), F.col("_order"))
    return scored.groupBy("doc_id", "field").agg(best.alias("b")).select("doc_id", "field", "b.owner", "b.score")


def row_pairs(amounts: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Pairs of amounts on one row of a document, larger left of smaller: doc_id, net, tax, gap."""
    left = amounts.select("doc_id", F.col("amount").alias("net"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = amounts.select("doc_id", F.col("amount").alias("tax"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    same = (F.abs(F.col("ly") - F.col("ry")) <= tolerance) & (F.col("lx") < F.col("rx")) & (F.col("net") > F.col("tax"))
    return left.join(right, "doc_id").where(same).select("doc_id", "net", "tax", (F.col("rx") - F.col("lx")).alias("gap"), F.col("ly").alias("y"), F.col("lx").alias("x"))


def pair_at_anchor(pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """The pair nearest to the document's total anchor (ax, ay): dy + 0.1 dx, times 0.8 right of the anchor.

    A document without an anchor gives its first pair: the smallest gap, then the lowest on the page.
    """
    joined = pairs.join(anchors, "doc_id", "left")
    cost = F.abs(F.col("y") - F.col("ay")) + 0.1 * F.abs(F.col("x") - F.col("ax"))
    cost = F.when(F.col("ax") < F.col("x"), cost * 0.8).otherwise(cost)
    return joined.groupBy("doc_id").agg(F.min_by(F.struct("net", "tax"), F.struct(cost.alias("c"), "gap", F.when(F.col("ax").isNull(), -F.col("y")).alias("up"), "net", "tax")).alias("p")).select("doc_id", "p.*")


def _common_run(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None or y is None else _common_run(x, y) for x, y in zip(a, b)])


def name_similarity(a: Column, b: Column, suffixes: str = "有限责任公司|股份有限公司|有限公司|公司") -> Column:
    """Half Jaccard of characters without company suffixes, half common subsequence over the longer length.

    Only letters and digits count, for the characters brackets too; 0 where nothing is left of a name.
    """
    chars = lambda x: F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.regexp_replace(x, suffixes, ""), r"[^\p{L}\p{N}（）()]", ""), "")), "")
    plain = lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", "")
    shared = F.size(F.array_intersect(chars(a), chars(b))) / F.greatest(F.size(F.array_union(chars(a), chars(b))), F.lit(1))
    score = 0.5 * shared + 0.5 * common_subsequence(plain(a), plain(b)) / F.greatest(F.length(plain(a)), F.length(plain(b)), F.lit(1))
    return F.when((F.size(chars(a)) > 0) & (F.size(chars(b)) > 0), score).otherwise(0.0)


def tax_id_similarity(a: Column, b: Column) -> Column:
    """Share of equal characters after the first six, if those and the lengths agree, else 0; blanks, dashes and case do not count."""
    a, b = (F.upper(F.regexp_replace(x, "[ -]", "")) for x in (a, b))
    rest = lambda x: F.split(F.substring(x, 7, 1000), "")
    same = F.aggregate(F.zip_with(rest(a), rest(b), lambda x, y: ((x == y) & (x != "")).cast("int")), F.lit(0), lambda acc, v: acc + v)
    fits = (F.length(a) == F.length(b)) & (F.left(a, F.lit(6)) == F.left(b, F.lit(6))) & (F.length(a) > 6)
    return F.when(fits, same / (F.length(a) - 6)).otherwise(0.0)
