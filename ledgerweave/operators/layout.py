"""From positioned tokens to rows, columns and grids; all work is per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.folds import number_rows


def gap_clusters(points: DataFrame, keys: list[str], value: str, eps: float) -> DataFrame:
    """Add cluster (0-based): a new one starts where the gap to the previous value exceeds eps."""
    w = Window.partitionBy(*keys).orderBy(value)
    jump = F.when(F.col(value) - F.lag(value).over(w) > eps, 1).otherwise(0)
    return points.withColumn("_jump", jump).withColumn("cluster", F.sum("_jump").over(w)).drop("_jump")


def bucket_of(value: Column, bounds: Column) -> Column:
    """Index of the first bound above the value, for sorted bounds."""
    return F.size(F.filter(bounds, lambda b: b <= value))


def rows_by_first_center(tokens: DataFrame, keys: list[str], share: float = 0.6, least: float = 3.0) -> DataFrame:
    """Add row: tokens by center y join a row whose first center is within max(share * median height, least).

    The comparison is with the row's first token, so it is a fold over one page, not a lag. The median is the upper middle one.
    """
    heights = F.sort_array(F.collect_list(F.col("y1") - F.col("y0")))
    middle = F.get(heights, F.floor(F.count(F.lit(1)) / 2).cast("int"))
    tolerance = tokens.groupBy(*keys).agg(F.greatest(middle * share, F.lit(least)).alias("_tolerance"))
    df = tokens.join(tolerance, keys).withColumn("_center", (F.col("y0") + F.col("y1")) / 2)

    def step(state, center, limit):
        if state["first"] is None or abs(center - state["first"]) > limit:
            state["row"], state["first"] = state["row"] + 1, center
        return state["row"]

    out = number_rows(df, keys, ["_center", "pos"], ["_center", "_tolerance"], "row", lambda: {"row": -1, "first": None}, step)
    return out.drop("_center", "_tolerance")


def rows_by_heights(tokens: DataFrame, keys: list[str], share: float = 0.6) -> DataFrame:
    """Add row: a token, by center y, joins the current row if its center is nearer to the row's first one than ``share`` of the taller of the two."""

    def step(state, center, height):
        if not state or abs(center - state["first"]) >= max(state["height"], height) * share:
            state["row"], state["first"], state["height"] = state.get("row", -1) + 1, center, height
        return state["row"]

    df = tokens.withColumns({"_center": (F.col("y0") + F.col("y1")) / 2, "_height": F.col("y1") - F.col("y0")})
    return number_rows(df, keys, ["_center", "pos"], ["_center", "_height"], "row", dict, step).drop("_center", "_height")


def line_region(line: Column, header: Column, summary: Column, remark: Column, footer: Column, table_start: Column | None = None) -> Column:
    """Region of a line by the lines (from 0) that the anchors stand in; null for an anchor that is not there.

    The last rule that fits wins: remark (ten lines at most, up to the footer), line_items (from the table's header to the summary, else the
    footer), the header's own lines, summary (up to the next footer or remark), footer; everything else is header.
    """
    after = lambda stop, start: F.coalesce(F.when(stop > start, line < stop), F.lit(True))
    inside = lambda test: F.coalesce(test, F.lit(False))
    start = F.greatest(F.lit(0), header - 7) if table_start is None else table_start
    items_end = F.coalesce(summary, footer)
    return (
        F.when(inside(line >= footer), "footer")
        .when(inside((line >= summary) & after(footer, summary) & after(remark, summary)), "summary")
        .when(inside((header >= 0) & line.between(start, header)), "header")
        .when(inside((header >= 0) & (line > header) & F.coalesce(line < items_end, F.lit(True))), "line_items")
        .when(inside((line >= remark) & (line < remark + 10) & after(footer, remark)), "remark")
        .otherwise("header")
    )


def rows_by_overlap(tokens: DataFrame, keys: list[str], share: float = 0.4) -> DataFrame:
    """Add row: a token, by center y, joins the current row if at least ``share`` of its height lies in the row's growing band.

    A token without height always joins.
    """

    def step(state, top, bottom):
        height = bottom - top
        if state and (height == 0 or max(0.0, min(state["b"], bottom) - max(state["a"], top)) / height >= share):
            state["a"], state["b"] = min(state["a"], top), max(state["b"], bottom)
        else:
            state["row"] = state.get("row", -1) + 1
            state["a"], state["b"] = top, bottom
        return state["row"]

    df = tokens.withColumn("_center", (F.col("y0") + F.col("y1")) / 2)
    return number_rows(df, keys, ["_center", "pos"], ["y0", "y1"], "row", dict, step).drop("_center")


def regions_of(tokens: DataFrame, regions: DataFrame) -> DataFrame:
    """Add region: the first region (by rank) that holds the token's center y, else the one with the nearest edge.

    ``regions``: doc_id, rank, region, top, bottom, a few rows per document, which a document's tokens get as one array.
    Equal tokens stay apart.
    """
    center = (F.col("y0") + F.col("y1")) / 2
    few = regions.groupBy("doc_id").agg(F.collect_list(F.struct("rank", "region", "top", "bottom")).alias("_regions"))
    far = lambda r: F.when(center.between(r["top"], r["bottom"]), 0.0).otherwise(F.least(F.abs(center - r["top"]), F.abs(center - r["bottom"])))
    best = F.array_min(F.transform("_regions", lambda r: F.struct(far(r).alias("e"), r["rank"].alias("rank"), r["region"].alias("region"))))
    return tokens.join(few, "doc_id").withColumn("region", best["region"]).drop("_regions")


def columns_by_overlap(tokens: DataFrame, columns: DataFrame, share: float = 0.3) -> DataFrame:
    """Add col: the column (doc_id, col, left, right) that covers most of the token, if at least ``share``; else null."""
    width = F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-9))
    cover = lambda c: (F.least(F.col("x1"), c["right"]) - F.greatest(F.col("x0"), c["left"])) / width
    few = columns.groupBy("doc_id").agg(F.collect_list(F.struct("col", "left", "right")).alias("_columns"))
    ranked = F.transform("_columns", lambda c: F.struct(cover(c).alias("cover"), (-c["col"]).alias("minus")))
    best = F.array_max(ranked)
    return tokens.join(few, "doc_id", "left").withColumn("col", F.when(best["cover"] >= share, -best["minus"])).drop("_columns")


def grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Text per row and column, tokens from left to right."""
    ordered = F.sort_array(F.collect_list(F.struct("x0", "pos", "text")))
    return cells.groupBy(*keys, "row", "col").agg(F.array_join(F.transform(ordered, lambda t: t["text"]), "").alias("text"))


def merge_continuations(rows: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Rows of one item joined: an item starts at a *code* row; rows before the first start stand alone in item 0."""
    w = Window.partitionBy(doc).orderBy(order)
    numbered = rows.withColumn("item", F.sum(F.col(text).rlike(r"^\*[^*]+\*").cast("int")).over(w))
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return numbered.groupBy(doc, "item").agg(F.array_join(F.transform(parts, lambda x: x[text]), "").alias(text), F.count(F.lit(1)).alias("n_rows"))
