"""Fields from raw text, choice among candidates, validation and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Label patterns for the invoice number, by priority.
_NOT_OTHER = "(?<!电话)(?<!银行)(?<!税)(?<!手机)(?<!传真)(?<!账号)"
NUMBER_PATTERNS = (
    r"发票号码[:：]?\s*([0-9]{8,20})",
    r"发票号[鸡吗马妈蚂][:：]?\s*([0-9]{8,20})",
    r"票据号码[:：]?\s*([0-9]{8,20})",
    _NOT_OTHER + r"号码[:：]?\s*([0-9]{8,20})",
    _NOT_OTHER + r"号[鸡吗马妈蚂][:：]?\s*([0-9]{8,20})",
    r"(?i)No[.:：]?\s*([0-9]{8,20})",
    r"(?i)FPHM[:：]?\s*([0-9]{8,20})",
)
#: Numbers without a label.
BARE_NUMBERS = (r"(?m)^\s*(\d{8}|\d{20})\s*$", r"\b(\d{20})\b")
#: What names a type.
SPECIAL_NAMES = "专票|专用|special|04"
NORMAL_NAMES = "普票|普通|normal|01|电子发票"


def first_match(text: Column, patterns, group: int = 1) -> Column:
    """First non-empty group by priority; '' if none. Later patterns run only where earlier ones fail."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns], F.lit(""))


def with_fields(texts: DataFrame, column: str, **fields) -> DataFrame:
    """``texts`` with one column per field, each a function of ``column``, in place of ``column``.

    The text is made once: the projection that makes it is not merged with the one that reads it many times.
    """
    return texts.select("*", *[of(F.col(column)).alias(name) for name, of in fields.items()]).drop(column)


def invoice_number(text: Column) -> Column:
    """Labelled numbers, then a line of just 8 or 20 digits, then a 20-digit word."""
    return first_match(text, (*NUMBER_PATTERNS, *BARE_NUMBERS))


def invoice_type(text: Column, special: tuple[str, ...], normal: tuple[str, ...]) -> Column:
    """专票 if its signals are at least as many as those of 普票; 其他 without any."""
    hits = lambda ps: sum((text.rlike(p).cast("int") for p in ps), F.lit(0))
    s, n = hits(special), hits(normal)
    return F.when((s > 0) & (s >= n), "专票").when(n > 0, "普票").otherwise("其他")


def type_name(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(SPECIAL_NAMES), "专票").when(low.rlike(NORMAL_NAMES), "普票").otherwise("其他")


def resolve(candidates: DataFrame) -> DataFrame:
    """Best candidate per document and field; of equal values in several fields the higher score stays; empty values do not count.

    ``candidates``: doc_id, field, value, score, confidence, source_rank, distance. Two aggregations with max_by, no window.
    """
    order = F.struct("confidence", "score", "source_rank", (-F.col("distance")).alias("near"), "value")
    best = candidates.where(F.coalesce("value", F.lit("")) != "").groupBy("doc_id", "field").agg(F.max_by(F.struct("value", "score", "confidence"), order).alias("b"))
    best = best.select("doc_id", "field", "b.*")
    won = best.groupBy("doc_id", "value").agg(F.max_by(F.struct("field", "score", "confidence"), F.struct("score", F.col("field"))).alias("w"))
    return won.select("doc_id", "w.field", "value", "w.score", "w.confidence")


def resolved_in_order(candidates: DataFrame, exclusive: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """doc_id, field, value, score, confidence, tokens: what stays of the best candidates of each document; equal ones go by arrival.

    1. A field takes its candidate of the highest confidence, the earliest of equal ones; empty values do not count. 2. A value that several fields
    took stays in the one of the highest score, of equal ones in the field that arrived first. 3. Of each pair in ``exclusive``, in order, whose tokens
    overlap, the field with the lower score is cleared, the second one of equal ones.
    ``candidates``: doc_id, pos, field, value, score, confidence, tokens (array). Steps 1 and 2 are sums, step 3 looks at one row a document and field.
    """
    taken = candidates.where(F.coalesce("value", F.lit("")) != "").groupBy("doc_id", "field").agg(
        F.max_by(F.struct("value", "score", "confidence", "tokens"), F.struct("confidence", (-F.col("pos")).alias("early"))).alias("b"), F.min("pos").alias("first")
    )
    taken = taken.select("doc_id", "field", "first", "b.*")
    order = F.struct("score", (-F.col("first")).alias("early"))
    won = taken.groupBy("doc_id", "value").agg(F.max_by(F.struct("field", "score", "confidence", "tokens"), order).alias("w")).select("doc_id", "value", "w.*")
    if not exclusive:
        return won.select("doc_id", "field", "value", "score", "confidence", "tokens")
    # One entry per field that has a value.
    docs = won.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value", "score", "confidence", "tokens")))).alias("fields"))
    rules = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in exclusive])

    def cleared(fields, rule):
        a, b = F.try_element_at(fields, rule["a"]), F.try_element_at(fields, rule["b"])
        clash = F.coalesce(F.arrays_overlap(a["tokens"], b["tokens"]), F.lit(False))
        loser = F.when(a["score"] >= b["score"], rule["b"]).otherwise(rule["a"])
        return F.when(clash, F.map_filter(fields, lambda k, v: k != loser)).otherwise(fields)

    kept = docs.select("doc_id", F.explode(F.aggregate(rules, F.col("fields"), cleared)).alias("field", "b"))
    return kept.select("doc_id", "field", "b.*")


def disjoint(candidates: DataFrame) -> DataFrame:
    """The candidates of each document that a greedy choice accepts: by score, then arrival, each whose tokens no accepted one has.

    ``candidates``: doc_id, pos, score, tokens (array) and more. One fold over a document's candidates, in one array; its state is the
    tokens taken so far.
    """
    order = F.struct((-F.col("score")).alias("down"), "pos", F.coalesce("tokens", F.array().cast(candidates.schema["tokens"].dataType)).alias("tokens"))
    docs = candidates.groupBy("doc_id").agg(F.sort_array(F.collect_list(order)).alias("_all"))
    start = F.struct(F.array().cast(candidates.schema["tokens"].dataType).alias("taken"), F.array().cast(candidates.select("pos").schema["pos"].dataType.simpleString().join(("array<", ">"))).alias("kept"))

    def step(acc, x):
        free = ~F.arrays_overlap(acc["taken"], x["tokens"])
        return F.when(F.coalesce(free, F.lit(True)), F.struct(F.concat(acc["taken"], x["tokens"]).alias("taken"), F.concat(acc["kept"], F.array(x["pos"])).alias("kept"))).otherwise(acc)

    kept = docs.select("doc_id", F.explode(F.aggregate("_all", start, step)["kept"]).alias("pos"))
    return candidates.join(kept, ["doc_id", "pos"], "left_semi")


def ranked(candidates: DataFrame) -> DataFrame:
    """Add rank per document and field: score, then source, both descending, then distance."""
    w = Window.partitionBy("doc_id", "field").orderBy(F.desc("score"), F.desc("source_rank"), F.asc("distance"), "value")
    return candidates.withColumn("rank", F.row_number().over(w))


def synced_confidence(score: Column, confidence: Column) -> Column:
    """A score over 1 on the 0-100 scale sets the confidence."""
    return F.when(score > 1, F.round(score / 100, 4)).otherwise(confidence)


def field_issues(fields: dict[str, tuple[Column, Column]], low: float = 0.6, fair: float = 0.85) -> Column:
    """Array of (field, severity, reason) for empty values and low confidences."""
    made = []
    for name, (value, confidence) in fields.items():
        empty = F.coalesce(value, F.lit("")) == ""
        severity = F.when(empty | (confidence < low), F.lit("error")).when(confidence < fair, F.lit("warning"))
        reason = F.when(empty, F.lit("empty")).otherwise(F.lit("confidence"))
        made.append(F.when(severity.isNotNull(), F.struct(F.lit(name).alias("field"), severity.alias("severity"), reason.alias("reason"))))
    return F.array_compact(F.array(*made))


def route(issues: Column) -> Column:
    """exception with any error, review with any warning, else accept."""
    has = lambda s: F.exists(issues, lambda x: x["severity"] == s)
    return F.when(has("error"), "exception").when(has("warning"), "review").otherwise("accept")


def quality_gate(text: Column, words: tuple[str, ...]) -> Column:
    """Number of keywords in the text."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
