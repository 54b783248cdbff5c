"""Quality rules as a short-circuit cascade (native expressions only).

Each rule is a boolean rejection test over a text column. ``plan_cascade`` takes every rule's
rejection rate and its time from a bounded sample and orders the rules by rejections per second;
``cascade`` nests them in one CASE, whose later branches are evaluated only for rows
that all earlier rules let pass. The order changes the cost and the name of the rule that is met first, never the verdict.

Cases: a null text counts as a text without words; an empty text likewise; an empty table
gives an empty result; repeated rows are judged one by one; extra columns pass through whatever their names, and
a column of the input that has the name of an added one is replaced by it.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.session import durable

#: A word of the contract: a run of anything but blanks (code points 32 and 9 to 13).
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Positions use the low 24 bits of a sort key; the other 40 hold a window's hash. Longer texts sort the windows themselves.
POSITION_BITS = 24


@dataclass(frozen=True)
class Rule:
    """``reject`` is true for bad rows."""

    name: str
    reject: Column


def pieces_of(text: Column) -> Column:
    """The text cut at every single blank: one more piece than blanks, empty pieces included."""
    return F.split(text, BLANK)


def words_of(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.coalesce(F.array_remove(pieces_of(text), ""), F.array().cast("array<string>"))


def window_hashes(words: Column) -> Column:
    """One 64-bit hash per three-word window."""
    return F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )


def window_keys(hashes: Column) -> Column:
    """Sorted keys of 40 bits of hash and 24 bits of position; null where all hashes differ."""
    mask = (1 << POSITION_BITS) - 1
    return F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))),
    )


def _same_window(words: Column, a: Column, b: Column) -> Column:
    return (
        (F.get(words, a) == F.get(words, b))
        & (F.get(words, a + 1) == F.get(words, b + 1))
        & (F.get(words, a + 2) == F.get(words, b + 2))
    )


_OWN = ("_pieces", "_lines", "_words", "_hashes", "_keys", "_some", "_exact", "_starts")


def set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named like one of ``names`` renamed, and the names to give back."""
    used, back = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.lower() in names:
            fresh = c
            while fresh.lower() in used or fresh.lower() in names:
                fresh += "_"
            used.add(fresh.lower())
            back[fresh] = c
    return docs.withColumnsRenamed({c: fresh for fresh, c in back.items()}), back


def with_text_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    n_repeat_words counts the words covered by three-word windows that occur at least
    twice in the text. Windows meet by sorting 40-bit hashes with their positions inside
    the row, and equal neighbours are compared word by word; where a hash hits different
    windows, the row falls back to sorting the windows themselves, so the count is exact.
    """
    docs, back = set_aside(docs, _OWN)
    mask = F.lit((1 << POSITION_BITS) - 1)
    pos = lambda k: k.bitwiseAND(mask).cast("int")
    blob = F.col(text)
    lines = F.filter(F.split(blob, "\n"), lambda x: x.rlike(WORD))
    df = docs.withColumns({"_pieces": pieces_of(blob), "_lines": F.coalesce(lines, F.array().cast("array<string>"))})
    df = df.withColumn("_words", F.coalesce(F.array_remove("_pieces", ""), F.array().cast("array<string>")))
    df = df.withColumn("_hashes", window_hashes(F.col("_words")))
    df = df.withColumn("_keys", window_keys(F.col("_hashes")))
    words, keys = F.col("_words"), F.col("_keys")
    # A sign bit that the shift brings in does no harm: equal high bits give 0.
    near = lambda k, other: F.shiftright(k.bitwiseXOR(other), POSITION_BITS) == 0
    # Keys that share their hash with a neighbour: the only possible repeats, and few.
    df = df.withColumn(
        "_some",
        F.filter(
            keys,
            lambda k, i: F.coalesce(near(k, F.get(keys, i + 1)), F.lit(False)) | F.coalesce(near(k, F.get(keys, i - 1)), F.lit(False)),
        ),
    )
    some = F.col("_some")
    # True where a key has its predecessor's hash but not its words.
    clash = F.exists(
        F.transform(
            some,
            lambda k, i: F.coalesce(
                near(k, F.get(some, i - 1)) & ~_same_window(words, pos(k), pos(F.get(some, i - 1))), F.lit(False)
            ),
        ),
        lambda x: x,
    )
    text_windows = F.sort_array(
        F.transform(
            F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.struct(w.alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("p")),
        )
    )
    long = F.size(words) > F.lit(1 << POSITION_BITS)
    df = df.withColumn("_exact", F.when(long | F.coalesce(clash, F.lit(False)), text_windows))
    ex = F.col("_exact")
    alike = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    exact = F.transform(
        F.filter(
            ex,
            lambda x, i: F.coalesce(alike(x, F.get(ex, i - 1)), F.lit(False)) | F.coalesce(alike(x, F.get(ex, i + 1)), F.lit(False)),
        ),
        lambda x: x["p"],
    )
    df = df.withColumn("_starts", F.sort_array(F.when(ex.isNotNull(), exact).otherwise(F.transform(some, pos))))
    starts = F.col("_starts")
    covered = F.aggregate(
        F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x.cast("long"),
    )
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.coalesce(F.length(blob) - F.size("_pieces") + 1, F.lit(0)).cast("long"),
            "n_symbols": F.coalesce(F.length(F.regexp_replace(blob, "[^" + SYMBOLS + "]+", "")), F.lit(0)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        }
    ).drop(*_OWN).withColumnsRenamed(back)


def metric_rules() -> list[Rule]:
    """Rules over the metric columns and, at a price, over the text itself.

    Fixed limits after published filters for web text: at most one symbol per ten words,
    at most three repeated lines per ten (two are always allowed), mean word length from 2 to 15, at least six of ten words with a
    letter, fewer than three of ten words shouted or ending in two exclamation marks.
    """
    n = F.col("n_words")
    count = lambda pattern: F.coalesce(F.regexp_count(F.col("text"), F.lit(pattern)), F.lit(0))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("dup_lines", (F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") * 10 > 3 * (count("\n") + 1))),
        Rule("letters", count(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0Da-zA-Z\x{80}-\x{10FFFF}]+(?![^\x20\x09-\x0D])") * 10 > 4 * n),
        Rule("shouting", count(r"!!(?![^\x20\x09-\x0D])") * 10 > 3 * n),
    ]


def base_rule() -> Column:
    """The contract's base test on the metric columns."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measured_costs(sample: DataFrame, rules: list[Rule], text: str = "text", rows: int = 20_000, runs: int = 2, step: float = 0.05) -> list[float]:
    """Seconds that each rule takes on ``sample``, repeated to about ``rows`` rows, beyond a pass that only reads it.

    The shortest of ``runs`` passes counts (the first one compiles), in whole steps of ``step`` seconds, one at least:
    differences below a step are noise.
    """
    repeats = max(1, rows // max(1, sample.count()))
    many = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("_repeat"))

    def seconds(what: Column) -> float:
        taken = []
        for _ in range(runs):
            began = time.perf_counter()
            many.agg(F.sum(what)).collect()
            taken.append(time.perf_counter() - began)
        return min(taken)

    reading = seconds(F.coalesce(F.length(text), F.lit(0)) + F.col("n_words"))
    return [max(1, math.ceil((seconds(F.coalesce(r.reject, F.lit(False)).cast("int")) - reading) / step)) * step for r in rules]


def plan_cascade(sample: DataFrame, rules: list[Rule], text: str = "text") -> list[Rule]:
    """Order ``rules`` by rejections per second as seen on ``sample``; ties by cost, then as given.

    Of the sample come back one row of rejection rates and the seconds of each rule. An empty sample leaves the rules as given.
    """
    rates = sample.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(r.reject, F.lit(False)).cast("int")).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    if rates["n"] == 0:
        return list(rules)
    costs = measured_costs(sample, rules, text)
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-rates[f"r{i}"] / costs[i], costs[i], i))]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are skipped."""
    out = None
    for r in rules:
        test = F.coalesce(r.reject, F.lit(False))
        out = F.when(test, F.lit(r.name)) if out is None else out.when(test, F.lit(r.name))
    return out if out is not None else F.lit(None).cast("string")


def bounded_sample(docs: DataFrame, rows: int, seed: int = 17) -> DataFrame:
    """About ``rows`` rows spread over the table (all of a smaller table)."""
    total = docs.count()
    return docs if total <= rows else docs.sample(False, rows / total, seed)


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Add the metrics, base_failed, rejected_by and kept. ``sample_rows`` bounds the planning sample.

    ``rejected_by`` is the first rule met in the planned order; where several reject a row, it may differ between runs.

    The row number in ``kept`` (always true) makes the column nondeterministic, so a filter on
    it is not pushed below the metric columns, which would copy their expressions many times.
    """
    rules = metric_rules() if rules is None else rules
    measured = durable(with_text_metrics(bounded_sample(docs.select("text"), sample_rows)))
    ordered = plan_cascade(measured.where(~base_rule()), rules)
    judged = with_text_metrics(docs).withColumn("base_failed", base_rule())
    judged = judged.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered)))
    return judged.withColumn("kept", F.col("rejected_by").isNull() & (F.monotonically_increasing_id() >= 0))
