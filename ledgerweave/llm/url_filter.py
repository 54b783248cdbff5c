"""URL filters: a path-template tree per host, judged by labelled purity (native expressions only).

Walking down the path segments, a segment value stays a literal branch if it looks fixed and has
enough pages; all others fall into the wildcard branch. Literal
branches whose labelled share of bad pages does not differ significantly from their siblings' are merged into
one; of those that differ, branches of similar shares, which do not differ significantly from each other's sum, are merged
again, a group for each range of shares. Each final template is scored by its bad share, smoothed towards the overall share, and
rejected from a limit on. Explicit allow and block rules go first, the longest fitting rule wins.

Everything is sums per (host, template, segment), partially aggregated before the shuffle; a host with a third of all pages
is many rows with few sums. Only kept literals, which have at least ``support`` pages each, are joined back.

In a template ``*`` stands for any segment, ``~`` and ``~n`` for merged ones, ``$`` for the end and ``**`` for the rest; a segment of a url that begins with
such a mark or a backslash is written with a backslash before it, so that it is a branch of its own.

Cases: a null url or one without ``://`` has an empty host and path; an empty table gives an empty
result; repeated rows are judged alike; without any labels nothing is rejected; null labels do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed by the contract: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A segment that varies from page to page: a number, with or without an ending, or a long hex or mixed id.
VARIABLE = r"^(\d+(\.\w+)?|[0-9a-fA-F-]{16,}|.*\d{4,}.*|.{41,})$"
WILDCARD, MERGED, END = "*", "~", "$"
#: Branches that differ from their siblings may merge within ranges of this width of asin(sqrt(share)), which has the same spread for all shares.
RANGE = 0.2


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null without one. The rules are a short list."""
    text = verdict = None
    for kind, of, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        text = F.when(fits, F.lit(of + start)) if text is None else text.when(fits, F.lit(of + start))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def alike(b: Column, m: Column, all_b: Column, all_m: Column, z: float) -> Column:
    """Two shares b / m and that of the rest of all are at most z standard errors apart; null where one has no labels."""
    own, others = F.nullif(m, F.lit(0)), F.nullif(all_m - m, F.lit(0))
    p = all_b / F.nullif(all_m, F.lit(0))
    return F.abs(b / own - (all_b - b) / others) <= z * F.sqrt(p * (1 - p) * (1 / own + 1 / others))


def templates(pages: DataFrame, support: int = 5, z: float = 1.96) -> DataFrame:
    """Add ``template`` to (page_id, host, path, bad).

    A level at a time, until no node is open: one is closed when all its pages go on alike or when it has fewer than
    ``support`` pages, so that no branch of it could be told apart. What a closed node still has below it is one wildcard.
    """
    parts = F.split(F.regexp_replace("path", r"^/|/$", ""), "/")
    rows = durable(pages.withColumn("_parts", parts).withColumn("template", F.lit("")))
    closed, level = None, 0
    while True:
        ahead = F.when(F.size("_parts") > level, F.concat(F.lit("/"), F.array_join(F.slice("_parts", level + 1, F.greatest(F.size("_parts"), F.lit(1))), "/")))
        ahead = F.coalesce(ahead, F.lit(""))
        nodes = rows.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("all_n"), F.sum("bad").alias("all_b"), F.count("bad").alias("all_m"), F.min(ahead).alias("lo"), F.max(ahead).alias("hi")
        )
        nodes = durable(nodes.withColumn("open", (F.col("lo") != F.col("hi")) & (F.col("all_n") >= support)).withColumn("below", F.col("hi") != "").drop("lo", "hi"))
        marked = rows.join(nodes.select("host", "template", "open", "below"), ["host", "template"])
        ended = F.when(F.col("below"), F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
        done = durable(marked.where("not open").withColumn("template", ended).drop("_parts", "open", "below"))
        closed = done if closed is None else closed.unionByName(done)
        if nodes.where("open").isEmpty():
            return closed
        seg = F.get("_parts", F.lit(level))
        literal = F.when(seg.rlike(r"^[*~$\\]"), F.concat(F.lit("\\"), seg)).otherwise(seg)
        rows = marked.where("open").drop("open", "below").withColumn("_seg", F.when(seg.rlike(VARIABLE), F.lit(WILDCARD)).otherwise(F.coalesce(literal, F.lit(END))))
        kids = rows.groupBy("host", "template", "_seg").agg(
            F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b"), F.count("bad").alias("m")
        )
        named = kids.where((F.col("_seg") != WILDCARD) & (F.col("n") >= support)).join(nodes, ["host", "template"])
        counts = (F.coalesce("b", F.lit(0)), F.col("m"))
        merges = F.coalesce(alike(*counts, F.col("all_b"), F.col("all_m"), z), F.lit(True)) & (F.col("_seg") != END)
        share = F.floor(F.asin(F.sqrt(F.col("b") / F.nullif(F.col("m"), F.lit(0)))) / RANGE)
        named = named.select("host", "template", "_seg", "b", "m", merges.alias("_merges"), F.when(~merges & (F.col("_seg") != END), share).alias("_range"))
        pools = named.where("_range is not null").groupBy("host", "template", "_range").agg(F.sum("b").alias("pool_b"), F.sum("m").alias("pool_m"))
        named = named.join(pools, ["host", "template", "_range"], "left")
        again = F.coalesce(alike(*counts, F.col("pool_b"), F.col("pool_m"), z), F.lit(False))
        group = F.when(F.col("_merges"), MERGED).when(again, F.concat(F.lit(MERGED), F.col("_range").cast("string"))).otherwise(F.col("_seg"))
        named = named.select("host", "template", "_seg", group.alias("_as"))
        rows = rows.join(named, ["host", "template", "_seg"], "left")
        rows = durable(
            rows.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("_as", F.lit(WILDCARD)))).drop("_seg", "_as")
        )
        level += 1


def purity(rows: DataFrame, strength: float = 8.0) -> DataFrame:
    """host, template, bad_share smoothed by ``strength`` pages of the overall share."""
    whole = rows.agg(F.coalesce(F.avg("bad"), F.lit(0.0)).alias("prior")).first()["prior"]
    sums = rows.groupBy("host", "template").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.count("bad").alias("m"))
    return sums.select("host", "template", ((F.col("b") + strength * whole) / (F.col("m") + strength)).alias("bad_share"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template, bad_share for every row of ``pages`` (page_id, url).

    ``labels``: page_id, bad (1 or 0).
    """
    known = labels.where("bad is not null").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = durable(templates(base.join(known, "page_id", "left")))
    scored = rows.join(purity(rows), ["host", "template"])
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_share") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "bad_share"
    )
