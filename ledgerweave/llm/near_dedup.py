"""MinHash near-dedup with min-max hashing.

Every permutation of a document's shingle set gives two signature values, its minimum and
its maximum, so half the hash evaluations fill the bands. Documents with equal sets become
one class by a 128-bit digest before any pair is formed. In each band bucket all classes meet the
smallest one, then the one that shares most; verified links give components; the classes that
still lie in different components of one bucket are joined by an exact prefix filter on their rarest shingles.
Every link is confirmed on the full sets of shingles, each shingle as its 64-bit hash.

Recall: with 4 rows in 32 bands a pair of similarity 0.8 shares no bucket with probability
(1 - 0.8**4)**32 = 5e-8.

Cases: a document without words or text has an empty set, no links, and itself as its component;
fewer words than a shingle make the whole sequence one shingle; rows that repeat an id are one
node; a null id takes no part (component null, kept true); an empty table gives an empty
result; extra columns are not used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.components import components
from ledgerweave.llm.token_arrays import (
    band_keys, distinct_shingles, in_pieces, minmax_signature, mix, permutations, segments, shingle_sets,
)
from ledgerweave.session import durable, temporary

BANDS, ROWS = 32, 4
PAIRS = 256
#: Buckets of at most so many members are settled pair by pair where members have marks.
SMALL = 32
TAG = np.uint64(0xA0761D6478BD642F)


def features(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), bands."""

    def run(batches):
        scale, shift = permutations(bands * rows // 2)
        for batch in in_pieces(batches, 1):
            n, keys, found = [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                found.append(band_keys(minmax_signature(s, scale, shift), bands, rows) if len(s) else np.empty(0, np.int64))
            sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(sizes, flat)],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; of an id with several texts any may do.

    Pairs are dealt out by their left side in batches of about PAIRS: its text travels once a batch and the right ones once a pair,
    sorted behind it, so that a task holds one left set while it streams through the others.
    """

    def run(batches):
        # The left sets of the group that the batch before ended with.
        key, kept, kept_size = None, np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in in_pieces(batches, 3):
            if not batch.num_rows:
                continue
            flat, offsets = distinct_shingles(batch.column(3), k)
            a, chunk = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            group = np.cumsum(np.append(False, (a[1:] != a[:-1]) | (chunk[1:] != chunk[:-1])))
            is_left = np.asarray(batch.column(2).is_null())
            if key != (a[0], chunk[0]):
                kept, kept_size = kept[:0], kept_size[:0]
            lefts, rights = np.flatnonzero(is_left), np.flatnonzero(~is_left)
            own, own_size = segments(flat, offsets, lefts)
            left, left_size = np.concatenate([kept, own]), np.concatenate([kept_size, own_size])
            of_group = np.concatenate([np.zeros(len(kept_size), np.int64), group[lefts]])
            # Every right row meets all left ones of its group: one, but for ids with several texts.
            count = np.bincount(of_group, minlength=group[-1] + 1)
            times = count[group[rights]]
            met_right = np.repeat(rights, times)
            met_left = np.repeat((np.cumsum(count) - count)[group[rights]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            right, right_size = segments(flat, offsets, met_right)
            tagged = lambda values, tags, size: mix(values + np.repeat(tags.astype(np.uint64), size) * TAG)
            hit = np.isin(tagged(right, met_left, right_size), tagged(left, np.arange(len(left_size)), left_size))
            both = np.bincount(np.repeat(np.arange(len(met_right)), right_size)[hit], minlength=len(met_right))
            close = (both > 0) & (100 * both >= percent * (left_size[met_left] + right_size - both))
            keep = pa.array(np.unique(met_right[close]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(2).take(keep)], names=["a", "b"])
            key, last = (a[-1], chunk[-1]), of_group == group[-1]
            kept, kept_size = left[np.repeat(last, left_size)], left_size[last]

    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = pairs.select("a", "b")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("chunks"))
    right = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b")
    right = right.join(one.withColumnRenamed("doc_id", "b"), "b").select("a", "chunk", "b", "text")
    left = sizes.join(one.withColumnRenamed("doc_id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), "text")
    dealt = left.unionByName(right).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long").distinct()


def common_shingles(members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """rep, order: a member's shingles that another member has too, as structs (c, s), rarest first; c members have s.

    A shingle of one member only cannot be shared by any pair. The array of a member is as long as its own text.
    """

    def explode(batches):
        for batch in in_pieces(batches, 1):
            sets = shingle_sets(batch.column(1), k)
            ids = np.repeat(np.asarray(batch.column(0)), [len(s) for s in sets]) if sets else np.empty(0, np.int64)
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat.view(np.int64))], names=["rep", "s"])

    own = texts.select(F.col("doc_id").alias("rep"), "text").join(members, "rep", "left_semi")
    shingles = durable(own.mapInArrow(explode, "rep long, s long"))
    common = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return shingles.join(common, "s").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("order"))


def residual_pairs(live: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of different components that can still reach the threshold, by prefixes of rare shingles.

    ``live``: rep, n, comp, v, order. In one global order, rarest first, the sets x and y of a link share a shingle, their
    first common one, at places i and j with at least m = percent * (nx + ny) / (100 + percent) shingles from there on in either set.
    So only the first n - percent * n / 100 places of a set are looked up, only the first n - 2 * percent * n / (100 + percent)
    in the smaller one of a pair, and a meeting counts only if both places leave room for m. Shingles of one member come first
    and meet nothing, so common passages and the shared stock of a large group are never reached.
    """
    n, at = F.col("n"), F.col("n") - F.col("v") + F.col("_at")
    places = live.select("rep", "n", "comp", (n - F.floor((percent * n + 99) / 100) + 1 - (n - F.col("v"))).alias("_take"), "v", "order").where("_take > 0")
    places = places.select("rep", "n", "comp", "v", F.posexplode(F.slice("order", F.lit(1), F.col("_take").cast("int"))).alias("_at", "_cs"))
    places = durable(places.select("rep", "n", "comp", F.col("_cs.s").alias("s"), (n - at).alias("room")))
    small = places.where((100 + percent) * F.col("room") >= 2 * percent * n)
    x = small.select("s", *[F.col(c).alias(f"{c}1") for c in ("rep", "n", "comp", "room")])
    y = places.select("s", *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "comp", "room")])
    meet = (
        (F.struct("n1", "rep1") < F.struct("n2", "rep2"))
        & (F.col("comp1") != F.col("comp2"))
        & ((100 + percent) * F.least("room1", "room2") >= percent * (F.col("n1") + F.col("n2")))
    )
    return x.join(y, (x["s"] == y["s"]) & meet).select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()


def several(entries: DataFrame, outer: bool = False) -> DataFrame:
    """Entries of the buckets whose members lie in more than one component, with the number of ``members``."""
    bands = entries.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"))
    return durable(entries.drop("members").join(bands.where("lo <> hi").select("band", "members"), "band"), outer)


def within_marks(x, y, percent: int):
    """Whether the sets of ``x`` and ``y`` (functions from n, m0, m1 to columns) may reach the threshold by their sizes and marks.

    The marks of a set are the cells that its shingles fall into. A cell of one set only holds a shingle of that set only, so the sets
    differ in d shingles at least, d being the cells in which the marks differ; a link needs (100 - percent) * (n1 + n2) >= (100 + percent) * d.
    """
    d = F.bit_count(x("m0").bitwiseXOR(y("m0"))) + F.bit_count(x("m1").bitwiseXOR(y("m1")))
    return (100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))) & ((100 - percent) * (x("n") + y("n")) >= (100 + percent) * d)


def bucket_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of different components in one bucket that may reach the threshold by sizes and marks."""
    side = lambda i: entries.select("band", *[F.col(c).alias(f"{c}{i}") for c in ("rep", "n", "m0", "m1", "comp")])
    may = within_marks(lambda c: F.col(f"{c}1"), lambda c: F.col(f"{c}2"), percent)
    x, y = side(1), side(2)
    return x.join(y, (x["band"] == y["band"]) & (F.col("rep1") < F.col("rep2")) & (F.col("comp1") != F.col("comp2")) & may).select(F.col("rep1").alias("a"), F.col("rep2").alias("b")).distinct()


def regrouped(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with the components of ``labels`` (node, component); unlinked members are their own."""
    node = labels.select(F.col("node").alias("rep"), F.col("component").alias("_c"))
    return entries.join(node, "rep", "left").withColumn("comp", F.coalesce("_c", "rep")).drop("_c")


def linked(entries: DataFrame, texts: DataFrame, k: int, percent: int, apart=lambda pairs: pairs) -> DataFrame:
    """node, component for all linked nodes. ``entries``: rep, n (set size), band, perhaps w; ``texts``: doc_id, text of the reps, no others.

    Of all pairs (a, b) only those that ``apart`` keeps can be links. With w, the members of a bucket meet its heaviest one first.
    With m0 and m1 (see ``within_marks``), pairs that their marks keep from the threshold are not looked up, and after step 1 the buckets
    of at most SMALL members are settled by all their other pairs; the larger ones go on to steps 2 and 3.

    1. In every bucket all members meet the smallest one. 2. In buckets that still hold several components, members
    meet the one with most shared shingles, which is nearest to the others. Who has met all others of a bucket leaves it. 3. The members of buckets that even then hold
    several components are joined by prefixes of their rare shingles (``residual_pairs``), which forms the pairs of different
    components that can reach the threshold, and no others. All bounds are exact: with at most
    v shared shingles, sizes n1 and n2 need 100 * m >= percent * (n1 + n2 - m) for m = min(v1, v2).
    """
    with temporary():
        heavy = [(-F.col("w")).alias("light")] if "w" in entries.columns else []
        marks = [c for c in ("m0", "m1") if c in entries.columns]
        lead = entries.groupBy("band").agg(F.min(F.struct(*heavy, "rep", "n", *marks)).alias("lead"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
        lead = lead.where("lo <> hi").drop("lo", "hi")
        star = lambda x: x.select(F.col("node").alias("a"), F.col("component").alias("b"))
        if marks:
            fits = within_marks(F.col, lambda c: F.col(f"lead.{c}"), percent)
        else:
            fits = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
        with temporary():
            met = durable(entries.join(lead, "band").where(F.col("rep") != F.col("lead.rep")))
            stars = met.where(fits).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct()
            labels = durable(components(verified(durable(apart(stars)), texts, k, percent)), outer=True)
            rest = several(regrouped(met.select("rep", "n", *marks, "band"), labels), outer=True)
        if marks:
            pairs = bucket_pairs(rest.where(F.col("members") <= SMALL), percent)
            labels = durable(components(star(labels).unionByName(verified(durable(apart(pairs)), texts, k, percent))), outer=True)
            rest = several(regrouped(rest.where(F.col("members") > SMALL).drop("comp", *marks), labels))
            if rest.isEmpty():
                return labels
        texts = durable(texts.join(rest.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
        known = durable(
            common_shingles(rest.select("rep").distinct(), texts, k)
            .withColumn("v", F.size("order").cast("long"))
            .join(rest.select("rep", "n").distinct(), "rep")
            .where(F.col("v") * 100 >= percent * F.col("n"))
        )
        live = several(rest.join(known.select("rep", "v"), "rep"))
        best = live.groupBy("band").agg(F.max(F.struct("v", (-F.col("rep")).alias("minus"), "n", "comp")).alias("top"))
        reach = lambda v1, n1, v2, n2: F.least(v1, v2) * 100 >= percent * (n1 + n2 - F.least(v1, v2))
        near = live.join(best, "band").where((F.col("comp") != F.col("top.comp")) & reach(F.col("v"), F.col("n"), F.col("top.v"), F.col("top.n")))
        pairs = near.select((-F.col("top.minus")).alias("a"), F.col("rep").alias("b")).distinct()
        labels = durable(components(star(labels).unionByName(verified(durable(apart(pairs)), texts, k, percent))))

        rest = live.join(best.select("band", (-F.col("top.minus")).alias("_top")), "band").where("rep <> _top")
        live = several(regrouped(rest.drop("comp", "_top"), labels))
        left = known.join(live.select("rep", "comp").distinct(), "rep")
        more = verified(durable(apart(residual_pairs(left, percent))), texts, k, percent)
        return durable(components(star(labels).unionByName(more)), outer=True)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    facts = durable(features(docs, k, bands, rows))
    named = facts.where("set_key is not null and doc_id is not null")
    reps = durable(
        named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    with temporary():
        entries = reps.select("rep", "n", F.explode("bands").alias("band"))
        full = entries.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("band")
        entries = durable(entries.join(full, "band", "left_semi"))
        members = entries.select(F.col("rep").alias("doc_id")).distinct()
        texts = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members, "doc_id", "left_semi"))
        labels = durable(linked(entries, texts, k, percent), outer=True)
    classes = reps.select("set_key", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    classes = classes.select("set_key", F.coalesce("component", "rep").alias("_component"))
    out = facts.drop("bands").join(classes, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
