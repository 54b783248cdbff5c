"""Substring dedup: paragraph MinHash banding.

1. Anchors: the smallest shingle hash of any WINDOW neighbouring shingles of a text (winnowing), with the ANCHOR words from its
place on. Documents none of whose anchors occurs in another document share no run of WINDOW + ANCHOR - 1 = 20 words with any and
leave here. 2. The others are cut by content alone. Paragraphs run from every line and sentence start to the first sentence end
at least MIN_WORDS words later, at most MAX_WORDS. Blocks are the MIN_WORDS words from every anchor's place. Those without an anchor that
another document has leave. Equal units are one class. 3. Paragraphs are banded by min-max signatures of their five-word shingles;
in a bucket the classes meet the one with most occurrences first. Pairs whose marks (128 cells that shingles fall into) differ too much
for the threshold are left out, which loses none. Colliding classes are verified by exact Jaccard similarity and joined to
components. Paragraphs that overlap in one document are no copies of each other. A component that reaches over several documents is a repeated passage: its
smallest document keeps it, the others lose it, and overlapping removals of a document merge to spans.

Recall: any WINDOW + MIN_WORDS - 1 = 36 words that two texts share hold a whole block, whatever stands around
them and with or without punctuation, so that passage is found; blocks begin at most WINDOW words apart and overlap. BANDS bands of
ROWS rows miss a pair of paragraphs of similarity 0.8 with probability (1 - 0.8**2)**8 = 2.8e-4, whatever their first words. A pair of
similarity 0.8 shares a run of 20 words, as each place where two runs meet costs 8 shingles, unless runs of four words repeat inside it.

Cases: texts without words or with fewer than MIN_WORDS words have no unit; rows that repeat an id and its text are one
document; an id with several texts is several documents, those after its first text (by hash) ordered behind all others; a null id takes no part; of documents with equal passages the smallest id keeps them, of equal spans in a document all
count once; an empty table gives an empty result; extra columns are not carried by the query and pass through
``remove_passages`` whatever their names. Only documents that share a passage appear. Positions are in code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.near_dedup import linked
from ledgerweave.llm.token_arrays import in_pieces, mix, permutations, split_words, word_hashes
from ledgerweave.session import durable, temporary

MIN_WORDS, MAX_WORDS, LONG_SENTENCE = 25, 60, 40
SHINGLE, PERCENT = 5, 80
WINDOW, ANCHOR = 12, 9
BANDS, ROWS = 8, 2
_FACTS = {"n": F.max, "w": F.sum, "lo": F.min, "hi": F.max, "last": F.max, "first": F.min, "m0": F.max, "m1": F.max}
_WEIGHTS = np.array([3, 5, 7, 11, 13], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def _row_ends(words) -> np.ndarray:
    return np.repeat(words.offsets[1:], np.diff(words.offsets))


def _cuts(words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-plus-one word of every paragraph of a batch, and the hash of its first two words."""
    n = len(h)
    row_end = _row_ends(words)
    opens = np.zeros(n, dtype=bool)
    opens[words.offsets[:-1][np.diff(words.offsets) > 0]] = True
    opens[1:] |= words.stop[:-1]
    index = np.arange(n)
    pair = mix(h + np.append(h[1:], np.uint64(0)) * np.uint64(0xC2B2AE3D27D4EB4F))
    since = index - np.maximum.accumulate(np.where(opens, index, 0))
    opens |= (since >= LONG_SENTENCE) & (pair % np.uint64(16) == 0)
    first = index[opens & (index + MIN_WORDS <= row_end)]
    stops = np.append(index[words.stop], n)
    at = stops[np.searchsorted(stops, first + MIN_WORDS - 1)] + 1
    return first, np.minimum(np.minimum(at, first + MAX_WORDS), row_end[first]), pair[first]


def _shingles(h: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE words from every word on; the last ones of the batch are 0."""
    n = max(len(h) - SHINGLE + 1, 0)
    full = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        full += h[j : n + j] * _WEIGHTS[j]
    return np.append(mix(full), np.zeros(len(h) - n, dtype=np.uint64))


def _places(words, full: np.ndarray, length: int) -> np.ndarray:
    """Words with the smallest hash of any WINDOW shingles of one row, the last of equals, that have ``length`` words left."""
    if len(full) < WINDOW + SHINGLE - 1:
        return np.empty(0, dtype=np.int64)
    row_end = _row_ends(words)
    low, size = full[: len(full) - SHINGLE + 1], 1
    place = np.arange(len(low))
    while size < WINDOW:
        step = min(size, WINDOW - size)
        right = low[step:] <= low[:-step]
        low, place = np.where(right, low[step:], low[:-step]), np.where(right, place[step:], place[:-step])
        size += step
    inside = np.arange(len(place)) + WINDOW + SHINGLE - 1 <= row_end[: len(place)]
    first = np.unique(place[inside])
    return first[first + length <= row_end[first]]


def sharing_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, places (words, sorted) of the documents with anchors that another document has too."""

    def run(batches):
        for batch in in_pieces(batches, 1):
            words = split_words(batch.column(1))
            full = _shingles(word_hashes(words))
            at = _places(words, full, ANCHOR)
            key = mix(full[at] + full[at + (ANCHOR - SHINGLE) // 2] * _WEIGHTS[1] + full[at + ANCHOR - SHINGLE] * _WEIGHTS[2])
            row = np.searchsorted(words.offsets, at, side="right") - 1
            ids = np.asarray(batch.column(0))[row] if len(at) else np.empty(0, np.int64)
            at = (at - words.offsets[row]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at), pa.array(key.view(np.int64))], names=["doc_id", "at", "key"])

    with temporary():
        anchors = durable(docs.mapInArrow(run, "doc_id long, at int, key long"))
        again = anchors.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("key")
        # The keys that repeat are one row each; hashed per task they spare the sort of all anchors.
        sharing = anchors.join(again.hint("shuffle_hash"), "key", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("places"))
        return durable(docs.join(durable(sharing), "doc_id"), outer=True)


def _distinct(full: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many different shingles first to last - 1 of every paragraph are: those that did not occur in it before."""
    order = np.argsort(full, kind="stable")
    before = np.full(len(full), -1, dtype=np.int64)
    same = full[order[1:]] == full[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    size = last - first
    begin = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(first - begin, size)
    return np.add.reduceat((before[at] < np.repeat(first, size)).astype(np.int64), begin)


def _bands(full: np.ndarray, spans: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """One row of BANDS keys per paragraph; ROWS values of min-max signatures make a key."""
    values = []
    for a, b in zip(scale, shift):
        p = (full * a + b) >> np.uint64(32)
        values += [np.minimum.reduceat(p, spans)[::2], np.maximum.reduceat(p, spans)[::2]]
    keys = np.empty((len(spans) // 2, BANDS), dtype=np.int64)
    for j in range(BANDS):
        key = np.full(len(keys), (j + 1) * 0xD6E8FEB86659FD93 % 2**64, dtype=np.uint64)
        for r in range(ROWS):
            # Every row of a band is the minimum or the maximum of another permutation.
            key = mix(key ^ (values[(j + r * BANDS) % len(values)] * _WEIGHTS[r % len(_WEIGHTS)]))
        keys[:, j] = key.view(np.int64)
    return keys


def _marks(full: np.ndarray, spans: np.ndarray) -> list[np.ndarray]:
    """Two columns of 64 bits per paragraph: of 128 cells those that its shingles fall into."""
    bit, upper = np.uint64(1) << (full & np.uint64(63)), full & np.uint64(64) != 0
    return [np.bitwise_or.reduceat(np.where(upper == half, bit, np.uint64(0)), spans)[::2].view(np.int64) for half in (False, True)]


def paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs and blocks of ``sharing_documents``: doc_id, cs, ce (code points), n (distinct shingles), k1, k2 (content hashes), opening (hash of two words), m0, m1 (cells of its shingles) and bands (these null for a block).

    Without the column ``places`` all paragraphs and blocks, else those with a shared anchor: equal or near ones share one.
    """

    def run(batches):
        scale, shift = permutations(BANDS * ROWS // 2, seed=8)
        for batch in in_pieces(batches, 1):
            words = split_words(batch.column(1), True, True)
            h = word_hashes(words)
            first = last = np.empty(0, dtype=np.int64)
            n_paragraphs = 0
            if len(h) >= MIN_WORDS:
                full = np.append(_shingles(h), np.uint64(0))
                first, last, opening = _cuts(words, h)
                blocks = _places(words, full[:-1], MIN_WORDS)
                if pruned:
                    places = batch.column(2)
                    shared = np.asarray(places.flatten()) + np.repeat(words.offsets[:-1], np.asarray(pc.list_value_length(places)))
                    upto = np.append(0, np.cumsum(np.bincount(shared, minlength=len(h))))
                    # A paragraph holds a whole anchor from one of its words on.
                    some = upto[last - ANCHOR + 1] > upto[first]
                    first, last, opening = first[some], last[some], opening[some]
                    blocks = blocks[upto[blocks + 1] > upto[blocks]]
                n_paragraphs = len(first)
                # A paragraph of the same words stands for its block.
                blocks = blocks[~np.isin(blocks, first[last - first == MIN_WORDS])]
                first, last = np.append(first, blocks), np.append(last, blocks + MIN_WORDS)
            row = np.searchsorted(words.offsets, first, side="right") - 1
            out = {"doc_id": pa.array(np.asarray(batch.column(0))[row] if len(first) else [], pa.int64())}
            bands = opens = m0 = m1 = np.empty(0, np.int64)
            if len(first):
                opens = np.append(opening, np.zeros(len(first) - n_paragraphs, np.uint64)).view(np.int64)
                spans = np.column_stack([first, last - SHINGLE + 1]).ravel()
                near = spans[: 2 * n_paragraphs]
                k1 = mix(np.add.reduceat(full, spans)[::2])
                k2 = np.add.reduceat(mix(full + np.uint64(1)), spans)[::2]
                n = _distinct(full, first, last - SHINGLE + 1)
                if n_paragraphs:
                    bands = _bands(full, near, scale, shift).ravel()
                    m0, m1 = _marks(full, near)
                m0, m1 = (np.append(m, np.zeros(len(first) - n_paragraphs, np.int64)) for m in (m0, m1))
            else:
                k1 = k2 = n = np.empty(0, np.uint64)
            begin = np.minimum(np.arange(len(first) + 1), n_paragraphs).astype(np.int32) * BANDS
            lists = pa.ListArray.from_arrays(pa.array(begin, mask=np.append(np.arange(len(first)) >= n_paragraphs, False)), pa.array(bands, pa.int64()))
            out |= {
                "cs": pa.array(words.begin[first], pa.int32()),
                "ce": pa.array(words.end[last - 1] if len(first) else [], pa.int32()),
                "n": pa.array(n.astype(np.int32)),
                "k1": pa.array(k1.view(np.int64)),
                "k2": pa.array((k2 >> np.uint64(33)).astype(np.int32)),
                "opening": pa.array(opens, mask=np.arange(len(first)) >= n_paragraphs),
                "m0": pa.array(m0, mask=np.arange(len(first)) >= n_paragraphs),
                "m1": pa.array(m1, mask=np.arange(len(first)) >= n_paragraphs),
                "bands": lists,
            }
            yield pa.RecordBatch.from_pydict({c: out[c] for c in names})

    pruned = "places" in docs.columns
    names = ("doc_id", "cs", "ce", "n", "k1", "k2", "opening", "m0", "m1", "bands")
    return docs.mapInArrow(run, "doc_id long, cs int, ce int, n int, k1 long, k2 int, opening long, m0 long, m1 long, bands array<long>")


def several_texts(docs: DataFrame) -> DataFrame | None:
    """doc_id, h, key: an own key for every text (by its hash) after the first one of an id with several texts; None where no id has.

    Keys are above all ids, so that these texts come after those of all other documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).where("doc_id is not null")
    first = rows.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    first = durable(first, outer=True)
    if first.isEmpty():
        return None
    most = rows.agg(F.max("doc_id")).first()[0]
    later = durable(rows.join(first, "doc_id").where("h <> lo").select("doc_id", "h").distinct(), outer=True)
    return durable(later.select("doc_id", "h", (F.monotonically_increasing_id() + F.lit(most) + 1).alias("key")), outer=True)


def keyed(docs: DataFrame, keys: DataFrame | None) -> DataFrame:
    """key, text of the rows with an id; a row's key is its id but for the texts in ``keys``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    if keys is None:
        return rows.select(F.col("id").alias("key"), "text")
    own = keys.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("key").alias("_key"))
    found = rows.join(own, (F.col("id") == F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left")
    return found.select(F.coalesce("_key", "id").alias("key"), "text")


def by_ids(rows: DataFrame, keys: DataFrame | None, *columns: str) -> DataFrame:
    """``rows`` with the ids of the keys in ``columns``."""
    for c in columns if keys is not None else ():
        own = keys.select(F.col("key").alias("_k"), F.col("doc_id").alias("_id"))
        rows = rows.join(own, F.col(c) == F.col("_k"), "left").withColumn(c, F.coalesce("_id", c)).drop("_k", "_id")
    return rows


def repeated_passages(docs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """One row per unit of a component that several documents share: doc_id, cs, ce, cluster, keeper, removed, own (its first words are of no other unit).

    Ids stand for keys where ``keys`` has some (see ``several_texts``).
    """
    with temporary():
        # Texts, bands and marks lie on disk until the members of buckets are known, no longer.
        with temporary():
            docs = sharing_documents(keyed(docs, keys).select(F.col("key").alias("doc_id"), "text"))
            with temporary():
                found = durable(paragraphs(docs))
                banded = durable(unit_classes(found), outer=1)
                units = durable(found.select("doc_id", "cs", "ce", "k1", "k2"), outer=3)
            classes = durable(banded.select("k1", "k2", "opening", "lo", "hi"), outer=1)
            members = bucket_members(docs, banded)
        labels = near_classes(*members)
        classes = classes.join(labels, F.col("k1") == F.col("node"), "left").where("node is not null or lo <> hi")
        classes = durable(classes.select("k1", "k2", F.coalesce("component", "k1").alias("cluster"), "opening", "lo", "hi"))
        spread = classes.groupBy("cluster").agg(F.min("lo").alias("keeper"), F.max("hi").alias("last")).where("keeper <> last").drop("last")
        # A paragraph of one document whose opening no other one of its component has begins in words of its own.
        alone = classes.where("opening is not null").groupBy("cluster", "opening").agg(F.max("k1").alias("k1"), F.max("k2").alias("k2"), F.count(F.lit(1)).alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        alone = alone.where("c = 1 and lo = hi").select("k1", "k2", F.lit(True).alias("own"))
        shared = classes.join(spread, "cluster").join(alone, ["k1", "k2"], "left")
        shared = durable(shared.select("k1", "k2", "cluster", "keeper", F.coalesce("own", F.lit(False)).alias("own")), outer=True)
    hit = units.join(shared.hint("shuffle_hash"), ["k1", "k2"])
    return hit.select("doc_id", "cs", "ce", "cluster", "keeper", (F.col("doc_id") != F.col("keeper")).alias("removed"), "own")


def unit_classes(units: DataFrame) -> DataFrame:
    """k1, k2, the facts of _FACTS, at, opening and bands (b0, b1, ...) of the classes of equal units that are paragraphs or lie in several documents."""
    facts = [f(c).alias(c) for c, f in _FACTS.items()]
    names = [f"b{j}" for j in range(BANDS)]
    # Plain numbers only, so that classes are hashed, not sorted. ``at`` is an occurrence in document lo: cs and ce in one number.
    seen = units.select(
        "k1", "k2", "n", "opening", "m0", "m1", *[F.get("bands", F.lit(j)).alias(c) for j, c in enumerate(names)],
        F.col("doc_id").alias("lo"), F.col("doc_id").alias("hi"), F.col("cs").alias("last"), F.col("ce").alias("first"), F.lit(1).alias("w"),
        F.shiftleft(F.col("cs").cast("long"), 32).bitwiseOR(F.col("ce").cast("long")).alias("at"),
    )
    classes = seen.groupBy("k1", "k2").agg(*facts, F.min_by("at", "lo").alias("at"), *[F.max(c).alias(c) for c in ("opening", *names)])
    return classes.where("opening is not null or lo <> hi")


def bucket_members(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the classes of paragraphs (k1 as rep) that meet another one in a bucket: band, rep, n, w, m0, m1 per bucket; their facts; their texts.

    All three outlive the caller's block.
    """
    near = classes.where("opening is not null").withColumnRenamed("k1", "rep")
    # Both the search for mixed buckets and the look at their members go by band; rows have a document only if it is their one.
    only = F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("only")
    entries = near.select("rep", only, "last", "first", F.explode(F.array(*[f"b{j}" for j in range(BANDS)])).alias("band")).repartition("band")
    spread = F.max(F.col("only").isNull()) | (F.min("only") < F.max("only")) | (F.max("last") >= F.min("first"))
    mixed = entries.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), spread.alias("spread"))
    mixed = mixed.where("least <> most and spread").select("band")
    facts = near.groupBy("rep").agg(*[f(c).alias(c) for c, f in _FACTS.items()], F.min_by("at", "lo").alias("at"))
    close = durable(entries.select("rep", "band").join(mixed.hint("shuffle_hash"), "band").join(facts.select("rep", "n", "w", "m0", "m1"), "rep"), outer=True)

    # One occurrence of every class that collides stands for its text.
    facts = durable(facts.join(close.select("rep").distinct(), "rep", "left_semi"), outer=True)
    cs = F.shiftright("at", 32).cast("int")
    found = facts.select("rep", F.col("lo").alias("doc_id"), cs.alias("cs"), (F.col("at").bitwiseAND(F.lit(2**32 - 1)).cast("int") - cs).alias("size"))
    texts = found.join(docs, "doc_id").select(F.col("rep").alias("doc_id"), F.expr("substring(text, cs + 1, size)").alias("text"))
    return close, facts, durable(texts, outer=True)


def near_classes(close: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """node, component of the classes of paragraphs (k1) that near copies link, from their ``bucket_members``.

    Paragraphs that overlap in one document are no copies of each other.
    """

    def apart(pairs):
        side = lambda x: facts.select(F.col("rep").alias(x), F.struct("lo", "hi", "last", "first").alias(f"_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        within = (F.col("_a.lo") == F.col("_b.hi")) & (F.col("_a.hi") == F.col("_b.lo"))
        return both.where(~within | (F.col("_a.last") >= F.col("_b.first")) | (F.col("_b.last") >= F.col("_a.first"))).select("a", "b")

    return linked(close, texts, SHINGLE, PERCENT, apart)


def merged_spans(hits: DataFrame) -> DataFrame:
    """Per document: n_paragraphs, and its removals merged to spans (array of begin, end); linear in its hits.

    A paragraph that begins in words of its own is removed from where another one begins inside it.
    """
    backwards = Window.partitionBy("doc_id").orderBy(F.desc("cs"))
    hits = hits.withColumn("_next", F.min(F.when(~F.col("own"), F.col("cs"))).over(backwards))
    hits = hits.withColumn("cs", F.when(F.col("own") & (F.col("_next") < F.col("ce")), F.col("_next")).otherwise(F.col("cs"))).drop("_next")
    ordered = Window.partitionBy("doc_id").orderBy("cs", "ce")
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
    gone = F.when(F.col("removed"), F.col("ce"))
    marked = hits.withColumn("_fresh", (F.col("removed") & F.coalesce(F.col("cs") > F.max(gone).over(upto) + 1, F.lit(True))).cast("int"))
    marked = marked.withColumn("_span", F.sum("_fresh").over(ordered))
    spans = marked.groupBy("doc_id", "_span").agg(
        F.count(F.lit(1)).alias("n"), F.min("keeper").alias("keeper"),
        F.min(F.when(F.col("removed"), F.col("cs"))).alias("cs"), F.max(gone).alias("ce"),
    )
    span = F.when(F.col("cs").isNotNull(), F.struct("cs", "ce"))
    return spans.groupBy("doc_id").agg(
        F.sum("n").alias("n_paragraphs"), F.min("keeper").alias("keeper"), F.sort_array(F.collect_list(span)).alias("spans")
    )


def op4_query(docs: DataFrame) -> DataFrame:
    keys = several_texts(docs)
    out = by_ids(merged_spans(repeated_passages(docs, keys)), keys, "doc_id", "keeper")
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["ce"] - x["cs"]).cast("long"))
    return out.select("doc_id", "keeper", "n_paragraphs", F.size("spans").cast("long").alias("n_spans"), chars.alias("removed_chars"), "spans")


def remove_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed spans cut out of ``text``; other columns and rows stay."""
    keys = several_texts(docs)
    found = merged_spans(repeated_passages(docs, keys)).select(F.col("doc_id").alias("id"), "spans").where(F.size("spans") > 0).alias("found")
    rows = docs.alias("rows")
    key = F.col("rows.doc_id").cast("long")
    if keys is not None:
        own = keys.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("key").alias("_key")).alias("own")
        rows = rows.join(own, (key == F.col("own._id")) & (F.xxhash64("rows.text") == F.col("own._h")), "left")
        key = F.coalesce(F.col("own._key"), key)
    rows = rows.join(found, key == F.col("found.id"), "left")
    spans, text = F.col("found.spans"), F.col("rows.text")
    n = F.size(spans)
    bounds = F.concat(F.array(F.lit(0)), F.flatten(F.transform(spans, lambda x: F.array(x["cs"], x["ce"]))))
    keep = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, F.get(bounds, 2 * i) + 1, F.coalesce(F.get(bounds, 2 * i + 1), F.length(text)) - F.get(bounds, 2 * i)))
    cut = F.when(spans.isNotNull(), F.array_join(keep, "")).otherwise(text)
    return rows.select(*[(cut if c == "text" else F.col(f"rows.`{c}`")).alias(c) for c in docs.columns])
