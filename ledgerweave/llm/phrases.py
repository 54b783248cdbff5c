"""Phrase collocation mining by contiguous pattern growth over projected occurrences.

1. Words are counted per language. 2. Neighbouring frequent words are counted as pairs, then frequent pairs with any frequent word
behind them as runs of three. A pair is told by its two words' keys, which no other word has, so its count is exact and its text comes from
the table of words; no task sends the texts of its pairs. Filters of a fixed number of bits keep the frequent runs.
3. Every place where such a run begins is an occurrence pointer; it is projected as the window of
the words that follow it, up to ``longest``, cut where a run of three isn't frequent. Equal windows of a task are summed. 4. The windows of
one first word are the projected occurrences of that prefix and go to one task. There they stream in sorted order, in which
all occurrences of a pattern are neighbours and which is the depth-first order of the tree of its extensions to the right, so the
task grows patterns with one open count per length, whatever the number of occurrences. 5. Counts of the parts give each
phrase its scores; phrases inside a longer one with the same share of occurrences leave.

The filters drop only words and runs below ``least``; what they let through by mistake is counted and found too rare later, so
the result is exact. Words are keyed anew while a frequent one shares its key. A prefix with over 1 / HOT of all words (HOT of them at most) is split by its windows into SALTS tasks whose
counts are summed afterwards. What goes to every task is three filters of ``filter_bits`` bits and at most HOT keys.

Cases: a null text is empty; a null language is ``und``; equal scores rank by count, then by the phrase's UTF-8 bytes; of cuts
with equal scores the first counts; an empty table gives an empty result; rows without an id or with the
same id count each; extra columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.token_arrays import in_pieces, mix
from ledgerweave.session import durable, temporary

LEAST, LONGEST, TOP, PERCENT = 100, 5, 2000, 100
FILTER_BITS = 1 << 27
HOT, SALTS = 1024, 64
FLUSH = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_BYTES = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


@dataclass
class PieceWords:
    """All words of a batch: number in ``dictionary``, row, and whether the word follows the one before in the same piece."""

    ids: np.ndarray
    dictionary: pa.Array
    row: np.ndarray
    follows: np.ndarray


def piece_words(texts: pa.Array) -> PieceWords:
    """Cut texts at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs into words; A-Z become a-z."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = memoryview(data)[int(at[0]) : int(at[-1])].tobytes() if data is not None else b""
    buf = np.frombuffer(raw.translate(_LOWER), dtype=np.uint8)
    rows = at - at[0]
    kind = _KIND[buf]
    word = kind == 0
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[rows] = True
    starts = np.flatnonzero(word & (np.append(True, ~word[:-1])[: len(buf)] | edge[:-1]))
    ends = np.flatnonzero(word & (np.append(~word[1:], True)[: len(buf)] | edge[1:])) + 1
    bounds = np.append(0, np.cumsum(ends - starts))
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(buf[word])])
    coded = flat.dictionary_encode()
    row = np.searchsorted(rows, starts, side="right") - 1
    breaks = np.flatnonzero(kind == 2)
    before = np.searchsorted(breaks, starts)
    follows = np.zeros(len(starts), dtype=bool)
    follows[1:] = (row[1:] == row[:-1]) & (before[1:] == before[:-1])
    return PieceWords(np.asarray(coded.indices).astype(np.int64), coded.dictionary.cast(pa.large_string()), row, follows)


def _hashes(values: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit number of every string, from its bytes and their places; another one for another seed."""
    values = values.cast(pa.large_binary())
    at = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    if not len(values) or at[0] == at[-1]:
        return np.zeros(len(values), dtype=np.uint64)
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
    place = np.arange(len(data)) - np.repeat(at[:-1] - at[0], np.diff(at))
    each = np.append(mix(_BYTES[data] + place.astype(np.uint64) * _A + np.uint64(seed)), np.uint64(0))
    return mix(np.where(np.diff(at) > 0, np.add.reduceat(each, at[:-1] - at[0]), np.uint64(0)) + np.diff(at).astype(np.uint64) * _C)


def _keyed(words: PieceWords, langs: pa.Array, seed: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The languages of a batch, the language number of every word, and a 64-bit key of its language and word."""
    coded = langs.cast(pa.string()).fill_null("und").dictionary_encode()
    lang = np.asarray(coded.indices).astype(np.int64)[words.row]
    return coded.dictionary, lang, mix(_hashes(words.dictionary, seed)[words.ids] * _A + _hashes(coded.dictionary, seed)[lang] * _B)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether both bits of a key are set."""
    mask, out = np.uint64(len(bits) * 64 - 1), np.ones(len(keys), dtype=bool)
    for place in (keys & mask, (keys >> np.uint64(32)) * _C >> np.uint64(20) & mask):
        out &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _A + b * _C)


def filter_of(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of ``bits`` bits (a power of two) over the column ``key``, or over pairs of keys a and b: two bits per key, summed on Spark.

    At most bits / 64 rows come to the driver, however many keys there are.
    """

    def run(batches):
        mask = np.uint64(bits - 1)
        for batch in batches:
            k = np.asarray(batch.column(0)).view(np.uint64)
            if batch.num_columns > 1:
                k = _joined(k, np.asarray(batch.column(1)).view(np.uint64))
            place = np.unique(np.concatenate([k & mask, (k >> np.uint64(32)) * _C >> np.uint64(20) & mask]))
            yield pa.RecordBatch.from_arrays(
                [pa.array((place >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], names=["w", "b"]
            )

    found = keys.mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[np.asarray(found["w"])] = np.asarray(found["b"]).view(np.uint64)
    return out


def word_counts(texts: DataFrame, seed: int = 0) -> DataFrame:
    """lang, word, key, n: occurrences of every word; ``texts``: text, lang."""

    def run(batches):
        for batch in in_pieces(batches, 0):
            words = piece_words(batch.column(0))
            langs, lang, keys = _keyed(words, batch.column(1), seed)
            both, first, n = np.unique(lang * max(len(words.dictionary), 1) + words.ids, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.take(lang[first]), words.dictionary.take(words.ids[first]).cast(pa.string()), pa.array(keys[first].view(np.int64)), pa.array(n)],
                names=["lang", "word", "key", "n"],
            )

    found = texts.mapInArrow(run, "lang string, word string, key long, n long")
    return found.groupBy("lang", "word").agg(F.max("key").alias("key"), F.sum("n").alias("n"))


def clash(counted: DataFrame, least: int) -> bool:
    """Whether a word of ``word_counts`` that occurs ``least`` times shares its key."""
    same = counted.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    return not same.where((F.col("c") > 1) & (F.col("n") >= least)).isEmpty()


def _runs(words: PieceWords, keys: np.ndarray, known: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where two and three neighbouring words begin that pass the filter ``known``, the three with a pair that passes ``pairs``, and the keys of the three."""
    ok = _passes(known, keys)
    two = np.zeros(len(keys), dtype=bool)
    two[:-1] = ok[:-1] & ok[1:] & words.follows[1:]
    at = np.flatnonzero(two)
    three = at[two[at + 1]]
    joined = _joined(keys[three], keys[three + 1])
    if pairs is not None:
        some = _passes(pairs, joined)
        three, joined = three[some], joined[some]
    return at, three, mix(joined * _B + keys[three + 2])


def pair_counts(texts: DataFrame, known, seed: int) -> DataFrame:
    """a, b, n: pairs of words that pass the filter ``known`` (a broadcast) by their keys."""

    def summed(parts):
        a, b, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        salt = (b[first] % np.uint64(SALTS // 4)).astype(np.int32)
        columns = [pa.array(a[first].view(np.int64)), pa.array(salt), pa.array(b[first].view(np.int64)), pa.array(np.add.reduceat(n[order], first))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "salt", "b", "n"])

    def run(batches):
        parts, size = [], 0
        for batch in in_pieces(batches, 0):
            words = piece_words(batch.column(0))
            _, lang, keys = _keyed(words, batch.column(1), seed)
            at = _runs(words, keys, known.value)[0]
            width = max(len(words.dictionary), 1)
            _, first, n = np.unique((lang[at] * width + words.ids[at]) * width + words.ids[at + 1], return_index=True, return_counts=True)
            at = at[first]
            if len(at):
                parts.append((keys[at], keys[at + 1], n))
                size += len(at)
            if size >= 2 * FLUSH:
                yield summed(parts)
                parts, size = [], 0
        if size:
            yield summed(parts)

    # Rows are summed in their task already; a sum before the shuffle would only spill. Neighbours with one first word stay so in a share of it and take less disk.
    found = texts.mapInArrow(run, "a long, salt int, b long, n long").repartition("a", "salt")
    return found.groupBy("a", "salt", "b").agg(F.sum("n").alias("n")).drop("salt")


def run_counts(texts: DataFrame, known, pairs, seed: int) -> DataFrame:
    """key, n: runs of three words that pass the filter ``known`` and begin with a pair that passes ``pairs`` (broadcasts)."""

    def summed(parts):
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    def run(batches):
        parts, size = [], 0
        for batch in in_pieces(batches, 0):
            words = piece_words(batch.column(0))
            parts.append(_runs(words, _keyed(words, batch.column(1), seed)[2], known.value, pairs.value)[2])
            size += len(parts[-1])
            if size >= 2 * FLUSH:
                yield summed(parts)
                parts, size = [], 0
        if size:
            yield summed(parts)

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def pair_phrases(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, k, a of ``pairs`` (a, b, n); ``words``: lang, phrase, key."""
    left = words.select("lang", F.col("phrase").alias("_left"), F.col("key").alias("a"))
    right = words.select(F.col("phrase").alias("_right"), F.col("key").alias("b"))
    return pairs.join(left, "a").join(right, "b").select("lang", F.concat_ws(" ", "_left", "_right").alias("phrase"), F.lit(2).alias("k"), F.col("n").alias("a"))


def windows(texts: DataFrame, known, threes, hot, seed: int, longest: int) -> DataFrame:
    """lang, first, salt, window, n: the projected occurrences, equal ones of a task summed; every word of a window ends with a space."""

    def batch_windows(batch) -> pa.Table:
        words = piece_words(batch.column(0))
        langs, lang, keys = _keyed(words, batch.column(1), seed)
        _, at, made = _runs(words, keys, known.value)
        at = at[_passes(threes.value, made)]
        passed = np.zeros(len(keys) + longest, dtype=bool)
        passed[at] = True
        size = max(len(words.dictionary), 1) + 1
        grid = np.full((longest, len(at)), -1, dtype=np.int64)
        grid[0] = words.ids[at]
        goes = np.ones(len(at), dtype=bool)
        # A window's number: its language and words, one word a step.
        number = lang[at] * size + grid[0]
        for k in range(1, longest):
            # A window goes on to a word while the run of three that ends there passes.
            goes = goes & passed[at + max(k - 2, 0)]
            grid[k][goes] = words.ids[at[goes] + k]
            number = np.unique(number, return_inverse=True)[1] * size + grid[k] + 1
        _, first, n = np.unique(number, return_index=True, return_counts=True)
        grid = grid[:, first]
        text = [words.dictionary.take(pa.array(g, mask=g < 0)) for g in grid]
        empty, blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        window = pc.binary_join_element_wise(*text, empty, blank, null_handling="skip")
        salt = np.where(np.isin(keys[at[first]], hot.value), _mixed(grid, np.append(_hashes(words.dictionary, seed), np.uint64(0))) % np.uint64(SALTS) + np.uint64(1), np.uint64(0))
        return pa.table({
            "lang": langs.take(lang[at[first]]), "first": text[0].cast(pa.string()), "salt": pa.array(salt.astype(np.int32)),
            "window": window.cast(pa.string()), "n": pa.array(n.astype(np.int64)),
        })

    def _mixed(grid: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """A number of the words of each window that is the same in every task; hashes end with that of no word."""
        out = np.zeros(grid.shape[1], dtype=np.uint64)
        for row in grid:
            out = mix(out * _A + hashes[row])
        return out

    def summed(parts):
        table = pa.concat_tables(parts).group_by(["lang", "first", "salt", "window"]).aggregate([("n", "sum")])
        return table.rename_columns(["lang", "first", "salt", "window", "n"]).to_batches(max_chunksize=50_000)

    def run(batches):
        parts, size = [], 0
        for batch in in_pieces(batches, 0):
            parts.append(batch_windows(batch))
            size += parts[-1].num_rows
            if size >= FLUSH:
                yield from summed(parts)
                parts, size = [], 0
        if size:
            yield from summed(parts)

    return texts.mapInArrow(run, "lang string, first string, salt int, window string, n long")


class Growth:
    """Patterns of three words and more of one stream of sorted windows: an open count per length, closed when the pattern changes."""

    def __init__(self, least: int, longest: int):
        self.least, self.longest = least, longest
        self.now: tuple = ()  # language, first word and salt of the open prefix
        self.words: list[str] = []  # words of the last window
        self.counts = [0] * (longest + 1)
        self.out: list[tuple[str, str, int]] = []

    def _emit(self, now: tuple, words: list[str], n: int) -> None:
        # The tasks of a split prefix have parts of its counts.
        if n >= (1 if now[2] else self.least):
            self.out.append((now[0], " ".join(words), n))

    def close(self) -> None:
        for k in range(3, len(self.words) + 1):
            self._emit(self.now, self.words[:k], self.counts[k])
        self.words = []

    def feed(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        now = list(zip(*[batch.column(c).to_pylist() for c in ("lang", "first", "salt")]))
        split = pc.split_pattern(pc.utf8_slice_codeunits(batch.column("window"), 0, -1), " ")
        lists = split.to_pylist()
        flat = split.flatten().dictionary_encode()
        sizes = np.asarray(pc.list_value_length(split)).astype(np.int64)
        begin = np.append(0, np.cumsum(sizes))[:-1]
        codes = np.append(np.asarray(flat.indices).astype(np.int64), -1)
        n = np.asarray(batch.column("n"))
        new = np.fromiter((a != b for a, b in zip(now, [self.now, *now])), dtype=bool, count=len(now))
        if new[0]:
            self.close()
        for k in range(1, self.longest + 1):
            at = np.where(sizes >= k, begin + k - 1, len(codes) - 1)
            word = codes[at]
            before = bool(len(self.words) >= k and sizes[0] >= k and self.words[k - 1] == lists[0][k - 1])
            new |= np.append(not before, word[1:] != word[:-1])
            if k < 3:
                continue
            # Sums of runs of one pattern; the first run may go on from the batch before, the last one stays open.
            heads = np.flatnonzero(new)
            has = np.where(sizes >= k, n, 0)
            if not len(heads):
                self.counts[k] += int(has.sum())
                continue
            if heads[0] > 0:
                self.counts[k] += int(has[: heads[0]].sum())
            if len(self.words) >= k:
                self._emit(self.now, self.words[:k], self.counts[k])
            sums = np.add.reduceat(has, heads)
            for i in np.flatnonzero(sums[:-1] > 0):
                h = heads[i]
                if sums[i] >= self.least or now[h][2]:
                    self._emit(now[h], lists[h][:k], int(sums[i]))
            self.counts[k] = int(sums[-1])
        self.now, self.words = now[-1], lists[-1]

    def take(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        lang, phrase, a = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(a, pa.int64())], names=["lang", "phrase", "a"])


def phrase_counts(projected: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, phrase, k (its words), a (its occurrences): all phrases of 3 to ``longest`` words that occur ``least`` times."""

    def run(batches):
        growth = Growth(least, longest)
        for batch in batches:
            growth.feed(batch)
            yield growth.take()
        growth.close()
        yield growth.take()

    keys = ("lang", "first", "salt")
    grown = projected.repartition(*keys).sortWithinPartitions(*keys, "window").mapInArrow(run, "lang string, phrase string, a long")
    total = grown.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return total.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), "a")


def _part(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(phrases: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """phrases with l, r, n and score of their lowest-scoring cut; ``parts``: lang, phrase, a of all words and phrases; ``totals``: lang, n."""
    side = lambda name, count: parts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = phrases.withColumn("_w", F.split("phrase", " ")).select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"_left": _part(F.col("_w"), F.lit(1), F.col("cut")), "_right": _part(F.col("_w"), F.col("cut") + 1, F.col("k") - F.col("cut"))}).drop("_w")
    both = cuts.join(side("_left", "l"), ["lang", "_left"]).join(side("_right", "r"), ["lang", "_right"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    over = (exact("a") * F.lit(1000)).cast("decimal(19,0)") * exact("n")
    both = both.withColumn("_over", over).withColumn("_under", exact("l") * exact("r")).withColumn("_score", F.expr("_over div _under"))
    lowest = F.min(F.struct(F.col("_score").alias("score"), "cut", "l", "r")).alias("low")
    found = both.groupBy("lang", "phrase", "k", "a", "n").agg(lowest)
    return found.select("lang", "phrase", "k", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))


def closed(phrases: DataFrame, percent: int) -> DataFrame:
    """Phrases that lie in no longer phrase with ``percent`` of their occurrences.

    A phrase between the two has at least as many as the longer one and is in the table, so one word more is enough to look at.
    """
    w = F.split("phrase", " ")
    inner = F.array(_part(w, F.lit(1), F.col("k") - 1), _part(w, F.lit(2), F.col("k") - 1))
    longer = phrases.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("_longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    kept = phrases.join(most, ["lang", "phrase"], "left")
    return kept.where(F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a"))).drop("_longer")


def ranked(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language; first those of SALTS shares of it, so that no task gets all phrases of one."""
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    shares = phrases.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("rank") <= top)
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.drop("_share")


def mine_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, filter_bits: int = FILTER_BITS,
    text: str = "text", lang: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of every language."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    texts = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    with temporary():
        seed, counted = 0, durable(word_counts(texts))
        while clash(counted, least):
            seed += 1
            counted = durable(word_counts(texts, seed))
        totals = durable(counted.groupBy("lang").agg(F.sum("n").alias("n")), outer=True)
        words = durable(counted.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("a"), "key"), outer=True)
        total = totals.agg(F.sum("n")).first()[0] or 0
        hot = words.where(F.col("a") * HOT > total).select("key").toArrow()["key"]
        hot = share(np.asarray(hot).view(np.uint64))
        known = share(filter_of(words.select("key"), filter_bits))
        pairs = durable(pair_counts(texts, known, seed).where(F.col("n") >= least))
        phrases = pair_phrases(pairs, words)
        if longest > 2:
            often = share(filter_of(pairs.select("a", "b"), filter_bits))
            runs = durable(run_counts(texts, known, often, seed).where(F.col("n") >= least).select("key"))
            threes = share(filter_of(runs, filter_bits))
            phrases = phrases.unionByName(phrase_counts(windows(texts, known, threes, hot, seed, longest), least, longest))
        phrases = durable(phrases, outer=True)
    parts = words.select("lang", "phrase", "a").unionByName(phrases.select("lang", "phrase", "a"))
    best = ranked(scored(closed(phrases, percent), parts, totals), top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {k} AS k, unnest([array_to_string(w[i:i + {k - 1}], ' ') for i in range(1, len(w) - {k - 2})]) AS phrase FROM pieces WHERE len(w) >= {k}" for k in range(1, LONGEST + 1)
)
ORACLE_SQL = f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
cut AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM texts),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut),
grams AS ({_GRAMS}),
counts AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND a >= {LEAST}),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS c FROM candidates),
scored AS (
  SELECT x.lang, x.phrase, x.k, x.a, x.c, l.a AS l, r.a AS r, n, (1000::HUGEINT * x.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM cuts x JOIN counts l ON l.lang = x.lang AND l.k = c AND l.phrase = array_to_string(w[1:c], ' ')
  JOIN counts r ON r.lang = x.lang AND r.k = x.k - c AND r.phrase = array_to_string(w[c + 1:], ' ')
  JOIN totals ON totals.lang = x.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, a
  FROM (SELECT lang, k, a, w, unnest(range(1, k + 1)) AS i FROM candidates), (SELECT unnest(range(1, {LONGEST + 1})) AS j)
  WHERE j > i AND j <= k AND j - i + 1 < k),
kept AS (
  SELECT * FROM lowest
  WHERE NOT EXISTS (SELECT 1 FROM inner_phrases y WHERE y.lang = lowest.lang AND y.phrase = lowest.phrase AND 100 * y.a >= {PERCENT} * lowest.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= {TOP}
"""
