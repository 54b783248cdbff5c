"""Cross-tokenizer alignment by an event sweep.

1. Every text is encoded by a byte-level tokenizer (A, a space before the text) and a piece tokenizer (B, which adds that space itself).
A token's end is an event; its byte offset follows from the tokens before it. The events of both sides form one table, packed in blocks of
at most BLOCK events of one side and document, which is dealt out by document and sorted by offset. 2. A task streams through it:
offsets where tokens of both sides end close a group, and all pairs of A and B tokens of a group are links. Its state is the
tokens after the last common end, and the open document's sums. 3. Documents that hold a pair are counted: each task sums its pairs, packed by A id, before
one shuffle. 4. Counts of at least a threshold, HEAD pairs at most, go to every task as a broadcast and meet the documents' pairs
there; the rarer pairs are joined by a shuffle, in which none of them is hot.

Texts are encoded word by word where that is sure to be equal: a cut lies before a space with no blank on both sides, where neither
tokenizer has a token. Any other text is encoded whole. Words seen before come from a bounded cache.

Cases: a null or empty text, and one whose joined tokens are not space+text in either tokenizer (such as one with U+2581), has no tokens: zeros and
an empty digest; control strings in texts are plain text; rows that repeat an id or have none are documents of their own; an empty
table gives an empty result; extra columns are not carried. A group of m and n tokens has m * n links; they are formed in slices.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.token_arrays import in_pieces
from ledgerweave.session import durable, temporary

BLOCK = 1 << 16
CACHE_WORDS = 300_000
SLICE = 1 << 21
BUCKETS = 256
HEAD = 1 << 22
#: Fixed value: how a byte-level tokenizer cuts a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text with one of these is encoded whole.
_WHOLE = re.compile(r"\s \s|  | $|^ |▁")
EVENTS = "row long, doc_id long, start long, side int, ids binary"
SWEPT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, packed binary"


def byte_level(path: str) -> dict:
    """A byte-level BPE vocabulary (tokenizers JSON): the bytes of every id and the ids that are control strings.

    Its merges are checked to be ordered by id, and each to be what the merges before it leave of its token. Then merging the neighbours whose joined bytes
    have the lowest id, as the fast encoder does, gives what the merge list gives.
    """
    found = json.loads(open(path, encoding="utf-8").read())
    if found["model"]["type"] != "BPE" or found["pre_tokenizer"]["type"] != "ByteLevel" or found["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("not a byte-level BPE without a prefix space")
    # Printable bytes stand for themselves, the others for the characters from 256 on.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    as_bytes = lambda token: bytes(byte_of[c] for c in token)
    vocab, control = found["model"]["vocab"], {t["id"]: t["content"] for t in found["added_tokens"]}
    raw = [b""] * (max(*vocab.values(), *control) + 1)
    for token, i in vocab.items():
        if i not in control:
            raw[i] = as_bytes(token)
    ranks, last = {r: i for i, r in enumerate(raw) if r}, -1
    for merge in found["model"]["merges"]:
        x, y = map(as_bytes, merge.split(" ") if isinstance(merge, str) else merge)
        rank = ranks.get(x + y, -1)
        if rank <= last or _merged_below(x + y, ranks, rank) != [x, y]:
            raise ValueError("the merges are not ordered by id")
        last = rank
    for i, text in control.items():
        raw[i] = text.encode()
    return {"raw": raw, "control": sorted(control)}


def _merged_below(token: bytes, ranks: dict[bytes, int], limit: int) -> list[bytes]:
    """The parts of a token after all merges of a lower rank than ``limit``."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def piece_level(path: str) -> dict:
    """A SentencePiece model: its bytes and the bytes of every id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_control(i) or sp.is_unknown(i):
            raw.append(b"")
        elif sp.is_byte(i):
            raw.append(bytes([int(piece[3:5], 16)]))
        elif re.search("[^▁]▁", piece):
            raise ValueError("a piece reaches over a word's end")
        else:
            raw.append(piece.replace("▁", " ").encode())
    return {"model": open(path, "rb").read(), "raw": raw}


class _Numbers(dict):
    """Word numbers; a word not seen before gets the next one and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Ids of both tokenizers (16 bits each), word by word through a cache."""

    def __init__(self, a: dict, b: dict):
        import sentencepiece
        import tiktoken

        ranks = {r: i for i, r in enumerate(a["raw"]) if r and i not in a["control"]}
        self.a = tiktoken.Encoding("a", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b["model"])
        self.raw = a["raw"], b["raw"]
        self._clear()

    def _clear(self) -> None:
        # Per side the ids of all words one after the other, and their number of each; no ids at all where a word's tokens differ from it.
        self.numbers, self.ids, self.sizes = _Numbers(), (array("H"), array("H")), (array("i"), array("i"))

    def _encoded(self, texts: list[str]):
        """Ids of both sides of every text, or None where they don't join to it."""
        encode, raw_a, raw_b = self.a.encode_ordinary, self.raw[0].__getitem__, self.raw[1].__getitem__
        for at in range(0, len(texts), 512):
            some = texts[at : at + 512]
            for text, b in zip(some, self.b.encode(some, num_threads=1)):
                text = " " + text
                a, data = encode(text), text.encode()
                yield (a, b) if b"".join(map(raw_a, a)) == data == b"".join(map(raw_b, b)) else None

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        for found in self._encoded(new):
            for side in (0, 1):
                self.ids[side].extend(found[side] if found else ())
                self.sizes[side].append(len(found[side]) if found else 0)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of every text; none where a text has no tokens."""
        if len(self.numbers) > CACHE_WORDS:
            self._clear()
        none = np.empty(0, np.uint16)
        words = [[] if not t or _WHOLE.search(t) else t.split(" ") for t in texts]
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), dtype=np.int64)
        self._learn()
        ends = np.cumsum([len(w) for w in words])
        flat, bounds = [], []
        for ids, sizes in zip(self.ids, self.sizes):
            ids, sizes = np.array(ids, dtype=np.uint16), np.array(sizes, dtype=np.int64)
            size = sizes[numbers]
            upto = np.append(0, np.cumsum(size))
            flat.append(ids[np.arange(upto[-1]) + np.repeat((np.cumsum(sizes) - sizes)[numbers] - upto[:-1], size)])
            bounds.append(np.append(0, upto[ends]))
        bad = np.append(0, np.cumsum(size == 0))[np.append(0, ends)]
        whole = iter(self._encoded([t for t, w in zip(texts, words) if t and not w]))
        out = []
        for i, (text, w) in enumerate(zip(texts, words)):
            if text and not w:
                out.append(tuple(np.array(x, dtype=np.uint16) for x in next(whole) or ((), ())))
            elif bad[i + 1] > bad[i] or not w:
                out.append((none, none))
            else:
                out.append(tuple(x[b[i] : b[i + 1]] for x, b in zip(flat, bounds)))
        return out


def events(docs: DataFrame, a: dict, b: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The events (EVENTS) of both sides; a document without tokens has one empty block."""
    shared = docs.sparkSession.sparkContext.broadcast((a, b))

    def run(batches):
        import zstandard

        encoder, pack = Encoder(*shared.value), zstandard.ZstdCompressor(level=1)
        sizes = [np.array([len(x) for x in side["raw"]], dtype=np.int64) for side in shared.value]
        for batch in in_pieces(batches, 2):
            out = []
            ids = encoder.encode(batch.column(2).to_pylist())
            for row, doc, sides in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids):
                for side, data in enumerate(sides):
                    start = 0
                    for at in range(0, max(len(data), 1 - side), BLOCK):
                        block = data[at : at + BLOCK]
                        out.append((row, doc, start, side, pack.compress(block.astype("<u2").tobytes())))
                        if len(data) > BLOCK:
                            start += int(sizes[side][block].sum())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), _kinds(EVENTS))] if out else [pa.array([], k) for k in _kinds(EVENTS)], names=_names(EVENTS))

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, EVENTS)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _kinds(schema: str) -> list[pa.DataType]:
    of = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return [of[x.split()[1]] for x in schema.split(", ")]


class Sweep:
    """Groups and links of one stream of blocks, sorted by document and offset."""

    def __init__(self, raw_a: list[bytes], raw_b: list[bytes]):
        import zstandard

        self.zstd = zstandard
        self.n_a, self.n_b = len(raw_a), len(raw_b)
        if self.n_a > 1 << 16 or self.n_b > 1 << 16 or self.n_a * self.n_b >= 1 << 32:
            raise ValueError("a vocabulary is too large for 16-bit ids")
        self.size_a, self.size_b = (np.array([len(x) for x in raw], dtype=np.int64) for raw in (raw_a, raw_b))
        self.digits = np.zeros((max(self.n_a, self.n_b), 6), dtype=np.uint8)
        for i in range(len(self.digits)):
            self.digits[i, : len(str(i))] = list(str(i).encode())
        self.digit_count = np.array([len(str(i)) for i in range(len(self.digits))], dtype=np.int64)
        self.pack = zstandard.ZstdCompressor(level=1)
        self.row = None
        self.out: list[tuple] = []

    def _open(self, row: int, doc) -> None:
        self.row, self.doc = row, doc
        self.rest = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.sums = np.zeros(4, dtype=np.int64)
        self.digest, self.pairs = None, []

    def close(self) -> None:
        """End the open document."""
        if self.row is None:
            return
        if len(self.rest[0]) or len(self.rest[1]):
            raise ValueError("the tokens of a text do not end together")
        keys, counts = _merged(self.pairs)
        packed = self.pack.compress(_planes(np.diff(keys, prepend=0)) + _planes(counts))
        digest = self.digest.hexdigest() if self.digest else ""
        self.out.append((self.row, self.doc, *self.sums.tolist(), digest, len(keys), packed))
        self.row = None

    def feed(self, batch: pa.RecordBatch) -> None:
        unpack = self.zstd.ZstdDecompressor()
        a, b = ([], []), ([], [])  # ids and number of their document, side by side
        docs: list[tuple] = []
        rows = batch.column(0).to_pylist()
        names, sides, blocks = batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        first = self.row is not None and bool(rows) and rows[0] == self.row
        if self.row is not None and rows and not first:
            self.close()
        if first:
            docs.append((self.row, self.doc))
            for side, rest in zip((a, b), self.rest):
                side[0].append(rest)
                side[1].append(len(rest))
        for row, doc, side, block in zip(rows, names, sides, blocks):
            if not docs or docs[-1][0] != row:
                docs.append((row, doc))
                for x in (a, b):
                    x[1].append(0)
            ids = np.frombuffer(unpack.decompress(block), dtype="<u2").astype(np.int64)
            into = a if side == 0 else b
            into[0].append(ids)
            into[1][-1] += len(ids)
        if docs:
            self._sweep(docs, first, *[np.concatenate(x[0]) if x[0] else np.empty(0, np.int64) for x in (a, b)], np.array(a[1]), np.array(b[1]))

    def _sweep(self, docs, goes_on: bool, a, b, per_a, per_b) -> None:
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.searchsorted(ends_b, ends_a)
        close_a = np.flatnonzero(np.append(ends_b, -1)[at] == ends_a)
        close_b = at[close_a]
        begin_a, begin_b = np.append(0, close_a + 1)[:-1], np.append(0, close_b + 1)[:-1]
        m, n = close_a + 1 - begin_a, close_b + 1 - begin_b
        doc_end_a, doc_end_b = np.cumsum(per_a), np.cumsum(per_b)
        doc_of = np.searchsorted(doc_end_a, close_a, side="right")
        used_a, used_b = (int(close_a[-1]) + 1, int(close_b[-1]) + 1) if len(close_a) else (0, 0)
        rest = a[used_a:], b[used_b:]
        last = len(docs) - 1
        if len(docs) > 1 and (used_a < doc_end_a[-2] or used_b < doc_end_b[-2]):
            raise ValueError("the tokens of a text do not end together")
        a, b = a[:used_a], b[:used_b]
        groups = np.bincount(doc_of, minlength=len(docs))
        links = np.zeros(len(docs), dtype=np.int64)
        np.add.at(links, doc_of, m * n)
        count = lambda ends, used: np.diff(np.minimum(ends, used), prepend=0)
        sums = np.column_stack([count(doc_end_a, used_a), count(doc_end_b, used_b), groups, links])

        text, text_end = self._text(a, b, m, n)
        bounds = np.append(0, text_end)[np.append(0, np.cumsum(groups))] if len(m) else np.zeros(len(docs) + 1, np.int64)
        keys, counts = self._pairs(a, b, m, n, begin_b, doc_of)
        cut = np.searchsorted(keys, np.arange(len(docs) + 1, dtype=np.uint64) << np.uint64(32))
        for i, (row, doc) in enumerate(docs):
            if i or not goes_on:
                self._open(row, doc)
            self.sums += sums[i]
            if groups[i]:
                piece = text[bounds[i] : bounds[i + 1] - 1]
                if self.digest is None:
                    self.digest = hashlib.sha256(piece)
                else:
                    self.digest.update(b";" + piece)
                self.pairs.append((keys[cut[i] : cut[i + 1]] & np.uint64(0xFFFFFFFF), counts[cut[i] : cut[i + 1]]))
                if len(self.pairs) > 8:
                    self.pairs = [_merged(self.pairs)]
            if i == last:
                self.rest = list(rest)
            else:
                self.rest = [rest[0][:0], rest[1][:0]]
                self.close()

    def _text(self, a, b, m, n) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;`` of every group, and where each group's text ends."""
        group = np.arange(len(m))
        end_a, end_b = np.cumsum(m), np.cumsum(n)
        of_a, of_b = np.repeat(group, m), np.repeat(group, n)
        place_a = np.arange(len(a)) + (end_b - n)[of_a] if len(m) else np.empty(0, np.int64)
        place_b = np.arange(len(b)) + end_a[of_b] if len(m) else np.empty(0, np.int64)
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[place_a], codes[place_b] = a, b
        mark = np.full(len(codes), ord(","), dtype=np.uint8)
        mark[place_a[end_a - 1]], mark[place_b[end_b - 1]] = ord("|"), ord(";")
        grid = self.digits[codes]
        grid[:, 5] = mark
        upto = np.cumsum(self.digit_count[codes] + 1)
        return grid[grid != 0].tobytes(), upto[end_a + end_b - 1] if len(m) else np.empty(0, np.int64)

    def _pairs(self, a, b, m, n, begin_b, doc_of) -> tuple[np.ndarray, np.ndarray]:
        """Distinct document and pair numbers and their links, sorted; formed in slices of about SLICE links."""
        group = np.repeat(np.arange(len(m)), m)
        times = n[group]
        upto = np.cumsum(times)
        parts, at = [], 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, side="right")))
            t, g = times[at:to], group[at:to]
            within = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
            right = b[np.repeat(begin_b[g], t) + within]
            key = np.repeat((doc_of[g].astype(np.uint64) << np.uint64(32)) + (a[at:to] * self.n_b).astype(np.uint64), t) + right.astype(np.uint64)
            parts.append(np.unique(key, return_counts=True))
            if len(parts) > 8:
                parts = [_merged(parts)]
            at = to
        return _merged(parts)

    def take(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 9, _kinds(SWEPT))], names=_names(SWEPT))


def _merged(parts) -> tuple[np.ndarray, np.ndarray]:
    """Keys sorted, each once, with the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers, all first bytes first."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, count=4 * n).reshape(4, n).T).view("<u4").ravel()


def _unpacked(batch: pa.RecordBatch, n_pairs: int, packed: int):
    """Pairs, links and number of the row, of all rows of a batch."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    size = np.asarray(batch.column(n_pairs))
    pairs, links = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
    for n, data in zip(size.tolist(), batch.column(packed).to_pylist()):
        data = unpack.decompress(data)
        pairs.append(np.cumsum(_unplaned(data, n), dtype=np.uint32))
        links.append(_unplaned(data[4 * n :], n))
    return np.concatenate(pairs), np.concatenate(links), np.repeat(np.arange(len(size)), size)


def swept(found: DataFrame, raw_a: list[bytes], raw_b: list[bytes]) -> DataFrame:
    """Per document (SWEPT): its counts, the digest of its groups, its distinct linked pairs with their number of links."""
    shared = found.sparkSession.sparkContext.broadcast((raw_a, raw_b))

    def run(batches):
        sweep = Sweep(*shared.value)
        for batch in in_pieces(batches, 4, most=256 << 10):
            sweep.feed(batch)
            yield sweep.take()
        sweep.close()
        yield sweep.take()

    return found.repartition("row").sortWithinPartitions("row", "start", "side").mapInArrow(run, SWEPT)


def pair_counts(documents: DataFrame, n_b: int) -> DataFrame:
    """pair (A id * n_b + B id), n (documents that hold it), best (no other pair of its A id has more)."""

    def partial(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)

        def summed(parts):
            pairs, n = np.unique(np.concatenate(parts), return_counts=True)
            bucket = pairs // n_b % BUCKETS
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(BUCKETS + 1))
            rows = [(i, t - s, pack.compress(pairs[by[s:t]].tobytes() + n[by[s:t]].astype(np.int64).tobytes())) for i, (s, t) in enumerate(zip(cut[:-1], cut[1:])) if t > s]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "size", "data"])

        parts, size = [], 0
        for batch in in_pieces(batches, 1, most=512 << 10):
            parts.append(_unpacked(batch, 0, 1)[0])
            size += len(parts[-1])
            if size >= 2 * SLICE:
                yield summed(parts)
                parts, size = [], 0
        if size:
            yield summed(parts)

    def total(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        bucket, parts, pending = None, [], 0

        def done():
            pairs, n = _merged(parts)
            a = pairs // n_b
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(a))))
            for at in range(0, len(pairs), 100_000):
                cut = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[cut].astype(np.int64)), pa.array(n[cut]), pa.array(n[cut] == most[cut])], names=["pair", "n", "best"])

        for batch in batches:
            for now, size, data in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if bucket is not None and now != bucket:
                    yield from done()
                    parts, pending = [], 0
                bucket = now
                data = unpack.decompress(data)
                parts.append((np.frombuffer(data, np.uint32, size), np.frombuffer(data, np.int64, size, 4 * size)))
                pending += size
                # The sum of a bucket has at most as many rows as pairs of its A ids; it is merged when as much has come again.
                if len(parts) > 1 and pending > max(SLICE, 2 * len(parts[0][0])):
                    parts = [_merged(parts)]
                    pending = len(parts[0][0])
        if bucket is not None:
            yield from done()

    packed = documents.where("n_pairs > 0").select("n_pairs", "packed").mapInArrow(partial, "bucket int, size long, data binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(total, "pair long, n long, best boolean")


def head_threshold(counts: DataFrame, most: int = HEAD) -> int:
    """The least power of two such that at most ``most`` pairs have that count or more."""
    power = F.floor(F.log2(F.col("n") + F.lit(0.5))).cast("int")
    found = {r.p: r.c for r in counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    p = max(found, default=0)
    total = 0
    while p >= 0 and total + found.get(p, 0) <= most:
        total += found.get(p, 0)
        p -= 1
    return 2 ** (p + 1)


def align(docs: DataFrame, a: dict, b: dict, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row per input row."""
    spark, n_b = docs.sparkSession, len(b["raw"])
    with temporary():
        # One key of a row for its blocks; written before use, so that it stays.
        documents = durable(swept(events(docs, a, b), a["raw"], b["raw"]), outer=True)
        counts = durable(pair_counts(documents, n_b), outer=True)
    least = head_threshold(counts, head)
    top = counts.where(F.col("n") >= least).toArrow()
    pair = np.asarray(top["pair"]).astype(np.uint32)
    by = np.argsort(pair)
    shared = spark.sparkContext.broadcast((pair[by], np.asarray(top["n"])[by], np.asarray(top["best"].combine_chunks().cast(pa.int8()))[by].astype(np.int64)))

    def run(batches):
        pair, n, best = shared.value
        pair, n, best = np.append(pair, np.uint32(0)), np.append(n, 0), np.append(best, 0)
        for batch in in_pieces(batches, 8, most=512 << 10):
            keys, links, row = _unpacked(batch, 7, 8)
            links = links.astype(np.int64)
            at = np.searchsorted(pair[:-1], keys)
            hit = (pair[at] == keys) & (at < len(pair) - 1)
            sums = []
            for of in (best, n):
                upto = np.append(0, np.cumsum(np.where(hit, links * of[at], 0)))
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                sums.append(np.diff(upto[ends]))
            left = np.flatnonzero(~hit)
            bounds = np.searchsorted(row[left], np.arange(batch.num_rows + 1)).astype(np.int32)
            rare = [pa.ListArray.from_arrays(bounds, pa.array(x[left].astype(np.int64))) for x in (keys, links)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(sums[0]), pa.array(sums[1]), *rare], names=names)

    names = [*_names(SWEPT)[:7], "n_best", "count_sum", "rare", "rare_links"]
    schema = SWEPT.split(", n_pairs")[0] + ", n_best long, count_sum long, rare array<long>, rare_links array<long>"
    found = documents.mapInArrow(run, schema)
    if least > 1:
        # Pairs below the threshold: few, and none in more documents than that.
        rows = found.select("row", F.explode(F.arrays_zip("rare", "rare_links")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_links").alias("links"))
        tail = counts.where(F.col("n") < least)
        sums = rows.join(tail, "pair").groupBy("row").agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("links") * F.col("n")).alias("_sum"))
        found = found.join(sums, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
