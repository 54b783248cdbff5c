"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of a batch become one flat array of symbols. In each round every word finds
its smallest pair rank by a segmented minimum and merges the leftmost such pair; where no pair
with the new symbol can rank before it, all non-overlapping occurrences of the rank merge
at once, which gives the same result. The arrays are compacted until no pair remains. Words
seen before come from a bounded cache. Spark deals out the texts; nothing is shuffled.

Rounds grow with a word's length, so a word of over LONG characters (a text without blanks, such as Chinese or base64) is first cut wherever two neighbouring
characters are neighbours in no piece, as no merge reaches over such a place. A stretch that is still longer merges its pairs one by one from a heap, in
the same order (rank, then place), in time that is linear but for a logarithm.

The vocabulary is read on the driver from the model file and sent as a broadcast of its own fixed
size (checked against MAX_PIECES). Words may be cut before a space run because no piece has
one after another character, and at line feeds because no piece has one; both are checked.

Cases: null counts as empty text; an empty text has the end id only and decodes to an empty
text; runs of blanks, U+2581 (decodes to a space), unknown characters (byte pieces) and very long words are
encoded exactly; repeated rows give repeated results; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.token_arrays import in_pieces

SPACE = "▁"
MAX_PIECES = 2_000_000
CACHE_WORDS = 200_000
LONG = 400
_NONE = np.int64(2**62)


def read_vocabulary(path: str) -> dict:
    """Pieces, scores and roles of a SentencePiece BPE model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    if n > MAX_PIECES:
        raise ValueError(f"{n} pieces are too many to broadcast")
    roles = ["b" if sp.is_byte(i) else "x" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "n" for i in range(n)]
    if roles.count("b") != 256:
        raise ValueError("the model has no byte pieces")
    pieces = [sp.id_to_piece(i) for i in range(n)]
    if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p, r in zip(pieces, roles) if r == "n"):
        raise ValueError("a piece reaches over a word's end")
    return {"pieces": pieces, "scores": [sp.get_score(i) for i in range(n)], "roles": roles, "end": sp.eos_id()}


class Merger:
    """Pair table of one vocabulary, and the rounds."""

    def __init__(self, vocabulary: dict):
        pieces, scores, roles = vocabulary["pieces"], vocabulary["scores"], vocabulary["roles"]
        self.n = len(pieces)
        self.end = vocabulary["end"]
        ids = {p: i for i, p in enumerate(pieces) if roles[i] == "n"}
        self.byte = [pieces.index(f"<0x{b:02X}>") for b in range(256)]
        order = sorted({scores[i] for i in ids.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        self.char = np.arange(0x110000, dtype=np.int64) + self.n
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i

        def symbol(s: str) -> int | None:
            return ids.get(s, self.n + ord(s) if len(s) == 1 else None)

        keys, made, ranks = [], [], []
        risky = np.zeros(self.n, dtype=bool)
        for p, i in ids.items():
            rank = rank_of[scores[i]]
            for cut in range(1, len(p)):
                left, right = symbol(p[:cut]), symbol(p[cut:])
                if left is None or right is None:
                    continue
                keys.append(left << 32 | right)
                made.append(i)
                ranks.append(rank)
                for part in (left, right):
                    if part < self.n and rank <= rank_of[scores[part]]:
                        risky[part] = True
        by = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[by], _NONE)
        self.made = np.append(np.array(made, dtype=np.int64)[by], 0)
        self.ranks = np.append(np.array(ranks, dtype=np.int64)[by], _NONE)
        self.risky = risky
        self.merges = dict(zip(keys, zip(ranks, made)))
        inner = {ord(a) << 21 | ord(b) for p in ids for a, b in zip(p, p[1:])}
        self.inner = np.append(np.array(sorted(inner), dtype=np.int64), _NONE)
        self.text = [str(i) for i in range(self.n)]
        self.raw = [
            bytes([int(p[3:5], 16)]) if r == "b" else b"" if r == "x" else p.replace(SPACE, " ").encode() for p, r in zip(pieces, roles)
        ]
        self.cache: dict[str, tuple[str, str]] = {}

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in order, and the number of symbols of each; long words are cut where no merge can reach over."""
        if max(map(len, words), default=0) <= LONG:
            return self.rounds(words)
        parts, owner = [], []
        for i, word in enumerate(words):
            cut = [word]
            if len(word) > LONG:
                at = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
                pair = at[:-1] << 21 | at[1:]
                ends = [*(np.flatnonzero(self.inner[np.searchsorted(self.inner, pair)] != pair) + 1).tolist(), len(word)]
                cut = [word[a:b] for a, b in zip([0, *ends], ends)]
            parts += cut
            owner += [i] * len(cut)
        short = [p for p in parts if len(p) <= LONG]
        found, sizes = self.rounds(short)
        pieces = iter(np.split(found, np.cumsum(sizes)[:-1]) if short else [])
        out = [next(pieces) if len(p) <= LONG else self.heaped(p) for p in parts]
        return np.concatenate(out), np.bincount(owner, weights=[len(x) for x in out], minlength=len(words)).astype(np.int64)

    def heaped(self, word: str) -> np.ndarray:
        """Symbols of one long word: the leftmost pair of the least rank merges, again and again."""
        sym = self.char[np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)].tolist()
        n, merges = len(sym), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # One number per waiting pair: its rank, then its place. It holds if the pair now at the place has that rank.
        heap = [m[0] << 40 | i for i in range(n - 1) if (m := merges.get(sym[i] << 32 | sym[i + 1]))]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j < 0:
                continue
            m = merges.get(sym[i] << 32 | sym[j])
            if m is None or m[0] != top >> 40:
                continue
            sym[i], sym[j] = m[1], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get(sym[i] << 32 | sym[k]):
                    heapq.heappush(heap, m[0] << 40 | i)
            h = before[i]
            if h >= 0 and (m := merges.get(sym[h] << 32 | sym[i])):
                heapq.heappush(heap, m[0] << 40 | h)
        return np.array([s for s in sym if s >= 0], dtype=np.int64)

    def rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in order, and the number of symbols of each."""
        sym = self.char[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
        seg = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        done_sym, done_seg = [], []
        while len(sym):
            pair = (sym[:-1] << 32) | sym[1:]
            at = np.searchsorted(self.keys, pair)
            hit = (self.keys[at] == pair) & (seg[:-1] == seg[1:])
            rank = np.append(np.where(hit, self.ranks[at], _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            lengths = np.diff(np.append(starts, len(seg)))
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = least == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_seg.append(seg[over])
                go = ~over
                if not go.any():
                    break
                sym, seg, rank, least = sym[go], seg[go], rank[go], least[go]
                at = np.append(at, 0)[go]
            else:
                at = np.append(at, 0)
            here = np.flatnonzero(rank == least)
            made = self.made[at[here]]
            # Of a run of overlapping occurrences every other one merges, from the left.
            run = np.append(True, np.diff(here) > 1)
            head = np.maximum.accumulate(np.where(run, np.arange(len(here)), 0))
            take = (np.arange(len(here)) - head) % 2 == 0
            first = np.append(True, seg[here][1:] != seg[here][:-1])
            take &= first | ~np.repeat(np.maximum.reduceat(self.risky[made], np.flatnonzero(first)), np.diff(np.append(np.flatnonzero(first), len(here))))
            here, made = here[take], made[take]
            sym[here] = made
            keep = np.ones(len(sym), dtype=bool)
            keep[here + 1] = False
            sym, seg = sym[keep], seg[keep]
        if not done_sym:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        return sym[np.argsort(seg, kind="stable")], np.bincount(seg, minlength=len(words))

    def learn(self, keys: list[str]) -> None:
        """Fill the cache; a key that starts with a line feed has no space before it, any other has one."""
        words = [k[1:] if k[:1] == "\n" else SPACE + k.replace(" ", SPACE) for k in keys]
        symbols, sizes = self.symbols(words)
        at = 0
        for key, size in zip(keys, sizes.tolist()):
            ids = [self.byte[10]] if key[:1] == "\n" else []
            for s in symbols[at : at + size].tolist():
                if s < self.n:
                    ids.append(s)
                else:
                    ids.extend(self.byte[b] for b in chr(s - self.n).encode())
            at += size
            self.cache[key] = (" ".join([self.text[i] for i in ids]), b"".join([self.raw[i] for i in ids]).decode())

    def keys_of(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " ":
            return [w if w[0] == "\n" else w[1:] for w in re.findall(r"\n[^ \n]*| +[^ \n]*", " " + text)]
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Decimal ids joined by spaces, and the text decoded from them."""
        keyed = [self.keys_of(t) for t in texts]
        new = set().union(*keyed) - self.cache.keys() if keyed else set()
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = set().union(*keyed)
        if new:
            self.learn(list(new))
        out = []
        for keys in keyed:
            got = [self.cache[k] for k in keys]
            ids = " ".join([g[0] for g in got])
            out.append((f"{ids} {self.end}" if ids else str(self.end), "".join([g[1] for g in got])[1:]))
        return out


def tokenize(docs: DataFrame, model: str, digests: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and either ids (array<int>) and decoded, or their two digests.

    ``model`` is the path of a SentencePiece BPE model on the driver; an end id closes every text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(model))

    def run(batches):
        merger = Merger(shared.value)
        for batch in in_pieces(batches, 1):
            names, rows = batch.column(0), []
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 64):
                for ids, decoded in merger.encode([t or "" for t in texts[at : at + 64]]):
                    n = ids.count(" ") + 1
                    if digests:
                        rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                    else:
                        rows.append((n, np.array(ids.split(" "), dtype=np.int32), decoded))
            n, a, b = zip(*rows) if rows else ((), (), ())
            second = pa.array(a, pa.string() if digests else pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64()), second, pa.array(b, pa.string())], names=list(fields))

    fields = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256") if digests else ("doc_id", "n_tokens", "ids", "decoded")
    kind = "string" if digests else "array<int>"
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id long, n_tokens long, {fields[2]} {kind}, {fields[3]} string")
