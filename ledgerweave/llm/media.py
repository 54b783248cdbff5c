"""Media columns: PNG files in binary columns, written and read chunk by chunk.

A payload becomes an RGB image of 64 pixels a row (192 bytes). Writing filters each row,
deflates and frames the chunks; reading checks signature, chunk checksums and sizes, inflates and
undoes the row filters with numpy. The feature is a 63-bit hash of the low-frequency cosine
transform of the image's 32 x 32 mean grey picture.

Cases: a null text counts as empty; an empty text is one row of blanks; very long texts make tall
images; a damaged file raises; repeated rows give repeated results; extra columns are not carried.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.token_arrays import in_pieces

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
SIDE, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, level: int = 1) -> bytes:
    """Lossless 8-bit RGB image of the payload, whose length is a positive multiple of 192.

    Rows are filtered by Up where that lowers the sum of absolute differences, else left as they are.
    """
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = np.abs(up.view(np.int8).astype(np.int16)).sum(axis=1) < np.abs(rows.view(np.int8).astype(np.int16)).sum(axis=1)
    lines = np.empty((len(rows), ROW + 1), dtype=np.uint8)
    lines[:, 0] = np.where(cost, 2, 0)
    lines[:, 1:] = np.where(cost[:, None], up, rows)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(data: bytes):
    """Kind and body of every chunk; raises on a wrong signature, length or checksum."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(data):
            raise ValueError("a chunk is cut off")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        yield kind, body
        at += 12 + size


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Undo the five row filters; ``step`` is the number of bytes of a pixel."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    above = np.zeros(out.shape[1], dtype=np.uint8)
    for i, kind in enumerate(kinds.tolist()):
        row = out[i]
        if kind == 1:
            row[:] = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row += above
        elif kind == 3:
            left = np.zeros(step, dtype=np.int16)
            for j in range(0, len(row), step):
                left = (row[j : j + step].astype(np.int16) + ((left + above[j : j + step]) >> 1)) & 255
                row[j : j + step] = left
        elif kind == 4:
            left, corner = np.zeros(step, dtype=np.int16), np.zeros(step, dtype=np.int16)
            for j in range(0, len(row), step):
                b = above[j : j + step].astype(np.int16)
                pa_, pb, pc = np.abs(b - corner), np.abs(left - corner), np.abs(left + b - 2 * corner)
                near = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, b, corner))
                left = (row[j : j + step].astype(np.int16) + near) & 255
                row[j : j + step], corner = left, b
        above = row
    return out


def read_png(data: bytes) -> np.ndarray:
    """Samples as height x (width * channels), for 8-bit grey, RGB and their alpha forms without interlace."""
    head, body, ended = None, [], False
    for kind, part in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
    if head is None or not ended or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("unsupported or incomplete image")
    step = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    flat = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    if len(flat) != head[1] * (head[0] * step + 1):
        raise ValueError("wrong number of samples")
    return unfilter(flat.reshape(head[1], -1), step)


def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


_COS = _cosines()


def cosine_hash(samples: np.ndarray, step: int = CHANNELS) -> str:
    """16 hex digits: signs of the 63 lowest frequencies against their median, the mean left out."""
    grey = samples.reshape(samples.shape[0], -1, step).mean(axis=2)
    small = _shrink(_shrink(grey).T).T
    low = (_COS @ small @ _COS.T).ravel()[1:]
    bits = np.append(0, low > np.median(low)).astype(np.uint8)
    return np.packbits(bits).tobytes().hex()


def _shrink(a: np.ndarray) -> np.ndarray:
    """Mean of SIDE even stretches of rows; short inputs repeat rows."""
    edges = np.arange(SIDE + 1) * len(a) // SIDE
    if len(a) < SIDE:
        return a[np.minimum(np.arange(SIDE) * len(a) // SIDE, len(a) - 1)]
    return np.add.reduceat(a, edges[:-1], axis=0) / np.diff(edges)[:, None]


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * ((-len(raw)) % ROW if raw else ROW), len(raw)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary PNG)."""

    def run(batches):
        for batch in in_pieces(batches, 1):
            made = [payload_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([write_png(p) for p, _ in made], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """Decode every image: doc_id, n_bytes, payload (binary), feature, media."""

    def run(batches):
        for batch in in_pieces(batches, 2):
            files = batch.column(2).to_pylist()
            pictures = [read_png(f) for f in files]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([p.tobytes() for p in pictures], pa.binary()),
                    pa.array([cosine_hash(p) for p in pictures], pa.string()),
                    batch.column(2),
                ],
                names=["doc_id", "n_bytes", "payload", "feature", "media"],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload binary, feature string, media binary"
    )


def op6_query(docs: DataFrame) -> DataFrame:
    back = read_back(store(docs))
    n = F.length("payload")
    return back.select(
        "doc_id",
        "n_bytes",
        n.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
