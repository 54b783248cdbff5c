"""WARC archives, every record a Zstandard frame of its own, compressed with a dictionary that leads the archive.

Of pages with equal payloads of at least ``least`` bytes the one with the smallest id is written as a response, the others as
revisits without a payload that refer to it. Every task writes archives of its own: it trains a dictionary on the
archive's first records (TRAIN_BYTES at most), writes it compressed in a leading skippable frame, as the WARC-Zstandard
convention has it, and then one frame per record, so that a record can be read without the ones before it. An archive ends at
ARCHIVE_BYTES. Archives have random names; only those in the returned manifest, which Spark commits, count, so a lost or repeated
attempt leaves an unused file in the folder and no double record.

Skew: a digest with over 1 / HOT of all rows gets its response by a broadcast of at most HOT rows; the others by a join on the digest.
Memory: a task holds TRAIN_BYTES of records, then one record at a time; an archive is read by one task in chunks.

Cases: a null html is an empty payload; payloads below ``least`` bytes are always responses; rows that repeat both id and payload are all responses; a
null id is never referred to unless no row has an id, then all rows of the payload are responses; a null url is left out; blanks and control characters
of a url are percent-encoded; an archive of few or small records has no dictionary; an empty table gives an empty result;
extra columns are not carried. A damaged archive, a digest or a number of records that does not agree raises.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.token_arrays import in_pieces
from ledgerweave.session import durable, shared_dir, temporary

DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES, TRAIN_BYTES, LEAST_SAMPLES = 64 << 10, 4 << 20, 16
ARCHIVE_BYTES = 256 << 20
CHUNK = 16 << 10
HOT = 5000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, n_records long, n_bytes long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
ROW = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "refers_url")


def digested(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload (UTF-8 bytes), payload_bytes, payload_digest (hex SHA-256)."""
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})


def with_revisits(rows: DataFrame, least: int = 100) -> DataFrame:
    """Add refers_to and refers_url: id and url of the response of a repeated payload, null where a row is one itself."""
    facts = durable(rows.where(F.col("payload_bytes") >= least).select("page_id", "url", "payload_digest"))
    repeats = durable(
        facts.groupBy("payload_digest")
        .agg(F.min("page_id").alias("keeper"), F.min_by("url", "page_id").alias("keeper_url"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and keeper is not null")
    )
    share = facts.count() / HOT
    named = lambda x, key: x.select(F.col("payload_digest").alias(key), F.struct("keeper", "keeper_url").alias(f"{key}_kept"))
    hot, rest = named(repeats.where(F.col("n") > share), "_hot"), named(repeats.where(F.col("n") <= share), "_rest")
    out = rows.join(F.broadcast(hot), F.col("payload_digest") == F.col("_hot"), "left")
    # A row of a hot payload, or of a short one, looks for nothing more; it is dealt out by its own key.
    away = F.col("_hot").isNotNull() | (F.col("payload_bytes") < least)
    key = F.when(away, F.concat_ws(" ", "payload_digest", F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("payload_digest"))
    out = out.withColumn("_key", key).join(rest, F.col("_key") == F.col("_rest"), "left")
    kept = F.coalesce("_hot_kept", "_rest_kept")
    other = (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(kept["keeper"])
    return out.select(*ROW[:5], F.when(other, kept["keeper"]).alias("refers_to"), F.when(other, kept["keeper_url"]).alias("refers_url"))


def _escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.UUID(digest[:32])}>"


def warc_record(page_id, url, payload: bytes, payload_bytes: int, digest: str, refers_to, refers_url, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the http header alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _escaped(url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Refers-To-Date", date)]
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", _escaped(refers_url)))
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed_record(raw: bytes) -> tuple:
    """The values of RECORD; a payload that does not agree with its length or digest raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's block has another length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    if fields["WARC-Type"] == "revisit":
        payload = None
    elif len(payload) != n or (found := hashlib.sha256(payload).hexdigest()) != digest:
        raise ValueError("a payload does not agree with its record")
    else:
        digest = found
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], n, digest, number("WARC-Refers-To"), payload


class ArchiveWriter:
    """One archive; its first records wait until a dictionary is trained on them."""

    def __init__(self, filesystem, path: str, level: int):
        import zstandard

        self.zstd, self.level, self.path = zstandard, level, path
        self.waiting: list[bytes] | None = []
        self.waiting_bytes = self.n_records = self.n_bytes = 0
        self.stream = filesystem.open_output_stream(path, compression=None)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.n_bytes += len(data)

    def _begin(self) -> None:
        samples, self.waiting = self.waiting, None
        size = min(DICTIONARY_BYTES, self.waiting_bytes // 50)
        trained = None
        if size >= 1024 and len(samples) >= LEAST_SAMPLES:
            try:
                trained = self.zstd.train_dictionary(size, samples, k=200, d=8, f=18, split_point=1.0, accel=4)
            except self.zstd.ZstdError:  # too uniform to learn from
                trained = None
        if trained is not None:
            body = self.zstd.ZstdCompressor(level=19).compress(trained.as_bytes())
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
        self.compressor = self.zstd.ZstdCompressor(level=self.level, dict_data=trained, write_content_size=True, write_checksum=True)
        for record in samples:
            self._put(self.compressor.compress(record))

    def write(self, record: bytes) -> None:
        self.n_records += 1
        if self.waiting is None:
            self._put(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if self.waiting_bytes >= TRAIN_BYTES:
            self._begin()

    def close(self) -> tuple[str, int, int]:
        if self.waiting is not None:
            self._begin()
        self.stream.close()
        return self.path, self.n_records, self.n_bytes


def archived(stream):
    """The decompressed records of one archive, in order."""
    import zstandard

    rest = stream.read(CHUNK)
    trained = None
    if len(rest) >= 8 and struct.unpack("<I", rest[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", rest[4:8])[0]
        body = rest[8:]
        while len(body) < size:
            more = stream.read(size - len(body))
            if not more:
                raise ValueError("the dictionary is cut off")
            body += more
        content, rest = body[:size], body[size:]
        if content[:4] == b"\x28\xb5\x2f\xfd":
            content = zstandard.ZstdDecompressor().decompress(content)
        trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)
    reader = zstandard.ZstdDecompressor(dict_data=trained)
    while rest := rest or stream.read(CHUNK):
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(CHUNK)
            if not rest:
                raise ValueError("the last record is cut off")
        yield b"".join(parts)


def write_archives(rows: DataFrame, folder: str, level: int = 3, date: str = DATE) -> DataFrame:
    """Write ``rows`` (the columns ROW) as archives under ``folder``; the manifest of the archives, written once."""

    def run(batches):
        from pyarrow import fs

        filesystem, root = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        open_ = None
        for batch in in_pieces(batches, 2):
            done = []
            for row in zip(*[batch.column(c).to_pylist() for c in ROW]):
                open_ = open_ or ArchiveWriter(filesystem, f"{root}/{uuid.uuid4().hex}.warc.zst", level)
                open_.write(warc_record(*row, date))
                if open_.n_bytes >= ARCHIVE_BYTES:
                    done.append(open_.close())
                    open_ = None
            if done:
                yield _manifest(done)
        if open_ is not None:
            yield _manifest([open_.close()])

    def _manifest(done):
        path, n, size = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(path), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["archive", "n_records", "n_bytes"])

    return durable(rows.select(*ROW).mapInArrow(run, MANIFEST), outer=True)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records (RECORD) of all archives of a manifest, one archive a task; their numbers are checked."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        from pyarrow import fs

        filesystem, _ = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, seen = [], 0, 0
                with filesystem.open_input_stream(path, compression=None) as stream:
                    for raw in archived(stream):
                        rows.append(parsed_record(raw))
                        size += len(raw)
                        seen += 1
                        if size >= 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                if seen != n:
                    raise ValueError(f"{path} has {seen} records in place of {n}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    tasks = max(1, manifest.count())
    return manifest.select("archive", "n_records").repartition(tasks).mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = 100) -> tuple[DataFrame, str]:
    """Archive all pages; the manifest, and the folder (a new one in the shared folder unless given)."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/ledgerweave/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    with temporary():
        return write_archives(with_revisits(digested(pages), least), folder), folder


def op11_query(pages: DataFrame) -> DataFrame:
    """What the archives say of every page, read back from them."""
    return read_archives(*archive_pages(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH sized AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
     firsts AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS keeper FROM sized)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> keeper THEN keeper END AS refers_to
FROM firsts
"""
