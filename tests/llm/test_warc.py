"""WARC archives: round trips, the dictionary's frame, revisits against brute force."""

import hashlib
import random

import pytest
import zstandard
from ledgerweave.llm import warc
from pyarrow import fs

PAGES = "page_id long, url string, html string, payload string, _key string, n_bytes long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 1) for i, u, h in rows], PAGES)


def expected(rows, least=100):
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in raw:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in raw:
        revisit = len(p) >= least and p in first and first[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out, key=str)


def some_rows():
    rng = random.Random(3)
    words = ["<p>", "</p>", "news", "market", "Größe", "言葉", "\r\n", "the", "of", "table"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same = text(60)
    rows = [(i, f"http://h/{i}", same if i % 3 == 0 else text(rng.randrange(0, 90))) for i in range(300)]
    long = text(60_000)
    rows += [(1000, "http://h/a b\r\nX: 1", long), (999, None, long), (None, "http://h/n", same), (None, None, None), (1001, "u", ""), (1002, "u", None)]
    edge = "e" * 99
    rows += [(1003, "u", edge), (1004, "u", edge), (1005, "u", edge + "e"), (1006, "u", edge + "e"), (1007, "r", text(40)), (None, "q", "only " * 40), (None, "q", "only " * 40)]
    return rows + [rows[-3], (-5, "minus", same)]


def test_pages_read_back(spark):
    rows = some_rows()
    got = warc.op11_query(pages(spark, rows).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_hot_payload_and_own_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 2)
    rows = some_rows()
    manifest, folder = warc.archive_pages(pages(spark, rows).repartition(2), str(tmp_path / "w"))
    got = warc.read_archives(manifest, folder)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(rows)
    texts = {i: h for i, _, h in rows if i is not None}
    for r in got.where("record_type = 'response' and page_id is not null").collect():
        assert r.payload.decode() == (texts[r.page_id] or "")
    assert {r.url for r in got.where("page_id = 1000").collect()} == {"http://h/a%20b%0D%0AX:%201"}


def test_dictionary_leads_the_archive(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><body class='article'>{i * 7919} " + " ".join(f"item{(i * k) % 97}" for k in range(200))) for i in range(400)]
    manifest, folder = warc.archive_pages(pages(spark, rows).coalesce(1), str(tmp_path / "w"))
    (row,) = manifest.collect()
    data = open(row.archive, "rb").read()
    assert len(data) == row.n_bytes and row.n_records == 400
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    size = int.from_bytes(data[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    assert dictionary.dict_id() != 0
    # Every record is one frame and can be read alone.
    rest, seen = data[8 + size :], 0
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\n") and one.eof
        rest, seen = one.unused_data, seen + 1
    assert seen == 400
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(warc.warc_record(i, u, h.encode(), len(h), "0" * 64, None, None))) for i, u, h in rows)
    assert row.n_bytes < 0.9 * plain


def test_damage_raises(spark, tmp_path):
    local, path = fs.LocalFileSystem(), str(tmp_path / "a.warc.zst")
    writer = warc.ArchiveWriter(local, path, 3)
    body = b"hello" * 50
    writer.write(warc.warc_record(1, "u", body, 250, hashlib.sha256(body).hexdigest(), None, None))
    writer.close()
    raw = list(warc.archived(local.open_input_stream(path, compression=None)))
    assert warc.parsed_record(raw[0])[-1] == body
    with pytest.raises(ValueError):
        warc.parsed_record(raw[0].replace(b"hellohello", b"hellohellO"))
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-9])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.archived(local.open_input_stream(path, compression=None)))


def test_empty_table(spark):
    assert warc.op11_query(pages(spark, [])).collect() == []
