import gzip
import hashlib
import io
import zlib

import pytest

from lectern.llm import warc


def brute(rows):
    stored = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            stored[b] = max(stored.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = stored.get(b) if stored.get(b) != i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def test_round_trip(spark):
    big, wide = "x" * 1000, "é" * 600 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/b c", big), (2, None, big), (3, "u\r\nInjected: 1", None), (4, "u", ""), (5, "u", "<html>"), (6, "u", "<html>"), (7, "ü", wide), (8, "u", wide), (9, "u", wide), (9, "u", wide), (None, "u", big), (10, "u", "y" * 999), (11, "u", "y" * 999)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    a = warc.archive(df).collect()
    assert sorted([tuple(r)[:5] for r in a], key=str) == brute(rows)
    path = a[0]["archive"].removeprefix("file://")
    raw = open(path, "rb").read()
    assert gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type") == sum(r["archive"] == a[0]["archive"] for r in a)
    assert zlib.decompressobj(31).decompress(raw[a[0]["offset"]:]).startswith(b"WARC/1.1\r\n")
    assert warc.archive(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_streams_in_any_chunks(chunk):
    every = [warc.record(i, "u", b"p" * i + b"\r\n\r\n", "d", None if i % 2 else i) for i in range(9)]
    whole = gzip.compress(b"".join(every[:5])) + gzip.compress(b"".join(every[5:]))
    assert list(warc.records(warc.inflate(io.BytesIO(whole), chunk))) == every
    with pytest.raises(ValueError):
        list(warc.records([every[0][:-9]]))
