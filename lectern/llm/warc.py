"""WARC archives: a monolithic gzip stream is inflated once, every record becomes a member of its own, and a
sidecar index has the offsets.

Files go to the shared folder through pyarrow's file systems. Every attempt of a task writes files of its own
name and only the winner's names are passed on, so a lost executor leaves at most a file that nobody reads.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads shorter than this are always stored.
LEAST = 1000
SALTS = 32
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
DATE = "1970-01-01T00:00:00Z"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, so the length of what it leaves out."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> tuple[dict[str, str], int]:
    """The WARC header's fields, by lower-case name, and where the block begins."""
    end = raw.index(b"\r\n\r\n")
    fields = (line.split(":", 1) for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, v in fields}, end + 4


def parse(raw: bytes) -> dict:
    h, at = headers(raw)
    block = raw[at:at + int(h["content-length"])]
    cut = block.index(b"\r\n\r\n") + 4
    number = lambda x: int(x.strip("<>").removeprefix(URN)) if x and x.strip("<>") != URN else None
    revisit = h["warc-type"] == "revisit"
    if revisit:
        http = dict(line.split(": ", 1) for line in block[:cut].decode().split("\r\n")[1:] if line)
        size, digest = int(http["Content-Length"]), h["warc-payload-digest"].removeprefix("sha1:")
    else:
        size, digest = len(block) - cut, hashlib.sha1(block[cut:]).hexdigest()
    return {"page_id": number(h["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": number(h.get("warc-refers-to"))}


def inflate(stream, chunk: int = CHUNK):
    """The bytes of a gzip stream of one or many members, at most `chunk` at a time."""
    d = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            out = d.decompress(data, chunk)
            if out:
                yield out
            data = d.unconsumed_tail
            if d.eof:
                data, d = d.unused_data.lstrip(b"\0"), zlib.decompressobj(31)


def records(chunks):
    """Whole records of an inflated stream; holds one record and a chunk."""
    buf, need = bytearray(), 0
    for c in chunks:
        buf += c
        while len(buf) >= max(need, 1):
            if not need:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                h, at = headers(bytes(buf[:end + 4]))
                need = at + int(h["content-length"]) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = 0
    if buf.strip():
        raise ValueError(f"the archive ends inside a record: {len(buf)} bytes left")


def _at(folder: str, name: str):
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return fs, f"{path}/{name}", f"{folder}/{name}"


def _writer(folder: str):
    def run(batches):
        gz = out = None
        n = 0
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(b.column(i).to_pylist() for i in range(5))):
                if out is None:
                    fs, path, name = _at(folder, f"{uuid.uuid4().hex}.warc.gz")
                    out, gz = fs.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(gz.compress(record(page_id, url, payload or b"", digest, refers_to)))
                n += 1
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": name, "records": n}], pa.schema([("path", pa.string()), ("records", pa.int64())]))
    return run


def _normaliser(folder: str):
    def run(batches):
        for b in batches:
            for source in b.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(source)
                stem = uuid.uuid4().hex
                ofs, opath, oname = _at(folder, f"{stem}.warc.gz")
                _, ipath, iname = _at(folder, f"{stem}.idx")
                offset = n = 0
                with fs.open_input_stream(path, compression=None) as src, ofs.open_output_stream(opath, compression=None) as dst, ofs.open_output_stream(ipath, compression=None) as idx:
                    for raw in records(inflate(src)):
                        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = gz.compress(raw) + gz.flush()
                        dst.write(member)
                        h, _ = headers(raw)
                        idx.write(f"{offset}\t{len(member)}\t{h['warc-type']}\t{h['warc-record-id']}\n".encode())
                        offset += len(member)
                        n += 1
                yield pa.RecordBatch.from_pylist([{"archive": oname, "index": iname, "records": n}], pa.schema([("archive", pa.string()), ("index", pa.string()), ("records", pa.int64())]))
    return run


_READ = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())]


def _reader(batches):
    for b in batches:
        for archive, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fs, path = pafs.FileSystem.from_uri(archive)
            rows = []
            with fs.open_input_file(path) as f, fs.open_input_stream(pafs.FileSystem.from_uri(index)[1], compression=None) as idx:
                for line in _lines(idx):
                    offset, size = map(int, line.split(b"\t")[:2])
                    f.seek(offset)
                    rows.append(parse(zlib.decompress(f.read(size), 31)) | {"archive": archive, "offset": offset})
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(_READ))
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, pa.schema(_READ))


def _lines(stream):
    rest = b""
    while data := stream.read(CHUNK):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads of at least `least` bytes the largest
    page_id is stored and the others refer to it. A hot payload is dealt over SALTS tasks."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    same = p.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("stored")).where("n > 1")
    same = same.select("digest", "stored", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("stored")), F.col("stored"))
    return p.join(same, ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_monolithic(plan: DataFrame, folder: str) -> DataFrame:
    """(path, records): one gzip stream for each partition."""
    common.bounded_batches(plan.sparkSession)
    return plan.mapInArrow(_writer(folder), "path string, records long")


def normalise(paths: DataFrame, folder: str) -> DataFrame:
    """(archive, index, records) for each monolithic file of `path`: a member for each record, and the offsets."""
    n = max(1, paths.count())
    return paths.select("path").repartition(n, "path").mapInArrow(_normaliser(folder), "archive string, index string, records long")


def read(archives: DataFrame) -> DataFrame:
    """The records of indexed archives, each read by its offset and inflated alone."""
    n = max(1, archives.count())
    return archives.select("archive", "index").repartition(n, "archive").mapInArrow(
        _reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long")


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes a record per page, normalises the archives and reads them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, archive, offset.

    Null html is an empty payload; a null page_id is kept, as a revisit if its payload is stored under an id,
    and stored otherwise; rows that repeat the largest page_id of a payload are all stored; a null url is
    empty, control signs and spaces in it are percent-encoded; extra columns are ignored; an empty table
    gives no archive and no rows.
    """
    spark = pages.sparkSession
    folder = common.scratch(spark, "warc")
    mono = common.materialize(write_monolithic(planned(pages, least), f"{folder}/mono"), "mono")
    members = common.materialize(normalise(mono, f"{folder}/members"), "members")
    return read(members)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(common.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS stored FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN stored IS NOT NULL AND page_id IS DISTINCT FROM stored THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM stored THEN stored END AS refers_to
FROM m
"""
