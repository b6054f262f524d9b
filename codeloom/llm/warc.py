"""WARC archives: writing pages, normalising whole-file gzip streams, reading records through an offset index.

``write_archives`` writes each partition's pages as one gzip stream a file.  A page whose payload equals that of
a page with a smaller id becomes a revisit record that names it.  Such a file can only be read from its start.

``normalise`` inflates a file's stream once, in pieces of fixed size, and rewrites every record as a gzip member
of its own, with a sidecar file listing offset, length, type and id of each member.  ``read_records`` then reads
any range of any archive from the sidecars, many tasks to an archive.

A task writes under a new name and reports the name in its rows.  Those rows, stored as a table, say which files
count: what a lost or repeated task left behind is named nowhere and never read.  Files are opened by URI
(``file``, ``hdfs``, ``s3``, ``gs``: what ``pyarrow.fs`` opens), so the folder must be one that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.tables import stored
from codeloom.session import checkpoint_dir

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SALTS = 256                      # rows with one payload are looked up under this many keys
STEP = 1 << 20                   # bytes inflated, or gathered for a read, at once
MAX_HEADER = 1 << 20
READ_AHEAD = 8 << 20             # neighbouring members are fetched together up to this size
SLAB = 32 << 20                  # bytes of an archive that one task reads
ARCHIVE_BYTES = 1 << 30          # a task begins a new file after this many bytes of records

WRITTEN = "path string, records long, bytes long"
NORMAL = "path string, normalised string, sidecar string, records long, bytes long, error string"
MEMBER = "archive string, offset long, length long, type string, record_id string"
RECORD = ("archive string, offset long, type string, record_id string, target_uri string, date string, refers_to string, "
          "payload binary, payload_bytes long, payload_digest string, digest_ok boolean")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


# --- record ids ---------------------------------------------------------------------------

def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the id; the nil UUID for a page without one."""
    if page_id is None:
        return f"<urn:uuid:{uuid.UUID(int=0)}>"
    x = page_id & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=(x >> 16) << 80 | 8 << 76 | 2 << 62 | x & 0xFFFF)}>"


def page_of(record: str | None) -> int | None:
    """The id in a record id made by ``record_id``; null for any other."""
    if not record or not record.startswith("<urn:uuid:"):
        return None
    v = uuid.UUID(record[10:-1]).int
    if v >> 76 & 15 != 8 or v >> 62 & 3 != 2:
        return None
    x = v >> 80 << 16 | v & 0xFFFF
    return x - (1 << 64) if x >> 63 else x


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing ------------------------------------------------------------------------------

def _head(fields: list[tuple[str, str | None]], first: str) -> bytes:
    return "\r\n".join([first, *[f"{k}: {v}" for k, v in fields if v is not None], "", ""]).encode()


def _record(kind: str, rid: str, date: str, block: bytes, more: list[tuple[str, str | None]]) -> bytes:
    head = _head([("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), *more, ("Content-Length", str(len(block)))], VERSION)
    return b"".join((head, block, b"\r\n\r\n"))


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One response record, or a revisit record without the payload if ``refers_to`` is given."""
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    uri = None if url is None else quote(url, safe="%:/?#[]@!$&'()*+,;=-._~") or None
    more = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is None:
        return _record("response", record_id(page_id), date, http + payload, more)
    return _record("revisit", record_id(page_id), date, http, [*more, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))])


def first_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, first): ``first`` is the smallest id with the same payload, null where no other row has it.

    Rows are counted by (payload hash, salt), then by payload hash, and only hashes that repeat go back, one
    row a salt: a payload that a third of all pages share is never one group of rows.
    """
    key = F.when(F.length("payload") >= min_bytes, F.sha2("payload", 256))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    keyed = pages.withColumn("key", key).withColumn("salt", salt)
    per_salt = keyed.where("key is not null").groupBy("key", "salt").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    repeated = per_salt.groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("first")).where("n > 1")
    look_up = per_salt.select("key", "salt").join(repeated.select("key", "first"), "key")
    return keyed.join(look_up, ["key", "salt"], "left").select("id", "url", "payload", "first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Pages written as monolithic .warc.gz files under ``folder``: (path, records, bytes) a file, as a stored table.

    The page with the smallest id of those with one payload is a response, the others revisit it; payloads of
    under ``min_bytes`` bytes are all responses.  Null html counts as empty.  Rows that repeat the smallest id
    are responses too; a page without an id revisits a page that has one, else it is a response under the nil
    UUID.  A null or empty url gives a record without a target.  Other columns are ignored; an empty table
    writes no file.
    """
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = first_pages(src, min_bytes).select(
        F.col("id").cast("string").alias("id"), "url", "payload",
        F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first")).cast("string").alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for b in batches:
            for i, url, payload, ref in zip(b["id"], b["url"], b["payload"], b["refers_to"]):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, at = _open(path)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out, gz, n, size = fs.open_output_stream(at, compression=None), zlib.compressobj(level, wbits=31), 0, 0
                    info = _record("warcinfo", f"<{uuid.uuid4().urn}>", date, b"software: codeloom\r\nformat: WARC File Format 1.1\r\n",
                                   [("Content-Type", "application/warc-fields")])
                    out.write(gz.compress(info))
                record = page_record(None if i is None else int(i), url, payload, None if ref is None else int(ref), date)
                out.write(gz.compress(record))
                n, size = n + 1, size + len(record)
                if size >= archive_bytes:
                    out.write(gz.flush())
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})
    return stored(rows.mapInPandas(run, WRITTEN))


# --- normalising --------------------------------------------------------------------------

class Damaged(Exception):
    """A stream that ends early, is no gzip stream, or holds no WARC record where one should begin."""


class Inflater:
    """Bytes of a gzip stream of one or more members, read forward in steps of fixed size."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read_raw, self.raw, self.buffer, self.at, self.z, self.used = read, b"", b"", 0, None, False

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.read_raw(STEP)
            if not self.raw:
                if self.z is not None:
                    raise Damaged("the gzip stream ends early")
                return False
        if self.z is None:
            if self.used and not self.raw.strip(b"\0"):            # padding after the last member
                self.raw = b""
                return True
            self.z, self.used = zlib.decompressobj(31), True
        try:
            out = self.z.decompress(self.raw, STEP)
        except zlib.error as e:
            raise Damaged(f"no gzip stream: {e}") from None
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        if self.z.eof:
            self.z = None
        self.buffer, self.at = self.buffer[self.at:] + out, 0
        return True

    def head(self) -> bytes | None:
        """Up to and with the next empty line; null at the end of the stream."""
        looked = 0
        while (end := self.buffer.find(b"\r\n\r\n", self.at + looked)) < 0:
            looked = max(0, len(self.buffer) - self.at - 3)
            if looked > MAX_HEADER:
                raise Damaged("a header does not end")
            if not self._more():
                if self.buffer[self.at:].strip():
                    raise Damaged("the last record is cut short")
                return None
        out, self.at = self.buffer[self.at:end + 4], end + 4
        return out

    def body(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if self.at == len(self.buffer) and not self._more():
                raise Damaged("the last record is cut short")
            piece = self.buffer[self.at:self.at + n]
            self.at, n = self.at + len(piece), n - len(piece)
            yield piece


def fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields (names in lower case) of a header; lines that begin with space go on the one before."""
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    return lines[0], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def members(read: Callable[[int], bytes], level: int = 6) -> Iterator[tuple[bytes, str, str]]:
    """(gzip member, type, record id) of every record of a stream; raises ``Damaged`` after the last whole one."""
    source = Inflater(read)
    while (head := source.head()) is not None:
        first, f = fields(head.lstrip(b"\r\n"))
        if not first.startswith("WARC/") or not f.get("content-length", "").isdigit():
            raise Damaged("no WARC record")
        z = zlib.compressobj(level, wbits=31)
        out = [z.compress(head.lstrip(b"\r\n"))]
        for n in (int(f["content-length"]), 4):
            out += [z.compress(piece) for piece in source.body(n)]
        yield b"".join((*out, z.flush())), f.get("warc-type", ""), f.get("warc-record-id", "")


def _normalise_file(path: str, folder: str, level: int) -> tuple:
    name = f"{folder}/{uuid.uuid4().hex}"
    fs, at = _open(name)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    n = size = 0
    error = None
    with fs.open_output_stream(at + ".warc.gz", compression=None) as out, fs.open_output_stream(at + ".idx", compression=None) as index:
        try:
            source, where = _open(path)
            with source.open_input_stream(where, compression=None) as stream:
                for member, kind, rid in members(stream.read, level):
                    out.write(member)
                    index.write(f"{size}\t{len(member)}\t{kind}\t{rid}\n".encode())
                    n, size = n + 1, size + len(member)
        except Damaged as e:
            error = str(e)
    return path, name + ".warc.gz", name + ".idx", n, size, error


def normalise(files: DataFrame, folder: str, path_col: str = "path", level: int = 6) -> DataFrame:
    """Every file of ``files`` rewritten under ``folder`` with a member a record and a sidecar index, as a stored table.

    (path, normalised, sidecar, records, bytes, error).  One task reads a file, forward and in fixed memory but
    for the record it is in.  A file that is cut short or damaged keeps the whole records before the damage and
    says so in ``error``; a missing file fails the job.  Files already made of many members, mixed ones, and
    empty ones are fine.  Null paths give no row; a path listed twice is rewritten twice.
    """
    files = files.select(F.col(path_col).alias("path")).where("path is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NORMAL.split(", ")]
        for b in batches:
            for path in b["path"]:
                yield pd.DataFrame([_normalise_file(path, folder, level)], columns=names)
    n = files.count()                                                            # a row a file
    return stored(files.repartition(max(1, n), "path").mapInPandas(run, NORMAL))


# --- reading ------------------------------------------------------------------------------

def index_rows(archives: DataFrame) -> DataFrame:
    """(archive, offset, length, type, record_id) of every member, from the sidecars."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, sidecar in zip(b["normalised"], b["sidecar"]):
                fs, at = _open(sidecar)
                with fs.open_input_stream(at, compression=None) as stream:
                    lines = io.TextIOWrapper(io.BufferedReader(_Raw(stream)), encoding="utf-8", newline="\n")
                    while part := lines.readlines(STEP):
                        got = pd.DataFrame([x.rstrip("\n").split("\t") for x in part], columns=["offset", "length", "type", "record_id"])
                        got.insert(0, "archive", archive)
                        yield got.astype({"offset": "int64", "length": "int64"})
    return archives.select("normalised", "sidecar").mapInPandas(run, MEMBER)


class _Raw(io.RawIOBase):
    """A stream of pyarrow as one that the standard library can buffer."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.stream.read(len(into))
        into[:len(got)] = got
        return len(got)


def parse_record(member: bytes) -> dict:
    """Fields of one record; the payload of a revisit is null, its size and digest are those its headers state."""
    raw = zlib.decompress(member, 31)
    cut = raw.index(b"\r\n\r\n") + 4
    _, f = fields(raw[:cut])
    block = raw[cut:cut + int(f["content-length"])]
    payload, size = block, None
    if f.get("content-type", "").startswith("application/http"):
        at = block.find(b"\r\n\r\n")
        http, payload = (block, b"") if at < 0 else (block[:at], block[at + 4:])
        size = fields(http)[1].get("content-length")
    stated = f.get("warc-payload-digest", "").rpartition(":")[2] or None
    out = {"type": f.get("warc-type"), "record_id": f.get("warc-record-id"), "target_uri": f.get("warc-target-uri"),
           "date": f.get("warc-date"), "refers_to": f.get("warc-refers-to")}
    if out["type"] == "revisit":
        return out | {"payload": None, "payload_bytes": int(size) if size else None, "payload_digest": stated, "digest_ok": None}
    own = sha1_base32(payload)
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": own, "digest_ok": None if stated is None else own == stated}


def read_records(archives: DataFrame, types: tuple[str, ...] = ("response", "revisit"), keep_payload: bool = True) -> DataFrame:
    """Records of the types asked for, read at the offsets of the sidecars of ``normalise``'s rows.

    (archive, offset, type, record_id, target_uri, date, refers_to, payload, payload_bytes, payload_digest, digest_ok).
    Digests of payloads are computed from the bytes; ``digest_ok`` compares them with the header.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, part in b.groupby("archive", sort=False):
                offsets, ends = part["offset"].to_numpy(), (part["offset"] + part["length"]).to_numpy()
                fs, where = _open(archive)
                with fs.open_input_file(where) as f:
                    at = 0
                    while at < len(part):
                        to = at + 1
                        while to < len(part) and offsets[to] == ends[to - 1] and ends[to] - offsets[at] <= READ_AHEAD:
                            to += 1
                        raw, rows = f.read_at(int(ends[to - 1] - offsets[at]), int(offsets[at])), []
                        for k in range(at, to):
                            r = parse_record(raw[offsets[k] - offsets[at]:ends[k] - offsets[at]])
                            rows.append({"archive": archive, "offset": offsets[k], **r, **({} if keep_payload else {"payload": None})})
                        yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64", "digest_ok": "boolean"})
                        at = to
    spark = archives.sparkSession
    total = archives.agg(F.sum("bytes")).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-total // SLAB))
    found = index_rows(archives).where(F.col("type").isin(*types)).withColumn("slab", F.floor(F.col("offset") / SLAB))
    found = found.repartition(int(n), "archive", "slab").sortWithinPartitions("archive", "offset")
    return found.select("archive", "offset", "length").mapInPandas(run, RECORD)


def page_id(record: Column) -> Column:
    """The page id that ``record_id`` put into a UUID, in built-in functions; null for the nil UUID."""
    h = F.regexp_replace(record, "^<urn:uuid:|-|>$", "")
    # a long's 16 digits: hex of the sign half is read apart, as conv() reads unsigned numbers
    high, low = F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.concat(F.substring(h, 9, 4), F.substring(h, 29, 4)), 16, 10).cast("long")
    signed = F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high)
    return F.when(F.substring(h, 13, 1) == "8", F.shiftleft(signed, 32).bitwiseOR(low))


def round_trip(pages: DataFrame, folder: str | None = None, keep_payload: bool = False, **options) -> DataFrame:
    """Pages written, normalised and read back: ``read_records`` rows of all pages, with page_id and refers_to as ids."""
    folder = folder or f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    files = write_archives(pages, f"{folder}/streams", **options)
    records = read_records(normalise(files, f"{folder}/archives"), keep_payload=keep_payload)
    return records.select(page_id(F.col("record_id")).alias("page_id"), "target_uri", "payload", "payload_bytes", "payload_digest",
                          F.col("type").alias("record_type"), page_id(F.col("refers_to")).alias("refers_to"), "digest_ok")
