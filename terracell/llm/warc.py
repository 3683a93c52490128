"""Conversion of ARC archives to WARC.

ARC files start with a version block that names the fields of the record headers; a record is a header line, whose last
field declares its length, and that many bytes. Fields are told apart from the right, so that addresses may hold blanks.
Each record gets a WARC header with what ARC lacks: an identifier made from its address, time and digest, an ISO timestamp,
a type, and digests of block and payload (what follows the HTTP header, if there is one); what ARC does give is kept. Later
records with a payload that an earlier one has become revisits of it. Records that can't be read are set aside with the
reason. Blocks are bytes throughout.

An archive is a file of gzip members, one for each record, after one with the archive's own record. Spark's text writer
writes them, so any file system that Spark knows will do: a member of less than 16 MB ends in a zero byte (the top of its
length), and that byte is given as the row separator. A longer record takes several members.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm.common import table
from terracell.scratch import scratch, stored

#: Header fields of the two versions of the format.
FIELDS = {1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"), 2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")}
#: Bytes of records in an ARC block made from pages, and in a batch of rows; revisits that may be broadcast.
BLOCK_BYTES, BATCH_BYTES, BROADCAST_ROWS = 1 << 20, 4 << 20, 500_000
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 0
#: Bytes in a gzip member, so that its length ends in a zero byte; bytes given to the decompressor at once.
MEMBER, STEP = (1 << 24) - 1, 1 << 16
#: What ends a header and a record.
END = "\r\n\r\n"
#: A line that looks like a record's header, where reading goes on after one that doesn't.
_HEADER = re.compile(rb"\n(?=[A-Za-z][A-Za-z0-9+.-]*:[^\n]* [^ \n]+ \d{12,14} [^\n]*\d\r?\n)")


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 terracell\n{' '.join(FIELDS[version])}\n".encode()
    line = {1: f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n", 2: f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"}[version]
    return line.encode() + body + b"\n"


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields, block and fault (or None) of each record after the version block.

    A record without a number for its length, with too few bytes or fields, or with no date is given with its fault and
    with its header line as the block; reading goes on at the next line that looks like a header.
    """
    at, fields = 0, None
    while at < len(content):
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].rstrip(b"\r")
        if not line:
            at += 1
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        fault, body = None, b""
        if end < 0:
            fault = "the header does not end"
        elif not (parts[-1].isascii() and parts[-1].isdigit()):
            fault = "no length"
        elif len(body := content[end + 1 : end + 1 + int(parts[-1])]) < int(parts[-1]):
            fault = f"{len(body)} bytes of {parts[-1]}"
        elif line.startswith(b"filedesc://"):
            version = body.split(b" ", 1)[0]
            fields = FIELDS.get(int(version) if version.isdigit() else 0)
            if fields:
                at = end + 1 + len(body)
                continue
            fault = "a version that is not known"
        elif fields is None:
            fault = "no version block before"
        elif len(parts) < len(fields):
            fault = f"{len(parts)} fields of {len(fields)}"
        elif not re.fullmatch(r"\d{12}(\d\d)?", parts[fields.index("Archive-date") - len(fields)], re.ASCII):
            fault = "no date"
        if fault:
            yield {}, line, fault
            # a record whose length is right is passed over; else the next header is looked for
            known = end >= 0 and body and len(body) == int(parts[-1])
            at = end + 1 + len(body) if known else m.end() if end >= 0 and (m := _HEADER.search(content, end)) else len(content)
            continue
        at = end + 1 + len(body)
        k = len(fields) - 1
        values = [" ".join(parts[:-k]), *parts[-k:]]
        yield dict(zip(fields, values)), body, None


def timestamp(date: str) -> str:
    """WARC's form of 14 digits (12 in some old files)."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, name: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join((url, date, digest, name)))}"


def arc_bytes(rows: Iterator[tuple[int | None, str | None, str | None]], date: str) -> Iterator[bytes]:
    """ARC archives of version 2 of (page_id, url, html), about a megabyte each, or one large page; the page_id is the file name."""
    held, size = [], 0
    for page, url, html in rows:
        payload = (html or "").encode("utf-8", "surrogatepass")
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        url = "".join(c if c > " " else f"%{ord(c):02X}" for c in (url or "urn:page"))
        held += [f"{url} 0.0.0.0 {date} text/html 200 - - 0 {'-' if page is None else page} {len(block)}\n".encode("utf-8", "surrogatepass"), block, b"\n"]
        size += len(block)
        if size >= BLOCK_BYTES:
            yield version_block(2, "pages.arc", date) + b"".join(held)
            held, size = [], 0
    if held:
        yield version_block(2, "pages.arc", date) + b"".join(held)


#: Columns of the records of archives.
RECORD = (("page_id", "long"), ("url", "string"), ("ip", "string"), ("date", "string"), ("kind", "string"), ("result", "string"), ("checksum", "string"), ("location", "string"), ("digest", "string"), ("block_digest", "string"), ("bytes", "long"), ("body_at", "long"), ("block", "binary"), ("id", "string"), ("fault", "string"))
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batches(rows: Iterator[tuple], shape: tuple, weight: int | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, of BATCH_BYTES in the column `weight` and 1,000 rows at most."""
    made = lambda held: pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(zip(*held), shape)], names=[n for n, _ in shape])
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[weight] or b"") if weight is not None else 0
        if len(held) >= 1000 or size >= BATCH_BYTES:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def _record(f: dict[str, str], block: bytes, fault: str | None, blocks: bool) -> tuple:
    if fault:
        return (*[None] * 12, block, None, fault)
    at = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
    at = 0 if at == 3 else at
    payload, name = block[at:], f.get("Filename", "-")
    digest, page = sha1(payload), int(name) if re.fullmatch(r"-?[0-9]{1,18}", name) else None
    said = [v if (v := f.get(k, "-")) != "-" else None for k in ("Result-code", "Checksum", "Location")]
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in f["URL"])
    return (page, url, f["IP-address"], timestamp(f["Archive-date"]), f["Content-type"], *said, digest, sha1(block) if blocks else None, len(payload), at, block if blocks else None, record_id(url, f["Archive-date"], digest, name), None)


def records(archives: DataFrame, blocks: bool = True) -> DataFrame:
    """`RECORD` columns of the records of ARC archives in a binary column `content`.

    A record that can't be read has its fault, its header line as the block, and nulls else. Without `blocks` these and
    their digests are null, for a pass that only needs the payloads' digests. A null archive has no records. The page_id is
    the file name where it is a number. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((_record(*x, blocks) for b in batches for c in b.column(0) for x in parse(c.as_py() or b"")), RECORD, 12)

    return archives.select("content").mapInArrow(run, ", ".join(" ".join(x) for x in RECORD))


def page_records(pages: DataFrame, date: str = "20240101000000", blocks: bool = True) -> DataFrame:
    """`records` of ARC archives made from rows of (page_id, url, html), which pass from one to the other inside of a task.

    Blanks and line ends in addresses are escaped; a null address is urn:page. A null html is empty. Repeated rows are
    records of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, u.as_py(), h.as_py()) for b in batches for p, u, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2)))
        yield from _batches((_record(*x, blocks) for c in arc_bytes(rows, date) for x in parse(c)), RECORD, 12)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, ", ".join(" ".join(x) for x in RECORD))


def revisits(rows: DataFrame) -> DataFrame:
    """(page_id, digest, first_id, first_url, first_date, first_record) of records whose payload an earlier page has (least page_id)."""
    small = stored(rows.where("fault IS NULL").select("page_id", "url", "date", "digest", "bytes", "id"), "digests")
    first = small.where("page_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("page_id", "url", "date", "id")).alias("f"))
    first = first.select("digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"), F.col("f.date").alias("first_date"), F.col("f.id").alias("first_record"))
    again = small.where(F.col("bytes") >= REVISIT_BYTES).select("page_id", "digest").join(first, "digest").where(F.col("page_id") > F.col("first_id"))
    return again.dropDuplicates(["page_id", "digest"])


def _fields(*pairs: tuple[str, str | int | None]) -> bytes:
    return "".join(f"\r\n{k}: {v}" for k, v in pairs if v is not None).encode("utf-8", "surrogatepass")


def _warc(r: dict) -> bytes:
    """A record's bytes, whole. A revisit keeps its HTTP header and leaves its payload out."""
    old = r["first_id"] is not None
    block = r["block"][: r["body_at"]] if old else r["block"]
    http = r["body_at"] > 0
    head = b"WARC/1.0" + _fields(
        ("WARC-Type", "revisit" if old else "response"),
        ("WARC-Record-ID", f"<{r['id']}>"),
        ("WARC-Date", r["date"]),
        ("WARC-Target-URI", r["url"]),
        ("WARC-IP-Address", r["ip"] if r["ip"] not in ("0.0.0.0", "-") else None),
        ("WARC-Block-Digest", f"sha1:{sha1(block) if old else r['block_digest']}"),
        ("WARC-Payload-Digest", f"sha1:{r['digest']}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" if old else None),
        ("WARC-Refers-To", f"<{r['first_record']}>" if old else None),
        ("WARC-Refers-To-Target-URI", r["first_url"] if old else None),
        ("WARC-Refers-To-Date", r["first_date"] if old else None),
        ("X-Refers-To-Page", r["first_id"]),
        ("X-Page", r["page_id"]),
        ("X-Payload-Length", r["bytes"]),
        ("X-Arc-Content-Type", r["kind"]),
        ("X-Arc-Result-Code", r["result"]),
        ("X-Arc-Checksum", r["checksum"]),
        ("X-Arc-Location", r["location"]),
        ("Content-Type", "application/http; msgtype=response" if http else r["kind"]),
        ("Content-Length", len(block)),
    )
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info() -> bytes:
    body = b"software: terracell\r\nformat: WARC File Format 1.0\r\n"
    return b"WARC/1.0" + _fields(("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'terracell')}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields"), ("Content-Length", len(body))) + b"\r\n\r\n" + body + b"\r\n\r\n"


def _members(record: bytes) -> Iterator[bytes]:
    """Gzip members without their last byte, which is zero."""
    for at in range(0, len(record), MEMBER):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        yield (z.compress(record[at : at + MEMBER]) + z.flush())[:-1]


def write(rows: DataFrame, path: str, keys: DataFrame | None = None) -> None:
    """Writes records without a fault as WARC archives under `path`, a file for each task.

    keys: the same records, perhaps without blocks, to find revisits by.
    """
    again = stored(revisits(rows if keys is None else keys), "revisits")
    few = again.count() <= BROADCAST_ROWS
    rows = rows.where("fault IS NULL").join(F.broadcast(again) if few else again, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple[bytes]]:
            for m in _members(_info()):
                yield (m,)
            for b in batches:
                for at in range(0, b.num_rows, 16):
                    for r in b.slice(at, 16).to_pylist():
                        for m in _members(_warc(r)):
                            yield (m,)

        yield from _batches(members(), (("value", "binary"),), 0)

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


class Archive:
    """Reads records one by one from the bytes of an archive, of which it holds inflated no more than the record at hand."""

    def __init__(self, content: bytes) -> None:
        self.content, self.at, self.z, self.data, self.used = memoryview(content), 0, zlib.decompressobj(31), bytearray(), 0

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        part = self.content[self.at : self.at + STEP]
        self.data += self.z.decompress(part)
        self.at += len(part)
        if self.z.eof:
            self.at -= len(self.z.unused_data)
            self.z = zlib.decompressobj(31)
        return True

    def _upto(self, n: int) -> None:
        while len(self.data) < n:
            if not self._more():
                raise ValueError("a record's length is wrong")

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while self.data or self._more():
            if not self.data:
                continue
            while (end := self.data.find(END.encode())) < 0:
                if not self._more():
                    raise ValueError("a record's header does not end")
            first, *lines = self.data[:end].decode("utf-8", "surrogatepass").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError("no record where one should begin")
            h = dict(x.split(": ", 1) for x in lines)
            stop = end + 4 + int(h["Content-Length"])
            self._upto(stop + 4)
            if self.data[stop : stop + 4] != END.encode():
                raise ValueError("a record's length is wrong")
            block = bytes(self.data[end + 4 : stop])
            del self.data[: stop + 4]
            yield h, block


#: Columns of what is read back.
BACK = (("page_id", "long"), ("url", "string"), ("date", "string"), ("record_id", "string"), ("record_type", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("refers_to", "long"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """`BACK` columns of every record but the archives' own; lengths and digests are checked, and a wrong one raises."""

    def rows(content: bytes) -> Iterator[tuple]:
        for h, block in Archive(content):
            if h["WARC-Type"] == "warcinfo":
                continue
            digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
            if sha1(block) != h["WARC-Block-Digest"].removeprefix("sha1:"):
                raise ValueError("a block differs from its digest")
            if h["WARC-Type"] == "response":
                payload = block[block.find(b"\r\n\r\n") + 4 :] if h["Content-Type"].startswith("application/http") else block
                if len(payload) != int(h["X-Payload-Length"]) or sha1(payload) != digest:
                    raise ValueError("a payload differs from its digest")
            page, ref = h.get("X-Page"), h.get("X-Refers-To-Page")
            yield (page and int(page), h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Record-ID"], h["WARC-Type"], int(h["X-Payload-Length"]), digest, ref and int(ref))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((r for b in batches for c in b.column(0) for r in rows(c.as_py())), BACK)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(" ".join(x) for x in BACK))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC archives, converted to WARC archives, and read back."""
    path, pages = scratch(spark, "warc"), table(spark, sf_dir, "pages")
    write(page_records(pages), path, page_records(pages, blocks=False))
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date", "record_id")
