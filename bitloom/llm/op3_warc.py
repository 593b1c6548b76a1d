"""Legacy archives to WARC.

`write_arc` writes pages as ARC files (version 1 and 2 of the format, one version block per file),
`convert` parses their version-specific header lines and declared lengths and synthesises WARC records
(identifier, timestamp, type, digests), `read_warc` reads WARC files back. Every file is written by Spark's
own text writer (bytes pass through it unchanged, gzip outside), so files are committed
task by task, survive lost executors and need only the shared folder.

A file holds one partition of its input, of which there are enough that none has much more than FILE_BYTES; readers parse a file as a stream of
records. Spark's writer compresses a file as one gzip member, not record by record.

Record types: of records with equal payloads of at least `min_revisit` bytes, that with the smallest id is a
response, the others are revisits which name it (its record id, URL and date, and its source id); smaller ones are all responses. A revisit is made
from the archive's header data; whole blocks are shuffled only where a filter of the revisits' record ids lets them pass.

URLs are archived as they are. Blanks and control bytes, which an ARC line cannot hold, are escaped there (a URL `-` too, as that stands for none);
such records carry the URL itself in a field of their HTTP header.

Edge cases: a null payload is an empty one; null ids or URLs are kept as null (a null id is never
referred to, and a record without id is a response); repeated rows give repeated records with record ids of their own, which revisit each other's
id only if the ids differ; rows of one id with different payloads are separate records; other columns are not read, whatever their names;
an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote_from_bytes, unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import arrow_schema, cleaned, ddl, drop, id_filter, load, work_dir, written

#: Least payload of a revisit, in bytes.
MIN_REVISIT = 0
ARC_DATE = "20240101000000"
ARC_IP = "0.0.0.0"
#: Fixed values of the two ARC versions: the fields of a header line.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
READ_BLOCK = 1 << 20
#: Payload bytes of a file, about.
FILE_BYTES = 1 << 30
URL_FIELD = b"X-Source-URL"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _lines(df: DataFrame, path: str) -> None:
    """A binary column `record` as gzip files; the writer ends each record by a line feed."""
    with cleaned(df.sparkSession):
        df.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _field(url) -> bytes:
    """A URL as a field of a header line: as it is, but for blanks, line ends and control bytes; '-' is null."""
    if url is None:
        return b"-"
    if url == "-":
        return b"%2D"
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in url.encode()) or b"%20"


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 bitloom\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    head = [f"filedesc://{name}", ARC_IP, ARC_DATE, "text/plain"] + ([] if version == 1 else ["200", "-", "-", "0", name]) + [str(len(body))]
    return " ".join(head).encode() + b"\n" + body


def arc_record(version: int, url, id_, payload: bytes, name: str) -> bytes:
    field = _field(url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if id_ is None else b"X-Source-Id: %d\r\n" % id_)
    if url is not None and field != url.encode():
        http += URL_FIELD + b": " + quote_from_bytes(url.encode(), safe="/:?&=").encode() + b"\r\n"
    block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    more = b"" if version == 1 else b" 200 %s - 0 %s" % (hashlib.md5(block).hexdigest().encode(), name.encode())
    return b"%s %s %s text/html%s %d\n" % (field, ARC_IP.encode(), ARC_DATE.encode(), more, len(block)) + block


def write_arc(pages: DataFrame, path: str, id_: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Pages as ARC files below path: version 1 for even partitions, 2 for odd ones."""
    with cleaned(pages.sparkSession):
        size = pages.select(F.sum(F.octet_length(F.col(payload).cast("binary")))).first()[0] or 0
    if size // FILE_BYTES >= max(1, pages.sparkSession.sparkContext.defaultParallelism):
        pages = pages.select(id_, url, payload).repartition(size // FILE_BYTES + 1)
    rows = pages.select(F.spark_partition_id().alias("part"), F.col(id_).cast("bigint").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))

    def apply(batches):
        name = None
        for batch in batches:
            out = []
            parts = batch.column("part")
            for i in range(batch.num_rows):
                part = parts[i].as_py()
                version = 1 + part % 2
                if name is None:
                    name = f"part-{part}.arc.gz"
                    out.append(arc_version_block(version, name))
                out.append(arc_record(version, batch.column("url")[i].as_py(), batch.column("id")[i].as_py(), batch.column("payload")[i].as_py(), name))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _lines(rows.mapInArrow(apply, "record binary"), path)


class Stream:
    """Bytes of a gzip file in memory, inflated piece by piece."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.z, self.buffer, self.start = memoryview(packed), 0, zlib.decompressobj(31), bytearray(), 0

    def _more(self) -> bool:
        if self.z.eof:  # the next member, if there is one
            rest = self.z.unused_data
            if not rest and self.at >= len(self.packed):
                return False
            self.z = zlib.decompressobj(31)
            self.buffer += self.z.decompress(rest)
            return True
        if self.at >= len(self.packed):
            return False
        self.buffer += self.z.decompress(self.packed[self.at : self.at + READ_BLOCK])
        self.at += READ_BLOCK
        return True

    def line(self):
        """The next line without its end; None at the end."""
        looked = self.start
        while (end := self.buffer.find(b"\n", looked)) < 0:
            looked = len(self.buffer)
            if not self._more():
                if self.start == len(self.buffer):
                    return None
                end = len(self.buffer)
                break
        line = bytes(self.buffer[self.start : end])
        self._drop(end + 1)
        return line

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.start < n:
            if not self._more():
                raise ValueError(f"a record declares {n} bytes, {len(self.buffer) - self.start} are there")
        data = bytes(self.buffer[self.start : self.start + n])
        self._drop(self.start + n)
        return data

    def _drop(self, to: int) -> None:
        self.start = to
        if self.start > 4 * READ_BLOCK:
            del self.buffer[: self.start]
            self.start = 0


def _http(block: bytes) -> tuple[bytes, bytes, dict]:
    head, gap, payload = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower()] = v.strip()
    return head + gap, payload, fields


def parse_arc(packed: bytes):
    """(url, ip, date, block) of each record, by the fields that the file's own version block names; that block is as long as its line declares."""
    s, fields = Stream(packed), None
    while (line := s.line()) is not None:
        if not line.strip():
            continue
        parts = line.split(b" ")
        if parts[0].startswith(b"filedesc://"):
            body = s.take(int(parts[-1])).split(b"\n")
            if body[0].split(b" ")[0] not in (b"1", b"2") or len(body) < 2:
                raise ValueError(f"not an ARC version block: {body[0][:80]!r}")
            fields = body[1].strip().decode().split(" ")
            continue
        if fields is None or len(parts) != len(fields):
            raise ValueError(f"not an ARC header line: {line[:80]!r}")
        x = dict(zip(fields, parts))
        url = None if x["URL"] == b"-" else x["URL"].decode()
        yield url, x["IP-address"].decode(), x["Archive-date"].decode(), s.take(int(x[fields[-1]]))


def _stamp(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def record_id(file: str, number: int) -> str:
    """A record's identifier, by its place in the archive that it comes from."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file} {number}')}"


def warc_info(name: str) -> bytes:
    body = b"software: bitloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{record_id(name, -1)}>", f"WARC-Date: {_stamp(ARC_DATE)}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r"


def warc_record(record: str, url, ip, date, head: bytes, payload: bytes, payload_digest: str, first=None) -> bytes:
    """A response or, with first (id, record, url, date of the response), a revisit; without the line feed that the writer adds."""
    kept = head if first else head + payload
    lines = ["WARC/1.1", "WARC-Type: " + ("revisit" if first else "response"), f"WARC-Record-ID: <{record}>", f"WARC-Date: {_stamp(date)}", f"WARC-IP-Address: {ip}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest_of(kept)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url).decode()}")
    if first:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{first['record']}>", f"WARC-Refers-To-Date: {_stamp(first['date'])}", f"X-Refers-To-Source: {first['id']}"]
        lines += [] if first["url"] is None else [f"WARC-Refers-To-Target-URI: {_field(first['url']).decode()}"]
    lines.append(f"Content-Length: {len(kept)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + kept + b"\r\n\r"  # the writer's line feed is the last byte


def parse_warc(packed: bytes):
    """(headers, block) of each record."""
    s = Stream(packed)
    while (line := s.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC version line: {line[:80]!r}")
        fields = {}
        while (line := s.line().rstrip(b"\r")) != b"":
            k, _, v = line.partition(b":")
            fields[k.strip().lower()] = v.strip()
        yield fields, s.take(int(fields[b"content-length"]))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def _own_url(fields: dict, url):
    """The URL that a record was made for: its header's, if that has one."""
    own = fields.get(URL_FIELD.lower())
    return url if own is None else unquote_to_bytes(own).decode()


_ARC = arrow_schema(id="long", record="string", url="string", ip="string", date="string", digest="string", size="long", head="binary", payload="binary")


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the ARC files below path, payloads or only their digests."""

    def apply(batches):
        for batch in batches:
            for name, packed in zip(batch.column("path"), batch.column("content")):
                rows, held, file = [], 0, name.as_py().rsplit("/", 1)[-1]
                for number, (url, ip, date, block) in enumerate(parse_arc(packed.as_py())):
                    head, payload, fields = _http(block)
                    own = fields.get(b"x-source-id")
                    rows.append((None if own is None else int(own), record_id(file, number), _own_url(fields, url), ip, date, digest_of(payload), len(payload), head, payload if payloads else None))
                    held += len(block) * payloads + 500
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARC)], schema=_ARC)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARC)], schema=_ARC)

    out = _files(spark, path).mapInArrow(apply, ddl(_ARC))
    return out if payloads else out.drop("payload")


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT) -> None:
    """The ARC files below arc_path as WARC files below warc_path."""
    seen = written(read_arc(spark, arc_path, payloads=False))
    known = seen.where(F.col("id").isNotNull() & (F.col("size") >= min_revisit))
    first = known.groupBy("digest", "size").agg(F.min(F.struct("id", "record", "url", "date")).alias("first"), F.max("id").alias("last")).where("last > first.id")
    again = written(known.join(first.drop("last"), ["digest", "size"]).where("id > first.id"))
    columns = ["record", "url", "ip", "date", "head", "digest"]
    whole = read_arc(spark, arc_path).select(*columns, "payload")
    maybe = id_filter(again, "record")(F.col("record"))
    rest = whole.where(maybe).join(again.select("record"), "record", "left_anti").select(whole.columns)
    responses = whole.where(~maybe).unionByName(rest).withColumn("first", F.lit(None).cast(first.schema["first"].dataType))
    rows = responses.unionByName(again.select(*columns, F.lit(b"").alias("payload"), "first"))

    def apply(batches):
        info = None
        for batch in batches:
            c = [batch.column(n) for n in (*columns, "payload", "first")]
            out = []
            for i in range(batch.num_rows):
                record, url, ip, date, head, digest, payload, one = (x[i].as_py() for x in c)
                if info is None:
                    info = warc_info(record)
                    out.append(info)
                out.append(warc_record(record, url, ip, date, head, payload, digest, one))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _lines(rows.mapInArrow(apply, "record binary"), warc_path)
    drop(seen, again)


_WARC = arrow_schema(source_id="long", url="string", record_id="string", date="string", record_type="string", payload_bytes="long", payload_digest="string", refers_to="long", payload="binary")


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record of the WARC files below path. Digests of responses are checked against their payloads."""

    def row(fields: dict, block: bytes) -> tuple:
        _, payload, http = _http(block)
        digest, kind = fields[b"warc-payload-digest"].decode().partition(":")[2], fields[b"warc-type"].decode()
        if kind == "response" and digest_of(payload) != digest:
            raise ValueError("a payload does not have the digest that its record declares")
        own, refers = http.get(b"x-source-id"), fields.get(b"x-refers-to-source")
        uri = fields.get(b"warc-target-uri")
        return (None if own is None else int(own), _own_url(http, None if uri is None else uri.decode()), fields[b"warc-record-id"].decode().strip("<>"), fields[b"warc-date"].decode(), kind, int(http[b"content-length"]), digest, None if refers is None else int(refers), payload if payloads else None)

    def apply(batches):
        for batch in batches:
            for packed in batch.column("content"):
                rows, held = [], 0
                for fields, block in parse_warc(packed.as_py()):
                    if fields[b"warc-type"] == b"warcinfo":
                        continue
                    rows.append(row(fields, block))
                    held += 400 + len(block) * payloads
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WARC)], schema=_WARC)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WARC)], schema=_WARC)

    out = _files(spark, path).mapInArrow(apply, ddl(_WARC))
    return out if payloads else out.drop("payload")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark)
    write_arc(load(spark, sf_dir, "pages"), f"{base}/arc")
    convert(spark, f"{base}/arc", f"{base}/warc")
    return read_warc(spark, f"{base}/warc").select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base32: the digest is spelled from the SHA-1's 160 bits, five at a time.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, hex,
  list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(instr('0123456789abcdef', hex[i + 1]) - 1), 4, '0')), 'string_agg', '') AS bits FROM d),
e AS (SELECT page_id, payload_bytes, hex,
  list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT]), 'string_agg', '') AS payload_digest,
  min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM e
"""
