"""WARC archives: a writer of record-wise compressed files and a Python data source that reads them.

Each record is a gzip member whose extra field `sl` holds its compressed and plain length, so a reader gets from record
to record, and inflates the headers of each, without touching payloads it doesn't want. Archives without that field,
in one or many gzip members or not compressed, are read from front to end; what isn't wanted is inflated and let go.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from peakforge.llm.store import new_path, written

SCHEMA = "record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_HEAD = struct.Struct("<4BI2B")  # gzip: magic, method, flags, time, extra flags, system
_EXTRA = struct.Struct("<H2sHII")  # extra length, `sl`, its length, compressed length of the member, plain length
#: What the planner puts into one partition.
PART_BYTES = 64 << 20


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five bytes, ten hex digits, become eight digits of base 32."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def member(record: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = _HEAD.size + _EXTRA.size + len(body) + 8
    head = _HEAD.pack(0x1F, 0x8B, 8, 4, 0, 0, 255) + _EXTRA.pack(12, b"sl", 8, size, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def response_id(digest: str, size: int, page_id: int | None) -> uuid.UUID:
    """Record ID of the one response of a payload, which its revisits name."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{digest} {size} {page_id}")


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes, own: bool = True) -> bytes:
    """One record; own: it is the only response of its payload. URLs stay as they are unless they hold line ends, which a header can't."""
    clean = lambda s: s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    name = response_id(digest, size, page_id) if own and kind == "response" else uuid.uuid4()
    block = HTTP + payload if kind == "response" else HTTP
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {size}"]
    if url is not None and ("\r" in url or "\n" in url):
        head += [f"WARC-Target-URI: {clean(url)}", "X-Escaped-URI: yes"]
    elif url is not None:
        head += [f"WARC-Target-URI: {url}"]
    head += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{response_id(digest, size, refers_to)}>"]
        head += [] if refers_to is None else [f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, least: int) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for i in range(b.num_rows):
                if out is None:
                    system, path = fs.FileSystem.from_uri(folder)
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                kind, page, url, digest, size, refers, html = (c[i].as_py() for c in b.columns)
                data = member(record(kind, page, url, digest, size, refers, (html or "").encode(), size >= least))
                out.write(data)
                n += len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "bytes"])

    return f


def write_warc(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files below folder; returns their manifest (folder, name, bytes).

    Each row gives a record with the html in UTF-8 as payload (null: empty). Of records with equal payloads of at least
    `least` bytes, that with the largest page_id (null smallest; then the largest url) is a response, all others are
    revisits without a payload that refer to its page_id; of repeated rows one is the response. Smaller payloads are
    all responses. Revisits name their response's record ID (WARC-Refers-To). A null url or page_id has no header. An empty table gives no files. Tasks that are run again leave
    files that the manifest does not name. Roles are decided on digests (SHA-1, another hash and the size) alone; a payload is shuffled once.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), payload_digest(html).alias("digest"), F.octet_length(html).cast("long").alias("size"), F.xxhash64(html).alias("x"))
    rows = p.groupBy("digest", "x", "size", "page_id", "url").agg(F.count("*").alias("copies"))
    order = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("k"), F.coalesce("url", F.lit("")).alias("u"), F.col("url").isNotNull().alias("n"))
    rows = rows.withColumn("order", order)
    same = ["digest", "x", "size"]  # colliding pairs of SHA-1 are public
    top = rows.groupBy(*same).agg(F.max(F.struct("order", "page_id")).alias("top"))
    one = rows.join(top, same).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    response = (F.col("size") < least) | ((F.col("order") == F.col("top.order")) & (F.col("copy") == 1))
    one = one.select(F.when(response, "response").otherwise("revisit").alias("kind"), "page_id", "url", *same, F.when(~response, F.col("top.page_id")).alias("refers"))
    # written before it is read twice: each record must have the same role in both branches
    one = written(one, "records")
    payloads = p.select(*same, "html").dropDuplicates(same)
    full = one.where("kind = 'response'").join(payloads, same).select("kind", "page_id", "url", "digest", "size", "refers", "html")
    bare = one.where("kind = 'revisit'").select("kind", "page_id", "url", "digest", "size", "refers", F.lit(None).cast("string").alias("html"))
    manifest = full.unionByName(bare).mapInArrow(_write(folder, least), "name string, bytes long")
    return written(manifest.withColumn("folder", F.lit(folder)), "manifest")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    """Plans files into partitions, applies predicates on headers before a payload is inflated."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.files = json.loads(options["files"])
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = ".".join(f.attribute) if isinstance(f, (EqualTo, In, StringStartsWith)) else ""
            if name not in ("record_type", "target_uri", "payload_digest", "page_id", "payload_bytes", "refers_to"):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            else:
                self.tests.append((name, "starts", f.value))

    def partitions(self) -> list[InputPartition]:
        """Files from the largest to the smallest, filled up to PART_BYTES."""
        parts: list[list[str]] = []
        room = 0
        for name, size in sorted(self.files, key=lambda x: (-x[1], x[0])):
            if not parts or size > room:
                parts.append([])
                room = PART_BYTES
            parts[-1].append(name)
            room -= size
        return [_Files(x) for x in parts] or [_Files([])]

    def _wanted(self, row: dict) -> bool:
        for name, how, value in self.tests:
            x = row[name]
            if x is None or (x not in value if how == "in" else not x.startswith(value)):
                return False
        return True

    def read(self, partition: _Files):
        if not partition.paths:
            return
        system, folder = fs.FileSystem.from_uri(self.folder)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        batch: list[dict] = []
        held = 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array([r[c] for r in batch], t) for c, t in zip(names, types, strict=True)], names=names)
        for name in partition.paths:
            with system.open_input_file(f"{folder}/{name}") as f:
                for row in self._records(f):
                    batch.append(row)
                    held += len(row["payload"] or b"")
                    if len(batch) >= 2000 or held > 4 << 20:
                        yield make()
                        batch, held = [], 0
        if batch:
            yield make()

    def _records(self, f: pa.NativeFile) -> Iterator[dict]:
        size, at = f.size(), 0
        while at < size:
            f.seek(at)
            start = f.read(4096)
            begin = _HEAD.size + _EXTRA.size
            if len(start) < begin or start[:4] != b"\x1f\x8b\x08\x04" or start[_HEAD.size + 2 : _HEAD.size + 4] != b"sl":
                f.seek(at)
                yield from self._rest(f, start[:2] == b"\x1f\x8b")
                return
            *_, length, _ = _EXTRA.unpack_from(start, _HEAD.size)
            z = zlib.decompressobj(-15)
            head = z.decompress(start[begin:length], 2048)
            while b"\r\n\r\n" not in head:  # long headers
                start += f.read(4096)
                z = zlib.decompressobj(-15)
                head = z.decompress(start[begin:length])
            text, _, rest = head.partition(b"\r\n\r\n")
            row = self._headers(text.decode(errors="replace"))
            if self._wanted(row):
                if self.payload and row["record_type"] != "revisit":
                    more = z.unconsumed_tail + f.read(max(0, length - len(start)))
                    self._fill(row, (rest + z.decompress(more))[: row["length"]])
                yield row
            at += length

    def _rest(self, f: pa.NativeFile, packed: bool) -> Iterator[dict]:
        data = _Plain(f, packed)
        while (head := data.until(b"\r\n\r\n")) is not None:
            if not head.strip():  # what ends a record
                continue
            row = self._headers(head.decode(errors="replace").lstrip("\r\n"))
            want = self._wanted(row)
            keep = want and self.payload and row["record_type"] != "revisit"
            block = data.take(row["length"] or 0, keep)
            if keep:
                self._fill(row, block)
            if want:
                yield row

    @staticmethod
    def _fill(row: dict, block: bytes) -> None:
        row["payload"] = block.partition(b"\r\n\r\n")[2] if row["record_type"] in ("response", "request") else block

    @staticmethod
    def _headers(text: str) -> dict:
        h = {k.lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in text.split("\r\n")[1:])}
        number = lambda k: int(h[k]) if k in h else None
        url, digest = h.get("warc-target-uri"), h.get("warc-payload-digest")
        if url and "x-escaped-uri" in h:
            url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        elif url and "x-payload-bytes" not in h:
            url = url.strip().removeprefix("<").removesuffix(">")  # as WARC 1.0 has it
        return {
            "record_type": h.get("warc-type", "").strip(), "page_id": number("x-page-id"), "payload_digest": digest and digest.strip().removeprefix("sha1:"), "payload_bytes": number("x-payload-bytes"),
            "target_uri": url, "refers_to": number("x-refers-to-page-id"), "payload": None, "length": number("content-length"),
        }


class _Plain:
    """What a file holds from where it stands on, its gzip members inflated, 1 MB at a time."""

    def __init__(self, f: pa.NativeFile, packed: bool):
        self.f, self.packed, self.z = f, packed, None
        self.ahead, self.have, self.at = b"", b"", 0

    def _more(self) -> bool:
        out = b""
        while not out:
            if not self.ahead:
                self.ahead = self.f.read(1 << 16)
                if not self.ahead:
                    return False
            if not self.packed:
                out, self.ahead = self.ahead, b""
                continue
            if self.z is None:
                self.ahead = self.ahead.lstrip(b"\0")  # padding between members
                if not self.ahead:
                    continue
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(self.ahead, 1 << 20)
            self.ahead = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if self.z.eof:
                self.z = None
        self.have, self.at = self.have[self.at :] + out, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (i := self.have.find(mark, self.at)) < 0:
            if not self._more():
                return None
        head = self.have[self.at : i]
        self.at = i + len(mark)
        return head

    def take(self, n: int, keep: bool) -> bytes:
        parts = []
        while n > 0 and (self.at < len(self.have) or self._more()):
            piece = self.have[self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            if keep:
                parts.append(piece)
        return b"".join(parts)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "peakforge_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the files that a manifest (folder, name, bytes) names. Filters on header columns reach the reader.

    Own archives are read record by record, others in order, with or without gzip. Payloads are what follows the HTTP
    headers of responses and requests (as archived: no transfer or content encoding is undone), the whole block of
    other types, and null for revisits; header columns that a record lacks are null. Of a last record that is cut off
    the payload is what is there. Bytes that are no gzip after a member raise an error.
    """
    spark: SparkSession = manifest.sparkSession
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    files = manifest.collect()
    folder = files[0]["folder"] if files else "none"
    names = json.dumps([(r["name"], r["bytes"]) for r in files])
    return spark.read.format("peakforge_warc").option("files", names).option("payload", str(payload).lower()).load(folder)


def archives(spark: SparkSession, folder: str, glob: str = "*.warc*") -> DataFrame:
    """A manifest of the archives in a folder, whoever wrote them; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.lit(folder).alias("folder"))


def record_digests(manifest: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest (computed from the payload where there is one), record_type, refers_to."""
    r = read_warc(manifest)
    own = F.col("payload").isNotNull()
    digest = F.when(own, payload_digest(F.col("payload"))).otherwise(F.col("payload_digest"))
    size = F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return r.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
