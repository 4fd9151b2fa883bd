"""WARC archives as a PySpark data source.

Writing: each record is a gzip member of its own whose extra field 'sl' holds
its compressed and plain lengths; a job's files appear to readers with its
manifest.  Reading: files are planned into partitions by size; predicates on
record type and other headers are pushed down and tested on the header block,
which is inflated first, and the rest of an unwanted record is skipped by its
length.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from . import common

READ_SCHEMA = "record_id string, type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, file string, position long"
HEADER_COLUMNS = ["record_id", "type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes"]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = {"record_id": "warc-record-id", "type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_CONTROL = re.compile("[\x00-\x20\x7f<>]")


def _clean(value: str) -> str:
    """Control characters, spaces and angle brackets would break a header."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id: str, kind: str, uri: str | None, date: str, refers_to: str | None, digest: bytes, n_payload: int, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_payload}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_clean(refers_to or '')}>"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(plain: bytes, level: int) -> bytes:
    """A gzip member with its lengths in the extra field 'sl'."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(plain) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.roll = int(options.get("roll_bytes", 128 << 20))
        self.level = int(options.get("level", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = common.arrow_fs(self.path)
        fs.create_dir(base)
        context = TaskContext.get()
        stem = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done, out, size, count = Written(), None, 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                done.files.append((name, size, count))

        for batch in iterator:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for k in range(batch.num_rows):
                if out is None or size >= self.roll:
                    close()
                    name = f"part-{stem}-{len(done.files):04d}.warc.gz"
                    out, size, count = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                data = member(record(*(c[k].as_py() for c in columns)), self.level)
                out.write(data)
                size, count = size + len(data), count + 1
        close()
        return done

    def commit(self, messages) -> None:
        """The manifest makes the files of the attempts that won visible."""
        fs, base = common.arrow_fs(self.path)
        fs.create_dir(base)
        name = f"{base}/_manifest-{uuid.uuid4().hex}"
        with fs.open_output_stream(name + ".tmp") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())
        fs.move(name + ".tmp", name + ".json")

    def abort(self, messages) -> None:
        fs, base = common.arrow_fs(self.path)
        for m in messages:
            for name, _, _ in m.files if m is not None else ():
                fs.delete_file(f"{base}/{name}")


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    """Options: path; payload=false leaves payloads out, so that records are
    skipped after their headers; verify=true checks payloads by digest."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.split = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_COLUMNS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADER_COLUMNS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADER_COLUMNS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif column in HEADER_COLUMNS and isinstance(f, IsNotNull):
                self.tests.append((column, "there", None))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Files of the manifests, or all archives where there are none; small
        ones share a partition, and a large one has its own."""
        import pyarrow.fs as pafs

        fs, base = common.arrow_fs(self.path)
        infos = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        manifests = [i.path for i in infos if i.base_name.startswith("_manifest-") and i.base_name.endswith(".json")]
        if manifests:
            files = []
            for m in sorted(manifests):
                with fs.open_input_file(m) as f:
                    files += [(name, size) for name, size, _ in json.loads(f.read())]
        else:
            files = [(i.base_name, i.size) for i in infos if i.base_name.endswith((".warc.gz", ".warc"))]
        parts: list[Files] = []
        held = 0
        for name, size in sorted(files):
            if not parts or held + size > self.split:
                parts.append(Files([]))
                held = 0
            parts[-1].files.append((name, size))
            held += size
        return parts or [Files([])]

    def wanted(self, row: dict) -> bool:
        for column, how, value in self.tests:
            got = row[column]
            if got is None or (how == "in" and got not in value) or (how == "starts" and not got.startswith(value)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, base = common.arrow_fs(self.path)
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in READ_SCHEMA.split(", ")])
        rows: list[dict] = []
        held = 0
        for name, _ in partition.files:
            with fs.open_input_file(f"{base}/{name}") as f:
                for row in records(f, name.endswith(".gz"), self.wanted, self.payload or self.verify):
                    row["file"] = name
                    if self.verify and row["type"] == "response":
                        got = base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode()
                        if (got, len(row["payload"])) != (row["payload_digest"], row["payload_bytes"]):
                            raise ValueError(f"{name} at {row['position']}: payload and digest differ")
                    if not self.payload:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n in names}, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n in names}, schema=schema)


def headers_of(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        out[key.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _row(block: bytes, position: int) -> tuple[dict, int]:
    h = headers_of(block)
    row: dict = {c: h.get(n) for c, n in _FIELDS.items()}
    for c in ("record_id", "refers_to"):
        if row[c] is not None:
            row[c] = row[c].strip("<>")
    if row["payload_digest"] is not None:
        row["payload_digest"] = row["payload_digest"].partition(":")[2] or row["payload_digest"]
    row |= {"payload_bytes": None, "payload": None, "position": position}
    return row, int(h.get("content-length", 0))


def _http(row: dict, body: bytes, length: int) -> None:
    """Payload and its length from an HTTP block; other blocks are payload.
    The body may be a block's first part, its headers at least; length is the
    whole block's."""
    if body.startswith(b"HTTP/"):
        head, blank, rest = body.partition(b"\r\n\r\n")
        n = headers_of(head).get("content-length")
        row["payload_bytes"] = int(n) if n and n.isdigit() else length - len(head) - len(blank)
    else:
        rest, row["payload_bytes"] = body, length
    row["payload"] = rest


class Member:
    """The plain bytes of a gzip member, inflated as far as they are asked for."""

    def __init__(self, f, position: int):
        self.f, self.position = f, position
        f.seek(position)
        first = f.read(1 << 13)
        self.empty = not first
        self.inflate = zlib.decompressobj(31)
        self.held = bytearray(self.inflate.decompress(first))
        self.end = self.n_plain = None  # where the member tells its lengths
        if len(first) >= 24 and first[3] & 4 and first[12:14] == b"sl":
            total, self.n_plain = struct.unpack("<II", first[16:24])
            self.end = position + total

    def fill(self, n: int) -> bool:
        """Hold n bytes, if there are so many."""
        while len(self.held) < n and not self.inflate.eof:
            more = self.f.read(1 << 16)
            if not more:
                raise ValueError(f"a record is cut off at {self.position}")
            self.held += self.inflate.decompress(more)
        return len(self.held) >= n

    def until_blank(self, most: int | None = None) -> int:
        """Where the first blank line within the first bytes is, or -1."""
        seen = 0
        while (at := self.held.find(b"\r\n\r\n", max(0, seen - 3), most)) < 0:
            seen = len(self.held)
            if (most is not None and seen >= most) or not self.fill(seen + 1):
                return -1
        return at

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError(f"a record is cut off at {self.position}")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        while n > 0:
            step = min(n, 1 << 18)
            self.take(step)
            n -= step

    def after(self) -> int:
        """The position after the member."""
        if self.end is not None:
            return self.end
        while not self.inflate.eof:
            self.held.clear()
            self.fill(1)
        return self.f.tell() - len(self.inflate.unused_data)


def records(f, gz: bool, wanted, payload: bool) -> Iterator[dict]:
    """The wanted records of a file, with the position of the record or of its
    gzip member, which may hold several.  Of others only the headers are
    inflated, where the member tells its length."""
    position = 0
    if not gz:
        while head := _until_blank(f):
            row, n = _row(head, position)
            start = f.tell()
            body = f.read(n if payload else min(n, 4096))
            while body.startswith(b"HTTP/") and b"\r\n\r\n" not in body and len(body) < n:
                more = f.read(min(n - len(body), 1 << 16))
                if not more:
                    raise ValueError(f"a record is cut off at {position}")
                body += more
            _http(row, body, n)
            if wanted(row):
                yield row
            f.seek(start + n + 4)
            position = start + n + 4
        return
    while not (member := Member(f, position)).empty:
        while member.fill(5):  # more than the end of the record before
            at = member.until_blank()
            if at < 0:
                raise ValueError(f"no record at {position}")
            row, n = _row(member.take(at + 4)[:-4], position)
            member.fill(min(n, 5))
            if member.held.startswith(b"HTTP/"):
                member.until_blank(n)
            _http(row, bytes(member.held[:n]), n)
            want = wanted(row)
            only = member.end is not None and member.n_plain == (at + 4 + n + 4) & 0xFFFFFFFF
            if only and not (want and payload):
                if want:
                    yield row
                break
            if want and payload:
                _http(row, member.take(n), n)
            else:
                member.skip(n)
            if member.fill(4):
                member.take(4)
            if want:
                yield row
        position = member.after()


def _until_blank(f) -> bytes:
    out = b""
    while b"\r\n\r\n" not in out:
        more = f.read(4096)
        if not more:
            return b""
        out += more
    head, _, rest = out.partition(b"\r\n\r\n")
    f.seek(f.tell() - len(rest))
    return head


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def read_warc(spark, path: str, **options) -> DataFrame:
    """The records of the archives in a folder, with READ_SCHEMA's columns;
    options are those of WarcReader.

    Headers that a record lacks are null; an empty payload is empty, of any
    length whole.  Repeated records are rows each, and a folder without
    archives gives none.  Spark pushes filters to Python sources only where
    spark.sql.python.filterPushdown.enabled is true, which is switched on for
    the session unless its owner has set it.
    """
    spark.dataSource.register(WarcDataSource)
    if not _is_set(spark, "spark.sql.python.filterPushdown.enabled"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(path=path, **options).load()


def _is_set(spark, key: str) -> bool:
    """Whether the session or its start has given a value, beside the default."""
    return bool(spark._jsparkSession.sessionState().conf().contains(key))


#: Groups of equal payloads up to this count are broadcast to the pages.
BROADCAST_GROUPS = 200_000


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """A record per row of pages (page_id, url, html).

    Of pages whose payloads are equal and of at least least_bytes, that with
    the largest page_id is the response and the others are revisits of it;
    rows that repeat the largest id are responses each.  A null html is an
    empty payload, a null url a record without a target, a null page_id a
    record named so, which is never referred to unless all its group is.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    body = common.text_bytes("html")
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("sha1"), F.length(body).cast("long").alias("n"))
    groups = rows.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("kept"), F.count("*").alias("members")).where("members > 1").select("sha1", "kept")
    groups = common.materialize(groups, "payload-groups")
    small = groups.count() <= BROADCAST_GROUPS
    if small:
        groups = F.broadcast(groups)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    revisit = F.expr("kept is not null and not (page_id <=> kept)")
    joined = rows.join(groups, "sha1", "left") if small else _join_hot(rows, groups)
    out = joined.select(
        name("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("type"), "url", F.lit(date).alias("date"), F.when(revisit, name("kept")).alias("refers_to"), F.unhex("sha1").alias("digest"), "n", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").options(path=path).save()


def _join_hot(rows: DataFrame, groups: DataFrame, salts: int = 64) -> DataFrame:
    """A page's payload may be a third of all: rows are dealt to so many tasks
    for each payload, and each group's short row goes to all of them."""
    salted = rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(page_id, url), {salts}) as int)"))
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, ["sha1", "salt"], "left").drop("salt")


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write pages to an archive and read it back, payloads checked: page_id,
    payload_bytes, payload_digest, record_type, refers_to.

    Null ids, urls and payloads, and repeated rows, are as in write_pages;
    payloads of any length are written whole.  An empty table gives no rows;
    other columns are ignored.
    """
    write_pages(pages, path, least_bytes)
    number = lambda c: F.expr(f"try_cast(substr({c}, 10) as bigint)")
    return read_warc(pages.sparkSession, path, payload="false", verify="true").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
