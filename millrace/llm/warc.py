"""WARC archives as a PySpark Python data source (operator 4).

``spark.read.format("millrace_warc").load(folder)`` plans partitions from the archives' files, takes pushed
predicates on the record type and on header columns, parses each record's header block first and skips the
payload of records that no predicate lets through, or whose payload is not asked for, without decoding it.
``df.write.format("millrace_warc")`` writes archives of about `file_bytes` (256 MB) at most, so that reading them
parts well; each commit adds a manifest, and only files that a manifest lists belong to the archive, so retried and
speculative tasks leave no doubled records.  Appending keeps what is there, overwriting replaces it.

Files are reached through pyarrow's file systems (file, hdfs, s3, gs by URI).  Every record written here is a gzip
member of its own.  Its header carries the member's length in an extra field, so a skipped record's payload is not
even inflated.  In folders without a manifest all `.warc.gz` and `.warc` files are read: members without that field
may hold any number of records and are inflated in small pieces, plain files are skipped over by seeking.  Such a
file is read by one task, whatever its size: gzip has no other place to begin.

Identical payloads.  ``with_revisits`` names, by SHA-1 of the payload, the smallest id that holds each payload of
at least `least` bytes as its response, the others as revisits that refer to it.  Grouping pre-aggregates, so a
payload shared by a third of all rows is one row per task, and adaptive execution splits the join's hot key.

Defined cases: a file that ends inside a record, or has no gzip member where one must begin, is an error that names
it; null html is the empty payload; null url is an empty target.  Null ids sort after all others.
Rows that repeat the smallest id of a payload are all responses.  An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from millrace.llm.common import written

SCHEMA = "page_id long, record_type string, target_uri string, record_id string, refers_to long, payload_digest string, payload_bytes long, payload binary, file string, offset long"
MANIFEST = "manifest-"
#: The columns whose predicates are decided from the header block.
HEADER_COLUMNS = ("record_type", "target_uri", "record_id", "payload_digest", "page_id")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:millrace:page:{'null' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    last = (record_id or "").rstrip(">").rpartition(":")[2]
    return int(last) if last.lstrip("-").isdigit() else None


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page_id),
        "WARC-Target-URI": _clean(url or ""),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if revisit:
        head |= {"WARC-Refers-To": _record_id(refers_to), "WARC-Profile": _REVISIT}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field `sl` holds its whole length and the data's."""
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    whole = 10 + 2 + 4 + 16 + len(packed) + 8
    extra = b"sl" + struct.pack("<HQQ", 16, whole, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Stream:
    """Reads a file of gzip members, or a plain one as a single member, in pieces, past what nobody wants."""

    PIECE = 1 << 14

    def __init__(self, handle, size: int, packed: bool):
        self.handle, self.size, self.packed, self.at = handle, size, packed, 0

    def open(self) -> bool:
        """Begins the member at self.at; False at the end of the file."""
        if self.at >= self.size:
            return False
        self.handle.seek(self.at)
        raw = self.handle.read(self.PIECE)
        self.read, self.length = len(raw), None
        if self.packed:
            if raw[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at byte {self.at}")
            if raw[3] & 4 and raw[12:16] == b"sl\x10\0":
                self.length = struct.unpack_from("<Q", raw, 16)[0]
            self.z = zlib.decompressobj(31)
            raw = self.z.decompress(raw)
        self.buffer = bytearray(raw)
        return True

    @property
    def place(self) -> int:
        """Where the next record begins in a plain file, its member in others."""
        return self.at if self.packed else self.at + self.read - len(self.buffer)

    def _more(self) -> bool:
        if self.packed and self.z.eof:
            return False
        raw = self.handle.read(self.PIECE * 16)
        if not raw:
            if self.packed:
                raise ValueError("the archive ends inside a gzip member")
            return False
        self.read += len(raw)
        self.buffer += self.z.decompress(raw) if self.packed else raw
        return True

    def another(self) -> bool:
        """Whether the member holds a further record; passes the line ends between two."""
        while True:
            n = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
            del self.buffer[:n]
            if self.buffer:
                return True
            if not self._more():
                return False

    def until(self, mark: bytes, most: int | None = None) -> bytes | None:
        """What is before the mark, which is passed; None, and nothing passed, if it does not end within `most` bytes."""
        while (i := self.buffer.find(mark)) < 0 and (most is None or len(self.buffer) < most):
            if not self._more():
                break
        if i < 0 or (most is not None and i + len(mark) > most):
            if most is None:
                raise ValueError("a record's header has no end")
            return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def skip(self, n: int) -> None:
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer.clear()
            if not self.packed:
                if self.at + self.read + n > self.size:
                    raise ValueError("the archive ends inside a record")
                self.handle.seek(self.at + self.read + n)
                self.read += n
                n = 0
            elif not self._more():
                raise ValueError("the archive ends inside a record")
        del self.buffer[:n]

    def close(self) -> None:
        """Moves to the next member."""
        if self.length is None:
            self.length = self.read - len(self.z.unused_data) if self.packed else self.size
        self.at += self.length


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _manifests(at, root: str) -> list[tuple[str, int]] | None:
    """The files that the folder's manifests list; None if there is no manifest."""
    from pyarrow import fs

    if at.get_file_info(root).type != fs.FileType.Directory:
        return None
    found = sorted(x.path for x in at.get_file_info(fs.FileSelector(root)) if x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"))
    files = []
    for path in found:
        with at.open_input_stream(path) as f:
            files += [(name, size) for name, size in json.loads(f.read())]
    return sorted(files) if found else None


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path = schema, options["path"]
        self.wanted: dict[str, set] = {}
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.each = int(options.get("partition_bytes", 16 << 20))

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_COLUMNS and isinstance(f, (EqualTo, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[name] = self.wanted.get(name, values) & values
            elif name in ("record_type", "record_id", "payload_digest", "target_uri") and isinstance(f, IsNotNull):
                continue  # these columns are never null
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        at, root = file_system(self.path)
        listed = _manifests(at, root)
        if listed is not None:
            files = [(f"{root}/{name}", size) for name, size in listed]
        else:
            found = at.get_file_info(fs.FileSelector(root, recursive=True)) if at.get_file_info(root).type == fs.FileType.Directory else [at.get_file_info(root)]
            files = sorted((x.path, x.size) for x in found if x.path.endswith((".warc.gz", ".warc")))
        parts, held = [[]], 0
        for name, size in files:
            if held and held + size > self.each:
                parts.append([])
                held = 0
            parts[-1].append((name, size))
            held += size
        return [_Part(p) for p in parts]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields]
        rows: list[tuple] = []
        held = 0
        at, _ = file_system(self.path)
        for name, size in partition.files:
            with at.open_input_file(name) as handle:
                stream = _Stream(handle, size, name.endswith(".gz"))
                try:
                    while stream.open():
                        while stream.another():
                            got = self._record(stream, name)
                            if got is not None:
                                rows.append(got)
                                held += len(got[7] or b"")
                            if len(rows) >= 2000 or held > 8 << 20:
                                yield self._batch(rows, names)
                                rows, held = [], 0
                            if stream.length is not None:
                                break  # one record a member, whose rest need not be inflated
                        stream.close()
                except (ValueError, zlib.error) as error:
                    raise ValueError(f"{name}: {error}") from error
        if rows:
            yield self._batch(rows, names)

    def _record(self, stream: _Stream, file: str) -> tuple | None:
        offset = stream.place
        h = headers(stream.until(b"\r\n\r\n"))
        kind, digest = h.get("warc-type", ""), h.get("warc-payload-digest", "").removeprefix("sha1:")
        record_id, length = h.get("warc-record-id", ""), int(h.get("content-length", 0))
        row = {"record_type": kind, "target_uri": h.get("warc-target-uri", ""), "record_id": record_id, "payload_digest": digest, "page_id": _page_of(record_id)}
        if any(row[k] not in v for k, v in self.wanted.items()):
            if stream.length is None:
                stream.skip(length)
            return None
        payload, http = None, None
        if h.get("content-type", "").startswith("application/http"):
            http = stream.until(b"\r\n\r\n", length)
            length -= 0 if http is None else len(http) + 4
        n = length
        if kind == "revisit" and http is not None:  # the payload is elsewhere, its length is told
            told = headers(http).get("content-length", "")
            n = int(told) if told.isdigit() else length
        if kind != "revisit" and self.payload:
            payload = stream.take(length)
        elif stream.length is None:
            stream.skip(length)
        return (row["page_id"], kind, row["target_uri"], record_id, _page_of(h.get("warc-refers-to")), digest, n, payload, file, offset)

    _ORDER = ("page_id", "record_type", "target_uri", "record_id", "refers_to", "payload_digest", "payload_bytes", "payload", "file", "offset")
    _KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64())

    def _batch(self, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        at = [self._ORDER.index(n) for n in names]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], self._KINDS[i]) for i in at], names)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Takes columns page_id, url, payload, digest (base32), refers_to, revisit."""

    def __init__(self, options, overwrite: bool):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", 1)), overwrite
        self.most = int(options.get("file_bytes", 256 << 20))

    def write(self, batches) -> _Written:
        at, root = file_system(self.path)
        at.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        for batch in batches:
            cols = {n: batch.column(batch.schema.get_field_index(n)) for n in ("page_id", "url", "payload", "digest", "refers_to", "revisit")}
            for i in range(batch.num_rows):
                row = {k: c[i].as_py() for k, c in cols.items()}
                data = member(record(row["page_id"], row["url"], row["payload"] or b"", row["digest"], row["refers_to"], row["revisit"]), self.level)
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = at.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                size += len(data)
                if size >= self.most:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return _Written(files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        at, root = file_system(self.path)
        at.create_dir(root, recursive=True)
        before = [x.path for x in at.get_file_info(fs.FileSelector(root)) if x.base_name.startswith(MANIFEST)]
        old = _manifests(at, root) or [] if self.overwrite else []
        files = sorted(x for m in messages if m for x in m.files)
        with at.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(files).encode())
        for path in [*before, *(f"{root}/{name}" for name, _ in old)] if self.overwrite else []:
            at.delete_file(path)

    def abort(self, messages) -> None:
        at, root = file_system(self.path)
        for name, _ in (x for m in messages if m for x in m.files):
            at.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """The rows that WarcWriter takes."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    # The first holder of each payload that several rows have; written, so that the join has an exchange of its own on
    # either side and a payload that very many rows hold can be split.
    first = written(
        rows.where(F.octet_length("payload") >= least)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha", "first", F.lit(True).alias("shared")),
        "first-holders",
    )
    joined = rows.join(first, "sha", "left")
    revisit = F.coalesce(F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)) & (F.octet_length("payload") >= least)
    return joined.select("page_id", "url", "payload", "sha", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha):
    """The 20 bytes of sha as 32 base32 characters, in SQL: 5 bytes give 8 digits of 5 bits."""
    digits = []
    for part in range(4):
        number = F.conv(F.hex(F.substring(sha, part * 5 + 1, 5)), 16, 10).cast("long")
        for digit in range(8):
            at = F.shiftright(number, 35 - 5 * digit).bitwiseAND(F.lit(31).cast("long")) + 1
            digits.append(F.substring(F.lit(_ALPHABET), at.cast("int"), F.lit(1)))
    return F.concat(*digits)


def write_archive(pages: DataFrame, path: str, least: int = 0, overwrite: bool = False, **names: str) -> None:
    register(pages.sparkSession)
    rows = with_revisits(pages, least=least, **names)
    rows.select("page_id", "url", "payload", base32(F.col("sha")).alias("digest"), "refers_to", "revisit").write.format("millrace_warc").mode("overwrite" if overwrite else "append").save(path)


def read_archive(spark, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("millrace_warc").option("payload", str(payload).lower()).load(path)


def summary(archive: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, digest_matches."""
    found = base32(F.unhex(F.sha1("payload")))
    return archive.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        F.when(F.col("payload").isNotNull(), found == F.col("payload_digest")).alias("digest_matches"),
    )
