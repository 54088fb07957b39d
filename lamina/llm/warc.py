"""WARC archives as a Spark data source, read and written by tasks.

Each record is a gzip member of its own whose extra field ``sl`` states its
compressed and plain length, so a reader can step over a payload without
decoding it.  Reading plans one partition for each run of files, takes
predicates on ``warc_type`` and on headers, inflates a record's headers first,
and inflates the payload only of a record that passes, and only if the column
is asked for.  Archives without that field, and plain ``.warc`` files, are read
as well; there an unwanted payload is inflated or skipped but not kept.

Defined cases: null html is an empty payload; rows that share the largest
page_id of a payload are all responses; an empty table writes no records.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from lamina.llm.common import new_path

SCHEMA = "record_id string, warc_type string, target_uri string, date string, payload_digest string, refers_to string, headers map<string,string>, payload binary"
WRITE_SCHEMA = "record_id string, warc_type string, target_uri string, payload_digest string, refers_to string, payload_length long, payload binary"
#: Column to header name; these can be pushed down.
HEADERS = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = b"\r\n\r\n"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _member(plain: bytes) -> bytes:
    """A gzip member whose extra field tells its own length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def _head(fields: dict[str, str | None]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n").encode()


class WarcWriter(DataSourceWriter):
    """One archive for each task, named after its attempt; only committed ones get their final name."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, folder = _filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        with fs.open_output_stream(f"{folder}/_{name}", compression=None) as out:
            for row in iterator:
                revisit = row["warc_type"] == "revisit"
                body = b"" if revisit else bytes(row["payload"] or b"")
                block = _HTTP + body
                fields = {
                    "WARC-Type": row["warc_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": "2000-01-01T00:00:00Z", "WARC-Target-URI": row["target_uri"],
                    "WARC-Payload-Digest": row["payload_digest"], "WARC-Refers-To": row["refers_to"],
                    "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
                    "X-Payload-Length": str(row["payload_length"]), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
                }
                out.write(_member(_head(fields) + block + _END))
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages: list) -> None:
        fs, folder = _filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.move(f"{folder}/_{m.name}", f"{folder}/{m.name}")

    def abort(self, messages: list) -> None:
        fs, folder = _filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{folder}/_{m.name}")


class FileRun(InputPartition):
    def __init__(self, files: list[str]) -> None:
        super().__init__(files)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int, wants_payload: bool) -> None:
        self.path, self.partition_bytes, self.wants_payload = path, partition_bytes, wants_payload
        self.wanted: list[tuple[str, frozenset[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and IN on the header columns; returns the rest to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in HEADERS and len(f.attribute) == 1:
                self.wanted.append((HEADERS[f.attribute[0]].lower(), frozenset([f.value])))
            elif isinstance(f, In) and f.attribute[0] in HEADERS and len(f.attribute) == 1:
                self.wanted.append((HEADERS[f.attribute[0]].lower(), frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, folder = _filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if fs.get_file_info(folder).type != pafs.FileType.File else [fs.get_file_info(folder)]
        runs: list[list[str]] = []
        room = 0
        for f in sorted(found, key=lambda f: f.path):
            name = f.path.rpartition("/")[2]
            if name.startswith(("_", ".")) or not name.endswith((".warc", ".warc.gz")):
                continue
            if not runs or room + f.size > self.partition_bytes:
                runs.append([])
                room = 0
            runs[-1].append(f.path)
            room += f.size
        return [FileRun(r) for r in runs]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.path)
        rows: list[tuple] = []
        held = 0
        for path in partition.files if partition else []:
            with fs.open_input_file(path) as f:
                records = _gzip_records(f, self._passes, self.wants_payload) if path.endswith(".gz") else _plain_records(f, self._passes, self.wants_payload)
                for fields, payload in records:
                    get = fields.get
                    rows.append((*(get(h.lower()) for h in HEADERS.values()), list(fields.items()), payload))
                    held += len(payload or b"") + 500
                    if held > 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _passes(self, fields: dict[str, str]) -> bool:
        return all(fields.get(k) in values for k, values in self.wanted)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.string()] * 6, pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [*HEADERS, "headers", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _payload(block: bytes) -> bytes:
    """What follows the HTTP headers of a block, or the block itself."""
    return block.partition(_END)[2] if block.startswith(b"HTTP/") else block


def _gzip_records(f, passes, wants_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        chunk = f.read(1 << 14)
        length = 0
        if chunk[3] & 4:  # the extra field; "sl" has the member's length
            extra = chunk[12 : 12 + struct.unpack_from("<H", chunk, 10)[0]]
            while len(extra) >= 4:
                n = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"sl" and n == 8:
                    length = struct.unpack_from("<I", extra, 4)[0]
                extra = extra[4 + n :]
        inflate = zlib.decompressobj(31)
        plain = inflate.decompress(chunk, 1 << 12)
        read = len(chunk)
        while _END not in plain and not inflate.eof:
            more = inflate.unconsumed_tail or f.read(1 << 14)
            read += 0 if inflate.unconsumed_tail else len(more)
            if not more:
                break
            plain += inflate.decompress(more, 1 << 14)
        head, _, rest = plain.partition(_END)
        fields = _fields(head)
        passed = passes(fields)
        if length and not (passed and wants_payload):
            at += length
        else:
            parts = [rest]
            while not inflate.eof:
                more = inflate.unconsumed_tail
                if not more:
                    more = f.read(1 << 16)
                    read += len(more)
                    if not more:
                        break
                parts.append(inflate.decompress(more, 1 << 20))
                if not (passed and wants_payload):
                    parts = []
            at += read - len(inflate.unused_data) if inflate.eof else size
            rest = b"".join(parts)
        if passed:
            yield fields, _payload(rest[: int(fields.get("content-length", 0))]) if wants_payload else None


def _plain_records(f, passes, wants_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        head = b""
        while _END not in head:
            more = f.read(1 << 12)
            if not more:
                return
            head += more
        head = head.partition(_END)[0]
        fields = _fields(head)
        n = int(fields.get("content-length", 0))
        begin = at + len(head) + 4
        if passes(fields):
            if wants_payload:
                f.seek(begin)
            yield fields, _payload(f.read(n)) if wants_payload else None
        at = begin + n + 4


class WarcSource(DataSource):
    """``spark.read.format("warc")``; option ``payload`` = false leaves payloads undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("partitionbytes", 32 << 20)), self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> None:
    """Writes a record for each row; equal payloads of ``least`` bytes or more become revisits of the one with the largest id.

    Digests are counted with partial sums; the join that brings the chosen id
    back is an ordinary one, which Spark splits where one payload is frequent.
    """
    register(pages.sparkSession)
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url).cast("string").alias("uri"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.length("payload").cast("long"))
    chosen = rows.where(F.col("n") >= least).groupBy("digest").agg(F.max("id").alias("best"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    rows = rows.join(chosen, "digest", "left").withColumn("revisit", F.coalesce((F.col("n") >= least) & (F.col("id").isNull() | (F.col("id") < F.col("best"))), F.lit(False)) & F.col("best").isNotNull())
    rows = rows.select(
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">")).alias("record_id"),
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("warc_type"),
        F.col("uri").alias("target_uri"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(F.col("revisit"), F.concat(F.lit("<urn:page:"), F.col("best").cast("string"), F.lit(">"))).alias("refers_to"),
        F.col("n").alias("payload_length"),
        F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
    )
    rows.write.format("warc").mode("append").save(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """The archived pages, as read back: responses with decoded payloads, revisits from their headers alone."""
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
    full = read(spark, path).where("warc_type = 'response'").select(
        number(F.col("record_id")).alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to")
    )
    brief = read(spark, path, payload=False).where("warc_type = 'revisit'").select(
        number(F.col("record_id")).alias("page_id"), F.col("headers")["x-payload-length"].cast("long").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to")
    )
    return full.unionByName(brief)


def round_trip(pages: DataFrame) -> DataFrame:
    path = new_path(pages.sparkSession, "warc")
    archive(pages, path)
    return page_records(pages.sparkSession, path)
