"""Deterministic sharded WARC writer and its reader.

Pages are put in order of page_id and cut into shards of equal row counts; a shard is written by one task, as files that
roll when their compressed size reaches a limit. Each record is a gzip member of its own, with headers, digests and record
ids made anew from the page, so the same pages give the same bytes. Of pages with equal payloads of at least
`LEAST_BYTES` the one with the smallest page_id is a response, the others are revisits that name it.

Tasks write under temporary names. The list of files of the attempts that succeeded is stored; then files get their
final names (a repeated rename does nothing); last comes the manifest, and readers take only files it lists. A lost
executor repeats its shard under another temporary name.

Defined results: null html is the empty payload, null url an empty address; rows repeated under the smallest page_id of
a payload are responses alike; pages without an id come first, and they revisit a page with an id if there is one. An empty
table gives a manifest without files. Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import in_batches
from kindred.operators.positions import numbered
from kindred.runtime import fresh_path, stored

LEAST_BYTES = 100
ROLL_BYTES = 16_000_000
# Rows of a shard; larger tables get larger shards, so that the list of bounds stays short.
SHARD_ROWS = 1024
MOST_SHARDS = 20_000
NAMES = uuid.UUID("6f3c1d5e-8a4b-5c7d-9e2f-0b1a2c3d4e5f")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, first: int | None, date: str = DATE) -> bytes:
    """One uncompressed record: a revisit of page `first`, or a response if that is None."""
    digest = hashlib.sha256(payload).hexdigest()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if first is not None else http + payload
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(url.split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-ID", str(first))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file of gzip members; one member is unpacked at a time."""
    at = 0
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof and at < len(data):
            chunk = data[at : at + 65_536]
            parts.append(unpack.decompress(chunk))
            at += len(chunk) - len(unpack.unused_data)
        text = b"".join(parts)
        while text:
            head, _, rest = text.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a record: {lines[0][:40]!r}")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            length = int(headers["Content-Length"])
            yield headers, rest[:length]
            text = rest[length + 4 :]


class _Files:
    """The files of one shard: opens, rolls and describes them."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.number, self.stream = shard, roll, 0, None
        self.system.create_dir(f"{self.folder}/_tmp", recursive=True)

    def write(self, data: bytes) -> dict | None:
        """Appends a record; the description of the file that this record filled, if any."""
        if self.stream is None:
            self.name = f"pages-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"_tmp/{uuid.uuid4().hex}-{self.name}"
            self.stream = self.system.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
            self.size, self.count, self.digest = 0, 0, hashlib.sha256()
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(data) + pack.flush()
        self.stream.write(member)
        self.digest.update(member)
        self.size, self.count = self.size + len(member), self.count + 1
        return self.close() if self.size >= self.roll else None

    def close(self) -> dict | None:
        if self.stream is None:
            return None
        self.stream.close()
        self.stream, self.number = None, self.number + 1
        return {
            "name": self.name,
            "temporary": self.temporary,
            "records": self.count,
            "bytes": self.size,
            "sha256": self.digest.hexdigest(),
        }


def _revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest and first: pages that repeat the payload of the page `first`."""
    html = F.coalesce(F.col("html"), F.lit(""))
    payloads = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    payloads = stored(payloads.filter(F.col("n") >= LEAST_BYTES).drop("n"), "payloads")
    firsts = payloads.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    # Both sides are stored, so a payload that very many pages share is split.
    firsts = stored(firsts.filter("copies > 1 and first is not null").drop("copies"), "firsts")
    return payloads.join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))


def _bounds(pages: DataFrame, shard_rows: int) -> np.ndarray:
    """The smallest page_id of every shard but the first: exact positions, so the shards do not depend on sampling."""
    ids = pages.select("page_id").filter(F.col("page_id").isNotNull())
    count = ids.count()
    rows = max(shard_rows, -(-count // MOST_SHARDS))
    edges = numbered(ids, "page_id").filter((F.col("position") % rows == 0) & (F.col("position") > 0))
    return np.array(sorted(r["page_id"] for r in edges.collect()), np.int64)  # at most MOST_SHARDS


def write(
    pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_rows: int = SHARD_ROWS, date: str = DATE
) -> DataFrame:
    """Writes all pages below folder and returns the manifest: name, records, bytes and sha256 of every file."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    bounds = _bounds(pages, shard_rows)

    def sharded(batches):
        for batch in batches:
            ids = batch.column("page_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            shard = pa.array(np.searchsorted(bounds, ids, side="right").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], [*batch.schema.names, "shard"])

    def written(batches):
        files, first_of, held = None, {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if files is None or row["shard"] != files.shard:
                    if files and (full := files.close()):
                        yield pa.RecordBatch.from_pylist([full])
                    files = _Files(folder, row["shard"], roll_bytes)
                if row["digest"] is not None:  # what a revisit refers to stands before its page
                    if held != row["page_id"]:
                        first_of, held = {}, row["page_id"]
                    first_of[row["digest"]] = row["first"]
                    continue
                payload = (row["html"] or "").encode()
                first = None
                if held == row["page_id"] and first_of:
                    first = first_of.get(hashlib.sha256(payload).hexdigest())
                if full := files.write(record(row["page_id"], row["url"] or "", payload, first, date)):
                    yield pa.RecordBatch.from_pylist([full])
        if files and (full := files.close()):
            yield pa.RecordBatch.from_pylist([full])

    def renamed(batches):
        for batch in batches:
            system, base = fs.FileSystem.from_uri(folder)
            for row in batch.to_pylist():
                source, target = f"{base}/{row['temporary']}", f"{base}/{row['name']}"
                if system.get_file_info(source).type != fs.FileType.NotFound:
                    system.move(source, target)
                elif system.get_file_info(target).type == fs.FileType.NotFound:
                    raise FileNotFoundError(source)
            yield batch.select(["name", "records", "bytes", "sha256"])

    nothing = F.lit(None)
    rows = pages.withColumns({"digest": nothing.cast("string"), "first": nothing.cast("long")})
    notes = _revisits(pages).select(
        "page_id", nothing.cast("string").alias("url"), nothing.cast("string").alias("html"), "digest", "first"
    )
    columns = "page_id long, url string, html string, digest string, first long"
    ordered = (
        in_batches(rows.unionByName(notes), sharded, columns + ", shard int")
        .repartitionByRange(len(bounds) + 1, "shard")
        .sortWithinPartitions("shard", "page_id", F.col("digest").isNull(), "digest", "url", "html")
    )
    manifest = "name string, temporary string, records long, bytes long, sha256 string"
    done = stored(in_batches(ordered, written, manifest), "written")
    final = in_batches(done, renamed, "name string, records long, bytes long, sha256 string")
    final.coalesce(8).write.parquet(f"{folder}/manifest")
    return done.sparkSession.read.schema(final.schema).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the files that the manifest lists; a wrong digest is an error."""
    manifest = spark.read.schema("name string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")
    schema = "path string, modificationTime timestamp, length long, content binary"
    if manifest.isEmpty():
        files = spark.createDataFrame([], schema)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def parsed(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                data, digest = batch.column("content")[row].as_py(), batch.column("sha256")[row].as_py()
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{batch.column('name')[row]} differs from its manifest")
                found = []
                for headers, block in records(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = headers["WARC-Type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                    size = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"]
                    page, first = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                    found.append(
                        {
                            "page_id": int(page) if page else None,
                            "url": headers["WARC-Target-URI"],
                            "payload_bytes": int(size),
                            "payload_digest": digest,
                            "record_type": kind,
                            "refers_to": int(first) if first else None,
                            "payload": payload if kind == "response" else None,
                        }
                    )
                    if len(found) == 256:
                        yield pa.RecordBatch.from_pylist(found, schema=arrow)
                        found = []
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

    arrow = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload", pa.binary()),
        ]
    )
    return in_batches(
        # The list has one short row per file of several megabytes, which meet it without moving.
        named.join(F.broadcast(manifest.select("name", "sha256")), "name"),
        parsed,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "payload binary",
    )


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it: of its default file system, if it names none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = files.makeQualified(place).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads the records back."""
    spark = pages.sparkSession
    folder = qualified(spark, fresh_path(spark, "archives"))
    write(pages, folder)
    found = read(spark, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
