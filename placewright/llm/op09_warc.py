"""WARC archives compressed with a Zstandard dictionary.

Each task writes archives of its own rows: the first records are set aside to train a dictionary, which goes first as a
skippable frame (magic 0x184D2A5D; where there's too little to learn from it is the beginning of the records); then every record is a frame compressed with it. Of records with equal payloads of
MIN_REVISIT bytes or more, the one with the largest page_id is a response; the others are revisits that refer to it and hold no
payload.

Archives are streamed into the shared folder under names that hold the task's attempt, and listed in a manifest table that Spark
commits: an attempt that is lost leaves a file that no manifest names. Reading streams each archive of the manifest.

Defined results: null html is an empty payload; a null page_id is written as `null` and is the response only where all of
its equals are null; rows that repeat the largest page_id with the same payload are responses all; a null or odd url is
written percent-encoded; empty tables give empty archives; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import passing_folder, settled, small_batches, table, without

MIN_REVISIT = 1000
MAGIC = 0x184D2A5D
#: Bytes of records that train an archive's dictionary, and bytes of records an archive holds before the next begins.
TRAIN_BYTES, ARCHIVE_BYTES, DICTIONARY_BYTES = 4 << 20, 256 << 20, 64 << 10
#: Lengths of the pieces that a dictionary is trained on, tried in turn.
PIECES = (128 << 10, 4 << 10, 256)
#: Payloads that occur more than once are broadcast up to so many, about 100 bytes each; more are joined by shuffle.
BROADCAST_GROUPS = 200_000
#: Compression level.
LEVEL = 9


def dealt(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), payload_bytes, payload_digest, record_type and refers_to of each page."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    many = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    many = settled(many.where("_n > 1").select(F.col("payload_digest").alias("_digest"), "_first"), "equal")
    few = many.count() <= BROADCAST_GROUPS
    rows = rows.join(F.broadcast(many) if few else many, F.col("payload_digest") == F.col("_digest"), "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    rows = rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("_first")))
    return rows.select(*without(rows, "_digest", "_first"))


def record(page: dict) -> bytes:
    """One WARC record."""
    payload = page["html"].encode("utf-8", "surrogatepass")
    name = "null" if page["page_id"] is None else page["page_id"]
    url = quote(page["url"], safe="%/:?#[]@!$&'()*+,;=~-._") if page["url"] else f"urn:x-page:{name}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = page["record_type"] == "revisit"
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {page['record_type']}", f"WARC-Record-ID: <urn:x-page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{page['payload_digest']}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{page['refers_to']}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(waiting: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on pieces of all records, of at most TRAIN_BYTES, evenly spaced; where they are too few or too alike to
    learn from, smaller pieces, and at last the beginning of the records as it is."""
    size = max(256, min(DICTIONARY_BYTES, sum(map(len, waiting)) // 8))
    for length in PIECES:
        pieces = [w[i : i + length] for w in waiting for i in range(0, len(w), length)]
        most = max(1, TRAIN_BYTES // length)
        total = sum(map(len, pieces))
        if total > TRAIN_BYTES and len(pieces) > most:
            most = max(most, len(pieces) * TRAIN_BYTES // total)
            pieces = [pieces[i * len(pieces) // most] for i in range(most)]
        try:
            return zstandard.train_dictionary(size, pieces)
        except zstandard.ZstdError:
            continue
    return zstandard.ZstdCompressionDict(b"".join(w[:size] for w in waiting[:size])[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes records to a stream, the dictionary first."""

    def __init__(self, out) -> None:
        self.out, self.waiting, self.size, self.n, self.packer = out, [], 0, 0, None

    def add(self, data: bytes) -> None:
        self.size, self.n = self.size + len(data), self.n + 1
        if self.packer is not None:
            self.out.write(self.packer.compress(data))
            return
        self.waiting.append(data)
        if self.size >= TRAIN_BYTES:
            self.train()

    def train(self) -> None:
        learned = dictionary(self.waiting)
        raw = learned.as_bytes()
        self.out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned)
        for data in self.waiting:
            self.out.write(self.packer.compress(data))
        self.waiting = []

    def close(self) -> None:
        if self.packer is None:
            self.train()
        self.out.close()


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return pafs.FileSystem.from_uri(folder)


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of dealt() as archives below folder; the manifest: path and n_records of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        task, archive, path, part = TaskContext.get(), None, "", 0
        for batch in batches:
            paths, counts = [], []
            for i in range(batch.num_rows):
                if archive is None:
                    path, part = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{part:05d}.warc.zst", part + 1
                    archive = Archive(fs.open_output_stream(path, compression=None))
                archive.add(record({n: batch.column(n)[i].as_py() for n in batch.schema.names}))
                if archive.size >= ARCHIVE_BYTES:
                    archive.close()
                    paths, counts, archive = [*paths, path], [*counts, archive.n], None
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "n_records"])
        if archive is not None:
            archive.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([archive.n], pa.int64())], names=["path", "n_records"])

    with small_batches(rows.sparkSession):
        return settled(rows.mapInArrow(run, "path string, n_records long"), "manifest")


def records(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of an archive, read as a stream."""
    start = stream.read(8)
    learned = None
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == MAGIC:
        raw = stream.read(struct.unpack("<I", start[4:])[0])
        learned, start = zstandard.ZstdCompressionDict(raw), b""

    class Joined:
        def __init__(self) -> None:
            self.first = start

        def read(self, n: int) -> bytes:
            out, self.first = self.first, b""
            return out or stream.read(n)

    plain = zstandard.ZstdDecompressor(dict_data=learned).stream_reader(Joined(), read_across_frames=True)
    have = b""

    def until(mark: bytes) -> bytes | None:
        nonlocal have
        while (at := have.find(mark)) < 0:
            more = plain.read(1 << 16)
            if not more:
                return None
            have += more
        out, have = have[:at], have[at + len(mark) :]
        return out

    while (head := until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        need, parts = int(fields["Content-Length"]) + 4, [have]
        got = len(have)
        while got < need:
            more = plain.read(max(1 << 16, need - got))
            if not more:
                raise ValueError("an archive ends within a record")
            parts, got = [*parts, more], got + len(more)
        whole = b"".join(parts)
        block, have = whole[: need - 4], whole[need:]
        yield fields, block


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record; digests of responses are computed from what was read."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def page(urn: str | None) -> int | None:
        name = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(name) if name not in ("", "null") else None

    def rows(path: str) -> Iterator[tuple]:
        fs, _ = _opened(folder)
        with fs.open_input_stream(path, compression=None) as stream:
            for head, block in records(stream):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind = head["WARC-Type"]
                size = int(http.rsplit(b"Content-Length: ", 1)[1])
                digest = hashlib.sha1(payload).hexdigest() if kind == "response" else head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (size != len(payload) or digest != head["WARC-Payload-Digest"].removeprefix("sha1:")):
                    raise ValueError(f"damaged record in {path}")
                yield page(head["WARC-Record-ID"]), size, digest, kind, page(head.get("WARC-Refers-To"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path"):
                out: list[tuple] = []
                for row in rows(path.as_py()):
                    out.append(row)
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    files = manifest.select("path").repartition(max(1, min(10_000, manifest.count())))
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = passing_folder(spark, "warc")
    return read(write(dealt(table(spark, sf_dir, "pages")), folder), folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM m
"""
