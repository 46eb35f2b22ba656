"""WARC archives, Zstandard-compressed record by record with a dictionary built from the records.

A file is a leading skippable frame that holds the dictionary, then one frame per record, so that records can
be reached one by one and small ones still compress well.  The dictionary of a file is trained on its first
``SAMPLE_BYTES`` of records; where there is too little to train on, those records are the dictionary.  The
sample bears on the size of the file alone.

Records with equal payloads of ``min_bytes`` or more are stored once: the largest page id (of equal ids the
largest url) is the response, the others are revisits that refer to it.  Identical rows of the
response are responses too.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import land
from adlens.session import scratch_path

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

SAMPLE_BYTES = 4_000_000
DICTIONARY_BYTES = 64_000
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"  # the pages carry no date


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """The bytes of a response, or of a revisit (without payload) if ``refers_to`` names a record."""
    body = HTTP_HEAD if refers_to else HTTP_HEAD + payload
    head = [VERSION, f"WARC-Type: {'revisit' if refers_to else 'response'}",
            f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there is too little to train on."""
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class ArchiveWriter:
    def __init__(self, out):
        self.out, self.waiting, self.held, self.compressor = out, [], 0, None

    def add(self, data: bytes) -> None:
        if self.compressor is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= SAMPLE_BYTES:
                self._begin()
        else:
            self.out.write(self.compressor.compress(data))

    def _begin(self) -> None:
        dictionary = build_dictionary(self.waiting)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        for data in self.waiting:
            self.out.write(self.compressor.compress(data))
        self.waiting = []

    def close(self) -> None:
        if self.compressor is None:
            self._begin()


def read_records(file):
    """(headers, payload) of every record of an open archive, in order; one record is held at a time."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    dictionary = zstandard.ZstdCompressionDict(file.read(size))
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(file, read_across_frames=True))
    while line := plain.readline():
        if line.strip() != VERSION.encode():
            raise ValueError("a record does not begin with the version")
        headers = {}
        while (line := plain.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            headers[name] = value
        body = plain.read(int(headers["Content-Length"]))
        plain.read(4)
        yield headers, body[body.index(b"\r\n\r\n") + 4:]


_MANIFEST = "path string, records bigint, bytes bigint"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Archive every row of ``pages`` (page_id, url, html; others are ignored); one manifest row per file.

    ``folder`` is an address that executors reach.  A file gets its name when it is complete, so a repeated
    task replaces it as a whole.  A null html is an empty payload; null ids and urls leave their headers out; an
    empty table writes no file.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    small = keyed.where(F.octet_length("html") >= min_bytes).select("page_id", "url", "sha")
    winners = land(small.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("w"), F.count("*").alias("n"))
                   .where("n > 1").select("sha", F.col("w.page_id").alias("w_id"), F.col("w.url").alias("w_url")), "winners")
    # Decided on keys alone, so that no payload is ever gathered by its digest.
    revisits = land(small.join(winners, "sha").where(~(F.col("page_id").eqNullSafe(F.col("w_id")) & F.col("url").eqNullSafe(F.col("w_url"))))
                    .distinct(), "revisits")
    r = revisits.select(F.col("page_id").alias("r_id"), F.col("url").alias("r_url"), F.col("sha").alias("r_sha"),
                        "w_id", "w_url", F.lit(True).alias("revisit"))
    decided = keyed.join(r, F.col("page_id").eqNullSafe(F.col("r_id")) & F.col("url").eqNullSafe(F.col("r_url"))
                         & (F.col("sha") == F.col("r_sha")), "left") \
        .select("page_id", "url", "html", "w_id", "w_url", F.coalesce("revisit", F.lit(False)).alias("revisit"))

    def write(batches):
        store = out = writer = None
        records = 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
            for page_id, url, w_id, w_url, revisit, html in zip(*columns, batch.column(2)):
                if writer is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    name = posixpath.join(root, f"pages-{TaskContext.get().partitionId():06d}.warc.zst")
                    draft = f"{name}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft)
                    writer = ArchiveWriter(out)
                payload = html.as_py().encode("utf-8", "surrogatepass")
                digest = payload_digest(payload)
                writer.add(record(page_id, url, payload, digest, record_id(w_id, w_url, digest) if revisit else None))
                records += 1
        if writer is not None:
            writer.close()
            size = out.tell()
            out.close()
            store.move(draft, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [records], "bytes": [size]})

    return land(decided.mapInArrow(write, _MANIFEST), "archives")


_RECORDS = "page_id bigint, url string, record_id string, record_type string, refers_to string, payload_digest string, payload binary"
_ROWS = 256


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the files of a manifest; ``payload`` is null for revisits.

    Without ``payloads`` the column holds nothing and ``payload_bytes`` alone tells the size.  The payload of a
    response is checked against its digest.
    """
    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "record_id", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * payloads
        types = [pa.int64(), *[pa.string()] * 5, pa.int64()] + [pa.binary()] * payloads
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as file:
                    for headers, payload in read_records(file):
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = headers["WARC-Type"] == "response"
                        if response and payload_digest(payload) != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                        page_id, url = headers.get("X-Page-ID"), headers.get("WARC-Target-URI")
                        rows.append((None if page_id is None else int(page_id), None if url is None else _plain(url),
                                     headers["WARC-Record-ID"], headers["WARC-Type"], headers.get("WARC-Refers-To"), digest,
                                     len(payload) if response else None, *([payload if response else None] * payloads)))
                        if len(rows) == _ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = _RECORDS.replace("payload binary", "payload_bytes bigint") + (", payload binary" if payloads else "")
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages, read the archives back, and resolve revisits: page_id, payload_bytes, payload_digest,
    record_type, refers_to, all from the archives."""
    folder = scratch_path(pages.sparkSession, "warc")
    records = land(read_archives(write_archives(pages, folder, min_bytes), folder, payloads=False), "records")
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    # Responses refer to nothing and stay out of the join; of them only the targets are landed, not one small file per shuffle partition.
    targets = responses.select(F.col("record_id").alias("target"), F.col("page_id").alias("target_page"),
                               F.col("payload_bytes").alias("target_bytes")).dropDuplicates(["target"]) \
        .join(revisits.select(F.col("refers_to").alias("target")).distinct(), "target", "left_semi")
    resolved = revisits.join(land(targets, "targets"), F.col("refers_to") == F.col("target"), "left") \
        .select("page_id", F.col("target_bytes").alias("payload_bytes"), "payload_digest", "record_type",
                F.col("target_page").alias("refers_to"))
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type",
                            F.lit(None).cast("bigint").alias("refers_to")).union(resolved)
