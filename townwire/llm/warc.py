"""Web archives of individually compressed records that share a dictionary.

The writer makes ``.warc.zst`` files: a leading skippable frame holds a Zstandard dictionary
built from a bounded sample of the records, then each record is one frame compressed with
it. So any record can be read with nothing but the dictionary and its own bytes.

1. Payloads are hashed (SHA-256); per hash the row with the largest page_id is the response
   that the other rows revisit. Only hashes, ids and lengths are shuffled for that, counted
   per task before, so a group of copies may hold any share of the rows.
2. Rows are joined with their kind by a row number of their own, so no key is hot, and each
   task writes archives of bounded size to the shared folder, under names of their own. The
   manifest lists the files of tasks that succeeded, so an attempt that was lost leaves a
   file that nobody reads.
3. The reader takes the manifest's files, a file a task, and reads frame by frame.

A revisit record holds the HTTP header without the payload, and names the response by its
record id; payload length and digest are those of the full payload in both kinds.

Defined cases: null html is an empty payload; a page_id may be null or repeat (a null is
smaller than any id; of rows that share payload and page_id one is the response); payloads
under ``least`` bytes are all responses; a null url is written as the record's own id; an
empty table makes no files and no rows. pages is read twice and must give its rows alike
(a table or a scan of files does).
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townwire.llm.common import SLICE_ROWS, join_counted, new_folder, stored

#: Skippable frame that holds the dictionary, and its header: magic number and length.
DICTIONARY_FRAME, FRAME_HEADER = 0x184D2A5D, struct.Struct("<II")
#: Bytes of the dictionary; rows (up to twice as many) and characters of each that it is built from; bytes of an archive, about; compression level.
DICTIONARY, SAMPLE_ROWS, SAMPLE_CHARS, ARCHIVE, LEVEL = 112 << 10, 1_000, 8_192, 64 << 20, 3
#: Bytes that the reader takes at once.
CHUNK = 1 << 16
#: The date of all records, as pages has none.
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def page_of(record: str) -> int | None:
    page = record.strip("<>").split(":")[2]
    return int(page) if page else None


def escaped(url: str) -> str:
    """White space and control characters, which would end a header's value, as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, row: int, url: str | None, payload: bytes, refers: str | None) -> bytes:
    """One record. refers: the response that it revisits, if it does."""
    own = record_id(page_id, row)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if refers else payload
    headers = {
        "WARC-Type": "revisit" if refers else "response", "WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Target-URI": own if url is None else escaped(url),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if refers:
        headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": refers}
    headers |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The columns of RECORDS, of one record. Raises where lengths or digests don't fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or len(data) != len(head) + 4 + len(block) + 4 or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    of_payload, refers = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields.get("WARC-Refers-To")
    if not refers and (len(payload) != length or digest(payload) != of_payload):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    url = fields["WARC-Target-URI"]
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": None if url == fields["WARC-Record-ID"] else url, "payload_bytes": length, "payload_digest": of_payload,
        "record_type": fields["WARC-Type"], "refers_to": page_of(refers) if refers else None, "html": None if refers else payload.decode(),
    }


def kinds(rows: DataFrame, least: int) -> DataFrame:
    """(row, refers): the rows that revisit another, and that row's record id."""
    html = F.coalesce("html", F.lit(""))
    hashed = stored(rows.select("row", "page_id", F.unhex(F.sha2(html, 256)).alias("hash"), F.octet_length(html).alias("bytes")), "payloads").filter(F.col("bytes") >= least)
    largest = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "row")).alias("first")
    repeated = stored(hashed.groupBy("hash").agg(F.count("*").alias("n"), largest).filter("n > 1"), "payloads-repeated")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), F.lit(":"), F.col("first.row"), F.lit(">"))
    return join_counted(hashed, repeated, "hash", "n", total).filter(F.col("row") != F.col("first.row")).select("row", name.alias("refers"))


def dictionary(rows: DataFrame, size: int = DICTIONARY) -> bytes | None:
    """A dictionary built from records of a bounded sample of rows, by hash; None where there is too little to build one from."""
    import zstandard

    sample = rows.select("page_id", "row", "url", F.left(F.coalesce("html", F.lit("")), F.lit(SAMPLE_CHARS)).alias("html"))
    share = max(1, rows.count() // SAMPLE_ROWS)  # one row in so many, so that tasks send no more than is taken
    sample = sample.filter(F.pmod(F.xxhash64("page_id", "url", "row"), F.lit(share)) == 0).limit(2 * SAMPLE_ROWS).collect()  # at most so many rows of SAMPLE_CHARS
    records = [record(r["page_id"], r["row"], r["url"], r["html"].encode(), None) for r in sample]
    try:
        return zstandard.train_dictionary(min(size, max(1 << 10, sum(map(len, records)) // 8)), records).as_bytes()
    except zstandard.ZstdError:
        return None


class Archive:
    """One archive while it is written."""

    def __init__(self, words: bytes | None):
        import zstandard

        shared = zstandard.ZstdCompressionDict(words) if words else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_checksum=True)
        self.head = FRAME_HEADER.pack(DICTIONARY_FRAME, len(words)) + words if words else b""
        self.out, self.records = io.BytesIO(self.head), 0
        self.out.seek(0, io.SEEK_END)

    def add(self, data: bytes) -> None:
        self.out.write(self.compressor.compress(data))
        self.records += 1

    def save(self, folder: str) -> dict:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        with system.open_output_stream(f"{path}/{name}", compression=None) as f:
            f.write(self.out.getbuffer())
        return {"path": f"{folder}/{name}", "records": self.records, "bytes": self.out.tell()}


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archives into folder, a URI that all executors reach. Returns the manifest: path, records, bytes."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    words = dictionary(rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def saved(archive: Archive) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([archive.save(folder)], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        archive = None
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                for r in batch.slice(start, SLICE_ROWS).to_pylist():
                    archive = archive or Archive(words)
                    archive.add(record(r["page_id"], r["row"], r["url"], (r["html"] or "").encode(), r["refers"]))
                    if archive.out.tell() >= ARCHIVE:
                        yield saved(archive)
                        archive = None
        if archive:
            yield saved(archive)

    return stored(rows.join(kinds(rows, least), "row", "left").mapInArrow(write, "path string, records long, bytes long"), "manifest")


def frames(source) -> Iterator[bytes]:
    """The records of an archive, one after the other, from a file that is open for reading."""
    import zstandard

    data, words = source.read(CHUNK), None
    while len(data) >= FRAME_HEADER.size and FRAME_HEADER.unpack_from(data)[0] == DICTIONARY_FRAME:
        end = FRAME_HEADER.size + FRAME_HEADER.unpack_from(data)[1]
        while len(data) < end:
            data += source.read(end - len(data))
        words, data = zstandard.ZstdCompressionDict(data[FRAME_HEADER.size : end]), data[end:]
    reader = zstandard.ZstdDecompressor(dict_data=words)
    while data or (data := source.read(CHUNK)):
        one, parts = reader.decompressobj(), []
        while not one.eof:
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else source.read(CHUNK)
            if not data and not one.eof:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives that a manifest lists, as page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for revisits)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORDS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for r in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(r["path"])
                out, n = [], 0
                with system.open_input_stream(path, compression=None) as f:
                    for x in frames(f):
                        out.append(parsed(x))
                        n += 1
                        if len(out) == SLICE_ROWS:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                if n != r["records"]:
                    raise ValueError(f"{r['path']} holds {n} of {r['records']} records")
                yield pa.RecordBatch.from_pylist(out, schema)

    files = manifest.count()
    return manifest.repartition(max(1, files), "path").mapInArrow(read, RECORDS)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives beside the scratch tables."""
    return new_folder(spark, "archives")
