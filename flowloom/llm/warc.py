"""WARC archives compressed record by record with a Zstandard dictionary of their own."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, packed, shared_dir, text_of

#: The magic number of the skippable frame that holds the dictionary of a .warc.zst file, and of a Zstandard frame.
DICTIONARY_FRAME = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but says its length and digest."""
    revisit = refers_to is not None
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}#{digest}')}>"
    block = b"" if revisit else HTTP % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else "%%%02X" % ord(c) for c in url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises if it is cut short."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if first != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:n]


def build_dictionary(records: list[bytes], size: int) -> bytes:
    """A dictionary from archived records: trained, or their last bytes where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def _dictionary(raw: bytes):
    import zstandard

    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind)


class ArchiveWriter:
    """Archives of bounded size in one folder, each led by a dictionary built from its first records.

    A file is named after the task attempt that writes it, so a repeated
    attempt never touches another's file; readers take only listed files.
    """

    def __init__(self, folder: str, level: int = 3, archive_bytes: int = 64 << 20, sample_bytes: int = 2 << 20, dictionary_bytes: int = 64 << 10):
        self.folder, self.level, self.archive_bytes, self.sample_bytes, self.dictionary_bytes = folder, level, archive_bytes, sample_bytes, dictionary_bytes
        self.held, self.held_bytes, self.out, self.path, self.done, self.written, self.n = [], 0, None, "", [], 0, 0

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.held.append(record)
            self.held_bytes += len(record)
            if self.held_bytes >= self.sample_bytes:
                self._begin()
        else:
            self._put(record)

    def _begin(self) -> None:
        import zstandard

        raw = build_dictionary(self.held, self.dictionary_bytes)
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=_dictionary(raw), write_content_size=True, write_checksum=True)
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        store, path = pafs.FileSystem.from_uri(self.path)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.written, self.n, held, self.held, self.held_bytes = 8 + len(raw), 0, self.held, [], 0
        for r in held:
            self._put(r)

    def _put(self, record: bytes) -> None:
        frame = self.packer.compress(record)
        self.out.write(frame)
        self.written += len(frame)
        self.n += 1
        if self.written >= self.archive_bytes:
            self._end()

    def _end(self) -> None:
        self.out.close()
        self.done.append((self.path, self.n, self.written))
        self.out = None

    def close(self) -> list[tuple[str, int, int]]:
        if self.out is None and self.held:
            self._begin()
        if self.out is not None:
            self._end()
        return self.done


def read_archive(uri: str) -> Iterator[bytes]:
    """The records of one archive, one at a time."""
    import zstandard

    store, path = pafs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{uri}: no dictionary frame")
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(f.read(n)))
        one, parts = None, []
        while data := f.read(1 << 20):
            while data:
                if one is None:
                    one, parts = unpacker.decompressobj(), []
                try:
                    parts.append(one.decompress(data))
                except zstandard.ZstdError as e:
                    raise ValueError(f"{uri}: damaged record") from e
                if not one.eof:
                    break
                data = one.unused_data
                one = None
                yield b"".join(parts)
        if one is not None:
            raise ValueError(f"{uri}: cut short")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``(page_id, url, payload, digest_hex, refers_to)``: the record that each page becomes.

    Pages with equal payloads (SHA-1 and length) form a group, whose smallest
    page_id is the response.  Groups of one never appear in the join's small
    side; a huge group is one pre-aggregated row there, and adaptive execution
    splits its pages.
    """
    rows = packed(pages, page_id=F.col(f"`{id_col}`").cast("long"), url=F.col(f"`{url_col}`").cast("string"), payload=F.encode(text_of(body_col), "UTF-8")).drop("__row")
    rows = rows.withColumn("digest_hex", F.sha1("payload")).withColumn("size", F.length("payload"))
    first = rows.groupBy("digest_hex", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = rows.join(first, ["digest_hex", "size"], "left")
    return met.withColumn("refers_to", F.expr("case when not page_id <=> first_id then first_id end")).select("page_id", "url", "payload", "refers_to")


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", **options) -> DataFrame:
    """Write every page as a WARC record; returns the written list ``(path, records, bytes)`` of archives.

    ``folder`` is a URI that all executors share, by default under
    ``spark.checkpoint.dir``.  Each task streams its records through one writer.
    The list is itself written, so the archives are made once; files of failed
    attempts are not in it.  A null html is an empty payload, a null url leaves
    out the target; a page with a null id is a response with an id made from
    its content, unless its group has another; pages that share the smallest id
    of a group are all responses.  An empty table makes an empty list.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ArchiveWriter(folder, **options)
        for b in batches:
            for page, url, payload, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                out.add(record_bytes(page, url, payload, digest_of(payload), refers))
        done = out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["path", "records", "bytes"])

    return durable(plan_records(pages, id_col, url_col, body_col).mapInArrow(go, "path string, records long, bytes long"), "archives")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the listed archives, one row each; response payloads are checked against their digests."""

    def page(name: str | None) -> int | None:
        return int(name[len("<urn:page:") : -1]) if name and name.startswith("<urn:page:") else None

    def rows(paths):
        for path in paths:
            for raw in read_archive(path):
                h, block = parse_record(raw)
                digest, n, body = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), None
                if h["WARC-Type"] == "response":
                    body = block.partition(b"\r\n\r\n")[2]
                    if len(body) != n or digest_of(body) != digest:
                        raise ValueError(f"{path}: payload differs from its digest")
                yield (page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), n, digest, h["WARC-Type"], page(h.get("WARC-Refers-To")), body if with_payload else None)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]

        def pack(held):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

        for b in batches:
            held, size = [], 0
            for r in rows(b.column("path").to_pylist()):
                held.append(r)
                size += 200 + len(r[6] or b"")
                if size > 8 << 20:
                    yield pack(held)
                    held, size = [], 0
            if held:
                yield pack(held)

    spread = archives.select("path").repartition(max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return spread.mapInArrow(go, RECORD)
