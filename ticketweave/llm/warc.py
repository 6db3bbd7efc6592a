"""WARC archives compressed with Zstandard: one frame per record, a dictionary in front.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, as it is or as a Zstandard frame of its own; every further frame is
one record. Reader and writer take and give archives as rows with a binary
``content`` column, so files read with ``binaryFile`` and tables work alike.

The reader takes archives of any writer: records of all types, with ids of any
form, and passes over other skippable frames. What a record states is checked:
its lengths, and its digests where it has some.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGICS = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT_BYTES = 1000
# Payload bytes after which an archive is closed, and what one training sample may hold.
ARCHIVE_BYTES = 4 << 20
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 20_000, 32 << 10
FEED = 1 << 14
DATE = "2024-01-01T00:00:00Z"
BROADCAST_COPIES = 100_000


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c for c in url or "" if c >= " " and c != "\x7f")
    header = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{_base32(hashlib.sha1(payload).digest())}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        header[1:1] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def open_archive(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def _compressor(dictionary: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True)


def _skippable(content: bytes, at: int) -> bytes | None:
    """The data of the skippable frame at this place, None if another frame is there."""
    if len(content) - at < 8 or struct.unpack_from("<I", content, at)[0] not in SKIPPABLE_MAGICS:
        return None
    size = struct.unpack_from("<I", content, at + 4)[0]
    data = content[at + 8 : at + 8 + size]
    if len(data) != size:
        raise ValueError("a skippable frame is cut off")
    return data


def frames(content: bytes):
    """The decoded frames of one archive."""
    import zstandard

    at, dictionary = 0, None
    front = _skippable(content, 0)
    if front is not None and struct.unpack_from("<I", content)[0] == DICTIONARY_MAGIC:
        if front[:4] == FRAME_MAGIC:
            front = zstandard.ZstdDecompressor().decompress(front, max_output_size=1 << 27)
        dictionary = zstandard.ZstdCompressionDict(front)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(content):
        passed = _skippable(content, at)
        if passed is not None:
            at += 8 + len(passed)
            continue
        one, parts = decoder.decompressobj(), []
        while not one.eof:
            piece = content[at : at + FEED]
            if not piece:
                raise ValueError("the last frame is cut off")
            try:
                parts.append(one.decompress(piece))
            except zstandard.ZstdError as error:
                raise ValueError(f"bad frame at byte {at}: {error}") from error
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; lines that begin with white space continue the one before."""
    out, name = {}, None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if name is not None and text[:1] in (" ", "\t"):
            out[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise ValueError("a header line without a colon")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def _page_number(name: str | None) -> int | None:
    """The page of a record id that this module wrote; null for any other."""
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if name and name.startswith("<urn:page:") and digits.lstrip("-").isdigit() else None


def _digest(value: str | None) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a labelled digest, in base 32 or 16; None without one or for an unknown algorithm."""
    algorithm, colon, text = (value or "").partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if not colon or algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = hashlib.new(algorithm).digest_size
    try:
        return algorithm, bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper())
    except ValueError as error:
        raise ValueError(f"a digest that cannot be read: {value}") from error


def _check(data: bytes, digest: tuple[str, bytes] | None, what: str) -> None:
    if digest is not None and hashlib.new(digest[0], data).digest() != digest[1]:
        raise ValueError(f"the {what} does not fit its length or digest")


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; ValueError if header, length or digest do not hold.

    The payload of an HTTP message is its body, that of any other block the
    whole block, and a revisit has none. An HTTP length is held against the body
    unless that is encoded or the record says it was truncated.
    """
    head, blank, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not blank or not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    header = _fields(lines)
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(header)
    if missing:
        raise ValueError(f"missing {sorted(missing)}")
    length = int(header["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the record")
    kind, block = header["warc-type"].lower(), rest[:length]
    _check(block, _digest(header.get("warc-block-digest")), "block")
    stated = _digest(header.get("warc-payload-digest"))
    payload, size = block, length
    if kind in ("response", "request", "revisit") and header.get("content-type", "application/http").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if kind != "revisit" and not blank:
            raise ValueError("the block holds no HTTP message")
        fields = _fields(http.split(b"\r\n")[1:])
        size = int(fields.get("content-length", len(payload)))
        plain = not {"content-encoding", "transfer-encoding"} & set(fields)
        if kind == "response" and plain and "warc-truncated" not in header and len(payload) != size:
            raise ValueError("the payload does not fit its length or digest")
        size = size if kind == "revisit" else len(payload)
    if kind == "revisit":
        digest = stated[1].hex() if stated and stated[0] == "sha1" else None
    else:
        digest = hashlib.sha1(payload).hexdigest()
        # Digests of chunked bodies are taken of either form; of truncated ones, of what is missing too.
        if kind == "response" and "warc-truncated" not in header and b"chunked" not in block[: length - len(payload)].lower():
            _check(payload, stated, "payload")
    return {
        "page_id": _page_number(header["warc-record-id"]),
        "url": header.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_number(header.get("warc-refers-to")),
        "record_id": header["warc-record-id"],
        "refers_to_id": header.get("warc-refers-to"),
        "payload": None if kind == "revisit" else payload,
    }


RECORDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, record_id string, refers_to_id string, payload binary"
)
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """All records of archives (``content`` binary): page_id, url, payload_bytes, payload_digest (hex SHA-1),
    record_type, refers_to, record_id, refers_to_id and, unless ``payload`` is false, payload (null for revisits).

    Archives of other writers are read as well: ``record_id`` and
    ``refers_to_id`` are the ids as written, page_id and refers_to their page
    numbers where ``write_archives`` made them, null otherwise. Records of every
    type come out. Every record's header, lengths and stated digests are
    validated; a damaged archive fails the job. A null or empty content holds no records. Other
    columns are not used.
    """
    names = [c.split()[0] for c in RECORDS.split(", ")][: None if payload else -1]

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for frame in frames(content.as_py() or b""):
                    rows.append(parse_record(frame))
                    size += len(frame)
                    if size > ARCHIVE_BYTES:
                        yield _records(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _records(rows, names)

    return archives.select("content").mapInArrow(run, ", ".join(c for c in RECORDS.split(", ") if c.split()[0] in names))


def _records(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    arrays = [pa.array([r[n] for r in rows], t) for n, t in zip(names, _TYPES)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample: the starts of the ``SAMPLE_PAGES`` pages of smallest hash."""
    hashed = pages.filter("html <> ''").withColumn("h", F.xxhash64("html", "page_id"))
    # The hashes are compared first, so that no task sends more pages than are used.
    cut = hashed.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    chosen = hashed.filter(F.col("h") <= F.lit(cut)).select("h", F.substring("html", 1, SAMPLE_BYTES).alias("html"))
    rows = [r.html.encode() for r in chosen.dropDuplicates(["h"]).orderBy("h").collect()]
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples
        return b""


def write_archives(pages: DataFrame, min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archives (name, content) that hold a record for each row of ``pages`` (page_id, url, html).

    The payload is the html in UTF-8, null as empty. Among payloads of at least
    ``min_revisit`` bytes that are equal, the row of the largest page_id is a
    response and all others are revisits that refer to it; rows that repeat
    that page_id are responses too, and so are rows with a null page_id.
    Null urls are written as empty. Other columns are not used.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    keyed = pages.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    long_ones = keyed.filter((F.octet_length("html") >= min_revisit) & F.col("page_id").isNotNull())
    copies = long_ones.groupBy("digest").agg(F.max("page_id").alias("first"), F.min("page_id").alias("last"))
    copies = work.write(copies.filter("first <> last").drop("last"), "copies")
    few = copies.count() <= BROADCAST_COPIES
    joined = keyed.join(F.broadcast(copies) if few else copies, "digest", "left")
    records = joined.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("first"), F.col("first")).alias("refers_to"))
    dictionary = train_dictionary(pages)

    def pack(batches):
        compressor = _compressor(dictionary)
        parts, size, first = [open_archive(dictionary)], 0, None

        def done():
            name = f"pages-{'' if first is None else first}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], names=["name", "content"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, body, refers_to in zip(*columns):
                payload = body.as_py().encode()
                if len(parts) == 1:
                    first = page_id.as_py()
                parts.append(compressor.compress(record_bytes(page_id.as_py(), url.as_py(), payload, refers_to.as_py())))
                size += len(payload)
                if size > ARCHIVE_BYTES:
                    yield done()
                    parts, size = [open_archive(dictionary)], 0
        if len(parts) > 1:
            yield done()

    return records.mapInArrow(pack, "name string, content binary")
